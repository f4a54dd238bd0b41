"""Strict-before operators against brute force, including the paths for keys that hold most of the rows."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strictasof.operators import prior as P
from strictasof.operators.grouped import average_ranks, group_quantiles, leave_one_out, relativize
from strictasof.operators.order_statistics import prior_quantile
from strictasof.operators.ranks import average_positions, sorted_positions, value_ranks


@pytest.fixture(scope="module")
def facts(spark):
    """One key holds a third of the rows; some keys and values are null; several rows share a date."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = 1 if i % 3 == 0 else rng.choice([2, 3, 4, 5, None])
        day = date(2020, 1, 1) + timedelta(days=rng.randrange(25))
        value = None if rng.random() < 0.1 else float(rng.randrange(40)) / 4
        rows.append((i, key, day, value))
    return pd.DataFrame(rows, columns=["id", "k", "d", "v"]).astype({"k": "Int64"}), spark.createDataFrame(
        rows, "id long, k long, d date, v double")


def earlier(pdf, row, key=True):
    same = pdf[(pdf.k == row.k) & (pdf.d < row.d)] if key else pdf[pdf.d < row.d]
    return same


def test_running_aggregates_match_brute_force(facts):
    pdf, df = facts
    out = P.with_prior(df, ["k"], "d", {
        "s": P.running_sum(F.col("v")), "n": P.running_count(F.col("v").isNotNull()), "lo": P.running_min(F.col("v")),
        "hi": P.running_max(F.col("v")), "last": P.latest(F.col("id"), "v")}).collect()
    assert len(out) == len(pdf)
    known = {r["id"]: r for r in out}
    for row in pdf.itertuples():
        got = known[row.id]
        if pd.isna(row.k):
            assert (got["s"], got["n"], got["last"]) == (None, 0, None)
            continue
        past = earlier(pdf, row)
        values = past.v.dropna()
        assert got["n"] == len(values)
        assert got["s"] == (pytest.approx(values.sum()) if len(values) else None)
        assert got["lo"] == (values.min() if len(values) else None) and got["hi"] == (values.max() if len(values) else None)
        if len(past):
            newest = past.sort_values(["d", "id"]).iloc[-1]
            assert got["last"]["_tie"] == newest.id
        else:
            assert got["last"] is None


def test_without_keys_there_is_one_series(facts):
    pdf, df = facts
    out = {r["id"]: r["n"] for r in P.with_prior(df, [], "d", {"n": P.running_count()}).collect()}
    assert all(out[r.id] == (pdf.d < r.d).sum() for r in pdf.itertuples())


def test_a_leaky_frame_is_told_apart(facts):
    """The same-day twin of the operator must differ, else the strictness test proves nothing."""
    from pyspark.sql import Window
    _, df = facts
    strict = P.with_prior(df.where("k is not null"), ["k"], "d", {"n": P.running_count()})
    leaky = strict.withColumn("leaky", F.count("*").over(Window.partitionBy("k").orderBy("d")))
    assert leaky.where("leaky != n").count() == strict.count()


def test_targets_on_dates_without_facts(spark, facts):
    _, df = facts
    targets = spark.createDataFrame([(1, date(2019, 1, 1)), (1, date(2021, 1, 1)), (9, date(2021, 1, 1))], "k long, d date")
    out = {(r["k"], r["d"].year): r["n"] for r in P.with_prior(targets, ["k"], "d", {"n": P.running_count()}, facts=df).collect()}
    assert out == {(1, 2019): 0, (1, 2021): df.where("k = 1").count(), (9, 2021): 0}


def test_recent_values_newest_first(facts):
    pdf, df = facts
    out = {r["id"]: r["recent"] for r in P.with_recent(df, ["k"], "d", ["id"], F.col("v"), 5, "recent").collect()}
    for row in pdf.dropna(subset=["k"]).itertuples():
        past = earlier(pdf, row).dropna(subset=["v"]).sort_values(["d", "id"], ascending=False)
        assert (out[row.id] or []) == list(past.v.head(5))


@pytest.mark.parametrize("q", [0.25, 0.5])
def test_prior_quantile(facts, q):
    pdf, df = facts
    out = {r["id"]: r["q"] for r in P.with_prior_quantile(df, ["k"], "d", F.col("v"), q, "q").collect()}
    assert len(out) == len(pdf)
    for row in pdf.itertuples():
        values = [] if pd.isna(row.k) else earlier(pdf, row).v.dropna()
        assert out[row.id] == (pytest.approx(np.quantile(values, q)) if len(values) else None)


@pytest.mark.parametrize("bits", [(1, 1), (2, 1), (3, 2)])
@pytest.mark.parametrize("q", [0.0, 0.3, 1.0])
def test_prior_quantile_through_levels(spark, bits, q):
    rng = np.random.default_rng(4)
    rows = [(k, int(d), float(v)) for k, n in ((1, 300), (2, 40), (3, 5), (4, 1))
            for d, v in zip(rng.integers(0, 30, n), rng.integers(0, n // 2 + 1, n))]
    df = spark.createDataFrame(rows, "k int, d int, _value double").repartition(3)
    probes = spark.createDataFrame([(k, d) for k in range(1, 6) for d in range(32)], "k int, d int")
    got = {(r.k, r.d): r._quantile for r in prior_quantile(probes, df, ["k"], "d", q, *bits).collect()}
    want = {}
    for k in range(1, 5):
        for d in range(32):
            values = [v for a, b, v in rows if a == k and b < d]
            if values:
                want[k, d] = pytest.approx(np.quantile(values, q))
    assert got == want


def test_quantiles_of_sums_in_any_order(spark):
    """Facts whose last bit depends on the order of summation are counted once, so none is lost."""
    parts = spark.range(4000).selectExpr("id % 400 as fact", "id % 7 as k", "(id * 0.1 + 1) / (id + 3) * 1e6 as x")
    facts = parts.repartition(7).groupBy("fact").agg(F.first("k").alias("k0"), F.sum("x").alias("v"))
    rows = facts.selectExpr("fact % 3 as k", "fact as d", "v")
    out = P.with_prior_quantile(rows, ["k"], "d", F.col("v"), 0.5, "q").collect()
    assert len(out) == 400 and sum(r.q is None for r in out) == 3
    for r in out:
        values = [o.v for o in out if o.k == r.k and o.d < r.d]
        assert r.q is None if not values else r.q == pytest.approx(np.median(values))


def test_asof_attach_takes_the_newest_strictly_earlier_version(spark):
    rows = spark.createDataFrame([(1, date(2020, 1, 5)), (1, date(2020, 1, 3)), (2, date(2020, 1, 5))], "horse_id long, date date")
    versions = spark.createDataFrame([(1, date(2020, 1, 1), 0.1), (1, date(2020, 1, 3), 0.3), (1, date(2020, 1, 5), 0.5)],
                                     "horse_id long, as_of date, effect double")
    out = {(r[0], r[1].day): (r[2], r[3]) for r in P.asof_attach(rows, versions, ["horse_id"], "date", "effect", "f302").collect()}
    assert out == {(1, 5): (0.3, 0), (1, 3): (0.1, 0), (2, 5): (None, 1)}


@pytest.mark.parametrize("ranges", [1, 3, 30])
def test_value_ranks_do_not_depend_on_the_ranges(facts, ranges):
    pdf, df = facts
    out = {(r["k"], r["v"]): (r["n_equal"], r["n_below"], r["n_group"]) for r in value_ranks(df, ["k"], "v", ranges).collect()}
    assert len(out) == len(pdf.dropna(subset=["v"]).groupby(["k", "v"], dropna=False))
    for (k, v), got in out.items():
        group = pdf[pdf.k.isna()] if k is None else pdf[pdf.k == k]
        assert got == ((group.v == v).sum(), (group.v < v).sum(), group.v.notna().sum())


def test_sorted_positions_of_texts(spark):
    words = [f"Customer#{i:05d}" for i in range(300)]
    got = {r["w"]: r["code"] for r in sorted_positions(spark.createDataFrame([(w,) for w in words * 2], "w string"), "w", ranges=7).collect()}
    assert got == {w: i for i, w in enumerate(words)}


@pytest.mark.parametrize("raw", [False, True])
def test_average_ranks(facts, raw):
    pdf, df = facts
    out = {r["id"]: r["v_avg_rank"] for r in average_ranks(df.where("k is not null"), ["k"], ["v"], raw=raw).collect()}
    expected = pdf.dropna(subset=["k"]).assign(r=lambda x: x.groupby("k").v.rank(method="average"))
    assert all(out[r.id] == (None if pd.isna(r.r) else r.r) for r in expected.itertuples())


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_average_positions_across_ranges(spark, ranges):
    rng = np.random.default_rng(ranges)
    rows = [(None if g == 2 else int(g), float("nan") if v == 9 else float(v), i)
            for i, (g, v) in enumerate(zip(rng.choice(4, 300, p=[.6, .2, .1, .1]), rng.choice([0, 0, 0, 0, 1, 2, 3, 9], 300)))]
    df = spark.createDataFrame(rows, "g int, v double, id long").repartition(3)
    got = {r.id: r._rank for r in average_positions(df, ["g"], "v", "id", ranges).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v", "id"]).fillna({"g": -1, "v": 1e9})
    frame["rank"] = frame.groupby("g").v.rank(method="average")
    assert got == dict(zip(frame.id, frame["rank"]))


def test_group_quantiles(facts):
    pdf, df = facts
    out = {r["k"]: (r["q"], r["n"]) for r in group_quantiles(
        df.where("k is not null"), ["k"], "v", {"q": 0.3}, count="n").collect()}
    for k, group in pdf.dropna(subset=["k"]).groupby("k"):
        assert out[k] == (pytest.approx(np.quantile(group.v.dropna(), 0.3)), group.v.notna().sum())


def test_relativize_rules(spark):
    rows = [(1, "a", 1.0), (1, "b", 3.0), (1, "c", None), (2, "a", 5.0), (2, "b", 5.0), (3, "a", 9.0)]
    df = spark.createDataFrame(rows, "race_id long, h string, x double").withColumn("n_starters", F.lit(4))
    out = {(r["race_id"], r["h"]): (r["x_z"], r["x_rank"]) for r in relativize(df, "x").collect()}
    sd = np.std([1, 3], ddof=1)
    assert out[(1, "a")] == (pytest.approx(-1 / sd), 0.25) and out[(1, "b")] == (pytest.approx(1 / sd), 0.5)
    assert out[(1, "c")] == (None, None)
    assert out[(2, "a")] == (None, 0.375) and out[(3, "a")] == (None, 0.25)  # no spread; a single member


def test_leave_one_out(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 3, None), (2, 1, 7.0)], "race_id long, horse_id long, x double")
    out = {(r[0], r[1]): (r["t"], r["n"]) for r in leave_one_out(df, ["race_id"], ["horse_id"], F.col("x"), "t", "n").collect()}
    assert out == {(1, 1): (3.0, 1), (1, 2): (2.0, 1), (1, 3): (5.0, 2), (2, 1): (0.0, 0)}


def test_empty_input_keeps_the_schema(spark):
    df = spark.createDataFrame([], "k long, d date, v double")
    out = P.with_prior_quantile(P.with_prior(df, ["k"], "d", {"s": P.running_sum(F.col("v"))}), ["k"], "d", F.col("v"), 0.5, "q")
    assert out.count() == 0 and dict(out.dtypes)["q"] == "double"
