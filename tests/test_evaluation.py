"""Probabilities, combinations, tickets, bootstrap, ranker and effects against direct computations."""

import itertools
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictasof.functions import vocabulary as V
from strictasof.operators import components, effects
from strictasof.operators.keys import require_disjoint
from strictasof.plans import bootstrap, evaluate as E, folds as T, probability as P, ranker as R, stage_one
from strictasof.sources import prediction_log as L
from tests.conftest import D, RACE, RUNNER, race, rows_of, runner


def pair(p, q):
    return p * q / (1 - p)


def triple(p, q, r):
    return p * q / (1 - p) * r / (1 - p - q)


def brute_combinations(win, kind):
    out = {}
    for size in {V.EXACTA: (2,), V.QUINELLA: (2,), V.TRIFECTA: (3,), V.TRIO: (3,), V.WIDE: (3,)}[kind]:
        for c in itertools.permutations(win, size):
            value = pair(*[win[i] for i in c]) if size == 2 else triple(*[win[i] for i in c])
            if kind in (V.EXACTA, V.TRIFECTA):
                out[c] = value
            elif kind in (V.QUINELLA, V.TRIO):
                out[tuple(sorted(c))] = out.get(tuple(sorted(c)), 0) + value
            else:
                for a, b in itertools.combinations(sorted(c), 2):
                    out[(a, b)] = out.get((a, b), 0) + value
    return out


@pytest.mark.parametrize("kind", P.COMBINATION_TYPES)
def test_top_combinations_equal_the_full_enumeration(spark, kind):
    rng = random.Random(3)
    events = {}
    for event, size in ((1, 4), (2, 9), (3, 14)):
        raw = [rng.expovariate(1) ** 2 for _ in range(size)]
        events[event] = {i + 1: x / sum(raw) for i, x in enumerate(raw)}
    df = spark.createDataFrame([(e, n, p) for e, ps in events.items() for n, p in ps.items()], "race_id long, number long, win_prob double")
    got = P.top_combinations(df, kind, 6).orderBy("race_id", "rank").collect()
    for event, win in events.items():
        full = sorted(brute_combinations(win, kind).items(), key=lambda kv: (-kv[1], kv[0]))[:6]
        mine = [(tuple(r["numbers"]), r["prob"]) for r in got if r["race_id"] == event]
        assert [c for c, _ in mine] == [c for c, _ in full]
        assert [p for _, p in mine] == pytest.approx([p for _, p in full])
    total = sum(brute_combinations(events[3], kind).values())
    assert total == pytest.approx(3.0 if kind == V.WIDE else 1.0)


def test_a_certain_winner_gives_no_division_by_zero(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0)], "race_id long, number long, win_prob double")
    for kind in P.COMBINATION_TYPES:
        assert all(r["prob"] == 0.0 for r in P.top_combinations(df, kind, 3).collect())
    with pytest.raises(ValueError):
        P.top_combinations(df, "枠連")


def test_temperature_keeps_order_and_finds_the_minimum(spark):
    rng = np.random.default_rng(5)
    rows = []
    for event in range(60):
        s = rng.normal(size=6) * 2
        p = np.exp(s / 2.5) / np.exp(s / 2.5).sum()
        winner = rng.choice(6, p=p)
        rows += [(event, i, float(x), bool(i == winner)) for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "race_id long, horse_id long, score double, is_winner boolean")
    def loss(t):
        total = 0.0
        for event in range(60):
            s = np.array([r[2] for r in rows if r[0] == event]) / t
            w = [r[3] for r in rows if r[0] == event].index(True)
            total -= s[w] - s.max() - math.log(np.exp(s - s.max()).sum())
        return total / 60
    fitted = P.fit_calibrator(df, points=48)
    best = min((loss(t), t) for t in np.linspace(0.1, 10, 2000))
    assert fitted.temperature == pytest.approx(best[1], abs=0.01) and not fitted.at_bound
    assert fitted.logloss_after <= fitted.logloss_before and fitted.logloss_before == pytest.approx(loss(1.0))
    probs = fitted.apply(df).collect()
    assert sum(r["win_prob"] for r in probs if r["race_id"] == 1) == pytest.approx(1.0)
    empty = P.fit_calibrator(df.limit(0))
    assert (empty.temperature, empty.n_races_fit, empty.at_bound) == (1.0, 0, False)


def market(spark):
    rows = [runner(1, 1, odds_win=2.0, popularity=1, finish_pos=1), runner(1, 2, odds_win=4.0, popularity=2, finish_pos=1),
            runner(1, 3, odds_win=4.0, popularity=3, finish_pos=3), runner(1, 4, odds_win=2.0, status="出走取消", finish_pos=None),
            runner(2, 1, odds_win=2.0, popularity=2, finish_pos=None, status="競走中止"), runner(2, 2, odds_win=2.0, popularity=3, finish_pos=1)]
    return rows_of(spark, RUNNER, rows)


def test_market_metrics_with_a_dead_heat(spark):
    entries = market(spark)
    scores = {r["race_id"]: r for r in E.market_scores(entries).collect()}
    assert scores[1]["log_loss"] == pytest.approx(-(0.5 * math.log(0.5) + 0.5 * math.log(0.25)))
    assert scores[1]["brier"] == pytest.approx(0 + 0.25 ** 2 + 0.25 ** 2) and scores[1]["n_runners"] == 3
    assert scores[2]["picked_finish_pos"] is None
    (m,) = E.probability_metrics(E.market_scores(entries)).collect()
    assert (m["n_races"], m["n_runners"], m["top1_hit_rate"]) == (2, 5, 1.0)  # the pick without a result is skipped


def test_ledger_counts_tickets_without_listing_pairs(spark):
    entries = rows_of(spark, RUNNER, [runner(1, i, popularity=i) for i in (1, 2, 3)] + [runner(1, 4, popularity=4, status="出走取消")]
                      + [runner(2, 1, popularity=2), runner(2, 2, popularity=3)])
    pays = spark.createDataFrame([
        (1, "単勝", "2", [2], 540), (1, "複勝", "1", [1], 120), (1, "複勝", "2", [2], 200), (1, "ワイド", "1-2", [1, 2], 300),
        (1, "ワイド", "2-4", [2, 4], 999), (2, "単勝", "1", [1], 250)], "race_id long, bet_type string, comb_key string, combination array<int>, payout int")
    got = {(r["race_id"], r["strategy"], r["bet_type"]): tuple(r)[3:] for r in E.race_ledger(entries, pays).collect()}
    assert got[(1, "uniform", "単勝")] == (3, 1, 300, 540) and got[(1, "favorite", "単勝")] == (1, 0, 100, 0)
    assert got[(1, "uniform", "複勝")] == (3, 2, 300, 320) and got[(1, "favorite", "複勝")] == (1, 1, 100, 120)
    assert got[(1, "uniform", "ワイド")] == (3, 1, 300, 300) and got[(1, "favorite", "ワイド")] == (2, 1, 200, 300)
    assert got[(2, "favorite", "ワイド")] == (0, 0, 0, 0) and got[(2, "uniform", "ワイド")] == (1, 0, 100, 0)
    (roi,) = [r["roi"] for r in E.returns(E.race_ledger(entries, pays)).collect() if (r["strategy"], r["bet_type"]) == ("uniform", "単勝")]
    assert roi == pytest.approx(790 / 500)


def test_bootstrap_agrees_with_resampling_rows(spark):
    rng = np.random.default_rng(1)
    pay = rng.choice([0, 0, 0, 150, 320, 900], size=400)
    df = spark.createDataFrame([(int(p), 100) for p in pay], "p long, s long")
    mine = np.array([r["ratio"] for r in bootstrap.bootstrap_ratio(df, F.col("p"), F.col("s"), 3000, seed=2).collect()])
    rows = pay[rng.integers(0, 400, size=(3000, 400))].sum(axis=1) / 40000
    assert mine.mean() == pytest.approx(rows.mean(), abs=0.02) and mine.std() == pytest.approx(rows.std(), rel=0.08)
    again = bootstrap.bootstrap_interval(df, F.col("p"), F.col("s"), 500, seed=2).collect()
    for parts in (1, 7):  # the draws of a value do not depend on where it lies
        cells = bootstrap.value_cells(df.repartition(parts), {"num": F.col("p"), "den": F.col("s")}).repartition(parts)
        sums = {r["rep"]: r["num"] for r in bootstrap.bootstrap_sums(cells, ["num", "den"], 200, seed=2).collect()}
        assert parts == 1 or sums == last
        last = sums
    assert again == bootstrap.bootstrap_interval(df, F.col("p"), F.col("s"), 500, seed=2).collect()
    assert again[0]["ci_low"] < again[0]["ratio"] < again[0]["ci_high"]
    (one,) = bootstrap.bootstrap_interval(df.limit(1), F.col("p"), F.col("s"), 50).collect()
    assert one["ci_low"] == one["ci_high"] == one["ratio"]


def numeric_loss(z, order):
    total, alive = 0.0, list(range(len(z)))
    for i in order:
        total -= z[i] - math.log(sum(math.exp(z[j]) for j in alive))
        alive.remove(i)
    return total


def test_gradient_matches_the_numeric_derivative(spark):
    z, labels = [0.3, -1.2, 2.0, 0.5, 40.0], [0, 3, 1, 2, 0]
    rows = spark.createDataFrame([(1, i, z[i], labels[i]) for i in range(5)], "race_id long, horse_id long, score double, label int")
    out = {r["horse_id"]: r for r in R.pl_gradient(R.placed_stages(rows, ["race_id"], R.MEMBER), F.col("score"), weight=F.lit(2.0)).collect()}
    order, step = [1, 3, 2], 1e-5
    for i in range(5):
        up, down = list(z), list(z)
        up[i] += step
        down[i] -= step
        slope = (numeric_loss(up, order) - numeric_loss(down, order)) / (2 * step)
        assert out[i]["grad"] == pytest.approx(2 * slope, abs=1e-6)
        assert out[i]["hess"] >= 2e-6


def test_ranker_learns_and_walks_forward(spark):
    rng = np.random.default_rng(4)
    rows = []
    for event in range(240):
        day = date(2015 + event // 48, 1 + (event % 48) // 4, 1 + event % 4)
        x = rng.normal(size=(5, 2))
        order = np.argsort(-(1.5 * x[:, 0] + rng.gumbel(size=5)))
        for i in range(5):
            rows.append((event, i, day, "G1" if event % 3 == 0 else None, int(3 - list(order).index(i)) if list(order).index(i) < 3 else 0, 1.0,
                         float(x[i, 0]), float(x[i, 1])))
    df = spark.createDataFrame(rows, "race_id long, horse_id long, date date, grade string, label int, sample_weight double, f1 double, f2 double")
    fitted = R.fit_rankers(df, ["f1", "f2"], {"a": F.lit("train"), "b": F.when(F.col("race_id") < 120, "train").otherwise("valid")}, rounds=6)
    assert all(w[0] > 0.7 and abs(w[1]) < 0.3 for w in fitted.weights.values())
    races = df.select("race_id", "date", "grade").distinct()
    plan = T.fold_rows(T.make_folds(races, date(2030, 1, 1)))
    assert [f["valid_start"].year for f in plan] == [2018, 2019]
    valid, oof, rounds = R.walk_forward(df, ["f1", "f2"], plan, F.col("grade") == "G1", n_blocks=2, rounds=3, patience=2)
    got = valid.collect()
    assert len(got) == 2 * 48 * 5 and {r["fold_index"] for r in got} == {0, 1} and all(1 <= n <= 3 for n in rounds.values())
    sums = {}
    for r in got:
        sums[r["race_id"]] = sums.get(r["race_id"], 0) + r["y_pred"]
    assert all(s == pytest.approx(1.0) for s in sums.values())
    loss = E.group_log_loss(valid).agg(F.avg("log_loss")).first()[0]
    assert loss < math.log(5)
    assert oof.where("not is_winner is null").count() == oof.count() > 0
    with pytest.raises(ValueError):
        require_disjoint(valid.select("race_id", "horse_id", "fold_index").unionByName(
            valid.select("race_id", "horse_id", (F.col("fold_index") + 1).alias("fold_index"))), ["race_id", "horse_id"], "fold_index")
    with pytest.raises(ValueError):
        fitted.require_columns(["f2", "f1"])
    top = R.drivers(df.where("race_id = 0"), fitted, "a", top_k=1).collect()
    assert len(top) == 5 and {r["family"] for r in top} == {R.OTHER_FAMILY}


def test_folds_blocks_and_weights(spark):
    races = rows_of(spark, RACE, [race(i, date(2015 + i, 6, 1), grade="G1" if i == 6 else None) for i in range(7)])
    plan = T.fold_rows(T.make_folds(races, date(2021, 12, 31)))
    assert [(f["valid_start"], f["train_start"]) for f in plan] == [(date(y, 1, 1), date(2015, 6, 1)) for y in (2018, 2019, 2020)]
    assert plan[0]["inner_valid_start"] == date(2017, 1, 1) and len({f["seed"] for f in plan}) == 3
    with pytest.raises(ValueError):
        T.make_folds(races, date(2021, 12, 31), min_train_years=2)
    days = spark.createDataFrame([(date(2020, 1, d),) for d in range(1, 13)], "d date")
    blocks = [r[0] for r in days.orderBy("d").select(T.cross_fit_block(F.col("d"), date(2020, 1, 1), date(2020, 1, 10), 4)).collect()]
    assert blocks == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, None, None]
    assert T.block_starts(date(2020, 1, 1), date(2020, 1, 10), 4) == [date(2020, 1, d) for d in (1, 4, 7, 9)]


def test_pace_target_uses_lap_order(spark):
    laps = spark.createDataFrame([(1, n, v) for n, v in zip((2, 3, 5, 8), (12.0, 11.0, 11.5, 12.5))] + [(2, n, 12.0) for n in (1, 2, 3)],
                                 "race_id long, furlong_no int, lap_sec double")
    races = rows_of(spark, RACE, [race(1, D[0], distance=1000), race(2, D[0])])
    assert [tuple(r) for r in T.pace_target(laps, races).collect()] == [(1, pytest.approx(35.0 / 3 - 12.0 / 2), 4)]


def test_components_follow_long_chains(spark):
    chain = [(i, i) for i in range(40)] + [(i + 1, i) for i in range(39)]
    edges = spark.createDataFrame(chain + [(100, 500), (101, 500)], "race_id long, horse_id long")
    labels = {r["race_id"]: r["component"] for r in components.event_components(edges).collect()}
    assert {labels[i] for i in range(40)} == {0} and labels[100] == labels[101] == 100
    assert {r[0] for r in components.largest_component(edges).collect()} == set(range(40))


def test_effects_match_a_dense_computation(spark):
    rng = np.random.default_rng(9)
    rows = [runner(r, h, time_sec=float(90 + 2 * (h % 3) + 0.5 * r + rng.normal())) for r in range(1, 13) for h in rng.choice(np.arange(1, 9), 5, replace=False).tolist()]
    races = {r: race(r, D[r], race_class="新馬" if r % 2 else "オープン") for r in range(1, 13)}
    tables = {"races": rows_of(spark, RACE, list(races.values())), "runners": rows_of(spark, RUNNER, rows)}
    fit = effects.fit_effects(tables["runners"].join(tables["races"], "race_id"), date(2020, 2, 1), max_iter=4, tol=0.0)
    t = np.array([r["time_sec"] for r in rows])
    ev, en = np.array([r["race_id"] for r in rows]), np.array([r["horse_id"] for r in rows])
    dev = t - np.array([t[ev == e].mean() for e in ev])
    y = t / dev.std(ddof=1)
    x = np.stack([np.ones(len(rows)), [float(races[e]["race_class"] == "新馬") for e in ev]], axis=1)
    solve = lambda target: x @ (np.linalg.pinv(x) @ target)
    u, v = {e: 0.0 for e in set(ev)}, {h: 0.0 for h in set(en)}
    fitted, ku, kv = solve(y), 1.0, 1.0
    for _ in range(4):
        nu = {e: (y - fitted - [v[h] for h in en])[ev == e].sum() / ((ev == e).sum() + ku) for e in u}
        nv = {h: (y - fitted - [nu[e] for e in ev])[en == h].sum() / ((en == h).sum() + kv) for h in v}
        mu, mv = np.mean(list(nu.values())), np.mean(list(nv.values()))
        u, v = {e: a - mu for e, a in nu.items()}, {h: a - mv for h, a in nv.items()}
        rest = y - np.array([u[e] for e in ev]) - np.array([v[h] for h in en])
        fitted = solve(rest)
        error = (rest - fitted).var()
        ku, kv = error / np.var(list(u.values())), error / np.var(list(v.values()))
    assert fit.n_iter == 4 and fit.sigma2_error == pytest.approx(error)
    assert {r[0]: r[1] for r in fit.horse_effects.collect()} == pytest.approx(v)
    assert {r[0]: r[1] for r in fit.race_effects.collect()} == pytest.approx(u)


def test_prediction_log_round_trip(spark, tmp_path):
    pick = lambda kind, numbers, stake=1.0: dict(bet_type=kind, horse_numbers=numbers, stake=stake, note="")
    record = lambda race_id, agent, picks, at="t1": (race_id, "2020-01-01", at, agent, "", "", {"1": 0.5}, False, picks)
    make = lambda rows: spark.createDataFrame(rows, L.RECORD)
    log = make([record(1, "a", [pick("複勝", [2]), pick("ワイド", [3, 1])]), record(2, "a", [pick("単勝", [1])])])
    log.write.json(str(tmp_path / "log"))
    log = L.read_log(spark, str(tmp_path / "log"))
    entries = rows_of(spark, RUNNER, [runner(1, 1), runner(1, 2, finish_pos=2), runner(2, 1, finish_pos=None), runner(3, 1, finish_pos=None)])
    pays = spark.createDataFrame([(1, "ワイド", "1-3", [1, 3], 450), (1, "複勝", "1", [1], 110)],
                                 "race_id long, bet_type string, comb_key string, combination array<int>, payout int")
    picks = {r["bet_type"]: (r["payout_ratio"], r["profit"]) for r in L.settled_picks(log, entries, pays).collect()}
    assert picks == {"複勝": (0.0, -1.0), "ワイド": (4.5, 3.5)}
    summary = {r["bet_type"]: (r["n_bets"], r["roi"], r["hit_rate"]) for r in L.score_summary(L.settled_picks(log, entries, pays)).collect()}
    assert summary == {"複勝": (1, 0.0, 0.0), "ワイド": (1, 4.5, 1.0), None: (2, 2.25, 0.5)}
    ends = {r["bet_type"]: r for r in L.score_intervals(L.settled_picks(log, entries, pays), n_boot=200).collect()}
    assert {k: (r["n_bets"], r["roi"]) for k, r in ends.items()} == {"複勝": (1, 0.0), "ワイド": (1, 4.5), None: (2, 2.25)}
    assert (ends[None]["ci_low"], ends[None]["ci_high"], ends["ワイド"]["ci_low"]) == (0.0, 4.5, 4.5)
    assert L.score_intervals(L.settled_picks(log, entries.limit(0), pays), n_boot=10).count() == 0
    assert tuple(L.log_warnings(log, entries).first()) == (2, 1, 2)
    new = make([record(1, "b", [pick("単勝", [1])]), record(2, "a", [pick("単勝", [1])]), record(2, "b", [pick("三連単", [1, 2, 3])]),
                record(2, "c", [pick("ワイド", [1])]), record(2, "d", []), record(2, "e", [pick("単勝", [1], 0.0)]),
                record(3, "a", [pick("単勝", [1])], "t1"), record(3, "a", [pick("単勝", [2])], "t2")])
    accepted, rejected = L.accept_records(new, log, entries)
    assert [(r["race_id"], r["agent"], r["logged_at"]) for r in accepted.collect()] == [(3, "a", "t1")]
    assert sorted((r["race_id"], r["agent"], r["reason"]) for r in rejected.collect()) == [
        (1, "b", "outcome already known"), (2, "a", "already logged"), (2, "b", "bet type not logged"), (2, "c", "wrong number of entries"),
        (2, "d", "no picks"), (2, "e", "stake not positive"), (3, "a", "already logged")]


def pace_inputs(spark, n):
    numbers = ", ".join(f"{c} double" for c in stage_one.NUMERIC)
    words = ", ".join(f"{c} string" for c in stage_one.CATEGORICAL)
    rows = [(i, date(2020, 1, 1) + timedelta(days=i), *[float(i % (k + 2)) for k in range(len(stage_one.NUMERIC))],
             *[f"{c}{i % 40}" for c in stage_one.CATEGORICAL]) for i in range(n)]
    return spark.createDataFrame(rows, f"race_id long, date date, {numbers}, {words}")


def test_first_stage_takes_forty_courses(spark):
    inputs = pace_inputs(spark, 80)
    target = inputs.select("race_id", F.col("distance").alias("f102_actual"))
    model = stage_one.fit_pace(inputs, target, rounds=1)
    assert model.stages[-1].getMaxBins() == 41
    assert stage_one.predict_pace(model, inputs).where("f102 is not null").count() == 80


def test_first_stage_without_a_block_to_fit(spark):
    inputs, none = pace_inputs(spark, 20), spark.createDataFrame([], "race_id long, f102_actual double")
    pace, model = stage_one.out_of_fold_pace(inputs, none, date(2020, 1, 1), date(2020, 12, 31))
    assert pace.count() == 0 and dict(pace.dtypes) == {"race_id": "bigint", "f102": "double"} and model is None
