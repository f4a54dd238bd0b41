"""Loading jobs, quality checks, scalar functions, catalogue and the registered queries."""

from datetime import date, datetime

import os

import pytest
from pyspark.sql import functions as F

from strictasof.functions import scalars as S
from strictasof.operators import keys as K
from strictasof.operators import quality as Q
from strictasof.plans import declared, matrix
from strictasof.plans.evaluate import to_markdown
from strictasof.sources import ingest as I
from tests.conftest import D, RACE, RUNNER, race, rows_of, runner


@pytest.mark.parametrize("text, value", [
    ("ハナ", 0.05), ("アタマ", 0.1), ("クビ", 0.2), ("大", 10.0), ("同着", 0.0), ("1/2", 0.5), ("3/4", 0.75), ("1.1/4", 1.25),
    ("2.1/2", 2.5), ("3", 3.0), ("10", 10.0), (" 1/2 ", 0.5), ("1/0", None), ("", None), (None, None), ("謎", None)])
def test_margins(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(S.margin_lengths(F.col("t"))).first()[0] == value


def test_scalar_rules(spark):
    row = spark.createDataFrame([(date(2024, 2, 29), [5, 6], [3, 1], None)], "d date, v array<int>, k array<int>, n double").select(
        S.minus_years(F.col("d"), 1).alias("y"), S.element_where(F.col("v"), F.col("k"), 1).alias("at"), S.element_where(F.col("v"), F.col("k"), 9).alias("no"),
        S.last_element(F.col("v")).alias("last"), S.clip(F.lit(-9.0), 5.0).alias("c"), S.clip(F.col("n"), 5.0).alias("cn"),
        S.season(F.col("d")).alias("s"), S.shrink(F.lit(0), F.lit(None).cast("double"), 5.0, F.lit(0.4)).alias("p"),
        S.shrink(F.lit(5), F.lit(1.0), 5.0, F.lit(0.0)).alias("q"), S.changed(F.col("n"), F.lit(1.0)).alias("x"),
        S.changed_or_null(F.col("n"), F.lit(1.0)).alias("z"), S.distance_band(F.lit(1401)).alias("b")).first()
    assert tuple(row) == (date(2023, 2, 28), 6, None, 6, -5.0, None, "冬", 0.4, 0.5, 0.0, 1.0, "マイル")
    assert S.minus_years_date(date(2024, 2, 29), 4) == date(2020, 2, 29) and S.minus_years_date(date(2024, 2, 29), 3) == date(2021, 2, 28)


def test_sealed_events(spark):
    rows = spark.createDataFrame([(date(2024, 6, 1), "G1"), (date(2024, 6, 1), "G2"), (date(2024, 6, 1), None), (date(2020, 6, 1), "G1")], "date date, grade string")
    assert [r[0] for r in rows.select(S.sealed(F.col("date"), F.col("grade"), date(2025, 1, 1))).collect()] == [True, False, False, False]


def clean():
    races = [race(1, D[0], n_entries=4, n_starters=3, corner_nos=[3, 4])]
    runners = [runner(1, 1, finish_pos=1, odds_win=2.0, popularity=1, corners=[1, 1]), runner(1, 2, finish_pos=2, odds_win=3.0, popularity=2, corners=[2, 2]),
               runner(1, 3, status="競走中止", finish_pos=None, odds_win=4.0, popularity=3, corners=None), runner(1, 4, status="出走取消", finish_pos=None, odds_win=None, popularity=None, corners=None)]
    pays = [(1, "単勝", "1", [1], 200), (1, "枠連", "7-8", [7, 8], 900)]
    return races, runners, pays


def checked(spark, races, runners, pays):
    return {"races": rows_of(spark, RACE, races), "runners": rows_of(spark, RUNNER, runners),
            "payouts": spark.createDataFrame(pays, "race_id long, bet_type string, comb_key string, combination array<int>, payout int")}


def test_a_clean_event_has_no_violations(spark):
    tables = checked(spark, *clean())
    assert Q.fail_rows(tables).count() == 0 and Q.exit_code(tables) == 0
    assert {r["check_id"]: r["n"] for r in Q.fail_counts(tables).collect()} == {name: 0 for name in Q.FAIL_CHECKS}


@pytest.mark.parametrize("check, change", [
    ("headcount_starters", lambda r, e, p: r[0].update(n_starters=2)),
    ("headcount_entries", lambda r, e, p: r[0].update(n_entries=9)),
    ("orphan_race", lambda r, e, p: r.append(race(2, D[1], n_entries=0, n_starters=0))),
    ("finish_pos_rank", lambda r, e, p: e[1].update(finish_pos=3)),
    ("status_columns", lambda r, e, p: e[2].update(finish_pos=3)),
    ("status_columns", lambda r, e, p: e[0].update(time_sec=None)),
    ("status_domain", lambda r, e, p: e[3].update(status="謎")),
    ("payout_horses", lambda r, e, p: p.append((1, "複勝", "4", [4], 100))),
    ("odds_monotonic", lambda r, e, p: e[2].update(odds_win=2.5)),
    ("corners_uniform", lambda r, e, p: e[0].update(corners=[1, 1, 1])),
])
def test_each_violation_is_found(spark, check, change):
    races, runners, pays = clean()
    change(races, runners, pays)
    found = Q.FAIL_CHECKS[check](checked(spark, races, runners, pays)).collect()
    assert len(found) == 1 and found[0]["race_id"] in (1, 2)


@pytest.mark.parametrize("positions, wrong", [([1, 1, 3], 0), ([1, 2, 2], 0), ([1, 1, 1], 0), ([1, 1, 2], 1), ([2, 3, 4], 3), ([1, 2, 4], 1)])
def test_tied_positions(spark, positions, wrong):
    runners = [runner(1, i, finish_pos=p) for i, p in enumerate(positions, 1)]
    assert Q.rank_differs({"runners": rows_of(spark, RUNNER, runners)}).count() == wrong


def test_rates_and_findings(spark):
    tables = checked(spark, *clean()) | {
        "rejected_rows": spark.createDataFrame([("202001", "unknown_finish_marker", "謎"), ("x", "other", "y")], "source_key string, reason string, raw string"),
        "fetch_log": spark.createDataFrame([("20200101", "day_index", "empty"), ("20200102", "archive", "http_error"), ("20200103", "archive", "ok")],
                                           "source_key string, page_kind string, outcome string"),
        "odds": spark.createDataFrame([(1, "単勝")], "race_id long, bet_type string"), "laps": spark.createDataFrame([], "race_id long")}
    rows = {(r["check_id"], r["cut"], r["bucket"]): (r["num"], r["den"]) for r in Q.warn_rows(tables).collect()}
    assert rows[("rejected_rate", "by_year", "2020")] == (1, 5) and rows[("rejected_rate", "by_year", None)] == (1, 1)
    assert rows[("rejected_rate", "by_group", "unknown_finish_marker (謎)")] == (1, 1)
    assert rows[("fetch_incomplete", "by_year", "2020")] == (1, 3) and rows[("odds_coverage", "by_group", "単勝")] == (1, 1)
    assert rows[("laps_coverage", "by_year", "2020")] == (1, 1) and rows[("corners_missing", "by_year", "2020")] == (0, 2)
    ledger = Q.findings(tables, run_id=3).collect()
    assert {r["run_id"] for r in ledger} == {3} and ("laps_coverage:year=2020", "1/1") in {(r["check_id"], r["detail"]) for r in ledger}


def test_constraints(spark):
    races = rows_of(spark, RACE, [race(1, D[0], surface="砂", n_entries=1), race(2, D[0], race_class=None, direction=None), race(3, D[0], distance=0)])
    broken = {(r["race_id"], r["rule"]) for r in Q.broken_rules(races, ["race_id"], Q.event_rules()).collect()}
    assert broken == {(1, "surface"), (1, "n_entries >= n_starters"), (3, "distance > 0")}
    runners = rows_of(spark, RUNNER, [runner(1, 1), runner(1, 1), runner(9, 2), runner(1, 3, affiliation="謎")])
    assert [tuple(r) for r in Q.duplicate_keys(runners, ["race_id", "horse_id"]).collect()] == [(1, 1, 2)]
    assert Q.missing_parents(runners, races, ["race_id"]).count() == 1
    assert [r["rule"] for r in Q.broken_rules(runners, ["race_id"], Q.entry_rules()).collect()] == ["affiliation"]
    odds = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 2.0), (3, 0.0, 1.0), (4, None, 1.0), (5, 2.0, 2.0)], "race_id long, odds_low double, odds_high double")
    assert {tuple(r) for r in Q.broken_rules(odds, ["race_id"], Q.odds_rules()).collect()} == {(2, "odds_high >= odds_low"), (3, "odds_low > 0")}
    run = Q.run_row({"races": races, "runners": runners}, 7, datetime(2020, 1, 1, 9), scope_to=date(2020, 2, 1)).first()
    assert tuple(run) == (7, datetime(2020, 1, 1, 9), None, date(2020, 2, 1), 3, 4)


def test_log_upsert_and_replacement_are_idempotent(spark):
    schema = "url string, outcome string, fetched_at int"
    log = spark.createDataFrame([("a", "http_error", 1), ("b", "ok", 1)], schema)
    new = spark.createDataFrame([("a", "ok", 2), ("c", "empty", 2)], schema)
    once = I.latest_wins(log, new, ["url"], "fetched_at")
    assert sorted(map(tuple, once.collect())) == [("a", "ok", 2), ("b", "ok", 1), ("c", "empty", 2)]
    assert sorted(I.latest_wins(once, new, ["url"], "fetched_at").collect()) == sorted(once.collect())
    old = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "source_key string, v int")
    fresh = spark.createDataFrame([("k1", 9)], "source_key string, v int")
    replaced = I.replace_keyed(old, fresh, ["source_key"])
    assert sorted(map(tuple, replaced.collect())) == [("k1", 9), ("k2", 3)]
    assert sorted(I.replace_keyed(replaced, fresh, ["source_key"]).collect()) == sorted(replaced.collect())
    gone = I.replace_keyed(old, fresh.limit(0), ["source_key"], replaced=fresh)
    assert sorted(map(tuple, gone.collect())) == [("k2", 3)]


def test_resume_keys_and_overlay(spark):
    log = spark.createDataFrame([("a", "archive", "ok"), ("b", "archive", "http_error"), ("c", "day_index", "ok")], "source_key string, page_kind string, outcome string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source_key string")
    assert sorted(r[0] for r in I.pending_keys(keys, log).collect()) == ["b", "c", "d"]
    known = spark.createDataFrame([("horse", "s", "x", 7), ("horse", "s", "y", 9)], "entity_type string, source string, source_key string, internal_id long")
    asked = spark.createDataFrame([("horse", "s", "x"), ("horse", "s", "n1"), ("horse", "s", "n2"), ("horse", "s", "n1"), ("jockey", "s", "x")],
                                  "entity_type string, source string, source_key string")
    got = {tuple(r)[:3]: r["internal_id"] for r in I.resolve_keys(asked, known).collect()}
    assert got[("horse", "s", "x")] == 7 and got[("jockey", "s", "x")] == 1
    assert {got[("horse", "s", "n1")], got[("horse", "s", "n2")]} == {10, 11}
    assert got == {tuple(r)[:3]: r["internal_id"] for r in I.resolve_keys(asked, known).collect()}
    stored = {"races": spark.createDataFrame([(1, "a", 5)], "race_id long, course string, prize int")}
    both = I.overlay(stored, {"races": spark.createDataFrame([(2, "b")], "race_id long, course string")})["races"]
    assert sorted(map(tuple, both.collect())) == [(1, "a", 5), (2, "b", None)]
    with pytest.raises(I.OverlayConflict):
        I.overlay(stored, {"races": spark.createDataFrame([(1, "b")], "race_id long, course string")})


def test_readiness_and_enrichment(spark):
    rows = spark.createDataFrame([(1, 480), (1, None), (2, 470)], "race_id long, horse_weight int")
    assert {r[0]: r[1] for r in I.readiness(rows, "horse_weight").collect()} == {1: False, 2: True}
    horses = spark.createDataFrame([(1, None, "n"), (2, 5, "m")], "horse_id long, sire_id int, name string")
    found = spark.createDataFrame([(1, 8), (2, None)], "horse_id long, sire_id int")
    assert sorted(map(tuple, I.enrich(horses, found, "horse_id", ["sire_id"]).collect())) == [(1, 8, "n"), (2, 5, "m")]


def test_catalogue_routes(spark):
    spec = declared.Feature
    table = matrix.catalogue(spark, [spec("F-1", ("a",), ("b",)), spec("F-2", ("c",), timing="当日", minutes_before=60),
                                     spec("F-3", ("d",), timing="当日", minutes_before=5), spec("F-4", ("e",), timing="当日")])
    columns = lambda route: sorted(r["column"] for r in matrix.usable_columns(table, route).collect())
    assert columns("暫定") == ["a", "b"] and columns("本命") == ["a", "b", "c"]
    assert [r["name"] for r in matrix.unresolved_deadlines(table).collect()] == ["F-4"]
    with pytest.raises(ValueError):
        matrix.catalogue(spark, [spec("F-5", ("x",), minutes_before=10)])
    with pytest.raises(ValueError):
        matrix.catalogue(spark, [spec("F-1", ("a",))] * 2)


def test_declared_columns():
    assert [declared.family(c) for c in ("f802", "f802_z", "f802_unavailable", "f703_travel_flag_unavailable", "fspd_unavailable", "jockey_id", "x")] == [
        "F-802", "F-802", "F-802", "F-703", "F-304", "F-201", declared.OTHER_FAMILY]
    assert declared.to_relativise(["f802", "f802_unavailable", "f803_distance", "f803_season", "f103", "f103_z", "f601_margin_prev", "own"]) == [
        "f802", "f601_margin_prev", "own"]


def test_staged_tables_have_an_owner(spark):
    from strictasof import session
    first, second = session.stage_table(spark.range(3)), session.stage_table(spark.range(4))
    session.release(first)
    assert second.count() == 4 and not os.path.exists(first.inputFiles()[0].removeprefix("file://")) if first.inputFiles() else True
    session.drop_staged(spark)
    folder = session.staging_folder(spark).removeprefix("file:")
    assert not os.path.exists(folder)


def test_reports(spark):
    rows, truncated = K.limited(spark.range(5).orderBy("id"), 3)
    assert rows.count() == 3 and truncated and not K.limited(spark.range(3), 3)[1]
    text = to_markdown(spark.createDataFrame([("a", 0.5, None)], "k string, v double, z string"), "t")
    assert "| a | 0.5000 | - |" in text


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_the_flagship_query_runs(spark):
    import __spark_entry__ as entry
    out = entry.entry(spark)
    assert out.columns == ["race_id", "horse_id", "owner_id", "number", "f704", "f704_unavailable"] and out.count() > 5000


@pytest.mark.parametrize("text", ["SELECT 1 AS a", "WITH t AS (SELECT 1 AS a) SELECT * FROM t -- INSERT", "VALUES (1) AS t(a)",
                                  "SELECT a FROM (SELECT 1 AS a) WHERE a IN (SELECT 1)", "SELECT 'drop table x; set a = 1' = '' OR true AS a"])
def test_queries_pass_the_gate(spark, text):
    assert K.read_only(spark, text).count() == 1


@pytest.mark.parametrize("text", [
    "CREATE TABLE gate_t (a INT) USING parquet", "CREATE TEMP VIEW gate_v AS SELECT 1 AS a", "DROP TABLE IF EXISTS gate_t", "SET spark.sql.ansi.enabled = false",
    "INSERT INTO gate_t SELECT 1", "WITH t AS (SELECT 1 AS a) INSERT INTO gate_t SELECT * FROM t", "TRUNCATE TABLE gate_t", "/* SELECT */ CACHE TABLE gate_t",
    "FROM (SELECT 1 AS a) INSERT INTO gate_t SELECT a", "INSERT OVERWRITE DIRECTORY '/tmp/gate' USING parquet SELECT 1", "EXPLAIN SELECT 1", "USE default",
    "ADD JAR x", "DELETE FROM gate_t", "UPDATE gate_t SET a = 1", "MERGE INTO gate_t USING gate_v ON true WHEN MATCHED THEN DELETE", "RESET"])
def test_what_changes_something_is_refused(spark, text):
    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(K.NotAQuery):
        K.read_only(spark, text)
    assert not spark.catalog.tableExists("gate_t") and spark.conf.get("spark.sql.ansi.enabled") == before
