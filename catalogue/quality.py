"""Queries over the data-quality operators."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from strictasof.bindings import star
from strictasof.operators import features as X
from strictasof.operators import quality as Q
from strictasof.plans import matrix
from strictasof.session import stage_table

from .oracle import MODEL, RACES, RUNNERS, TICKETS, with_tables
from .registry import Registry, r6

R = Registry()
RAN = "('出走', '降着', '競走中止', '失格')"

# operations tables bound to the stored tables: the events stream as a fetch log, labelled documents as rejects
OPS = """
fetch_log AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) || '/' || event_type AS url, CASE event_type WHEN 'signup' THEN 'day_index' ELSE 'archive' END AS page_kind,
         strftime(ts, '%Y%m%d') AS source_key, CASE event_type WHEN 'error' THEN 'http_error' WHEN 'signup' THEN 'empty' ELSE 'ok' END AS outcome,
         event_id, ts AS fetched_at FROM events),
rejected_rows AS (
  SELECT CAST(1995 + quality * 3 + toxic AS VARCHAR) || '0101' AS source_key,
         CASE WHEN toxic = 1 THEN 'unknown_finish_marker' ELSE 'corners_length_mismatch' END AS reason,
         CAST(quality AS VARCHAR) AS raw, doc_id FROM labels)"""


def fetch_log(spark, folder):
    kind, outcome = F.col("event_type"), F.col("event_type")
    return star.table(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("url"),
        F.when(kind == "signup", "day_index").otherwise("archive").alias("page_kind"),
        F.date_format("ts", "yyyyMMdd").alias("source_key"),
        F.when(outcome == "error", "http_error").when(outcome == "signup", "empty").otherwise("ok").alias("outcome"),
        "event_id", F.col("ts").alias("fetched_at"))


def rejected_rows(spark, folder):
    return star.table(spark, folder, "labels").select(
        F.concat((1995 + F.col("quality") * 3 + F.col("toxic")).cast("string"), F.lit("0101")).alias("source_key"),
        F.when(F.col("toxic") == 1, "unknown_finish_marker").otherwise("corners_length_mismatch").alias("reason"),
        F.col("quality").cast("string").alias("raw"), "doc_id")


def odds(runners):
    """Priced tickets of every event: the win price of each running number."""
    return runners.where(F.col("odds_win").isNotNull()).select(
        "race_id", F.when(F.col("number") <= 3, "複勝").otherwise("単勝").alias("bet_type"), "odds_win")


def laps(spark, folder):
    """Lap table: an order's line numbers with their smallest quantity."""
    items = star.table(spark, folder, "lineitem")
    return items.groupBy(F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("furlong_no")).agg(
        F.min("l_quantity").alias("lap_sec"))


def tables(spark, folder):
    return star.load_all(spark, folder) | {
        "fetch_log": fetch_log(spark, folder), "rejected_rows": rejected_rows(spark, folder),
        "odds": odds(star.runners(spark, folder)), "laps": laps(spark, folder)}


#: what the fail checks and rates read of entries and events
RUNNER_INPUTS = ("race_id", "horse_id", "number", "status", "finish_pos", "time_sec", "popularity", "odds_win", "corners")
RACE_INPUTS = ("race_id", "date", "n_entries", "n_starters", "corner_nos")


def stored_tables(spark, folder):
    """The tables with entries, events and placed tickets built once, for reports that run all checks."""
    runners = stage_table(star.runners(spark, folder).select(*RUNNER_INPUTS))
    return Q.with_dated(tables(spark, folder) | {
        "runners": runners, "races": stage_table(star.races(spark, folder).select(*RACE_INPUTS)),
        "payouts": stage_table(star.payouts(spark, folder, runners)), "odds": odds(runners), "laps": stage_table(laps(spark, folder))})


ODDS_SQL = "odds AS (SELECT race_id, CASE WHEN number <= 3 THEN '複勝' ELSE '単勝' END AS bet_type FROM runners WHERE odds_win IS NOT NULL)"
LAPS_SQL = "laps AS (SELECT l_orderkey AS race_id, l_linenumber AS furlong_no, min(l_quantity) AS lap_sec FROM lineitem GROUP BY 1, 2)"

STORED = "stored AS (SELECT *, CAST(month(date) AS INTEGER) AS claimed FROM races)"
NONE = "CAST(NULL AS BIGINT) AS horse_id"


def headcount(which, counted):
    return MODEL + f""", {STORED}, sizes AS (SELECT race_id, {counted} AS actual FROM runners GROUP BY 1)
    SELECT r.race_id, {NONE}, '{which}=' || r.claimed || ' actual=' || COALESCE(actual, 0) AS detail
    FROM stored r LEFT JOIN sizes USING (race_id) WHERE r.claimed <> COALESCE(actual, 0)"""


def claimed(which, check):
    """The stored count is replaced by an independent column (the month), so that many events disagree."""
    def run(spark, folder):
        t = tables(spark, folder)
        t["races"] = t["races"].withColumn(which, F.month("date"))
        return check(t)
    return run


R.add("qc_header_count", claimed("n_starters", Q.starters_differ), headcount("n_starters", f"count(*) FILTER (WHERE status IN {RAN})"))
R.add("qc_header_entries", claimed("n_entries", Q.entries_differ), headcount("n_entries", "count(*)"))
R.add("qc_orphans", lambda s, f: Q.events_without_entries(tables(s, f)), MODEL + f"""
    SELECT race_id, {NONE}, 'runners が0行' AS detail FROM races r WHERE NOT EXISTS (SELECT 1 FROM runners u WHERE u.race_id = r.race_id)""")
R.add("qc_rank", lambda s, f: Q.rank_differs(tables(s, f)), MODEL + """
    , k AS (SELECT race_id, horse_id, finish_pos, rank() OVER (PARTITION BY race_id ORDER BY finish_pos) AS expected FROM runners WHERE finish_pos IS NOT NULL)
    SELECT race_id, horse_id, 'finish_pos=' || finish_pos || ' expected=' || expected AS detail FROM k WHERE finish_pos <> expected""")


@R.query("qc_status", MODEL + """
    , c AS (SELECT race_id, horse_id, status, finish_pos, CASE WHEN frame = 4 THEN NULL ELSE time_sec END AS time_sec FROM runners)
    SELECT race_id, horse_id, 'status=' || status AS detail FROM c
    WHERE (status IN ('出走', '降着') AND (finish_pos IS NULL OR time_sec IS NULL))
       OR (status NOT IN ('出走', '降着') AND finish_pos IS NOT NULL)""")
def _(spark, folder):
    t = tables(spark, folder)
    untimed = F.when(F.coalesce(F.col("frame"), F.lit(0)) != 4, F.col("time_sec"))
    return Q.status_incoherent(t | {"runners": t["runners"].withColumn("time_sec", untimed)})


@R.query("qc_domain", """
    SELECT l_orderkey AS race_id, l_partkey AS horse_id, 'status=' || l_returnflag AS detail FROM lineitem""")
def _(spark, folder):
    t = tables(spark, folder)
    raw = star.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_partkey").alias("horse_id"), F.col("l_returnflag").alias("status"))
    return Q.status_unknown(t | {"runners": raw})


R.add("qc_array_refs", lambda s, f: Q.payout_numbers_unknown(_without_geldings(s, f)),
      TICKETS + f"""
    , named AS (SELECT race_id, bet_type, comb_key, CAST(unnest(string_split(comb_key, '-')) AS INTEGER) AS n FROM payouts)
    SELECT p.race_id, {NONE}, bet_type || ' ' || comb_key || ' 馬番' || n AS detail FROM named p
    WHERE NOT EXISTS (SELECT 1 FROM runners ru WHERE ru.race_id = p.race_id AND ru.number = n AND ru.sex <> 'セ' AND ru.status IN {RAN})""")


def _without_geldings(spark, folder):
    t = tables(spark, folder)
    return t | {"runners": t["runners"].where(F.col("sex") != "セ")}


R.add("qc_monotonic", lambda s, f: Q.odds_not_monotonic(tables(s, f)), MODEL + """
    , o AS (SELECT race_id, horse_id, popularity, odds_win FROM runners WHERE popularity IS NOT NULL AND odds_win IS NOT NULL),
    steps AS (SELECT race_id, popularity, max(odds_win) AS top FROM o GROUP BY 1, 2),
    prev AS (SELECT race_id, popularity, lag(top) OVER (PARTITION BY race_id ORDER BY popularity) AS prev FROM steps)
    SELECT race_id, horse_id, 'odds_win=' || odds_win || ' prev=' || prev AS detail FROM o JOIN prev USING (race_id, popularity)
    WHERE odds_win < prev""")
R.add("qc_array_len", lambda s, f: Q.corners_uneven(tables(s, f)), MODEL + """
    SELECT race_id, horse_id, 'len(corners)=' || len(corners) || ' len(corner_nos)=' || len(corner_nos) AS detail
    FROM runners JOIN races USING (race_id) WHERE corners IS NOT NULL AND status IN ('出走', '降着') AND len(corners) <> len(corner_nos)""")
R.add("qc_warn_by_year", lambda s, f: Q.corners_missing_by_year(tables(s, f)).select(F.col("bucket").cast("long"), "num", "den"), MODEL + """
    SELECT CAST(year(date) AS BIGINT) AS bucket, count(*) FILTER (WHERE corners IS NULL) AS num, count(*) AS den
    FROM runners JOIN races USING (race_id) WHERE status IN ('出走', '降着') AND len(corner_nos) > 0 GROUP BY 1""")
R.add("qc_reject_rate", lambda s, f: Q.rejects_by_year(tables(s, f)).select(F.col("bucket").cast("long"), "num", "den"),
      with_tables(RACES, RUNNERS, OPS) + """
    , rej AS (SELECT TRY_CAST(substr(source_key, 1, 4) AS INTEGER) AS b, count(*) AS n FROM rejected_rows GROUP BY 1),
    run AS (SELECT year(date) AS b, count(*) AS n FROM runners JOIN races USING (race_id) GROUP BY 1)
    SELECT CAST(COALESCE(rej.b, run.b) AS BIGINT) AS bucket, COALESCE(rej.n, 0) AS num, COALESCE(rej.n, 0) + COALESCE(run.n, 0) AS den
    FROM rej FULL OUTER JOIN run ON rej.b = run.b""")
R.add("qc_reject_reasons", lambda s, f: Q.rejects_by_reason(tables(s, f)), with_tables(OPS) + """
    SELECT reason || CASE WHEN reason = 'unknown_finish_marker' THEN ' (' || raw || ')' ELSE '' END AS bucket,
           count(*) AS num, count(*) AS den FROM rejected_rows GROUP BY 1""")
R.add("qc_fetch_incomplete", lambda s, f: Q.incomplete_fetches_by_year(tables(s, f)).select(F.col("bucket").cast("long"), "num", "den"),
      with_tables(OPS) + """
    SELECT CAST(substr(source_key, 1, 4) AS BIGINT) AS bucket,
           count(*) FILTER (WHERE outcome <> 'ok' AND NOT (page_kind = 'day_index' AND outcome = 'empty')) AS num, count(*) AS den
    FROM fetch_log GROUP BY 1""")
R.add("qc_fetch_kinds", lambda s, f: Q.incomplete_fetches_by_kind(tables(s, f)), with_tables(OPS) + """
    SELECT page_kind || '/' || outcome AS bucket, count(*) AS num, count(*) AS den FROM fetch_log GROUP BY 1""")
R.add("qc_coverage", lambda s, f: Q.odds_coverage_by_type(tables(s, f)), with_tables(RACES, RUNNERS, ODDS_SQL) + """
    SELECT bet_type AS bucket, count(DISTINCT race_id) AS num, (SELECT count(*) FROM races) AS den FROM odds GROUP BY 1""")
R.add("qc_coverage_by_year", lambda s, f: Q.odds_coverage_by_year(tables(s, f)).select(F.col("bucket").cast("long"), "num", "den"),
      with_tables(RACES, RUNNERS, ODDS_SQL) + """
    SELECT CAST(year(date) AS BIGINT) AS bucket, count(DISTINCT o.race_id) AS num, count(DISTINCT r.race_id) AS den
    FROM races r LEFT JOIN odds o USING (race_id) GROUP BY 1""")
R.add("qc_laps_coverage", lambda s, f: Q.events_without_laps_by_year(tables(s, f)).select(F.col("bucket").cast("long"), "num", "den"),
      with_tables(RACES, LAPS_SQL) + """
    SELECT CAST(year(date) AS BIGINT) AS bucket, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM laps l WHERE l.race_id = r.race_id)) AS num,
           count(*) AS den FROM races r GROUP BY 1""")
R.add("qc_duplicate_keys", lambda s, f: Q.duplicate_keys(star.runners(s, f), ["race_id", "number"]), MODEL + """
    SELECT race_id, number, count(*) AS n FROM runners GROUP BY 1, 2 HAVING count(*) > 1""")


@R.query("qc_missing_parents", MODEL + """
    SELECT race_id, horse_id, number FROM runners ru WHERE NOT EXISTS (SELECT 1 FROM races r WHERE r.race_id = ru.race_id AND r.grade = 'G1')""")
def _(spark, folder):
    t = tables(spark, folder)
    flagged = t["races"].where(F.col("grade") == "G1")
    return Q.missing_parents(t["runners"], flagged, ["race_id"]).select("race_id", "horse_id", "number")


@R.query("qc_rules", with_tables(RACES) + """
    SELECT race_id, 'surface' AS rule FROM races
    UNION ALL SELECT race_id, 'direction' FROM races WHERE direction IS NOT NULL
    UNION ALL SELECT race_id, 'race_class' FROM races
    UNION ALL SELECT race_id, 'weight_rule' FROM races
    UNION ALL SELECT race_id, 'n_starters >= 0' FROM races WHERE n_starters < 0
    UNION ALL SELECT race_id, 'distance > 0' FROM races WHERE distance <= 0""")
def _(spark, folder):
    return Q.broken_rules(star.races(spark, folder), ["race_id"], Q.event_rules())


@R.query("qc_entry_rules", """
    WITH e AS (SELECT l_orderkey AS race_id, l_partkey AS horse_id, l_linenumber AS n, l_returnflag AS flag, l_linestatus AS line FROM lineitem)
    SELECT race_id, horse_id, 'status' AS rule FROM e WHERE flag <> 'A'
    UNION ALL SELECT race_id, horse_id, 'number >= 1' FROM e WHERE n - 1 < 1
    UNION ALL SELECT race_id, horse_id, 'finish_pos >= 1' FROM e WHERE flag = 'A' AND n - 2 < 1
    UNION ALL SELECT race_id, horse_id, 'affiliation' FROM e WHERE line <> 'F'""")
def _(spark, folder):
    """Entries whose flags stand for statuses and places, so that every rule is broken somewhere; a missing place holds."""
    flag, line, n = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    rows = star.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_partkey").alias("horse_id"), F.when(flag == "A", "出走").otherwise(flag).alias("status"),
        (n - 1).alias("number"), F.when(flag == "A", n - 2).alias("finish_pos"), F.when(line == "F", "東").otherwise(line).alias("affiliation"))
    return Q.broken_rules(rows, ["race_id", "horse_id"], Q.entry_rules())


@R.query("qc_odds_rules", """
    WITH o AS (SELECT l_orderkey AS race_id, l_linenumber AS number, CASE WHEN l_tax > 0 THEN l_quantity - 5 END AS low, l_linenumber * 10 AS high FROM lineitem)
    SELECT race_id, number, 'odds_high >= odds_low' AS rule FROM o WHERE high < low
    UNION ALL SELECT race_id, number, 'odds_low > 0' FROM o WHERE low <= 0""")
def _(spark, folder):
    """Ranges of odds from quantities and line numbers; a missing end holds."""
    rows = star.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("number"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity") - 5).alias("odds_low"), (F.col("l_linenumber") * 10).alias("odds_high"))
    return Q.broken_rules(rows, ["race_id", "number"], Q.odds_rules())


@R.query("qc_run", MODEL + """
    SELECT CAST(1 AS BIGINT) AS run_id, DATE '1995-01-01' AS scope_from, CAST(NULL AS DATE) AS scope_to,
           (SELECT count(*) FROM races) AS n_races, (SELECT count(*) FROM runners) AS n_runners""")
def _(spark, folder):
    return Q.run_row(tables(spark, folder), 1, datetime(2001, 8, 1), scope_from=date(1995, 1, 1)).drop("started_at")


@R.query("qc_findings", None)
def _(spark, folder):
    return Q.findings(stored_tables(spark, folder), run_id=1)


@R.query("qc_fail_counts", TICKETS + f"""
    , counts AS (
      SELECT 'headcount_starters' AS check_id, 0 AS n UNION ALL SELECT 'headcount_entries', 0
      UNION ALL SELECT 'orphan_race', (SELECT count(*) FROM races WHERE n_entries = 0)
      UNION ALL SELECT 'finish_pos_rank', (SELECT count(*) FROM (SELECT finish_pos, rank() OVER (PARTITION BY race_id ORDER BY finish_pos) AS e
                                            FROM runners WHERE finish_pos IS NOT NULL) WHERE finish_pos <> e)
      UNION ALL SELECT 'status_columns', 0 UNION ALL SELECT 'status_domain', 0 UNION ALL SELECT 'payout_horses', 0
      UNION ALL SELECT 'odds_monotonic', (
        SELECT count(*) FROM (SELECT race_id, popularity, odds_win FROM runners WHERE odds_win IS NOT NULL) o
        JOIN (SELECT race_id, popularity, lag(max(odds_win)) OVER (PARTITION BY race_id ORDER BY popularity) AS prev
              FROM runners WHERE odds_win IS NOT NULL GROUP BY 1, 2) p USING (race_id, popularity) WHERE odds_win < prev)
      UNION ALL SELECT 'corners_uniform', (SELECT count(*) FROM runners JOIN races USING (race_id)
                                           WHERE corners IS NOT NULL AND len(corners) <> len(corner_nos)))
    SELECT check_id, CAST(n AS BIGINT) AS n FROM counts""")
def _(spark, folder):
    return Q.fail_counts(stored_tables(spark, folder))


@R.query("audit_two_cutoffs", "SELECT CAST(0 AS BIGINT) AS differing, count(*) AS compared FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate < DATE '1998-01-01'")
def _(spark, folder):
    """Features built from the data known at two dates agree on the rows both contain."""
    rows = matrix.entry_frame(star.event_tables(spark, folder))
    ids = ["race_id", "horse_id", "owner_id", "number"]
    build = lambda cutoff: X.add_course_aptitude(X.add_features(rows.where(F.col("date") < F.lit(cutoff)), [X.career_rates()])).select(
        *ids, "f802", "f809_win_rate", "f809_top3_rate")
    early, late = build(date(1998, 1, 1)), build(date(2000, 1, 1))
    rounded = lambda df: df.select(*ids, r6("f802"), r6("f809_win_rate"), r6("f809_top3_rate"))
    n = early.agg(F.count("*").alias("n")).scalar()
    return Q.differing_rows(rounded(early), rounded(late), ids).agg(F.count("*").alias("differing")).select("differing", n.alias("compared"))
