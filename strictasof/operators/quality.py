"""Data-quality checks: violating rows of each rule, yearly rates, constraint checks and a findings ledger."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import top_per_group
from .prior import latest, running_count, with_prior
from ..functions import scalars as S
from ..functions import vocabulary as V
from ..session import stage_table

Tables = Mapping[str, DataFrame]


def _no_entity() -> Column:
    return F.lit(None).cast("long")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _violations(rows: DataFrame, detail: Column, entity: Column | None = None) -> DataFrame:
    entity = F.col("horse_id") if entity is None else entity
    return rows.select("race_id", entity.alias("horse_id"), detail.alias("detail"))


def _dated(tables: Tables) -> DataFrame:
    """Entries with their event's date and corners: the stored table ``dated``, if there is one, else joined here."""
    if "dated" in tables:
        return tables["dated"]
    return tables["runners"].join(tables["races"].select("race_id", "date", "corner_nos"), "race_id")


def with_dated(tables: Tables) -> Tables:
    """The tables with ``dated`` joined and stored once, for reports that run all checks."""
    return {**tables, "dated": stage_table(_dated(tables).select("race_id", "horse_id", "status", "corners", "date", "corner_nos"))}


def _headcount(tables: Tables, stored: str, counted: Column) -> DataFrame:
    sizes = tables["runners"].groupBy("race_id").agg(counted.alias("actual"))
    rows = tables["races"].join(sizes, "race_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return _violations(rows.where(F.col(stored) != F.col("actual")),
                       _text(f"{stored}=", F.col(stored), " actual=", F.col("actual")), _no_entity())


def starters_differ(tables: Tables) -> DataFrame:
    return _headcount(tables, "n_starters", F.count_if(S.ran(F.col("status"))))


def entries_differ(tables: Tables) -> DataFrame:
    return _headcount(tables, "n_entries", F.count("*"))


def events_without_entries(tables: Tables) -> DataFrame:
    rows = tables["races"].join(tables["runners"], "race_id", "left_anti")
    return _violations(rows, F.lit("runners が0行"), _no_entity())


def rank_differs(tables: Tables) -> DataFrame:
    """Stored finish position against the competition rank: one more than the entries placed strictly before."""
    placed = tables["runners"].where(F.col("finish_pos").isNotNull())
    rows = with_prior(placed, ["race_id"], "finish_pos", {"_ahead": running_count()})
    expected = F.col("_ahead") + 1
    return _violations(rows.where(F.col("finish_pos") != expected),
                       _text("finish_pos=", F.col("finish_pos"), " expected=", expected))


def status_incoherent(tables: Tables) -> DataFrame:
    status, pos = F.col("status"), F.col("finish_pos")
    lacking = S.finished(status) & (pos.isNull() | F.col("time_sec").isNull())
    extra = status.isin(*V.STOPPED, *V.VOID) & pos.isNotNull()
    return _violations(tables["runners"].where(lacking | extra), _text("status=", status))


def status_unknown(tables: Tables) -> DataFrame:
    return _violations(tables["runners"].where(~F.col("status").isin(*V.ALL_STATUSES)), _text("status=", F.col("status")))


def payout_numbers_unknown(tables: Tables) -> DataFrame:
    """Numbers named by a payout that no running entry of the event carries (frame tickets aside)."""
    named = tables["payouts"].where(~F.col("bet_type").isin(*V.FRAME_TYPES)).select(
        "race_id", "bet_type", "comb_key", F.explode("combination").alias("number"))
    known = tables["runners"].where(S.ran(F.col("status"))).select("race_id", "number")
    return _violations(named.join(known, ["race_id", "number"], "left_anti"),
                       _text(F.col("bet_type"), " ", F.col("comb_key"), " 馬番", F.col("number")), _no_entity())


def odds_not_monotonic(tables: Tables) -> DataFrame:
    """Odds must not fall as popularity goes down: each entry against the odds of the popularity just before it."""
    listed = tables["runners"].where(F.col("popularity").isNotNull() & F.col("odds_win").isNotNull())
    previous = with_prior(listed, ["race_id"], "popularity", {"_p": latest(F.col("odds_win"))}, source=listed)
    rows = previous.where(F.col("odds_win") < F.col("_p._tie"))
    return _violations(rows, _text("odds_win=", F.col("odds_win"), " prev=", F.col("_p._tie")))


def corners_uneven(tables: Tables) -> DataFrame:
    rows = _dated(tables)
    mine, event = F.size("corners"), F.size("corner_nos")
    both = F.col("corners").isNotNull() & F.col("corner_nos").isNotNull() & S.finished(F.col("status"))
    return _violations(rows.where(both & (mine != event)),
                       _text("len(corners)=", mine, " len(corner_nos)=", event))


FAIL_CHECKS: dict[str, Callable[[Tables], DataFrame]] = {
    "headcount_starters": starters_differ,
    "headcount_entries": entries_differ,
    "orphan_race": events_without_entries,
    "finish_pos_rank": rank_differs,
    "status_columns": status_incoherent,
    "status_domain": status_unknown,
    "payout_horses": payout_numbers_unknown,
    "odds_monotonic": odds_not_monotonic,
    "corners_uniform": corners_uneven,
}


# --- rates: (bucket, num, den) --------------------------------------------------------------------------

def _key_year() -> Column:
    return F.substring("source_key", 1, 4).try_cast("int")


def _rate(rows: DataFrame, bucket: Column, numerator: Column) -> DataFrame:
    return rows.groupBy(bucket.alias("bucket")).agg(F.count_if(numerator).alias("num"), F.count("*").alias("den"))


def corners_missing_by_year(tables: Tables) -> DataFrame:
    rows = _dated(tables).where(S.finished(F.col("status")) & (F.size("corner_nos") > 0))
    return _rate(rows, F.year("date"), F.col("corners").isNull())


def rejects_by_year(tables: Tables) -> DataFrame:
    rejected = tables["rejected_rows"].groupBy(_key_year().alias("bucket")).agg(F.count("*").alias("rej"))
    kept = _dated(tables).groupBy(F.year("date").alias("bucket")).agg(F.count("*").alias("run"))
    both = rejected.join(kept, "bucket", "full")
    num = F.coalesce("rej", F.lit(0))
    return both.select("bucket", num.alias("num"), (num + F.coalesce("run", F.lit(0))).alias("den"))


def rejects_by_reason(tables: Tables) -> DataFrame:
    marker = F.when(F.col("reason") == "unknown_finish_marker", F.concat(F.lit(" ("), "raw", F.lit(")"))).otherwise("")
    return _rate(tables["rejected_rows"], F.concat("reason", marker), F.lit(True))


def incomplete_fetches_by_year(tables: Tables) -> DataFrame:
    idle = (F.col("page_kind") == "day_index") & (F.col("outcome") == "empty")
    return _rate(tables["fetch_log"], _key_year(), (F.col("outcome") != "ok") & ~idle)


def incomplete_fetches_by_kind(tables: Tables) -> DataFrame:
    return _rate(tables["fetch_log"], F.concat_ws("/", "page_kind", "outcome"), F.lit(True))


def odds_coverage_by_year(tables: Tables) -> DataFrame:
    covered = tables["odds"].select("race_id").distinct().withColumn("_covered", F.lit(True))
    return _rate(tables["races"].join(covered, "race_id", "left"), F.year("date"), F.col("_covered"))


def odds_coverage_by_type(tables: Tables) -> DataFrame:
    """Events with odds per ticket type over all events (one scalar, counted in the same plan)."""
    per_type = tables["odds"].select("bet_type", "race_id").distinct().groupBy("bet_type").agg(F.count("*").alias("num"))
    total = tables["races"].agg(F.count("*").alias("n")).scalar()
    return per_type.select(F.col("bet_type").alias("bucket"), "num", total.alias("den"))


def events_without_laps_by_year(tables: Tables) -> DataFrame:
    present = tables["laps"].select("race_id").distinct().withColumn("_present", F.lit(True))
    return _rate(tables["races"].join(present, "race_id", "left"), F.year("date"), F.col("_present").isNull())


WARN_CHECKS: dict[str, dict[str, Callable[[Tables], DataFrame]]] = {
    "corners_missing": {"by_year": corners_missing_by_year},
    "rejected_rate": {"by_year": rejects_by_year, "by_group": rejects_by_reason},
    "fetch_incomplete": {"by_year": incomplete_fetches_by_year, "by_group": incomplete_fetches_by_kind},
    "odds_coverage": {"by_year": odds_coverage_by_year, "by_group": odds_coverage_by_type},
    "laps_coverage": {"by_year": events_without_laps_by_year},
}


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def fail_rows(tables: Tables, checks: Mapping[str, Callable] = FAIL_CHECKS) -> DataFrame:
    return _union([check(tables).withColumn("check_id", F.lit(name)) for name, check in checks.items()])


def warn_rows(tables: Tables, checks: Mapping[str, Mapping[str, Callable]] = WARN_CHECKS) -> DataFrame:
    return _union([
        check(tables).select(F.lit(name).alias("check_id"), F.lit(cut).alias("cut"), F.col("bucket").cast("string"), "num", "den")
        for name, cuts in checks.items() for cut, check in cuts.items()])


def findings(tables: Tables, run_id: int, per_check: int | None = None) -> DataFrame:
    """Ledger rows of one run: every violation of the fail checks and every yearly rate.

    ``per_check`` is for reports that show only the first violations of each check.
    """
    failed = fail_rows(tables)
    if per_check is not None:
        failed = top_per_group(failed, ["check_id"], [F.col("race_id"), F.col("horse_id"), F.col("detail")], per_check)
    failed = failed.select(
        "check_id", F.lit("fail").alias("severity"), "race_id", "horse_id", "detail")
    yearly = stage_table(warn_rows(tables).where("cut = 'by_year'"))  # a row per check and year, read for the totals too
    totals = yearly.groupBy("check_id").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    detail = F.concat_ws("/", F.col("num").cast("string"), F.col("den").cast("string"))
    name = F.concat("check_id", F.lit(":year="), F.coalesce("bucket", F.lit("None")))
    none = F.lit(None).cast("long")
    warned = totals.select("check_id", detail.alias("detail")).unionByName(
        yearly.select(name.alias("check_id"), detail.alias("detail")))
    warned = warned.select("check_id", F.lit("warn").alias("severity"), none.alias("race_id"), none.alias("horse_id"), "detail")
    return failed.unionByName(warned).withColumn("run_id", F.lit(run_id).cast("long"))


def run_row(tables: Tables, run_id: int, started_at: datetime, scope_from: date | None = None, scope_to: date | None = None) -> DataFrame:
    """The run's own ledger row: when it began, the dates it was asked for and how much it looked at."""
    entries = tables["runners"].agg(F.count("*").alias("n")).scalar()
    return tables["races"].agg(F.count("*").alias("n_races")).select(
        F.lit(run_id).cast("long").alias("run_id"), F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(scope_from).cast("date").alias("scope_from"), F.lit(scope_to).cast("date").alias("scope_to"), "n_races", entries.alias("n_runners"))


def fail_counts(tables: Tables) -> DataFrame:
    """Violations per check, zeros included."""
    names = tables["races"].sparkSession.createDataFrame([(n,) for n in FAIL_CHECKS], "check_id string")
    counts = fail_rows(tables).groupBy("check_id").agg(F.count("*").alias("n"))
    return names.join(counts, "check_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def exit_code(tables: Tables) -> int:
    return 0 if fail_rows(tables).isEmpty() else 1


def next_run_id(runs: DataFrame) -> int:
    return (runs.agg(F.max("run_id").alias("n")).first()["n"] or 0) + 1


# --- constraints as checks ------------------------------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def missing_parents(df: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(S.all_of(F.col(k).isNotNull() for k in keys)).join(parent.select(*keys), list(keys), "left_anti")


def broken_rules(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule (a rule that evaluates to null holds, as a CHECK does), one row per broken rule."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def event_rules() -> dict[str, Column]:
    known = lambda c, words: F.col(c).isNull() | F.col(c).isin(*words)
    return {
        "n_entries >= n_starters": F.col("n_entries") >= F.col("n_starters"),
        "n_starters >= 0": F.col("n_starters") >= 0,
        "race_number >= 1": F.col("race_number") >= 1,
        "distance > 0": F.col("distance") > 0,
        "surface": F.col("surface").isin(*V.SURFACES),
        "direction": known("direction", V.DIRECTIONS),
        "track_condition": known("track_condition", V.TRACK_CONDITION_CODES),
        "race_class": known("race_class", V.RACE_CLASSES + V.LADDER_CLASSES),
        "weight_rule": known("weight_rule", V.WEIGHT_RULES),
        "meeting_no >= 1": F.col("meeting_no") >= 1,
        "meeting_day >= 1": F.col("meeting_day") >= 1,
    }


def entry_rules() -> dict[str, Column]:
    return {
        "status": F.col("status").isin(*V.ALL_STATUSES),
        "number >= 1": F.col("number") >= 1,
        "finish_pos >= 1": F.col("finish_pos") >= 1,
        "affiliation": F.col("affiliation").isin(*V.AFFILIATIONS),
    }


def odds_rules() -> dict[str, Column]:
    return {"odds_high >= odds_low": F.col("odds_high") >= F.col("odds_low"), "odds_low > 0": F.col("odds_low") > 0}


# --- audits ---------------------------------------------------------------------------------------------

def differing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the common keys on which two builds disagree (in either direction)."""
    common = a.select(*keys).intersect(b.select(*keys))
    left, right = a.join(common, list(keys), "left_semi"), b.join(common, list(keys), "left_semi")
    columns = a.columns
    return left.select(*columns).exceptAll(right.select(*columns)).unionByName(
        right.select(*columns).exceptAll(left.select(*columns)))


def forbidden_columns(df: DataFrame, forbidden: Sequence[str]) -> list[str]:
    return sorted(set(df.columns) & set(forbidden))
