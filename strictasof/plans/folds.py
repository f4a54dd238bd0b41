"""Training tables: folds, cross-fit blocks, labels, weights, category codes, pace target and event inputs."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.grouped import group_quantiles, top_per_group
from ..operators.ranks import sorted_positions

DEFAULT_SEED = 20260819



def make_folds(races: DataFrame, today: date, train_years: int | None = None, min_train_years: int = 3,
               sealed_years: int = 3, seed: int = DEFAULT_SEED) -> DataFrame:
    """One row per walk-forward fold: a calendar year is validated with everything (or N years) before it.

    The years between the first and the last open event become the rows; each has a seed of its own.
    """
    if min_train_years < 3:
        raise ValueError(f"min_train_years must be at least 3, not {min_train_years}")
    span = races.where(~S.sealed(F.col("date"), F.col("grade"), today, sealed_years)).agg(
        F.min("date").alias("first"), F.max("date").alias("last"))
    begin, stop = F.year("first") + min_train_years, F.year("last")
    years = span.where(begin <= stop).select("first", F.posexplode(F.sequence(begin, stop)).alias("fold_index", "y"))
    start = F.make_date("y", F.lit(1), F.lit(1))
    return years.select(
        F.col("fold_index").cast("long"), (F.col("first") if train_years is None else F.add_months(start, -12 * train_years)).alias("train_start"),
        F.date_sub(start, 1).alias("train_end"), start.alias("valid_start"), F.make_date("y", F.lit(12), F.lit(31)).alias("valid_end"),
        F.make_date(F.col("y") - 1, F.lit(1), F.lit(1)).alias("inner_valid_start"),
        F.pmod(F.xxhash64(F.lit(seed), "y"), F.lit(2 ** 32)).alias("seed"))


def fold_rows(folds: DataFrame):
    """The folds on the driver (one per year)."""
    return folds.orderBy("fold_index").collect()


def assign_folds(races: DataFrame, folds: DataFrame, today: date, sealed_years: int = 3) -> DataFrame:
    """(fold_index, race_id, role) for every open event a fold trains on or validates.

    The folds are a handful of date ranges, so each event tests them as expressions; nothing is joined.
    """
    d = F.col("date")
    roles = []
    for f in fold_rows(folds):
        role = (F.when(d.between(F.lit(f["valid_start"]), F.lit(f["valid_end"])), "valid")
                .when(d.between(F.lit(f["inner_valid_start"]), F.lit(f["train_end"])), "inner_valid")
                .when(d.between(F.lit(f["train_start"]), F.lit(f["train_end"])), "train"))
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(f["fold_index"]).cast("long").alias("fold_index"), role.alias("role"))))
    open_events = races.where(~S.sealed(d, F.col("grade"), today, sealed_years))
    if not roles:
        return open_events.select(F.lit(None).cast("long").alias("fold_index"), "race_id", F.lit("").alias("role")).limit(0)
    return open_events.select("race_id", F.explode(F.array_compact(F.array(*roles))).alias("_f")).select("_f.fold_index", "race_id", "_f.role")


def cross_fit_block(day: Column, start: date, end: date, n_blocks: int = 4) -> Column:
    """Number of the contiguous day block a date falls in; longer blocks come first. Null outside the range."""
    days = (end - start).days + 1
    if days < n_blocks:
        raise ValueError(f"{days} training days cannot fill {n_blocks} blocks")
    short, longer = divmod(days, n_blocks)
    offset = F.datediff(day, F.lit(start))
    head = longer * (short + 1)
    block = F.when(offset < head, F.floor(offset / (short + 1))).otherwise(longer + F.floor((offset - head) / short))
    return F.when(offset.between(0, days - 1), block.cast("long"))


def block_starts(start: date, end: date, n_blocks: int = 4) -> list[date]:
    short, longer = divmod((end - start).days + 1, n_blocks)
    return [start + timedelta(days=b * short + min(b, longer)) for b in range(n_blocks)]


def graded_labels(entries: DataFrame) -> DataFrame:
    """3/2/1 for the first three, 0 for other runners; void entries have no row."""
    pos = F.col("finish_pos")
    label = F.when(pos == 1, 3).when(pos == 2, 2).when(pos == 3, 1).otherwise(0)
    return entries.where(S.ran(F.col("status"))).withColumn("label", label)


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("race_id").agg(F.count("*").alias("size"))


def sample_weights(races: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    weight = F.coalesce(S.lookup(F.col("grade"), {k: float(v) for k, v in weights.items()}), F.lit(1.0))
    return races.select("race_id", weight.alias("sample_weight"))


# --- categories -----------------------------------------------------------------------------------------

def category_codes(train: DataFrame, column: str, min_count: int = 20) -> DataFrame:
    """Dictionary (value, code) of the values seen at least ``min_count`` times, numbered in value order."""
    kept = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")).where(F.col("n") >= min_count)
    return sorted_positions(kept, "value")


def apply_categories(df: DataFrame, column: str, codes: DataFrame, other: int | None = None) -> DataFrame:
    """Replace values by their codes: null stays null, a value outside the dictionary becomes ``other``.

    ``other`` defaults to the size of the dictionary; -1 gives the encoding of the first-stage inputs.
    """
    fallback = codes.agg(F.count("*").alias("n")).scalar() if other is None else F.lit(other).cast("long")
    renamed = codes.select(F.col("value").alias(column), F.col("code").alias("_code"))
    rows = df.join(renamed, column, "left")
    if other is None:
        code = F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.coalesce("_code", fallback))
    else:
        code = F.coalesce("_code", fallback)
    return rows.withColumn(column, code).drop("_code").select(*df.columns)


# --- first stage ----------------------------------------------------------------------------------------

def pace_target(laps: DataFrame, races: DataFrame) -> DataFrame:
    """Mean of the last three laps minus the mean per 200 m before; events with fewer than four laps have none."""
    lap = F.col("lap_sec").cast("double")
    whole = laps.groupBy("race_id").agg(F.count("*").alias("n_laps"), F.sum(lap).alias("_all")).where("n_laps >= 4")
    late = top_per_group(laps, ["race_id"], [F.col("furlong_no").desc()], 3).groupBy("race_id").agg(F.sum(lap).alias("_late"))
    rows = whole.join(late, "race_id").join(races.select("race_id", "distance"), "race_id")
    early = F.try_divide(F.col("_all") - F.col("_late"), (F.col("distance") - 600.0) / 200.0)
    return rows.select("race_id", (F.col("_late") / 3.0 - early).alias("f102_actual"), "n_laps")


def event_inputs(races: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per event: summary of the runners' ``f101`` and the event's own columns."""
    runners = entries.where(S.ran(F.col("status")))
    summary = runners.groupBy("race_id").agg(
        F.min("f101").alias("f101_min"), F.avg("f101").alias("f101_mean"),
        F.count_if(F.col("f101").isNull()).alias("f101_n_missing"))
    low = group_quantiles(runners, ["race_id"], "f101", {"f101_q25": 0.25})
    own = races.select("race_id", "n_starters", "distance", "surface", "direction", "course", "race_class", "weather",
                       S.track_condition_code(F.col("track_condition")).alias("track_condition"))
    return own.join(summary, "race_id", "left").join(low, "race_id", "left")
