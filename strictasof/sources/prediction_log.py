"""Prediction log: schema, reading, gates for new records, and scoring of settled picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..plans.bootstrap import bootstrap_interval

PICK = T.StructType([
    T.StructField("bet_type", T.StringType()), T.StructField("horse_numbers", T.ArrayType(T.IntegerType())),
    T.StructField("stake", T.DoubleType()), T.StructField("note", T.StringType()),
])
RECORD = T.StructType([
    T.StructField("race_id", T.LongType()), T.StructField("race_date", T.StringType()),
    T.StructField("logged_at", T.StringType()), T.StructField("agent", T.StringType()),
    T.StructField("confidence", T.StringType()), T.StructField("reasoning", T.StringType()),
    T.StructField("model_probs", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("weight_confirmed", T.BooleanType()),
    T.StructField("picks", T.ArrayType(PICK)),
])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def list_log(log: DataFrame, agent: str | None = None) -> DataFrame:
    rows = log if agent is None else log.where(F.col("agent") == agent)
    return rows.select("race_id", "race_date", "agent", F.coalesce("confidence", F.lit("")).alias("confidence"),
                       F.size("picks").alias("n_picks"), "logged_at", "weight_confirmed")


def pick_problem(picks: Column) -> Column:
    """Why a list of picks cannot be logged; null when it can."""
    wrong_size = lambda p: F.size(p["horse_numbers"]) != F.when(p["bet_type"] == V.WIDE, 2).otherwise(1)
    return (
        F.when(picks.isNull() | (F.size(picks) == 0), "no picks")
        .when(F.exists(picks, lambda p: ~p["bet_type"].isin(*V.LEDGER_TYPES)), "bet type not logged")
        .when(F.exists(picks, wrong_size), "wrong number of entries")
        .when(F.exists(picks, lambda p: p["stake"] <= 0), "stake not positive")
    )


def accept_records(new: DataFrame, log: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``): valid picks, outcome still open, one record per (event, agent).

    Among new records of one (event, agent) the earliest is kept.
    """
    settled = entries.where(F.col("finish_pos").isNotNull()).select("race_id").distinct().withColumn("_settled", F.lit(True))
    logged = log.select("race_id", "agent").distinct().withColumn("_logged", F.lit(True))
    first = new.groupBy("race_id", "agent").agg(F.min("logged_at").alias("_first"))
    rows = new.join(settled, "race_id", "left").join(logged, ["race_id", "agent"], "left").join(first, ["race_id", "agent"])
    reason = F.coalesce(
        pick_problem(F.col("picks")), F.when(F.col("_settled"), "outcome already known"),
        F.when(F.col("_logged") | (F.col("logged_at") > F.col("_first")), "already logged"))
    rows = rows.withColumn("reason", reason).drop("_settled", "_logged", "_first")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def settled_picks(log: DataFrame, entries: DataFrame, payouts: DataFrame, agent: str | None = None) -> DataFrame:
    """One row per pick of an event with a known outcome, with its payout ratio (0 when it lost)."""
    rows = log if agent is None else log.where(F.col("agent") == agent)
    settled = entries.where(F.col("finish_pos").isNotNull()).select("race_id").distinct()
    picks = rows.join(settled, "race_id", "left_semi").select("race_id", "agent", F.explode("picks").alias("p"))
    number_set = lambda numbers: F.array_join(F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: n.cast("string")), "-")
    paid = payouts.where(F.col("bet_type").isin(*V.LEDGER_TYPES)).select(
        "race_id", "bet_type", number_set(F.col("combination")).alias("_set"), (F.col("payout") / 100.0).alias("_ratio"))
    picks = picks.select("race_id", "agent", F.col("p.bet_type").alias("bet_type"), F.col("p.horse_numbers").alias("horse_numbers"),
                         F.col("p.stake").alias("stake"), number_set(F.col("p.horse_numbers")).alias("_set"))
    scored = picks.join(paid, ["race_id", "bet_type", "_set"], "left")
    ratio = F.coalesce("_ratio", F.lit(0.0))
    return scored.select("race_id", "agent", "bet_type", "horse_numbers", "stake", ratio.alias("payout_ratio"),
                         (ratio * F.col("stake") - F.col("stake")).alias("profit"))


def score_summary(picks: DataFrame) -> DataFrame:
    """Bets, return and hit rate per ticket type and overall (``bet_type`` null)."""
    gross = F.col("payout_ratio") * F.col("stake")
    return picks.groupingSets([["bet_type"], []], "bet_type").agg(
        F.count("*").alias("n_bets"), (F.sum(gross) / F.sum("stake")).alias("roi"),
        F.avg(F.when(gross > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("hit_rate"))


def score_intervals(picks: DataFrame, n_boot: int = 10_000, seed: int = 42) -> DataFrame:
    """Return with its percentile interval over resampled picks, per ticket type and overall (``bet_type`` null).

    Without picks there are no rows.
    """
    kinds = F.explode(F.array(F.struct(F.col("bet_type").alias("_kind"), F.lit(False).alias("_all")),
                              F.struct(F.lit("").alias("_kind"), F.lit(True).alias("_all"))))
    units = picks.select("payout_ratio", "stake", kinds.alias("_k")).select("payout_ratio", "stake", "_k.*")
    found = bootstrap_interval(units, F.col("payout_ratio") * F.col("stake"), F.col("stake"), n_boot, seed, ["_kind", "_all"])
    return found.select(F.when(~F.col("_all"), F.col("_kind")).alias("bet_type"), F.col("n").alias("n_bets"),
                        F.col("ratio").alias("roi"), "ci_low", "ci_high")


def log_warnings(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Counts that qualify a score: logged and settled events, records made before weights were known."""
    settled = entries.where(F.col("finish_pos").isNotNull()).select("race_id").distinct().withColumn("_s", F.lit(True))
    return log.join(settled, "race_id", "left").agg(
        F.countDistinct("race_id").alias("n_races_logged"),
        F.countDistinct(F.when(F.col("_s"), F.col("race_id"))).alias("n_races_settled"),
        F.count_if(~F.col("weight_confirmed")).alias("n_weight_unconfirmed"))
