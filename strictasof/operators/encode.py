"""Shrunken point-in-time means: how a key did so far under a condition, pulled toward the condition's mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prior import prior_mean, running_count, running_max, running_sum, with_prior
from ..functions.scalars import all_of, shrink

K = 5.0
NEUTRAL_SHARE = 0.5  # middle of finish_pos / n_starters


def with_condition_mean(df: DataFrame, condition: Sequence[str], value: Column, where: Column, out: str,
                        order: str = "date", fallback: float | None = NEUTRAL_SHARE,
                        source: DataFrame | None = None) -> DataFrame:
    """Mean of ``value`` over strictly earlier rows of the same condition (all rows when it is empty)."""
    seen = F.when(where, value)
    rows = with_prior(df, condition, order, {"_s": running_sum(seen), "_n": running_count(seen.isNotNull())},
                      source=source)
    return rows.withColumn(out, prior_mean("_s", "_n", fallback)).drop("_s", "_n")


def target_encode(df: DataFrame, entity: Sequence[str], condition: Sequence[str], value: Column, where: Column,
                  out: str, order: str = "date", k: float = K, fallback: float = NEUTRAL_SHARE,
                  mean: str | None = None, with_count: bool = False, indicator: bool = True,
                  source: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the entity's strictly earlier mean under the condition, shrunk to the condition's own mean.

    ``where`` selects the facts. A null entity gives null, with ``<out>_unavailable`` = 1. ``mean`` names a
    column that already holds the condition's mean, so several entities can share one pass.
    """
    source = df if source is None else source
    seen = F.when(where, value)
    rows, prior = df, mean or "_mu"
    if mean is None:
        rows = with_condition_mean(rows, condition, value, where, prior, order, fallback, source)
    rows = with_prior(rows, [*entity, *condition], order,
                      {"_s": running_sum(seen), "_n": running_count(seen.isNotNull())}, source=source)
    known = all_of(F.col(e).isNotNull() for e in entity)
    new = {out: F.when(known, shrink(F.col("_n"), F.col("_s") / F.col("_n"), k, F.col(prior)))}
    if indicator:
        new[f"{out}_unavailable"] = F.when(known, F.lit(0)).otherwise(F.lit(1))
    if with_count:
        new[f"{out}_n"] = F.when(known, F.col("_n")).otherwise(F.lit(0)).cast("double")
    return rows.withColumns(new).drop("_s", "_n", *([] if mean else [prior]))


def residual_rating(df: DataFrame, entity: str, stratum: str, value: Column, where: Column, out: str,
                    order: str = "date", k: float = K, source: DataFrame | None = None) -> DataFrame:
    """Mean excess of ``value`` over what its stratum did before, per entity, shrunk to the overall excess.

    Two chained strictly-before passes: the stratum's expectation for every fact, then the entity's mean
    residual. Facts whose stratum has no history have no residual and count nowhere.
    """
    source = (df if source is None else source).select(
        entity, stratum, order, F.when(where, value).alias("_value"))
    seen = F.col("_value").isNotNull()
    facts = with_condition_mean(source, [stratum], F.col("_value"), seen, "_expected", order, fallback=None)
    facts = facts.select(entity, order, (F.col("_value") - F.col("_expected")).alias("_residual"))
    residual, seen = F.col("_residual"), F.col("_residual").isNotNull()
    rows = with_condition_mean(df, [], residual, seen, "_mu", order, fallback=0.0, source=facts)
    return target_encode(rows, [entity], [], residual, seen, out, order, k, mean="_mu", source=facts).drop("_mu")


def main_partner(df: DataFrame, owner: str, partner: str, order: str = "date", out: str = "main_partner",
                 source: DataFrame | None = None) -> DataFrame:
    """The partner an owner used most often before the row's date; the lowest id wins a tie.

    A pair's count only grows, so the largest running count among the owner's earlier pair-days is the count
    of the current favourite: a running maximum finds it without listing candidate partners per date.
    """
    used = (df if source is None else source).where(F.col(owner).isNotNull() & F.col(partner).isNotNull())
    pair_days = used.groupBy(owner, partner, order).agg(F.count("*").alias("_used"))
    upto = Window.partitionBy(owner, partner).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    best = pair_days.select(owner, order, F.struct(
        F.sum("_used").over(upto).alias("n"), (-F.col(partner)).alias("id")).alias("_b"))
    rows = with_prior(df, [owner], order, {"_best": running_max(F.col("_b"))}, facts=best)
    return rows.withColumn(out, -F.col("_best.id")).drop("_best")
