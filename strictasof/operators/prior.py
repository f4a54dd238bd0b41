"""Strictly-before statistics: what was known about a key before a row's own date.

All operators share one shape, which stays balanced when a single key holds a large share of the rows:

1. aggregate the facts to one row per (key, date) - Spark combines this on the map side,
2. run the window over those rows only - at most one per date, however many facts the key has,
3. join the result back to the rows on (key, date), where adaptive execution can split a hot key.

``order`` is a date, month or sequence number: a column with few distinct values per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import prior_quantile
from ..functions.scalars import all_of

_BEFORE = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Running:
    """One aggregate over the earlier facts of a key."""

    kind: str  # sum | count | min | max | latest
    value: Column

    def per_day(self, value: Column) -> Column:
        combine = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "latest": F.max}
        return combine[self.kind](value)

    def earlier(self, name: str, window) -> Column:
        if self.kind == "latest":
            return F.last(name, ignorenulls=True).over(window)
        combine = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        return combine[self.kind](name).over(window)


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def running_count(condition: Column | None = None) -> Running:
    """Number of earlier facts for which ``condition`` holds (all facts when not given)."""
    return Running("count", F.lit(1) if condition is None else F.when(condition, F.lit(1)))


def running_min(value: Column) -> Running:
    return Running("min", value)


def running_max(value: Column) -> Running:
    return Running("max", value)


def latest(tie: Column, *columns: str | Column, where: Column | None = None) -> Running:
    """The columns of the most recent earlier fact; ``tie`` decides between facts of one date."""
    row = F.struct(tie.alias("_tie"), *columns)
    return Running("latest", row if where is None else F.when(where, row))


def with_prior(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggregates: Mapping[str, Running],
    facts: DataFrame | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add, to every row of ``df``, aggregates over the facts of its key with a strictly smaller ``order``.

    The facts are ``df`` itself, or ``source``, a frame that also holds every (key, order) of ``df``: features
    added one after the other all read the same source, so the plan grows by one branch per feature. ``facts``
    is for facts that may lack dates of ``df``. Without keys there is one series over all facts. A row whose
    key is null gets nulls; counts are 0 where nothing came before.
    """
    keys = list(keys)
    known = all_of(F.col(c).isNotNull() for c in [*keys, order])
    if facts is not None:
        source = facts
    elif source is None:
        source = df
    rows = source.where(known).select(*keys, order, *[a.value.alias(n) for n, a in aggregates.items()])
    if facts is not None:
        # dates on which a key has targets but no facts need a row of their own
        rows = rows.unionByName(df.where(known).select(*keys, order), allowMissingColumns=True)
    days = rows.groupBy(*keys, order).agg(*[a.per_day(F.col(n)).alias(n) for n, a in aggregates.items()])
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(*_BEFORE)
    days = days.select(*keys, order, *[a.earlier(n, window).alias(n) for n, a in aggregates.items()])
    # without keys a row per date is left, so the rows need not move
    joined = df.join(days if keys else F.broadcast(days), [*keys, order], "left")
    counts = {n: F.coalesce(F.col(n), F.lit(0)) for n, a in aggregates.items() if a.kind == "count"}
    return joined.withColumns(counts) if counts else joined


def prior_mean(total: str, n: str, fallback: float | None = None) -> Column:
    mean = F.when(F.col(n) > 0, F.col(total) / F.col(n))
    return mean if fallback is None else F.coalesce(mean, F.lit(fallback))


def asof_attach(
    df: DataFrame, versions: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
) -> DataFrame:
    """Attach the newest version dated strictly before the row, with a 0/1 indicator of its absence.

    ``versions`` holds ``keys``, ``as_of`` and ``value``, unique per (keys, as_of).
    """
    facts = versions.withColumnRenamed("as_of", order).withColumn("_version", F.col(value))
    found = with_prior(df, keys, order, {"_found": latest(F.col(order), F.col("_version"))}, facts=facts)
    return found.withColumns({
        out: F.col("_found._version"),
        f"{out}_unavailable": F.when(F.col("_found._version").isNull(), F.lit(1)).otherwise(F.lit(0)),
    }).drop("_found")


def with_recent(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: Sequence[str],
    value: Column,
    n: int,
    out: str,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add an array of the last ``n`` earlier values of the key, newest first (null values are no facts).

    Only the newest ``n`` facts of a (key, date) can matter, so the rest is dropped before any list is
    built; the lists and the window frame then hold at most ``n`` dates of ``n`` values.
    """
    keys = list(keys)
    source = (df if source is None else source).withColumn("_value", value)
    source = source.where(all_of(F.col(c).isNotNull() for c in [*keys, order, "_value"]))
    by_tie = Window.partitionBy(*keys, order).orderBy(*[F.col(c).desc() for c in tie], F.col("_value").desc())
    newest = (
        source.select(*keys, order, "_value", F.row_number().over(by_tie).alias("_rn"))
        .where(F.col("_rn") <= n)
        .groupBy(*keys, order)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_value"))), lambda s: s["_value"])
             .alias("_day"))
    )
    last_days = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    upto = F.slice(F.flatten(F.reverse(F.collect_list("_day").over(last_days))), 1, n)
    lists = newest.select(*keys, order, upto.alias("_upto"))
    found = with_prior(df, keys, order, {"_lists": latest(F.col(order), F.col("_upto"))}, facts=lists)
    return found.withColumn(out, F.col("_lists._upto")).drop("_lists")


def mean_of_array(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.when(F.size(values) > 0, total / F.size(values))


def with_prior_quantile(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    q: float,
    out: str,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the interpolated ``q`` quantile of the key's strictly earlier values (see :mod:`.order_statistics`)."""
    keys = list(keys)
    known = all_of(F.col(c).isNotNull() for c in [*keys, order])
    source = df if source is None else source
    probes = source.where(known).select(*keys, order).distinct()
    facts = source.where(known).select(*keys, order, value.alias("_value")).where(F.col("_value").isNotNull())
    found = prior_quantile(probes, facts, keys, order, q)
    return df.join(found.withColumnRenamed("_quantile", out), [*keys, order], "left")
