"""Ranks of values, inside groups or overall, computed without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, stage_table

_BEFORE = (Window.unboundedPreceding, -1)


def ranged(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Store ``df`` cut into sorted ranges of about equal size, each row with its range's number.

    Spark samples the rows to balance the ranges, so a group of any size is spread out whatever its values look
    like. The numbers are stored with the rows: later steps and reruns all see the same cut.
    """
    n = ranges or partitions(df.sparkSession)
    return stage_table(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def value_ranks(df: DataFrame, group: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """One row per (group, distinct value): ``n_equal`` rows hold it, ``n_below`` hold less, ``n_group`` hold any.

    Equal values are counted first. The distinct values are cut into sorted ranges; each range is ranked on its own
    and shifted by the rows of its group in the ranges before it.
    """
    group = list(group)
    cells = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_equal"))
    stored = ranged(cells, [*group, value], ranges)
    whole = Window.partitionBy(*group)
    sizes = stored.groupBy(*group, "_range").agg(F.sum("n_equal").alias("_rows"))
    offsets = sizes.select(
        *group, "_range", F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("n_group"))
    inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(*_BEFORE)
    local = stored.withColumn("_local", F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
    keys = [*group, "_range"]
    named = offsets.withColumnsRenamed({k: f"{k}_o" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_o"))
    return local.join(named, same).select(
        *[F.col(g) for g in group], value, "n_equal", (F.col("_offset") + F.col("_local")).alias("n_below"), "n_group")


def _same(a: Sequence, b: Sequence) -> bool:
    """Whether Spark groups two keys together: null with null, NaN with NaN."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _borders(stored: DataFrame, columns: Sequence[str]) -> list[tuple]:
    """(last key of a range, first key of the next) for the ranges of a :func:`ranged` table; a row per range is read."""
    key = F.struct(*columns)
    ends = sorted(stored.groupBy("_range").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect(), key=lambda r: r["_range"])
    return [(tuple(a["last"]), tuple(b["first"])) for a, b in zip(ends, ends[1:])]


def _among(df: DataFrame, rows: Sequence[tuple], columns: Sequence[str], extra: str = "") -> DataFrame:
    """``df`` joined with the few ``rows`` (values of ``columns``, then the ``extra`` ones); only those rows if none are extra."""
    fields = [f"`_at_{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields]
    table = F.broadcast(df.sparkSession.createDataFrame(list(rows), ", ".join(filter(None, (*fields, extra)))))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    return df.join(table, same, "left" if extra else "left_semi").drop(*[f"_at_{c}" for c in columns])


def _shifted(df: DataFrame, stored: DataFrame, group: Sequence[str], segments: Sequence[tuple], size: Column) -> tuple[DataFrame, list]:
    """``df`` with ``_offset``, the ``size`` of its group in earlier ranges; ``segments`` are the groups that have any.

    Also the (group, range, size) rows of those groups: there are at most two per range.
    """
    group = list(group)
    sizes = [tuple(r) for r in _among(stored, segments, group).groupBy(*group, "_range").agg(size.alias("_rows")).collect()]
    total: dict[tuple, int] = {}
    rows = []
    for *key, at, n in sorted(sizes, key=lambda r: r[-2]):
        key = next(s for s in segments if _same(s, key))
        rows.append((*key, at, total.get(key, 0)))
        total[key] = total.get(key, 0) + n
    shifted = _among(df, rows, [*group, "_range"], "_offset long")
    return shifted.withColumn("_offset", F.coalesce("_offset", F.lit(0).cast("long"))), sizes


def with_positions(stored: DataFrame, group: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """A :func:`ranged` table of (group, value, ...) with ``out``: the summed ``weight`` of its group's rows at or below
    the value. Rows of equal (group, value) lie in one range."""
    inside = Window.partitionBy(*group, "_range").orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    local = stored.withColumn(out, F.sum(weight).over(inside))
    segments = list(dict.fromkeys(last for last, first in _borders(stored, group) if _same(last, first)))
    if not segments:
        return local
    shifted, _ = _shifted(local, stored, group, segments, F.sum(weight))
    return shifted.withColumn(out, F.col(out) + F.col("_offset")).drop("_offset")


def average_positions(df: DataFrame, group: Sequence[str], value: str, row: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_rank``, the average 1-based rank of a row's value (not null) in its group; ``row`` tells rows apart.

    The rows themselves are cut into sorted ranges and ranked there, so nothing is joined back by value. ``row`` ends the
    order, so ties of any number are spread. Only a group that goes on in the next range needs more: the rows before it,
    and for the value at the border its rows on both sides. There are no more of either than there are ranges.
    """
    group = list(group)
    stored = ranged(df, [*group, value, row], ranges)
    borders = _borders(stored, [*group, value])
    segments = list(dict.fromkeys(last[:-1] for last, first in borders if _same(last[:-1], first[:-1])))
    inside = Window.partitionBy(*group, "_range").orderBy(value)
    local = stored.withColumn("_rank", (F.rank().over(inside) + F.count("*").over(inside)) / 2)
    if not segments:
        return local.drop("_range")
    local, sizes = _shifted(local, stored, group, segments, F.count("*"))
    values = list({str(last): last for last, first in borders if _same(last, first)}.values())
    equal = [tuple(r) for r in _among(stored, values, [*group, value]).groupBy(*group, value, "_range").count().collect()] if values else []
    ties = []
    for v in values:
        mine = sorted(r[-2:] for r in equal if _same(r[:-2], v))
        at, n = mine[0]  # all rows of the group in this range are at or below the value
        upto = sum(r[-1] for r in sizes if _same(r[:-2], v[:-1]) and r[-2] <= at)
        ties.append((*v, upto - n + (sum(m for _, m in mine) + 1) / 2))
    local = local.withColumn("_rank", F.col("_rank") + F.col("_offset"))
    if ties:
        local = _among(local, ties, [*group, value], "_tied double").withColumn("_rank", F.coalesce("_tied", "_rank")).drop("_tied")
    return local.drop("_range", "_offset")


def sorted_positions(values: DataFrame, value: str, out: str = "code", ranges: int | None = None) -> DataFrame:
    """0-based position of each distinct value in sorted order."""
    stored = ranged(values.select(value).distinct(), [value], ranges)
    sizes = stored.groupBy("_range").agg(F.count("*").alias("_rows"))  # one row per range
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(value)) - 1
    return stored.withColumn("_rank", rank).join(offsets, "_range").select(value, (F.col("_offset") + F.col("_rank")).cast("long").alias(out))
