"""Operators inside a group: shares, z-scores, ranks, quantiles and top-k.

Sums and extremes of a group are aggregated first and joined back, so a group may be of any size. Quantiles are read off
balanced sorted ranges (:mod:`.ranks`), whatever the size of the group; ranks too, where the group is a large one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import average_positions, value_ranks
from ..session import stage_table

#: spread, in parts of the mean, below which equal values differ only by rounding
VARIES = 1e-12
#: members up to which a group is seen by one task at once
SMALL_GROUP = 4096


def with_group_stats(df: DataFrame, group: Sequence[str], aggregates: Mapping[str, Column],
                     where: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add whole-group aggregates to every row (taken from ``source``, by default the rows themselves)."""
    group = list(group)
    source = df if source is None else source
    source = source if where is None else source.where(where)
    return df.join(source.groupBy(*group).agg(*[c.alias(n) for n, c in aggregates.items()]), group, "left")


def leave_one_out(df: DataFrame, group: Sequence[str], own: Sequence[str], value: Column,
                  total: str, n: str, source: DataFrame | None = None) -> DataFrame:
    """Sum and count of ``value`` over the group's members other than the row's own: whole minus own."""
    group, own = list(group), list(own)
    rows = (df if source is None else source).withColumn("_v", value)
    mine = rows.groupBy(*group, *own).agg(F.sum("_v").alias("_sum"), F.count("_v").alias("_n"))
    whole = mine.groupBy(*group).agg(F.sum("_sum").alias("_all_sum"), F.sum("_n").alias("_all_n"))
    others = mine.join(whole, group).select(
        *group, *own,
        (F.coalesce("_all_sum", F.lit(0)) - F.coalesce("_sum", F.lit(0))).alias(total),
        (F.col("_all_n") - F.col("_n")).alias(n))
    return df.join(others, [*group, *own], "left")


def average_ranks(df: DataFrame, group: Sequence[str], values: Sequence[str], suffix: str = "_avg_rank", raw: bool = False) -> DataFrame:
    """Add the average rank (ties share it, null has none) of each numeric column inside its group.

    All columns are ranked in one pass over (group, column, value, row); the ranks of a row come back together. The frame
    is stored for that, so select what is needed first. ``raw`` says that the values are read, not computed: then they are
    the same whenever they are read, so ranks come back by value and only the values are stored.
    """
    group, values = list(group), list(values)
    cell = lambda i, v: F.struct(F.lit(i).alias("_column"), F.col(v).cast("double").alias("_value"))
    melted = F.inline(F.array(*[cell(i, v) for i, v in enumerate(values)]))
    if raw:
        cells = df.select(*group, melted).where(F.col("_value").isNotNull())
        ranks = value_ranks(cells, [*group, "_column"], "_value").withColumn("_rank", F.col("n_below") + (F.col("n_equal") + 1) / 2)
        for i, v in enumerate(values):
            mine = ranks.where(F.col("_column") == i).select(*[F.col(g).alias(f"_of_{g}") for g in group], "_value", F.col("_rank").alias(f"{v}{suffix}"))
            same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group], F.col(v).cast("double") == F.col("_value"))
            df = df.join(mine, same, "left").drop("_value", *[f"_of_{g}" for g in group])
        return df
    rows = stage_table(df.withColumn("_member", F.monotonically_increasing_id()))
    cells = rows.select("_member", *group, melted).where(F.col("_value").isNotNull())
    ranks = average_positions(cells, [*group, "_column"], "_value", "_member")
    found = ranks.groupBy("_member").agg(F.map_from_entries(F.collect_list(F.struct("_column", "_rank"))).alias("_ranks"))
    rows = rows.join(found, "_member", "left")
    return rows.withColumns({f"{v}{suffix}": F.try_element_at("_ranks", F.lit(i)) for i, v in enumerate(values)}).drop("_member", "_ranks")


def _whole_groups(batches, group: str):
    """Tables of whole groups from batches that come group by group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = held.column(group)[len(held) - 1]
        first = pc.index(held.column(group), last).as_py()  # where the group begins that may go on
        if first:
            yield held.slice(0, first).combine_chunks()
            held = held.slice(first)
    if held is not None:
        yield held.combine_chunks()


def _measures(x: np.ndarray, known: np.ndarray, starts: np.ndarray, group: np.ndarray):
    """(z-score, whether it has one, average rank) of the values of groups that begin at ``starts``."""
    add = lambda v: np.add.reduceat(np.where(known, v, 0.0), starts)
    with np.errstate(all="ignore"):
        n = add(np.ones(len(x)))
        mean = add(x) / n
        away = x - mean[group]
        spread = np.sqrt(add(away * away) / (n - 1))
        varies = (n > 1) & ((spread > VARIES * np.maximum(1.0, np.abs(mean))) | (np.isnan(spread) & ~np.isnan(mean)))
        z = away / spread[group]
    at = np.flatnonzero(known)
    at = at[np.lexsort((x[at], group[at]))]
    v, g, place = x[at], group[at], np.arange(len(at))
    fresh, other = np.ones(len(at), bool), np.ones(len(at), bool)
    fresh[1:] = g[1:] != g[:-1]
    other[1:] = fresh[1:] | ~((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    begin = np.flatnonzero(other)
    tied = np.cumsum(other) - 1
    middle = (begin + np.append(begin[1:], len(at)) - 1) / 2
    rank = np.zeros(len(x))
    rank[at] = middle[tied] - np.maximum.accumulate(np.where(fresh, place, 0)) + 1 if len(at) else 0.0
    return z, known & varies[group], rank


def _relative_to_small(df: DataFrame, values: Sequence[str], group: str) -> DataFrame:
    """``df`` with ``<value>_z`` and ``<value>_avg_rank``: rows meet once by group, whatever the number of values."""
    new = [T.StructField(f"{v}{end}", T.DoubleType()) for v in values for end in ("_z", "_avg_rank")]
    schema = T.StructType([*df.schema.fields, *new])

    def work(batches):
        for table in _whole_groups(batches, group):
            keys = table.column(group).combine_chunks()
            border = np.ones(len(table), bool)
            border[1:] = np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)))
            starts, of = np.flatnonzero(border), np.cumsum(border) - 1
            columns = list(table.columns)
            for v in values:
                own = pc.cast(table.column(v), pa.float64(), safe=False)
                known = np.asarray(pc.is_valid(own))
                z, has, rank = _measures(np.asarray(pc.fill_null(own, 0.0)), known, starts, of)
                columns += [pa.array(z, mask=~has), pa.array(rank, mask=~known)]
            yield from pa.table(columns, schema.names).to_batches()

    return df.repartition(group).sortWithinPartitions(group).mapInArrow(work, schema)


def _relative_to_large(df: DataFrame, values: Sequence[str], group: str, raw: bool) -> DataFrame:
    """The same columns from aggregates and sorted ranges, so that no task sees a group."""
    stats = {}
    for v in values:
        stats[f"_mean_{v}"] = F.avg(v)
        stats[f"_sd_{v}"] = F.stddev_samp(v)
    rows = average_ranks(with_group_stats(df, [group], stats), [group], values, raw=raw)
    out = {}
    for v in values:
        sd, mean = F.col(f"_sd_{v}"), F.col(f"_mean_{v}")
        varies = sd > VARIES * F.greatest(F.lit(1.0), F.abs(mean))
        out[f"{v}_z"] = F.when(varies, (F.col(v) - mean) / sd)
    return rows.withColumns(out).drop(*stats)


def relativize(df: DataFrame, values: Sequence[str] | str, group: str = "race_id", size: str = "n_starters", raw: bool = False) -> DataFrame:
    """Add ``<value>_z`` (null where the group does not vary) and ``<value>_rank`` (average rank / size).

    Groups of up to ``SMALL_GROUP`` members are measured whole, all values in one exchange of the rows; larger ones, and rows
    without a group, by aggregates and sorted ranges. Select what is needed first: the rows take part with all their columns.
    ``raw``: the values are read, not computed (see :func:`average_ranks`)."""
    values = [values] if isinstance(values, str) else list(values)
    if not values:
        return df
    apart = df.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_members")).where(
        F.col("_of").isNull() | (F.col("_members") > SMALL_GROUP)).select("_of")
    if apart.isEmpty():
        rows = _relative_to_small(df, values, group)
    else:
        apart = stage_table(apart)
        same = F.col(group).eqNullSafe(F.col("_of"))
        rows = _relative_to_small(df.join(apart, same, "left_anti"), values, group).unionByName(
            _relative_to_large(df.join(apart, same, "left_semi"), values, group, raw))
    out = {}
    for v in values:
        out[f"{v}_z"] = F.col(f"{v}_z")
        out[f"{v}_rank"] = F.col(f"{v}_avg_rank") / F.col(size)
    return rows.select(*df.columns, *[c.alias(name) for name, c in out.items()])


def group_quantiles(df: DataFrame, group: Sequence[str], value: str, quantiles: Mapping[str, float],
                    count: str | None = None) -> DataFrame:
    """Interpolated quantiles per group (and, as ``count``, the number of values), read off the ranks of the values.

    A group without values has null quantiles and count 0.
    """
    group = list(group)
    ranks = value_ranks(df, group, value)
    upper = F.col("n_below") + F.col("n_equal")
    columns = []
    for name, q in quantiles.items():
        rank = F.lit(q) * (F.col("n_group") - 1)
        at = lambda k: F.max(F.when((F.col("n_below") <= k) & (k < upper), F.col(value)))
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        columns.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    if count:
        columns.append(F.max("n_group").alias(count))
    found = ranks.groupBy(*group).agg(*columns)
    named = found.withColumnsRenamed({g: f"_of_{g}" for g in group})
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group], F.lit(True))
    every = df.select(*group).distinct().join(named, same, "left").drop(*[f"_of_{g}" for g in group])
    return every.fillna(0, [count]) if count else every


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only ``k`` per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def softmax(df: DataFrame, group: str, score: str, out: str, temperature: float | Column = 1.0) -> DataFrame:
    """Group-normalised ``exp(score / temperature)``, shifted by the group's maximum."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = df.withColumn("_scaled", F.col(score) / t)
    shifted = with_group_stats(scaled, [group], {"_top": F.max("_scaled")})
    shifted = shifted.withColumn("_exp", F.exp(F.col("_scaled") - F.col("_top")))
    shares = with_group_stats(shifted, [group], {"_total": F.sum("_exp")})
    return shares.withColumn(out, F.col("_exp") / F.col("_total")).drop("_scaled", "_top", "_exp", "_total")


def normalise(df: DataFrame, group: str, weight: Column, out: str) -> DataFrame:
    """Each row's share of its group's total weight."""
    rows = with_group_stats(df.withColumn("_w", weight), [group], {"_total": F.sum("_w")})
    return rows.withColumn(out, F.col("_w") / F.col("_total")).drop("_w", "_total")
