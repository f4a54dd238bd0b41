"""Bootstrap percentile intervals without resampling rows.

A resample only matters through how often each distinct unit value was drawn. The units are first reduced to distinct
values with their counts (cells). A resample then draws a Poisson number for each cell, with the cell's count as its mean:
cells are independent of each other, each is drawn once, from a seed of its own values, and the sums of all tasks add up.
So the draws depend neither on partitions nor on other slices, and the work grows with cells times draws. Statistics are
ratios of resampled sums, which do not depend on the number of units a resample happens to hold; an empty one is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table

#: slices whose sums a task holds before it hands them on
HELD_SLICES = 64


def value_cells(units: DataFrame, values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Distinct unit values per slice and how many units have them (``_n``), stored: every later step reads them."""
    columns = [c.cast("double").alias(n) for n, c in values.items()]
    return stage_table(units.groupBy(*by, *columns).agg(F.count("*").alias("_n")))


def _times(seed: int, cell: tuple, mean: int, n_boot: int) -> np.ndarray:
    """How often a cell is drawn in each resample; the same wherever the cell lies."""
    key = int.from_bytes(hashlib.blake2b(repr((seed, cell)).encode(), digest_size=16).digest(), "big")
    return np.random.Generator(np.random.Philox(key=key)).poisson(mean, n_boot)


def bootstrap_sums(cells: DataFrame, names: Sequence[str], n_boot: int = 10_000, seed: int = 20260819,
                   by: Sequence[str] = ()) -> DataFrame:
    """(rep, resampled sum of each value) per ``by`` slice, without the resamples that drew no unit."""
    by, names = list(by), list(names)
    schema = T.StructType([*[cells.schema[b] for b in by], T.StructField("rep", T.LongType()),
                           *[T.StructField(n, T.DoubleType()) for n in (*names, "_drawn")]])

    def draw(batches):
        held: dict[tuple, np.ndarray] = {}

        def rows():
            for slice_, sums in held.items():
                keys = [pa.array([v] * n_boot, kinds[b]) for b, v in zip(by, slice_)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(n_boot)), *[pa.array(c) for c in sums]], schema.names)
            held.clear()

        for batch in batches:
            kinds = {b: batch.schema.field(b).type for b in by}
            columns = [batch.column(c).to_pylist() for c in (*by, *names, "_n")]
            for row in zip(*columns):
                slice_, values, mean = row[:len(by)], row[len(by):-1], row[-1]
                if slice_ not in held:
                    if len(held) >= HELD_SLICES:
                        yield from rows()
                    held[slice_] = np.zeros((len(names) + 1, n_boot))
                times = _times(seed, row[:-1], mean, n_boot)
                for total, v in zip(held[slice_], (*[0.0 if v is None else v for v in values], 1.0)):
                    total += times * v
        yield from rows()

    sums = cells.select(*by, *names, "_n").mapInArrow(draw, schema).groupBy(*by, "rep").agg(
        *[F.sum(n).alias(n) for n in (*names, "_drawn")])
    return sums.where(F.col("_drawn") > 0).drop("_drawn")


def bootstrap_ratio(units: DataFrame, numerator: Column, denominator: Column, n_boot: int = 10_000,
                    seed: int = 20260819, by: Sequence[str] = ()) -> DataFrame:
    """(rep, ratio) per slice: ratio of resampled sums, 0 where the resampled denominator is 0."""
    return _ratios(value_cells(units, {"num": numerator, "den": denominator}, by), n_boot, seed, by)


def _ratios(cells, n_boot, seed, by):
    sums = bootstrap_sums(cells, ["num", "den"], n_boot, seed, by)
    ratio = F.when(F.col("den") != 0, F.col("num") / F.col("den")).otherwise(F.lit(0.0))
    return sums.select(*by, "rep", ratio.alias("ratio"))


def percentile_ends(reps: DataFrame, value: str, by: Sequence[str] = (),
                    ends: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Two order statistics of the resampled values of each slice, as many values as there were resamples."""
    ordered = reps.select(*by, value, F.row_number().over(Window.partitionBy(*by).orderBy(value, "rep")).alias("_rn"),
                          F.count("*").over(Window.partitionBy(*by)).alias("_m"))
    at = lambda end: F.least(F.floor(F.lit(end) * F.col("_m")) + 1, F.col("_m"))
    pick = lambda end, name: F.max(F.when(F.col("_rn") == at(end), F.col(value))).alias(name)
    return ordered.groupBy(*by).agg(pick(ends[0], "ci_low"), pick(ends[1], "ci_high"))


def bootstrap_interval(units: DataFrame, numerator: Column, denominator: Column, n_boot: int = 10_000,
                       seed: int = 20260819, by: Sequence[str] = (),
                       ends: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Point ratio and percentile interval per slice.

    One unit gives its own ratio as both ends; without units there is no row.
    """
    by = list(by)
    cells = value_cells(units, {"num": numerator, "den": denominator}, by)
    total = lambda c: F.sum(F.col(c) * F.col("_n"))
    point = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.try_divide(total("num"), total("den")).alias("ratio"))
    bounds = percentile_ends(_ratios(cells, n_boot, seed, by), "ratio", by, ends)
    if by:
        return point.join(bounds, by)
    return point.withColumns({"ci_low": bounds.select("ci_low").scalar(), "ci_high": bounds.select("ci_high").scalar()})


def blend_weight_interval(losses: DataFrame, weights: Sequence[float], n_boot: int = 1_000, seed: int = 20260819) -> DataFrame:
    """Best blend weight on all events and the percentile interval of the best weight over resampled events.

    ``losses`` holds one row per event with columns l0, l1, ... in the order of ``weights``.
    """
    names = [f"l{i}" for i in range(len(weights))]
    best = F.array_min(F.array(*[F.struct(F.col(n).alias("loss"), F.lit(float(w)).alias("w")) for n, w in zip(names, weights)]))["w"]
    cells = value_cells(losses, {n: F.col(n) for n in names})
    reps = bootstrap_sums(cells, names, n_boot, seed).select("rep", best.alias("w"))
    point = cells.agg(*[F.sum(F.col(n) * F.col("_n")).alias(n) for n in names]).select(best.alias("w"))
    bounds = percentile_ends(reps, "w")
    return point.withColumns({"ci_low": bounds.select("ci_low").scalar(), "ci_high": bounds.select("ci_high").scalar()})
