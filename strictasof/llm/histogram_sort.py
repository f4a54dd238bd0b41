"""Sharding by histogram sort.

Rows are put in the order of their keys and cut into shards of near-equal bytes. The cutting keys are found without
sorting: candidate boundaries are probed, the exact bytes below each are counted over all partitions, and each splitter's
interval shrinks to the probe step that holds its target, until it is as close as the tolerance asks or the interval is
a single key. Only then rows move, once, each to its piece.

A key may hold a third of all rows. Splitters that end inside one key go on with the next column of the order; the last
column is a row number, so every order is strict and a hot group is cut where the bytes say. A shard is moved as several
pieces of bounded bytes, so no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bundle, numbered, unbundle
from .registry import query

#: candidate boundaries probed inside each splitter's interval in one round
PROBES = 64
#: bytes that one exchanged piece of a shard aims at
PIECE_BYTES = 64 << 20
#: pieces of all shards together; beyond it pieces grow instead, and Spark's sort spills
MOST_PIECES = 4096
LOW, HIGH = -(1 << 63), 1 << 63


class _Search:
    """One splitter: the cut lies between lo (inclusive) and hi of column ``level``, below a fixed prefix."""

    def __init__(self, target: int):
        self.target, self.prefix, self.lo, self.hi = target, (), LOW, HIGH
        self.key: tuple | None = None

    def probes(self) -> list[tuple]:
        step = max(1, (self.hi - self.lo) // PROBES)
        return [self.prefix + (v,) for v in range(self.lo + step, self.hi, step)][:PROBES + 1]


def _rank(boundaries: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many of the ascending boundaries are at or below each key; both are given column by column."""
    left = np.searchsorted(boundaries[0], keys[0], "left")
    at = np.searchsorted(boundaries[0], keys[0], "right")
    if len(boundaries) > 1:
        tied = np.flatnonzero(left != at)  # only these need the later columns
        for first, last in set(zip(left[tied].tolist(), at[tied].tolist())):
            rows = tied[left[tied] == first]
            at[rows] = first + _rank([b[first:last] for b in boundaries[1:]], [k[rows] for k in keys[1:]])
    return at


def _bins(boundaries: list[tuple], columns: int):
    """A function that places keys in the len(boundaries) + 1 bins; a short boundary is filled with the lowest value."""
    full = [b + (LOW,) * (columns - len(b)) for b in boundaries]
    arrays = [np.array([b[c] for b in full], np.int64) for c in range(columns)]
    return lambda keys: _rank(arrays, keys)


def _counts(keys: DataFrame, boundaries: list[tuple], columns: list[str]) -> tuple[list[int], list[int]]:
    """Rows and bytes in each of the len(boundaries) + 1 bins, counted exactly: one small row per bin and task."""
    place, n = _bins(boundaries, len(columns)), len(boundaries) + 1

    def count(batches):
        rows, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            at = place([batch.column(c).to_numpy() for c in columns])
            rows += np.bincount(at, minlength=n)
            np.add.at(total, at, batch.column("_size").to_numpy())
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(rows[used]), pa.array(total[used])], ["bin", "n", "b"])

    got = keys.select(*columns, "_size").mapInArrow(count, "bin long, n long, b long").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"))
    rows, size = [0] * n, [0] * n
    for r in got.collect():  # as many rows as there are boundaries
        rows[r.bin], size[r.bin] = r.n, r.b
    return rows, size


def splitters(keys: DataFrame, columns: list[str], targets: list[int], tolerance: int) -> list[tuple]:
    """Order keys (first key of the upper side) at which the bytes below come within ``tolerance`` of each target.

    Where no key does, the key just below the target is taken, so the fault is less than one row.
    """
    searches = [_Search(t) for t in targets]
    while any(s.key is None for s in searches):
        live = [s for s in searches if s.key is None]
        ordered = sorted({p for s in live for p in s.probes()}, key=lambda b: b + (LOW,) * (len(columns) - len(b)))
        _, size = _counts(keys, ordered, columns)
        below, total = {}, 0
        for b, s in zip(ordered, size):
            total += s
            below[b] = total
        for s in live:
            inside = s.probes()
            best = min(inside, key=lambda p: abs(below[p] - s.target), default=None)
            if best is not None and abs(below[best] - s.target) <= tolerance:
                s.key = best
                continue
            under = [p for p in inside if below[p] <= s.target]
            over = [p for p in inside if below[p] > s.target]
            s.lo = under[-1][-1] if under else s.lo
            s.hi = over[0][-1] if over else s.hi
            if s.hi - s.lo == 1:
                if len(s.prefix) + 1 == len(columns):
                    s.key = s.prefix + (s.lo,)
                else:  # the target lies within this one key: go on with the next column
                    s.prefix, s.lo, s.hi = s.prefix + (s.lo,), LOW, HIGH
    return [s.key + (LOW,) * (len(columns) - len(s.key)) for s in searches]


def histogram_shards(rows: DataFrame, order: list[Column], size: Column, shards: int, tolerance: float = 0.0005,
                     piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 .. shards - 1), ``slot`` (long, gapless from 0 in each shard).

    ``order``: bigint columns that sort the rows; nulls sort first. ``size``: bytes of a row, at least 1. Shards differ
    from total / shards by ``tolerance`` of it or less than a row. Equal rows are told apart by a written row number.
    An empty table gives no rows. Columns of ``rows`` named like the added ones are replaced.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    names = [f"_k{i}" for i in range(len(order))]
    columns = [*names, "row_id"]
    staged = numbered(rows, bundle(rows, kept), size.cast("long").alias("_size"),
                      *[F.coalesce(k.cast("long"), F.lit(LOW)).alias(n) for k, n in zip(order, names)], name="histogram")
    keys = staged.select(*columns, "_size")
    total = keys.agg(F.sum("_size").alias("b")).first().b or 0
    per_shard = max(1, min(round(total / shards / piece_bytes), MOST_PIECES // shards))
    pieces = shards * per_shard
    cuts = sorted(splitters(keys, columns, [total * i // pieces for i in range(1, pieces)],
                            max(1, int(tolerance * total / shards))))
    counts, _ = _counts(keys, cuts, columns)
    before = [sum(counts[p - p % per_shard:p]) for p in range(pieces)]
    place = _bins(cuts, len(columns))

    def pieced(batches):
        for batch in batches:
            at = place([batch.column(c).to_numpy() for c in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], [*batch.schema.names, "_piece"])

    placed = staged.mapInArrow(pieced, T.StructType([*staged.schema.fields, T.StructField("_piece", T.LongType())]))
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy(*columns)) - 1
    first = F.element_at(F.lit(before), (F.col("_piece") + 1).cast("int"))
    return placed.withColumns({
        "shard": F.floor(F.col("_piece") / per_shard).cast("int"), "slot": (inside + first).cast("long"),
    }).select(*unbundle(kept), "shard", "slot")


@query("op6_histogram_sort")
def op6_histogram_sort(spark, sf_dir):
    """All documents in 16 shards of near-equal bytes, ordered by (hash of the text, doc_id): equal texts lie together.

    Null texts have size 1 and the CRC of the empty text; null ids sort first.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    placed = histogram_shards(rows, [F.col("text_hash"), F.col("doc_id")], F.col("size"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
