"""Where documents share stretches of ``length`` units (words or bytes): the search both substring operators build on.

1. Anchors. Of the ``gram``-unit strings inside every window of ``length`` units, the one with the least hash is the
   window's anchor. Equal windows have equal anchors, so a window can only recur if its anchor does, and only about
   2 / (length - gram + 2) of all positions are anchors. All windows of all documents take part.
2. Segments. Around each anchor that occurs twice or more in the corpus lie the windows it stands for; their text is the
   segment. Equal segments are counted, not repeated, and of equal documents only one gives segments.
3. Verdicts. An anchor with one segment, seen twice, needs no more: all of it recurs. Else the operator's own ``judge``
   looks at all segments of some anchors together (a shard of bounded size) and says which stretches recur. An anchor
   with more than ``crowd`` different segments is judged window by window, counted by content over all tasks.
4. The stretches go back to the documents by row. Tables that nothing reads any more are removed on the way.

No step holds more than a document, a shard or one task's counts. Lengths are in units; positions count from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Rolling, bundle, flat_bytes, mix, numbered, parts_by_size, release, stage

#: units handled at a time when anchors are sought; also the room for positions in a sort key
CHUNK, POSITION_BITS = 1 << 20, 24
#: bytes of text handled at a time
PART_BYTES = 1 << 18
#: different segments of one anchor that are judged in one shard
CROWD = 2000
#: bytes of segments that one shuffled partition aims at
PARTITION_BYTES = 32 << 20

_ROLLING = Rolling()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


@dataclass(frozen=True)
class Units:
    """How a text is cut: ``bytes`` or words ``[^\\x20\\x09-\\x0D]+``."""

    words: bool

    def hashes(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number per unit and the offsets of the documents in units."""
        if not self.words:
            return buffer.astype(np.uint64) + np.uint64(1), offsets
        space = _IS_SPACE[buffer]
        edge = np.zeros(len(buffer) + 1, bool)
        edge[offsets] = True  # a word ends where its document does
        word = ~space
        starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], space[:-1]])))
        ends = np.flatnonzero(word & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
        return _ROLLING.spans(buffer.astype(np.uint64) + np.uint64(1), starts, ends), np.searchsorted(starts, offsets)

    def cut(self, text: bytes) -> list[bytes] | bytes:
        return text.split() if self.words else text

    def join(self, units) -> bytes:
        return b" ".join(units) if self.words else units


WORDS, BYTES = Units(True), Units(False)


def window_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` units."""
    n = len(units) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return _ROLLING.spans_of(units, size)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def anchors(units: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(hash, document, first window, windows) of every anchor of the documents whose units are given."""
    mask = np.uint64((1 << POSITION_BITS) - 1)
    out = []
    for at in range(0, max(0, len(units) - length + 1), CHUNK):
        part = units[at:at + CHUNK + length - 1]
        grams = window_hashes(part, gram)
        key = grams & ~mask | np.arange(len(grams), dtype=np.uint64)
        place = (_least(key, length - gram + 1) & mask).astype(np.int64)
        starts = np.arange(len(place)) + at
        document = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + length <= offsets[document + 1]
        place, starts, document = place[inside], starts[inside], document[inside]
        if not len(place):
            continue
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (document[1:] != document[:-1])]))
        count = np.diff(np.append(new, len(place)))
        out.append((grams[place[new]], document[new], starts[new] - offsets[document[new]], count))
    if not out:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def _anchor_rows(rows: DataFrame, units: Units, length: int, gram: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for part in parts_by_size(batch, "text", PART_BYTES):
                values, offsets = units.hashes(*flat_bytes(part.column("text")))
                h, document, first, count = anchors(values, offsets, length, gram)
                ids = part.column("row_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[document]), pa.array(first.astype(np.int32)),
                                                  pa.array(count.astype(np.int32))], ["h", "row_id", "first", "n"])

    return rows.select("row_id", "text").mapInArrow(work, "h long, row_id long, first int, n int")


def _segments(rows: DataFrame, units: Units, length: int) -> DataFrame:
    """(row_id, first, h, c, n, weight, segment) from rows with text, weight and the list ``marks`` of (first, n, h)."""
    schema = "row_id long, first int, h long, c binary, n int, weight long, segment binary"

    def work(batches):
        for batch in batches:
            for part in parts_by_size(batch, "text", PART_BYTES):
                out = [[] for _ in range(7)]
                for row_id, text, weight, marks in zip(*(part.column(c).to_pylist() for c in ("row_id", "text", "weight", "marks"))):
                    cut = units.cut(text.encode())
                    for m in marks:
                        segment = units.join(cut[m["first"]:m["first"] + m["n"] + length - 1])
                        for column, v in zip(out, (row_id, m["first"], m["h"], xxhash.xxh3_128_digest(segment), m["n"], weight, segment)):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(work, schema)


#: segments (bytes), windows of each, how often each was seen -> recurring stretches (start, stop) of each, in units
Judge = Callable[[list[bytes], np.ndarray, np.ndarray], list[list[tuple[int, int]]]]


def _judged(segments: DataFrame, judge: Judge, shard_bytes: int) -> DataFrame:
    """(h, c, a, b): the judge's stretches; shards are made of whole anchors, at most about ``shard_bytes`` each."""

    def work(batches):
        held: list[tuple] = []

        def verdicts(rows):
            found = judge([r[4] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64))
            flat = [(r[0], r[1], a, b) for r, spans in zip(rows, found) for a, b in spans]
            columns = list(zip(*flat)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "c", "a", "b"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "c", "n", "weight", "segment"))):
                if size >= shard_bytes and row[0] != held[-1][0]:
                    yield verdicts(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield verdicts(held)

    total = segments.agg(F.sum(F.octet_length("segment")).alias("b")).first().b or 0
    parts = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    dealt = segments.select("h", "c", "n", "weight", "segment").repartition(parts, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(work, "h long, c binary, a int, b int")


def _by_window(segments: DataFrame, units: Units, length: int) -> DataFrame:
    """(h, c, a, b) for crowded anchors: windows counted by content."""

    def work(batches):
        for batch in batches:
            for h, c, n, weight, segment in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "n", "weight", "segment"))):
                cut = segment.split(b" ") if units.words else segment
                windows = [xxhash.xxh3_128_digest(units.join(cut[j:j + length])) for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * n), pa.array([c] * n, pa.binary()), pa.array(range(n), pa.int32()),
                                                  pa.array([weight] * n), pa.array(windows, pa.binary())], ["h", "c", "a", "weight", "w"])

    windows = stage(segments.select("h", "c", "n", "weight", "segment").mapInArrow(work, "h long, c binary, a int, weight long, w binary"), "windows")
    twice = windows.groupBy("w").agg(F.sum("weight").alias("s")).where("s > 1").select("w")
    return windows.join(twice, "w").select("h", "c", "a", (F.col("a") + length).alias("b"))


def recurring(docs: DataFrame, units: Units, length: int, gram: int, judge: Judge, shard_bytes: int, text: str = "text",
              crowd: int = CROWD) -> DataFrame:
    """(text, others, whole, spans): every row's text, its other columns as a struct, and what recurs in it.

    ``spans`` are (a, b) pairs of units, unordered and possibly overlapping; ``whole`` tells that the row's text occurs
    more than once, so that all of it recurs if it is at least ``length`` long. A null text counts as empty.
    """
    rows = numbered(docs, bundle(docs, [c for c in docs.columns if c != text], "others"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), name="texts")
    copies = rows.select("row_id", F.sha2("text", 256).alias("key"))
    # counts are stored before rows join them: only then can Spark split the rows of a hot key
    counted = stage(copies.groupBy("key").agg(F.min("row_id").alias("one"), F.count("*").alias("weight")).where("weight > 1"), "counts")
    copies = stage(copies.join(counted, "key").select("row_id", "weight", (F.col("row_id") == F.col("one")).alias("one")), "copies")

    found = stage(_anchor_rows(rows, units, length, gram), "anchors")
    twice = stage(found.groupBy("h").agg(F.count("*").alias("s")).where("s > 1").select("h"), "twice")
    marks = found.join(twice, "h").groupBy("row_id").agg(F.collect_list(F.struct("first", "n", "h")).alias("marks"))
    marks = marks.join(copies, "row_id", "left").where("one is null or one").select(
        "row_id", "marks", F.coalesce("weight", F.lit(1).cast("long")).alias("weight"))
    segments = stage(_segments(rows.select("row_id", "text").join(marks, "row_id"), units, length), "segments")
    release(found)
    release(twice)

    one = F.min(F.struct("row_id", "first"))
    kinds_of = stage(segments.groupBy("h", "c").agg(F.sum("weight").alias("weight"), F.first("n").alias("n"), one.alias("one")), "kinds")
    crowds = stage(kinds_of.groupBy("h").agg(F.count("*").alias("kinds")), "crowds")
    kinds = kinds_of.join(crowds, "h")
    alone = kinds.where("kinds = 1 and weight > 1").select("h", "c", F.lit(0).alias("a"), (F.col("n") + length - 1).alias("b"))
    # the text of one segment of each kind, where an anchor has several
    several = kinds.where("kinds > 1").select("one.row_id", "one.first", "h", "c", "kinds", F.col("weight").alias("seen"))
    shown = stage(segments.select("row_id", "first", "h", "c", "n", "segment").join(several, ["row_id", "first", "h", "c"]).select(
        "h", "c", "n", F.col("seen").alias("weight"), "segment", "kinds"), "shown")
    some = _judged(shown.where(F.col("kinds") <= crowd), judge, shard_bytes)
    many = _by_window(shown.where(F.col("kinds") > crowd), units, length)
    verdicts = alone.unionByName(some).unionByName(many)
    spans = segments.select("row_id", "first", "h", "c").join(verdicts, ["h", "c"]).groupBy("row_id").agg(
        F.collect_list(F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))).alias("spans"))
    whole = copies.select("row_id", F.lit(True).alias("whole"))
    spans = stage(spans.join(whole, "row_id", "full").withColumn("whole", F.coalesce("whole", F.lit(False))), "spans")
    for done in (segments, kinds_of, crowds, shown, copies):
        release(done)
    return rows.join(spans, "row_id", "left").select("text", "others", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")


def covered(spans: list | None, whole: bool, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal recurring runs of a text of ``n`` units, in order."""
    if whole:
        return [(0, n)] if n >= length else []
    runs: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


__all__ = ["BYTES", "WORDS", "Units", "anchors", "covered", "mix", "recurring", "runs_of", "window_hashes"]
