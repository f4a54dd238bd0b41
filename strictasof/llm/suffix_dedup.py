"""Suffix-array dedup by merging Burrows-Wheeler transforms.

Byte strings of ``length`` that occur more than once are found in merged suffix order. Each shard has its own suffix
array and Burrows-Wheeler transform; their interleaving starts as one block and is refined round by round: every row moves
to the row of the suffix that begins ``STEP`` bytes earlier (the LF mapping taken ``STEP`` times) and the rows are dealt,
stably, by those bytes, which the transform itself spells. After a round the interleaving is sorted by one more step, and
neighbours that agreed so far and got equal bytes share a block: the blocks are the intervals with that common prefix. No
suffix is compared or sorted again. A row alone in its block stays alone and leaves, and only rows whose last step lands
on a window start are carried, so a round costs in proportion to what may still recur.

What is merged is bounded: shards hold the segments of some anchors (see :mod:`.recur`), never a whole corpus.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unbundle, widened
from .recur import BYTES, covered, recurring, runs_of
from .registry import query

LENGTH, GRAM = 200, 50
#: bytes of segments judged together, and the shards whose transforms are merged
JUDGED_BYTES, SHARDS = 256 << 10, 4
#: bytes by which a round refines the interleaving
STEP = 8


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes (the end is lowest), by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(STEP, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(STEP):
        key = key << np.uint64(8) | padded[j:j + n]
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(~same)
    reach = STEP
    while reach < depth and same.any():
        tied = same | np.concatenate([same[1:], [False]])  # only ranks that are shared need another look
        rows = order[tied]
        after = np.where(rows + reach < n, rank[np.minimum(rows + reach, n - 1)], 0)
        pair = rank[rows] * (n + 1) + after
        again = np.argsort(pair, kind="stable")
        order[tied] = rows[again]
        pair = pair[again]
        still = np.zeros(n, bool)
        still[np.flatnonzero(tied)] = np.concatenate([[False], pair[1:] == pair[:-1]])
        # the rank of a group is the place of its first row, so ranks only grow finer
        place = np.arange(1, n + 1)
        rank[order] = np.maximum.accumulate(np.where(still, 0, place))
        same, reach = still, 2 * reach
    return order


class Transform:
    """Suffix array, Burrows-Wheeler transform and LF mapping of one shard's text."""

    def __init__(self, text: np.ndarray, depth: int):
        self.suffixes = suffix_order(text, depth)
        self.row = np.empty(len(text), np.int64)
        self.row[self.suffixes] = np.arange(len(text))
        self.bwt = text[self.suffixes - 1]
        self.lf = self.row[self.suffixes - 1]

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the ``STEP`` bytes before its suffix as a number, and the row of the suffix they begin."""
        row, key = np.arange(len(self.bwt)), np.zeros(len(self.bwt), np.uint64)
        for j in range(STEP):
            key |= self.bwt[row].astype(np.uint64) << np.uint64(8 * j)
            row = self.lf[row]
        return key, row


def _stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2**32, by counting 16 bits at a time."""
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    if len(codes) and codes.max() >> 16:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merged_repeats(shards: list[tuple[np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each shard (text, window starts): whether the ``length`` bytes from each start occur at another one as well.

    ``length`` must be a multiple of the step; windows must lie inside the text.
    """
    keys, moves, rows, base = [], [], [], 0
    for text, starts in shards:
        transform = Transform(text, length)
        key, move = transform.steps()
        keys.append(key)
        moves.append(move + base)
        # the suffix that begins where the window ends; at the very end of the text, the suffix there is the whole text's
        rows.append(transform.row[(starts + length) % len(text)] + base)
        base += len(text)
    _, code = np.unique(np.concatenate(keys), return_inverse=True)
    move = np.concatenate(moves)
    row = np.concatenate(rows)  # the interleaving of what is carried: one block, shard after shard
    window = np.arange(len(row))
    block = np.zeros(len(row), np.int64)
    for _ in range(length // STEP):
        step = code[row]
        order = _stable_order(step)
        step, block, window, row = step[order], block[order], window[order], move[row[order]]
        new = np.concatenate([[True], (step[1:] != step[:-1]) | (block[1:] != block[:-1])])[:len(row)]
        block = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]])[:len(row)]
        row, block, window = row[~alone], block[~alone], window[~alone]
        if not len(row):
            break
    again = np.zeros(sum(len(r) for r in rows), bool)
    again[window] = True
    return np.split(again, np.cumsum([len(r) for r in rows])[:-1])


def merging_judge(length: int, shards: int = SHARDS):
    """A judge for :func:`recur.recurring`."""

    def judge(segments: list[bytes], windows: np.ndarray, seen: np.ndarray) -> list[list[tuple[int, int]]]:
        groups = [g for g in np.array_split(np.arange(len(segments)), min(shards, len(segments))) if len(g)]
        built = []
        for group in groups:
            sizes = np.array([len(segments[i]) for i in group])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            n = windows[group]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            built.append((np.frombuffer(b"".join([segments[i] for i in group]), np.uint8), np.repeat(begin, n) + inside))
        out = []
        for group, again in zip(groups, merged_repeats(built, length)):
            at = 0
            for i in group.tolist():
                n = int(windows[i])
                flags = again[at:at + n] if seen[i] == 1 else np.ones(n, bool)
                out.append([(a, b + length - 1) for a, b in runs_of(flags)])
                at += n
        return out

    return judge


def removed_bytes(docs: DataFrame, length: int = LENGTH, text: str = "text", gram: int = GRAM, judged_bytes: int = JUDGED_BYTES,
                  shards: int = SHARDS, **settings) -> DataFrame:
    """The other columns of ``docs`` with n_bytes, n_removed, spans (removed runs, in bytes) and ``kept`` (binary).

    Columns of these names are replaced. A null text counts as empty. ``length`` must be a multiple of eight.
    """
    if length % STEP:
        raise ValueError(f"length must be a multiple of {STEP}")
    added = [*("n_bytes", "n_removed", "spans", "kept")]
    others = [c for c in docs.columns if c not in (text, *added)]
    rows = recurring(docs.select(*[f"`{c}`" for c in others], text), BYTES, length, gram, merging_judge(length, shards), judged_bytes, text, **settings)
    schema = widened(rows.select("others"), "n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>, kept binary")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def cut(batches):
        for batch in batches:
            n, gone, runs, kept = [], [], [], []
            for value, whole, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "spans"))):
                data = value.encode()
                out = covered(spans, bool(whole), len(data), length)
                n.append(len(data))
                gone.append(sum(b - a for a, b in out))
                runs.append([{"start": a, "stop": b} for a, b in out])
                edges = [0, *[e for run in out for e in run], len(data)]
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-4]] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(runs, spans_type), pa.array(kept, pa.binary())], schema.names)

    return rows.mapInArrow(cut, schema).select(*unbundle(others, "others"), *added)


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    """Every document without the bytes of its 200-byte strings that occur anywhere else."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                      F.sha2("kept", 256).alias("kept_sha256"))
