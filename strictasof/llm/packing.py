"""Best-fit packing by exact-complement hashing.

Documents become token ids and end with a separator; only longer ones are cut, into full pieces after a first shorter one.
What is packed is the histogram of piece lengths, at most ``capacity`` numbers whatever the corpus holds. For each length,
longest first, the sums of one, two or three other lengths are looked up for the exact gap, and a combination that fills
it is taken as often as the counts allow. What is left is best-fitted, length by length. Pieces then find their places by
their rank within their length, so no task sees more than its own rows and nothing but the histogram reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import accumulate
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_by_size, stage, widened
from .registry import query

CAPACITY, SEPARATOR = 2048, 0
#: chunks of text after which a Python worker remembers anew, beside as many before; this bounds memory, not results
REMEMBERED = 300_000
#: code points of a chunk that is remembered: a text without spaces is one chunk
LONGEST = 64
#: bytes of text encoded at a time
PART_BYTES = 1 << 20


class _Chunks(dict):
    """Ids, as little-endian bytes, of the chunks of text between single spaces, each worked out when first met.

    ``older`` are those met before the last renewal: the frequent ones come back from there.
    """

    def __init__(self, encode, before: str, older: dict[str, bytes] | None = None):
        super().__init__()
        self.encode, self.before, self.older = encode, before, older or {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encode(chunk, self.before)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def renewed(self) -> _Chunks:
        self.older = {}
        return _Chunks(self.encode, self.before, self)


class Encoder:
    """Byte-level BPE ids of whole texts.

    No pre-token spans the start of a run of white space, nor the space before a non-space, so a text may be cut at its
    spaces unless one stands between two other white-space characters; such a text is encoded whole, and so is one that
    holds a token which the tokenizer adds to its model, such as an end mark: the tokenizer takes those out first.
    """

    ODD = re.compile(r"\s \s")
    #: what the pattern cuts at most in two, behind the letters: Latin letters, then ASCII punctuation
    WORD = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        import json

        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without normaliser or prefix space is expected")
        self.pieces, self.model = regex.compile(PATTERN).findall, self.tokenizer.model
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.letters = self._letters()
        self.space = chr(self.letters[32])
        self.words = _Chunks(self._word, "")
        self.first, self.later = _Chunks(self._chunk, ""), _Chunks(self._chunk, " ")

    @staticmethod
    def _letters() -> dict[int, int]:
        """Byte-level BPE writes printable bytes as themselves and the others, in order, from code point 256 on."""
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in set(printable)]
        return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}

    def _ids(self, spelled: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(spelled)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def _word(self, word: str, before: str = "") -> bytes:
        return self._ids((before + word).encode().decode("latin-1").translate(self.letters))

    def _chunk(self, chunk: str, before: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # one word, spelled as it is
            return self._ids(self.space + chunk if before else chunk)
        if found := self.WORD.fullmatch(chunk):
            word, marks = found.groups()
            if not marks:  # the chunk is what is remembered, not the word beside it
                return self._word(word, before)
            return (self.later if before else self.words)[word] + self.words[marks]
        found = self.pieces(before + chunk)
        if len(found) == 1:
            return self._word(chunk, before)
        # a word after a space is the chunk of that word
        return b"".join([self.later[p[1:]] if len(p) > 1 and p[0] == " " and not p[1].isspace() else self.words[p] for p in found])

    def __call__(self, text: str) -> bytes:
        if any(mark in text for mark in self.marks) or self.ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.words, self.first, self.later
        if sum(map(len, known)) > REMEMBERED:
            self.words, self.first, self.later = (k.renewed() for k in known)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR,
           ids: bool = True) -> DataFrame:
    """The other columns of ``docs`` with piece, start, length, ids_crc32 and, if asked for, the ids of every piece.

    ``_block`` and ``_rank`` number the pieces of one length within a task. A null text counts as empty and is the
    separator alone. Columns of these names are replaced.
    """
    added = ["piece", "start", "length", "ids_crc32", "ids", "_block", "_rank"]
    kept = [c for c in docs.columns if c != text and c not in added]
    ddl = "piece int, start long, length long, ids_crc32 long, _block int, _rank long" + ", ids binary" * ids
    schema = widened(docs.select(*kept), ddl)
    end = np.array([separator], "<u4").tobytes()

    def cut(batches):
        encode, block, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in (part for whole in batches for part in parts_by_size(whole, text, PART_BYTES)):
            row, out = [], [[] for _ in range(6)]
            data = []
            for i, value in enumerate(batch.column(text)):
                whole = encode(value.as_py() or "") + end
                n, at = len(whole) // 4, 0
                size = n if n <= capacity else n % capacity or capacity
                number = 0
                while at < n:
                    part = whole[4 * at:4 * (at + size)]
                    row.append(i)
                    for column, v in zip(out, (number, at, size, zlib.crc32(part), block, seen[size])):
                        column.append(v)
                    if ids:
                        data.append(part)
                    seen[size] += 1
                    at, number, size = at + size, number + 1, capacity
            others = batch.select(kept).take(pa.array(row, pa.int64()))
            columns = [pa.array(v, pa.int32() if k in (0, 4) else pa.int64()) for k, v in enumerate(out)]
            names = [*kept, "piece", "start", "length", "ids_crc32", "_block", "_rank", *["ids"] * ids]
            yield pa.RecordBatch.from_arrays([*others.columns, *columns, *[pa.array(data, pa.binary())] * ids], names)

    return docs.select(*kept, text).mapInArrow(cut, schema)


def _pair(counts: list[int], gap: int) -> tuple[int, ...] | None:
    """Two available lengths that sum to ``gap``, the longest possible first."""
    for a in range(min(gap - 1, len(counts) - 1), (gap - 1) // 2, -1):
        b = gap - a
        if counts[a] and counts[b] and (a != b or counts[a] > 1):
            return a, b
    return None


def _complement(counts: list[int], gap: int, sums: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``; ``sums`` has a bit for every sum of two lengths."""
    if gap < len(counts) and counts[gap]:
        return (gap,)
    if sums >> gap & 1 and (pair := _pair(counts, gap)):
        return pair
    for a in range(gap - 2, (gap - 1) // 3, -1):
        if counts[a] and sums >> (gap - a) & 1:
            counts[a] -= 1
            pair = _pair(counts, gap - a)
            counts[a] += 1
            if pair:
                return a, *pair
    return None


def _pair_sums(counts: list[int]) -> int:
    """A number with bit s set where two available lengths sum to s (a single piece may be paired with itself here)."""
    there, sums = sum(1 << n for n, c in enumerate(counts) if c), 0
    for n, c in enumerate(counts):
        if c:
            sums |= there << n
    return sums


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences): every piece of the histogram is used once."""
    counts = [0] * capacity
    out: list[tuple[tuple[int, ...], int]] = []
    for length, n in histogram.items():
        if length == capacity:
            out.append(((length,), n))
        else:
            counts[length] = n
    sums = _pair_sums(counts)
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1
            found = _complement(counts, capacity - length, sums)
            counts[length] += 1
            if not found:
                break
            uses = Counter((length, *found))
            times = min(counts[n] // k for n, k in uses.items())
            for n, k in uses.items():
                counts[n] -= k * times
                if not counts[n]:
                    sums = None
            out.append(((length, *found), times))
            sums = _pair_sums(counts) if sums is None else sums
    open_at: dict[int, list[list]] = defaultdict(list)  # by gap: [lengths, number of sequences]
    for length in range(capacity - 1, 0, -1):
        left = counts[length]
        while left:
            gap = min((g for g in open_at if g >= length and open_at[g]), default=None)
            if gap is None:
                each = capacity // length
                whole, rest = divmod(left, each)
                for k, n in ((each, whole), (rest, 1 if rest else 0)):
                    if n:
                        open_at[capacity - k * length].append([(length,) * k, n])
                break
            inside, n = open_at[gap].pop()
            fit = gap // length
            times = min(n, left // fit) if left >= fit else 0
            if not times:
                fit, times = left, 1
            if n > times:
                open_at[gap].append([inside, n - times])
            open_at[gap - fit * length].append([inside + (length,) * fit, times])
            left -= fit * times
    return out + [(inside, n) for rows in open_at.values() for inside, n in rows]


def places(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), in order: where the pieces of a length go by rank."""
    used, rows, sequence = Counter(), [], 0
    for lengths, times in chosen:
        for length, offset in zip(lengths, [0, *accumulate(lengths)]):
            rows.append((length, used[length], sequence, offset))
            used[length] += times
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from :func:`pieces`) with sequence_id and offset, gapless in each sequence.

    ``cut`` is staged first, so ranks cannot change under a recomputed task. An empty table gives no rows.
    """
    cut = stage(cut, "pieces")
    per_task = cut.groupBy("length", "_block").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    ranked = cut.join(before, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_block")
    kept = [c for c in cut.columns if c not in ("_block", "_rank", "sequence_id", "offset")]
    schema = widened(cut.select(*kept), "sequence_id long, offset long")
    wide = 1 << 40

    def put(batches):
        first = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(first, batch.column("length").to_numpy() * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(table[at, 2] + rank - table[at, 1]),
                                              pa.array(table[at, 3])], schema.names)

    return ranked.select(*kept, "_rank").mapInArrow(put, schema)


@query("op10_packing")
def op10_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 ids of the public 50k byte-level BPE."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
