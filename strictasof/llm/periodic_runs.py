"""Periodic runs: maximal stretches of words that repeat with a smallest period.

Per document, without any exchange:

1. Stretches. A run of period q repeats every ``gram`` consecutive words of it q words further on, so a stretch whose
   ``gram``-word strings occur once in their stretch holds no run. What is left after this sieve is usually a small part
   of the text; it is a superset (strings are compared by hash, which can only keep too much).
2. Lyndon arrays. The first phase of Baier's suffix sorter groups suffixes by their context; when a group is taken out,
   highest first, its context is the longest Lyndon word at each of its positions. Once with the order of the words,
   once with the reverse order: no suffix array is made.
3. Runs. Every run holds its Lyndon root in one of the two orders. Roots are extended to both sides by comparing words
   (longest common extensions); a root inside a run already found with its period is passed over.

A document is the largest thing a task holds.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bundle, mix, parts_by_size, unbundle, widened
from .registry import query

#: bytes of text handled at a time; a longer text is handled alone
PART_BYTES = 4 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon_lengths(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each position, in the order of the codes.

    A negative code ends a string: several strings are handled in one call, and none looks beyond its end.
    """
    n = len(codes)
    found = np.zeros(n, np.int64)
    inside = np.flatnonzero(codes >= 0)
    if not len(inside):
        return found
    by_code = inside[np.argsort(codes[inside], kind="stable")]
    cuts = np.flatnonzero(np.diff(codes[by_code])) + 1
    # groups are numbered; below and above link them in their order; positions count from 1, 0 is never taken out
    members = [part.tolist() for part in np.split(by_code + 1, cuts)]
    context = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    above[-1] = -1
    group = np.full(n + 1, -1)
    group[by_code + 1] = np.repeat(np.arange(len(members)), [len(m) for m in members])
    group = group.tolist()
    near = list(range(n + 1))  # the nearest position to the left, or the position itself, in a group not taken out yet
    current = len(members) - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = ()
        size = context[current]
        for i in own:
            near[i] = i - 1
            found[i - 1] = size
        followed: dict[int, int] = {}
        for i in own:
            j = near[i]
            while near[j] != j:  # path halving
                near[j] = j = near[near[j]]
            near[i] = j
            if group[j] >= 0:
                followed[j] = followed.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in followed.items():
            moved.setdefault((group[j], times), []).append(j)
        last: dict[int, int] = {}
        for old, times in sorted(moved):  # those followed more often lie higher, all above those that stay
            under, new = last.get(old, old), len(members)
            over = above[under]
            members.append(moved[old, times])
            context.append(context[old] + times * size)
            below.append(under)
            above.append(over)
            above[under] = new
            if over >= 0:
                below[over] = new
            for j in moved[old, times]:
                group[j] = new
            last[old] = new
        current = below[current]
    return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of two arrays agree."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        stop = min(n, at + step)
        differ = a[at:stop] != b[at:stop]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = stop, 2 * step
    return n


def _gram(least: int, exponent: int) -> int:
    """The longest string that every run repeats one period further on, whatever its period."""
    return max(1, min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2)))


def _stretches(codes: np.ndarray, string: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Positions that may lie in a run; ``string`` numbers the document of each position, in order."""
    gram = _gram(least, exponent)
    at = np.arange(len(codes))
    while len(at) >= gram:
        size = len(at)
        units = mix(codes[at].astype(np.uint64) + np.uint64(1))
        h = mix(string[at].astype(np.uint64) + np.uint64(1 << 40))[:size - gram + 1].copy()
        for k in range(gram):
            h = mix(h + units[k:size - gram + 1 + k])
        # a string must lie in consecutive words of one document
        whole = (at[gram - 1:] - at[:size - gram + 1] == gram - 1) & (string[at[gram - 1:]] == string[at[:size - gram + 1]])
        starts = np.flatnonzero(whole)
        order = starts[np.argsort(h[starts], kind="stable")]
        twice = h[order][1:] == h[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= twice
        again[:-1] |= twice
        edges = np.zeros(size + 1, np.int64)
        np.add.at(edges, order[again], 1)
        np.add.at(edges, order[again] + gram, -1)
        kept = np.cumsum(edges[:-1]) > 0
        # neighbours of a document's end or a gap part stretches; short ones hold no run
        part = np.cumsum(np.concatenate([[True], ~kept[1:] | ~kept[:-1] | (np.diff(at) != 1) | (np.diff(string[at]) != 0)]))
        long_enough = np.bincount(part[kept], minlength=part[-1] + 1) >= least
        at = at[kept & long_enough[part]]
        if len(at) > 0.9 * size:
            break
        # later rounds ask for a second sight inside the stretch
        string = string.copy()
        string[at] = part[kept & long_enough[part]]
    return at if len(at) >= least else at[:0]


def periodic_runs(codes: np.ndarray, offsets: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the strings codes[offsets[i]:offsets[i + 1]], by start, then period.

    A run is a stretch with smallest period q, at least ``least`` and ``exponent`` (2 or more) times q long, that no
    neighbour extends. Codes are equal for equal words; their order does not matter.
    """
    string = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = _stretches(codes, string, least, exponent)
    if not len(at):
        return []
    gaps = np.flatnonzero((np.diff(at) != 1) | (np.diff(string[at]) != 0)) + 1
    # a separator of its own after each stretch; separators differ from everything, so no extension crosses them
    places = np.arange(len(at)) + np.searchsorted(gaps, np.arange(len(at)), "right")
    units = np.full(places[-1] + 2, -1, np.int64)
    units[places] = codes[at]
    origin = np.full(len(units), -1, np.int64)
    origin[places] = at
    compared = units.copy()
    ends = np.flatnonzero(units < 0)
    compared[ends] = -1 - np.arange(len(ends))
    n = len(units)
    roots = []
    for ordered in (units, np.where(units < 0, units, units.max() - units)):
        period = lyndon_lengths(ordered)
        i = np.flatnonzero((period > 0) & (np.arange(n) + period < n))
        following = i + period[i]
        if exponent >= 3:  # a run this long holds two whole roots, one after the other
            i = i[period[following] == period[i]]
        else:
            i = i[(compared[i] == compared[following]) | (compared[i - 1] == compared[following - 1]) & (i > 0)]
        roots.append(np.stack([i, period[i]]))
    i, period = np.unique(np.concatenate(roots, 1), axis=1)
    runs, latest = [], {}
    for start, q in zip(i.tolist(), period.tolist()):
        if start + q <= latest.get(q, -1):
            continue
        stop = start + q + _common(compared[start:], compared[start + q:])
        begin = start - _common(compared[:start][::-1], compared[:start + q][::-1])
        latest[q] = stop
        if stop - begin >= max(least, exponent * q):
            runs.append((int(origin[begin]), stop - begin, q))
    return sorted(set(runs))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts and the offsets of each text's words; null has none."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = lists.flatten()
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]


def with_periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """The other columns of ``docs``, ``n_words``, ``runs`` (start, length, period by start, then period), ``collapsed``.

    ``collapsed`` keeps of every run its first period: words that lie in a run after its first ``period`` words are
    left out, the others joined by one space. Null and empty texts have no words, no runs and an empty ``collapsed``;
    repeated rows are answered one by one; an empty table gives no rows. Columns named like the results are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]

    def work(batches):
        for batch in batches:
            for part in parts_by_size(batch, "_text", PART_BYTES):
                words, offsets = split_words(part.column("_text"))
                codes = np.asarray(words.dictionary_encode().indices).astype(np.int64)
                runs = periodic_runs(codes, offsets, least, exponent)
                lists: list[list[dict]] = [[] for _ in range(part.num_rows)]
                edges = np.zeros(len(codes) + 1, np.int64)
                for start, length, q in runs:
                    document = int(np.searchsorted(offsets, start, "right")) - 1
                    lists[document].append({"start": start - int(offsets[document]), "length": length, "period": q})
                    edges[start + q] += 1
                    edges[start + length] -= 1
                stays = np.cumsum(edges[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(stays)])[offsets]
                texts = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(stays)))
                spans = pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_rest"), pa.array(np.diff(offsets)), spans, pc.binary_join(texts, " ").cast(pa.string())],
                    ["_rest", "n_words", "runs", "collapsed"])

    rows = docs.select(bundle(docs, kept), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = widened(rows.select("_rest"), f"n_words long, runs {RUNS}, collapsed string")
    return rows.mapInArrow(work, schema).select(*unbundle(kept), "n_words", "runs", "collapsed")


def repeated_tail(doc_id: int | None, words: list) -> list:
    """The contract's text: one document in ten goes on, from a word of it, with a stretch of its own words."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _with_tails(docs: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            for part in parts_by_size(batch, "text", PART_BYTES):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text")
                touched = {i: d for i, d in enumerate(ids) if d is not None and zlib.crc32(str(d).encode()) % 10 == 0}
                changed = [None] * len(ids)
                for i, doc_id in touched.items():
                    changed[i] = b" ".join(repeated_tail(doc_id, (texts[i].as_py() or "").encode().split())).decode()
                mask = np.zeros(len(ids), bool)
                mask[list(touched)] = True
                text = pc.if_else(pa.array(mask), pa.array(changed, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, text string")


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Runs of four periods or more, at least six words, in all documents; the longest (then first, then of smallest
    period) is shown. A null id leaves the text as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = with_periodic_runs(_with_tails(docs))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    shown = found.withColumn("top", F.when(F.size("runs") > 0, longest))
    length = -F.col("top.shorter")
    return shown.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"),
        F.col("top.period").alias("period"), F.floor(1000 * length / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
