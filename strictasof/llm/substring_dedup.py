"""Substring dedup by repeated-phrase automata.

Passages of at least ``length`` words that recur in the corpus are confirmed word by word and compiled, shard by shard,
into Aho-Corasick automata over word numbers; the documents' stretches of the shard stream through its automaton, which
tells every place where a confirmed passage occurs. All documents take part: each is cut at its anchors, and a stretch
meets the shard of its anchor unless that anchor occurs once in the corpus, in which case nothing in it can recur.
"""

from __future__ import annotations


import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, parts_by_size, unbundle, widened
from .recur import PART_BYTES, WORDS, covered, recurring, runs_of, window_hashes
from .registry import query

LENGTH, GRAM = 35, 12
#: bytes of segments compiled into one automaton
SHARD_BYTES = 1 << 20


def confirmed(numbers: np.ndarray, starts: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """For each window of word numbers, whether its sequence was seen twice or more; compared word by word."""
    hashes = window_hashes(mix(numbers.astype(np.uint64) + np.uint64(1)), length)[starts]
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    window = np.arange(length)
    for at in range(0, len(starts), 50_000):
        mine = starts[at:at + 50_000]
        alike = numbers[mine[:, None] + window] == numbers[starts[first[group[at:at + 50_000]]][:, None] + window]
        if not alike.all():  # two sequences with one hash: group by the words themselves
            _, group = np.unique(numbers[starts[:, None] + window], axis=0, return_inverse=True)
            break
    return np.bincount(group, weights=weights)[group] > 1


def automaton_judge(length: int):
    """A judge for :func:`recur.recurring`."""

    def judge(segments: list[bytes], windows: np.ndarray, seen: np.ndarray) -> list[list[tuple[int, int]]]:
        known: dict[bytes, int] = {}
        texts = [tuple([known.setdefault(w, len(known)) for w in s.split(b" ")]) for s in segments]
        sizes = np.array([len(t) for t in texts], np.int64)
        numbers = np.fromiter((w for t in texts for w in t), np.int64, int(sizes.sum()))
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        again = confirmed(numbers, np.repeat(begin, windows) + inside, np.repeat(seen, windows), length)
        ends = np.cumsum(windows)
        phrases = {t[a:b + length - 1] for t, e, n in zip(texts, ends.tolist(), windows.tolist())
                   for a, b in runs_of(again[e - n:e])}
        if not phrases:
            return [[] for _ in texts]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases:
            automaton.add_word(phrase, len(phrase))
        automaton.make_automaton()
        out = []
        for text in texts:
            places = [{"a": end + 1 - n, "b": end + 1} for end, n in automaton.iter(text)]
            out.append(covered(places, False, len(text), length))
        return out

    return judge


def removed_passages(docs: DataFrame, length: int = LENGTH, text: str = "text", gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                     keep_text: bool = False, **settings) -> DataFrame:
    """``docs`` with the text's words outside every recurring passage joined by one space, and what was taken out.

    Added: n_words, n_removed, spans (start and stop, in words, of each removed run) and ``kept_text``, columns of these
    names being replaced; the text itself stays only if asked for. A text without words, empty or null, keeps the empty
    string.
    """
    added = [*("n_words", "n_removed", "spans", "kept_text")]
    others = [c for c in docs.columns if c not in (text, *added)]
    rows = recurring(docs.select(*[f"`{c}`" for c in others], text), WORDS, length, gram, automaton_judge(length), shard_bytes, text, **settings)
    schema = widened(rows.select("others", *["text"] * keep_text), "n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept_text string")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def cut(batches):
        for batch in (part for whole in batches for part in parts_by_size(whole, "text", PART_BYTES)):
            n, gone, runs, kept = [], [], [], []
            for value, whole, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "spans"))):
                words = value.encode().split()
                out = covered(spans, bool(whole), len(words), length)
                n.append(len(words))
                gone.append(sum(b - a for a, b in out))
                runs.append([{"start": a, "stop": b} for a, b in out])
                for a, b in reversed(out):
                    del words[a:b]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-4]] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(runs, spans_type), pa.array(kept, pa.string())], schema.names)

    return rows.mapInArrow(cut, schema).select(*unbundle(others, "others"), *[F.col("text").alias(text)] * keep_text, *added)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT rid, s, array_to_string(w[s:s + 34], ' ') AS t
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY t) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i FROM (SELECT rid, unnest(generate_series(s, s + 34)) AS i FROM again)),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid),
counted AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN counted USING (rid)
"""


@query("op2_substring_dedup", ORACLE)
def op2_substring_dedup(spark, sf_dir):
    """Every document without the words of its windows of 35 that occur anywhere else."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


