"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A benchmark item is cut into windows of ten words (an item of fewer is one window). A document holds a window only if it
holds all of its five-word shingles; ordered by rarity, the prefix that an exact containment must share is the rarest
shingle alone. So each window waits under its rarest shingle, documents meet it there, the shingle's place in the window
fixes where the window would start, the length must fit into the document, and only then the words are compared.

Rarity is counted over all documents, so a shingle that is frequent in the corpus is never the meeting point where the
window has a rarer one. The windows are broadcast only while their counted size is small; beyond it they are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lower_ascii, stage
from .registry import query

WINDOW, SHINGLE = 10, 5
#: bytes of windows up to which they are sent to every task
BROADCAST_BYTES = 32 << 20
#: what separates words, after lower-casing and before it
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text; none for null."""
    text = F.coalesce(text, F.lit(""))
    # in plain ASCII, ``lower`` changes A-Z only, and it need not look up each character
    lowered = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(lowered, GAPS), "")


def word_count(text: Column) -> Column:
    """How many words :func:`words_of` gives."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), RAW_GAPS), ""))


def text_key(text: Column) -> Column:
    """Equal for equal texts only; null stays null."""
    return F.sha2(text, 256)


def benchmark_windows(items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW,
                      shingle: int = SHINGLE) -> DataFrame:
    """(window_words, length, item_ids, shingles): one row per different window, its items as strings.

    Items without words give none; an item without an id counts as the empty string.
    """
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = rows.select("item", "w", F.explode(starts).alias("at")).select(
        "item", F.slice("w", F.col("at") + 1, window).alias("window_words"))
    distinct = cut.groupBy("window_words").agg(F.collect_set("item").alias("item_ids"))
    length = F.size("window_words")
    size = F.least(length, F.lit(shingle))
    shingles = F.transform(F.sequence(F.lit(0), length - size), lambda i: F.struct(
        i.alias("offset"), size.alias("size"), _hash(F.slice("window_words", i + 1, size)).alias("h")))
    return distinct.withColumns({"length": length, "shingles": shingles})


def _hash(words: Column) -> Column:
    return F.xxhash64(words)


def _document_shingles(docs: DataFrame, size: int) -> DataFrame:
    """(key, w, at, h): every shingle of ``size`` words of every text, with the words still at hand.

    Too short texts give an empty list of places: a filter on their words would be moved below and split each text anew.
    """
    places = F.array_repeat(F.lit(0).cast("byte"), F.size("w") - (size - 1))
    return docs.select("key", "w", F.posexplode(places).alias("at", "_zero")).drop("_zero").withColumn(
        "h", F.xxhash64(*[F.col("w")[F.col("at") + j] for j in range(size)]))


def find_windows(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW,
                 shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, start, length, item_ids): every occurrence of a benchmark window, once per different text (``text_key``)."""
    windows = stage(benchmark_windows(items, text, item_id, window, shingle).withColumn("window", F.xxhash64("window_words")), "windows")
    size = windows.agg(F.sum(F.size("window_words") * 16 + F.size("item_ids") * 16 + 64).alias("b")).first().b or 0
    near = F.broadcast if size <= broadcast_bytes else lambda df: df
    tokens = windows.select("window_words", "length", "item_ids", F.explode("shingles").alias("s")).select(
        "window_words", "length", "item_ids", "s.*")
    sizes = [r.size for r in tokens.select("size").distinct().collect()]  # at most ``shingle`` numbers
    words = docs.select(text_key(F.col(text)).alias("key"), words_of(F.col(text)).alias("w"))
    found = None
    for n in sorted(sizes):
        mine = tokens.where(F.col("size") == n)
        shared = _document_shingles(words, n).join(near(mine.select("h").distinct()), "h")
        counts = shared.groupBy("h").agg(F.count("*").alias("n"))
        rarest = Window.partitionBy("window_words").orderBy(F.coalesce("n", F.lit(0)), "h", "offset")
        prefix = stage(mine.join(counts, "h", "left").withColumn("r", F.row_number().over(rarest)).where(
            "r = 1 and n is not null").select("h", "offset", "length", "window_words", "item_ids"), "prefix")
        start = F.col("at") - F.col("offset")
        hits = _document_shingles(words, n).join(near(prefix), "h").where(
            (start >= 0) & (start + F.col("length") <= F.size("w"))
            & (F.slice("w", start + 1, F.col("length")) == F.col("window_words"))
        ).select("key", start.alias("start"), "length", "item_ids")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "key string, start int, length int, item_ids array<string>")
    return found.distinct()


def _union_length(spans: Column) -> Column:
    """Words covered by a sorted array of (start, stop)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    grow = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("n"),
        F.greatest(a["reach"], s["stop"]).alias("reach"))
    return F.aggregate(spans, zero, grow, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", **settings) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence), items (sorted ids) and contaminated (n_hit > 0).

    Null and empty texts have no words. Repeated rows each get their own result. Columns of these names are replaced.
    """
    added = ("n_words", "n_hit", "items", "contaminated", "_key")
    kept = [c for c in docs.columns if c not in added]
    hits = find_windows(docs, items, text, item_id, **settings)
    by_text = hits.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"))
    # stored, so that the rows of a text with very many copies can be split in the join
    by_text = stage(by_text.select(F.col("key").alias("_key"), _union_length(F.col("spans")).alias("n_hit"), "items"), "hits")
    rows = docs.select(*kept, text_key(F.col(text)).alias("_key"), word_count(F.col(text)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(by_text, "_key", "left").select(
        *kept, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT rid, s, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY rid),
ids AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN ids USING (rid)
"""


@query("op7_decontaminate", ORACLE)
def op7_decontaminate(spark, sf_dir):
    """Every document against every benchmark window of ten words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
