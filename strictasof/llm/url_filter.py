"""URL filters by a cascade of Bloom filters.

Level 1 holds the listed keys. The other keys of the corpus that pass it by accident go into level 2, the listed keys that
pass level 2 into level 3, and so on until a level lets nothing of the other side pass. Over the keys it was built for,
which are all keys of the corpus, the cascade then answers exactly, and judging a row needs no join: its levels reach the
scan as scalar values.

The levels together take about listed * (log2(others / listed) + 7) bits. Their exact size is known before they are sent;
beyond ``most_bytes`` the keys are divided by a hash and each part gets a cascade and a pass of its own, so what a task
holds stays bounded and no key is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .registry import query

#: bits of all levels that one pass may send to a task
MOST_BYTES = 64 << 20
#: share of the other side that passes a level from the second on
LATER_RATE = 0.05
#: 64-bit words in one stored segment of a level
SEGMENT = 4096

#: rules of the query: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
#: a host with one of these words in it puts all of its urls on the list
HOST_WORDS = ("adult", "casino", "spam")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` wide, ``hashes`` positions per key, stored as one row of segments."""

    number: int
    bits: int
    hashes: int
    table: DataFrame

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.number), F.lit(j), key), F.lit(self.bits)) for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = self.table.scalar()
        found = None
        for at in self.positions(key):
            word = F.floor(at / 64).cast("long")
            segment = words[F.floor(word / SEGMENT).cast("int")]
            value = segment[F.pmod(word, F.lit(SEGMENT)).cast("int")]
            hit = F.call_function("shiftright", value, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
            found = hit if found is None else found & hit
        return found


def _encode(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A level with the ``n`` rows of ``keys`` (column key), sized for ``rate`` false positives."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)
    spec = Level(number, bits, hashes, keys)
    words = -(-bits // 64)
    whole = -(-words // SEGMENT) * SEGMENT
    ones = keys.select(F.explode(F.array(*spec.positions(F.col("key")))).alias("at")).select(
        F.floor(F.col("at") / 64).cast("long").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")).alias("value"))
    zeros = keys.sparkSession.range(whole).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("value"))
    filled = ones.union(zeros).groupBy("word").agg(F.bit_or("value").alias("value"))
    segments = filled.groupBy(F.floor(F.col("word") / SEGMENT).cast("long").alias("segment")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("values"))
    row = segments.agg(F.transform(F.sort_array(F.collect_list(F.struct("segment", "values"))), lambda x: x["values"]).alias("words"))
    return Level(number, bits, hashes, stage(row, "cascade-level"))


def build_cascade(universe: DataFrame) -> list[Level]:
    """Levels for ``universe``: one row per distinct ``key`` (not null) and ``listed`` (boolean)."""
    sides = stage(universe.groupBy("key").agg(F.max("listed").alias("listed")), "cascade-keys")
    counted = {r.listed: r.n for r in sides.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, others = counted.get(True, 0), counted.get(False, 0)
    inside, outside = sides.where("listed").select("key"), sides.where("not listed").select("key")
    levels: list[Level] = []
    rate = min(0.5, max(1e-6, listed / max(1, others)))
    n = listed
    while n:
        level = _encode(inside, n, len(levels) + 1, rate)
        levels.append(level)
        wrong = stage(outside.where(level.passes(F.col("key"))), "cascade-wrong")
        n = wrong.count()
        inside, outside, rate = wrong, inside, LATER_RATE
    return levels


def listed(levels: list[Level], key: Column) -> Column:
    """Whether ``key``, a key of the universe, is listed: the first level it fails tells its side."""
    if not levels:
        return F.lit(False)
    answer = F
    for level in levels:
        answer = answer.when(~level.passes(key), F.lit(level.number % 2 == 0))
    return answer.otherwise(F.lit(len(levels) % 2 == 1))


def with_listed(rows: DataFrame, universe: DataFrame, key: str, into: str = "listed", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with the boolean ``into``: whether their ``key`` is among the listed keys of ``universe`` (key, listed).

    Every key of ``rows`` must be in the universe; a null key is not listed. An empty list or table gives False.
    """
    sizes = universe.groupBy("key").agg(F.max("listed").alias("listed")).agg(
        F.count_if("listed").alias("listed"), F.count("*").alias("n")).first()
    need = sizes.listed * (max(0.0, math.log2(max(1, sizes.n) / max(1, sizes.listed))) + 7) * 1.45 / 8
    passes = max(1, math.ceil(need / most_bytes))
    part = lambda column: F.pmod(F.xxhash64(F.lit("pass"), column), F.lit(passes))
    out = []
    for p in range(passes):
        keys = universe.where("key is not null")
        levels = build_cascade(keys if passes == 1 else keys.where(part(F.col("key")) == p))
        mine = rows if passes == 1 else rows.where(F.coalesce(part(F.col(key)), F.lit(0)) == p)
        out.append(mine.withColumn(into, F.when(F.col(key).isNull(), F.lit(False)).otherwise(listed(levels, F.col(key)))))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (struct verdict, rule), else null. A rule fits its host and all subdomains."""
    chosen = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def judge_urls(pages: DataFrame, rules=RULES, host_words=HOST_WORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict: a fitting rule's verdict, else block exactly for listed urls.

    Listed is every url key (host and path) whose host contains a listed word. Columns of these names are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_key", "_rule", "_listed")]
    rows = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    key = F.concat("host", "path")
    bad = F.lit(False)
    for word in host_words:
        bad = bad | F.col("host").contains(word)
    universe = rows.select(key.alias("key"), bad.alias("listed"))
    rows = with_listed(rows.withColumn("_key", key), universe, "_key", "_listed", most_bytes)
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    by_list = F.when(F.col("_listed"), "block").otherwise("allow")
    return rows.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"),
                       F.coalesce(F.col("_rule.verdict"), by_list).alias("verdict"))


ORACLE = """
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN contains(host, 'adult') OR contains(host, 'casino') OR contains(host, 'spam') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""


@query("op1_url_filter", ORACLE)
def op1_url_filter(spark, sf_dir):
    """Every url of ``pages`` judged by the five rules, else by the list of urls on hosts with a listed word."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")
