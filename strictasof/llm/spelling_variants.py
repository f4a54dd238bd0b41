"""Spelling variants: words one edit apart, found by search schemes on a bidirectional FM-index.

1. Vocabulary. Tasks count their words, counts are added up; only words with enough occurrences stay.
2. Shards. The vocabulary is sorted (once by word, once by reversed word) and cut into shards of bounded size. A word one
   edit away keeps the word's first half or its second half as it is. So the words that keep the first half lie in the
   shards whose range meets it, and the search for them goes there only; the search for those that keep the second half
   goes to the shards sorted from the end. Shards that many words ask are asked in several parts.
3. Search. A shard's words, each between delimiters, are indexed in both directions. All words asked are searched at once:
   the kept half is matched exactly up to its delimiter, then the interval is extended across the other half, allowing one
   insertion, deletion or replacement, up to the other delimiter. What is left of the interval are the words found.
4. Forms. A word's form is its most frequent near word if that is frequent enough; roots follow the forms, each round
   twice as far.

No step lists the words of a bucket against each other; a task holds one shard and one part of those who ask.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_by_size, release, shuffle_partitions, stage
from .registry import query

#: symbols (letters and delimiters) of one shard; words that one part of a shard's searches asks for
SHARD_SYMBOLS, ASKED = 200_000, 50_000
#: code points of a shard's first word that routing looks at
BOUNDARY = 64
#: positions between the counts that an index stores, for alphabets of up to four times as many letters
STEP = 32
#: letters times words that are searched at once
AT_ONCE = 1 << 19
PART_BYTES = 4 << 20
#: different words a task counts before it passes them on
HELD_WORDS = 1 << 18
LAST = "\U0010ffff"


# ---- the index ------------------------------------------------------------------------------------------------------

def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; a suffix that ends is before those that go on."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    length = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:max(0, n - length)] = rank[length:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        length *= 2


class _Side:
    """One direction: the Burrows-Wheeler transform of a text and counts of symbols below each position."""

    def __init__(self, symbols: np.ndarray, letters: int):
        self.order = suffix_array(symbols)
        bwt = symbols[self.order - 1]  # before the first suffix stands the last symbol: the text is read as a circle
        self.letters, self.step = letters, max(STEP, letters // 4)
        blocks = len(bwt) // self.step + 1
        self.bwt = np.full(blocks * self.step, letters, np.uint8 if letters < 256 else np.int32)
        self.bwt[:len(bwt)] = bwt
        self.bwt = self.bwt.reshape(blocks, self.step)
        flat = np.arange(blocks)[:, None] * (letters + 1) + self.bwt
        per_block = np.bincount(flat.ravel(), minlength=blocks * (letters + 1)).reshape(blocks, letters + 1)[:, :letters]
        self.counts = np.cumsum(per_block, axis=0, dtype=np.int32) - per_block.astype(np.int32)
        self.smaller = np.cumsum(self.counts, axis=1, dtype=np.int32) - self.counts
        self.first = np.cumsum(np.bincount(symbols, minlength=letters)) - np.bincount(symbols, minlength=letters)

    def _part(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each position and the block's symbols below it; the others read as a letter that does not exist."""
        block = at // self.step
        return block, np.where(np.arange(self.step) < (at % self.step)[:, None], self.bwt[block], self.letters)

    def below(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the transform's first ``at`` symbols: how many are ``symbol``, how many are smaller."""
        block, part = self._part(at)
        same = self.counts[block, symbol] + (part == symbol[:, None]).sum(1)
        return same, self.smaller[block, symbol] + (part < symbol[:, None]).sum(1)

    def all_below(self, at: np.ndarray) -> np.ndarray:
        """Of the transform's first ``at`` symbols: how many there are of each letter."""
        block, part = self._part(at)
        flat = (np.arange(len(at))[:, None] * (self.letters + 1) + part).ravel()
        inside = np.bincount(flat, minlength=len(at) * (self.letters + 1)).reshape(len(at), self.letters + 1)
        return self.counts[block] + inside[:, :self.letters]


class WordIndex:
    """A bidirectional FM-index over distinct words, none empty: delimiter (symbol 0), word, delimiter, word, ..., delimiter.

    A state is three arrays: interval start among the suffixes, interval start among the reversed prefixes, size.
    Extending a state to either side keeps both intervals in step.
    """

    def __init__(self, words: list[str]):
        points = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), "<u4")
        self.alphabet, symbols = np.unique(points, return_inverse=True)
        self.size, self.words = len(symbols), len(words)
        self.forward = _Side(symbols, len(self.alphabet))
        self.backward = _Side(symbols[::-1], len(self.alphabet))
        self.word_at = np.cumsum(symbols == 0) - 1  # of the delimiter before a word: the word's number

    def symbols(self, word: str) -> np.ndarray:
        """The word's symbols; a letter that the index does not hold is -1."""
        points = np.frombuffer(word.encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1)

    def extend(self, state, symbol: np.ndarray, right: bool):
        """States after one more symbol on a side; size 0 where the text has none."""
        mine, other, size = (state[1], state[0], state[2]) if right else state
        side, letter = self.backward if right else self.forward, np.maximum(symbol, 0)
        (same, small), (same_end, small_end) = side.below(letter, mine), side.below(letter, mine + size)
        mine, other = side.first[letter] + same, other + small_end - small
        size = np.where(symbol < 0, 0, same_end - same)
        return (other, mine, size) if right else (mine, other, size)

    def branch(self, state, right: bool):
        """(parent, letter, state) for every letter that the text has on that side of a state."""
        mine, other, size = (state[1], state[0], state[2]) if right else state
        side = self.backward if right else self.forward
        low = side.all_below(mine)
        found = side.all_below(mine + size) - low
        smaller = np.cumsum(found, axis=1) - found
        parent, letter = np.nonzero(found[:, 1:])
        letter += 1
        mine, other, size = side.first[letter] + low[parent, letter], other[parent] + smaller[parent, letter], found[parent, letter]
        return parent, letter, ((other, mine, size) if right else (mine, other, size))

    def near(self, asked: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked word, number of the indexed word) one edit apart, the edit being in one half.

        ``first_half``: the first half of an asked word (of n letters, the first n // 2) stays as it is, else the rest
        does. Each pair is found once: an edit that could be said in several places is said in one.
        """
        order = sorted(range(len(asked)), key=lambda i: len(asked[i]))
        parts, at = [], 0
        while at < len(order):
            n = max(1, AT_ONCE // (len(asked[order[min(len(order), at + 4096) - 1]]) + len(self.alphabet)))
            chunk = np.array(order[at:at + min(n, 4096)])
            ask, found = self._near([asked[i] for i in chunk], first_half)
            parts.append((chunk[ask], found))
            at += len(chunk)
        return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2

    def _near(self, asked: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        right = first_half  # the side on which the other half lies
        lengths = np.array([len(w) for w in asked], np.int64)
        kept = lengths // 2 if first_half else lengths - lengths // 2
        # letters are read outwards from the cut: the kept half first, then the other half; -2 after both
        letters = np.full((len(asked), int(lengths.max()) + 2), -2, np.int64)
        for i, w in enumerate(asked):
            halves = np.split(self.symbols(w), [len(w) // 2])
            halves[0] = halves[0][::-1]
            letters[i, :len(w)] = np.concatenate(halves if first_half else halves[::-1])
        ask, state = np.arange(len(asked)), (np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.full(len(asked), self.size))
        for step in range(int(kept.max()) + 1):  # the kept half and its delimiter
            symbol = np.where(step < kept[ask], letters[ask, step], 0)
            after = self.extend(state, symbol, not right)
            state = tuple(np.where(step <= kept[ask], new, old) for new, old in zip(after, state))
            alive = state[2] > 0
            ask, state = ask[alive], tuple(c[alive] for c in state)
        place = kept[ask]
        none = np.zeros(0, np.int64)
        wrong, wrong_place, wrong_state = none, none, (none, none, none)  # states after their one edit
        found: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
        while len(ask) or len(wrong):
            at_end = wrong_place == lengths[wrong]
            after = self.extend(wrong_state, np.where(at_end, 0, letters[wrong, wrong_place]), right)
            hit, on = at_end & (after[2] > 0), ~at_end & (after[2] > 0)
            word = self.word_at[self.forward.order[after[0][hit]]]  # words differ, so the interval holds one
            held = word < self.words  # the last delimiter and, read as a circle, the first hold no word
            found.append((wrong[hit][held], word[held]))
            parent, letter, branched = self.branch(state, right)
            here, following = letters[ask, place], letters[ask, np.minimum(place + 1, lengths[ask])]
            inside = place < lengths[ask]
            deleted = inside & (here != following)  # of equal letters the last one is deleted
            other = letter != here[parent]  # and what is inserted comes after them
            replaced = other & inside[parent]
            wrong = np.concatenate([wrong[on], ask[deleted], ask[parent[other]], ask[parent[replaced]]])
            wrong_place = np.concatenate([wrong_place[on] + 1, place[deleted] + 1, place[parent[other]], place[parent[replaced]] + 1])
            wrong_state = tuple(np.concatenate([a[on], s[deleted], b[other], b[replaced]])
                                for a, s, b in zip(after, state, branched))
            same = ~other & inside[parent]
            ask, place, state = ask[parent[same]], place[parent[same]] + 1, tuple(c[same] for c in branched)
        return tuple(np.concatenate(c) for c in zip(*found))


# ---- vocabulary -----------------------------------------------------------------------------------------------------

#: a document's id and a lower-cased word -> the word to count
Change = Callable[[object, str], str]


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", pattern: str = r"[A-Za-z\u00C0-\u00FF]+", letters: int = 7,
               least: int = 2, change: Change | None = None) -> DataFrame:
    """(word, n): words of all texts, A-Z lower-cased, with ``letters`` code points and ``least`` occurrences or more.

    ``pattern`` finds the words; ``change`` may replace a word, given the value of ``key``. Null and empty texts and an
    empty table give no words; repeated rows count as often as they are there.
    """
    found = re.compile(pattern)

    def count(batches):
        words: Counter[str] = Counter()
        for batch in batches:
            for part in parts_by_size(batch, "text", PART_BYTES):
                for doc, content in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    if content:
                        # bytes.lower() touches A-Z only
                        for w, n in Counter(found.findall(content.encode().lower().decode())).items():
                            w = w if change is None else change(doc, w)
                            if len(w) >= letters:
                                words[w] += n
                if len(words) > HELD_WORDS:
                    yield batch_of(words)
                    words.clear()
        yield batch_of(words)

    def batch_of(words):
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


# ---- sharded search -------------------------------------------------------------------------------------------------

def _sharded(words: DataFrame, symbols: int) -> tuple[DataFrame, list[tuple[int, int, str]]]:
    """``words`` (key, word, n) sorted by key and cut into shards (range, cut), and each shard's start, in order."""

    def cut(batches):
        shard, size = 0, 0
        for batch in batches:
            lengths = pa.compute.utf8_length(batch.column("key")).to_numpy(zero_copy_only=False) + 1
            shards = np.empty(len(lengths), np.int32)
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > symbols:
                    shard, size = shard + 1, 0
                size += n
                shards[i] = shard
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards)], [*batch.schema.names, "cut"])

    ranged = words.repartitionByRange(shuffle_partitions(words.sparkSession), "key").sortWithinPartitions("key")
    ranged = ranged.withColumn("range", F.spark_partition_id())
    shards = stage(ranged.mapInArrow(cut, "key string, word string, n long, range int, cut int"), "shards")
    starts = shards.groupBy("range", "cut").agg(F.min(F.substring("key", 1, BOUNDARY)).alias("start")).collect()  # a row per shard
    return shards, sorted((r.range, r.cut, r.start) for r in starts)


def _found(words: DataFrame, first_half: bool, symbols: int, asked: int) -> DataFrame:
    """(word, near, near_n): words one edit apart whose first half (else whose second half) is the word's own."""
    keyed = words.select((F.col("word") if first_half else F.reverse("word")).alias("key"), "word", "n")
    shards, starts = _sharded(keyed, symbols)
    bounds = [start for _, _, start in starts]

    def route(batches):
        for batch in batches:
            out, at = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                half = key[:len(key) // 2 if first_half else len(key) - len(key) // 2][:BOUNDARY]
                first, last = bisect_left(bounds, half, 1) - 1, bisect_right(bounds, half + LAST) - 1
                out.extend(range(first, last + 1))
                at.extend([i] * (last - first + 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), batch.column("word").take(pa.array(at, pa.int32()))], ["shard", "word"])

    asks = stage(shards.select("key", "word").mapInArrow(route, "shard int, word string"), "asks")
    parts = {r["shard"]: -(-r["count"] // asked) for r in asks.groupBy("shard").count().collect()}  # a row per shard
    plan = [(r, c, i, parts.get(i, 1)) for i, (r, c, _) in enumerate(starts)]
    plan = F.broadcast(words.sparkSession.createDataFrame(plan, "range int, cut int, shard int, parts int"))  # a row per shard
    held = shards.join(plan, ["range", "cut"]).select("shard", "word", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = asks.join(plan, "shard").select("shard", "word", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"))

    def search(index: pa.Table, wanted: pa.Table) -> pa.Table:
        held, asking = index.column("word").combine_chunks(), wanted.column("word").combine_chunks()
        schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
        if not len(held) or not len(asking):
            return schema.empty_table()
        words = asking.to_pylist()
        ask, found = WordIndex(held.to_pylist()).near(words, first_half)
        pairs = pa.table([asking.take(pa.array(ask)), held.take(pa.array(found)), index.column("n").combine_chunks().take(pa.array(found))], schema=schema)
        if first_half:
            return pairs
        # words that keep the first half too are found from there
        keeps = [v.startswith(w[:len(w) // 2]) for w, v in zip(pairs.column("word").to_pylist(), pairs.column("near").to_pylist())]
        return pairs.filter(pa.compute.invert(pa.array(keeps, pa.bool_())))

    # a search costs far more than its few bytes: as many partitions as there are searches, not as few as their bytes fill
    searches = max(shuffle_partitions(words.sparkSession), sum(parts.values()))
    held, dealt = (side.repartition(searches, "shard", "part").groupBy("shard", "part") for side in (held, dealt))
    return held.cogroup(dealt).applyInArrow(search, "word string, near string, near_n long")


def near_words(words: DataFrame, symbols: int = SHARD_SYMBOLS, asked: int = ASKED) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words (word, n) that differ by exactly one inserted, deleted or replaced
    code point, each once. Words are distinct, neither null nor empty, and hold no NUL."""
    return _found(words, True, symbols, asked).unionByName(_found(words, False, symbols, asked))


def variant_groups(words: DataFrame, times: int = 10, symbols: int = SHARD_SYMBOLS, asked: int = ASKED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from distinct words (word, n).

    ``form`` is the near word of largest n (among ties the smallest in code-point order) if its n is ``times`` the word's
    or more, else null; ``root`` follows the forms to the last. An empty table gives no rows.
    """
    words = stage(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(words, symbols, asked).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= times * F.col("n")
    formed = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "formed")
    links = stage(formed.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:  # n grows with every form, so there are no circles; each round doubles the steps followed
        further = links.alias("a").join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        longer = stage(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        release(links)
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def slip(doc_id: object, word: str) -> str:
    """The contract's text: one (document, word) in 31 loses a letter. A null id counts as an empty one."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_table),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
coded AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS digits FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(digits) // 2), lambda i: ('0x' || substring(digits, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM coded, crc),
changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (
  SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON walk.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON f.word = w.word
JOIN formed last ON w.root = last.word AND last.form IS NULL
"""


@query("op11_spelling_variants", ORACLE)
def op11_spelling_variants(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variant_groups(vocabulary(docs, change=slip))
