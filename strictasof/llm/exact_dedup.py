"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every row gets a digest of its text and, from it, a short fingerprint: only as many bits as the number of rows needs.
2. A task sends the owner of each range of fingerprints its own ones, sorted, each once, as Golomb-Rice codes of their
   differences: about twelve bits a fingerprint, whatever the texts hold.
3. An owner sees which fingerprints come from two messages and answers each message with a bitmap.
4. Only rows that a bitmap (or the task itself) marks are suspects; their texts are shuffled and compared byte by byte,
   after equal texts of a task were put together. Texts that share a digest but no bytes stay apart.

A hot text is sent once per message and its text once per task, so no owner and no group gathers its copies. Rows wait in
a table bucketed by the task that wrote them, so the bitmaps come to the rows and no other text moves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bundle, release, shuffle_partitions, stage, staged_path, unbundle, widened
from .registry import query

#: fingerprints that one owner keeps, rows that one message speaks for, fingerprint bits beyond those the rows need
OWNED, SENT, SPARE_BITS = 1 << 21, 1 << 20, 10
#: position of a row in the task that wrote it: the lower bits of Spark's row numbers
POSITION_BITS = 33


# ---- Golomb-Rice codes ----------------------------------------------------------------------------------------------

def golomb(values: np.ndarray, low: int, high: int) -> bytes:
    """Ascending distinct values in [low, high) as codes of their differences: all unary parts, then all remainders."""
    n = len(values)
    gaps = np.diff(values, prepend=low)
    width = max(0, int((high - low) // max(1, n)).bit_length() - 1)
    quotients = gaps >> width
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(width)) & 1
    head = np.array([n, width, len(unary)], "<i8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_values(code: bytes, low: int) -> np.ndarray:
    """The values that :func:`golomb` coded."""
    n, width, bits = np.frombuffer(code, "<i8", 3).tolist()
    body = np.frombuffer(code, np.uint8, offset=24)
    split = -(-bits // 8)
    quotients = np.diff(np.flatnonzero(np.unpackbits(body[:split], count=bits)), prepend=-1) - 1
    rest = np.unpackbits(body[split:], count=n * width).reshape(n, width).astype(np.int64)
    return low + np.cumsum((quotients << width) + (rest << np.arange(width)).sum(1))


# ---- the exchange ---------------------------------------------------------------------------------------------------

def _range(owner: int, owners: int, bits: int) -> tuple[int, int]:
    """The fingerprints [low, high) of an owner."""
    return (owner << bits) // owners, ((owner + 1) << bits) // owners


def _messages(rows: DataFrame, owners: int, bits: int, sent: int) -> DataFrame:
    """(owner, code, repeated, row_ids, places): a task's fingerprints of one owner, which of them it saw twice, and the
    rows behind them with the place of their fingerprint in the message."""
    schema = "owner int, code binary, repeated binary, row_ids binary, places binary"
    bounds = np.array([_range(o, owners, bits)[0] for o in range(1, owners)], np.int64)

    def message(held):
        prints, row_ids = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(prints, kind="stable")
        prints, row_ids = prints[order], row_ids[order]
        cuts = np.searchsorted(prints, bounds).tolist()
        out = [[] for _ in range(5)]
        for owner, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(prints)])):
            if b > a:
                once, places, times = np.unique(prints[a:b], return_inverse=True, return_counts=True)
                for column, v in zip(out, (owner, golomb(once, *_range(owner, owners, bits)), np.packbits(times > 1).tobytes(),
                                           row_ids[a:b].astype("<i8").tobytes(), places.astype("<i4").tobytes())):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), *[pa.binary()] * 4))],
                                          [f.split()[0] for f in schema.split(", ")])

    def work(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("fingerprint").to_numpy(), batch.column("row_id").to_numpy()))
            size += batch.num_rows
            if size >= sent:
                yield message(held)
                held, size = [], 0
        if size:
            yield message(held)

    return rows.mapInArrow(work, schema)


def _answers(messages: DataFrame, owners: int, bits: int) -> DataFrame:
    """(message, bitmap): which fingerprints of a message another message holds too."""

    def answer(table: pa.Table) -> pa.Table:
        low = _range(table.column("owner")[0].as_py(), owners, bits)[0]
        sets = [golomb_values(code.as_py(), low) for code in table.column("code")]
        every, times = np.unique(np.concatenate(sets), return_counts=True)
        twice = every[times > 1]
        maps = []
        for values in sets:
            at = np.searchsorted(twice, values)
            maps.append(np.packbits(np.append(twice, -1)[at] == values).tobytes())
        return pa.table({"message": table.column("message"), "bitmap": pa.array(maps, pa.binary())})

    return messages.select("owner", "message", "code").groupBy("owner").applyInArrow(answer, "message long, bitmap binary")


def _marked(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """row_id of every row whose fingerprint was seen twice, in its own message or in another."""

    def work(batches):
        for batch in batches:
            for bitmap, repeated, row_ids, places in zip(*(batch.column(c).to_pylist() for c in ("bitmap", "repeated", "row_ids", "places"))):
                flags = np.unpackbits(np.frombuffer(bitmap, np.uint8) | np.frombuffer(repeated, np.uint8)).astype(bool)
                ids = np.frombuffer(row_ids, "<i8")[flags[np.frombuffer(places, "<i4")]]
                yield pa.RecordBatch.from_arrays([pa.array(ids)], ["row_id"])

    both = messages.select("message", "repeated", "row_ids", "places").join(answers, "message")
    return both.select("bitmap", "repeated", "row_ids", "places").mapInArrow(work, "row_id long")


def _bitmaps(marked: DataFrame) -> DataFrame:
    """(task, words): the marked rows of each writing task, 64 positions to a word."""
    position = F.col("row_id").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))

    def work(table: pa.Table) -> pa.Table:
        at = table.column("position").to_numpy()
        words = np.zeros(int(at.max() >> 6) + 1, np.uint64)
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return pa.table({"task": table.column("task").slice(0, 1), "words": pa.array([words.view(np.int64)], pa.list_(pa.int64()))})

    rows = marked.select(F.shiftright("row_id", POSITION_BITS).cast("int").alias("task"), position.alias("position"))
    return rows.groupBy("task").applyInArrow(work, "task int, words array<long>")


def _bucketed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as a table bucketed by ``task``: each task's rows lie in one bucket, so nothing is shuffled."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = rows.write.option("compression", "zstd").option("path", staged_path(spark, name))
    writer.bucketBy(shuffle_partitions(spark), "task").saveAsTable(table)
    return spark.table(table)


#: bytes of a text -> digest that equal texts share
Digest = Callable[[bytes], bytes]


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z to a-z and nothing else."""
    return pc.ascii_lower(texts)


def exact_groups(docs: DataFrame, text: str = "text", prefer: str = "doc_id", normalise: Callable[[pa.Array], pa.Array] = lowered,
                 digest: Digest = sha256, owned: int = OWNED, sent: int = SENT, spare_bits: int = SPARE_BITS) -> DataFrame:
    """``docs`` with ``digest`` (binary), ``group_size`` (long), ``keep`` (the ``prefer`` value of the row that stays) and
    ``kept`` (boolean).

    Rows belong together whose normalised texts are the same bytes. Of a group exactly one row stays: the one with the
    largest ``prefer`` (null is the least), among equal ones the first written. Null texts count as empty, so they form
    one group with empty ones. Any digest gives right groups; one that tells fewer texts apart makes more suspects. An
    empty table gives no rows. Columns of ``docs`` named like the results are replaced.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("digest", "group_size", "keep", "kept")]
    others = [c for c in columns if c != text]

    def digests(batches):
        for batch in batches:
            texts = normalise(batch.column("text").fill_null(""))
            values = [digest(t) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], [*batch.schema.names, "digest"])

    plain = docs.select(bundle(docs, others), F.col(f"`{prefer}`").alias("prefer"), F.col(f"`{text}`").cast("string").alias("text"))
    coded = plain.mapInArrow(digests, widened(plain, "digest binary")).withColumn("row_id", F.monotonically_increasing_id())
    rows = _bucketed(coded.withColumn("task", F.shiftright("row_id", POSITION_BITS).cast("int")), "exact_rows")

    n = rows.count()
    bits = min(62, max(1, n).bit_length() + spare_bits)
    owners = max(1, min(shuffle_partitions(spark), -(-n // 1000)), -(-n // owned))
    fingerprint = F.shiftright(F.xxhash64("digest").bitwiseAND(F.lit((1 << 62) - 1)), 62 - bits)
    sent_rows = _messages(rows.select("row_id", fingerprint.alias("fingerprint")), owners, bits, sent)
    messages = stage(sent_rows.withColumn("message", F.monotonically_increasing_id()), "messages")
    bitmaps = stage(_bitmaps(_marked(messages, _answers(messages, owners, bits))), "bitmaps")
    release(messages)

    def suspects(*wanted: str) -> DataFrame:
        bit = "shiftrightunsigned(try_element_at(words, int(shiftright({0}, 6) + 1)), int({0} & 63)) & 1"
        marked = F.expr(bit.format(f"(row_id & {(1 << POSITION_BITS) - 1})")) == 1
        return rows.select("task", "row_id", *wanted).join(bitmaps.hint("shuffle_hash"), "task").where(marked).select("row_id", *wanted)

    def normal(batches):
        for batch in batches:
            texts = normalise(batch.column("text").fill_null("")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("digest"), texts], ["row_id", "digest", "text"])

    # equal texts of a task are put together before they move
    texts = suspects("digest", "text").mapInArrow(normal, "row_id long, digest binary, text string")
    same = texts.groupBy("digest", "text").agg(F.count("*").alias("n"), F.min("row_id").alias("variant"))
    kinds = stage(same.groupBy("digest").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1"), "kinds")
    narrow = suspects("digest", "prefer")
    classes = narrow.join(kinds.where("kinds = 1").select("digest"), "digest").withColumn("variant", F.lit(0).cast("long"))
    mixed = kinds.where("kinds > 1").select("digest")
    if not mixed.isEmpty():  # different texts share a digest: each text is a class of its own
        variants = same.join(mixed, "digest").select("digest", "text", "variant")
        apart = texts.join(mixed, "digest").join(variants, ["digest", "text"]).select("row_id", "variant")
        classes = classes.unionByName(narrow.join(apart, "row_id"))
    classes = stage(classes, "classes")
    best = F.max(F.struct(F.col("prefer").isNotNull().alias("known"), F.col("prefer").alias("value"), (-F.col("row_id")).alias("first")))
    groups = stage(classes.groupBy("digest", "variant").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    found = stage(classes.join(groups, ["digest", "variant"]).select(
        "row_id", "group_size", F.col("best.value").alias("keep"), (-F.col("best.first") == F.col("row_id")).alias("kept")), "found")
    for done in (bitmaps, kinds, classes, groups):
        release(done)
    own = dict(zip(others, unbundle(others)))
    return rows.join(found, "row_id", "left").select(
        *[F.col("text").alias(c) if c == text else own[c] for c in columns], "digest",
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.col("prefer")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("kept", F.lit(True)).alias("kept"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


@query("op12_exact_dedup", ORACLE)
def op12_exact_dedup(spark, sf_dir):
    """Groups of equal texts, A-Z lower-cased, over all documents; the digest is the SHA-256 of the normalised text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", F.col("keep").alias("keep_id"), "group_size", "kept",
                                     F.lower(F.hex("digest")).alias("text_sha256"))
