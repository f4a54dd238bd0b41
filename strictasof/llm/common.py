"""Pieces the operators share: staged tables in the shared folder, row ids and unsigned hashing in numpy."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: white space of the word pattern [^\x20\x09-\x0D]+ ; also what bytes.split() splits at
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one below the session's warehouse."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    return (set_by_cluster or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "llm", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = staged_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more (intermediate rounds of a loop)."""
    spark = staged.sparkSession
    jvm = spark._jvm
    for file in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, *columns: Column | str, name: str = "rows") -> DataFrame:
    """Staged ``columns`` of ``docs`` with ``row_id``, unique per row: ids may be null or repeated, rows may be equal.

    The number is written, so a recomputed task cannot change it.
    """
    return stage(docs.select(*columns).withColumn("row_id", F.monotonically_increasing_id()), name)


def bundle(docs: DataFrame, columns: list[str], name: str = "_rest") -> Column:
    """``columns`` of ``docs`` as one struct, so that no name of theirs can clash on the way; see :func:`unbundle`."""
    return F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).cast("byte").alias("_end")).alias(name)


def unbundle(columns: list[str], name: str = "_rest") -> list[Column]:
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def widened(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with the fields of ``ddl`` after its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


# ---- numpy ----------------------------------------------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """Spread unsigned 64-bit values over all bits (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hashes of all windows of a sequence from one running sum: sum of u[i] * base**i modulo 2**64."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
    #: most units whose powers are kept from call to call; a longer sequence works out its own
    KEPT = 1 << 19

    def __init__(self):
        self.tables = (np.ones(1, np.uint64),) * 2

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` powers, or more, of the base and of its inverse."""
        have = len(self.tables[0])
        if n <= have:
            return self.tables
        size = min(max(n, 2 * have), self.KEPT) if n <= self.KEPT else n
        tables = []
        for base in (self.BASE, np.uint64(pow(int(self.BASE), -1, 1 << 64))):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            tables.append(np.multiply.accumulate(values, out=values))
        if size <= self.KEPT:
            self.tables = tuple(tables)
        return tuple(tables)

    def spans(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of units[start:end] for each span, independent of where the span lies."""
        powers, inverse = self._powers(len(units) + 1)
        sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * powers[:len(units)], out=sums[1:])
        with np.errstate(over="ignore"):
            h = (sums[ends] - sums[starts]) * inverse[starts]
            return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


    def spans_of(self, units: np.ndarray, size: int) -> np.ndarray:
        """The hashes of :meth:`spans` for every window of ``size`` units."""
        powers, inverse = self._powers(len(units) + 1)
        sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * powers[:len(units)], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * inverse[:len(units) - size + 1]
        return mix(h + np.uint64(size * 0xD6E8FEB86659FD93 % (1 << 64)))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary array and the offsets of its values; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def parts_by_size(batch: pa.RecordBatch, column: str, most: int):
    """Slices of a batch whose texts hold about ``most`` bytes each; a longer text makes a slice of its own."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)
