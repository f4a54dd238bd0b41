"""Session settings the library relies on, and staged tables in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: runtime settings that let Spark split a hot key; each is set only where the session left it alone
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


#: partitions a shuffle starts with, before adaptive execution joins small ones
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: bytes of stored input for each of them
INPUT_BYTES = 4 << 20


def tune(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Turn on the adaptive skew handling unless the session was started with its own choice.

    With the input's ``folder``, shuffles start with partitions by its size, so what a task holds does not grow with it.
    """
    started_with = dict(spark.sparkContext.getConf().getAll())
    for key, value in SKEW_SETTINGS.items():
        if key not in started_with:
            spark.conf.set(key, value)
    if folder is not None and FIRST_PARTITIONS not in started_with:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        size = store.getContentSummary(path).getLength() if store.exists(path) else 0
        spark.conf.set(FIRST_PARTITIONS, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // INPUT_BYTES)))
    return spark


def partitions(spark: SparkSession) -> int:
    """Parts to cut a table into where the number must be said: those a shuffle starts with."""
    return max(int(spark.conf.get(key, "1")) for key in ("spark.sql.shuffle.partitions", FIRST_PARTITIONS))


def staging_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, else below the session's warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/strictasof-{spark.sparkContext.applicationId}"


#: whether a command's shuffle files go when it ends
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame) -> DataFrame:
    """Write a frame that several later branches read, as a table in the shared folder.

    The branches then read only their own columns, the plan starts anew, and a lost executor costs a re-read. Nothing reads
    the shuffles of the write again, so their files go with it. Tables of finished rounds are removed with :func:`release`,
    all that is left of a job with :func:`drop_staged`.
    """
    path = f"{staging_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more, such as those of a loop's earlier rounds."""
    for df in staged:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if f"/strictasof-{df.sparkSession.sparkContext.applicationId}/" in folder:
                _delete(df.sparkSession, folder)


def drop_staged(spark: SparkSession) -> None:
    """Remove every staged table of this application; results that read them must have been written before."""
    _delete(spark, staging_folder(spark))
