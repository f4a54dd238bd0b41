from strictasof import session
from strictasof.operators import ranks


def test_partitions_follow_the_input(spark, tmp_path):
    """A shuffle starts with more partitions for a larger input, so what a task holds does not grow with it."""
    (tmp_path / "small").mkdir()
    (tmp_path / "large").mkdir()
    (tmp_path / "small" / "a.parquet").write_bytes(b"x" * 1000)
    (tmp_path / "large" / "a.parquet").write_bytes(b"x" * (10 * session.INPUT_BYTES))
    before = spark.conf.get(session.FIRST_PARTITIONS, None)
    try:
        session.tune(spark, str(tmp_path / "small"))
        assert session.partitions(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        session.tune(spark, str(tmp_path / "large"))
        assert session.partitions(spark) == 10
        rows = ranks.ranged(spark.range(1000).withColumnRenamed("id", "v"), ["v"])
        assert rows.select("_range").distinct().count() == 10
    finally:
        spark.conf.unset(session.FIRST_PARTITIONS) if before is None else spark.conf.set(session.FIRST_PARTITIONS, before)
