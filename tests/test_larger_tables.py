"""What moves while a matrix is built, and that small and large groups are measured alike."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictasof.operators import features as X
from strictasof.operators import grouped as G
from strictasof.operators import prior as P
from strictasof.plans import matrix
from strictasof.session import SHUFFLE_CLEANUP, partitions, stage_table

from .conftest import D, race, runner


def exchanged(df):
    """The columns of each exchange of a frame's plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [re.findall(r"(\w+)#", m) for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


def test_rows_move_once_by_number_while_features_are_added(spark, event_tables):
    races = [race(i, D[i], race_number=i) for i in range(1, 6)]
    frame = matrix.entry_frame(event_tables(races, [runner(i, h, finish_pos=h, time_sec=90.0 + h + i) for i in range(1, 6) for h in (1, 2)]))
    facts = matrix.with_row_facts(frame, 1)
    built = matrix.add_default_features(facts)
    assert built.count() == 10 and built.select(X.ROW).distinct().count() == 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = exchanged(X.beside(facts, [X.add_blood_encoding, X.add_partner_rating, X.add_course_aptitude]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("weight_rule" in columns for columns in moved) == 1 and len(moved) > 10
    assert X.ROW not in matrix.feature_columns(built, frame)


def relative(df):
    return {r.id: (r.x_z, r.x_rank, r.y_z, r.y_rank) for r in G.relativize(df, ["x", "y"], size="n").collect()}


def test_small_and_large_groups_are_measured_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 29 == 0 else int(g), None if i % 7 == 0 else float("nan") if i % 31 == 0 else float(v), int(v), 4)
            for i, (g, v) in enumerate(zip(rng.choice(9, 400, p=[.4, .2] + [.4 / 7] * 7), rng.integers(0, 6, 400)))]
    rows += [(500, 77, 1.0, 2, 4), (501, 78, None, 3, 4), (502, 79, 2.0, 2, 4), (503, 79, 2.0, 2, 4)]
    df = spark.createDataFrame(rows, "id int, race_id int, x double, y int, n int").repartition(3)
    small = relative(df)
    monkeypatch.setattr(G, "SMALL_GROUP", 0)
    large = relative(df)
    monkeypatch.setattr(G, "SMALL_GROUP", 30)
    both = relative(df)
    assert len(small) == len(rows)
    for other in (large, both):
        assert small.keys() == other.keys()
        for i, values in small.items():
            assert values == pytest.approx(other[i], nan_ok=True), i


def test_groups_that_cross_batches_stay_whole(spark):
    df = spark.range(50).select(F.col("id"), F.floor(F.col("id") / 7).alias("race_id"), (F.col("id") % 7).cast("double").alias("x"),
                                (F.col("id") % 3).alias("y"), F.lit(7).alias("n"))
    expected = relative(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert relative(df) == expected and expected[6][:2] == (pytest.approx(3 / np.std(range(7), ddof=1)), 1.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_values_of_a_frame_move_once(spark):
    df = stage_table(spark.createDataFrame([(1, 1.0, 2, 2), (1, 3.0, 2, 2)], "race_id long, x double, y int, n int"))
    assert len(exchanged(G.relativize(df, ["x", "y"], size="n"))) == 1


def test_series_without_key_moves_no_rows(spark):
    df = stage_table(spark.createDataFrame([(1, D[1], 2.0), (2, D[2], 3.0)], "id long, date date, v double"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = P.with_prior(df, [], "date", {"s": P.running_sum(F.col("v"))})
        assert not any("id" in columns for columns in exchanged(found))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.id: r.s for r in found.collect()} == {1: None, 2: 2.0}


def test_partitions_without_a_first_number(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        assert partitions(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        if before is not None:
            spark.conf.set(key, before)


def test_staging_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    assert stage_table(spark.range(20).groupBy((F.col("id") % 3).alias("k")).count()).count() == 3
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
