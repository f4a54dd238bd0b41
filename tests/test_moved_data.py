"""What queries store and shuffle: only the columns that a result needs, and no computed row twice."""

import pytest

from catalogue import extraction, history, training
from strictasof.bindings import rendered
from strictasof.plans import matrix, probability
from strictasof.sources.decode import NAMED_REFERENCES

from .conftest import D, race, runner


@pytest.fixture()
def stored(spark, monkeypatch, event_tables):
    """Columns of the tables that catalogue queries store, over a few events."""
    races = [race(i, D[i], race_number=i) for i in range(1, 6)]
    frame = matrix.entry_frame(event_tables(races, [runner(i, h, finish_pos=h, time_sec=90.0 + h + i) for i in range(1, 6) for h in (1, 2)]))
    found = []
    for module in (history, training):
        kept = module.stage_table
        monkeypatch.setattr(module, "entries", lambda *_: frame)
        monkeypatch.setattr(module, "stage_table", lambda df, kept=kept: (found.append(set(df.columns)), kept(df))[1])
    monkeypatch.setattr(training.star, "races", lambda *_: event_tables(races, [runner(1, 1)])["races"])
    return found


@pytest.mark.parametrize("module, query, rows", [
    (history, "opponent_strength", 10), (history, "pit_regression", 10), (history, "speed_history", 10), (history, "final_section", 10), (training, "event_inputs", 5)])
def test_only_needed_columns_are_stored(spark, stored, module, query, rows):
    assert module.R.queries[query](spark, "nowhere").count() == rows
    assert stored and all(not columns & {"weather", "owner_key", "sire_id", "popularity", "weight_carried"} for columns in stored)


def test_training_rows_store_needed_columns_first(spark, stored):
    assert training.training_rows(spark, "nowhere").count() == 10
    assert len(stored) == 2 and "weather" not in stored[0] and "label" in stored[1]


def test_calibration_computes_its_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(r, float(s), s == 2) for r in range(5) for s in range(3)], "race_id long, score double, is_winner boolean")
    fitted = probability.fit_calibrator(rows.mapInArrow(watched, rows.schema))
    assert (fitted.n_races_fit, fitted.n_runners_fit, fitted.at_bound) == (5, 15, True)
    assert seen.value == 15


@pytest.mark.parametrize("render", [rendered.card_pages, rendered.result_pages])
def test_rendered_pages_are_not_dealt_out_again(spark, monkeypatch, event_tables, render):
    races = [race(i, D[i], owner_key=i) for i in range(1, 4)]
    t = event_tables(races, [runner(i, 1) for i in range(1, 4)], [dict(horse_id=1, sire_id=1, damsire_id=1)])
    from pyspark.sql import functions as F
    monkeypatch.setattr(rendered.star, "races", lambda *_: t["races"].withColumn("owner_key", F.col("race_id")))
    monkeypatch.setattr(rendered.star, "runners", lambda *_: t["runners"])
    monkeypatch.setattr(rendered.star, "horses", lambda *_: t["horses"].withColumn("name", F.lit("x")))
    tickets = spark.createDataFrame([(i, "単勝", [1], 100, "1") for i in range(1, 4)], "race_id long, bet_type string, combination array<int>, payout long, comb_key string")
    monkeypatch.setattr(rendered.star, "payouts", lambda *_: tickets)
    monkeypatch.setattr(extraction, "stage_table", lambda df: df)
    rows = extraction.printed(render, spark, "nowhere")
    assert rows.count() == 3
    assert "Repartition" not in rows._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_usual_references_are_found_first():
    assert NAMED_REFERENCES.index("\neacute\t") < 4000 < NAMED_REFERENCES.index("\nCounterClockwiseContourIntegral\t")
