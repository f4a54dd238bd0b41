"""Rounds of a fit move no rows, and events kept as one row or as rows give the same weights."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictasof.plans import fold_runner, ranker, stored_fit
from strictasof.session import stage_table

from .test_larger_tables import exchanged


@pytest.fixture()
def entered(spark):
    rng = np.random.default_rng(11)
    rows = [(e, h, date(2010 + e % 8, 1 + e % 12, 3), int(3 - p if p < 3 else 0), 1.0 + e % 2, float(x), float(x * x + rng.normal()))
            for e in range(90) for h, (p, x) in enumerate(zip(rng.permutation(3 + e % 5), rng.normal(size=3 + e % 5)))]
    return stage_table(spark.createDataFrame(rows, "race_id long, horse_id long, date date, label int, sample_weight double, f1 double, f2 double"))


def roles():
    late = F.col("race_id") >= 60
    return {"all": F.lit("train"), "split": F.when(late, "valid").otherwise("train"), "part": F.when(~late, "train")}


@pytest.mark.parametrize("patience", [None, 2])
@pytest.mark.parametrize("limit", [0, 4])
def test_fits_do_not_depend_on_how_events_are_kept(entered, monkeypatch, limit, patience):
    whole = ranker.fit_rankers(entered, ["f1", "f2"], roles(), rounds=6, patience=patience)
    newton = stored_fit.fit_weights(entered, ["f1", "f2"], rounds=4)
    monkeypatch.setattr(ranker, "SMALL_EVENT", limit)
    apart = ranker.fit_rankers(entered, ["f1", "f2"], roles(), rounds=6, patience=patience)
    assert whole.rounds == apart.rounds and any(w for ws in whole.weights.values() for w in ws)
    for name, weights in whole.weights.items():
        assert weights == pytest.approx(apart.weights[name], abs=1e-9)
        assert whole.losses[name] == pytest.approx(apart.losses[name], abs=1e-9)
    assert newton[0] == pytest.approx(stored_fit.fit_weights(entered, ["f1", "f2"], rounds=4)[0], abs=1e-9)


def test_folds_do_not_depend_on_how_events_are_kept(entered, monkeypatch):
    rows = entered.select("*", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("fold_index"), (F.col("race_id") % 4).alias("block"))
    placed = ranker.placed_stages(rows, ["fold_index", "race_id"], ranker.MEMBER)
    used = stage_table(placed.withColumn("_row", F.monotonically_increasing_id()).withColumn("_x", F.array("f1", "f2")))
    models = [(0, -1), (1, 2), (1, -1)]
    whole, _ = fold_runner.fit_models(used, 2, models, rounds=3)
    monkeypatch.setattr(ranker, "SMALL_EVENT", 4)
    apart, _ = fold_runner.fit_models(used, 2, models, rounds=3)
    for m in models:
        assert whole[m] == pytest.approx(apart[m], abs=1e-9)


def test_a_round_moves_sums_only(entered):
    staged = ranker.placed_stages(entered, ["race_id"], ranker.MEMBER)
    units, large = ranker.event_units(staged.select(
        "race_id", "stage", "sample_weight", F.lit(False).alias("_won"), F.array(F.lit("train")).alias("_roles"), F.array("f1", "f2").alias("_x")), ["race_id"])
    assert large is None and units.count() == 90
    cells = ranker.unit_cells(units, {0: np.zeros(2)}, 2, 3, "train", ranker._slopes)
    assert exchanged(cells) == []
