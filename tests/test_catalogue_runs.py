"""Registered fits run with the operators' defaults over the whole span, and the matrix query gives every column."""

import inspect
from datetime import date, timedelta

import pytest

from catalogue import training as C
from strictasof.operators import effects
from strictasof.plans import matrix, ranker, stage_one


class Seen(Exception):
    pass


def arguments_of(monkeypatch, owner, name, query, spark):
    """The arguments, defaults filled in, with which a query calls a function."""
    signature, found = inspect.signature(getattr(owner, name)), {}

    def called(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        found.update(bound.arguments)
        raise Seen

    monkeypatch.setattr(owner, name, called)
    with pytest.raises(Seen):
        C.R.queries[query](spark, "nowhere")
    return found, {k: p.default for k, p in signature.parameters.items()}


@pytest.fixture()
def dated(spark, monkeypatch):
    rows = spark.createDataFrame([(1, date(1994, 3, 1), None), (2, date(2001, 7, 9), "G1")], "race_id long, date date, grade string")
    monkeypatch.setattr(C, "entries", lambda *_: rows)
    monkeypatch.setattr(C, "stage_table", lambda df: df)
    monkeypatch.setattr(C, "_inputs", lambda *_: (rows, rows))
    monkeypatch.setattr(C, "training_rows", lambda *_: rows)
    monkeypatch.setattr(C.star, "races", lambda *_: rows)


@pytest.mark.parametrize("query, owner, name, limits", [
    ("stage1_fit", stage_one, "fit_pace", ["rounds"]),
    ("oof_predictions", stage_one, "out_of_fold_pace", ["rounds", "n_blocks"]),
    ("ranker_fit", ranker, "fit_rankers", ["rounds", "patience"]),
    ("attribution", ranker, "fit_rankers", ["rounds", "patience"]),
    ("walk_forward", ranker, "walk_forward", ["rounds", "patience", "n_blocks"]),
    ("mixed_effects", effects, "fit_effects", ["max_iter", "tol"]),
    ("effect_series", effects, "cross_fit_effects", ["n_blocks", "max_iter"]),
])
def test_fits_are_not_cut(spark, monkeypatch, dated, query, owner, name, limits):
    got, defaults = arguments_of(monkeypatch, owner, name, query, spark)
    assert {k: got[k] for k in limits} == {k: defaults[k] for k in limits}
    if "start" in got:
        assert (got["start"], got["end"]) == (date(1994, 3, 1), date(2001, 7, 9))
    if "valid_start" in got:
        assert got["valid_start"] == got["end"] + timedelta(days=1)


def test_whole_matrix_gives_every_column(spark, monkeypatch):
    wide = spark.createDataFrame([(1, 2, 3, 4, 0.5, 0.25)], "race_id long, horse_id long, owner_id long, number int, f101 double, f811_z double")
    monkeypatch.setattr(C.star, "event_tables", lambda *_: {})
    monkeypatch.setattr(matrix, "feature_matrix", lambda *_, **__: wide)
    assert C.R.queries["feature_matrix_whole"](spark, "nowhere").columns == wide.columns
