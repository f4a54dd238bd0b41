"""Queries over folds, training tables, models and effects."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from strictasof.bindings import star
from strictasof.functions import scalars as S
from strictasof.operators import components, effects
from strictasof.operators import features as X
from strictasof.plans import folds as T
from strictasof.plans import evaluate, fold_runner, matrix, probability, ranker, scoring, stage_one, stored_fit
from strictasof.session import release, stage_table, staging_folder
from strictasof.sources import cards, ingest

from .chances import GROUPS, SCORED, SEALED, TODAY, scored
from .history import MIN_SESSION_N, QUANTILE_SQL, over, shrunk
from .oracle import EVENTS, FULL, IDS, MODEL, RACES, with_tables, rnd
from .quality import LAPS_SQL, laps
from .registry import Registry, r6

R = Registry()
ID = ["race_id", "horse_id", "owner_id", "number"]
MEMBER = tuple(ID)


def entries(spark, folder):
    return matrix.entry_frame(star.event_tables(spark, folder))


FOLDS_SQL = EVENTS + f"""
    , span AS (SELECT min(date) AS lo, max(date) AS hi FROM races WHERE NOT {SEALED}),
    folds AS (SELECT CAST(y - year(lo) - 3 AS BIGINT) AS fold_index, lo AS train_start, make_date(y - 1, 12, 31) AS train_end,
                     make_date(y, 1, 1) AS valid_start, make_date(y, 12, 31) AS valid_end, make_date(y - 1, 1, 1) AS inner_valid_start
              FROM span, (SELECT CAST(unnest(generate_series(1990, 2010)) AS INTEGER) AS y) WHERE y >= year(lo) + 3 AND y <= year(hi))"""


@R.query("folds", FOLDS_SQL + "SELECT * FROM folds")
def _(spark, folder):
    return T.make_folds(star.races(spark, folder), TODAY).drop("seed")


@R.query("fold_roles", FOLDS_SQL + f"""
    SELECT fold_index, race_id, CASE WHEN date >= valid_start THEN 'valid' WHEN date >= inner_valid_start THEN 'inner_valid' ELSE 'train' END AS role
    FROM races, folds WHERE NOT {SEALED} AND date BETWEEN train_start AND valid_end""")
def _(spark, folder):
    races = star.races(spark, folder)
    return T.assign_folds(races, T.make_folds(races, TODAY), TODAY)


@R.query("crossfit_blocks", EVENTS + """
    , b AS (SELECT i, DATE '1995-01-01' + CAST(i * 273 + least(i, 3) AS INTEGER) AS lo, DATE '1995-01-01' + CAST((i + 1) * 273 + least(i + 1, 3) - 1 AS INTEGER) AS hi
            FROM (SELECT unnest(generate_series(0, 3)) AS i))
    SELECT race_id, CAST(i AS BIGINT) AS block FROM races LEFT JOIN b ON date BETWEEN lo AND hi""")
def _(spark, folder):
    block = T.cross_fit_block(F.col("date"), date(1995, 1, 1), date(1997, 12, 30))
    return star.races(spark, folder).select("race_id", block.alias("block"))


@R.query("sample_weights", EVENTS + "SELECT race_id, CASE grade WHEN 'G1' THEN 3.0 WHEN 'G2' THEN 2.0 ELSE 1.0 END::DOUBLE AS sample_weight FROM races")
def _(spark, folder):
    return T.sample_weights(star.races(spark, folder), {"G1": 3.0, "G2": 2.0})


@R.query("group_sizes", MODEL + SCORED + "SELECT race_id, count(*) AS size FROM scored GROUP BY 1")
def _(spark, folder):
    return T.group_sizes(scored(spark, folder))


@R.query("category_folding", FULL + f"""
    , kept AS (SELECT jockey_id, row_number() OVER (ORDER BY jockey_id) - 1 AS code FROM entries WHERE jockey_id IS NOT NULL AND date < DATE '1999-01-01' GROUP BY 1 HAVING count(*) >= 290)
    SELECT {IDS}, CAST(CASE WHEN jockey_id IS NULL THEN NULL ELSE COALESCE(code, (SELECT count(*) FROM kept)) END AS BIGINT) AS code
    FROM entries LEFT JOIN kept USING (jockey_id)""")
def _(spark, folder):
    rows = entries(spark, folder)
    codes = T.category_codes(rows.where(F.col("date") < F.lit(date(1999, 1, 1))), "jockey_id", 290)
    return T.apply_categories(rows, "jockey_id", codes).select("race_id", "horse_id", "owner_id", "number", F.col("jockey_id").cast("long").alias("code"))


@R.query("category_codes_text", """
    WITH k AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part WHERE p_size <= 25 GROUP BY 1)
    SELECT p_partkey, CAST(COALESCE(code, -1) AS BIGINT) AS code FROM part LEFT JOIN k USING (p_name)""")
def _(spark, folder):
    parts = star.table(spark, folder, "part")
    codes = T.category_codes(parts.where("p_size <= 25"), "p_name", 1)
    return T.apply_categories(parts, "p_name", codes, other=-1).select("p_partkey", F.col("p_name").cast("long").alias("code"))


@R.query("pace_target", with_tables(RACES, LAPS_SQL) + f"""
    , s AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n, row_number() OVER (PARTITION BY race_id ORDER BY furlong_no DESC) AS back FROM laps)
    SELECT race_id, {rnd('sum(lap_sec) FILTER (WHERE back <= 3) / 3.0 - sum(lap_sec) FILTER (WHERE back > 3) / ((max(distance) - 600) / 200.0)')} AS f102_actual,
           max(n) AS n_laps FROM s JOIN races USING (race_id) WHERE n >= 4 GROUP BY 1""")
def _(spark, folder):
    return T.pace_target(laps(spark, folder), star.races(spark, folder)).select("race_id", r6("f102_actual"), "n_laps")


INPUTS_SQL = FULL + QUANTILE_SQL


@R.query("event_inputs", INPUTS_SQL + f"""
    , s AS (SELECT race_id, min(f101) AS mn, avg(f101) AS av, quantile_cont(f101, 0.25) AS q, count(*) - count(f101) AS miss FROM lead WHERE status <> '出走取消' GROUP BY 1)
    SELECT r.race_id, {rnd('mn')} AS f101_min, {rnd('av')} AS f101_mean, {rnd('q')} AS f101_q25, miss AS f101_n_missing, distance,
           CAST(CASE track_condition WHEN '良' THEN 0 WHEN '稍重' THEN 1 WHEN '重' THEN 2 WHEN '不良' THEN 3 END AS INTEGER) AS track_condition
    FROM races r LEFT JOIN s USING (race_id)""")
def _(spark, folder):
    rows = _led(spark, folder)
    out = T.event_inputs(star.races(spark, folder), rows)
    return out.select("race_id", r6("f101_min"), r6("f101_mean"), r6("f101_q25"), "f101_n_missing", "distance", "track_condition")


def _led(spark, folder):
    """A stored table of the entries' events, status and lead quantile; only what the quantile reads is stored before."""
    rows = stage_table(entries(spark, folder).select("race_id", "horse_id", "date", "status", "corners", "corner_nos", "n_starters"))
    led = stage_table(X.add_lead_quantile(rows).select("race_id", "status", "f101"))
    release(rows)
    return led


def _inputs(spark, folder):
    """Event inputs with their date, and the pace target of the events that have one."""
    races = star.races(spark, folder)
    rows = _led(spark, folder)
    inputs = T.event_inputs(races, rows).join(races.select("race_id", "date"), "race_id")
    return stage_table(inputs), stage_table(T.pace_target(laps(spark, folder), races))


def _span(rows):
    """First and last date."""
    return tuple(rows.agg(F.min("date"), F.max("date")).first())


@R.query("stage1_fit")
def _(spark, folder):
    inputs, target = _inputs(spark, folder)
    return stage_one.predict_pace(stage_one.fit_pace(inputs, target), inputs)


@R.query("oof_predictions")
def _(spark, folder):
    inputs, target = _inputs(spark, folder)
    oof, _ = stage_one.out_of_fold_pace(inputs, target, *_span(inputs))
    return oof


# --- ranker ----------------------------------------------------------------------------------------------------

PL = SCORED + """, st AS (SELECT s.*, p.stage FROM scored s LEFT JOIN (
        SELECT race_id, horse_id, owner_id, number, row_number() OVER (PARTITION BY race_id ORDER BY label DESC, race_id, horse_id, owner_id, number) AS stage FROM scored WHERE label > 0
        QUALIFY stage <= 3) p USING (race_id, horse_id, owner_id, number)),
    x AS (SELECT *, max(stage) OVER g AS placed, exp(score) AS e1, CASE WHEN stage = 1 THEN 0 ELSE exp(score) END AS e2,
                 CASE WHEN stage <= 2 THEN 0 ELSE exp(score) END AS e3 FROM st WINDOW g AS (PARTITION BY race_id)),
    p AS (SELECT *, CASE WHEN placed >= 1 THEN e1 / sum(e1) OVER g ELSE 0 END AS p1, CASE WHEN placed >= 2 THEN e2 / sum(e2) OVER g ELSE 0 END AS p2,
                 CASE WHEN placed >= 3 THEN e3 / sum(e3) OVER g ELSE 0 END AS p3 FROM x WINDOW g AS (PARTITION BY race_id))"""


@R.query("pl_gradient", MODEL + PL + f"""
    SELECT {IDS}, {rnd('p1 + p2 + p3 - CASE WHEN stage IS NOT NULL THEN 1 ELSE 0 END')} AS grad,
           {rnd('greatest(p1 * (1 - p1) + p2 * (1 - p2) + p3 * (1 - p3), 1e-6)')} AS hess FROM p""")
def _(spark, folder):
    rows = ranker.placed_stages(scored(spark, folder), ["race_id"], ID)
    return ranker.pl_gradient(rows, F.col("score")).select(*ID, r6("grad"), r6("hess"))


FEATURES = ("f704", "f802", "f809_win_rate", "f809_top3_rate", "f702_jockey_experience_count")


def training_rows(spark, folder):
    """A stored training table: strictly-before features, labels and grade weights of all runners."""
    rows = stage_table(entries(spark, folder).select(*ID, "date", "grade", "status", "finish_pos", "jockey_id", "course", "distance", "n_starters"))
    built = X.add_partner_course_encoding(rows, source=rows)
    built = X.add_course_aptitude(built, source=rows)
    built = X.add_features(built, [X.career_rates(), X.partner_change()], source=rows)
    built = T.graded_labels(built).select(*ID, "date", "grade", "label", *FEATURES)
    weights = T.sample_weights(star.races(spark, folder), {"G1": 3.0, "G2": 2.0})
    built = stage_table(built.join(weights, "race_id"))
    release(rows)
    return built


@R.query("ranker_fit")
def _(spark, folder):
    rows = training_rows(spark, folder)
    train = F.when(F.col("date") < F.lit(date(2000, 1, 1)), "train").otherwise("valid")
    fitted = ranker.fit_rankers(rows, FEATURES, {"main": train}, member=ID)
    return fitted.table(spark)


@R.query("attribution")
def _(spark, folder):
    rows = training_rows(spark, folder)
    fitted = ranker.fit_rankers(rows, FEATURES, {"main": F.lit("train")}, member=ID)
    return ranker.drivers(rows, fitted, "main", top_k=3, member=MEMBER)


@R.query("walk_forward")
def _(spark, folder):
    """Validation probabilities of all folds; the flagged grade is re-normalised with its fold's temperature."""
    rows = training_rows(spark, folder)
    races = star.races(spark, folder)
    folds = T.fold_rows(T.make_folds(races, TODAY))
    open_rows = rows.where(~S.sealed(F.col("date"), F.col("grade"), TODAY))
    valid, oof, _ = ranker.walk_forward(open_rows, FEATURES, folds, F.col("grade") == "G1", member=ID)
    valid, oof = stage_table(valid), stage_table(oof)
    fitted = [(f["fold_index"], probability.fit_calibrator(oof.where(F.col("fold_index") == f["fold_index"])).temperature) for f in folds]
    temperatures = spark.createDataFrame(fitted, "fold_index long, temperature double")
    flagged = probability.calibrate_slice(valid, temperatures, races.where("grade = 'G1'"), out="y_calibrated")
    return valid.join(flagged.select(*ID, "fold_index", "y_calibrated"), [*ID, "fold_index"], "left")


# --- effects -----------------------------------------------------------------------------------------------------

@R.query("condition_scale", FULL + f"""
    , t AS (SELECT surface, distance, time_sec - avg(time_sec) OVER (PARTITION BY race_id) AS d FROM entries WHERE status IN ('出走', '降着', '失格') AND time_sec IS NOT NULL)
    SELECT surface, distance, {rnd('stddev_samp(d)', 4)} AS sd FROM t GROUP BY 1, 2""")
def _(spark, folder):
    return effects.condition_scale(effects.timed_rows(entries(spark, folder))).select("surface", "distance", r6("sd", digits=4))


@R.query("mixed_effects")
def _(spark, folder):
    return effects.fit_effects(entries(spark, folder), date(2001, 8, 2)).horse_effects


#: all that the fits of the effects read
EFFECT_INPUTS = ("race_id", "horse_id", "date", "status", "time_sec", "surface", "distance", "race_class", "grade")


@R.query("effect_series")
def _(spark, folder):
    rows = entries(spark, folder)
    rows = stage_table(rows.select(*[c for c in rows.columns if c in EFFECT_INPUTS]))
    first, last = _span(rows)
    return effects.cross_fit_effects(rows, first, last, last + timedelta(days=1))


@R.query("largest_component", """
    WITH RECURSIVE edges AS (SELECT DISTINCT l_orderkey AS race_id, l_suppkey AS horse_id FROM lineitem),
    reach(horse_id) AS (SELECT min(horse_id) FROM edges UNION SELECT b.horse_id FROM reach r JOIN edges a ON a.horse_id = r.horse_id JOIN edges b ON b.race_id = a.race_id)
    SELECT DISTINCT race_id FROM edges JOIN reach USING (horse_id)""")
def _(spark, folder):
    edges = star.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_suppkey").alias("horse_id"))
    return components.largest_component(edges)


# --- the full matrix ----------------------------------------------------------------------------------------------

def whole_matrix(spark, folder):
    return matrix.feature_matrix(star.event_tables(spark, folder), as_of=date(2002, 1, 1), min_session_n=MIN_SESSION_N, keep=("owner_id", "number"))


@R.query("feature_matrix_whole")
def _(spark, folder):
    """The matrix with all of its columns; ``feature_matrix`` compares those that SQL states."""
    return whole_matrix(spark, folder)


@R.query("feature_matrix", FULL + f"""
    , v AS (SELECT *, COALESCE(sum(perf) OVER m / NULLIF(count(perf) OVER m, 0), 0.5) AS mu, sum(perf) OVER h AS s, count(perf) OVER h AS k,
                   count(finish_pos) OVER w AS n, count(*) FILTER (WHERE finish_pos = 1) OVER w AS w1
            FROM entries WINDOW m AS {over('course, band')}, h AS {over('horse_id, course, band')}, w AS {over('horse_id')}),
    base AS (SELECT *, {shrunk('s', 'k', 'mu')} AS f802 FROM v WHERE status <> '出走取消'),
    rel AS (SELECT *, avg(f802) OVER g AS a, stddev_samp(f802) OVER g AS sd FROM base WINDOW g AS (PARTITION BY race_id))
    SELECT {IDS}, {rnd('f802')} AS f802, {rnd('CASE WHEN sd > 1e-9 THEN (f802 - a) / sd END', 4)} AS f802_z,
           {rnd('CASE WHEN n > 0 THEN w1 / n END')} AS f809_win_rate,
           CASE WHEN month(date) IN (3,4,5) THEN '春' WHEN month(date) IN (6,7,8) THEN '夏' WHEN month(date) IN (9,10,11) THEN '秋' ELSE '冬' END AS f803_season
    FROM rel""")
def _(spark, folder):
    out = whole_matrix(spark, folder)
    return out.select(*ID, r6("f802"), r6("f802_z", digits=4), r6("f809_win_rate"), "f803_season")


def fold_run(spark, folder, rounds=50):
    """All folds over the whole matrix, with the expected pace of each: ``rounds`` of trees per pace model."""
    tables = star.event_tables(spark, folder)
    races = tables["races"]
    folds = T.fold_rows(T.make_folds(races, TODAY))
    inputs, target = _inputs(spark, folder)
    inputs = stage_table(inputs.join(probability.target_population(races, TODAY).select("race_id"), "race_id", "left_semi"))
    pace = stage_table(stage_one.fold_pace(inputs, target, folds, rounds=rounds))
    built = fold_runner.fold_matrix(tables, folds, TODAY, pace, keep=("owner_id", "number"), min_session_n=MIN_SESSION_N)
    labels = T.graded_labels(tables["runners"]).select(*ID, "label")
    weights = T.sample_weights(races, {"G1": 3.0, "G2": 2.0})
    rows = stage_table(built.join(labels, ID).join(weights, "race_id"))
    return fold_runner.run_folds(rows, ["grade"], F.col("grade") == "G1", MEMBER)


@R.query("fold_report", MODEL + FOLDS_SQL[len(EVENTS):] + GROUPS + f"""
    , ran AS (SELECT race_id, any_value(grade) AS grade, any_value(date) AS date, count(*) AS k FROM runners JOIN races USING (race_id)
              WHERE status <> '出走取消' AND NOT {SEALED} GROUP BY 1),
    ev AS (SELECT fold_index, grade, k, ll FROM ran JOIN g USING (race_id) JOIN folds ON date BETWEEN valid_start AND valid_end)
    SELECT fold_index, population, count(*) AS n_races, {rnd('avg(ll)')} AS market_log_loss, {rnd('avg(ln(k))')} AS uniform_log_loss,
           true AS below_uniform
    FROM (SELECT *, 'all' AS population FROM ev UNION ALL SELECT *, 'g1' FROM ev WHERE grade = 'G1') GROUP BY 1, 2""")
def _(spark, folder):
    """Per fold and population: events, the market's and the uniform loss, and whether the model's is below the latter."""
    report = fold_runner.fold_report(fold_run(spark, folder).valid, evaluate.market_scores(star.runners(spark, folder)))
    return report.select("fold_index", "population", "n_races", r6("market_log_loss"), r6("uniform_log_loss"),
                         (F.col("model_log_loss") < F.col("uniform_log_loss")).alias("below_uniform"))


PENDING_FROM = date(2001, 7, 1)


def pending_setup(spark, folder):
    """(stored tables before the last month, tables of the last month's events as their cards show them).

    Cards name entities by key; the register has no key of the parts of size 50, which therefore enter as newcomers.
    """
    tables = star.event_tables(spark, folder)
    coming = tables["races"].where(F.col("date") >= F.lit(PENDING_FROM))
    held = tables["races"].where(F.col("date") < F.lit(PENDING_FROM))
    listed = scoring.before_the_start(tables["runners"].join(coming.select("race_id"), "race_id", "left_semi"))
    key = lambda kind, column: F.concat(F.lit(kind[0]), F.col(column).cast("string"))
    card = listed.withColumns({f"{kind}_key": key(kind, column) for column, kind in cards.ENTITIES.items()}).drop(*cards.ENTITIES)
    filed = lambda kind, rows, column: rows.select(
        F.lit(kind).alias("entity_type"), key(kind, column).alias("source_key"), F.col(column).cast("long").alias("internal_id"))
    register = (filed("horse", tables["horses"].where("damsire_id IS NOT NULL"), "horse_id")
                .unionByName(filed("jockey", star.table(spark, folder, "supplier"), "s_suppkey"))
                .unionByName(filed("trainer", star.table(spark, folder, "customer"), "c_custkey")))
    pending = cards.pending_tables(coming.drop("n_entries", "n_starters"), card, register)
    stored = {**tables, "races": held, "runners": tables["runners"].join(held.select("race_id"), "race_id", "left_semi")}
    return stored, {name: stage_table(table) for name, table in pending.items()}


CARD_SQL = FULL + f"""
    , card AS (SELECT * FROM entries WHERE date >= DATE '{PENDING_FROM}'),
    fresh AS (SELECT DISTINCT horse_id AS old_id, 'h' || horse_id AS k FROM card WHERE damsire_id IS NULL),
    ids AS (SELECT old_id, {cards.TEMPORARY_FROM} - 1 + row_number() OVER (ORDER BY substr(md5(k), 1, 3), k) AS new_id FROM fresh)"""


@R.query("pending_card", CARD_SQL + """
    , sizes AS (SELECT race_id, CAST(count(*) AS INTEGER) AS n_entries, CAST(count(*) FILTER (WHERE status <> '出走取消') AS INTEGER) AS n_starters FROM card GROUP BY 1)
    SELECT race_id, owner_id, number, CAST(COALESCE(new_id, horse_id) AS BIGINT) AS horse_id, CAST(jockey_id AS BIGINT) AS jockey_id,
           CAST(trainer_id AS BIGINT) AS trainer_id, new_id IS NOT NULL AS is_new, s.n_entries, s.n_starters
    FROM card JOIN sizes s USING (race_id) LEFT JOIN ids ON old_id = horse_id""")
def _(spark, folder):
    """The entries of all pending events with stored or temporary ids, and their event's sizes by the card."""
    _, pending = pending_setup(spark, folder)
    rows = pending["runners"].join(pending["races"].select("race_id", "n_entries", "n_starters"), "race_id")
    return rows.select("race_id", "owner_id", "number", *[F.col(c).cast("long").alias(c) for c in cards.ENTITIES],
                       cards.is_temporary(F.col("horse_id")).alias("is_new"), "n_entries", "n_starters")


def pending_scored(spark, folder):
    """(probabilities, drivers) of all events of the last month, scored at once from the history before them."""
    stored, pending = pending_setup(spark, folder)
    rows = training_rows(spark, folder)
    fitted = ranker.fit_rankers(rows.where(F.col("date") < F.lit(PENDING_FROM)), FEATURES, {"main": F.lit("train")}, member=ID)
    built = scoring.pending_matrix(stored, pending, min_session_n=MIN_SESSION_N, keep=("owner_id", "number"))
    return scoring.score_pending(stage_table(built), pending["runners"], fitted, "main", member=ID)


@R.query("pending_scores")
def _(spark, folder):
    """Probability, readiness and first driver of every entry of the pending events, newcomers included."""
    probabilities, why = pending_scored(spark, folder)
    first = why.where("rank = 1").select(*ID, F.col("family").alias("driver"), F.col("contribution"))
    return probabilities.join(first, list(ID), "left")


@R.query("pending_totals", CARD_SQL + """
    , g AS (SELECT race_id, count(*) FILTER (WHERE status <> '出走取消') AS k, count(new_id) FILTER (WHERE status <> '出走取消') AS n_new,
                   bool_and(horse_weight IS NOT NULL) AS ready FROM card LEFT JOIN ids ON old_id = horse_id GROUP BY 1)
    SELECT race_id, k AS n_scored, n_new, ready, 1.0::DOUBLE AS total,
           CAST(CASE WHEN ready THEN 2 * least(5, k * (k - 1) // 2) + least(5, k * (k - 1)) + least(5, k * (k - 1) * (k - 2) // 6)
                                     + least(5, k * (k - 1) * (k - 2)) ELSE 0 END AS BIGINT) AS n_combinations
    FROM g WHERE k > 0""")
def _(spark, folder):
    """Per pending event: entries scored, newcomers, sum of the probabilities, and combinations of the events that are ready."""
    probabilities = stage_table(pending_scored(spark, folder)[0])
    # the star binding repeats numbers inside an event; a ticket needs one number per entry
    place = F.row_number().over(Window.partitionBy("race_id").orderBy("number", "horse_id", "owner_id"))
    tickets = scoring.pending_combinations(probabilities.withColumn("number", place)).groupBy("race_id").agg(F.count("*").alias("n_combinations"))
    events = probabilities.groupBy("race_id").agg(
        F.count("*").alias("n_scored"), F.count_if(cards.is_temporary(F.col("horse_id"))).alias("n_new"),
        F.bool_and("ready").alias("ready"), F.sum("win_prob").alias("total"))
    return events.join(tickets, "race_id", "left").select(
        "race_id", "n_scored", "n_new", "ready", r6("total"), F.coalesce("n_combinations", F.lit(0)).alias("n_combinations"))


@R.query("stored_fit_scores", CARD_SQL + """
    SELECT race_id, count(*) AS n_scored, 1.0::DOUBLE AS total, true AS same FROM card WHERE status <> '出走取消' GROUP BY 1""")
def _(spark, folder):
    """A model over the whole matrix, fitted on the history, stored, read back and applied to the pending events.

    ``same``: the model as read back scores every entry as the one that was stored.
    """
    stored, pending = pending_setup(spark, folder)
    tables = ingest.overlay(stored, pending)
    built = stage_table(matrix.feature_matrix(tables, as_of=date(2002, 1, 1), min_session_n=MIN_SESSION_N, keep=("owner_id", "number")))
    labels = T.graded_labels(stored["runners"]).select(*ID, "label")
    weights = T.sample_weights(stored["races"], {"G1": 3.0, "G2": 2.0})
    known = built.join(labels, ID).join(weights, "race_id").join(stored["races"].select("race_id", "date", "grade"), "race_id")
    fitted = stored_fit.fit(known, PENDING_FROM, ["grade"], MEMBER, flagged=F.col("grade") == "G1")
    place = f"{staging_folder(spark)}/fit-{uuid.uuid4().hex}"
    stored_fit.save(fitted, place)
    rows = built.join(pending["races"].select("race_id"), "race_id", "left_semi")
    again, _ = stored_fit.score(rows, stored_fit.load(spark, place), [], MEMBER)
    first, _ = stored_fit.score(rows, fitted, [], MEMBER)
    both = again.join(first.select(*ID, F.col("win_prob").alias("_first")), list(ID))
    return both.groupBy("race_id").agg(F.count("*").alias("n_scored"), F.sum("win_prob").alias("total"),
                                       F.bool_and(F.abs(F.col("win_prob") - F.col("_first")) < 1e-9).alias("same")).select(
        "race_id", "n_scored", r6("total"), "same")


@R.query("feature_catalogue", FULL + """
    SELECT 'F-803' AS name, 'f803_distance' AS "column", '木曜' AS timing, CAST(NULL AS INTEGER) AS minutes_before, TRUE AS event_level,
           count(*) AS n, count(*) - count(distance) AS n_null FROM entries
    UNION ALL SELECT 'F-803', 'f803_season', '木曜', NULL, TRUE, count(*), count(*) - count(date) FROM entries
    UNION ALL SELECT 'F-805', 'f805_age', '木曜', NULL, FALSE, count(*), count(*) - count(age) FROM entries""")
def _(spark, folder):
    """Declared columns that are known in time on a route, with their nulls; a same-day column without minutes is not."""
    usable = matrix.usable_columns(matrix.catalogue(spark), "本命")
    rows = X.add_entry_basics(X.add_event_description(entries(spark, folder)))
    return evaluate.null_coverage(rows, ["f803_distance", "f803_season", "f805_age", "f603_horse_weight"]).join(usable, "column")
