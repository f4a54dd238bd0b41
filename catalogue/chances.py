"""Queries over probabilities and evaluation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from strictasof.bindings import star
from strictasof.functions import vocabulary as V
from strictasof.operators import grouped as G
from strictasof.plans import bootstrap, evaluate as E, folds, matrix
from strictasof.plans import probability as P
from strictasof.plans import ranker
from strictasof.sources import prediction_log as L

from .oracle import EVENTS, FULL, IDS, MODEL, TICKETS, rnd
from .registry import Registry, r6

R = Registry()
ID = ["race_id", "horse_id", "owner_id", "number"]
TODAY = date(2001, 8, 1)
SEALED = "COALESCE(grade = 'G1' AND date BETWEEN DATE '1998-08-01' AND DATE '2001-08-01', false)"


def runners(spark, folder):
    return star.runners(spark, folder)


def scored(spark, folder):
    """Entries that ran with a score (price in 10,000s) and their graded label."""
    rows = folds.graded_labels(runners(spark, folder).join(
        star.table(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("race_id"), F.col("l_partkey").alias("horse_id"), F.col("l_suppkey").alias("owner_id"),
            F.col("l_linenumber").alias("number"), (F.col("l_extendedprice") / 10000).alias("score")), ID))
    return rows


SCORED = """, scored AS (
      SELECT l_orderkey AS race_id, l_partkey AS horse_id, l_suppkey AS owner_id, l_linenumber AS number, l_extendedprice / 10000 AS score, status,
             CASE WHEN status NOT IN ('出走', '降着') THEN 0 WHEN l_linenumber = 1 THEN 3 WHEN l_linenumber = 2 THEN 2 WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS label
      FROM raw_runners WHERE status <> '出走取消')"""
SOFT = SCORED + """, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY race_id)) AS x FROM scored),
    soft AS (SELECT *, x / sum(x) OVER (PARTITION BY race_id) AS p FROM e)"""


@R.query("group_softmax", MODEL + SOFT + f"SELECT {IDS}, {rnd('p')} AS win_prob FROM soft")
def _(spark, folder):
    return G.softmax(scored(spark, folder), "race_id", "score", "win_prob").select(*ID, r6("win_prob"))


@R.query("labels", MODEL + SCORED + f"SELECT {IDS}, CAST(label AS BIGINT) AS label FROM scored")
def _(spark, folder):
    return folds.graded_labels(runners(spark, folder)).select(*ID, F.col("label").cast("long"))


MARKET = """, priced AS (SELECT *, 1.0 / odds_win AS w FROM runners WHERE status <> '出走取消' AND odds_win IS NOT NULL),
    market AS (SELECT *, w / sum(w) OVER (PARTITION BY race_id) AS p,
                      CASE WHEN finish_pos = 1 THEN 1.0 / count(*) FILTER (WHERE finish_pos = 1) OVER (PARTITION BY race_id) ELSE 0.0 END AS y
               FROM priced)"""


@R.query("market_probability", MODEL + MARKET + f"SELECT {IDS}, {rnd('p')} AS p FROM market")
def _(spark, folder):
    return P.market_probability(runners(spark, folder)).select(*ID, r6("p"))


@R.query("tie_split_label", MODEL + MARKET + f"SELECT {IDS}, {rnd('y')} AS y FROM market")
def _(spark, folder):
    rows = P.market_probability(runners(spark, folder))
    return P.tie_split_label(rows, F.col("finish_pos") == 1).select(*ID, r6("y"))


GROUPS = MARKET + """, g AS (SELECT race_id, -sum(CASE WHEN y > 0 THEN y * ln(p) ELSE 0 END) AS ll, sum((p - y) * (p - y)) AS br, count(*) AS n FROM market GROUP BY 1),
    pick AS (SELECT race_id, finish_pos FROM (
        SELECT race_id, finish_pos, row_number() OVER (PARTITION BY race_id ORDER BY p DESC, popularity, number, owner_id) AS rn FROM market) WHERE rn = 1)"""


def decided_entries(spark, folder):
    """Popularity made unique inside an event, so that the likeliest member is always determined."""
    order = F.col("popularity") * 1_000_000 + F.col("number") * 100_000 + F.col("owner_id")
    return runners(spark, folder).withColumn("popularity", order)


@R.query("prob_metrics", MODEL + GROUPS + f"""
    SELECT CAST(count(*) AS BIGINT) AS n_races, CAST(sum(n) AS BIGINT) AS n_runners, {rnd('avg(ll)')} AS log_loss, {rnd('avg(br)')} AS brier,
           {rnd('avg(CASE WHEN finish_pos = 1 THEN 1.0 WHEN finish_pos IS NOT NULL THEN 0.0 END)')} AS top1_hit_rate,
           {rnd('avg(CASE WHEN finish_pos <= 3 THEN 1.0 WHEN finish_pos IS NOT NULL THEN 0.0 END)')} AS top3_hit_rate
    FROM g JOIN pick USING (race_id)""")
def _(spark, folder):
    m = E.probability_metrics(E.market_scores(decided_entries(spark, folder)))
    return m.select("n_races", "n_runners", r6("log_loss"), r6("brier"), r6("top1_hit_rate"), r6("top3_hit_rate"))


@R.query("group_log_loss", MODEL + SOFT + f"""
    , y AS (SELECT *, CASE WHEN label = 3 THEN 1.0 / count(*) FILTER (WHERE label = 3) OVER (PARTITION BY race_id) ELSE 0.0 END AS y FROM soft)
    SELECT race_id, {rnd('-sum(CASE WHEN y > 0 THEN y * ln(greatest(p, 1e-15)) ELSE 0 END)')} AS log_loss, count(*) AS n_runners FROM y GROUP BY 1""")
def _(spark, folder):
    rows = ranker.labelled_truth(G.softmax(scored(spark, folder), "race_id", "score", "y_pred"))
    return E.group_log_loss(rows).select("race_id", r6("log_loss"), "n_runners")


@R.query("ndcg_at_k", MODEL + SCORED + f"""
    , a AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score DESC, number) AS rs,
                   row_number() OVER (PARTITION BY race_id ORDER BY label DESC, number) AS rl FROM scored),
    g AS (SELECT race_id, sum(label / log2(rs + 1)) FILTER (WHERE rs <= 3) AS dcg, sum(label / log2(rl + 1)) FILTER (WHERE rl <= 3) AS idcg FROM a GROUP BY 1)
    SELECT race_id, {rnd('CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END')} AS ndcg FROM g""")
def _(spark, folder):
    return E.ndcg(scored(spark, folder), tie="number").select("race_id", r6("ndcg"))


GRID = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]


@R.query("temperature_grid", MODEL + SCORED + f"""
    , t AS (SELECT s.*, v.t AS temperature FROM scored s, (VALUES {", ".join(f"({t}::DOUBLE)" for t in GRID)}) v(t)),
    z AS (SELECT race_id, temperature, max(score) AS mx FROM t GROUP BY 1, 2),
    q AS (SELECT t.race_id, t.temperature, t.label, exp((score - mx) / t.temperature) AS x FROM t JOIN z USING (race_id, temperature)),
    w AS (SELECT race_id, temperature, sum(x) AS s, count(*) FILTER (WHERE label = 3) AS n FROM q GROUP BY 1, 2),
    l AS (SELECT race_id, temperature, sum(ln(greatest(x / s, 1e-15)) / n) AS lp FROM q JOIN w USING (race_id, temperature) WHERE label = 3 GROUP BY 1, 2)
    SELECT temperature, {rnd('-sum(lp) / (SELECT count(DISTINCT race_id) FROM scored)')} AS log_loss FROM l GROUP BY 1""")
def _(spark, folder):
    rows = scored(spark, folder).withColumn("is_winner", F.col("label") == 3)
    return P.temperature_losses(rows, GRID).select("temperature", r6("log_loss"))


@R.query("temperature_fit")
def _(spark, folder):
    rows = scored(spark, folder).select("race_id", "score", (F.col("label") == 3).alias("is_winner"))
    fitted = P.fit_calibrator(rows)
    return spark.createDataFrame([fitted.__dict__])


@R.query("calibrate_slice", FULL + SCORED + f"""
    , f AS (SELECT s.*, CASE year(date) WHEN 1998 THEN 2.0 WHEN 1999 THEN 0.5 END AS temp FROM scored s JOIN races USING (race_id) WHERE grade = 'G1' AND year(date) IN (1998, 1999)),
    e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY race_id)) / temp) AS x FROM f)
    SELECT {IDS}, {rnd('x / sum(x) OVER (PARTITION BY race_id)')} AS y_pred FROM e""")
def _(spark, folder):
    races = star.races(spark, folder)
    rows = scored(spark, folder).join(races.select("race_id", (F.year("date") - 1998).cast("long").alias("fold_index")), "race_id")
    temperatures = spark.createDataFrame([(0, 2.0), (1, 0.5)], "fold_index long, temperature double")
    return P.calibrate_slice(rows, temperatures, races.where("grade = 'G1'")).select(*ID, r6("y_pred"))


# --- combinations: the probabilities of the distinct numbers of an event ------------------------------------

def numbered(spark, folder):
    soft = G.softmax(scored(spark, folder), "race_id", "score", "p")
    return soft.groupBy("race_id", "number").agg(F.sum("p").alias("win_prob"))


NUMBERED = MODEL + SOFT + ", n AS (SELECT race_id, number, sum(p) AS p FROM soft GROUP BY 1, 2)"
X2 = "CASE WHEN 1 - {a}.p > 1e-12 THEN {a}.p * {b}.p / (1 - {a}.p) ELSE 0 END"
X3 = "CASE WHEN 1 - {a}.p > 1e-12 AND 1 - {a}.p - {b}.p > 1e-12 THEN {a}.p * ({b}.p / (1 - {a}.p)) * ({c}.p / (1 - {a}.p - {b}.p)) ELSE 0 END"
ALL3 = " + ".join(X3.format(a=a, b=b, c=c) for a, b, c in ("abc", "acb", "bac", "bca", "cab", "cba"))
COMBOS = {
    "combos_exacta": (V.EXACTA, "SELECT a.race_id, a.number || '-' || b.number AS comb, a.number * 100 + b.number AS o, " + X2.format(a="a", b="b") + " AS prob FROM n a JOIN n b ON a.race_id = b.race_id AND a.number <> b.number"),
    "combos_pair": (V.QUINELLA, "SELECT a.race_id, a.number || '-' || b.number AS comb, a.number * 100 + b.number AS o, " + X2.format(a="a", b="b") + " + " + X2.format(a="b", b="a") + " AS prob FROM n a JOIN n b ON a.race_id = b.race_id AND a.number < b.number"),
    "combos_trifecta": (V.TRIFECTA, "SELECT a.race_id, a.number || '-' || b.number || '-' || c.number AS comb, a.number * 10000 + b.number * 100 + c.number AS o, " + X3.format(a="a", b="b", c="c") + " AS prob FROM n a JOIN n b ON a.race_id = b.race_id AND a.number <> b.number JOIN n c ON c.race_id = a.race_id AND c.number <> a.number AND c.number <> b.number"),
    "combos_triple": (V.TRIO, "SELECT a.race_id, a.number || '-' || b.number || '-' || c.number AS comb, a.number * 10000 + b.number * 100 + c.number AS o, " + ALL3 + " AS prob FROM n a JOIN n b ON a.race_id = b.race_id AND a.number < b.number JOIN n c ON c.race_id = a.race_id AND c.number > b.number"),
    "combos_wide": (V.WIDE, "SELECT a.race_id, a.number || '-' || b.number AS comb, a.number * 100 + b.number AS o, COALESCE(sum(CASE WHEN c.number IS NOT NULL THEN " + ALL3 + " END), 0) AS prob FROM n a JOIN n b ON a.race_id = b.race_id AND a.number < b.number LEFT JOIN n c ON c.race_id = a.race_id AND c.number <> a.number AND c.number <> b.number GROUP BY 1, 2, 3"),
}


def _combos(kind):
    def run(spark, folder):
        top = P.top_combinations(numbered(spark, folder), kind, 5)
        return top.select("race_id", F.array_join(F.transform("numbers", lambda n: n.cast("string")), "-").alias("comb"), r6("prob"))
    return run


for _name, (_kind, _sql) in COMBOS.items():
    R.add(_name, _combos(_kind), NUMBERED + f""", c AS ({_sql}),
    k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY prob DESC, o) AS rank FROM c)
    SELECT race_id, comb, {rnd('prob')} AS prob FROM k WHERE rank <= 5""")


# --- tickets ------------------------------------------------------------------------------------------------

LEDGER = """, el AS (SELECT race_id, number, bool_or(popularity = 1) AS fav FROM runners WHERE status <> '出走取消' GROUP BY 1, 2),
    ev AS (SELECT race_id, count(*) AS m, min(number) FILTER (WHERE fav) AS favourite FROM el GROUP BY 1),
    tickets AS (
      SELECT race_id, 'uniform' AS strategy, t AS bet_type, CAST(number AS VARCHAR) AS comb_key FROM el, (VALUES ('単勝'), ('複勝')) v(t)
      UNION ALL SELECT race_id, 'favorite', t, CAST(favourite AS VARCHAR) FROM ev, (VALUES ('単勝'), ('複勝')) v(t) WHERE favourite IS NOT NULL
      UNION ALL SELECT a.race_id, 'uniform', 'ワイド', a.number || '-' || b.number FROM el a JOIN el b ON a.race_id = b.race_id AND a.number < b.number
      UNION ALL SELECT race_id, 'favorite', 'ワイド', least(number, favourite) || '-' || greatest(number, favourite) FROM el JOIN ev USING (race_id) WHERE number <> favourite),
    grid AS (SELECT race_id, s AS strategy, t AS bet_type FROM ev, (VALUES ('favorite'), ('uniform')) v(s), (VALUES ('単勝'), ('複勝'), ('ワイド')) w(t)),
    ledger AS (
      SELECT g.race_id, g.strategy, g.bet_type, count(k.comb_key) AS n_bets, count(p.payout) AS n_hits, 100 * count(k.comb_key) AS stake_yen,
             CAST(COALESCE(sum(p.payout), 0) AS BIGINT) AS payout_yen
      FROM grid g LEFT JOIN tickets k USING (race_id, strategy, bet_type) LEFT JOIN payouts p USING (race_id, bet_type, comb_key) GROUP BY 1, 2, 3)"""


@R.query("bet_ledger", TICKETS + LEDGER + "SELECT * FROM ledger")
def _(spark, folder):
    return E.race_ledger(runners(spark, folder), star.payouts(spark, folder))


@R.query("roi_by_slice", TICKETS + LEDGER + f"""
    SELECT strategy, bet_type, count(*) AS n_races, CAST(sum(n_bets) AS BIGINT) AS n_bets, CAST(sum(n_hits) AS BIGINT) AS n_hits,
           CAST(sum(stake_yen) AS BIGINT) AS stake_yen, CAST(sum(payout_yen) AS BIGINT) AS payout_yen, {rnd('sum(payout_yen) / sum(stake_yen)')} AS roi
    FROM ledger GROUP BY 1, 2""")
def _(spark, folder):
    out = E.returns(E.race_ledger(runners(spark, folder), star.payouts(spark, folder)))
    return out.select(*[c for c in out.columns if c != "roi"], r6("roi"))


REPORT = """, pop AS (SELECT race_id, year(date) AS year, 'all' AS population FROM races WHERE NOT {sealed}
                      UNION ALL SELECT race_id, year(date), 'g1' FROM races WHERE NOT {sealed} AND grade = 'G1'),
    pm AS (SELECT population, {by} count(*) AS n_races, avg(ll) AS log_loss, avg(br) AS brier,
                  avg(CASE WHEN finish_pos = 1 THEN 1.0 WHEN finish_pos IS NOT NULL THEN 0.0 END) AS top1_hit_rate,
                  avg(CASE WHEN finish_pos <= 3 THEN 1.0 WHEN finish_pos IS NOT NULL THEN 0.0 END) AS top3_hit_rate
           FROM g JOIN pick USING (race_id) JOIN pop USING (race_id) GROUP BY ALL),
    long AS (SELECT population, {by} 'probability' AS metric_kind, metric_name, NULL AS strategy, NULL AS bet_type, n_races, value
             FROM pm UNPIVOT (value FOR metric_name IN (log_loss, brier, top1_hit_rate, top3_hit_rate))
             UNION ALL SELECT population, {by} 'return', 'roi', strategy, bet_type, count(*), sum(payout_yen) / sum(stake_yen)
             FROM ledger JOIN pop USING (race_id) GROUP BY ALL)"""


def _report(by_year):
    def run(spark, folder):
        out = E.baseline_report(star.races(spark, folder), decided_entries(spark, folder), star.payouts(spark, folder), TODAY,
                                by_year=by_year, ledger_entries=runners(spark, folder))
        keys = [F.col("year").cast("long")] if by_year else []
        return out.select("population", *keys, "metric_kind", "metric_name", "strategy", "bet_type", "n_races", r6("value"))
    return run


for _name, _by in (("baseline_report", ""), ("baseline_by_year", "year,")):
    R.add(_name, _report(bool(_by)), TICKETS + GROUPS + LEDGER + REPORT.format(sealed=SEALED, by=_by) + f"""
    SELECT population, {'CAST(year AS BIGINT) AS year,' if _by else ''} metric_kind, metric_name, strategy, bet_type, n_races, {rnd('value')} AS value FROM long""")


@R.query("baseline_intervals", TICKETS + LEDGER + f"""
    , pop AS (SELECT race_id, 'all' AS population FROM races WHERE NOT {SEALED} UNION ALL SELECT race_id, 'g1' FROM races WHERE NOT {SEALED} AND grade = 'G1')
    SELECT population, strategy, bet_type, count(*) AS n_races, {rnd('sum(payout_yen) / sum(stake_yen)')} AS value, TRUE AS encloses
    FROM ledger JOIN pop USING (race_id) GROUP BY 1, 2, 3""")
def _(spark, folder):
    """The report's returns per population, and whether each lies in its interval."""
    out = E.baseline_report(star.races(spark, folder), runners(spark, folder), star.payouts(spark, folder), TODAY, n_boot=10_000)
    inside = F.col("value").between(F.col("ci_low"), F.col("ci_high"))
    return out.where("metric_kind = 'return'").select(
        "population", "strategy", "bet_type", "n_races", r6("value"), inside.alias("encloses"))


@R.query("bootstrap_ci")
def _(spark, folder):
    ledger = E.race_ledger(runners(spark, folder), star.payouts(spark, folder))
    return bootstrap.bootstrap_interval(ledger, F.col("payout_yen"), F.col("stake_yen"), by=["strategy", "bet_type"])


@R.query("bootstrap_encloses", TICKETS + LEDGER + f"""
    SELECT strategy, bet_type, count(*) AS n, {rnd('sum(payout_yen) / sum(stake_yen)')} AS ratio, TRUE AS encloses FROM ledger GROUP BY 1, 2""")
def _(spark, folder):
    """Units, point ratio and whether the interval encloses it, per slice."""
    ledger = E.race_ledger(runners(spark, folder), star.payouts(spark, folder))
    out = bootstrap.bootstrap_interval(ledger, F.col("payout_yen"), F.col("stake_yen"), by=["strategy", "bet_type"])
    inside = F.col("ratio").between(F.col("ci_low"), F.col("ci_high"))
    return out.select("strategy", "bet_type", "n", r6("ratio"), inside.alias("encloses"))


BOTH = GROUPS + SOFT + """, mm AS (SELECT *, CASE WHEN label = 3 THEN 1.0 / count(*) FILTER (WHERE label = 3) OVER (PARTITION BY race_id) ELSE 0.0 END AS y2 FROM soft),
    model AS (SELECT race_id, -sum(CASE WHEN y2 > 0 THEN y2 * ln(greatest(p, 1e-15)) ELSE 0 END) AS ml, count(*) AS mn FROM mm GROUP BY 1),
    cmp AS (SELECT m.*, g.ll, r.grade, year(r.date) AS year FROM model m JOIN g USING (race_id) JOIN races r USING (race_id))"""
CAPTURE = f"""count(*) AS n_races, {rnd('avg(ml)')} AS model_log_loss, {rnd('avg(ll)')} AS market_log_loss, {rnd('avg(ln(mn))')} AS uniform_log_loss,
           {rnd('(avg(ln(mn)) - avg(ml)) / (avg(ln(mn)) - avg(ll))', 4)} AS capture, avg(ml) < avg(ll) AS passes"""


def _model_losses(spark, folder):
    rows = ranker.labelled_truth(G.softmax(scored(spark, folder), "race_id", "score", "y_pred"))
    return E.group_log_loss(rows).join(star.races(spark, folder).select(
        "race_id", F.coalesce("grade", F.lit("none")).alias("grade"), F.year("date").cast("long").alias("year")), "race_id")


def _capture(by):
    def run(spark, folder):
        out = E.compare_with_market(_model_losses(spark, folder), E.market_scores(runners(spark, folder)), by)
        return out.select(*by, "n_races", r6("model_log_loss"), r6("market_log_loss"), r6("uniform_log_loss"), r6("capture", digits=4), "passes")
    return run


R.add("capture_ratio", _capture([]), MODEL + BOTH + f"SELECT {CAPTURE} FROM cmp")
R.add("slice_compare", _capture(["grade", "year"]), MODEL + BOTH + f"""
    SELECT COALESCE(grade, 'none') AS grade, CAST(year AS BIGINT) AS year, {CAPTURE} FROM cmp GROUP BY 1, 2""")


@R.query("slice_compare_ci")
def _(spark, folder):
    diff = E.paired_difference(_model_losses(spark, folder), E.market_scores(runners(spark, folder)), ["grade"])
    return bootstrap.bootstrap_interval(diff, F.col("difference"), F.lit(1), by=["grade"])


WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


def blended(spark, folder):
    market = P.market_probability(runners(spark, folder)).select(*ID, "p", "finish_pos", "status")
    model = G.softmax(scored(spark, folder), "race_id", "score", "q").select(*ID, "q")
    return P.tie_split_label(market.join(model, ID), F.col("finish_pos") == 1)


@R.query("blend_grid", MODEL + MARKET + SOFT + f"""
    , b AS (SELECT m.race_id, m.finish_pos, m.p AS a, s.p AS b, v.w FROM market m JOIN soft s USING (race_id, horse_id, owner_id, number),
            (VALUES {", ".join(f"({w}::DOUBLE)" for w in WEIGHTS)}) v(w)),
    c AS (SELECT race_id, w, finish_pos, (1 - w) * ln(greatest(a, 1e-15)) + w * ln(greatest(b, 1e-15)) AS m FROM b),
    d AS (SELECT race_id, w, ln(sum(exp(m))) AS z, avg(m) FILTER (WHERE finish_pos = 1) AS t FROM c GROUP BY 1, 2)
    SELECT w, {rnd('avg(CASE WHEN t IS NOT NULL THEN z - t ELSE 0 END)')} AS log_loss FROM d GROUP BY 1""")
def _(spark, folder):
    return E.blend_grid(blended(spark, folder), "p", "q", WEIGHTS).select("w", r6("log_loss"))


@R.query("blend_weight_ci")
def _(spark, folder):
    losses = E.blend_losses(blended(spark, folder), "p", "q", WEIGHTS)
    return bootstrap.blend_weight_interval(losses, WEIGHTS)


@R.query("completion_check", MODEL + MARKET + SOFT + f"""
    , yt AS (SELECT *, CASE WHEN label = 3 THEN 1.0 / count(*) FILTER (WHERE label = 3) OVER (PARTITION BY race_id) ELSE 0.0 END AS y FROM soft),
    md AS (SELECT race_id, -sum(CASE WHEN y > 0 THEN y * ln(greatest(p, 1e-15)) ELSE 0 END) AS ml FROM yt GROUP BY 1),
    mk AS (SELECT race_id, -sum(CASE WHEN y > 0 THEN y * ln(p) ELSE 0 END) AS ll FROM market GROUP BY 1),
    pops AS (SELECT race_id, 'all' AS population FROM races UNION ALL SELECT race_id, 'g1' FROM races WHERE grade = 'G1')
    SELECT population, count(*) AS n_races, {rnd('avg(ml)')} AS model_log_loss, {rnd('avg(ll)')} AS market_log_loss, avg(ml) < avg(ll) AS passes
    FROM md JOIN mk USING (race_id) JOIN pops USING (race_id) GROUP BY 1""")
def _(spark, folder):
    rows = ranker.labelled_truth(G.softmax(scored(spark, folder), "race_id", "score", "y_pred"))
    flagged = rows.join(star.races(spark, folder).where("grade = 'G1'"), "race_id", "left_semi")
    out = E.completion_check(rows, flagged, runners(spark, folder))
    return out.select("population", "n_races", r6("model_log_loss"), r6("market_log_loss"), "passes")


#: a model of two inputs, whose effect is that of leaving the second one out
TWO_INPUTS = ranker.Rankers(("score", "weight_carried"), {"main": [1.0, 0.1]}, {"main": 1}, {})


@R.query("ablation", MODEL + SCORED + f"""
    , s2 AS (SELECT l_orderkey AS race_id, l_linenumber AS number, COALESCE(l_extendedprice / 10000, 0) AS other,
                    COALESCE(l_extendedprice / 10000, 0) + 0.1 * COALESCE(50 + l_discount * 100, 0) AS score, CASE WHEN status IN ('出走', '降着') AND l_linenumber = 1 THEN 3 ELSE 0 END AS label
             FROM raw_runners WHERE status <> '出走取消'),
    s AS (SELECT *, exp(score) / sum(exp(score)) OVER w AS p, exp(other) / sum(exp(other)) OVER w AS q,
                 CASE WHEN label = 3 THEN 1.0 / count(*) FILTER (WHERE label = 3) OVER w ELSE 0 END AS y FROM s2 WINDOW w AS (PARTITION BY race_id)),
    g AS (SELECT race_id, -sum(CASE WHEN y > 0 THEN y * ln(p) ELSE 0 END) AS a, -sum(CASE WHEN y > 0 THEN y * ln(q) ELSE 0 END) AS b FROM s GROUP BY 1),
    ta AS (SELECT race_id, number FROM (SELECT race_id, number, row_number() OVER (PARTITION BY race_id ORDER BY score DESC, number) AS rn FROM s) WHERE rn = 1),
    tb AS (SELECT race_id, number FROM (SELECT race_id, number, row_number() OVER (PARTITION BY race_id ORDER BY other DESC, number) AS rn FROM s) WHERE rn = 1)
    SELECT count(*) AS n_races, {rnd('avg(a)')} AS log_loss, {rnd('avg(b)')} AS log_loss_without, {rnd('avg(b - a)')} AS effect,
           {rnd('avg(CASE WHEN ta.number <> tb.number THEN 1.0 ELSE 0.0 END)')} AS top_changed
    FROM g JOIN ta USING (race_id) JOIN tb USING (race_id)""")
def _(spark, folder):
    rows = ranker.labelled_truth(scored(spark, folder), "y").withColumns({
        "score": TWO_INPUTS.score("main"), "score_without": TWO_INPUTS.score("main", without=("weight_carried",)), "horse_id": F.col("number")})
    return E.ablation(rows).select("n_races", r6("log_loss"), r6("log_loss_without"), r6("effect"), r6("top_changed"))


@R.query("quantile_profile", FULL + f"""
    SELECT course, count(time_sec) AS n, {", ".join(f"{rnd(f'quantile_cont(time_sec, {q})', 4)} AS {n}" for n, q in E.PROFILE.items())}
    FROM entries GROUP BY 1""")
def _(spark, folder):
    rows = matrix.entry_frame(star.event_tables(spark, folder))
    out = G.group_quantiles(rows, ["course"], "time_sec", E.PROFILE, count="n")
    return out.select("course", "n", *[r6(n, digits=4) for n in E.PROFILE])


@R.query("quantile_profile_large_groups", FULL + f"""
    SELECT course, count(time_sec) AS n, {", ".join(f"{rnd(f'quantile_cont(time_sec, {q})', 4)} AS {n}" for n, q in E.PROFILE.items())}
    FROM entries GROUP BY 1""")
def _(spark, folder):
    """The same profile; groups of every size are read off the ranks of their values."""
    rows = matrix.entry_frame(star.event_tables(spark, folder))
    out = G.group_quantiles(rows, ["course"], "time_sec", E.PROFILE, count="n")
    return out.select("course", "n", *[r6(n, digits=4) for n in E.PROFILE])


@R.query("null_coverage", MODEL + """
    SELECT sex, n, u.column AS "column", u.n_null AS n_null FROM (
      SELECT sex, count(*) AS n, count(*) FILTER (WHERE jockey_id IS NULL) AS jockey_id, count(*) FILTER (WHERE frame IS NULL) AS frame,
             count(*) FILTER (WHERE horse_weight IS NULL) AS horse_weight FROM runners GROUP BY 1)
    UNPIVOT (n_null FOR "column" IN (jockey_id, frame, horse_weight)) u""")
def _(spark, folder):
    return E.null_coverage(runners(spark, folder), ["jockey_id", "frame", "horse_weight"], ["sex"])


# --- logged picks ---------------------------------------------------------------------------------------------

def prediction_records(spark, folder):
    """One record per event and customer segment: a place pick on number 2 and a wide pick on 1 and 3."""
    races = star.races(spark, folder)
    pick = lambda kind, numbers, stake: F.struct(
        F.lit(kind).alias("bet_type"), F.array(*[F.lit(n) for n in numbers]).alias("horse_numbers"), stake.alias("stake"), F.lit("").alias("note"))
    stake = (F.col("race_number") * 1.0)
    return races.select(
        "race_id", F.col("date").cast("string").alias("race_date"), F.col("date").cast("string").alias("logged_at"),
        F.col("weather").alias("agent"), F.lit("").alias("confidence"), F.lit("").alias("reasoning"),
        F.lit(None).cast("map<string,double>").alias("model_probs"), (F.col("surface") == "O").alias("weight_confirmed"),
        F.array(pick(V.PLACE, [2], stake), pick(V.WIDE, [3, 1], F.lit(1.0))).alias("picks"))


PICKS = """, picks AS (SELECT race_id, '複勝' AS bet_type, '2' AS k, race_number * 1.0 AS stake FROM races UNION ALL SELECT race_id, 'ワイド', '1-3', 1.0 FROM races),
    settled AS (SELECT DISTINCT race_id FROM runners WHERE finish_pos IS NOT NULL),
    bets AS (SELECT p.race_id, p.bet_type, CAST(p.stake AS DOUBLE) AS stake, COALESCE(o.payout, 0) / 100.0 AS ratio
             FROM picks p JOIN settled USING (race_id) LEFT JOIN payouts o ON o.race_id = p.race_id AND o.bet_type = p.bet_type AND o.comb_key = p.k)"""


@R.query("score_picks", TICKETS + PICKS + f"""
    SELECT bet_type, count(*) AS n_bets, {rnd('sum(ratio * stake) / sum(stake)')} AS roi, {rnd('avg(CASE WHEN ratio * stake > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate
    FROM bets GROUP BY GROUPING SETS ((bet_type), ())""")
def _(spark, folder):
    picks = L.settled_picks(prediction_records(spark, folder), runners(spark, folder), star.payouts(spark, folder))
    return L.score_summary(picks).select("bet_type", "n_bets", r6("roi"), r6("hit_rate"))


@R.query("score_picks_ci", TICKETS + PICKS + f"""
    SELECT bet_type, count(*) AS n_bets, {rnd('sum(ratio * stake) / sum(stake)')} AS roi, TRUE AS encloses
    FROM bets GROUP BY GROUPING SETS ((bet_type), ())""")
def _(spark, folder):
    """Bets and return per ticket type and overall, and whether the interval encloses the return."""
    picks = L.settled_picks(prediction_records(spark, folder), runners(spark, folder), star.payouts(spark, folder))
    inside = F.col("roi").between(F.col("ci_low"), F.col("ci_high"))
    return L.score_intervals(picks).select("bet_type", "n_bets", r6("roi"), inside.alias("encloses"))


@R.query("score_warnings", TICKETS + """
    SELECT count(DISTINCT r.race_id) AS n_races_logged, count(DISTINCT u.race_id) AS n_races_settled,
           count(*) FILTER (WHERE surface <> 'O') AS n_weight_unconfirmed
    FROM races r LEFT JOIN (SELECT DISTINCT race_id FROM runners WHERE finish_pos IS NOT NULL) u USING (race_id)""")
def _(spark, folder):
    return L.log_warnings(prediction_records(spark, folder), runners(spark, folder))


@R.query("list_predictions", EVENTS + """
    SELECT race_id, CAST(date AS VARCHAR) AS race_date, weather AS agent, '' AS confidence, CAST(2 AS BIGINT) AS n_picks,
           CAST(date AS VARCHAR) AS logged_at, surface = 'O' AS weight_confirmed FROM races WHERE weather = 'BUILDING'""")
def _(spark, folder):
    return L.list_log(prediction_records(spark, folder), "BUILDING").withColumn("n_picks", F.col("n_picks").cast("long"))


@R.query("append_predictions", MODEL + """
    , settled AS (SELECT DISTINCT race_id FROM runners WHERE finish_pos IS NOT NULL)
    SELECT r.race_id, r.weather AS agent, CASE WHEN s.race_id IS NOT NULL THEN 'outcome already known'
           WHEN r.weather = 'BUILDING' THEN 'already logged' END AS reason
    FROM races r LEFT JOIN settled s USING (race_id)""")
def _(spark, folder):
    new = prediction_records(spark, folder)
    accepted, rejected = L.accept_records(new, new.where(F.col("agent") == "BUILDING"), runners(spark, folder))
    return accepted.withColumn("reason", F.lit(None).cast("string")).select("race_id", "agent", "reason").unionByName(
        rejected.select("race_id", "agent", "reason"))
