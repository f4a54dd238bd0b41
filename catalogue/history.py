"""Queries over the history operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strictasof.bindings import star
from strictasof.operators import encode as E
from strictasof.operators import features as X
from strictasof.operators import grouped as G
from strictasof.operators import prior as P
from strictasof.operators import speed
from strictasof.operators.ranks import value_ranks
from strictasof.functions import scalars as S
from strictasof.plans import matrix
from strictasof.session import release, stage_table

from .oracle import FULL, IDS, rnd
from .registry import Registry, r6

R = Registry()
ID = ["race_id", "horse_id", "owner_id", "number"]
BEFORE = "ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"
SESSION_BEFORE = ("(PARTITION BY date, course, surface ORDER BY race_number "
                  "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def entries(spark, folder):
    return matrix.entry_frame(star.event_tables(spark, folder))


def over(keys: str) -> str:
    return f"(PARTITION BY {keys} {BEFORE})" if keys else f"({BEFORE})"


def shrunk(total: str, n: str, mu: str, k: float = 5.0) -> str:
    return f"CASE WHEN {n} > 0 THEN ({total} + {k} * {mu}) / ({n} + {k}) ELSE {mu} END"


def encode_sql(entity: str, condition: str, where: str, known: str, out: str, extra: str = "") -> str:
    keys = ", ".join(filter(None, [entity, condition]))
    return FULL + f"""
    , facts AS (SELECT *, CASE WHEN {where} THEN perf END AS v FROM entries),
    p AS (SELECT *, COALESCE(sum(v) OVER c / NULLIF(count(v) OVER c, 0), 0.5) AS mu,
                 sum(v) OVER e AS s, count(v) OVER e AS n
          FROM facts WINDOW c AS {over(condition)}, e AS {over(keys)})
    SELECT {IDS}, {rnd(f"CASE WHEN {known} THEN {shrunk('s', 'n', 'mu')} END")} AS {out},
           CAST(CASE WHEN {known} THEN 0 ELSE 1 END AS BIGINT) AS {out}_unavailable {extra}
    FROM p"""


# --- shrunken conditional means ---------------------------------------------------------------------------

@R.query("pit_target_encode_partner", encode_sql(
    "jockey_id", "course, band", "finish_pos IS NOT NULL AND jockey_id IS NOT NULL", "jockey_id IS NOT NULL", "f704"))
def _(spark, folder):
    rows = X.add_partner_course_encoding(entries(spark, folder))
    return rows.select(*ID, r6("f704"), F.col("f704_unavailable").cast("long"))


@R.query("pit_target_encode_frame", encode_sql(
    "frame", "course, band, n_starters", "finish_pos IS NOT NULL AND frame IS NOT NULL", "frame IS NOT NULL", "f801"))
def _(spark, folder):
    rows = X.add_frame_bias(entries(spark, folder))
    return rows.select(*ID, r6("f801"), F.col("f801_unavailable").cast("long"))


@R.query("pit_target_encode_entity", encode_sql("horse_id", "course, band", "finish_pos IS NOT NULL", "true", "f802"))
def _(spark, folder):
    rows = X.add_course_aptitude(entries(spark, folder))
    return rows.select(*ID, r6("f802"), F.lit(0).cast("long").alias("f802_unavailable"))


@R.query("pit_target_encode_parents", FULL + f"""
    , p AS (SELECT *, COALESCE(sum(perf) OVER c / NULLIF(count(perf) OVER c, 0), 0.5) AS mu,
                   sum(perf) OVER a AS sa, count(perf) OVER a AS na, sum(perf) OVER b AS sb, count(perf) OVER b AS nb
            FROM entries WINDOW c AS {over('surface, band')}, a AS {over('sire_id, surface, band')},
                 b AS {over('damsire_id, surface, band')})
    SELECT {IDS},
           {rnd(f"CASE WHEN sire_id IS NOT NULL THEN {shrunk('sa', 'na', 'mu')} END")} AS f202_sire,
           CAST(CASE WHEN sire_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f202_sire_unavailable,
           {rnd(f"CASE WHEN damsire_id IS NOT NULL THEN {shrunk('sb', 'nb', 'mu')} END")} AS f202_damsire,
           CAST(CASE WHEN damsire_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f202_damsire_unavailable
    FROM p""")
def _(spark, folder):
    rows = X.add_blood_encoding(entries(spark, folder))
    return rows.select(*ID, r6("f202_sire"), F.col("f202_sire_unavailable").cast("long"),
                       r6("f202_damsire"), F.col("f202_damsire_unavailable").cast("long"))


@R.query("pit_target_encode_pair", encode_sql(
    "sire_id, damsire_id", "", "finish_pos IS NOT NULL AND sire_id IS NOT NULL AND damsire_id IS NOT NULL",
    "sire_id IS NOT NULL AND damsire_id IS NOT NULL", "f811_nick",
    ", CAST(CASE WHEN sire_id IS NOT NULL AND damsire_id IS NOT NULL THEN n ELSE 0 END AS DOUBLE) AS f811_nick_n"))
def _(spark, folder):
    rows = X.add_cross_encoding(entries(spark, folder))
    return rows.select(*ID, r6("f811_nick"), F.col("f811_nick_unavailable").cast("long"), "f811_nick_n")


@R.query("pit_global_prior", FULL + f"""
    SELECT {IDS}, {rnd("sum(last_3f) OVER w / NULLIF(count(last_3f) OVER w, 0)")} AS mu,
           CAST(count(last_3f) OVER w AS BIGINT) AS n
    FROM entries WINDOW w AS {over('')}""")
def _(spark, folder):
    seen = {"s": P.running_sum(F.col("last_3f")), "n": P.running_count(F.col("last_3f").isNotNull())}
    rows = P.with_prior(entries(spark, folder), [], "date", seen)
    return rows.select(*ID, r6(F.col("s") / F.nullif(F.col("n"), F.lit(0)), "mu"), "n")


@R.query("asof_attach", FULL + f"""
    , versions AS (SELECT DISTINCT horse_id, date AS as_of FROM entries WHERE finish_pos = 1),
    valued AS (SELECT v.horse_id, v.as_of, count(*) AS effect FROM versions v
               JOIN entries e ON e.horse_id = v.horse_id AND e.date <= v.as_of GROUP BY 1, 2)
    SELECT e.race_id, e.horse_id, e.owner_id, e.number, v.effect AS f302,
           CAST(CASE WHEN v.effect IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f302_unavailable
    FROM entries e ASOF LEFT JOIN valued v ON e.horse_id = v.horse_id AND e.date > v.as_of""")
def _(spark, folder):
    rows = entries(spark, folder)
    days = rows.groupBy("horse_id", "date").agg(F.count("*").alias("c"), F.count_if(F.col("finish_pos") == 1).alias("w"))
    versions = P.with_prior(days, ["horse_id"], "date", {"before": P.running_sum(F.col("c"))}).where("w > 0").select(
        "horse_id", F.col("date").alias("as_of"), (F.coalesce("before", F.lit(0)) + F.col("c")).alias("effect"))
    out = P.asof_attach(rows, versions, ["horse_id"], "date", "effect", "f302")
    return out.select(*ID, "f302", F.col("f302_unavailable").cast("long"))


# --- quantiles, slopes, residuals -------------------------------------------------------------------------

QUANTILE_SQL = f"""
    , ratios AS (SELECT *, CASE WHEN list_position(corner_nos, 1) IS NOT NULL
                          THEN CAST(list_extract(corners, list_position(corner_nos, 1)) AS DOUBLE) / n_starters END AS ratio
                 FROM entries),
    lead AS (SELECT *, quantile_cont(ratio, 0.25) OVER w AS f101, count(*) OVER w AS starts, count(ratio) OVER w AS usable
             FROM ratios WINDOW w AS {over('horse_id')})"""


@R.query("pit_quantile", FULL + QUANTILE_SQL + f"""
    SELECT {IDS}, {rnd('f101')} AS f101,
           CAST(CASE WHEN f101 IS NULL AND starts > 0 AND usable = 0 THEN 1 ELSE 0 END AS BIGINT) AS f101_unavailable
    FROM lead""")
def _(spark, folder):
    rows = X.add_lead_quantile(entries(spark, folder))
    return rows.select(*ID, r6("f101"), F.col("f101_unavailable").cast("long"))


PACE_SQL = QUANTILE_SQL + f"""
    , pressure AS (
      SELECT l.*, 1 - (sum(f101) OVER g - COALESCE(sum(f101) OVER o, 0))
                      / NULLIF(count(f101) OVER g - count(f101) OVER o, 0) AS x,
             CASE margin WHEN 'ハナ' THEN 0.05 WHEN 'クビ' THEN 0.2 WHEN '1.1/2' THEN 1.5 WHEN '3/4' THEN 0.75
                  WHEN '2' THEN 2.0 WHEN '大' THEN 10.0 WHEN 'アタマ' THEN 0.1 END AS y
      FROM lead l WINDOW g AS (PARTITION BY race_id), o AS (PARTITION BY race_id, horse_id)),
    pairs AS (
      SELECT t.race_id, t.horse_id, t.owner_id, t.number, t.date, max(t.starts) AS starts, count(h.x) AS m,
             regr_slope(h.y, h.x) AS slope, regr_sxx(h.y, h.x) AS sxx
      FROM pressure t LEFT JOIN pressure h
        ON h.horse_id = t.horse_id AND h.date < t.date AND h.x IS NOT NULL AND h.y IS NOT NULL
      GROUP BY 1, 2, 3, 4, 5),
    betas AS (SELECT *, CASE WHEN m >= 2 AND sxx >= 1e-6 THEN slope END AS beta FROM pairs),
    pace AS (SELECT *, COALESCE(sum(beta) OVER w / NULLIF(count(beta) OVER w, 0), 0) AS mu
             FROM betas WINDOW w AS {over('')})"""


@R.query("pit_regression", FULL + PACE_SQL + f"""
    SELECT {IDS}, {rnd(f"CASE WHEN beta IS NOT NULL THEN (m * beta + 5 * mu) / (m + 5) END", 5)} AS f103,
           CAST(CASE WHEN beta IS NULL AND starts > 0 THEN 1 ELSE 0 END AS BIGINT) AS f103_unavailable
    FROM pace""")
def _(spark, folder):
    rows = stage_table(entries(spark, folder).select(*ID, "date", "margin", "corners", "corner_nos", "n_starters"))
    led = stage_table(X.add_lead_quantile(rows).select(*ID, "date", "margin", "f101"))
    release(rows)
    rows = X.add_pace_aptitude(stage_table(X.with_pace_pair(led).drop("margin", "f101")))
    return rows.select(*ID, r6("f103", digits=5), F.col("f103_unavailable").cast("long"))


@R.query("pit_residual_rating", FULL + f"""
    , seen AS (SELECT *, CASE WHEN popularity IS NOT NULL THEN CAST(finish_pos AS DOUBLE) END AS v FROM entries),
    res AS (SELECT *, v - sum(v) OVER w / NULLIF(count(v) OVER w, 0) AS res
            FROM seen WINDOW w AS {over('popularity')}),
    p AS (SELECT *, COALESCE(sum(res) OVER g / NULLIF(count(res) OVER g, 0), 0) AS mu,
                 sum(res) OVER j AS s, count(res) OVER j AS n
          FROM res WINDOW g AS {over('')}, j AS {over('jockey_id')})
    SELECT {IDS}, {rnd(f"CASE WHEN jockey_id IS NOT NULL THEN {shrunk('s', 'n', 'mu')} END")} AS f701,
           CAST(CASE WHEN jockey_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f701_unavailable
    FROM p""")
def _(spark, folder):
    rows = X.add_partner_rating(entries(spark, folder))
    return rows.select(*ID, r6("f701"), F.col("f701_unavailable").cast("long"))


# --- previous event and career ----------------------------------------------------------------------------

RANKED_SQL = """
    , last3f AS (SELECT race_id, horse_id, owner_id, number,
                        (rank() OVER (PARTITION BY race_id ORDER BY last_3f)
                         + (count(*) OVER (PARTITION BY race_id, last_3f) - 1) / 2.0) / n_starters AS last_3f_rank
                 FROM entries WHERE last_3f IS NOT NULL),
    ranked AS (SELECT e.*, l.last_3f_rank FROM entries e LEFT JOIN last3f l USING (race_id, horse_id, owner_id, number))"""

PREV_SQL = RANKED_SQL + """
    , pairs AS (
      SELECT t.race_id AS t_race, t.horse_id AS t_horse, t.owner_id AS t_owner, t.number AS t_number, h.*,
             row_number() OVER (PARTITION BY t.race_id, t.horse_id, t.owner_id, t.number
                                ORDER BY h.date DESC, h.race_id DESC, h.number DESC, h.owner_id DESC) AS rn
      FROM entries t JOIN ranked h ON h.horse_id = t.horse_id AND h.date < t.date {where}),
    prev AS (SELECT * FROM pairs WHERE rn = 1)"""
PREV_JOIN = """FROM entries e LEFT JOIN prev p
      ON p.t_race = e.race_id AND p.t_horse = e.horse_id AND p.t_owner = e.owner_id AND p.t_number = e.number"""
E_IDS = "e.race_id, e.horse_id, e.owner_id, e.number"
MARGIN = ("CASE p.margin WHEN 'ハナ' THEN 0.05 WHEN 'クビ' THEN 0.2 WHEN '1.1/2' THEN 1.5 WHEN '3/4' THEN 0.75 "
          "WHEN '2' THEN 2.0 WHEN '大' THEN 10.0 WHEN 'アタマ' THEN 0.1 END")
PREV_RESULT = f"""
    SELECT {E_IDS}, CAST(p.finish_pos AS DOUBLE) AS f601_finish_pos_prev, CAST({MARGIN} AS DOUBLE) AS f601_margin_prev,
           {rnd('p.last_3f_rank')} AS f601_last3f_rank_prev,
           CAST(CASE WHEN p.rn IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f601_finish_pos_prev_unavailable
    {PREV_JOIN}"""


def previous_result(spark, folder, **options):
    rows = X.add_features(X.with_last_3f_rank(entries(spark, folder)), [X.previous_result(**options)])
    return rows.select(*ID, "f601_finish_pos_prev", "f601_margin_prev", r6("f601_last3f_rank_prev"),
                       F.col("f601_finish_pos_prev_unavailable").cast("long"))


R.add("prev_event", previous_result, FULL + PREV_SQL.format(where="") + PREV_RESULT)
R.add("prev_event_without_relegated", lambda s, f: previous_result(s, f, exclude_relegated=True),
      FULL + PREV_SQL.format(where="AND h.status <> '降着'") + PREV_RESULT)


@R.query("recency", FULL + PREV_SQL.format(where="") + f"""
    SELECT {E_IDS}, p.grade AS f602_prev_grade, {rnd('date_diff(\'day\', p.date, e.date) / 7.0')} AS f602_weeks_since_last,
           CAST(CASE WHEN p.rn IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f602_prev_grade_unavailable
    {PREV_JOIN}""")
def _(spark, folder):
    rows = X.add_features(entries(spark, folder), [X.recency()])
    return rows.select(*ID, "f602_prev_grade", r6("f602_weeks_since_last"),
                       F.col("f602_prev_grade_unavailable").cast("long"))


@R.query("partner_history", FULL + PREV_SQL.format(where="") + f"""
    , exp AS (SELECT {IDS}, count(*) OVER {over('horse_id, jockey_id')} AS n FROM entries)
    SELECT {E_IDS},
           CAST(CASE WHEN p.jockey_id IS NOT NULL THEN CAST(p.jockey_id <> e.jockey_id AS INTEGER) END AS BIGINT) AS f702_jockey_changed,
           CAST(CASE WHEN p.jockey_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f702_jockey_changed_unavailable,
           CAST(CASE WHEN e.jockey_id IS NULL THEN 0 ELSE x.n END AS BIGINT) AS f702_jockey_experience_count
    {PREV_JOIN} JOIN exp x ON x.race_id = e.race_id AND x.horse_id = e.horse_id AND x.owner_id = e.owner_id AND x.number = e.number""")
def _(spark, folder):
    rows = X.add_features(entries(spark, folder), [X.partner_change()])
    return rows.select(*ID, *[F.col(c).cast("long") for c in (
        "f702_jockey_changed", "f702_jockey_changed_unavailable", "f702_jockey_experience_count")])


@R.query("condition_change", FULL + PREV_SQL.format(where="AND h.status <> '出走取消'") + f"""
    SELECT {E_IDS}, CAST(p.distance AS DOUBLE) AS f807_prev_distance, p.surface AS f807_prev_surface,
           p.course AS f807_prev_course, CAST(p.n_starters AS DOUBLE) AS f807_prev_n_starters,
           CAST(e.distance - p.distance AS DOUBLE) AS f807_distance_diff,
           CASE WHEN p.rn IS NULL THEN NULL WHEN e.surface <> p.surface THEN 1.0 ELSE 0.0 END::DOUBLE AS f807_surface_changed,
           CASE WHEN p.rn IS NULL THEN NULL WHEN e.direction IS DISTINCT FROM p.direction THEN 1.0 ELSE 0.0 END::DOUBLE AS f807_direction_changed,
           CASE WHEN p.rn IS NULL THEN NULL WHEN e.course <> p.course THEN 1.0 ELSE 0.0 END::DOUBLE AS f807_course_changed,
           CAST(e.n_starters - p.n_starters AS DOUBLE) AS f807_n_starters_diff
    {PREV_JOIN}""")
def _(spark, folder):
    rows = X.add_features(entries(spark, folder), [X.condition_change()])
    return rows.select(*ID, *[c for c in rows.columns if c.startswith("f807_")])


@R.query("pair_history", FULL + f"""
    , seen AS (SELECT *, CASE WHEN status IN ('出走', '降着') THEN perf END AS v,
                      CASE WHEN status IN ('出走', '降着') AND finish_pos IS NOT NULL
                           THEN CASE WHEN finish_pos = 1 THEN 1.0 ELSE 0.0 END END AS win FROM entries),
    p AS (SELECT *, avg(v) OVER w AS a, min(v) OVER w AS b, avg(win) OVER w AS c FROM seen
          WINDOW w AS {over('jockey_id, horse_id')})
    SELECT {IDS}, {rnd('CASE WHEN jockey_id IS NOT NULL THEN a END')} AS f808_relfinish_mean,
           {rnd('CASE WHEN jockey_id IS NOT NULL THEN b END')} AS f808_relfinish_best,
           {rnd('CASE WHEN jockey_id IS NOT NULL THEN c END')} AS f808_win_rate FROM p""")
def _(spark, folder):
    rows = X.add_features(entries(spark, folder), [X.pair_history()])
    return rows.select(*ID, r6("f808_relfinish_mean"), r6("f808_relfinish_best"), r6("f808_win_rate"))


@R.query("career_rates", FULL + f"""
    , p AS (SELECT *, count(finish_pos) OVER w AS n, count(*) FILTER (WHERE finish_pos = 1) OVER w AS w1,
                   count(*) FILTER (WHERE finish_pos <= 3) OVER w AS w3
            FROM entries WINDOW w AS {over('horse_id')})
    SELECT {IDS}, {rnd('CASE WHEN n > 0 THEN w1 / n END')} AS f809_win_rate,
           {rnd('CASE WHEN n > 0 THEN w3 / n END')} AS f809_top3_rate FROM p""")
def _(spark, folder):
    rows = X.add_features(entries(spark, folder), [X.career_rates()])
    return rows.select(*ID, r6("f809_win_rate"), r6("f809_top3_rate"))


@R.query("main_partner", FULL + f"""
    , days AS (SELECT trainer_id, jockey_id, date, count(*) AS c FROM entries
               WHERE trainer_id IS NOT NULL AND jockey_id IS NOT NULL GROUP BY 1, 2, 3),
    targets AS (SELECT DISTINCT trainer_id, date FROM entries),
    counted AS (SELECT t.trainer_id, t.date, d.jockey_id, sum(d.c) AS n
                FROM targets t JOIN days d ON d.trainer_id = t.trainer_id AND d.date < t.date GROUP BY 1, 2, 3),
    main AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY trainer_id, date ORDER BY n DESC, jockey_id) = 1)
    SELECT {E_IDS}, CAST(CASE WHEN m.jockey_id IS NOT NULL THEN CAST(m.jockey_id = e.jockey_id AS INTEGER) END AS BIGINT) AS f703_main_jockey_flag,
           CAST(CASE WHEN m.jockey_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f703_main_jockey_flag_unavailable,
           CAST(m.jockey_id AS BIGINT) AS main_partner
    FROM entries e LEFT JOIN main m ON m.trainer_id = e.trainer_id AND m.date = e.date""")
def _(spark, folder):
    rows = entries(spark, folder)
    rows = E.main_partner(X.add_stable_intent(rows), "trainer_id", "jockey_id", source=rows)
    return rows.select(*ID, F.col("f703_main_jockey_flag").cast("long"),
                       F.col("f703_main_jockey_flag_unavailable").cast("long"), "main_partner")


@R.query("home_flag", FULL + f"""
    SELECT {IDS}, CAST(CASE affiliation
             WHEN '東' THEN CASE WHEN course IN ('東京', '中山', '新潟', '福島', '札幌', '函館') THEN 0 ELSE 1 END
             WHEN '西' THEN CASE WHEN course IN ('阪神', '京都', '中京', '小倉') THEN 0 ELSE 1 END END AS BIGINT) AS travel
    FROM (SELECT * REPLACE (CASE course WHEN 'ASIA' THEN '東京' WHEN 'EUROPE' THEN '京都' ELSE course END AS course) FROM entries)""")
def _(spark, folder):
    named = F.when(F.col("course") == "ASIA", "東京").when(F.col("course") == "EUROPE", "京都").otherwise(F.col("course"))
    rows = entries(spark, folder).withColumn("course", named)
    return rows.select(*ID, S.home_away(F.col("affiliation"), F.col("course")).cast("long").alias("travel"))


@R.query("final_section", FULL + RANKED_SQL + f"""
    , hist AS (SELECT t.race_id, t.horse_id, t.owner_id, t.number, h.last_3f, h.last_3f_rank,
                      row_number() OVER (PARTITION BY t.race_id, t.horse_id, t.owner_id, t.number
                          ORDER BY h.date DESC, h.race_id DESC, h.number DESC, h.owner_id DESC) AS rn
               FROM entries t JOIN ranked h ON h.horse_id = t.horse_id AND h.date < t.date AND h.last_3f IS NOT NULL),
    agg AS (SELECT race_id, horse_id, owner_id, number, count(*) AS n, avg(last_3f) AS a,
                   count(*) FILTER (WHERE rn <= 5) AS n5, avg(last_3f) FILTER (WHERE rn <= 5) AS a5, avg(last_3f_rank) AS ar
            FROM hist GROUP BY 1, 2, 3, 4),
    mu AS (SELECT *, sum(last_3f) OVER g / NULLIF(count(last_3f) OVER g, 0) AS mu, count(*) OVER w AS starts
           FROM entries WINDOW g AS {over('')}, w AS {over('horse_id')})
    SELECT {IDS}, {rnd('(n * a + 5 * mu) / (n + 5)')} AS last3f_all, {rnd('(n5 * a5 + 5 * mu) / (n5 + 5)')} AS last3f_recent,
           {rnd('ar')} AS last3f_rank_in_race,
           CAST(CASE WHEN starts > 0 AND n IS NULL THEN 1 ELSE 0 END AS BIGINT) AS last3f_all_unavailable
    FROM mu LEFT JOIN agg USING (race_id, horse_id, owner_id, number)""")
def _(spark, folder):
    rows = stage_table(entries(spark, folder).select(*ID, "date", "last_3f", "n_starters"))
    rows = X.add_final_section(stage_table(X.with_last_3f_rank(rows)))
    return rows.select(*ID, r6("last3f_all"), r6("last3f_recent"), r6("last3f_rank_in_race"),
                       F.col("last3f_all_unavailable").cast("long"))


@R.query("full_and_recent", FULL + f"""
    , hist AS (SELECT t.race_id, t.horse_id, t.owner_id, t.number, h.time_sec,
                      row_number() OVER (PARTITION BY t.race_id, t.horse_id, t.owner_id, t.number
                          ORDER BY h.date DESC, h.race_id DESC, h.number DESC, h.owner_id DESC) AS rn
               FROM entries t JOIN entries h ON h.horse_id = t.horse_id AND h.date < t.date AND h.time_sec IS NOT NULL)
    SELECT {IDS}, CAST(count(*) AS BIGINT) AS n_all, {rnd('avg(time_sec)')} AS time_all,
           CAST(count(*) FILTER (WHERE rn <= 4) AS BIGINT) AS n_recent, {rnd('avg(time_sec) FILTER (WHERE rn <= 4)')} AS time_recent
    FROM hist GROUP BY 1, 2, 3, 4""")
def _(spark, folder):
    rows = entries(spark, folder)
    seen = F.col("time_sec").isNotNull()
    rows = P.with_prior(rows, ["horse_id"], "date", {"s": P.running_sum(F.col("time_sec")), "n_all": P.running_count(seen)})
    rows = P.with_recent(rows, ["horse_id"], "date", X.TIE, F.col("time_sec"), 4, "recent").where("n_all > 0")
    return rows.select(*ID, "n_all", r6(F.col("s") / F.col("n_all"), "time_all"),
                       F.size("recent").cast("long").alias("n_recent"), r6(P.mean_of_array(F.col("recent")), "time_recent"))


# --- speed index and sessions -----------------------------------------------------------------------------

SPEED_SQL = """
    , timed AS (SELECT *, date_trunc('month', date) AS mo, COALESCE(grade, race_class, 'その他') AS ck
                FROM entries WHERE status IN ('出走', '降着') AND time_sec IS NOT NULL),
    mc AS (SELECT surface, distance, ck, mo, sum(time_sec) AS s, sum(time_sec * time_sec) AS q, count(*) AS n FROM timed GROUP BY 1, 2, 3, 4),
    cc AS (SELECT surface, distance, ck, mo, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER w AS n FROM mc
           WINDOW w AS (PARTITION BY surface, distance, ck ORDER BY mo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    mf AS (SELECT surface, distance, mo, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM mc GROUP BY 1, 2, 3),
    cf AS (SELECT surface, distance, mo, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER w AS n FROM mf
           WINDOW w AS (PARTITION BY surface, distance ORDER BY mo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    resid AS (SELECT t.*, t.time_sec - COALESCE(c.s / c.n, f.s / f.n) AS e,
                     CASE WHEN c.n IS NOT NULL THEN sqrt(greatest(c.q / c.n - (c.s / c.n) * (c.s / c.n), 0))
                          ELSE sqrt(greatest(f.q / f.n - (f.s / f.n) * (f.s / f.n), 0)) END AS sd
              FROM timed t
              LEFT JOIN cc c ON c.surface = t.surface AND c.distance = t.distance AND c.ck = t.ck AND c.mo = t.mo AND c.n >= 20
              LEFT JOIN cf f ON f.surface = t.surface AND f.distance = t.distance AND f.mo = t.mo AND f.n >= 20
              WHERE COALESCE(c.n, f.n) IS NOT NULL),
    tv AS (SELECT date, course, surface, median(e) AS tv, count(*) AS tv_n FROM resid GROUP BY 1, 2, 3),
    spd AS (SELECT r.race_id, r.horse_id, r.owner_id, r.number, -(r.e - tv.tv) / r.sd AS spd
            FROM resid r JOIN tv USING (date, course, surface) WHERE r.sd > 0 AND tv.tv_n >= 2)"""
MIN_SESSION_N = 2  # sessions of the star binding are small


def with_speed(spark, folder):
    return speed.with_speed_index(entries(spark, folder), min_session_n=MIN_SESSION_N)


def speed_facts(spark, folder):
    """A stored table of the entries' ids, date, status and speed index. The index reads its inputs several times, so they
    are stored too, and nothing else is."""
    rows = stage_table(entries(spark, folder).select(*ID, "date", "course", "surface", "distance", "grade", "race_class", "status", "time_sec"))
    facts = stage_table(speed.with_speed_index(rows, min_session_n=MIN_SESSION_N).select(*ID, "date", "status", "spd"))
    release(rows)
    return facts


@R.query("speed_index", FULL + SPEED_SQL + f"SELECT {IDS}, {rnd('spd')} AS spd FROM spd")
def _(spark, folder):
    return with_speed(spark, folder).where(F.col("spd").isNotNull()).select(*ID, r6("spd"))


@R.query("speed_history", FULL + SPEED_SQL + f"""
    , clipped AS (SELECT s.*, greatest(least(spd, 5), -5) AS c, e.date FROM spd s JOIN entries e USING (race_id, horse_id, owner_id, number)),
    past AS (SELECT t.race_id, t.horse_id, t.owner_id, t.number, c.c,
                    row_number() OVER (PARTITION BY t.race_id, t.horse_id, t.owner_id, t.number
                        ORDER BY c.date DESC, c.race_id DESC, c.number DESC, c.owner_id DESC) AS rn
             FROM entries t JOIN clipped c ON c.horse_id = t.horse_id AND c.date < t.date),
    agg AS (SELECT race_id, horse_id, owner_id, number, max(c) AS b, avg(c) AS m, max(c) FILTER (WHERE rn = 1) AS l,
                   avg(c) FILTER (WHERE rn <= 3) AS r3, count(*) AS n FROM past GROUP BY 1, 2, 3, 4),
    starts AS (SELECT {IDS}, count(*) OVER {over('horse_id')} AS starts FROM entries)
    SELECT {IDS}, {rnd('b')} AS fspd_best, {rnd('m')} AS fspd_mean, {rnd('l')} AS fspd_last, {rnd('r3')} AS fspd_recent3,
           CAST(COALESCE(n, 0) AS DOUBLE) AS fspd_n,
           CAST(CASE WHEN starts > 0 AND b IS NULL THEN 1 ELSE 0 END AS BIGINT) AS fspd_unavailable
    FROM starts LEFT JOIN agg USING (race_id, horse_id, owner_id, number)""")
def _(spark, folder):
    facts = speed_facts(spark, folder)
    rows = X.add_recent_speed(X.add_features(facts, [X.speed_history()]), source=facts)
    return rows.select(*ID, r6("fspd_best"), r6("fspd_mean"), r6("fspd_last"), r6("fspd_recent3"), "fspd_n",
                       F.col("fspd_unavailable").cast("long"))


@R.query("opponent_strength", FULL + SPEED_SQL + f"""
    , clipped AS (SELECT race_id, horse_id, greatest(least(spd, 5), -5) AS c FROM spd),
    opp AS (SELECT t.race_id, t.horse_id, t.owner_id, t.number, c.c
            FROM entries t JOIN entries m ON m.horse_id = t.horse_id AND m.date < t.date AND m.status IN ('出走', '降着')
            JOIN clipped c ON c.race_id = m.race_id AND c.horse_id <> t.horse_id),
    agg AS (SELECT race_id, horse_id, owner_id, number, avg(c) AS a, count(*) AS n FROM opp GROUP BY 1, 2, 3, 4),
    starts AS (SELECT {IDS}, count(*) FILTER (WHERE status IN ('出走', '降着')) OVER {over('horse_id')} AS starts FROM entries)
    SELECT {IDS}, {rnd('a')} AS f806_field_mean, CAST(COALESCE(n, 0) AS DOUBLE) AS f806_n,
           CAST(CASE WHEN starts > 0 AND a IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f806_unavailable
    FROM starts LEFT JOIN agg USING (race_id, horse_id, owner_id, number)""")
def _(spark, folder):
    rows = X.add_features(stage_table(X.with_rival_speed(speed_facts(spark, folder)).drop("spd")), [X.opponent_strength()])
    return rows.select(*ID, r6("f806_field_mean"), F.col("f806_n").cast("double"), F.col("f806_unavailable").cast("long"))


@R.query("session_earlier_mean", FULL + f"""
    , r AS (SELECT *, CASE WHEN finish_pos <= 3 THEN CAST(corners[-1] AS DOUBLE) / n_starters END AS ratio FROM entries),
    p AS (SELECT *, avg(ratio) OVER w AS a, count(ratio) OVER w AS n FROM r WINDOW w AS {SESSION_BEFORE})
    SELECT {IDS}, {rnd('a')} AS f501, CAST(CASE WHEN n = 0 THEN 1 ELSE 0 END AS BIGINT) AS f501_unavailable FROM p""")
def _(spark, folder):
    rows = speed.add_session_bias(entries(spark, folder))
    return rows.select(*ID, r6("f501"), F.col("f501_unavailable").cast("long"))


@R.query("session_earlier_median", FULL + SPEED_SQL + f"""
    , e2 AS (SELECT t.race_id, t.horse_id, t.owner_id, t.number, r.e FROM entries t
             LEFT JOIN resid r ON r.date = t.date AND r.course = t.course AND r.surface = t.surface AND r.race_number < t.race_number)
    SELECT {IDS}, {rnd('median(e)')} AS f502, CAST(CASE WHEN count(e) = 0 THEN 1 ELSE 0 END AS BIGINT) AS f502_unavailable
    FROM e2 GROUP BY 1, 2, 3, 4""")
def _(spark, folder):
    rows = speed.add_session_clock(entries(spark, folder))
    return rows.select(*ID, r6("f502"), F.col("f502_unavailable").cast("long"))


@R.query("session_earlier_rows", FULL + f"""
    SELECT t.race_id, s.race_number AS source_number, s.race_id AS source_race_id, s.horse_id AS source_horse_id,
           s.finish_pos, {rnd('CAST(s.corners[-1] AS DOUBLE) / s.n_starters')} AS ratio
    FROM races t JOIN entries s ON s.date = t.date AND s.course = t.course AND s.surface = t.surface
         AND s.race_number < t.race_number AND s.finish_pos <= 3 AND len(s.corners) > 0""")
def _(spark, folder):
    t = star.event_tables(spark, folder)
    rows = speed.session_earlier_rows(matrix.entry_frame(t), t["races"])
    return rows.select("race_id", "source_number", "source_race_id", "source_horse_id", "finish_pos", r6("ratio"))


# --- inside the event -------------------------------------------------------------------------------------

@R.query("relativize", FULL + f"""
    , m AS (SELECT *, avg(last_3f) OVER g AS a, stddev_samp(last_3f) OVER g AS sd,
                   rank() OVER (PARTITION BY race_id ORDER BY last_3f NULLS LAST)
                   + (count(*) OVER (PARTITION BY race_id, last_3f) - 1) / 2.0 AS rk
            FROM entries WINDOW g AS (PARTITION BY race_id))
    SELECT {IDS}, {rnd('CASE WHEN sd <> 0 THEN (last_3f - a) / sd END')} AS last_3f_z,
           {rnd('CASE WHEN last_3f IS NOT NULL THEN rk / n_starters END')} AS last_3f_rank FROM m""")
def _(spark, folder):
    rows = G.relativize(entries(spark, folder), "last_3f", raw=True)
    return rows.select(*ID, r6("last_3f_z"), r6("last_3f_rank"))


@R.query("value_ranks", """
    WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, value, CAST(n AS BIGINT) AS n_equal,
           CAST(COALESCE(sum(n) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_below,
           CAST(sum(n) OVER (PARTITION BY event_type) AS BIGINT) AS n_group FROM c""")
def _(spark, folder):
    return value_ranks(star.table(spark, folder, "events"), ["event_type"], "value")


@R.query("missing_indicator", FULL + f"""
    SELECT {IDS}, CAST(horse_weight AS BIGINT) AS f603_horse_weight,
           CAST(CASE WHEN horse_weight IS NULL THEN 1 ELSE 0 END AS BIGINT) AS f603_horse_weight_unavailable FROM entries""")
def _(spark, folder):
    rows = X.add_entry_basics(entries(spark, folder))
    return rows.select(*ID, F.col("f603_horse_weight").cast("long"), F.col("f603_horse_weight_unavailable").cast("long"))


@R.query("event_description", FULL + f"""
    SELECT {IDS}, CAST(distance AS BIGINT) AS f803_distance, surface AS f803_surface, direction AS f803_direction,
           CASE WHEN month(date) IN (3,4,5) THEN '春' WHEN month(date) IN (6,7,8) THEN '夏'
                WHEN month(date) IN (9,10,11) THEN '秋' ELSE '冬' END AS f803_season, prize AS f803_prize,
           weather AS f804_weather,
           CAST(CASE track_condition WHEN '良' THEN 0 WHEN '稍重' THEN 1 WHEN '重' THEN 2 WHEN '不良' THEN 3 END AS BIGINT) AS f804_track_condition,
           CAST(meeting_no AS BIGINT) AS f503_meeting_no, CAST(age AS DOUBLE) AS f805_age, sex AS f805_sex,
           {rnd('weight_carried')} AS f805_weight_carried, owner_id AS f810_owner_id, sire_id, damsire_id, jockey_id, trainer_id
    FROM entries""")
def _(spark, folder):
    rows = X.add_owner_id(X.add_entry_basics(X.add_event_weather(X.add_event_description(entries(spark, folder)))))
    return rows.select(*ID, F.col("f803_distance").cast("long"), "f803_surface", "f803_direction", "f803_season", "f803_prize",
                       "f804_weather", F.col("f804_track_condition").cast("long"), F.col("f503_meeting_no").cast("long"),
                       "f805_age", "f805_sex", r6("f805_weight_carried"), "f810_owner_id",
                       "sire_id", "damsire_id", "jockey_id", "trainer_id")
