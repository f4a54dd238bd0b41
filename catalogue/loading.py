"""Queries over scans, loading jobs and page extraction."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictasof.bindings import star
from strictasof.functions import scalars as S
from strictasof.operators import keys as K
from strictasof.plans import matrix
from strictasof.plans import probability as P
from strictasof.sources import ingest, pages
from strictasof.sources.decode import decode_body

from .chances import SEALED, TODAY
from .oracle import EVENTS, FULL, IDS, MODEL, with_tables
from .quality import OPS, fetch_log, rejected_rows
from .registry import Registry

R = Registry()
ID = ["race_id", "horse_id", "owner_id", "number"]


def entries(spark, folder):
    return matrix.entry_frame(star.event_tables(spark, folder))


# --- scans ------------------------------------------------------------------------------------------------

@R.query("population_by_cutoff", FULL + f"SELECT {IDS} FROM entries WHERE date < DATE '1999-06-01' AND status <> '出走取消'")
def _(spark, folder):
    return matrix.base_population(entries(spark, folder), as_of=date(1999, 6, 1)).select(*ID)


@R.query("population_by_keys", FULL + f"SELECT {IDS} FROM entries WHERE grade = 'G1' AND status <> '出走取消'")
def _(spark, folder):
    wanted = star.races(spark, folder).where("grade = 'G1'")
    return matrix.base_population(entries(spark, folder), events=wanted).select(*ID)


@R.query("sealed_population", EVENTS + f"""
    SELECT race_id, grade, CAST((SELECT count(*) FROM races WHERE {SEALED}) AS BIGINT) AS n_sealed FROM races WHERE NOT {SEALED}""")
def _(spark, folder):
    races = star.races(spark, folder)
    return P.target_population(races, TODAY).select("race_id", "grade", P.sealed_count(races, TODAY).scalar().alias("n_sealed"))


@R.query("events_in_range", EVENTS + f"SELECT race_id FROM races WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND NOT {SEALED}")
def _(spark, folder):
    return matrix.events_between(star.races(spark, folder), date(1998, 1, 1), date(1999, 12, 31), TODAY).select("race_id")


# --- logs and replacement ------------------------------------------------------------------------------------

@R.query("latest_wins_log", with_tables(OPS) + """
    SELECT url, page_kind, source_key, outcome, event_id FROM fetch_log QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) = 1""")
def _(spark, folder):
    log = fetch_log(spark, folder)
    first = log.where(F.col("fetched_at") < F.lit("2024-01-15").cast("timestamp"))
    later = log.where(F.col("fetched_at") >= F.lit("2024-01-15").cast("timestamp"))
    return ingest.latest_wins(first, later, ingest.FETCH_LOG_KEY, "fetched_at").select("url", "page_kind", "source_key", "outcome", "event_id")


@R.query("keyed_replace", """
    SELECT l_orderkey AS race_id, l_partkey AS horse_id, CASE WHEN o_orderstatus = 'F' THEN 2 * l_quantity ELSE l_quantity END AS quantity
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""")
def _(spark, folder):
    """New versions of the 'F' orders' lines; the 'P' orders are cleared without a replacement."""
    old = star.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_partkey").alias("horse_id"), F.col("l_quantity").alias("quantity"))
    orders = star.table(spark, folder, "orders").select(F.col("o_orderkey").alias("race_id"), "o_orderstatus")
    new = old.join(orders.where("o_orderstatus = 'F'"), "race_id", "left_semi").withColumn("quantity", 2 * F.col("quantity"))
    return ingest.replace_keyed(old, new, ["race_id"], replaced=orders.where("o_orderstatus in ('F', 'P')"))


@R.query("replace_groups", """
    SELECT l_orderkey AS race_id, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE l_quantity END) AS total
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def _(spark, folder):
    parents = star.table(spark, folder, "orders").select(F.col("o_orderkey").alias("race_id"), "o_orderstatus")
    children = star.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_quantity").alias("q"))
    fresh = parents.where("o_orderstatus = 'O'")
    replaced = ingest.replace_groups(
        {"races": parents, "runners": children},
        {"races": fresh, "runners": children.join(fresh, "race_id", "left_semi").withColumn("q", F.lit(1.0))}, "races", "race_id")
    return replaced["runners"].groupBy("race_id").agg(F.count("*").alias("n"), F.sum("q").alias("total"))


@R.query("resume_pending", with_tables(OPS) + """
    SELECT DISTINCT source_key FROM fetch_log f WHERE page_kind = 'day_index' AND NOT EXISTS (
      SELECT 1 FROM fetch_log g WHERE g.page_kind = 'archive' AND g.outcome = 'ok' AND g.source_key = f.source_key)
    UNION ALL SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') FROM orders""")
def _(spark, folder):
    log = fetch_log(spark, folder)
    days = star.table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("source_key"))
    listed = log.where("page_kind = 'day_index'").select("source_key")
    return ingest.pending_keys(listed.union(days).distinct(), log)


@R.query("outcome_routing", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'http_error' WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 5 THEN 'parse_error'
           WHEN value < 1 THEN 'empty' ELSE 'ok' END AS outcome FROM events""")
def _(spark, folder):
    key = F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))["k"]
    rows = star.table(spark, folder, "events")
    return ingest.route_outcomes(rows, F.col("event_type") == "error", key < 5, F.col("value") < 1).select("event_id", "outcome")


@R.query("reject_split", FULL + """
    , marked AS (SELECT race_id, horse_id, status, CASE WHEN jockey_id IS NULL THEN 'no partner' WHEN frame IS NULL THEN 'no frame' END AS reason FROM entries),
    totals AS (SELECT race_id, count(*) AS n_entries, count(*) FILTER (WHERE status <> '出走取消') AS n_starters FROM marked WHERE reason IS NULL GROUP BY 1)
    SELECT race_id, 'accepted' AS kind, n_entries, n_starters FROM totals
    UNION ALL SELECT race_id, reason, count(*), 0 FROM marked WHERE reason IS NOT NULL GROUP BY 1, 2""")
def _(spark, folder):
    reason = F.when(F.col("jockey_id").isNull(), "no partner").when(F.col("frame").isNull(), "no frame")
    accepted, rejected = ingest.split_rows(entries(spark, folder), reason)
    totals = ingest.event_totals(accepted).select("race_id", F.lit("accepted").alias("kind"), "n_entries", "n_starters")
    return totals.unionByName(rejected.groupBy("race_id", F.col("reason").alias("kind")).agg(
        F.count("*").alias("n_entries"), F.lit(0).cast("long").alias("n_starters")))


@R.query("quarantine_replace", with_tables(OPS) + """
    SELECT source_key, reason, doc_id FROM rejected_rows WHERE source_key <> '19950101'
    UNION ALL SELECT source_key, 'reread' AS reason, doc_id FROM rejected_rows WHERE source_key = '19950101' AND raw = '0'""")
def _(spark, folder):
    old = rejected_rows(spark, folder).select("source_key", "reason", "raw", "doc_id")
    again = old.where("source_key = '19950101' and raw = '0'").withColumn("reason", F.lit("reread"))
    return ingest.replace_keyed(old, again, ["source_key"]).select("source_key", "reason", "doc_id")


@R.query("rejected_keys", with_tables(OPS) + "SELECT DISTINCT source_key FROM rejected_rows WHERE reason = 'unknown_finish_marker'")
def _(spark, folder):
    return ingest.keys_rejected_for(rejected_rows(spark, folder), "unknown_finish_marker")


@R.query("surrogate_keys", """
    WITH keys AS (SELECT DISTINCT 'part' AS entity_type, 'shop' AS source, CAST(l_partkey AS VARCHAR) AS source_key FROM lineitem
                  UNION SELECT 'supplier', 'shop', CAST(l_suppkey AS VARCHAR) FROM lineitem),
    known AS (SELECT 'part' AS entity_type, 'shop' AS source, CAST(p_partkey AS VARCHAR) AS source_key, p_partkey + 10 AS internal_id FROM part WHERE p_size <= 25),
    found AS (SELECT k.*, internal_id FROM keys k LEFT JOIN known USING (entity_type, source, source_key)),
    fresh AS (SELECT entity_type, source, source_key, row_number() OVER (PARTITION BY entity_type ORDER BY substr(md5(source || chr(1) || source_key), 1, 3), source, source_key) AS rn
              FROM found WHERE internal_id IS NULL)
    SELECT entity_type, source, source_key, CAST(internal_id AS BIGINT) AS internal_id FROM found WHERE internal_id IS NOT NULL
    UNION ALL SELECT entity_type, source, source_key, COALESCE((SELECT max(internal_id) FROM known k WHERE k.entity_type = f.entity_type), 0) + rn FROM fresh f""")
def _(spark, folder):
    items = star.table(spark, folder, "lineitem")
    keyed = lambda kind, column: items.select(F.lit(kind).alias("entity_type"), F.lit("shop").alias("source"), F.col(column).cast("string").alias("source_key"))
    known = star.table(spark, folder, "part").where("p_size <= 25").select(
        F.lit("part").alias("entity_type"), F.lit("shop").alias("source"), F.col("p_partkey").cast("string").alias("source_key"),
        (F.col("p_partkey") + 10).alias("internal_id"))
    return ingest.resolve_keys(keyed("part", "l_partkey").union(keyed("supplier", "l_suppkey")), known)


@R.query("entity_key_fallback", """
    SELECT p_partkey, COALESCE(CASE WHEN p_size > 25 THEN CAST(p_partkey AS VARCHAR) END, 'name:' || p_name) AS source_key FROM part""")
def _(spark, folder):
    key = F.when(F.col("p_size") > 25, F.col("p_partkey").cast("string"))
    return star.table(spark, folder, "part").select("p_partkey", ingest.entity_key(key, F.col("p_name")).alias("source_key"))


@R.query("enrich_dimension", """
    SELECT p_partkey AS horse_id, COALESCE(CASE WHEN s.total > 900 THEN s.total END, CASE WHEN p_size <> 1 THEN p_size END) AS sire_id
    FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part) LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey""")
def _(spark, folder):
    size = F.col("p_size").cast("double")
    dimension = star.table(spark, folder, "part").select(F.col("p_partkey").alias("horse_id"), F.when(size != 1, size).alias("sire_id"))
    found = star.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("horse_id")).agg(F.sum("l_quantity").alias("t"))
    return ingest.enrich(dimension, found.select("horse_id", F.when(F.col("t") > 900, F.col("t")).alias("sire_id")), "horse_id", ["sire_id"])


@R.query("pending_entities", with_tables(OPS) + """
    SELECT CAST(c_custkey AS VARCHAR) AS source_key FROM customer WHERE c_acctbal < 0 AND NOT EXISTS (
      SELECT 1 FROM fetch_log WHERE page_kind = 'archive' AND outcome = 'ok' AND source_key = CAST(c_custkey AS VARCHAR))""")
def _(spark, folder):
    people = star.table(spark, folder, "customer").withColumn("source_key", F.col("c_custkey").cast("string"))
    return ingest.pending_entities(people, F.col("c_acctbal") < 0, fetch_log(spark, folder), "archive").select("source_key")


@R.query("overlay_union", """
    SELECT o_orderkey AS race_id, o_orderstatus AS surface, CASE WHEN o_orderdate < DATE '2001-01-01' THEN o_totalprice END AS prize FROM orders""")
def _(spark, folder):
    """Orders of the last year come in as pending events without an outcome column."""
    orders = star.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("race_id"), F.col("o_orderstatus").alias("surface"), F.col("o_totalprice").alias("prize"), "o_orderdate")
    split = F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")
    out = ingest.overlay({"races": orders.where(split).drop("o_orderdate")}, {"races": orders.where(~split).drop("o_orderdate", "prize")})
    return out["races"]


@R.query("readiness_gate", MODEL + "SELECT race_id, bool_and(horse_weight IS NOT NULL) AS ready FROM runners GROUP BY 1")
def _(spark, folder):
    return ingest.readiness(star.runners(spark, folder), "horse_weight")


@R.query("limited_sql", """
    SELECT nation, revenue, true AS truncated FROM (
      SELECT n_name AS nation, round(sum(c_acctbal), 2) AS revenue FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY revenue DESC, nation LIMIT 5)""")
def _(spark, folder):
    for name in ("customer", "nation"):
        star.table(spark, folder, name).createOrReplaceTempView(name)
    full = K.read_only(spark, "SELECT n_name AS nation, round(sum(c_acctbal), 2) AS revenue FROM customer JOIN nation ON n_nationkey = c_nationkey "
                              "GROUP BY 1 ORDER BY revenue DESC, nation")
    rows, truncated = K.limited(full, 5)
    return rows.withColumn("truncated", F.lit(truncated))


@R.query("margin_parse", """
    SELECT p_partkey, CASE text WHEN 'ハナ' THEN 0.05 WHEN 'アタマ' THEN 0.1 WHEN '大' THEN 10.0 ELSE
             CASE WHEN text LIKE '%.%/%' THEN CAST(split_part(text, '.', 1) AS DOUBLE) + CAST(split_part(split_part(text, '.', 2), '/', 1) AS DOUBLE) / CAST(split_part(text, '/', 2) AS DOUBLE)
                  WHEN text LIKE '%/%' THEN CAST(split_part(text, '/', 1) AS DOUBLE) / NULLIF(CAST(split_part(text, '/', 2) AS DOUBLE), 0)
                  ELSE TRY_CAST(text AS DOUBLE) END END AS margin
    FROM (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_size || '.1/2' WHEN 'SMALL' THEN '3/4' WHEN 'STANDARD' THEN CAST(p_retailprice AS VARCHAR)
                 WHEN 'PROMO' THEN 'ハナ' WHEN 'LARGE' THEN '1/0' ELSE p_name END AS text FROM part)""")
def _(spark, folder):
    kind = F.col("p_type")
    text = (F.when(kind == "ECONOMY", F.concat(F.col("p_size").cast("string"), F.lit(".1/2"))).when(kind == "SMALL", "3/4")
            .when(kind == "STANDARD", F.col("p_retailprice").cast("string")).when(kind == "PROMO", "ハナ").when(kind == "LARGE", "1/0")
            .otherwise(F.col("p_name")))
    return star.table(spark, folder, "part").select("p_partkey", S.margin_lengths(text).alias("margin"))


@R.query("distance_band", EVENTS + """
    SELECT race_id, CASE WHEN distance <= 1400 THEN '短距離' WHEN distance <= 1800 THEN 'マイル' WHEN distance <= 2200 THEN '中距離' ELSE '長距離' END AS band,
           COALESCE(grade, race_class, 'その他') AS class_key, date_trunc('month', date)::DATE AS month, (date - INTERVAL 3 YEAR)::DATE AS three_years_ago,
           greatest(least(prize / 100000.0, 2.0), -2.0)::DOUBLE AS clipped FROM races""")
def _(spark, folder):
    return star.races(spark, folder).select(
        "race_id", S.distance_band(F.col("distance")).alias("band"), S.class_key(F.col("grade"), F.col("race_class")).alias("class_key"),
        S.month_start(F.col("date")).alias("month"), S.minus_years(F.col("date"), 3).alias("three_years_ago"),
        S.clip(F.col("prize") / 100000.0, 2.0).alias("clipped"))


@R.query("shared_keys", "SELECT l_partkey AS horse_id, count(DISTINCT l_returnflag) AS n_parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def _(spark, folder):
    rows = star.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("horse_id"), "l_returnflag")
    return K.shared_keys(rows, ["horse_id"], "l_returnflag")


@R.query("complement", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, folder):
    lines = star.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.without(star.table(spark, folder, "orders"), lines, ["o_orderkey"]).select("o_orderkey")


@R.query("first_of_group", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def _(spark, folder):
    order = F.struct(-F.col("o_totalprice"), "o_orderkey")
    return K.first_by(star.table(spark, folder, "orders"), ["o_custkey"], order, ["o_orderkey", "o_totalprice"])


# --- pages ----------------------------------------------------------------------------------------------------

def stored_pages(spark, folder):
    return star.table(spark, folder, "pages")


@R.query("page_strip", r"""
    SELECT page_id, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS digest FROM (
      SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS body FROM pages)""")
def _(spark, folder):
    body = pages.strip_boilerplate(F.col("html"))
    return stored_pages(spark, folder).select("page_id", F.length(body).cast("long").alias("n_chars"), F.md5(body).alias("digest"))


@R.query("page_links", r"""
    WITH all_links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages),
    firsts AS (SELECT page_id, target, min(pos) AS pos FROM all_links GROUP BY 1, 2)
    SELECT page_id, target, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS position FROM firsts""")
def _(spark, folder):
    return pages.links(stored_pages(spark, folder), F.col("html")).select("page_id", "target", F.col("position").cast("long"))


@R.query("page_fields", r"""
    SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, nullif(regexp_extract(url, '^(https?)://', 1), '') AS scheme,
           regexp_extract(url, '^https?://([^/]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/(\d+)(?:[/?#]|$)', 1) AS BIGINT) AS number,
           len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, CASE WHEN html LIKE '%class="ad"%' THEN 'ad' WHEN html LIKE '%<article%' THEN 'article' END AS first_word
    FROM pages""")
def _(spark, folder):
    return stored_pages(spark, folder).select(
        "page_id", F.coalesce(pages.found(F.col("html"), '<html lang="([^"]*)"'), F.lit("")).alias("lang"),
        pages.found(F.col("url"), "^(https?)://").alias("scheme"), F.coalesce(pages.found(F.col("url"), "^https?://([^/]+)"), F.lit("")).alias("host"),
        pages.number(pages.found(F.col("url"), r"/(\d+)(?:[/?#]|$)"), "long").alias("number"),
        F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"),
        F.coalesce(F.when(F.col("html").contains('class="ad"'), "ad"), F.when(F.col("html").contains("<article"), "article")).alias("first_word"))


@R.query("page_rows", r"""
    WITH items AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) AS item, generate_subscripts(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), 1) AS line FROM pages)
    SELECT page_id, CAST(line - 1 AS BIGINT) AS line, trim(regexp_replace(regexp_replace(item, '<.*?>', '', 'g'), '\s+', ' ', 'g')) AS text FROM items""")
def _(spark, folder):
    items = pages.found_all(F.col("html"), r"(?s)<li[^>]*>(.*?)</li>")
    return stored_pages(spark, folder).select("page_id", F.posexplode(items).alias("line", "item")).select(
        "page_id", F.col("line").cast("long"), pages.plain(F.col("item")).alias("text"))


PROBES = (
    pages.Probe("navigation", ("<nav>", "<ul>", "<li>"), 2, r"<a href="),
    pages.Probe("article", ("<article>",), 1, r"<h1>[^<]+</h1>"),
    pages.Probe("table", ("<table",), 1, r"<t[dh]"),
    pages.Probe("entities", pattern=r"&[a-z]+;"),
    pages.Probe("size", derived=True),
)


@R.query("page_presence", r"""
    WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<head\b.*?</head>', ' ', 'g') AS h FROM pages)
    SELECT page_id, 'navigation' AS field, CAST(contains(h, '<nav>')::INT + contains(h, '<ul>')::INT + contains(h, '<li>')::INT AS BIGINT) AS hits,
           contains(h, '<nav>')::INT + contains(h, '<ul>')::INT + contains(h, '<li>')::INT >= 2 AND contains(h, '<a href=') AS present FROM b
    UNION ALL SELECT page_id, 'article', contains(h, '<article>')::BIGINT, contains(h, '<article>') AND regexp_matches(h, '<h1>[^<]+</h1>') FROM b
    UNION ALL SELECT page_id, 'table', contains(h, '<table')::BIGINT, contains(h, '<table') AND regexp_matches(h, '<t[dh]') FROM b
    UNION ALL SELECT page_id, 'entities', 0, regexp_matches(h, '&[a-z]+;') FROM b
    UNION ALL SELECT page_id, 'size', 0, NULL FROM b""")
def _(spark, folder):
    return pages.field_presence(stored_pages(spark, folder), PROBES, key="page_id", text="html")


@R.query("page_coverage", r"""
    SELECT f.field, count(*) AS n_pages, count(*) FILTER (WHERE CASE f.field WHEN 'article' THEN contains(html, '<article>') AND regexp_matches(html, '<h1>[^<]+</h1>') ELSE regexp_matches(html, '<table.*<t[dh]') END) AS n_present
    FROM pages, (VALUES ('article'), ('table')) f(field) GROUP BY 1""")
def _(spark, folder):
    kept = [p for p in PROBES if p.field in ("article", "table")]
    return pages.field_coverage(pages.field_presence(stored_pages(spark, folder), kept, key="page_id", text="html"))


@R.query("page_decode", "SELECT page_id, md5(html) AS digest FROM pages")
def _(spark, folder):
    return stored_pages(spark, folder).select("page_id", F.md5(decode_body(F.encode("html", "UTF-8"))).alias("digest"))


@R.query("vector_positions", """
    SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS value, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS position FROM embeddings""")
def _(spark, folder):
    """An ordered vector as indexed rows, the way laps are stored."""
    return star.table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v")).select(
        "vec_id", (F.col("p") + 1).cast("long").alias("position"), F.col("v").cast("double").alias("value"))


@R.query("combination_keys", MODEL + """
    SELECT race_id, number, array_to_string(list_sort([number, CAST(popularity AS INTEGER), 3]), '-') AS unordered,
           array_to_string([number, CAST(popularity AS INTEGER), 3], '-') AS ordered FROM runners""")
def _(spark, folder):
    raw = F.concat_ws("-", F.col("number").cast("string"), F.col("popularity").cast("string"), F.lit("3"))
    key = lambda kind: F.array_join(F.transform(pages.canonical_combination(F.lit(kind), raw), lambda n: n.cast("string")), "-")
    return star.runners(spark, folder).select("race_id", "number", key("三連複").alias("unordered"), key("三連単").alias("ordered"))
