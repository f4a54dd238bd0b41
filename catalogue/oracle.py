"""DuckDB texts of the star binding, shared by the oracle queries."""

RACES = """
races AS (
  SELECT o_orderkey AS race_id, CAST(o_orderdate AS DATE) AS date, r_name AS course,
         CAST(1 + o_custkey % 12 AS INTEGER) AS race_number,
         CAST(1000 + 200 * floor(o_totalprice / 50000) AS INTEGER) AS distance,
         o_orderstatus AS surface, NULLIF(c_mktsegment, 'AUTOMOBILE') AS direction,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'G1' WHEN '2-HIGH' THEN 'G2' END AS grade,
         CASE o_orderpriority WHEN '1-URGENT' THEN '良' WHEN '2-HIGH' THEN '稍重' WHEN '3-MEDIUM' THEN '重'
              WHEN '4-NOT SPECIFIED' THEN '不良' END AS track_condition,
         c_mktsegment AS weather, CAST(NULL AS VARCHAR) AS weather_forecast,
         CAST(floor(o_totalprice) AS BIGINT) AS prize,
         CASE o_orderstatus WHEN 'P' THEN [3, 4] WHEN 'O' THEN [1, 2, 3, 4] ELSE [2, 1] END AS corner_nos,
         o_orderpriority AS race_class, substr(o_orderpriority, 1, 1) AS weight_rule,
         month(o_orderdate) AS meeting_no, day(o_orderdate) AS meeting_day, o_custkey AS owner_key,
         COALESCE(n_entries, 0) AS n_entries, COALESCE(n_starters, 0) AS n_starters
  FROM orders
  LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_entries,
                    count(*) FILTER (WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')) AS n_starters
             FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey
)"""

RUNNERS = """
raw_runners AS (
  SELECT *, CASE l_returnflag || l_linestatus WHEN 'AO' THEN '降着' WHEN 'NO' THEN '競走中止'
                 WHEN 'RO' THEN '出走取消' ELSE '出走' END AS status,
         CAST(round(l_discount * 100) AS INTEGER) AS cents, CAST(round(l_tax * 100) AS INTEGER) AS tax,
         CAST(l_quantity AS INTEGER) AS q
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
),
runners AS (
  SELECT l_orderkey AS race_id, l_partkey AS horse_id, l_linenumber AS number, NULLIF(cents, 0) AS frame,
         CASE WHEN tax <> 0 THEN l_suppkey END AS jockey_id, o_custkey AS trainer_id, l_suppkey AS owner_id,
         50 + l_discount * 100 AS weight_carried, 400 + NULLIF(q, 13) AS horse_weight,
         l_linenumber - 4 AS weight_diff, 2 + l_linenumber AS age,
         CASE l_returnflag WHEN 'A' THEN '牡' WHEN 'N' THEN '牝' ELSE 'セ' END AS sex,
         1 + NULLIF(l_quantity, 50) AS odds_win, 1 + cents AS popularity, status,
         CASE WHEN status IN ('出走', '降着') THEN l_linenumber END AS finish_pos,
         CASE WHEN status IN ('出走', '降着') THEN CASE WHEN l_linenumber = 1 THEN '' ELSE
              CASE q % 7 WHEN 0 THEN 'ハナ' WHEN 1 THEN 'クビ' WHEN 2 THEN '1.1/2' WHEN 3 THEN '3/4' WHEN 4 THEN '2'
                         WHEN 5 THEN '大' ELSE 'アタマ' END END END AS margin,
         CASE WHEN status IN ('出走', '降着') THEN l_extendedprice END AS time_sec,
         CASE WHEN status IN ('出走', '降着') THEN l_quantity + l_discount END AS last_3f,
         CASE WHEN status NOT IN ('出走', '降着') OR tax = 1 THEN NULL WHEN cents = 10 THEN [l_linenumber]
              WHEN o_orderstatus = 'P' THEN [l_linenumber, l_linenumber + 1]
              WHEN o_orderstatus = 'O' THEN [q % 18 + 1, l_linenumber, l_linenumber + 1, l_linenumber]
              ELSE [l_linenumber + 2, l_linenumber] END AS corners,
         CASE WHEN l_linestatus = 'F' THEN '東' WHEN l_returnflag <> 'R' THEN '西' ELSE '地' END AS affiliation
  FROM raw_runners
)"""

HORSES = """
horses AS (
  SELECT p_partkey AS horse_id, p_name AS name,
         NULLIF(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT), 1) AS sire_id,
         NULLIF(CAST(p_size AS BIGINT), 50) AS damsire_id
  FROM part
)"""

BAND = ("CASE WHEN distance <= 1400 THEN '短距離' WHEN distance <= 1800 THEN 'マイル' "
        "WHEN distance <= 2200 THEN '中距離' ELSE '長距離' END")

ENTRIES = f"""
entries AS (
  SELECT ru.*, r.* EXCLUDE (race_id), h.sire_id, h.damsire_id, {BAND} AS band,
         CAST(finish_pos AS DOUBLE) / n_starters AS perf
  FROM runners ru JOIN races r USING (race_id) LEFT JOIN horses h USING (horse_id)
)"""

PAYOUTS = """
placed AS (
  SELECT race_id, number, min(finish_pos) AS finish_pos, CAST(floor(COALESCE(min(odds_win), 2) * 100) AS BIGINT) AS pay
  FROM runners WHERE finish_pos <= 3 GROUP BY 1, 2
),
payouts AS (
  SELECT race_id, '単勝' AS bet_type, CAST(number AS VARCHAR) AS comb_key, pay AS payout FROM placed WHERE finish_pos = 1
  UNION ALL
  SELECT race_id, '複勝', CAST(number AS VARCHAR), CAST(floor(pay / 2) AS BIGINT) FROM placed
  UNION ALL
  SELECT a.race_id, 'ワイド', a.number || '-' || b.number, CAST(s.total AS BIGINT)
  FROM placed a JOIN placed b ON a.race_id = b.race_id AND a.number < b.number
  JOIN (SELECT race_id, sum(pay) AS total FROM placed GROUP BY 1) s ON s.race_id = a.race_id
)"""


def with_tables(*parts: str) -> str:
    return "WITH " + ",".join(parts)


EVENTS = with_tables(RACES)
MODEL = with_tables(RACES, RUNNERS)
FULL = with_tables(RACES, RUNNERS, HORSES, ENTRIES)
TICKETS = with_tables(RACES, RUNNERS, PAYOUTS)
IDS = "race_id, horse_id, owner_id, number"


def rnd(expression: str, digits: int = 6) -> str:
    """Rounding in one form that both engines evaluate alike.

    The halfway point sits slightly beside .5, so that simple fractions such as 89/128 are no ties that the
    last bit of a sum would decide.
    """
    scale = 10 ** digits
    return f"floor(({expression}) * {scale} + 0.5003) / {scale}"
