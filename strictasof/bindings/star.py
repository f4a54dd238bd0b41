"""Binding of the star-schema tables to the event model.

orders -> events, line items -> entries, parts -> entities. Only columns are renamed, cast and mapped; no row is
left out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _by(column: Column, pairs: dict, default=None) -> Column:
    chain = F  # F.when starts the chain, Column.when continues it
    for key, value in pairs.items():
        chain = chain.when(column == key, value if isinstance(value, Column) else F.lit(value))
    return chain.otherwise(default) if default is not None else chain


def races(spark: SparkSession, folder: str) -> DataFrame:
    """Events: one per order; sizes come from the order's line items."""
    place = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("course"), F.col("c_mktsegment").alias("weather"))
    )
    void = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    sizes = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("race_id")).agg(
        F.count("*").cast("int").alias("n_entries"), F.count_if(~void).cast("int").alias("n_starters"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    events = table(spark, folder, "orders").join(place, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("race_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        "course",
        (1 + F.col("o_custkey") % 12).cast("int").alias("race_number"),
        (1000 + 200 * F.floor(F.col("o_totalprice") / 50000)).cast("int").alias("distance"),
        status.alias("surface"),
        F.nullif(F.col("weather"), F.lit("AUTOMOBILE")).alias("direction"),
        _by(priority, {"1-URGENT": "G1", "2-HIGH": "G2"}).alias("grade"),
        _by(priority, {"1-URGENT": "良", "2-HIGH": "稍重", "3-MEDIUM": "重", "4-NOT SPECIFIED": "不良"})
        .alias("track_condition"),
        "weather",
        F.lit(None).cast("string").alias("weather_forecast"),
        F.floor("o_totalprice").cast("long").alias("prize"),
        _by(status, {"P": F.array(F.lit(3), F.lit(4)), "O": F.array(*[F.lit(i) for i in (1, 2, 3, 4)])},
            F.array(F.lit(2), F.lit(1))).alias("corner_nos"),
        priority.alias("race_class"),
        F.substring(priority, 1, 1).alias("weight_rule"),
        F.month("o_orderdate").alias("meeting_no"),
        F.dayofmonth("o_orderdate").alias("meeting_day"),
        F.col("o_custkey").alias("owner_key"),
    )
    return events.join(sizes, "race_id", "left").withColumns({
        "n_entries": F.coalesce("n_entries", F.lit(0)), "n_starters": F.coalesce("n_starters", F.lit(0))})


def runners(spark: SparkSession, folder: str) -> DataFrame:
    """Entries: one per line item. (race_id, horse_id, owner_id, number) identifies a row."""
    flags = F.concat("l_returnflag", "l_linestatus")
    status = _by(flags, {"AO": "降着", "NO": "競走中止", "RO": "出走取消"}, F.lit("出走"))
    done = status.isin(*V.FINISHED)
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    cents = F.round(F.col("l_discount") * 100).cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"))
    corners = (
        F.when(~done | (tax == 1), F.lit(None))
        .when(cents == 10, F.array(line))
        .when(F.col("o_orderstatus") == "P", F.array(line, line + 1))
        .when(F.col("o_orderstatus") == "O", F.array(quantity % 18 + 1, line, line + 1, line))
        .otherwise(F.array(line + 2, line))
    )
    margin = F.when(line == 1, "").otherwise(_by(quantity % 7, {
        0: "ハナ", 1: "クビ", 2: "1.1/2", 3: "3/4", 4: "2", 5: "大"}, F.lit("アタマ")))
    return table(spark, folder, "lineitem").join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_partkey").alias("horse_id"),
        line.alias("number"),
        F.nullif(cents, F.lit(0)).alias("frame"),
        F.when(tax != 0, F.col("l_suppkey")).alias("jockey_id"),
        F.col("o_custkey").alias("trainer_id"),
        F.col("l_suppkey").alias("owner_id"),
        (50 + F.col("l_discount") * 100).alias("weight_carried"),
        (400 + F.nullif(quantity, F.lit(13))).alias("horse_weight"),
        (line - 4).alias("weight_diff"),
        (2 + line).alias("age"),
        _by(F.col("l_returnflag"), {"A": "牡", "N": "牝"}, F.lit("セ")).alias("sex"),
        (1 + F.nullif(F.col("l_quantity"), F.lit(50.0))).alias("odds_win"),
        (1 + cents).alias("popularity"),
        status.alias("status"),
        F.when(done, line).alias("finish_pos"),
        F.when(done, margin).alias("margin"),
        F.when(done, F.col("l_extendedprice")).alias("time_sec"),
        F.when(done, F.col("l_quantity") + F.col("l_discount")).alias("last_3f"),
        corners.alias("corners"),
        F.when(F.col("l_linestatus") == "F", "東").when(F.col("l_returnflag") != "R", "西").otherwise("地")
        .alias("affiliation"),
    )


def horses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("horse_id"), F.col("p_name").alias("name"),
        F.nullif(F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("long"), F.lit(1)).alias("sire_id"),
        F.nullif(F.col("p_size").cast("long"), F.lit(50)).alias("damsire_id"))


def payouts(spark: SparkSession, folder: str, entries: DataFrame | None = None) -> DataFrame:
    """Ticket outcomes: winners, first three, and pairs of the first three numbers of each event (of the ``entries``, if stored)."""
    entries = runners(spark, folder) if entries is None else entries
    placed = entries.where(F.col("finish_pos") <= 3).groupBy("race_id", "number").agg(
        F.min("finish_pos").alias("finish_pos"), F.min("odds_win").alias("odds"))
    pay = F.floor(F.coalesce(F.col("odds"), F.lit(2.0)) * 100).cast("long")
    single = placed.select("race_id", "number", "finish_pos", pay.alias("payout"))
    win = single.where("finish_pos = 1").select("race_id", F.lit(V.WIN).alias("bet_type"), F.array("number").alias("combination"), "payout")
    place = single.select("race_id", F.lit(V.PLACE).alias("bet_type"), F.array("number").alias("combination"),
                          F.floor(F.col("payout") / 2).alias("payout"))
    # at most the numbers 1, 2 and 3 are placed, so an event has at most three pairs
    listed = single.groupBy("race_id").agg(F.sort_array(F.collect_set("number")).alias("n"), F.sum("payout").alias("payout"))
    pairs = F.filter(
        F.flatten(F.transform("n", lambda a: F.transform("n", lambda b: F.array(a, b)))), lambda p: p[0] < p[1])
    wide = listed.select("race_id", F.lit(V.WIDE).alias("bet_type"), F.explode(pairs).alias("combination"), "payout")
    return win.unionByName(place).unionByName(wide).withColumn("comb_key", F.array_join(F.transform(
        "combination", lambda n: n.cast("string")), "-"))


def event_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"races": races(spark, folder), "runners": runners(spark, folder), "horses": horses(spark, folder)}


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return event_tables(spark, folder) | {"payouts": payouts(spark, folder)}
