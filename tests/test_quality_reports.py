"""Reports that run all checks read stored entries."""

from datetime import datetime

from catalogue import quality


def test_reports_read_stored_entries(spark, tmp_path):
    day = datetime(1995, 3, 1)
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
        "customer": ([(1, 0, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "supplier": ([(1,)], "s_suppkey long"),
        "part": ([(1, "a", "Brand#1", 5)], "p_partkey long, p_name string, p_brand string, p_size int"),
        "orders": ([(i, 1, "O", 60000.0, day, "1-URGENT") for i in (1, 2)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, n, 9.0 - n, 10.0, 0.05, 0.02, "A", "F", day) for n in (1, 3)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "events": ([(1, "error", 1, day)], "user_id long, event_type string, event_id long, ts timestamp"),
        "labels": ([(1, 2, 1)], "doc_id long, quality int, toxic int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = quality.R.queries["qc_findings"](spark, str(tmp_path))
    assert not any("lineitem.parquet" in f or "orders.parquet" in f for f in found.inputFiles())
    failed = {(r.check_id, r.race_id) for r in found.where("severity = 'fail'").collect()}
    assert ("orphan_race", 2) in failed and ("finish_pos_rank", 1) in failed
    rates = {r.check_id: r.detail for r in found.where("severity = 'warn'").collect()}
    assert rates["laps_coverage"] == rates["laps_coverage:year=1995"] == "1/2" and rates["rejected_rate"] == "1/3"
    counts = {r.check_id: r.n for r in quality.R.queries["qc_fail_counts"](spark, str(tmp_path)).collect()}
    assert counts["orphan_race"] == 1 and counts["finish_pos_rank"] == 1
