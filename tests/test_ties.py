"""Ties that a query's SQL leaves to the order of its table."""

import random

import duckdb

from millrace.plans import catalog, catalog_reports  # noqa: F401


def test_callee_ranks_takes_the_tables_first_of_lines_at_one_place(spark, tmp_path):
    r = random.Random(3)
    lines = [(o, n, 7, s, float(o + n), "N") for o in range(40) for n in (1, 1, 1, 2) for s in [r.choice([None, *range(1, 30)])]]
    lines += [(50, 1, 7, None, 1.0, "N"), (51, None, 7, 3, 1.0, "N"), (51, 2, 7, 4, 1.0, "R"), (52, 1, 7, 5, 1.0, "A")]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute("set threads to 1")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.SQL["callee_ranks"]).fetchall()
    got = catalog.QUERIES["callee_ranks"](spark, str(tmp_path)).select("which", "callee", "n", "bytes", "first").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
