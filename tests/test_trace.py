"""The trace of a search that ends at its root: one subproblem, and no link whose record could tell the columns."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sylvaframe import catalogue, sources
from sylvaframe.plans.estimator import OptimalTree


def test_trace_query_of_one_leaf(spark, sf, tmp_path):
    """No split of lineitem pays where nine in ten rows have one flag."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 10 > 0, "N").otherwise(F.col("l_returnflag"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["search_trace"](spark, str(tmp_path)).select("objective", "loose", "unfounded").collect()]
    assert got == con.sql(f"SELECT objective, loose, unfounded FROM ({catalogue.SQL['search_trace']})").fetchall()


@pytest.mark.parametrize("cells", [5_000_000, 0])
def test_trace_without_links(spark, tmp_path, cells):
    """Both searches write nodes and links, and say what they are."""
    rows = spark.createDataFrame([(k % 2, k // 2 % 2, "a" if k else "b") for k in range(40)], "u int, v int, y string")
    model = OptimalTree({"regularization": 0.1, "local_cells": cells, "task_cells": 0, "diagnostics": True, "trace": f"{tmp_path}/trace"}).fit(rows, "y")
    nodes, links = sources.read_graph(spark, f"{tmp_path}/trace")
    assert model.leaves() == 1 and links.columns == ["tid", "feature", "bit", "child"] and links.count() == 0
    whole = nodes.collect()
    assert len(whole) == 1 and whole[0]["lower"] == whole[0]["upper"] == whole[0]["leaf"]
    assert model.summary["diagnosis"] == {"unresolved": 0, "blocking": 0}
