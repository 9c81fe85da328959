"""Plans: what reaches the scan, what is shuffled, and that nothing runs in Python that need not."""

import os
import re

import pytest
from pyspark.sql import functions as F

from matrixlake import queries as Q
from matrixlake.operators import gather as G
from matrixlake.operators import sampling as S

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
IN_PYTHON = {"links_callback"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_ids_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("global_row_index"), F.lit(1).alias("v"), F.lit(2).alias("w")).write.parquet(str(tmp_path / "t"))
    df = G.gather_ids(spark.read.parquet(str(tmp_path / "t")), [3, 1, 3]).select("pos", "v")
    text = plan(df)
    assert re.search(r"PushedFilters: \[In\(global_row_index", text) or "In(global_row_index" in text
    assert "w#" not in re.search(r"ReadSchema: struct<[^>]*>", text)[0] and "w:int" not in text


def test_columns_are_pruned(spark):
    text = plan(Q.queries()["coo_sum_duplicates"](spark, SF))
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", text)[1].replace(":bigint", "").replace(":double", "").split(",")) == {"l_orderkey", "l_partkey", "l_quantity"}
    assert text.count("Exchange") == 1


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - IN_PYTHON))
def test_no_python_in_plans(spark, name):
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan(Q.queries()[name](spark, SF)))


def test_draws_do_not_multiply_cells_by_pairs(spark):
    """The slot join of a weighted draw makes a few rows a cell, whatever the number of intervals."""
    cells = spark.range(2000).select(F.col("id").alias("row"), F.lit(0).alias("group"))
    weights = spark.range(500).select(F.lit(0).alias("group"), F.col("id").alias("pair_no"), (F.col("id") % 7 + 1).alias("w"))
    from matrixlake.functions.draws import uniform

    out = S.pick(cells, weights, ["group"], ["pair_no"], "w", uniform(1, F.col("row")))
    assert out.count() == 2000 and out.select("row").distinct().count() == 2000
    share = out.where("pair_no % 7 = 6").count() / 2000
    assert 0.18 < share < 0.32  # 7 of 28


def test_distinct_ranks(spark):
    from matrixlake.functions.draws import uniform

    df = spark.range(3000).select("id", S.distinct_ranks(3, F.lit(5).cast("long"), lambda j: uniform(F.col("id"), j)).alias("r"))
    rows = [r["r"] for r in df.collect()]
    assert all(len(set(r)) == 3 and min(r) >= 0 and max(r) < 5 for r in rows)
    for place in range(3):
        counts = [sum(r[place] == v for r in rows) for v in range(5)]
        assert max(counts) - min(counts) < 150
