"""Operators' queries meet all rows of their tables, not a chosen few."""

import os

import pytest

from matrixlake import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_order_is_permuted_gathered_and_routed(spark):
    orders = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    placed = Q.queries()["reorder_rewrite_all"](spark, SF).collect()
    assert {r["source_row"] for r in placed} == orders and sorted(r["global_row_index"] for r in placed) == list(range(len(orders)))
    got = Q.queries()["gather_table_all"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len({r["global_row_index"] for r in got}) > 0.9 * len(orders)
    routed = Q.queries()["route_all_rows_to_dataset"](spark, SF).collect()
    assert {r["id"] for r in routed} == orders and {r["dataset_id"] for r in routed} == {"F", "O", "P"}


def test_every_cell_is_linked_and_every_label_pair_weighed(spark):
    cells = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey as row", "nullif(o_orderstatus, 'P') as status", "year(o_orderdate) as year").collect()
    years = {(c["status"], c["year"]) for c in cells}
    got = Q.queries()["links_lookup_all"](spark, SF).collect()
    assert sorted(r["source_row"] for r in got) == sorted(c["row"] for c in cells if (c["status"], c["year"] + 1) in years)
    e = {r["vec_id"]: (r["label"], [int(x * 1000 // 1) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    links = Q.queries()["links_topk_all_labels"](spark, SF).collect()
    labels = {label for label, _ in e.values()}
    assert {(e[r["source_row"]][0], e[r["target_row"]][0]) for r in links} == {(a, b) for a in labels for b in labels if a != b}
    assert all(r["weight"] == sum(x * y for x, y in zip(e[r["source_row"]][1], e[r["target_row"]][1], strict=True)) for r in links[:200])
