"""The driver's tables as matrices, features, cells and groups; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def coo(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value"))


DATASET = {"A": 0, "N": 1, "R": 2}
DATASET_SQL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def dataset_coo(spark: SparkSession, d: str) -> DataFrame:
    ds = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, d, "lineitem").select(ds.alias("dataset_index"), F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("value"))


def var(spark: SparkSession, d: str) -> DataFrame:
    """Features of each dataset, numbered by the first cell that has them."""
    first = dataset_coo(spark, d).groupBy("dataset_index", F.col("part").alias("feature_id")).agg(F.min("row").alias("first"))
    w = Window.partitionBy("dataset_index").orderBy("first", "feature_id")
    return first.select("dataset_index", (F.row_number().over(w) - 1).cast("int").alias("origin_index"), "feature_id")


VAR_SQL = f"""f AS (SELECT {DATASET_SQL} AS dataset_index, l_partkey AS feature_id, min(l_orderkey) AS fo FROM lineitem GROUP BY 1, 2),
var AS (SELECT dataset_index, CAST(row_number() OVER (PARTITION BY dataset_index ORDER BY fo, feature_id) - 1 AS INTEGER) AS origin_index, feature_id FROM f),
m AS (SELECT feature_id, min(dataset_index * 1000000000 + origin_index) AS k FROM var GROUP BY 1),
vocab AS (SELECT dataset_index, origin_index, feature_id, CAST(dense_rank() OVER (ORDER BY m.k) - 1 AS BIGINT) AS global_id FROM var JOIN m USING (feature_id))"""


def local_coo(spark: SparkSession, d: str) -> DataFrame:
    """Counts with the dataset's own feature numbers."""
    names = var(spark, d).select("dataset_index", F.col("feature_id").alias("part"), F.col("origin_index").alias("gene"))
    return dataset_coo(spark, d).join(names, ["dataset_index", "part"]).select("dataset_index", "row", "gene", "value")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells for grouping: status (P is null), priority, year."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("row"), F.expr("nullif(o_orderstatus, 'P')").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))


CELLS_SQL = "cells AS (SELECT o_orderkey AS r, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders)"


def groups_sql(by: str) -> str:
    """Groups ``g`` (grp, keys, n) and members ``mem`` (grp, r, k); ``by``: columns of cells."""
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"g.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    return f"""{CELLS_SQL},
g AS (SELECT CAST(row_number() OVER (ORDER BY min(r)) - 1 AS INTEGER) AS grp, {by}, count(*) AS n FROM cells GROUP BY {by}),
mem AS (SELECT g.grp, c.r, row_number() OVER (PARTITION BY g.grp ORDER BY c.r) - 1 AS k, g.n FROM cells c JOIN g ON {same})"""


def u_sql(text: str) -> str:
    """The uniform draw of a key."""
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"
