"""Rewrites of a table in a new row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixlake.functions.draws import order as draw


def reorder(table: DataFrame, order: DataFrame, row: str = "global_row_index", source: str = "source_row") -> DataFrame:
    """Rows at their new positions; ``order``: (row, new_row), which may leave rows out. The old number is kept in ``source_row``."""
    to = order.select(F.col("row").alias(row), F.col("new_row").cast("long").alias("_new"))
    return table.join(to, row).withColumn(source, F.col(row)).withColumn(row, F.col("_new")).drop("_new")


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(row, new_row): all rows in the order of their draws; ranks are taken within slots of the draws, so no window spans all rows."""
    keyed = rows.select("row", draw(seed, F.col("row")).alias("_draw")).withColumn("_slot", F.substring("_draw", 1, 3))
    sizes = keyed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_slot", (F.sum("_n").over(Window.orderBy("_slot")) - F.col("_n")).alias("_start"))  # at most 4096
    rank = F.row_number().over(Window.partitionBy("_slot").orderBy("_draw", "row")) - 1
    return keyed.withColumn("_k", rank).join(F.broadcast(starts), "_slot").select("row", (F.col("_start") + F.col("_k")).alias("new_row"))


def write_reordered(table: DataFrame, order: DataFrame, path: str, files: int = 8, row: str = "global_row_index") -> DataFrame:
    """Range-partitioned by new position and sorted inside, then checked to hold 0..n-1."""
    spark = table.sparkSession
    reorder(table, order, row).repartitionByRange(files, row).sortWithinPartitions(row).write.mode("errorifexists").parquet(path)
    out = spark.read.parquet(path)
    r = out.agg(F.min(row).alias("lo"), F.max(row).alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct(row).alias("d")).first()
    if r["n"] and (r["lo"], r["hi"], r["d"]) != (0, r["n"] - 1, r["n"]):
        raise ValueError(f"the new order is not 0..{r['n'] - 1}")
    return out
