"""Gathers of rows in request order, with repeats; ranges; dense values on an axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PUSH_IDS = 1000
BROADCAST_IDS = 1_000_000


class RowError(IndexError):
    """A row that is not there was asked for."""


def request(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    """(pos, id) of the ids asked for, in order. A range is counted out by the executors and never listed on the driver."""
    if isinstance(ids, range):
        return spark.range(len(ids)).select(F.col("id").alias("pos"), (F.col("id") * ids.step + ids.start).alias("id"))
    return spark.createDataFrame(list(enumerate(map(int, ids))), "pos long, id long")


def check_range(requested: DataFrame, n_rows: int) -> DataFrame:
    r = requested.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if r["lo"] is not None and (r["lo"] < 0 or r["hi"] >= n_rows):
        raise RowError(f"rows {r['lo']}..{r['hi']} asked for, 0..{n_rows - 1} are there")
    return requested


def few(requested: DataFrame, n: int | None) -> DataFrame:
    """The request, to be broadcast if it is known to be small."""
    return F.broadcast(requested) if n is not None and n <= BROADCAST_IDS else requested


def gather(table: DataFrame, requested: DataFrame, key: str = "global_row_index", n_requested: int | None = None) -> DataFrame:
    """Rows of ``table`` by key, one for each request, with ``pos``. A request that is known to be small is broadcast."""
    return table.join(few(requested.select("pos", F.col("id").alias(key)), n_requested), key)


def gather_ids(table: DataFrame, ids: Sequence[int], key: str = "global_row_index") -> DataFrame:
    """As ``gather`` for a list; few ids also go to the scan as a filter."""
    if len(ids) <= PUSH_IDS:
        table = table.where(F.col(key).isin([int(i) for i in set(ids)])) if len(ids) else table.where("false")
    return gather(table, request(table.sparkSession, ids), key, len(ids)).orderBy("pos")


def route(requested: DataFrame, entries: DataFrame) -> DataFrame:
    """The dataset and local row of each global row; ``entries``: (dataset_id, dataset_index, global_start, global_end), few."""
    e = F.broadcast(entries.select("dataset_id", "dataset_index", "global_start", "global_end"))
    return requested.join(e, (F.col("id") >= F.col("global_start")) & (F.col("id") < F.col("global_end"))).select("pos", "id", "dataset_id", "dataset_index", (F.col("id") - F.col("global_start")).alias("local_row_index"))


def row_ranges(requested: DataFrame, max_gap: int = 0, by: str | None = None) -> DataFrame:
    """(start, stop, n): runs of distinct ids, with gaps of at most ``max_gap`` rows filled."""
    keys = [by] if by else []
    ids = requested.select("id", *keys).distinct()
    w = Window.partitionBy(*keys).orderBy("id")
    new = F.coalesce((F.col("id") - F.lag("id").over(w) > max_gap + 1).cast("int"), F.lit(1))
    runs = ids.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("_run", *keys).agg(F.min("id").alias("start"), (F.max("id") + 1).alias("stop"), F.count(F.lit(1)).alias("n_requested")).drop("_run")


def dense(requested: DataFrame, values: DataFrame, axis: DataFrame, present: DataFrame) -> DataFrame:
    """A row per request: ``counts`` and ``measured`` along the axis.

    ``requested``: (pos, id, dataset_index); ``values``: (id, global_id, value);
    ``axis``: (output_index, global_id); ``present``: (dataset_index, global_id).
    """
    # rows asked for by features: the dense form itself
    grid = requested.select("pos", "id", "dataset_index").crossJoin(axis.select("output_index", "global_id"))
    v = values.select("id", "global_id", F.col("value").cast("float").alias("value"))
    full = grid.join(v, ["id", "global_id"], "left").join(present.select("dataset_index", "global_id").distinct().withColumn("m", F.lit(True)), ["dataset_index", "global_id"], "left")
    items = F.array_sort(F.collect_list(F.struct("output_index", F.coalesce("value", F.lit(0.0).cast("float")).alias("c"), F.coalesce("m", F.lit(False)).alias("m"))))
    return full.groupBy("pos", "id").agg(items.alias("x")).select("pos", "id", F.col("x.c").alias("counts"), F.col("x.m").alias("measured"))


def strict_union(*frames: DataFrame) -> DataFrame:
    """Union of frames with the same names and types; anything else is an error."""
    shape = lambda d: sorted((f.name, f.dataType.simpleString()) for f in d.schema)
    out = frames[0]
    for f in frames[1:]:
        if shape(f) != shape(out):
            raise ValueError(f"schemas differ: {sorted(set(shape(f)) ^ set(shape(out)))}")
        out = out.unionByName(f)
    return out


def diagonal_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def chunks(rows: DataFrame, chunk_rows: int = 8192, row: str = "row") -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col(row) / chunk_rows))
