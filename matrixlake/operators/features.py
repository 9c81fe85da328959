"""Feature axes: first-seen vocabulary, presence, joins of axes, masks, matches by id, checks of attributes.

A var table has (dataset_index, origin_index, feature_id). Windows without a
partition run over features, never over cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class FeatureError(ValueError):
    """Feature tables do not fit."""


def check_origin_index(var: DataFrame, origin: str = "origin_index", by: str | None = None) -> DataFrame:
    """Raises unless the numbers of each dataset are 0..n-1, each once."""
    g = var.groupBy(by) if by else var.groupBy()
    bad = g.agg(F.min(origin).alias("lo"), F.max(origin).alias("hi"), F.count_distinct(origin).alias("d"), F.count(F.lit(1)).alias("n"))
    if not bad.where("n > 0 and (lo <> 0 or hi <> n - 1 or d <> n)").isEmpty():
        raise FeatureError("feature numbers must be 0..n-1, each once")
    return var


def vocabulary(var: DataFrame, dataset: str = "dataset_index", origin: str = "origin_index", feature: str = "feature_id") -> DataFrame:
    """``var`` with ``global_id``: features in the order in which (dataset, origin) first shows them."""
    first = var.groupBy(feature).agg(F.min(F.struct(dataset, origin)).alias("first"))
    ids = first.select(feature, (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("global_id"))
    return var.join(ids, feature)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if rows := duplicate_keys(df, *keys).limit(3).collect():
        raise FeatureError(f"repeated keys: {[tuple(r)[:-1] for r in rows]}")
    return df


def local_to_global(coo: DataFrame, vocab: DataFrame, dataset: str = "dataset_index", gene: str = "gene") -> DataFrame:
    """Local gene numbers to global ids; the vocabulary is joined by dataset and number."""
    keys = vocab.select(F.col(dataset), F.col("origin_index").alias(gene), "global_id")
    return coo.join(keys, [dataset, gene])


def global_map(vocab: DataFrame, datasets: DataFrame, width: int) -> DataFrame:
    """(dataset_index, origin_index, global_id) padded with -1 up to ``width``."""
    grid = datasets.select("dataset_index").join(datasets.sparkSession.range(width).select(F.col("id").cast("int").alias("origin_index")))
    return grid.join(vocab.select("dataset_index", "origin_index", "global_id"), ["dataset_index", "origin_index"], "left").withColumn("global_id", F.coalesce("global_id", F.lit(-1)))


def presence(vocab: DataFrame, dataset: str = "dataset_index", feature: str = "feature_id") -> DataFrame:
    """(feature, global_id, dataset, measured) for every pair: an unmeasured zero is told from a measured one."""
    features, datasets = vocab.select("global_id", feature).distinct(), vocab.select(dataset).distinct()
    has = vocab.select("global_id", dataset).distinct().withColumn("measured", F.lit(True))
    # features by datasets is the result asked for
    return features.crossJoin(datasets).join(has, ["global_id", dataset], "left").withColumn("measured", F.coalesce("measured", F.lit(False)))


def uniform_probability(vocab: DataFrame, dataset: str = "dataset_index") -> DataFrame:
    return vocab.withColumn("probability", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(dataset))).cast("float"))


def hvg_ranks(var: DataFrame, flag: str = "highly_variable", by: str = "dataset_index", origin: str = "origin_index") -> DataFrame:
    """Ranks 1..n of the flagged features, in feature order; 0 for others."""
    n = F.row_number().over(Window.partitionBy(by, F.coalesce(flag, F.lit(False))).orderBy(origin))
    return var.withColumn("hvg_rank", F.when(F.coalesce(flag, F.lit(False)), n).otherwise(0))


def hvg_mask(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.withColumn("hvg", (F.col("hvg_rank") >= 1) & (F.col("hvg_rank") <= n))


def mask_features(coo: DataFrame, var: DataFrame, column: str, value, gene: str = "gene", origin: str = "origin_index") -> tuple[DataFrame, DataFrame]:
    """Matrix and var of the features with that value, renumbered from 0."""
    kept = var.where(F.col(column) == F.lit(value)).withColumn("_new", (F.row_number().over(Window.orderBy(origin)) - 1).cast("int"))
    to = kept.select(F.col(origin).alias(gene), "_new")
    out = coo.join(to, gene).withColumn(gene, F.col("_new")).drop("_new")
    return out.select(*coo.columns), kept.withColumn(origin, F.col("_new")).drop("_new").select(*var.columns)


def axis_exact(vocab: DataFrame, dataset: str = "dataset_index", origin: str = "origin_index", feature: str = "feature_id") -> DataFrame:
    """One row: whether all datasets have the same features in the same order."""
    n = vocab.agg(F.count_distinct(dataset).alias("n"))
    by_place = vocab.groupBy(origin).agg(F.count_distinct(feature).alias("f"), F.count(F.lit(1)).alias("c"))
    return by_place.join(F.broadcast(n)).agg(F.coalesce(F.bool_and(F.expr("f = 1 and c = n")), F.lit(False)).alias("exact"))


def axis_inner(vocab: DataFrame, dataset: str = "dataset_index", origin: str = "origin_index", feature: str = "feature_id") -> DataFrame:
    """(output_index, global_id, feature): features of all datasets, in the first dataset's order."""
    n = vocab.agg(F.count_distinct(dataset).alias("n"))
    shared = vocab.groupBy("global_id", feature).agg(F.count_distinct(dataset).alias("d"), F.min(F.struct(dataset, origin)).alias("first")).join(F.broadcast(n)).where("d = n")
    return shared.select((F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("output_index"), "global_id", feature)


def axis_outer(vocab: DataFrame, feature: str = "feature_id") -> DataFrame:
    """(output_index, global_id, feature): features of any dataset, in first-seen order."""
    found = vocab.select("global_id", feature).distinct()
    return found.select((F.row_number().over(Window.orderBy("global_id")) - 1).cast("int").alias("output_index"), "global_id", feature)


def axis(vocab: DataFrame, how: str) -> DataFrame:
    if how not in ("exact", "inner", "outer"):
        raise FeatureError(f"unknown axis join: {how}")
    if how == "exact" and not axis_exact(vocab).first()["exact"]:
        raise FeatureError("the datasets' features differ; join inner or outer")
    out = axis_outer(vocab) if how == "outer" else axis_inner(vocab)
    if out.isEmpty():
        raise FeatureError("no feature is left on the axis")
    return out


def align(coo: DataFrame, vocab: DataFrame, axis_table: DataFrame) -> DataFrame:
    """Values on the axis: ``gene`` becomes the output index; genes off the axis go, rows without values stay out of a coordinate table anyway."""
    to = vocab.join(axis_table.select("global_id", "output_index"), "global_id").select("dataset_index", F.col("origin_index").alias("gene"), "output_index")
    rest = [c for c in coo.columns if c != "gene"]
    return coo.join(to, ["dataset_index", "gene"]).select(*rest, F.col("output_index").alias("gene"))


def match_features(found: DataFrame, wanted: DataFrame, kind: str | None = None) -> DataFrame:
    """(file_index, output_index): the file's features of a kind and the wanted ones must be the same set of ids."""
    have = found.where(F.col("feature_type") == kind) if kind else found
    both = have.select("feature_id", F.col("origin_index").alias("file_index")).join(wanted.select("feature_id", F.col("origin_index").alias("output_index")), "feature_id", "full")
    return both.withColumn("matched", F.col("file_index").isNotNull() & F.col("output_index").isNotNull())


def require_match(found: DataFrame, wanted: DataFrame, kind: str | None = None) -> DataFrame:
    out = match_features(found, wanted, kind)
    if not out.where("not matched").isEmpty() or not duplicate_keys(out, "feature_id").isEmpty():
        raise FeatureError("a file's features are not the wanted ones")
    return out.drop("matched")


def map_genes(genes: DataFrame, table: DataFrame, gene: str = "gene_id", mapped: str = "canonical_gene_id") -> DataFrame:
    """Left join with a gene map (gene, mapped); genes that it lacks keep their id."""
    t = table.select(F.col(table.columns[0]).alias(gene), F.col(table.columns[1]).alias("_to"))
    return genes.join(t, gene, "left").withColumn(mapped, F.coalesce("_to", gene)).drop("_to")


def merge_attributes(members: DataFrame, feature: str, columns: list[str], order: str = "dataset_index") -> DataFrame:
    """One row a feature: the first non-null value by member; more than one distinct value is a conflict (``conflict``)."""
    out = []
    for c in columns:
        out.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c))
    clash = [F.count_distinct(c) > 1 for c in columns]
    any_clash = clash[0]
    for x in clash[1:]:
        any_clash = any_clash | x
    return members.groupBy(feature).agg(*out, any_clash.alias("conflict"))


def global_ranges(datasets: DataFrame, size: str = "n_cells", order: str = "dataset_index") -> DataFrame:
    """Half-open ranges of global rows, one dataset after the other."""
    stop = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return datasets.withColumn("global_end", stop.cast("long")).withColumn("global_start", (F.col("global_end") - F.col(size)).cast("long"))
