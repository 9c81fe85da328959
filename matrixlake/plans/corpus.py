"""Corpora: conversion from coordinates, opening, views over several, annotation, gathers, export.

A stored corpus is a folder with ``expression.parquet`` (a row per cell: genes and
counts as arrays), ``obs.parquet``, ``var.parquet``, optional ``extra/<name>`` and,
written last, ``corpus.yaml``. A view refers to its members' DataFrames and copies
nothing.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixlake.functions.text import member_key
from matrixlake.operators import counts as C
from matrixlake.operators import features as V
from matrixlake.operators import gather as G
from matrixlake.schema import ROUTING
from matrixlake.sources.tables import read_yaml, write_once, write_yaml

FORMAT, VERSION = "matrixlake-corpus", 1
TOTAL = "total_counts"


class CorpusError(ValueError):
    """A corpus cannot be made or used as asked."""


def convert(coo: DataFrame, obs: DataFrame, var: DataFrame, output: str, layer: str | None = None, attempt_conversion: bool = False, no_count: bool = False, round_counts: bool = False, features: tuple[str, object] | None = None, extra: Mapping[str, tuple[DataFrame, DataFrame]] | None = None, files: int | None = None) -> Corpus:
    """Coordinates (row, gene, value), cells (local_row_index, ...) and features (origin_index, ...) to a stored corpus.

    Counts are checked before anything is written. ``attempt_conversion`` recovers
    counts behind log1p; ``no_count``, ``round_counts`` and ``features`` need the
    matrix to be named by ``layer``.
    """
    spark = coo.sparkSession
    if os.path.exists(output):
        raise FileExistsError(output)
    if no_count and (not layer or attempt_conversion):
        raise CorpusError("no_count needs a named layer and no conversion")
    if (round_counts or features) and not layer:
        raise CorpusError("rounding and feature masks need a named layer")
    if TOTAL in obs.columns:
        raise CorpusError(f"the cells already have a column {TOTAL}")
    n_obs = obs.count()
    if not n_obs:
        raise CorpusError("there are no cells")
    V.check_origin_index(obs, "local_row_index")
    if features:
        coo, var = V.mask_features(coo, var, *features)
    n_var = var.count()
    V.check_origin_index(var)
    span = coo.agg(F.min("row"), F.max("row"), F.min("gene"), F.max("gene")).first()
    if span[0] is not None and (span[0] < 0 or span[1] >= n_obs or span[2] < 0 or span[3] >= n_var):
        raise CorpusError("the matrix does not fit the cells and features")
    share = None
    if no_count:
        kind, values = "non_count", C.validate_finite(coo)
    else:
        values, kind = C.sum_duplicates(coo), "counts"
        if round_counts:
            share = C.fractional_share(values).first()[0]
            values, kind = C.round_counts(values), "rounded_counts"
        if attempt_conversion and not C.count_report(values).first()["all_counts"]:
            values, kind = C.recover_counts(values), "recovered_counts"
        else:
            values = C.validate_counts(values)
    cells = obs.select(F.col("local_row_index").alias("row")).join(C.to_rows(values), "row", "left")
    type_of = values.schema["value"].dataType.simpleString()
    table = cells.select(F.col("row").cast("long").alias("global_row_index"), F.coalesce("genes", F.expr("cast(array() as array<int>)")).alias("genes"), F.coalesce("counts", F.expr(f"cast(array() as array<{type_of}>)")).alias("counts"))
    files = files or max(1, min(1000, n_obs // 100_000 + 1))
    write_once(table.repartitionByRange(files, "global_row_index").sortWithinPartitions("global_row_index"), f"{output}/expression.parquet")
    for name, (matrix, names) in (extra or {}).items():
        write_once(C.to_rows(C.sum_duplicates(matrix)).withColumnRenamed("row", "global_row_index"), f"{output}/extra/{name}/matrix.parquet")
        write_once(names, f"{output}/extra/{name}/var.parquet")
    if kind != "non_count":
        obs = C.cell_totals(values.withColumnRenamed("row", "local_row_index"), obs, "local_row_index", as_name=TOTAL)
    write_once(obs, f"{output}/obs.parquet")
    write_once(var, f"{output}/var.parquet")
    manifest = {"format": FORMAT, "version": VERSION, "shape": [n_obs, n_var], "value_kind": kind, "layer": layer, "extra": sorted(extra or {})}
    if share is not None:
        manifest["fractional_value_share"] = share
    write_yaml(manifest, Path(output, "corpus.yaml"))
    return open_corpus(spark, output)


def convert_files(files: DataFrame, cells: DataFrame, file_features: DataFrame, genes: DataFrame, output: str, guides: DataFrame | None = None) -> Corpus:
    """Many files in one corpus: ``cells`` (file_id, local_row, ...) gives the rows in order of ``local_row_index``;
    ``files``: (file_id, row, gene, value); ``file_features``: (file_id, origin_index, feature_id, feature_type).

    Each file's genes must be the wanted ones; its guides too, or it has none.
    """
    place = cells.select("file_id", F.col("local_row").alias("row"), F.col("local_row_index").alias("_to"))

    def part(kind: str, wanted: DataFrame, optional: bool) -> DataFrame:
        have = file_features.where(F.col("feature_type") == kind)
        want = wanted.select("feature_id", F.col("origin_index").alias("_new"))
        n = want.count()
        matched = have.join(want, "feature_id", "left")
        bad = matched.groupBy("file_id").agg(F.count("_new").alias("m"), F.count(F.lit(1)).alias("c"), F.count_distinct("feature_id").alias("d")).where(f"m <> {n} or c <> {n} or d <> {n}")
        used = cells.select("file_id").distinct()
        if not optional:
            bad = bad.select("file_id").unionByName(used.join(have.select("file_id").distinct(), "file_id", "left_anti"))
        if rows := bad.limit(3).collect():
            raise V.FeatureError(f"features of files {[r['file_id'] for r in rows]} are not the wanted ones")
        to = matched.select("file_id", F.col("origin_index").alias("gene"), "_new")
        return files.join(to, ["file_id", "gene"]).join(place, ["file_id", "row"]).select(F.col("_to").cast("long").alias("row"), F.col("_new").cast("int").alias("gene"), "value")

    extra = {"guides": (part("CRISPR Guide Capture", guides, True), guides)} if guides is not None else None
    obs = cells.withColumn("local_row_index", F.col("local_row_index").cast("long"))
    return convert(part("Gene Expression", genes, False), obs, genes, output, layer="X", extra=extra)


def open_corpus(spark: SparkSession, path: str, ex_obs: str | None = None, ex_var: str | None = None) -> Corpus:
    m = read_yaml(Path(path, "corpus.yaml"), ("format", "version", "shape"))
    if m["format"] != FORMAT or m["version"] != VERSION:
        raise CorpusError(f"{path}: not a corpus of version {VERSION}")
    table = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    obs = table(f"ex_obs{'_' + ex_obs if ex_obs else ''}") if ex_obs is not None else table("obs")
    var = table(f"ex_var{'_' + ex_var if ex_var else ''}") if ex_var is not None else table("var")
    if [obs.count(), var.count()] != list(m["shape"]):
        raise CorpusError(f"{path}: tables do not have the shape {m['shape']}")
    return Corpus(spark, [Member(Path(path).name, table("expression"), obs, var, *m["shape"], path)], m)


@dataclass
class Member:
    name: str
    expression: DataFrame
    obs: DataFrame
    var: DataFrame
    n_obs: int
    n_var: int
    path: str | None = None


class Corpus:
    """One corpus or a view over several."""

    def __init__(self, spark: SparkSession, members: list[Member], manifest: dict | None = None, feature_key: str | None = "feature_id", obs_columns: Sequence[str] | None = None):
        self.spark, self.members, self.manifest, self.feature_key, self.obs_columns = spark, members, manifest or {}, feature_key, obs_columns
        start, rows = 0, []
        for i, m in enumerate(members):
            rows.append((m.name, i, start, start + m.n_obs))
            start += m.n_obs
        self.n_obs = start
        self.entries = spark.createDataFrame(rows, "dataset_id string, dataset_index int, global_start long, global_end long")
        self._starts = [r[2] for r in rows]

    @property
    def dataset_ids(self) -> list[str]:
        return [m.name for m in self.members]

    @property
    def obs(self) -> DataFrame:
        """All cells with routing columns, which win over columns of those names."""
        parts = []
        for i, (m, s) in enumerate(zip(self.members, self._starts, strict=True)):
            o = m.obs
            keep = [c for c in (self.obs_columns or o.columns) if c not in ROUTING]
            cell = F.col("cell_id").cast("string") if "cell_id" in o.columns else F.col("local_row_index").cast("string")
            parts.append(o.select((F.col("local_row_index") + s).cast("long").alias("global_row_index"), F.lit(i).alias("dataset_index"), F.lit(m.name).alias("dataset_id"), F.col("local_row_index").cast("long"), cell.alias("cell_id"), *(f"`{c}`" for c in keep)))
        return G.strict_union(*parts)

    @property
    def vocabulary(self) -> DataFrame:
        """Features of all members with first-seen global ids; without ``feature_key`` features are local to their member."""
        parts = []
        for i, m in enumerate(self.members):
            key = F.col(self.feature_key).cast("string") if self.feature_key else member_key(m.name, F.col("origin_index"))
            parts.append(m.var.select(F.lit(i).alias("dataset_index"), F.col("origin_index").cast("int"), key.alias("feature_id")))
        return V.vocabulary(G.strict_union(*parts))

    @property
    def feature_presence(self) -> DataFrame:
        return V.presence(self.vocabulary)

    @property
    def expression(self) -> DataFrame:
        """(global_row_index, dataset_index, genes, counts) of all members; counts of mixed types become double."""
        kinds = {m.expression.schema["counts"].dataType.simpleString() for m in self.members}
        cast = (lambda: F.col("counts").cast("array<double>")) if len(kinds) > 1 else (lambda: F.col("counts"))
        parts = [m.expression.select((F.col("global_row_index") + s).alias("global_row_index"), F.lit(i).alias("dataset_index"), "genes", cast().alias("counts")) for i, (m, s) in enumerate(zip(self.members, self._starts, strict=True))]
        return G.strict_union(*parts)

    def coo(self) -> DataFrame:
        """(dataset_index, row, gene, value) with local genes."""
        return self.expression.select("dataset_index", F.col("global_row_index").alias("row"), F.explode(F.arrays_zip("genes", "counts")).alias("x")).select("dataset_index", "row", F.col("x.genes").alias("gene"), F.col("x.counts").alias("value"))

    def read(self, ids: Sequence[int]) -> DataFrame:
        """Cells in request order, with repeats."""
        G.check_range(G.request(self.spark, ids), self.n_obs)
        return G.gather_ids(self.expression, ids)

    def to_local_batch(self, ids: Sequence[int]) -> tuple:
        """Flat arrays (row_offsets, genes, counts, global_row_index) of a gather."""
        import numpy as np

        rows = self.read(ids).select("global_row_index", "genes", "counts").toPandas()
        size = rows["genes"].map(len).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
        flat = lambda c, t: np.concatenate([np.asarray(x, t) for x in rows[c]]) if len(rows) else np.zeros(0, t)
        kind = np.int32 if self.expression.schema["counts"].dataType.simpleString() == "array<int>" else np.float64
        return np.r_[0, np.cumsum(size)], flat("genes", np.int32), flat("counts", kind), rows["global_row_index"].to_numpy(np.int64)

    def take_metadata(self, ids: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        if isinstance(columns, str):
            raise TypeError("columns must be a list")
        obs = self.obs
        if columns is not None:
            if unknown := [c for c in columns if c not in obs.columns]:
                raise CorpusError(f"unknown columns: {unknown}")
            obs = obs.select("global_row_index", *(c for c in dict.fromkeys(columns) if c != "global_row_index"))
        G.check_range(G.request(self.spark, ids), self.n_obs)
        out = G.gather_ids(obs, ids)
        return out.select(*dict.fromkeys(columns), "pos") if columns is not None else out

    def read_extra(self, name: str, ids: Sequence[int]) -> tuple[DataFrame, DataFrame]:
        if len(self.members) != 1 or name not in self.manifest.get("extra", []):
            raise CorpusError(f"no extra matrix {name!r}")
        base = f"{self.members[0].path}/extra/{name}"
        rows = self.spark.read.parquet(f"{base}/matrix.parquet")
        asked = G.check_range(G.request(self.spark, ids), self.n_obs).withColumnRenamed("id", "global_row_index")
        return asked.join(rows, "global_row_index", "left").orderBy("pos"), self.spark.read.parquet(f"{base}/var.parquet")

    def dense_counts(self, ids: Sequence[int], genes: Sequence[str] | None = None) -> DataFrame:
        """(pos, id, counts, measured) on the global axis, or on the genes given, in their order."""
        vocab = self.vocabulary
        axis = vocab.select("global_id", "feature_id").distinct()
        if genes is not None:
            order = self.spark.createDataFrame(list(enumerate(genes)), "output_index int, feature_id string")
            axis = order.join(axis, "feature_id", "left")
            if missing := [r[0] for r in axis.where("global_id is null").select("feature_id").collect()]:
                raise CorpusError(f"unknown genes: {missing}")
        else:
            axis = axis.withColumn("output_index", F.col("global_id").cast("int"))
        G.check_range(G.request(self.spark, ids), self.n_obs)
        asked = G.route(G.request(self.spark, ids), self.entries)
        rows = self.coo().join(F.broadcast(asked.select(F.col("id").alias("row")).distinct()), "row")
        values = V.local_to_global(rows, vocab).select(F.col("row").alias("id"), "global_id", "value")
        return G.dense(asked, values, axis, vocab)

    def export(self, dataset_ids: Sequence[str] | str | None = None, rows: Sequence[int] | None = None, obs_columns: Sequence[str] | None = None, var_join: str = "exact", chunk_rows: int = 8192) -> dict[str, DataFrame]:
        """Lazy frames ``X`` (row, chunk, gene, value on the joined axis), ``obs``, ``var`` and ``presence``."""
        chosen = [dataset_ids] if isinstance(dataset_ids, str) else list(dataset_ids) if dataset_ids is not None else self.dataset_ids
        if not chosen or len(set(chosen)) != len(chosen) or (unknown := [d for d in chosen if d not in self.dataset_ids]):
            raise CorpusError(f"unknown, repeated or no datasets: {chosen}")
        numbers = [self.dataset_ids.index(d) for d in chosen]
        vocab = self.vocabulary.where(F.col("dataset_index").isin(numbers))
        axis = V.axis(vocab, "inner" if len(chosen) == 1 else var_join)
        coo = self.coo().where(F.col("dataset_index").isin(numbers))
        obs = self.obs.where(F.col("dataset_index").isin(numbers))
        if rows is not None:
            G.check_range(G.request(self.spark, rows), self.n_obs)
            asked = G.few(G.request(self.spark, rows), len(rows))
            obs = obs.join(asked.withColumnRenamed("id", "global_row_index"), "global_row_index")
            coo = coo.join(asked.withColumnRenamed("id", "row"), "row").withColumn("row", F.col("pos").cast("long"))
        if obs_columns is not None:
            if unknown := [c for c in obs_columns if c not in obs.columns]:
                raise CorpusError(f"unknown columns: {unknown}")
            obs = obs.select(*ROUTING, *(c for c in dict.fromkeys(obs_columns) if c not in ROUTING), *(["pos"] if rows is not None else []))
        return {"X": G.chunks(V.align(coo, vocab, axis), chunk_rows), "obs": obs, "var": axis.orderBy("output_index"), "presence": V.presence(vocab)}

    def write_export(self, path: str, **options) -> None:
        if os.path.exists(path):
            raise FileExistsError(path)
        for name, df in self.export(**options).items():
            write_once(df, f"{path}/{name}.parquet")

    def add_obs(self, extra: DataFrame, overwrite: bool = False) -> Corpus:
        """New columns by position: ``extra`` has local_row_index and cell_id like the cells', element by element."""
        if len(self.members) != 1:
            raise CorpusError("annotate the members of a view")
        m = self.members[0]
        new = [c for c in extra.columns if c not in ("local_row_index", "cell_id")]
        if bad := [c for c in new if c in ROUTING]:
            raise CorpusError(f"reserved columns: {bad}")
        if (clash := [c for c in new if c in m.obs.columns]) and not overwrite:
            raise CorpusError(f"columns are there already: {clash}")
        if "cell_id" in m.obs.columns and "cell_id" in extra.columns:
            both = m.obs.select("local_row_index", "cell_id").join(extra.select("local_row_index", F.col("cell_id").alias("_c")), "local_row_index", "full")
            if not both.where("not (cell_id <=> _c)").isEmpty() or extra.count() != m.n_obs:
                raise CorpusError("the rows or their order differ")
        elif not m.obs.select("local_row_index").join(extra, "local_row_index", "left_anti").isEmpty() or extra.count() != m.n_obs:
            raise CorpusError("the rows differ")
        obs = m.obs.drop(*clash).join(extra.select("local_row_index", *new), "local_row_index")
        return Corpus(self.spark, [Member(m.name, m.expression, obs, m.var, m.n_obs, m.n_var, m.path)], self.manifest, self.feature_key)

    def save_obs(self, name: str = "") -> str:
        """The annotated cells beside the stored ones, after a check that rows and their ids are the same."""
        m = self.members[0]
        if m.path is None:
            raise CorpusError("a view is not stored")
        stored = self.spark.read.parquet(f"{m.path}/obs.parquet")
        keys = [c for c in ("local_row_index", "cell_id") if c in stored.columns and c in m.obs.columns]
        if m.obs.count() != m.n_obs or not stored.select(*keys).exceptAll(m.obs.select(*keys)).isEmpty():
            raise CorpusError("the rows differ from the stored ones")
        path = f"{m.path}/ex_obs{'_' + name if name else ''}.parquet"
        m.obs.write.mode("overwrite").parquet(path)
        return path

    def save_var(self, name: str = "") -> str:
        """The annotated features beside the stored ones, after a check that they are the same in the same order."""
        m = self.members[0]
        if m.path is None or len(self.members) != 1:
            raise CorpusError("a view is not stored")
        stored = self.spark.read.parquet(f"{m.path}/var.parquet")
        keys = [c for c in ("origin_index", self.feature_key) if c and c in stored.columns]
        if m.var.count() != m.n_var or not stored.select(*keys).exceptAll(m.var.select(*keys)).isEmpty():
            raise CorpusError("the features differ from the stored ones")
        path = f"{m.path}/ex_var{'_' + name if name else ''}.parquet"
        m.var.write.mode("overwrite").parquet(path)
        return path

    def with_var(self, var: DataFrame) -> Corpus:
        """The corpus with an annotated feature table."""
        m = self.members[0]
        return Corpus(self.spark, [Member(m.name, m.expression, m.obs, var, m.n_obs, m.n_var, m.path)], self.manifest, self.feature_key)

    @property
    def global_vocab_size(self) -> int:
        return self.vocabulary.select("global_id").distinct().count()

    @property
    def max_local_vocab(self) -> int:
        return max(m.n_var for m in self.members)

    def to_local_feature_ids(self) -> list[str]:
        """Ids of the global axis, in order."""
        return [r[0] for r in self.vocabulary.select("global_id", "feature_id").distinct().orderBy("global_id").select("feature_id").collect()]

    def hvg(self, n: int | None = None) -> DataFrame:
        """Features with ``hvg_rank`` and, for n, the mask of the first n."""
        parts = [m.var.select(F.lit(i).alias("dataset_index"), "origin_index", (F.col("highly_variable") if "highly_variable" in m.var.columns else F.lit(False)).alias("highly_variable")) for i, m in enumerate(self.members)]
        ranked = V.hvg_ranks(G.strict_union(*parts))
        return V.hvg_mask(ranked, n) if n is not None else ranked


def unique_names(obs: DataFrame, name: str = "cell_id", order: str = "pos") -> DataFrame:
    """Names of repeated rows made unique: the first keeps its name, later ones get -1, -2, ..."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return obs.withColumn(name, F.when(k == 0, F.col(name)).otherwise(F.concat_ws("-", name, k)))


def concat(corpora: Mapping[str, Corpus], feature_key: str | None = "feature_id", obs_columns: Sequence[str] | None = None, var_columns: Sequence[str] = (), obs: Mapping[str, DataFrame] | None = None, var: Mapping[str, DataFrame] | None = None) -> Corpus:
    """A view over named corpora; ids must be unique within each, attributes of shared features must agree.

    ``obs`` and ``var`` replace members' tables; rows and their numbers must be the members' own.
    """
    for given, key, what in ((obs, "local_row_index", "obs"), (var, "origin_index", "var")):
        if unknown := sorted(set(given or {}) - set(corpora)):
            raise CorpusError(f"no members {unknown}")
        for name, df in (given or {}).items():
            old = getattr(corpora[name].members[0], what)
            if df.count() != old.count() or not old.select(key).exceptAll(df.select(key)).isEmpty():
                raise CorpusError(f"{name}: the rows differ")
    if not corpora or any(not isinstance(k, str) or not k for k in corpora):
        raise CorpusError("members need names")
    members = []
    for name, c in corpora.items():
        if len(c.members) != 1:
            raise CorpusError("members must not be views")
        m = c.members[0]
        m = Member(m.name, m.expression, (obs or {}).get(name, m.obs), (var or {}).get(name, m.var), m.n_obs, m.n_var, m.path)
        if feature_key:
            if feature_key not in m.var.columns or not m.var.where(F.col(feature_key).isNull() | (F.col(feature_key).cast("string") == "")).isEmpty():
                raise CorpusError(f"{name}: features without id")
            V.require_unique(m.var, feature_key)
        members.append(Member(name, m.expression, m.obs, m.var, m.n_obs, m.n_var, m.path))
    spark = next(iter(corpora.values())).spark
    if var_columns:
        parts = [m.var.select(F.lit(i).alias("dataset_index"), F.col(feature_key).alias("feature_id"), *var_columns) for i, m in enumerate(members)]
        merged = V.merge_attributes(G.strict_union(*parts), "feature_id", list(var_columns))
        if rows := merged.where("conflict").limit(3).collect():
            raise CorpusError(f"members disagree on features {[r['feature_id'] for r in rows]}")
    out = Corpus(spark, members, {}, feature_key, obs_columns)
    _ = out.obs.schema  # differing column types are an error now, not when first used
    return out
