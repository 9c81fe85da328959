"""Corpora that are really written, opened, joined to a view, annotated, exported and managed.

Orders below the middle key are the cells of corpus ``a``, the others of ``b``;
parts are the features, in reverse order in ``b``. Row numbers of the view are
order keys. Each query runs the library's own functions over whole tables.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake import cli
from matrixlake.operators import features as V
from matrixlake.operators.reorder import write_reordered
from matrixlake.plans import canonical as H
from matrixlake.plans import corpus as K
from matrixlake.plans import drafting as D
from matrixlake.plans import inspection as I
from matrixlake.plans import manage as M
from matrixlake.queries import canonical as Q
from matrixlake.queries.data import table
from matrixlake.session import scratch
from matrixlake.sources import staging
from matrixlake.sources import tables as T

_made: dict[tuple[str, str], tuple] = {}


def _source(spark, d: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coordinates, cells and features of corpus a or b."""
    orders, parts = table(spark, d, "orders"), table(spark, d, "part")
    n, p = orders.count(), parts.count()
    lo, hi = (0, (n + 1) // 2) if name == "a" else ((n + 1) // 2, n)
    gene = lambda c: F.col(c) if name == "a" else p - 1 - F.col(c)
    coo = table(spark, d, "lineitem").where(F.col("l_orderkey").between(lo, hi - 1))
    coo = coo.select((F.col("l_orderkey") - lo).alias("row"), gene("l_partkey").cast("int").alias("gene"), F.col("l_quantity").alias("value"))
    obs = orders.where(F.col("o_orderkey").between(lo, hi - 1))
    obs = obs.select((F.col("o_orderkey") - lo).alias("local_row_index"), F.col("o_orderkey").cast("string").alias("cell_id"), F.col("o_orderstatus").alias("status"))
    return coo, obs, parts.select(gene("p_partkey").cast("int").alias("origin_index"), F.concat(F.lit("P"), F.col("p_partkey")).alias("feature_id"))


def _corpora(spark, d: str) -> tuple[K.Corpus, K.Corpus, int, int]:
    """Corpora a and b, written once for a session and folder; the number of cells, and where b begins."""
    key = spark.sparkContext.applicationId, d
    if key not in _made:
        base = scratch(spark)
        a, b = (K.convert(*_source(spark, d, x), f"{base}/{x}") for x in "ab")
        _made[key] = a, b, a.n_obs + b.n_obs, a.n_obs
    return _made[key]


def _view(spark, d: str) -> K.Corpus:
    a, b, _, _ = _corpora(spark, d)
    return K.concat({"a": a, "b": b})


_H = "h AS (SELECT (count(*) + 1) // 2 AS h, count(*) AS n FROM orders), p AS (SELECT count(*) AS p FROM part)"
_COO = f"WITH {_H}, x AS (SELECT l_orderkey AS k, l_partkey AS g, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
_CELLS = f"WITH {_H}, c AS (SELECT o_orderkey AS k, CAST(o_orderkey >= h AS INTEGER) AS i, CASE WHEN o_orderkey >= h THEN o_orderkey - h ELSE o_orderkey END AS r, o_orderstatus AS status, o_totalprice AS price, h, n FROM orders, h), t AS (SELECT l_orderkey AS k, sum(l_quantity) AS v, count(DISTINCT l_partkey) AS g FROM lineitem GROUP BY 1)"
_XYV = "CAST(v AS DOUBLE) AS value"


def convert_counts(spark, d) -> DataFrame:
    return _view(spark, d).coo().withColumn("value", F.col("value").cast("double"))


def open_obs_totals(spark, d) -> DataFrame:
    return _view(spark, d).obs.select("global_row_index", "dataset_index", "dataset_id", "local_row_index", "cell_id", "status", F.col("total_counts").cast("double").alias("total_counts"))


def view_metadata_reversed(spark, d) -> DataFrame:
    return _view(spark, d).take_metadata(range(_corpora(spark, d)[2] - 1, -1, -1), ["status", "cell_id"])


def view_rows_reversed(spark, d) -> DataFrame:
    rows = _view(spark, d).read(range(_corpora(spark, d)[2] - 1, -1, -1))
    return rows.select("pos", "global_row_index", F.size("genes").cast("long").alias("n_genes"), F.expr("cast(aggregate(counts, 0D, (s, x) -> s + x) as double)").alias("total"))


def _exported(spark, d) -> str:
    path = f"{scratch(spark)}/export"
    _view(spark, d).write_export(path, obs_columns=["status"], var_join="inner", chunk_rows=1000)
    return path


def export_view(spark, d) -> DataFrame:
    return spark.read.parquet(f"{_exported(spark, d)}/X.parquet").select("row", "chunk", "gene", F.col("value").cast("double").alias("value"))


def export_view_obs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{_exported(spark, d)}/obs.parquet")


def export_view_presence(spark, d) -> DataFrame:
    return spark.read.parquet(f"{_exported(spark, d)}/presence.parquet").select("feature_id", "dataset_index", "measured")


def export_one_dataset_rows(spark, d) -> DataFrame:
    _, _, n, h = _corpora(spark, d)
    return _view(spark, d).export("b", rows=range(n - 1, h - 1, -1))["X"].select("row", "chunk", "gene", F.col("value").cast("double").alias("value"))


def view_mixed_types(spark, d) -> DataFrame:
    """Whole and fractional counts in one view become doubles."""
    a, _, _, _ = _corpora(spark, d)
    coo, obs, var = _source(spark, d, "b")
    c = K.convert(coo.groupBy("row", "gene").agg((F.sum("value") / 4).alias("value")), obs, var, f"{scratch(spark)}/c", layer="quarter", no_count=True)
    m = a.members[0]
    plain = K.Corpus(spark, [K.Member("a", m.expression, m.obs.drop("total_counts"), m.var, m.n_obs, m.n_var)])
    return K.concat({"a": plain, "c": c}).coo()


def save_obs_price(spark, d) -> DataFrame:
    coo, obs, var = _source(spark, d, "a")
    a = K.convert(coo, obs, var, f"{scratch(spark)}/a")
    price = table(spark, d, "orders").select(F.col("o_orderkey").alias("local_row_index"), F.col("o_orderkey").cast("string").alias("cell_id"), F.col("o_totalprice").alias("price")).where(F.col("local_row_index") < a.n_obs)
    a.add_obs(price).save_obs("price")
    return K.open_corpus(spark, a.members[0].path, ex_obs="price").obs.select("global_row_index", "cell_id", "status", "price")


def _files(spark, d) -> K.Corpus:
    """A file for each return flag, in which orders are rows from the last to the first; suppliers are guides, after or before the parts."""
    items, p, s = table(spark, d, "lineitem"), table(spark, d, "part").count(), table(spark, d, "supplier").count()
    flag, n = F.col("l_returnflag").alias("file_id"), table(spark, d, "orders").count()
    each = F.explode(F.array(*map(F.lit, "ANR"))).alias("file_id")
    cells = table(spark, d, "orders").select("o_orderkey", each).select("file_id", (n - 1 - F.col("o_orderkey")).alias("local_row"), (F.col("o_orderkey") + n * F.expr("case file_id when 'A' then 0 when 'N' then 1 else 2 end")).alias("local_row_index"))
    first = F.expr("file_id = 'N'")  # here the suppliers come first
    gene, guide = F.when(first, F.col("part") + s).otherwise(F.col("part")), F.when(first, F.col("supp")).otherwise(F.col("supp") + p)
    both = items.select(flag, (n - 1 - F.col("l_orderkey")).alias("row"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("value"))
    files = both.select("file_id", "row", gene.cast("int").alias("gene"), "value").unionByName(both.select("file_id", "row", guide.cast("int").alias("gene"), "value"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("part"))
    supps = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"))
    of = lambda df, at, name, key, kind: df.select("*", each).select("file_id", at.cast("int").alias("origin_index"), F.concat(F.lit(name), F.col(key)).alias("feature_id"), F.lit(kind).alias("feature_type"))
    features = of(parts, gene, "P", "part", "Gene Expression").unionByName(of(supps, guide, "S", "supp", "CRISPR Guide Capture"))
    genes = parts.select(F.col("part").cast("int").alias("origin_index"), F.concat(F.lit("P"), F.col("part")).alias("feature_id"))
    guides = supps.select(F.col("supp").cast("int").alias("origin_index"), F.concat(F.lit("S"), F.col("supp")).alias("feature_id"))
    return K.convert_files(files, cells, features, genes, f"{scratch(spark)}/files", guides)


def convert_many_files(spark, d) -> DataFrame:
    return _files(spark, d).coo().select("row", "gene", F.col("value").cast("double").alias("value"))


def read_extra_all(spark, d) -> DataFrame:
    c = _files(spark, d)
    rows, names = c.read_extra("guides", range(c.n_obs - 1, -1, -1))
    flat = rows.select("pos", F.explode(F.arrays_zip("genes", "counts")).alias("x")).select("pos", F.col("x.genes").alias("origin_index"), F.col("x.counts").cast("double").alias("value"))
    return flat.join(names, "origin_index").select("pos", "feature_id", "value")


_FILES_SQL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def write_reordered_all(spark, d) -> DataFrame:
    v, n = _view(spark, d), _corpora(spark, d)[2]
    order = spark.range(n).select(F.col("id").alias("row"), (n - 1 - F.col("id")).alias("new_row"))
    out = write_reordered(v.expression, order, f"{scratch(spark)}/reordered")
    return out.select("global_row_index", "source_row", F.size("genes").cast("long").alias("n_genes"))


def _managed(spark, d, topology: str) -> str:
    root = f"{scratch(spark)}/managed"
    for x in "ab":
        coo, obs, var = _source(spark, d, x)
        M.materialize_dataset(root, x, coo, obs, var, {"readiness": "pass", "count_source": ".X", "source_path": f"{x}.parquet"}, topology)
    return root


def materialize_aggregate(spark, d) -> DataFrame:
    root = _managed(spark, d, "aggregate")
    rows = spark.read.parquet(M.dataset_paths(root, "a", "aggregate")["matrix"])
    return rows.select("global_row_index", F.size("genes").cast("long").alias("n_genes"), F.expr("cast(aggregate(counts, 0D, (s, x) -> s + x) as double)").alias("total"))


def materialize_provenance(spark, d) -> DataFrame:
    root = _managed(spark, d, "federated")
    paths = [f"{M.dataset_paths(root, x)['meta']}/feature-provenance.parquet" for x in "ab"]
    return spark.read.parquet(paths[0]).unionByName(spark.read.parquet(paths[1]))


def corpus_index(spark, d) -> DataFrame:
    root = _managed(spark, d, "federated")
    index = M.compose(f"{root}-composed", [(root, "b"), (root, "a")])
    rows = [(root_, e["dataset_id"], e["dataset_index"], e["global_start"], e["global_end"]) for root_, x in (("own", M.read_index(root)), ("composed", index)) for e in x["datasets"]]
    return spark.createDataFrame(rows, "corpus string, dataset_id string, dataset_index int, global_start long, global_end long")


def corpus_checks(spark, d) -> DataFrame:
    """Whether a corpus is valid, what a strict check misses, and folders that no dataset owns, before and after they go."""
    root = _managed(spark, d, "federated")
    os.makedirs(f"{root}/stray/meta")
    rows = [("valid", len(M.validate(root))), ("strict", len(M.validate(root, strict=True))), ("garbage", len(M.collect_garbage(root)))]
    M.collect_garbage(root, dry_run=False)
    refused = 0
    for x, state in (("a", "pass"), ("c", "fail")):  # registered already; not ready
        try:
            M.materialize_dataset(root, x, *_source(spark, d, "a"), {"readiness": state})
        except M.ManageError:
            refused += 1
    return spark.createDataFrame([*rows, ("left", len(M.collect_garbage(root))), ("refused", refused)], "what string, n long")


def inspect_dataset(spark, d) -> DataFrame:
    coo, obs, var = _source(spark, d, "a")
    log = coo.groupBy("row", "gene").agg(F.log1p(F.sum("value")).alias("value"))
    n, p = obs.count(), var.count()
    out = I.inspect(obs, {".X": (log, n, p), "counts": (coo.groupBy("row", "gene").agg(F.sum("value").alias("value")), n, p)}, "a", scratch(spark))
    return spark.createDataFrame([(out["count_source"], out["readiness"], out["needs_recovery"], len(out["candidates"]), ",".join(f["field"] for f in out["obs_fields"]))], "count_source string, readiness string, needs_recovery boolean, n_candidates long, fields string")


_AVAILABLE = ("dataset_id", "cell_id", "perturb_label")


def missing_required_columns(spark, d) -> DataFrame:
    return spark.createDataFrame([(c,) for c in H.missing_required(_AVAILABLE)], "missing string")


def draft_schema(spark, d) -> DataFrame:
    """A draft for cells with foreign names: what is matched by name, alias and sample."""
    o = table(spark, d, "orders")
    obs = o.select(F.col("o_orderkey").cast("string").alias("cell_id"), F.concat(F.lit("gene"), F.col("o_custkey")).alias("target_gene"), F.concat(F.col("o_custkey"), F.lit(" nM")).alias("dose"), F.col("o_orderpriority").alias("batch"))
    var = table(spark, d, "part").select(F.concat(F.lit("ENSG0000"), F.col("p_partkey"), F.lit(".2")).alias("feature_id"))
    s = D.draft("orders", obs.columns, var.columns, D.samples_of(obs), D.samples_of(var))
    chosen = {m.canonical_name: m for m in [*s.obs, *s.var]}
    rows = [(k, chosen[k].strategy, chosen[k].source_column, ",".join(t["name"] for t in chosen[k].transforms)) for k in ("cell_id", "perturb_label", "dose", "batch_id", "donor_id", "gene_id")]
    return spark.createDataFrame([*rows, ("gene mapping", s.gene_mapping["engine"], None, "")], "name string, strategy string, source string, transforms string")


def gene_map_file(spark, d) -> DataFrame:
    path = f"{scratch(spark)}/map"
    parts = table(spark, d, "part")
    lines = parts.select(F.concat_ws("\t", F.concat(F.lit("P"), F.col("p_partkey")), F.col("p_brand")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# brands",), ("",)], "value string")).coalesce(1).write.text(path)
    return T.read_gene_map(spark, path)


def input_list_file(spark, d) -> DataFrame:
    base = scratch(spark)
    names = [r[0] for r in table(spark, d, "nation").select("n_name").orderBy("n_name").collect()]
    Path(base, "list.csv").write_text("source , dataset_id,inspection_summary\n" + "".join(f" {n}.parquet, {n} ,s\n" for n in names))
    for n in names:
        Path(base, f"{n}.parquet").touch()
    listed, scanned = T.read_input_list(f"{base}/list.csv"), T.scan_inputs(base)
    return spark.createDataFrame([(r["dataset_id"], r["source"], os.path.basename(s["source"])) for r, s in zip(sorted(listed, key=lambda r: r["dataset_id"]), scanned, strict=True)], "dataset_id string, source string, scanned string")


def yaml_schema_roundtrip(spark, d) -> DataFrame:
    path = Path(scratch(spark), "schema.yaml")
    H.Schema.from_dict(Q.SCHEMA).write(path)
    return spark.createDataFrame([(m.canonical_name, m.strategy) for m in H.Schema.read(path).obs], "name string, strategy string")


def staged_copy(spark, d) -> DataFrame:
    a = _corpora(spark, d)[0]
    path = staging.stage(f"{a.members[0].path}/expression.parquet", scratch(spark))
    return spark.read.parquet(path).select("global_row_index", F.size("genes").cast("long").alias("n_genes"))


def _cli_source(spark, d) -> str:
    base = scratch(spark)
    for name, df in zip(("matrix", "obs", "var"), _source(spark, d, "a"), strict=True):
        df.write.parquet(f"{base}/src/{name}.parquet")
    return base


def cli_convert(spark, d) -> DataFrame:
    base = _cli_source(spark, d)
    cli.main(["convert", "--source", f"{base}/src", "--output", f"{base}/out"])
    return K.open_corpus(spark, f"{base}/out").coo().select("row", "gene", F.col("value").cast("double").alias("value"))


def cli_materialize(spark, d) -> DataFrame:
    """Inspected, materialised, drafted, harmonised and checked by commands; the stored canonical cells."""
    base = _cli_source(spark, d)
    src, root = f"{base}/src", f"{base}/corpus"
    done = [
        cli.main(["inspect", "--source", src, "--dataset-id", "a", "--output", f"{base}/i"]),
        cli.main(["materialize", "--corpus", root, "--source", src, "--dataset-id", "a", "--inspection-summary", f"{base}/i/a/dataset-summary.yaml"]),
        cli.main(["draft-schema", "--dataset-id", "a", "--obs", f"{src}/obs.parquet", "--var", f"{src}/var.parquet", "--output", f"{base}/s.yaml"]),
        cli.main(["canonicalize", "--corpus", root, "--dataset-id", "a", "--schema", f"{base}/s.yaml"]),
        cli.main(["corpus-validate", "--corpus", root, "--strict"]),
    ]
    return spark.read.parquet(f"{M.dataset_paths(root, 'a')['canonical']}/canonical-obs.parquet").select("cell_id", F.lit(sum(done)).cast("long").alias("errors"))


def origin_order(spark, d) -> DataFrame:
    """Features by their number, which must run from 0 without gaps."""
    var = _corpora(spark, d)[1].members[0].var
    V.check_origin_index(var)
    return var


_IN = ", ".join(f"'{c}'" for c in _AVAILABLE)
_REQUIRED = ", ".join(f"'{c}'" for c in H.OBS_REQUIRED)
_STEPS = ", ".join(f"('{m['canonical_name']}', '{m['strategy'] or 'null'}')" for m in Q.SCHEMA["obs_column_mappings"])
_TOTALS = "coalesce(g, 0) AS n_genes, CAST(coalesce(v, 0) AS DOUBLE) AS total"

QUERIES = {
    "convert_counts": (convert_counts, f"{_COO} SELECT CAST(k >= h AS INTEGER) AS dataset_index, k AS row, CAST(CASE WHEN k >= h THEN p - 1 - g ELSE g END AS INTEGER) AS gene, {_XYV} FROM x, h, p"),
    "open_obs_totals": (open_obs_totals, f"{_CELLS} SELECT k AS global_row_index, i AS dataset_index, CASE i WHEN 0 THEN 'a' ELSE 'b' END AS dataset_id, r AS local_row_index, CAST(k AS VARCHAR) AS cell_id, status, CAST(coalesce(v, 0) AS DOUBLE) AS total_counts FROM c LEFT JOIN t USING (k)"),
    "view_metadata_reversed": (view_metadata_reversed, f"{_CELLS} SELECT status, CAST(k AS VARCHAR) AS cell_id, n - 1 - k AS pos FROM c"),
    "view_rows_reversed": (view_rows_reversed, f"{_CELLS} SELECT n - 1 - k AS pos, k AS global_row_index, {_TOTALS} FROM c LEFT JOIN t USING (k)"),
    "export_view": (export_view, f"{_COO} SELECT k AS row, k // 1000 AS chunk, CAST(g AS INTEGER) AS gene, {_XYV} FROM x"),
    "export_view_obs": (export_view_obs, f"{_CELLS} SELECT k AS global_row_index, i AS dataset_index, CASE i WHEN 0 THEN 'a' ELSE 'b' END AS dataset_id, r AS local_row_index, CAST(k AS VARCHAR) AS cell_id, status FROM c"),
    "export_view_presence": (export_view_presence, "SELECT 'P' || p_partkey AS feature_id, CAST(i AS INTEGER) AS dataset_index, true AS measured FROM part, range(2) AS r(i)"),
    "export_one_dataset_rows": (export_one_dataset_rows, f"{_COO} SELECT n - 1 - k AS row, (n - 1 - k) // 8192 AS chunk, CAST(p - 1 - g AS INTEGER) AS gene, {_XYV} FROM x, h, p WHERE k >= h"),
    "view_mixed_types": (view_mixed_types, f"{_COO} SELECT CAST(k >= h AS INTEGER) AS dataset_index, k AS row, CAST(CASE WHEN k >= h THEN p - 1 - g ELSE g END AS INTEGER) AS gene, CASE WHEN k >= h THEN v / 4 ELSE CAST(v AS DOUBLE) END AS value FROM x, h, p"),
    "save_obs_price": (save_obs_price, f"{_CELLS} SELECT k AS global_row_index, CAST(k AS VARCHAR) AS cell_id, status, price FROM c WHERE i = 0"),
    "convert_many_files": (convert_many_files, f"WITH {_H} SELECT l_orderkey + n * {_FILES_SQL} AS row, CAST(l_partkey AS INTEGER) AS gene, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem, h GROUP BY 1, 2"),
    "read_extra_all": (read_extra_all, f"WITH {_H} SELECT 3 * n - 1 - (l_orderkey + n * {_FILES_SQL}) AS pos, 'S' || l_suppkey AS feature_id, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem, h GROUP BY 1, 2"),
    "write_reordered_all": (write_reordered_all, f"{_CELLS} SELECT n - 1 - k AS global_row_index, k AS source_row, coalesce(g, 0) AS n_genes FROM c LEFT JOIN t USING (k)"),
    "materialize_aggregate": (materialize_aggregate, f"{_CELLS} SELECT k AS global_row_index, {_TOTALS} FROM c LEFT JOIN t USING (k)"),
    "materialize_provenance": (materialize_provenance, f"WITH {_H} SELECT CAST(CASE x WHEN 'b' THEN p - 1 - p_partkey ELSE p_partkey END AS INTEGER) AS origin_index, 'P' || p_partkey AS feature_id, '.X' AS count_source, x || '.parquet' AS source_path FROM part, p, (VALUES ('a'), ('b')) AS s(x)"),
    "corpus_index": (corpus_index, f"WITH {_H} SELECT corpus, dataset_id, CAST(i AS INTEGER) AS dataset_index, s AS global_start, e AS global_end FROM h, LATERAL (VALUES ('own', 'a', 0, 0, h), ('own', 'b', 1, h, n), ('composed', 'b', 0, 0, n - h), ('composed', 'a', 1, n - h, n)) AS v(corpus, dataset_id, i, s, e)"),
    "corpus_checks": (corpus_checks, "SELECT * FROM (VALUES ('valid', 0::BIGINT), ('strict', 2), ('garbage', 1), ('left', 0), ('refused', 2)) AS v(what, n)"),
    "inspect_dataset": (inspect_dataset, "SELECT 'counts' AS count_source, 'pass' AS readiness, false AS needs_recovery, 2::BIGINT AS n_candidates, 'cell_id,status' AS fields"),
    "missing_required_columns": (missing_required_columns, f"SELECT unnest([{_REQUIRED}]) AS missing EXCEPT SELECT unnest([{_IN}])"),
    "draft_schema": (draft_schema, "SELECT * FROM (VALUES ('cell_id', 'source-field', 'cell_id', 'strip_whitespace'), ('perturb_label', 'source-field', 'target_gene', 'strip_whitespace'), ('dose', 'source-field', 'dose', 'strip_whitespace,dose_parse'), ('batch_id', 'source-field', 'batch', 'strip_whitespace'), ('donor_id', 'null', NULL, ''), ('gene_id', 'source-field', 'feature_id', 'strip_ensembl_version'), ('gene mapping', 'gget', NULL, '')) AS v(name, strategy, source, transforms)"),
    "gene_map_file": (gene_map_file, "SELECT 'P' || p_partkey AS gene, p_brand AS mapped FROM part"),
    "input_list_file": (input_list_file, "SELECT n_name AS dataset_id, n_name || '.parquet' AS source, n_name || '.parquet' AS scanned FROM nation"),
    "yaml_schema_roundtrip": (yaml_schema_roundtrip, f"SELECT * FROM (VALUES {_STEPS}) AS v(name, strategy)"),
    "staged_copy": (staged_copy, f"{_CELLS} SELECT k AS global_row_index, coalesce(g, 0) AS n_genes FROM c LEFT JOIN t USING (k) WHERE i = 0"),
    "cli_convert": (cli_convert, f"{_COO} SELECT k AS row, CAST(g AS INTEGER) AS gene, {_XYV} FROM x, h WHERE k < h"),
    "cli_materialize": (cli_materialize, f"{_CELLS} SELECT CAST(k AS VARCHAR) AS cell_id, 0::BIGINT AS errors FROM c WHERE i = 0"),
    "origin_order": (origin_order, f"WITH {_H} SELECT CAST(p - 1 - p_partkey AS INTEGER) AS origin_index, 'P' || p_partkey AS feature_id FROM part, p"),
}
