"""Harmonised tables, vocabularies, sidecars, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.plans import canonical as H
from matrixlake.plans import inspection as I
from matrixlake.queries.data import table
from matrixlake.sources.tables import explode_sidecar, sidecar


def _raw(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("local_row_index"),
        F.concat(F.lit("cell"), "o_orderkey").alias("cell_id"),
        F.lit("ds").alias("dataset_id"),
        F.expr("CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' NTC ' WHEN 2 THEN '' ELSE concat('G', o_custkey) END").alias("target"),
        F.expr("concat('TP', o_custkey % 50, '_sg', o_orderkey % 3)").alias("guide"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat(o_custkey, 'nM') END").alias("dose_raw"),
    )


_RAW = """raw AS (SELECT o_orderkey AS local_row_index, 'cell' || o_orderkey AS cell_id, 'ds' AS dataset_id,
CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' NTC ' WHEN 2 THEN '' ELSE 'G' || o_custkey END AS target, 'TP' || o_custkey % 50 || '_sg' || o_orderkey % 3 AS guide,
o_orderstatus AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || 'nM' END AS dose_raw FROM orders)"""


def _one(**mapping):
    m = H.Mapping("out", **mapping)

    def run(spark, d) -> DataFrame:
        raw = _raw(spark, d)
        return raw.select("local_row_index", H.compile_mapping(m, raw.columns).alias("out"))

    return run


def _q(sql: str, **mapping):
    return _one(**mapping), f"WITH {_RAW} SELECT local_row_index, {sql} AS out FROM raw"


_STRIP_STEPS = ({"name": "strip_whitespace"}, {"name": "strip_guide_suffix"}, {"name": "map_control_labels", "args": {"candidates": ["ntc"]}})
_TARGET = "CASE WHEN target IS NULL OR target = '' THEN regexp_replace(guide, '_sg\\d+$', '') WHEN trim(target) = 'NTC' THEN 'ctrl' ELSE target END"

SCHEMA = {
    "kind": H.KIND, "dataset_id": "ds", "status": "ready",
    "obs_column_mappings": [
        {"canonical_name": "perturb_label", "strategy": "coalesce", "source_columns": ["target", "guide"], "transforms": list(_STRIP_STEPS)},
        {"canonical_name": "dose", "strategy": "source-field", "source_column": "dose_raw", "transforms": [{"name": "dose_parse"}]},
        {"canonical_name": "dose_unit", "strategy": "source-field", "source_column": "dose_raw", "transforms": [{"name": "dose_unit"}]},
        {"canonical_name": "cell_context", "strategy": "join", "source_columns": ["status", "priority"], "separator": ":"},
        {"canonical_name": "condition", "strategy": "template", "template": "{status}/{priority}", "fallback": "WT"},
        {"canonical_name": "batch_id", "strategy": "passthrough", "source_column": "priority"},
        {"canonical_name": "perturb_type", "strategy": "conditional", "cases": [{"source_column": "target", "predicate": "equals", "value": "ntc", "result_literal": "control"}], "default_literal": "genetic"},
        {"canonical_name": "cell_id", "strategy": "passthrough"},
        {"canonical_name": "dataset_id", "strategy": "passthrough"},
        {"canonical_name": "global_row_index", "strategy": "row-index"},
        {"canonical_name": "local_row_index", "strategy": "row-index"},
        {"canonical_name": "dataset_index", "strategy": "literal", "literal_value": "3"},
        *({"canonical_name": n, "strategy": "literal", "literal_value": v} for n, v in (("species", "human"), ("tissue", "blood"), ("assay", "x"), ("sex", "unknown"))),
        *({"canonical_name": n, "strategy": None} for n in ("cell_line_or_type", "disease_state", "donor_id", "timepoint", "timepoint_unit")),
    ],
    "obs_extensible": [{"raw_source_column": "status", "canonical_name": "order_status"}],
    "var_column_mappings": [
        {"canonical_name": "gene_id", "strategy": "source-field", "source_column": "feature_id"},
        {"canonical_name": "canonical_gene_id", "strategy": "gene-mapping"},
        {"canonical_name": "global_id", "strategy": "auto"},
        {"canonical_name": "brand", "strategy": "source-field", "source_column": "brand", "transforms": [{"name": "strip_prefix", "args": {"prefix": "Brand"}}]},
    ],
}


def canonical_obs(spark, d) -> DataFrame:
    return H.canonical_obs(_raw(spark, d), H.Schema.from_dict(SCHEMA))


def canonical_var(spark, d) -> DataFrame:
    var = table(spark, d, "part").select(F.col("p_partkey").alias("origin_index"), F.concat(F.lit("F"), "p_partkey").alias("feature_id"), F.col("p_brand").alias("brand"))
    mapped = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("F"), "p_partkey").alias("gene"), F.concat(F.lit("M"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("to"))
    return H.canonical_var(var, H.Schema.from_dict(SCHEMA), mapped)


def json_sidecar_explode(spark, d) -> DataFrame:
    return explode_sidecar(table(spark, d, "events").select("event_id", "props"), "props", ["k", "absent"])


def json_sidecar_roundtrip(spark, d) -> DataFrame:
    made = sidecar(_raw(spark, d).select("cell_id", "dataset_id", "target", "status"), ["cell_id", "dataset_id"], "raw_fields")
    return explode_sidecar(made, "raw_fields")


def _small(spark, d) -> DataFrame:
    return canonical_obs(spark, d).select("perturb_type", "batch_id", "dose_unit", "cell_id")


def _listed(v: DataFrame) -> DataFrame:
    return v.select("column", F.array_join("values", "|").alias("values"))


def vocab_per_dataset(spark, d) -> DataFrame:
    return _listed(H.vocabulary(_small(spark, d)))


def vocab_merge(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("batch_id"))
    return _listed(H.merge_vocabularies(H.vocabulary(_small(spark, d)), H.vocabulary(c)))


def field_profiles(spark, d) -> DataFrame:
    out = I.profile_fields(_raw(spark, d).select("local_row_index", "target", "status", "dose_raw"))
    return out.select("field", "dtype", "n_null", "n_distinct_head", F.array_join("examples", "|").alias("examples"))


def control_candidates(spark, d) -> DataFrame:
    raw = _raw(spark, d).select("local_row_index", F.col("target").alias("perturbation"), F.expr("CASE WHEN local_row_index % 2 = 0 THEN 'WT' ELSE status END").alias("condition"), F.expr("CASE WHEN local_row_index % 4 = 0 THEN 'yes' ELSE 'no' END").alias("is_control"))
    return I.control_candidates(raw).select("column", "confidence", F.array_join("labels", "|").alias("labels"))


_DISTINCT = "SELECT {c!r} AS \"column\", string_agg(v, '|' ORDER BY v) AS \"values\" FROM (SELECT DISTINCT {e} AS v FROM raw) WHERE v IS NOT NULL AND v <> 'NA'"
_VOCAB = " UNION ALL ".join(_DISTINCT.format(c=c, e=e) for c, e in (("perturb_type", "CASE WHEN trim(target) = 'NTC' THEN 'control' ELSE 'genetic' END"), ("batch_id", "priority"), ("dose_unit", "CASE WHEN dose_raw IS NOT NULL THEN 'nm' END")))


def _profile(f: str) -> str:
    return f"SELECT '{f}' AS field, 'string' AS dtype, count(*) FILTER (WHERE {f} IS NULL) AS n_null, (SELECT count(DISTINCT v) FROM (SELECT {f} AS v FROM raw WHERE {f} IS NOT NULL ORDER BY local_row_index LIMIT 64)) AS n_distinct_head, (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT v, min(k) AS k FROM (SELECT {f} AS v, row_number() OVER (ORDER BY local_row_index) AS k FROM raw WHERE {f} IS NOT NULL) WHERE k <= 256 GROUP BY v ORDER BY k LIMIT 5)) AS examples FROM raw"


QUERIES = {
    "canonical_obs": (
        canonical_obs,
        f"""WITH {_RAW} SELECT {_TARGET} AS perturb_label, CASE WHEN dose_raw IS NOT NULL THEN replace(dose_raw, 'nM', '') END AS dose, CASE WHEN dose_raw IS NOT NULL THEN 'nm' END AS dose_unit,
        status || ':' || priority AS cell_context, status || '/' || priority AS condition, priority AS batch_id, CASE WHEN trim(target) = 'NTC' THEN 'control' ELSE 'genetic' END AS perturb_type,
        cell_id, dataset_id, local_row_index AS global_row_index, local_row_index, 3 AS dataset_index, 'human' AS species, 'blood' AS tissue, 'x' AS assay, 'unknown' AS sex,
        'NA' AS cell_line_or_type, 'NA' AS disease_state, 'NA' AS donor_id, CAST(NULL AS VARCHAR) AS timepoint, CAST(NULL AS VARCHAR) AS timepoint_unit, status AS order_status FROM raw""",
    ),
    "canonical_var": (
        canonical_var,
        "WITH v AS (SELECT CAST(p_partkey AS VARCHAR) AS origin_index, 'F' || p_partkey AS gene_id, CASE WHEN p_partkey % 2 = 0 THEN 'M' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE 'F' || p_partkey END AS canonical_gene_id, CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END AS brand FROM part) SELECT origin_index, gene_id, canonical_gene_id, CAST(dense_rank() OVER (ORDER BY canonical_gene_id) - 1 AS VARCHAR) AS global_id, brand FROM v",
    ),
    "map_literal": _q("'x'", strategy="literal", literal_value="x"),
    "map_passthrough": _q("coalesce(target, 'NA')", strategy="passthrough", source_column="target"),
    "map_row_index": _q("CAST(local_row_index AS VARCHAR)", strategy="row-index"),
    "map_null": _q("'none'", strategy="null", fallback="none"),
    "map_source_field": _q("CASE WHEN dose_raw IS NULL THEN 'NA' ELSE replace(dose_raw, 'nM', '') END", strategy="source-field", source_column="dose_raw", transforms=({"name": "dose_parse"},)),
    "map_coalesce": _q(_TARGET, strategy="coalesce", source_columns=("target", "guide"), transforms=_STRIP_STEPS),
    "map_join": _q("lower(CASE WHEN dose_raw IS NULL THEN status || ':' || priority ELSE status || ':' || dose_raw || ':' || priority END)", strategy="join", source_columns=("status", "dose_raw", "priority"), separator=":", transforms=({"name": "normalize_case", "args": {"mode": "lower"}},)),
    "map_template": _q("status || ':' || coalesce(dose_raw, 'unknown')", strategy="template", template="{status}:{dose_raw}", missing_value_behavior="literal", missing_value="unknown"),
    "map_conditional": _q(
        "CASE WHEN status = 'F' THEN 'NTC' WHEN target IS NOT NULL AND target <> '' THEN trim(target) ELSE guide END",
        strategy="conditional",
        cases=({"source_column": "status", "predicate": "equals", "value": " f ", "result_literal": "NTC"}, {"source_column": "target", "predicate": "not_null", "result_source_column": "target"}),
        default_source_column="guide",
        transforms=({"name": "strip_whitespace"},),
    ),
    "json_sidecar_explode": (json_sidecar_explode, "SELECT event_id, props ->> '$.k' AS k, CAST(NULL AS VARCHAR) AS absent FROM events"),
    "json_sidecar_roundtrip": (json_sidecar_roundtrip, f"WITH {_RAW} SELECT cell_id, dataset_id, status, target FROM raw"),
    "vocab_per_dataset": (vocab_per_dataset, f"WITH {_RAW} {_VOCAB}"),
    "vocab_merge": (
        vocab_merge,
        f"WITH {_RAW}, v AS ({_VOCAB}) SELECT \"column\", \"values\" FROM v WHERE \"column\" <> 'batch_id' UNION ALL SELECT 'batch_id', string_agg(x, '|' ORDER BY x) FROM (SELECT priority AS x FROM raw UNION SELECT c_mktsegment FROM customer)",
    ),
    "field_profiles": (field_profiles, f"WITH {_RAW} " + " UNION ALL ".join(_profile(f) for f in ("target", "status", "dose_raw"))),
    "control_candidates": (
        control_candidates,
        "SELECT * FROM (VALUES ('perturbation', 'high', ' NTC '), ('condition', 'low', 'WT'), ('is_control', 'high', 'yes')) AS t(\"column\", confidence, labels)",
    ),
}
