"""Harmonisation: a declarative schema of column mappings is compiled to one projection.

Nothing is evaluated by row in Python: every strategy and transform becomes a
Column, so a harmonised table is a single scan of its raw table.
"""

from __future__ import annotations

import string
import warnings
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixlake.functions import text as X
from matrixlake.schema import CONTRACT_VERSION, OBS_INTEGERS, OBS_NULLABLE, OBS_REQUIRED, VAR_REQUIRED
from matrixlake.sources.tables import read_gene_map, read_yaml, write_yaml

KIND = "canonicalization-schema"
OBS_STRATEGIES = ("source-field", "literal", "passthrough", "row-index", "null", "coalesce", "join", "template", "conditional")
VAR_STRATEGIES = ("source-field", "literal", "passthrough", "gene-mapping", "auto", "null")
ENGINES = {}


class SchemaError(ValueError):
    """The schema cannot be used on this table."""


@dataclass
class Mapping:
    """How one harmonised column is made."""

    canonical_name: str
    strategy: str
    source_column: str | None = None
    source_columns: tuple[str, ...] = ()
    literal_value: str | None = None
    separator: str = "+"
    skip_nulls: bool = True
    template: str | None = None
    missing_value_behavior: str = "fallback"
    missing_value: str | None = None
    cases: tuple[dict, ...] = ()
    default_literal: str | None = None
    default_source_column: str | None = None
    transforms: tuple[dict, ...] = ()
    fallback: str = X.NA

    def check(self, allowed: tuple[str, ...]) -> Mapping:
        if self.strategy not in allowed:
            raise SchemaError(f"{self.canonical_name}: unknown strategy {self.strategy!r}")
        if self.strategy in ("coalesce", "join") and not self.source_columns:
            raise SchemaError(f"{self.canonical_name}: {self.strategy} needs source_columns")
        if self.strategy == "template" and (not self.template or self.missing_value_behavior not in ("fallback", "empty", "literal")):
            raise SchemaError(f"{self.canonical_name}: template needs a text and a known missing_value_behavior")
        if self.strategy == "conditional":
            if self.default_literal is not None and self.default_source_column is not None:
                raise SchemaError(f"{self.canonical_name}: two defaults")
            if not self.cases and self.default_literal is None and self.default_source_column is None:
                raise SchemaError(f"{self.canonical_name}: neither cases nor a default")
        return self

    def columns(self) -> list[str]:
        """Source columns that must be there."""
        if self.strategy in ("coalesce", "join"):
            return list(self.source_columns)
        if self.strategy == "template":
            return [f for _, f, _, _ in string.Formatter().parse(self.template) if f]
        if self.strategy == "conditional":
            named = [c.get(k) for c in self.cases for k in ("source_column", "result_source_column")]
            return [c for c in [*named, self.default_source_column] if c]
        return []


@dataclass
class Schema:
    dataset_id: str
    obs: list[Mapping] = field(default_factory=list)
    var: list[Mapping] = field(default_factory=list)
    obs_extensible: list[tuple[str, str]] = field(default_factory=list)
    var_extensible: list[tuple[str, str]] = field(default_factory=list)
    gene_mapping: dict[str, Any] = field(default_factory=dict)
    status: str = "ready"
    description: str = ""
    notes: list[str] = field(default_factory=list)

    @classmethod
    def from_dict(cls, data: dict) -> Schema:
        if data.get("kind") != KIND:
            raise SchemaError(f"kind must be {KIND!r}")
        if not data.get("dataset_id"):
            raise SchemaError("dataset_id is missing")
        if data.get("status", "ready") not in ("ready", "draft"):
            raise SchemaError(f"unknown status {data['status']!r}")

        def mappings(key: str, allowed: tuple[str, ...]) -> list[Mapping]:
            out = []
            for m in data.get(key) or []:
                m = {k: v for k, v in m.items() if k in Mapping.__dataclass_fields__}
                m["strategy"] = "null" if m.get("strategy") is None else m["strategy"]
                for k in ("source_columns", "cases", "transforms"):
                    m[k] = tuple(m.get(k) or ())
                out.append(Mapping(**m).check(allowed))
            return out

        names = lambda key: [(e, e) if isinstance(e, str) else (e["raw_source_column"], e.get("canonical_name") or e["raw_source_column"]) for e in data.get(key) or []]
        out = cls(data["dataset_id"], mappings("obs_column_mappings", OBS_STRATEGIES), mappings("var_column_mappings", VAR_STRATEGIES), names("obs_extensible"), names("var_extensible"), data.get("gene_mapping") or {}, data.get("status", "ready"), data.get("description", ""), list(data.get("notes") or []))
        for part, ext in ((out.obs, out.obs_extensible), (out.var, out.var_extensible)):
            seen = [m.canonical_name for m in part] + [n for _, n in ext]
            if twice := sorted({n for n in seen if seen.count(n) > 1}):
                raise SchemaError(f"named twice: {twice}")
        return out

    @classmethod
    def read(cls, path: str | Path) -> Schema:
        return cls.from_dict(read_yaml(path))

    def to_dict(self) -> dict:
        def plain(m: Mapping) -> dict:
            base = Mapping(m.canonical_name, m.strategy)
            out = {k: (list(v) if isinstance(v, tuple) else v) for k, v in vars(m).items() if k in ("canonical_name", "strategy") or v != getattr(base, k)}
            return out

        return {
            "kind": KIND, "contract_version": CONTRACT_VERSION, "dataset_id": self.dataset_id, "status": self.status, "description": self.description, "gene_mapping": self.gene_mapping,
            "obs_column_mappings": [plain(m) for m in self.obs], "obs_extensible": [{"raw_source_column": r, "canonical_name": n} for r, n in self.obs_extensible], "var_column_mappings": [plain(m) for m in self.var], "var_extensible": [{"raw_source_column": r, "canonical_name": n} for r, n in self.var_extensible], "notes": self.notes,
        }

    def write(self, path: str | Path) -> None:
        write_yaml(self.to_dict(), path)


def missing_required(available, required: tuple[str, ...] = OBS_REQUIRED) -> list[str]:
    return [c for c in required if c not in set(available)]


def _plain(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def compile_mapping(m: Mapping, columns: list[str], row: str = "local_row_index") -> Column:
    """The mapping as a text Column over a table with these columns; ``row`` numbers its rows."""
    if absent := [c for c in m.columns() if c not in columns]:
        raise SchemaError(f"{m.canonical_name}: no column {absent}")
    chained = lambda c: X.chain(c, m.transforms, m.fallback)
    if m.strategy == "literal":
        return F.lit(m.literal_value if m.literal_value is not None else m.fallback)
    if m.strategy == "null":
        return F.lit(m.fallback)
    if m.strategy == "row-index":
        return F.col(row).cast("string")
    if m.strategy == "passthrough":
        name = next((c for c in (m.canonical_name, m.source_column) if c in columns), None)
        if name is None:
            warnings.warn(f"{m.canonical_name}: no column to pass through", stacklevel=2)
            return F.lit(m.fallback)
        return F.coalesce(_plain(name), F.lit(m.fallback))
    if m.strategy == "source-field":
        if m.source_column not in columns:
            warnings.warn(f"{m.canonical_name}: no column {m.source_column!r}", stacklevel=2)
            return F.lit(m.fallback)
        return chained(F.coalesce(_plain(m.source_column), F.lit(X.NA)))
    if m.strategy == "coalesce":
        return chained(X.coalesce_values(*map(_plain, m.source_columns)))
    if m.strategy == "join":
        parts = [F.when(X.is_missing(_plain(c)), None if m.skip_nulls else F.lit(m.fallback)).otherwise(_plain(c)) for c in m.source_columns]
        return chained(F.concat_ws(m.separator, *parts))
    if m.strategy == "template":
        parts, gaps = [], []
        put = {"empty": "", "literal": m.missing_value if m.missing_value is not None else ""}.get(m.missing_value_behavior, "")
        for literal, name, spec, conversion in string.Formatter().parse(m.template):
            if spec or conversion:
                raise SchemaError(f"{m.canonical_name}: a template has plain fields only")
            if literal:
                parts.append(F.lit(literal))
            if name:
                gaps.append(X.is_missing(_plain(name)))
                parts.append(F.when(gaps[-1], F.lit(put)).otherwise(_plain(name)))
        filled = F.concat(*parts) if parts else F.lit("")
        if m.missing_value_behavior == "fallback" and gaps:
            any_gap = gaps[0]
            for g in gaps[1:]:
                any_gap = any_gap | g
            return F.when(any_gap, F.lit(m.fallback)).otherwise(chained(filled))
        return chained(filled)
    # conditional
    result = None
    value = lambda literal, name: F.lit(literal) if literal is not None else F.coalesce(_plain(name), F.lit(X.NA)) if name else F.lit(m.fallback)
    for c in m.cases:
        test = X.matches(_plain(c["source_column"]), c.get("predicate", "equals"), c.get("values") if c.get("predicate") == "in" else c.get("value"), c.get("case_sensitive", False), c.get("strip_whitespace", True))
        then = value(c.get("result_literal"), c.get("result_source_column"))
        result = F.when(test, then) if result is None else result.when(test, then)
    default = value(m.default_literal, m.default_source_column)
    return chained(default if result is None else result.otherwise(default))


def typed(name: str, c: Column) -> Column:
    if name in OBS_INTEGERS:
        return F.when(~X.is_missing(c), X.strip_whitespace(c)).try_cast(OBS_INTEGERS[name])
    return F.when(~X.is_missing(c), c) if name in OBS_NULLABLE else c


def _extensible(columns: list[str], names: list[tuple[str, str]]) -> dict[str, Column]:
    out = {}
    for raw, n in names:
        if raw not in columns:
            warnings.warn(f"no column {raw!r}", stacklevel=3)
        out[n] = F.coalesce(_plain(raw), F.lit(X.NA)) if raw in columns else F.lit(X.NA)
    return out


def canonical_obs(raw: DataFrame, schema: Schema, row: str = "local_row_index", require: bool = True) -> DataFrame:
    """The harmonised cell table. ``raw`` must hold the row number ``row``."""
    made = {m.canonical_name: typed(m.canonical_name, compile_mapping(m, raw.columns, row)) for m in schema.obs}
    made |= _extensible(raw.columns, schema.obs_extensible)
    if require and (gone := missing_required(made)):
        raise SchemaError(f"required columns are not made: {gone}")
    return raw.select(*(c.alias(n) for n, c in made.items()))


def gene_table(spark, mapping: dict) -> DataFrame | None:
    """The gene map that a schema names; None for identity."""
    if not mapping.get("enabled"):
        return None
    engine = mapping.get("engine", "identity")
    if engine in ENGINES:
        return ENGINES[engine](spark, mapping)
    if engine == "mapping_file" and mapping.get("mapping_file"):
        return read_gene_map(spark, mapping["mapping_file"])
    if engine not in ("identity", "gget"):
        raise SchemaError(f"unknown gene mapping engine {engine!r}")
    if engine == "gget":
        warnings.warn("the online gene mapping needs a registered engine; identity is used", stacklevel=2)
    return None


def canonical_var(raw: DataFrame, schema: Schema, table: DataFrame | None = None, apply_gene_transforms: bool = False) -> DataFrame:
    """The harmonised feature table, all text: ``gene_id`` raw, ``canonical_gene_id`` mapped, ``global_id`` its rank among the sorted distinct ids."""
    table = gene_table(raw.sparkSession, schema.gene_mapping) if table is None else table
    made: dict[str, Column] = {}
    later = {}
    for m in schema.var:
        n = m.canonical_name
        if n in ("canonical_gene_id", "global_id"):
            later[n] = m
        elif n == "gene_id":
            name = next((c for c in (m.source_column, "gene_id", "feature_id") if c in raw.columns), None)
            if name is None:
                raise SchemaError("no column holds gene ids")
            made[n] = X.chain(_plain(name), m.transforms, m.fallback) if apply_gene_transforms else _plain(name)
        elif n == "origin_index":
            made[n] = _plain(m.source_column if m.source_column in raw.columns else "origin_index")
        elif m.strategy == "literal":
            made[n] = F.lit(m.literal_value or m.fallback)
        elif m.strategy in ("source-field", "passthrough", "null"):
            made[n] = compile_mapping(m, raw.columns)
        else:
            warnings.warn(f"{n}: strategy {m.strategy!r} gives the fallback", stacklevel=2)
            made[n] = F.lit(m.fallback)
    made.setdefault("origin_index", _plain("origin_index"))
    if "gene_id" not in made:
        raise SchemaError("gene_id is not mapped")
    made |= _extensible(raw.columns, schema.var_extensible)
    out = raw.select(*(c.alias(n) for n, c in made.items()))
    if table is not None:
        t = table.select(F.col(table.columns[0]).alias("gene_id"), F.col(table.columns[1]).alias("_to"))
        out = out.join(t, "gene_id", "left").withColumn("canonical_gene_id", F.coalesce("_to", "gene_id")).drop("_to")
    else:
        out = out.withColumn("canonical_gene_id", F.col("gene_id"))
    ids = out.select("canonical_gene_id").distinct()
    ids = ids.withColumn("global_id", (F.row_number().over(Window.orderBy("canonical_gene_id")) - 1).cast("string"))
    out = out.join(ids, "canonical_gene_id")
    return out.select(*VAR_REQUIRED, *(c for c in out.columns if c not in VAR_REQUIRED))


VOCAB_SKIP = ("global_row_index", "local_row_index", "dataset_index", "cell_id", "dataset_id")


def vocabulary(obs: DataFrame, skip: tuple[str, ...] = VOCAB_SKIP) -> DataFrame:
    """(column, values): the sorted distinct values of each text column, without the missing ones."""
    names = [c for c, k in obs.dtypes if k == "string" and c not in skip]
    pairs = obs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names))).alias("x")).select("x.*")
    distinct = pairs.where("value is not null").where(F.col("value") != X.NA).distinct()
    return distinct.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values"))


def merge_vocabularies(*vocabs: DataFrame) -> DataFrame:
    out = vocabs[0]
    for v in vocabs[1:]:
        out = out.unionByName(v)
    return out.select("column", F.explode("values").alias("value")).distinct().groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values"))


def write_vocabulary(vocab: DataFrame, path: str | Path, genes: dict[str, str] | None = None) -> None:
    rows = {r["column"]: list(r["values"]) for r in vocab.orderBy("column").collect()}
    write_yaml({"kind": "canonical-vocab", "contract_version": CONTRACT_VERSION, "obs": rows, "genes": genes or {}}, path)


def canonicalize(spark, raw_obs: str, raw_var: str, schema: Schema | str, output: str) -> dict[str, str]:
    """Raw sidecars in, harmonised tables and their vocabulary out."""
    from matrixlake.sources.tables import explode_sidecar, write_once

    schema = schema if isinstance(schema, Schema) else Schema.read(schema)
    obs = explode_sidecar(spark.read.parquet(raw_obs), "raw_fields")
    var = explode_sidecar(spark.read.parquet(raw_var), "raw_var")
    if "local_row_index" not in obs.columns:
        raise SchemaError("the raw cell table has no local_row_index")
    paths = {"obs": f"{output}/canonical-obs.parquet", "var": f"{output}/canonical-var.parquet", "vocab": f"{output}/vocab.yaml"}
    made = canonical_obs(obs, schema)
    write_once(made, paths["obs"])
    write_once(canonical_var(var, schema), paths["var"])
    write_vocabulary(vocabulary(spark.read.parquet(paths["obs"])), paths["vocab"])
    return paths
