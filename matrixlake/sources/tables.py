"""Readers and writers: coordinates, row arrays, sidecars with JSON, gene maps, input lists, YAML documents."""

from __future__ import annotations

import csv
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_coo(spark: SparkSession, path: str, row: str = "row", gene: str = "gene", value: str = "value") -> DataFrame:
    """Coordinates from Parquet, under their standard names."""
    return spark.read.parquet(path).select(F.col(row).cast("long").alias("row"), F.col(gene).cast("int").alias("gene"), F.col(value).alias("value"))


def read_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*dict.fromkeys(columns)) if columns else df


def explode_sidecar(df: DataFrame, json_column: str, keys: list[str] | None = None) -> DataFrame:
    """The JSON object's entries as text columns; absent keys are null, and an entry replaces a column of its name.

    Without ``keys`` they are gathered from the data first.
    """
    parsed = df.withColumn("_m", F.from_json(json_column, "map<string,string>"))
    if keys is None:
        keys = sorted(r[0] for r in parsed.select(F.explode(F.map_keys("_m"))).distinct().collect())
    return parsed.drop(json_column).withColumns({k: F.try_element_at("_m", F.lit(k)) for k in keys}).drop("_m")


def sidecar(df: DataFrame, fixed: list[str], json_column: str) -> DataFrame:
    """Fixed columns, and all others as one JSON object; NaN is null."""
    kinds = dict(df.dtypes)
    rest = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns if c not in fixed]
    return df.select(*fixed, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(json_column) if rest else F.lit("{}").alias(json_column))


def provenance(var: DataFrame, count_source: str, source_path: str) -> DataFrame:
    return var.select("origin_index", "feature_id", F.lit(count_source).alias("count_source"), F.lit(source_path).alias("source_path"))


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """(gene, mapped) from tab-separated lines; blank and # lines are skipped, the last line of a gene counts."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())  # order within the files' splits is line order
    parts = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select("n", F.split("value", "\t", -1).alias("p"))
    if not parts.where(F.size("p") < 2).isEmpty():
        raise ValueError(f"{path}: a line has fewer than two columns")
    w = Window.partitionBy("gene").orderBy(F.desc("n"))
    rows = parts.select(F.trim(F.col("p")[0]).alias("gene"), F.trim(F.col("p")[1]).alias("mapped"), "n")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("gene", "mapped")


def read_input_list(path: str) -> list[dict[str, str]]:
    """Rows of a CSV with source, dataset_id and inspection_summary, trimmed, none empty."""
    want = ("source", "dataset_id", "inspection_summary")
    with open(path, newline="") as f:
        reader = csv.DictReader(f)
        names = [c.strip() for c in reader.fieldnames or []]
        if missing := [c for c in want if c not in names]:
            raise ValueError(f"{path}: columns are missing: {missing}")
        reader.fieldnames = names
        rows = [{c: (r[c] or "").strip() for c in want} for r in reader]
    if not rows:
        raise ValueError(f"{path}: no rows")
    for i, r in enumerate(rows, 2):
        if empty := [c for c in want if not r[c]]:
            raise ValueError(f"{path}, line {i}: empty {empty}")
    return rows


def scan_inputs(folder: str, suffix: str = ".parquet", summaries: str | None = None) -> list[dict[str, str]]:
    """Inputs of a folder by name; each needs its summary where a folder of summaries is given."""
    found = sorted(Path(folder).glob(f"*{suffix}"))
    if not found:
        raise FileNotFoundError(f"{folder}: no *{suffix}")
    out = []
    for p in found:
        summary = Path(summaries, p.stem, "dataset-summary.yaml") if summaries else None
        if summary and not summary.exists():
            raise FileNotFoundError(str(summary))
        out.append({"source": str(p), "dataset_id": p.stem, "inspection_summary": str(summary or "")})
    return out


def read_yaml(path: str | Path, required: tuple[str, ...] = (), kind: str | None = None) -> dict:
    data = yaml.safe_load(Path(path).read_text())
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not a mapping")
    if missing := [k for k in required if k not in data]:
        raise ValueError(f"{path}: missing {missing}")
    if kind and data.get("kind") != kind:
        raise ValueError(f"{path}: kind is {data.get('kind')!r}, not {kind!r}")
    return data


def write_yaml(data: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True))


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
