"""Inspection: column profiles, control labels, candidates for the count matrix, readiness."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixlake.functions.text import label_key
from matrixlake.operators.counts import audit_matrix, audit_recovery
from matrixlake.sources.tables import write_yaml

# Columns that may hold control labels, and the labels
CONTROL_COLUMNS = ("perturbation", "perturb_label", "guide_id", "sgRNA", "target_gene", "condition", "treatment", "genotype", "control", "is_control")
STRONG = ("ctrl", "control", "ntc", "nontargeting", "nonperturbing", "nonperturbed", "scramble", "scrambled")
AMBIGUOUS = ("wt", "wildtype", "untreated", "vehicle", "mock", "baseline")
TRUE_LABELS = ("true", "1", "yes", "y", "t")
PROFILE_ROWS, DISTINCT_ROWS, EXAMPLES = 256, 64, 5


def profile_fields(df: DataFrame, row: str = "local_row_index") -> DataFrame:
    """(field, dtype, n_null, n_distinct_head, examples): distinct values among the first 64 non-null ones, at most 5 examples from the first 256."""
    names = [c for c in df.columns if c != row]
    kinds = dict(df.dtypes)
    nulls = df.agg(*(F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in names))
    nulls = nulls.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("dtype"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n_null")) for c in names))).alias("x")).select("x.*")
    long = df.select(row, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in names))).alias("x")).select(row, "x.*").where("value is not null")
    head = long.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy(row))).where(f"k <= {PROFILE_ROWS}")
    first = head.groupBy("field", "value").agg(F.min("k").alias("k"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy("k"))
    seen = first.withColumn("r", rank).groupBy("field").agg(
        F.sum((F.col("k") <= DISTINCT_ROWS).cast("long")).alias("n_distinct_head"), F.array_sort(F.collect_list(F.when(F.col("r") <= EXAMPLES, F.struct("r", "value")))).alias("e")
    )
    return nulls.join(seen, "field", "left").select("field", "dtype", "n_null", F.coalesce("n_distinct_head", F.lit(0)).alias("n_distinct_head"), F.coalesce(F.col("e.value"), F.expr("cast(array() as array<string>)")).alias("examples"))


def control_candidates(df: DataFrame, row: str = "local_row_index") -> DataFrame:
    """(column, confidence, labels): of the first 12 distinct values of the known columns, those that name controls."""
    names = [c for c in CONTROL_COLUMNS if c in df.columns]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, confidence string, labels array<string>")
    long = df.select(row, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names))).alias("x")).select(row, "x.*").where("value is not null")
    first = long.groupBy("column", "value").agg(F.min(row).alias("at"))
    head = first.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("at", "value"))).where("r <= 12")
    key = label_key(F.col("value"))
    level = F.when(key.isin(*STRONG) | (F.col("column").isin("control", "is_control") & key.isin(*TRUE_LABELS)), "high").when(key.isin(*AMBIGUOUS), "low")
    found = head.withColumn("confidence", level).where("confidence is not null")
    return found.groupBy("column", "confidence").agg(F.array_sort(F.collect_list(F.struct("r", "value"))).alias("x")).select("column", "confidence", F.col("x.value").alias("labels"))


def transform_family(name: str) -> str:
    """What a matrix's name says was done to it."""
    low = name.lower()
    for family, words in (("log", ("log",)), ("scaled", ("scale",)), ("normalized", ("norm", "cpm", "tpm")), ("binary", ("bin",)), ("identity", ("count", "raw"))):
        if any(w in low for w in words):
            return family
    return "identity" if name in (".X", "X") else "unknown"


def source_priority(name: str, status: str) -> int:
    """Score of a matrix by name and audit status."""
    low = name.lower()
    shaped = any(t in low for t in ("norm", "log", "scale"))
    if "count" in low and not any(t in low for t in ("norm", "log", "bin")):
        base = 500
    elif name == ".raw.X":
        base = 450
    elif name == ".X":
        base = 400
    else:
        base = 100 if shaped else 80 if "bin" in low else 250
    return base + {"pass": 50, "needs-review": 10}.get(status, -200)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """(name, status, score, ord) with ``rank``, best first."""
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord")))


def choose_count_source(candidates: DataFrame) -> DataFrame:
    """For the curated route: the widest matrix, then counts as they are before recovered ones, then source order."""
    direct = F.col("status") == "pass"
    return candidates.where("status = 'pass' or recoverable").orderBy(F.desc("n_features"), F.desc(direct), "ord").limit(1)


def choose_matrix(candidates: DataFrame) -> DataFrame:
    """For direct conversion: counts as they are before any recoverable one, then the widest, then names with counts, raw, X, others."""
    n = F.lower("name")
    named = F.when(n.contains("count"), 0).when(n.contains("raw"), 1).when(n.isin("x", ".x"), 2).otherwise(3)
    return candidates.where("status = 'pass' or recoverable").orderBy(F.desc(F.col("status") == "pass"), F.desc("n_features"), named, "ord").limit(1)


def readiness(status: str) -> str:
    return {"pass": "pass", "needs-review": "needs-review"}.get(status, "fail")


def inspect(obs: DataFrame, matrices: dict[str, tuple[DataFrame, int, int]], dataset_id: str, output: str | None = None) -> dict:
    """A dataset's summary; ``matrices``: name -> (coordinates, rows, columns)."""
    found = []
    for i, (name, (coo, rows, cols)) in enumerate(matrices.items()):
        a = audit_matrix(coo, rows, cols).first().asDict()
        r = audit_recovery(coo, rows).first().asDict() if a["status"] == "fail" and a["non_negative"] else None
        found.append({"name": name, "n_features": cols, "ord": i, **a, "recovery": r["status"] if r else None, "score": source_priority(name, a["status"])})
    usable = [c for c in found if c["status"] == "pass" or c["recovery"] in ("pass", "needs-review")]
    usable.sort(key=lambda c: (-c["n_features"], c["status"] != "pass", c["ord"]))
    best = usable[0] if usable else None
    state = readiness((best["status"] if best["status"] == "pass" else best["recovery"]) if best else "fail")
    out = {
        "kind": "dataset-summary",
        "dataset_id": dataset_id,
        "count_source": best["name"] if best else None,
        "needs_recovery": bool(best and best["status"] != "pass"),
        "readiness": state,
        "candidates": sorted(found, key=lambda c: (-c["score"], c["ord"])),
        "obs_fields": [r.asDict() for r in profile_fields(obs).orderBy("field").collect()],
        "control_labels": [r.asDict() for r in control_candidates(obs).orderBy("column", "confidence").collect()],
    }
    if output:
        write_yaml(out, Path(output, dataset_id, "dataset-summary.yaml"))
    return out
