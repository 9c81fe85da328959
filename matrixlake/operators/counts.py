"""Count matrices as coordinates (row, gene, value): checks, recovery, rounding, totals, row arrays, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_COUNT = 2**31 - 1
DIRECT_TOLERANCE = 1e-6
RECOVERY_TOLERANCE = 0.01
AUDIT_TOLERANCE = 1e-8


class CountError(ValueError):
    """The values are not what was asked for."""


def sum_duplicates(coo: DataFrame, row: str = "row", gene: str = "gene", value: str = "value") -> DataFrame:
    """Values of repeated coordinates are added; zeros go."""
    return coo.groupBy(row, gene).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def count_report(coo: DataFrame, value: str = "value") -> DataFrame:
    """One row: number of values, bad ones by kind, largest deviation from a whole number, and whether all are counts."""
    v = F.col(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf")) & v.isNotNull()
    ok = F.when(finite, v)
    deviation = F.max(F.abs(ok - F.rint(ok)))
    return coo.agg(
        F.count(F.lit(1)).alias("n_values"),
        F.coalesce(F.sum((~finite).cast("long")), F.lit(0)).alias("n_not_finite"),
        F.coalesce(F.sum((ok < 0).cast("long")), F.lit(0)).alias("n_negative"),
        F.coalesce(F.sum((ok > MAX_COUNT).cast("long")), F.lit(0)).alias("n_too_large"),
        F.coalesce(F.sum((ok != F.floor(ok)).cast("long")), F.lit(0)).alias("n_fractional"),
        F.coalesce(deviation, F.lit(0.0)).alias("max_deviation"),
    ).withColumn("all_counts", F.expr(f"n_not_finite = 0 and n_negative = 0 and n_too_large = 0 and max_deviation <= {DIRECT_TOLERANCE}"))


def nonnegative_integers(coo: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return coo.agg(F.coalesce(F.bool_and((v >= 0) & (v == F.floor(v))), F.lit(True)).alias("nonnegative_integers"))


def validate_counts(coo: DataFrame, value: str = "value") -> DataFrame:
    """The values as integers; raises before anything is written if one is no count."""
    r = count_report(coo, value).first()
    if not r["all_counts"]:
        raise CountError(f"not counts: {r['n_not_finite']} not finite, {r['n_negative']} negative, {r['n_too_large']} beyond {MAX_COUNT}, largest deviation {r['max_deviation']:g}")
    return coo.withColumn(value, F.rint(value).cast("int"))


def validate_finite(coo: DataFrame, value: str = "value") -> DataFrame:
    """Values that are not counts: any type, explicit zeros kept, all finite."""
    if n := count_report(coo, value).first()["n_not_finite"]:
        raise CountError(f"{n} values are not finite")
    return coo


def recovered(coo: DataFrame, row: str = "row", value: str = "value") -> DataFrame:
    """Counts behind log1p of scaled counts: expm1(x) over the cell's smallest; adds ``size_factor``, ``raw``, ``count``, ``deviation``."""
    e = F.expm1(F.col(value).cast("double"))
    low = F.min(F.when(e > 0, e)).over(Window.partitionBy(row))
    out = coo.withColumn("size_factor", F.coalesce(low, F.lit(1.0))).withColumn("raw", e / F.col("size_factor"))
    return out.withColumn("count", F.rint("raw")).withColumn("deviation", F.abs(F.col("raw") - F.col("count")))


def recover_counts(coo: DataFrame, row: str = "row", value: str = "value") -> DataFrame:
    """``coo`` with recovered whole counts; raises if a value is no count within 0.01."""
    found = recovered(coo, row, value)
    r = found.agg(F.max("deviation").alias("d"), F.max("raw").alias("m"), F.min(value).alias("low"), F.bool_or(F.isnan("raw") | F.col("raw").isNull()).alias("bad")).first()
    if r["d"] is not None and (r["bad"] or r["low"] < 0 or not r["d"] <= RECOVERY_TOLERANCE or not r["m"] <= MAX_COUNT):
        raise CountError(f"the values are not log1p of scaled counts: deviation {r['d']:g}, largest {r['m']:g}")
    return found.withColumn(value, F.col("count").cast("int")).drop("size_factor", "raw", "count", "deviation").where(F.col(value) != 0)


def fractional_share(coo: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return coo.agg(F.coalesce(F.avg((v != F.floor(v)).cast("double")), F.lit(0.0)).alias("fractional_value_share"))


def round_counts(coo: DataFrame, value: str = "value") -> DataFrame:
    """Half to even; zeros go."""
    return coo.withColumn(value, F.rint(value)).where(F.col(value) != 0)


def cell_totals(coo: DataFrame, obs: DataFrame, row: str = "row", value: str = "value", as_name: str = "total_counts") -> DataFrame:
    """``obs`` with each cell's sum; 0 where a cell has no values."""
    total = coo.groupBy(row).agg(F.sum(F.col(value).cast("double")).alias(as_name))
    return obs.join(total, row, "left").withColumn(as_name, F.coalesce(as_name, F.lit(0.0)))


def gene_nnz(coo: DataFrame, gene: str = "gene", value: str = "value") -> DataFrame:
    return coo.where(F.col(value) != 0).groupBy(gene).agg(F.count(F.lit(1)).alias("n_cells"))


def even_sample(n: int, k: int = 32) -> list[int]:
    """At most k evenly spaced row numbers of n, first and last among them."""
    if n <= 0:
        return []
    if n <= k:
        return list(range(n))
    return sorted({int(i * (n - 1) / (k - 1)) for i in range(k)})


def audit_matrix(coo: DataFrame, n_rows: int, n_cols: int, sample: int = 32, row: str = "row", value: str = "value") -> DataFrame:
    """One row about the values on evenly spaced rows: density, share and size of deviations, sign, status."""
    rows = even_sample(n_rows, sample)
    v = F.col(value).cast("double")
    dev = F.abs(v - F.rint(v))
    part = coo.where(F.col(row).isin(rows) & (v != 0)) if rows else coo.where("false")
    out = part.agg(
        F.count(F.lit(1)).alias("nnz"),
        F.coalesce(F.avg((dev > AUDIT_TOLERANCE).cast("double")), F.lit(0.0)).alias("fraction_non_integer"),
        F.coalesce(F.max(dev), F.lit(0.0)).alias("max_deviation"),
        F.coalesce(F.min(v) >= 0, F.lit(True)).alias("non_negative"),
    )
    status = F.expr("case when nnz = 0 then 'needs-review' when non_negative and fraction_non_integer = 0 then 'pass' else 'fail' end")
    return out.withColumn("n_rows_sampled", F.lit(len(rows))).withColumn("density", F.col("nnz") / F.lit(max(1, len(rows) * n_cols))).withColumn("status", status)


def audit_recovery(coo: DataFrame, n_rows: int, sample: int = 32, row: str = "row", value: str = "value") -> DataFrame:
    """Whether the sampled rows are log1p of scaled counts: pass, needs-review (within 0.01) or fail."""
    rows = even_sample(n_rows, sample)
    part = recovered(coo.where(F.col(row).isin(rows) & (F.col(value) > 0)), row, value)
    out = part.agg(F.count(F.lit(1)).alias("nnz"), F.coalesce(F.max("deviation"), F.lit(0.0)).alias("max_deviation"))
    return out.withColumn("status", F.expr(f"case when nnz = 0 then 'fail' when max_deviation <= {AUDIT_TOLERANCE} then 'pass' when max_deviation <= {RECOVERY_TOLERANCE} then 'needs-review' else 'fail' end"))


def to_rows(coo: DataFrame, row: str = "row", gene: str = "gene", value: str = "value") -> DataFrame:
    """A row per cell: genes rising and their counts, as two arrays."""
    items = F.sort_array(F.collect_list(F.struct(F.col(gene).alias("g"), F.col(value).alias("v"))))
    return coo.groupBy(row).agg(items.alias("x")).select(row, F.col("x.g").alias("genes"), F.col("x.v").alias("counts"))


def from_rows(rows: DataFrame, row: str = "row") -> DataFrame:
    return rows.select(row, F.explode(F.arrays_zip("genes", "counts")).alias("x")).select(row, F.col("x.genes").alias("gene"), F.col("x.counts").alias("value"))


def dense_to_coo(dense: DataFrame, row: str, values: str) -> DataFrame:
    return dense.select(row, F.posexplode(values).alias("gene", "value")).where("value <> 0")


def pack(rows: DataFrame, wide: bool = False) -> DataFrame:
    """Genes and whole counts of a cell in one array of longs: count above 16 bits of gene.

    ``wide`` takes genes below 2**31: what a gene has above 16 bits is added to its
    count and kept beside it in ``high``, which is null in cells without such genes.
    """
    most = 2**31 if wide else 65536
    bad = rows.agg(F.coalesce(F.bool_or(F.expr(f"exists(genes, g -> g < 0 or g >= {most}) or exists(counts, c -> c < 0 or c >= 4294967296 or c <> floor(c))")), F.lit(False)).alias("bad"))
    if bad.first()["bad"]:
        raise CountError(f"only genes below {most:,} and whole counts below 2**32 can be packed")
    out = rows.withColumn("packed", F.expr("transform(arrays_zip(genes, counts), x -> shiftleft(cast(x.counts as bigint), 16) + x.genes)"))
    if wide:
        out = out.withColumn("high", F.expr("case when exists(genes, g -> g >= 65536) then transform(genes, g -> cast(shiftright(g, 16) as int)) end"))
    return out.drop("genes", "counts")


def unpack(packed: DataFrame, count_type: str = "int") -> DataFrame:
    high = "high" if "high" in packed.columns else "cast(null as array<int>)"
    of = lambda e, kind: F.expr(f"transform(packed, (x, i) -> cast({e.format(h=f'coalesce(get({high}, i), 0)')} as {kind}))")
    return packed.withColumns({"genes": of("shiftleft({h}, 16) | (x & 65535)", "int"), "counts": of("shiftrightunsigned(x, 16) - {h}", count_type)}).drop("packed", "high")


def normalize_total(coo: DataFrame, target: float = 1e4, row: str = "row", value: str = "value") -> DataFrame:
    return coo.withColumn(value, F.col(value) * F.lit(target) / F.sum(value).over(Window.partitionBy(row)))


def log1p(coo: DataFrame, value: str = "value") -> DataFrame:
    return coo.withColumn(value, F.log1p(value))


def cell_qc(coo: DataFrame, row: str = "row", value: str = "value") -> DataFrame:
    return coo.groupBy(row).agg(F.count(F.lit(1)).alias("n_genes"), F.sum(value).alias("total_counts"), F.max(value).alias("top_count"))
