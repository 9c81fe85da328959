"""Counts: sums, totals, masks, checks, recovery, audits, packing, gathers, rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.functions.draws import order
from matrixlake.operators import counts as C
from matrixlake.operators import features as V
from matrixlake.operators import gather as G
from matrixlake.operators.reorder import reorder, shuffled
from matrixlake.plans.inspection import choose_count_source, choose_matrix, rank_candidates, source_priority
from matrixlake.queries.data import coo, dataset_coo, table


def coo_sum_duplicates(spark, d) -> DataFrame:
    return C.sum_duplicates(coo(spark, d))


SUM_SQL = "SELECT l_orderkey AS row, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0"


def rows_as_arrays(spark, d) -> DataFrame:
    rows = C.to_rows(C.sum_duplicates(coo(spark, d)))
    return rows.select("row", F.array_join("genes", ",").alias("genes"), F.array_join(F.transform("counts", lambda x: x.cast("long").cast("string")), ",").alias("counts"))


def arrays_to_coo(spark, d) -> DataFrame:
    return C.from_rows(C.to_rows(C.sum_duplicates(coo(spark, d))))


def cell_total_counts(spark, d) -> DataFrame:
    return C.cell_totals(coo(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("row")))


def feature_mask_renumber(spark, d) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("origin_index"), "p_brand")
    return V.mask_features(C.sum_duplicates(coo(spark, d)), parts, "p_brand", "Brand#12")[0]


def round_half_even_share(spark, d) -> DataFrame:
    halves = coo(spark, d).withColumn("value", F.col("value") * 0.5)
    return C.round_counts(halves).agg(F.count(F.lit(1)).alias("n_values"), F.sum("value").alias("total")).join(C.fractional_share(halves))


def _scaled(spark, d) -> DataFrame:
    """ln(1 + s c) of counts c that have a 1 in every cell; s depends on the cell."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("gene")).agg(F.max("l_quantity").alias("q"))
    low = li.groupBy("row").agg(F.min("q").alias("m"))
    x = F.log(1 + (F.col("q") - F.col("m") + 1) * (0.5 + F.pmod("row", F.lit(7)) * 0.25))
    return li.join(low, "row").select("row", "gene", x.alias("value"))


def log1p_recovery(spark, d) -> DataFrame:
    return C.recover_counts(_scaled(spark, d))


def recovery_audit(spark, d) -> DataFrame:
    n = table(spark, d, "orders").count()
    return C.audit_recovery(_scaled(spark, d), n).select("nnz", (F.col("max_deviation") < 1e-6).alias("exact"), F.col("status").isin("pass", "needs-review").alias("usable"))


def count_validation_report(spark, d) -> DataFrame:
    good = C.count_report(coo(spark, d)).withColumn("what", F.lit("quantity"))
    prices = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("value"))
    return good.unionByName(C.count_report(prices).withColumn("what", F.lit("price")))


def nonnegative_integers(spark, d) -> DataFrame:
    return C.nonnegative_integers(coo(spark, d))


def validated_counts(spark, d) -> DataFrame:
    return C.validate_counts(C.sum_duplicates(coo(spark, d)))


def matrix_audit_sampled(spark, d) -> DataFrame:
    n, m = table(spark, d, "orders").count(), table(spark, d, "part").count()
    out = C.audit_matrix(C.sum_duplicates(coo(spark, d)), n, m)
    return out.select("nnz", "fraction_non_integer", "max_deviation", "non_negative", F.round("density", 12).alias("density"), "status")


_CANDIDATES = [(".X", "fail", 2000, True, 0), (".raw.X", "pass", 1800, False, 1), ("counts", "pass", 2000, False, 2), ("lognorm", "fail", 2500, True, 3), ("binned", "fail", 2500, False, 4)]


def _candidates(spark) -> DataFrame:
    rows = [(*c, source_priority(c[0], c[1])) for c in _CANDIDATES]
    return spark.createDataFrame(rows, "name string, status string, n_features int, recoverable boolean, ord int, score int")


def count_source_choice(spark, d) -> DataFrame:
    c = _candidates(spark)
    return choose_count_source(c).select(F.lit("widest first").alias("rule"), "name").unionByName(choose_matrix(c).select(F.lit("counts first").alias("rule"), "name"))


def candidate_ranking(spark, d) -> DataFrame:
    return rank_candidates(_candidates(spark)).select("name", "score", "rank")


def pack_unpack_roundtrip(spark, d) -> DataFrame:
    rows = C.to_rows(C.sum_duplicates(coo(spark, d).withColumn("gene", F.col("gene").cast("int"))))
    packed = C.pack(rows, wide=True)
    return C.from_rows(C.unpack(packed)).join(packed.select("row", F.element_at("packed", 1).alias("first_packed")), "row")


def gene_nnz(spark, d) -> DataFrame:
    return C.gene_nnz(C.sum_duplicates(coo(spark, d)))


def cell_qc(spark, d) -> DataFrame:
    return C.cell_qc(C.sum_duplicates(coo(spark, d)))


def normalized_log1p(spark, d) -> DataFrame:
    return C.log1p(C.normalize_total(C.sum_duplicates(coo(spark, d)))).withColumn("value", F.round("value", 6))


def dense_slice(spark, d) -> DataFrame:
    wide = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: F.when(x > 0, F.lit(1)).otherwise(0)).alias("values"))
    return C.dense_to_coo(wide, "row", "values")


def gather_ordered_dups(spark, d) -> DataFrame:
    ids = [9, 1, 9, 5, 0, 257, 14, 5]
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("global_row_index"), "o_orderstatus", "o_totalprice")
    return G.gather_ids(orders, ids)


def gather_table_all(spark, d) -> DataFrame:
    """Every line item asks for an order, any of all of them."""
    n = table(spark, d, "orders").count()
    asked = table(spark, d, "lineitem").select(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("pos"), F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(n)).alias("id"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("global_row_index"), "o_orderstatus")
    return G.gather(orders, asked)


def _entries(spark, d) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n_cells"))
    number = F.when(F.col("dataset_id") == "F", 0).when(F.col("dataset_id") == "O", 1).otherwise(2)
    return V.global_ranges(n.withColumn("dataset_index", number))


def global_ranges(spark, d) -> DataFrame:
    return _entries(spark, d)


ENTRIES_SQL = """e AS (SELECT o_orderstatus AS dataset_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS dataset_index, count(*) AS n_cells FROM orders GROUP BY 1, 2),
ent AS (SELECT dataset_id, n_cells, dataset_index, CAST(sum(n_cells) OVER (ORDER BY dataset_index) AS BIGINT) AS global_end, CAST(sum(n_cells) OVER (ORDER BY dataset_index) - n_cells AS BIGINT) AS global_start FROM e)"""


def route_all_rows_to_dataset(spark, d) -> DataFrame:
    n = table(spark, d, "orders").count()
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.pmod(F.col("o_orderkey") * 31, F.lit(n)).alias("id"))
    return G.route(ids, _entries(spark, d))


def gap_islands(spark, d) -> DataFrame:
    return G.row_ranges(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")), 2)


def extra_matrix_rows(spark, d) -> DataFrame:
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("global_row_index"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return G.gather_ids(events, [6, 0, 3, 3])


def extra_csc_regroup(spark, d) -> DataFrame:
    """Values that come by feature, regrouped by cell: the shuffle is the regrouping."""
    by_gene = coo(spark, d).repartition("gene")
    return C.to_rows(C.sum_duplicates(by_gene)).select("row", F.size("genes").cast("long").alias("n"), F.element_at("genes", 1).alias("first_gene"), F.element_at("counts", -1).alias("last_count"))


def _shuffled(spark, d) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey < 500").select(F.col("o_orderkey").alias("row"))
    from pyspark.sql import Window

    return o.withColumn("new_row", F.row_number().over(Window.orderBy(order(7, F.col("row")))) - 1)


def reorder_rewrite_all(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("global_row_index"), "o_totalprice")
    return reorder(orders, shuffled(orders.select(F.col("global_row_index").alias("row")), 7))


def export_chunks(spark, d) -> DataFrame:
    return G.chunks(dataset_coo(spark, d), 4096).groupBy("dataset_index", "chunk").agg(F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("total"))


def duplicate_keys(spark, d) -> DataFrame:
    return V.duplicate_keys(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


_EVEN = "ids AS (SELECT DISTINCT CASE WHEN n <= 32 THEN i ELSE CAST(floor(i * (n - 1) / 31.0) AS BIGINT) END AS r FROM (SELECT count(*) AS n FROM orders), (SELECT unnest(range(32)) AS i) WHERE i < n)"
_SCALED_SQL = """li AS (SELECT l_orderkey AS row, l_linenumber AS gene, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
sc AS (SELECT row, gene, q - min(q) OVER (PARTITION BY row) + 1 AS c FROM li)"""

QUERIES = {
    "coo_sum_duplicates": (coo_sum_duplicates, SUM_SQL),
    "rows_as_arrays": (rows_as_arrays, f"SELECT row, string_agg(CAST(gene AS VARCHAR), ',' ORDER BY gene) AS genes, string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY gene) AS counts FROM ({SUM_SQL}) GROUP BY row"),
    "arrays_to_coo": (arrays_to_coo, SUM_SQL),
    "cell_total_counts": (cell_total_counts, "SELECT o_orderkey AS row, coalesce(sum(l_quantity), 0.0) AS total_counts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "feature_mask_renumber": (
        feature_mask_renumber,
        f"WITH p AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS g FROM part WHERE p_brand = 'Brand#12') SELECT row, g AS gene, value FROM ({SUM_SQL}) s JOIN p ON p_partkey = s.gene",
    ),
    "round_half_even_share": (
        round_half_even_share,
        "WITH h AS (SELECT l_quantity * 0.5 AS v FROM lineitem) SELECT count(*) FILTER (WHERE round_even(v, 0) <> 0) AS n_values, sum(round_even(v, 0)) AS total, avg(CASE WHEN v <> floor(v) THEN 1.0 ELSE 0.0 END) AS fractional_value_share FROM h",
    ),
    "log1p_recovery": (log1p_recovery, f"WITH {_SCALED_SQL} SELECT row, gene, CAST(c AS INTEGER) AS value FROM sc"),
    "recovery_audit": (recovery_audit, f"WITH {_SCALED_SQL}, {_EVEN} SELECT count(*) AS nnz, true AS exact, true AS usable FROM sc JOIN ids ON ids.r = sc.row"),
    "count_validation_report": (
        count_validation_report,
        " UNION ALL ".join(
            f"SELECT count(*) AS n_values, CAST(0 AS BIGINT) AS n_not_finite, CAST(sum(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative, CAST(sum(CASE WHEN {c} > 2147483647 THEN 1 ELSE 0 END) AS BIGINT) AS n_too_large, CAST(sum(CASE WHEN {c} <> floor({c}) THEN 1 ELSE 0 END) AS BIGINT) AS n_fractional, max(abs({c} - round_even({c}, 0))) AS max_deviation, max(abs({c} - round_even({c}, 0))) <= 1e-6 AND min({c}) >= 0 AS all_counts, '{n}' AS what FROM lineitem"
            for c, n in (("l_quantity", "quantity"), ("l_extendedprice", "price"))
        ),
    ),
    "nonnegative_integers": (nonnegative_integers, "SELECT bool_and(l_quantity >= 0 AND l_quantity = floor(l_quantity)) AS nonnegative_integers FROM lineitem"),
    "validated_counts": (validated_counts, f"SELECT row, gene, CAST(value AS INTEGER) AS value FROM ({SUM_SQL})"),
    "matrix_audit_sampled": (
        matrix_audit_sampled,
        f"WITH {_EVEN}, v AS (SELECT value FROM ({SUM_SQL}) s JOIN ids ON ids.r = s.row) SELECT count(*) AS nnz, 0.0::DOUBLE AS fraction_non_integer, 0.0::DOUBLE AS max_deviation, true AS non_negative, round(count(*) / ((SELECT count(*) FROM ids) * (SELECT count(*) FROM part))::DOUBLE, 12) AS density, 'pass' AS status FROM v",
    ),
    "count_source_choice": (
        count_source_choice,
        """WITH c(name, status, n, rec, ord) AS (VALUES ('.X', 'fail', 2000, true, 0), ('.raw.X', 'pass', 1800, false, 1), ('counts', 'pass', 2000, false, 2), ('lognorm', 'fail', 2500, true, 3), ('binned', 'fail', 2500, false, 4))
        SELECT 'widest first' AS rule, (SELECT name FROM c WHERE status = 'pass' OR rec ORDER BY n DESC, status = 'pass' DESC, ord LIMIT 1) AS name
        UNION ALL SELECT 'counts first', (SELECT name FROM c WHERE status = 'pass' OR rec ORDER BY status = 'pass' DESC, n DESC, ord LIMIT 1)""",
    ),
    "candidate_ranking": (
        candidate_ranking,
        "WITH c(name, score, ord) AS (VALUES ('.X', 200, 0), ('.raw.X', 500, 1), ('counts', 550, 2), ('lognorm', -100, 3), ('binned', -120, 4)) SELECT name, score, CAST(row_number() OVER (ORDER BY score DESC, ord) AS INTEGER) AS rank FROM c",
    ),
    "pack_unpack_roundtrip": (
        pack_unpack_roundtrip,
        f"SELECT row, CAST(gene AS INTEGER) AS gene, CAST(value AS INTEGER) AS value, first_value(CAST(value AS BIGINT) * 65536 + gene) OVER (PARTITION BY row ORDER BY gene) AS first_packed FROM ({SUM_SQL})",
    ),
    "gene_nnz": (gene_nnz, f"SELECT gene, count(*) AS n_cells FROM ({SUM_SQL}) GROUP BY 1"),
    "cell_qc": (cell_qc, f"SELECT row, count(*) AS n_genes, sum(value) AS total_counts, max(value) AS top_count FROM ({SUM_SQL}) GROUP BY 1"),
    "normalized_log1p": (normalized_log1p, f"SELECT row, gene, round(ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY row)), 6) AS value FROM ({SUM_SQL})"),
    "dense_slice": (dense_slice, "SELECT vec_id AS row, CAST(i - 1 AS INTEGER) AS gene, 1 AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE embedding[i] > 0"),
    "gather_ordered_dups": (
        gather_ordered_dups,
        "SELECT id AS global_row_index, o_orderstatus, o_totalprice, pos FROM (SELECT unnest([9, 1, 9, 5, 0, 257, 14, 5])::BIGINT AS id, unnest(range(8)) AS pos) JOIN orders ON o_orderkey = id",
    ),
    "gather_table_all": (
        gather_table_all,
        "SELECT o_orderkey AS global_row_index, o_orderstatus, CAST((l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS BIGINT) AS pos FROM lineitem JOIN orders ON o_orderkey = (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM orders)",
    ),
    "global_ranges": (global_ranges, f"WITH {ENTRIES_SQL} SELECT * FROM ent"),
    "route_all_rows_to_dataset": (
        route_all_rows_to_dataset,
        f"WITH {ENTRIES_SQL}, i AS (SELECT o_orderkey AS pos, (o_orderkey * 31) % (SELECT count(*) FROM orders) AS id FROM orders) SELECT pos, id, dataset_id, dataset_index, id - global_start AS local_row_index FROM i JOIN ent ON id >= global_start AND id < global_end",
    ),
    "gap_islands": (
        gap_islands,
        "WITH i AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45), n AS (SELECT id, CASE WHEN id - lag(id) OVER (ORDER BY id) <= 3 THEN 0 ELSE 1 END AS b FROM i), r AS (SELECT id, sum(b) OVER (ORDER BY id) AS k FROM n) SELECT min(id) AS start, max(id) + 1 AS stop, count(*) AS n_requested FROM r GROUP BY k",
    ),
    "extra_matrix_rows": (
        extra_matrix_rows,
        "SELECT id AS global_row_index, event_type, count(*) AS n, pos FROM (SELECT unnest([6, 0, 3, 3])::BIGINT AS id, unnest(range(4)) AS pos) JOIN events ON user_id = id GROUP BY 1, 2, 4",
    ),
    "extra_csc_regroup": (extra_csc_regroup, f"SELECT row, count(*) AS n, min(gene) AS first_gene, arg_max(value, gene) AS last_count FROM ({SUM_SQL}) GROUP BY 1"),
    "reorder_rewrite_all": (
        reorder_rewrite_all,
        "WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5('7:' || o_orderkey)) - 1 AS n FROM orders) SELECT n AS global_row_index, o_totalprice, o_orderkey AS source_row FROM o",
    ),
    "export_chunks": (
        export_chunks,
        "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS dataset_index, l_orderkey // 4096 AS chunk, count(*) AS nnz, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2",
    ),
    "duplicate_keys": (duplicate_keys, "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
}
