"""Feature axes, composition of cell and feature tables, annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.functions.text import null_if_missing
from matrixlake.operators import features as V
from matrixlake.operators import gather as G
from matrixlake.plans.corpus import Corpus, Member
from matrixlake.queries.data import DATASET_SQL, VAR_SQL, local_coo, table, var


def vocab_first_seen(spark, d) -> DataFrame:
    return V.vocabulary(var(spark, d))


def flagship(spark, d) -> DataFrame:
    """For each dataset and feature of the shared vocabulary: measured or not, and its total count."""
    vocab = V.vocabulary(var(spark, d))
    total = V.local_to_global(local_coo(spark, d), vocab).groupBy("dataset_index", "global_id").agg(F.sum("value").alias("total"))
    return V.presence(vocab).join(total, ["dataset_index", "global_id"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def local_to_global(spark, d) -> DataFrame:
    return V.local_to_global(local_coo(spark, d), V.vocabulary(var(spark, d))).select("dataset_index", "row", "global_id", "value")


def global_map_padded(spark, d) -> DataFrame:
    vocab = V.vocabulary(var(spark, d))
    return V.global_map(vocab, vocab.select("dataset_index").distinct(), 2000)


def feature_presence(spark, d) -> DataFrame:
    return V.presence(V.vocabulary(var(spark, d)))


def feature_prob_uniform(spark, d) -> DataFrame:
    return V.uniform_probability(V.vocabulary(var(spark, d))).select("dataset_index", "global_id", F.round(F.col("probability").cast("double"), 7).alias("probability"))


def axis_exact_check(spark, d) -> DataFrame:
    vocab = V.vocabulary(var(spark, d))
    one = vocab.where("dataset_index = 0")
    same = one.unionByName(one.withColumn("dataset_index", F.lit(1)))
    return V.axis_exact(vocab).withColumn("what", F.lit("flags")).unionByName(V.axis_exact(same).withColumn("what", F.lit("same")))


def axis_inner(spark, d) -> DataFrame:
    return V.axis_inner(V.vocabulary(var(spark, d)))


def axis_outer(spark, d) -> DataFrame:
    return V.axis_outer(V.vocabulary(var(spark, d)))


def axis_inner_aligned(spark, d) -> DataFrame:
    vocab = V.vocabulary(var(spark, d))
    return V.align(local_coo(spark, d), vocab, V.axis_inner(vocab))


def axis_outer_dense(spark, d) -> DataFrame:
    """Rows of a view of two small corpora on the outer axis, with the measured mask."""
    coo = {"a": [(0, 0, 1), (0, 2, 2), (1, 1, 3)], "b": [(0, 0, 5), (1, 1, 7)]}
    names = {"a": ["g1", "g2", "g3"], "b": ["g3", "g4"]}
    members = []
    for m in ("a", "b"):
        x = spark.createDataFrame(coo[m], "row long, gene int, value int")
        rows = x.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("x")).select(F.col("row").alias("global_row_index"), F.col("x.gene").alias("genes"), F.col("x.value").alias("counts"))
        obs = spark.range(2).select(F.col("id").alias("local_row_index"), F.concat(F.lit(m), F.col("id")).alias("cell_id"))
        members.append(Member(m, rows, obs, spark.createDataFrame(list(enumerate(names[m])), "origin_index int, feature_id string"), 2, len(names[m])))
    out = Corpus(spark, members).dense_counts([3, 0, 2])
    return out.select("pos", "id", F.array_join(F.transform("counts", lambda x: x.cast("int").cast("string")), ",").alias("counts"), F.array_join(F.transform("measured", lambda x: x.cast("int").cast("string")), ",").alias("measured"))


def hvg_rank_mask(spark, d) -> DataFrame:
    size = table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), (F.col("p_size") > 25).alias("highly_variable"))
    return V.hvg_mask(V.hvg_ranks(var(spark, d).join(size, "feature_id")), 100).select("dataset_index", "origin_index", "hvg_rank", "hvg")


def obs_diagonal_union(spark, d) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), null_if_missing(F.expr("if(c_custkey % 5 = 0, ' NA ', c_mktsegment)")).alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return G.diagonal_union(a, b)


def obs_strict_union(spark, d) -> DataFrame:
    a = table(spark, d, "customer").select(F.lit("customer").alias("dataset_id"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("dataset_id"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return G.strict_union(a, b)


def var_conflict_check(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.expr(DATASET_SQL).alias("dataset_index"), (F.col("l_partkey") % 500).alias("feature_id"), F.expr("nullif(l_linestatus, 'F')").alias("line"), F.expr("cast(l_partkey % 500 as string)").alias("name"))
    return V.merge_attributes(rows, "feature_id", ["line", "name"])


def annotate_positional(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    obs = o.select(F.col("o_orderkey").alias("local_row_index"), F.col("o_orderkey").cast("string").alias("cell_id"), "o_orderstatus")
    extra = o.select(F.col("o_orderkey").alias("local_row_index"), F.col("o_orderkey").cast("string").alias("cell_id"), F.floor(F.col("o_totalprice") / 1000).alias("score"))
    n = obs.count()
    none = spark.createDataFrame([], "global_row_index long, genes array<int>, counts array<int>")
    return Corpus(spark, [Member("orders", none, obs, none, n, 0)]).add_obs(extra).members[0].obs


def feature_id_match(spark, d) -> DataFrame:
    have = table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.expr("cast(p_partkey as int)").alias("origin_index"), F.expr("if(p_size > 10, 'gene', 'guide')").alias("feature_type"))
    want = table(spark, d, "part").where("p_size > 12").select(F.col("p_partkey").alias("feature_id"), F.expr("cast(p_partkey * 2 as int)").alias("origin_index"))
    return V.match_features(have, want, "gene")


def gene_map_left_default(spark, d) -> DataFrame:
    genes = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("gene_id"))
    mapped = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("gene"), F.upper("p_name").alias("to"))
    return V.map_genes(genes, mapped)


def view_metadata(spark, d) -> DataFrame:
    """Routing columns of a view over two members."""
    none = spark.createDataFrame([], "global_row_index long, genes array<int>, counts array<int>")
    members = []
    for name, t, key in (("customers", "customer", "c_custkey"), ("suppliers", "supplier", "s_suppkey")):
        obs = table(spark, d, t).select(F.col(key).alias("local_row_index"), F.concat(F.lit(name[0]), F.col(key)).alias("cell_id"), F.lit("user value").alias("dataset_id"))
        members.append(Member(name, none, obs, none, obs.count(), 0))
    return Corpus(spark, members).obs


def _v(sql: str) -> str:
    return f"WITH {VAR_SQL} {sql}"


_PRESENCE = "SELECT p.global_id, p.feature_id, s.dataset_index, v.feature_id IS NOT NULL AS measured FROM (SELECT DISTINCT global_id, feature_id FROM vocab) p CROSS JOIN (SELECT DISTINCT dataset_index FROM vocab) s LEFT JOIN vocab v ON v.global_id = p.global_id AND v.dataset_index = s.dataset_index"
_INNER = "SELECT CAST(row_number() OVER (ORDER BY min(dataset_index * 1000000000 + origin_index)) - 1 AS INTEGER) AS output_index, global_id, feature_id FROM vocab GROUP BY global_id, feature_id HAVING count(DISTINCT dataset_index) = 3"

QUERIES = {
    "flagship_measured_totals": (flagship, _v(f", t AS (SELECT {DATASET_SQL} AS dataset_index, l_partkey AS feature_id, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2), pr AS ({_PRESENCE}) SELECT pr.*, coalesce(t.total, 0.0) AS total FROM pr LEFT JOIN t USING (dataset_index, feature_id)")),
    "vocab_first_seen": (vocab_first_seen, _v("SELECT * FROM vocab")),
    "local_to_global": (local_to_global, _v(f"SELECT v.dataset_index, l_orderkey AS row, global_id, l_quantity AS value FROM lineitem JOIN vocab v ON v.dataset_index = {DATASET_SQL} AND v.feature_id = l_partkey")),
    "global_map_padded": (global_map_padded, _v("SELECT s.dataset_index, CAST(i AS INTEGER) AS origin_index, coalesce(v.global_id, -1) AS global_id FROM (SELECT DISTINCT dataset_index FROM vocab) s CROSS JOIN (SELECT unnest(range(2000)) AS i) LEFT JOIN vocab v ON v.dataset_index = s.dataset_index AND v.origin_index = i")),
    "feature_presence": (feature_presence, _v(_PRESENCE)),
    "feature_prob_uniform": (feature_prob_uniform, _v("SELECT dataset_index, global_id, round(CAST(CAST(1.0 / count(*) OVER (PARTITION BY dataset_index) AS FLOAT) AS DOUBLE), 7) AS probability FROM vocab")),
    "axis_exact_check": (
        axis_exact_check,
        _v("SELECT (SELECT count(*) FROM (SELECT origin_index FROM vocab GROUP BY 1 HAVING count(DISTINCT feature_id) <> 1 OR count(*) <> 3)) = 0 AS exact, 'flags' AS what UNION ALL SELECT true, 'same'"),
    ),
    "axis_inner": (axis_inner, _v(_INNER)),
    "axis_outer": (axis_outer, _v("SELECT CAST(dense_rank() OVER (ORDER BY global_id) - 1 AS INTEGER) AS output_index, global_id, feature_id FROM (SELECT DISTINCT global_id, feature_id FROM vocab)")),
    "axis_inner_aligned": (axis_inner_aligned, _v(f", a AS ({_INNER}) SELECT {DATASET_SQL} AS dataset_index, l_orderkey AS row, l_quantity AS value, a.output_index AS gene FROM lineitem JOIN a ON a.feature_id = l_partkey")),
    "axis_outer_dense": (
        axis_outer_dense,
        "SELECT * FROM (VALUES (0::BIGINT, 3::BIGINT, '0,0,0,7', '0,0,1,1'), (1, 0, '1,0,2,0', '1,1,1,0'), (2, 2, '0,0,5,0', '0,0,1,1')) AS t(pos, id, counts, measured)",
    ),
    "hvg_rank_mask": (
        hvg_rank_mask,
        _v(", h AS (SELECT dataset_index, origin_index, p_size > 25 AS hv FROM var JOIN part ON p_partkey = feature_id), r AS (SELECT dataset_index, origin_index, CASE WHEN hv THEN CAST(row_number() OVER (PARTITION BY dataset_index, hv ORDER BY origin_index) AS INTEGER) ELSE 0 END AS hvg_rank FROM h) SELECT *, hvg_rank BETWEEN 1 AND 100 AS hvg FROM r"),
    ),
    "obs_diagonal_union": (
        obs_diagonal_union,
        "SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    ),
    "obs_strict_union": (obs_strict_union, "SELECT 'customer' AS dataset_id, c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier"),
    "var_conflict_check": (
        var_conflict_check,
        "SELECT l_partkey % 500 AS feature_id, max(nullif(l_linestatus, 'F')) AS line, CAST(l_partkey % 500 AS VARCHAR) AS name, count(DISTINCT nullif(l_linestatus, 'F')) > 1 AS conflict FROM lineitem GROUP BY l_partkey % 500",
    ),
    "annotate_positional": (annotate_positional, "SELECT o_orderkey AS local_row_index, CAST(o_orderkey AS VARCHAR) AS cell_id, o_orderstatus, CAST(floor(o_totalprice / 1000) AS BIGINT) AS score FROM orders"),
    "feature_id_match": (
        feature_id_match,
        "SELECT p_partkey AS feature_id, CAST(p_partkey AS INTEGER) AS file_index, CASE WHEN p_size > 12 THEN CAST(p_partkey * 2 AS INTEGER) END AS output_index, p_size > 12 AS matched FROM part WHERE p_size > 10",
    ),
    "gene_map_left_default": (gene_map_left_default, "SELECT 'P' || p_partkey AS gene_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE 'P' || p_partkey END AS canonical_gene_id FROM part"),
    "view_metadata": (
        view_metadata,
        "SELECT c_custkey AS global_row_index, 0 AS dataset_index, 'customers' AS dataset_id, c_custkey AS local_row_index, 'c' || c_custkey AS cell_id FROM customer UNION ALL SELECT s_suppkey + (SELECT count(*) FROM customer), 1, 'suppliers', s_suppkey, 's' || s_suppkey FROM supplier",
    ),
}
