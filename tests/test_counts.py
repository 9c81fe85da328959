import math

import pytest
from pyspark.sql import functions as F

from matrixlake.operators import counts as C
from matrixlake.operators import features as V
from matrixlake.operators import gather as G
from matrixlake.queries.matrix import pack_unpack_roundtrip


def coo(spark, matrix, kind="double"):
    rows = [(i, j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, f"row long, gene int, value {kind}")


def as_matrix(df, n, m):
    out = [[0] * m for _ in range(n)]
    for r in df.collect():
        out[r["row"]][r["gene"]] = r["value"]
    return out


def test_recovery(spark):
    want = [[1, 2, 0], [0, 1, 4], [3, 1, 0], [1, 0, 0]]
    x = [[math.log1p(v * s) for v in r] for r, s in zip(want, (2.5, 0.4, 1.7, 2.2), strict=True)]
    df = coo(spark, x)
    with pytest.raises(C.CountError):
        C.validate_counts(df)
    assert as_matrix(C.recover_counts(df), 4, 3) == want
    with pytest.raises(C.CountError):
        C.recover_counts(coo(spark, [[0.7, 0.35], [0.3, 0.85]]))


def test_rounding(spark):
    df = coo(spark, [[0.4, 1.5, 0], [2.0, 0, 0.5], [0, 0, 0], [3.25, 0.75, 1]])
    assert C.fractional_share(df).first()[0] == 5 / 7
    assert as_matrix(C.round_counts(df), 4, 3) == [[0, 2, 0], [2, 0, 0], [0, 0, 0], [3, 1, 1]]


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf"), 2.0**31, 1.5])
def test_not_counts(spark, bad):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, bad)], "row long, gene int, value double")
    with pytest.raises(C.CountError):
        C.validate_counts(df)


def test_empty_matrix(spark):
    df = spark.createDataFrame([], "row long, gene int, value double")
    assert C.count_report(df).first()["all_counts"]
    assert C.validate_counts(df).count() == 0
    assert C.audit_matrix(df, 0, 0).first()["status"] == "needs-review"
    assert C.fractional_share(df).first()[0] == 0.0
    assert C.recover_counts(df).count() == 0


def test_totals_of_empty_cells(spark):
    obs = spark.range(4).withColumnRenamed("id", "row")
    out = C.cell_totals(coo(spark, [[1, 0, 2], [0, 0, 0], [3, 1, 0], [0, 0, 0]]), obs).orderBy("row")
    assert [r["total_counts"] for r in out.collect()] == [3.0, 0.0, 4.0, 0.0]


def test_packing(spark):
    rows = spark.createDataFrame([(0, [0, 65535], [1, 2**31 - 1])], "row long, genes array<int>, counts array<int>")
    back = C.unpack(C.pack(rows)).first()
    assert (back["genes"], back["counts"]) == ([0, 65535], [1, 2**31 - 1])
    for genes, counts in (([65536], [1.0]), ([1], [0.5]), ([1], [-1.0]), ([1], [2.0**32])):
        with pytest.raises(C.CountError):
            C.pack(spark.createDataFrame([(0, genes, counts)], "row long, genes array<int>, counts array<double>"))


def test_packing_of_wide_genes(spark, tmp_path):
    cells = [([0, 65535], [1, 2**31 - 1]), ([5, 65536 + 5, 131072 + 5, 2**31 - 1], [3, 2, 1, 2**31 - 1]), ([], [])]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "row long, genes array<int>, counts array<int>")
    packed = C.pack(rows, wide=True)
    p = [(r["packed"], r["high"]) for r in packed.orderBy("row").collect()]
    assert p == [([(v << 16) + g for g, v in zip(*c, strict=True)], [g >> 16 for g in c[0]] if max(c[0], default=0) > 65535 else None) for c in cells]
    back = C.unpack(packed)
    assert back.dtypes == rows.dtypes and [(r["genes"], r["counts"]) for r in back.orderBy("row").collect()] == cells
    with pytest.raises(C.CountError):
        C.pack(spark.createDataFrame([(0, [2**31], [1])], "row long, genes array<long>, counts array<int>"), wide=True)
    items = [(1, 70000, 2.0), (1, 4464, 3.0), (1, 70000, 1.0), (2, 65536, 1.0), (3, 12, 50.0), (3, 13, 0.0)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = pack_unpack_roundtrip(spark, str(tmp_path)).select("row", "gene", "value", "first_packed").collect()
    assert sorted(map(tuple, got)) == [(1, 4464, 3, 3 * 65536 + 4464), (1, 70000, 3, 3 * 65536 + 4464), (2, 65536, 1, 131072), (3, 12, 50, 50 * 65536 + 12)]


def test_even_sample():
    assert C.even_sample(0) == [] and C.even_sample(3) == [0, 1, 2]
    s = C.even_sample(1000)
    assert len(s) == 32 and s[0] == 0 and s[-1] == 999


def test_feature_mask(spark):
    x = coo(spark, [[1, 0, 0.37], [0, 4, -1.2], [2, 3, 0.05]])
    var = spark.createDataFrame([(0, "RNA"), (1, "RNA"), (2, "protein")], "origin_index int, modality string")
    m, v = V.mask_features(x, var, "modality", "RNA")
    assert as_matrix(m, 3, 2) == [[1, 0], [0, 4], [2, 3]] and v.count() == 2


def test_feature_checks(spark):
    var = lambda rows: spark.createDataFrame(rows, "dataset_index int, origin_index int, feature_id string")
    same = V.vocabulary(var([(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "b")]))
    assert V.axis(same, "exact").count() == 2
    differ = V.vocabulary(var([(0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "c")]))
    with pytest.raises(V.FeatureError):
        V.axis(differ, "exact")
    assert [r["feature_id"] for r in V.axis(differ, "inner").collect()] == ["b"]
    assert [r["feature_id"] for r in V.axis(differ, "outer").orderBy("output_index").collect()] == ["a", "b", "c"]
    with pytest.raises(V.FeatureError):
        V.axis(V.vocabulary(var([(0, 0, "a"), (1, 0, "b")])), "inner")
    with pytest.raises(V.FeatureError):
        V.check_origin_index(var([(0, 0, "a"), (0, 2, "b")]), by="dataset_index")
    with pytest.raises(V.FeatureError):
        V.require_unique(var([(0, 0, "a"), (0, 1, "a")]), "dataset_index", "feature_id")


def test_gather(spark):
    t = spark.range(10).select(F.col("id").alias("global_row_index"), (F.col("id") * 2).alias("v"))
    assert [r["v"] for r in G.gather_ids(t, [5, 5, 3, 5]).collect()] == [10, 10, 6, 10]
    assert G.gather_ids(t, []).count() == 0
    with pytest.raises(IndexError):
        G.check_range(G.request(spark, [3, 10]), 10)
    with pytest.raises(IndexError):
        G.check_range(G.request(spark, [-1]), 10)
    big = [i % 10 for i in range(1500)]
    assert [r["v"] for r in G.gather_ids(t, big).collect()] == [2 * i for i in big]


def test_strict_union(spark):
    a = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        G.strict_union(a, spark.createDataFrame([("1",)], "x string"))
