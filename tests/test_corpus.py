import pytest
from pyspark.sql import functions as F

from matrixlake.operators import gather as G
from matrixlake.operators.features import FeatureError
from matrixlake.operators.reorder import write_reordered
from matrixlake.plans import corpus as K
from matrixlake.plans import manage as M


def tables(spark, matrix, ids, names):
    coo = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if v], "row long, gene int, value double")
    obs = spark.createDataFrame([(i, c, i * 10) for i, c in enumerate(ids)], "local_row_index long, cell_id string, dataset_id int")
    return coo, obs, spark.createDataFrame(list(enumerate(names)), "origin_index int, feature_id string")


MATRIX = [[1, 0, 2], [0, 0, 0], [3, 1, 0], [0, 0, 0]]


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpora")
    a = K.convert(*tables(spark, MATRIX, ["c1", "c2", "c3", "c4"], ["g1", "g2", "g3"]), f"{base}/a")
    b = K.convert(*tables(spark, MATRIX, ["d1", "d2", "d3", "d4"], ["g3", "g1", "g4"]), f"{base}/b")
    return base, a, b


def test_convert(spark, two):
    base, a, _ = two
    assert [r["total_counts"] for r in a.members[0].obs.orderBy("local_row_index").collect()] == [3.0, 0.0, 4.0, 0.0]
    offsets, genes, counts, rows = a.to_local_batch([3, 0, 1, 0])
    assert (offsets.tolist(), genes.tolist(), counts.tolist(), rows.tolist()) == ([0, 0, 2, 2, 4], [0, 2, 0, 2], [1, 2, 1, 2], [3, 0, 1, 0])
    with pytest.raises(FileExistsError):
        K.convert(*tables(spark, MATRIX, "abcd", "xyz"), f"{base}/a")
    coo, obs, var = tables(spark, MATRIX, "abcd", "xyz")
    with pytest.raises(K.CorpusError):
        K.convert(coo, obs.withColumn("total_counts", F.lit(1)), var, f"{base}/new")
    for bad in ({"no_count": True}, {"round_counts": True}, {"features": ("feature_id", "x")}):
        with pytest.raises(K.CorpusError):
            K.convert(coo, obs, var, f"{base}/new", **bad)
    assert not (base / "new").exists()


def test_view(two):
    _, a, b = two
    v = K.concat({"a": a, "b": b})
    assert [r["feature_id"] for r in v.vocabulary.select("feature_id", "global_id").distinct().orderBy("global_id").collect()] == ["g1", "g2", "g3", "g4"]
    measured = {(r["feature_id"], r["dataset_index"]): r["measured"] for r in v.feature_presence.collect()}
    assert [[measured[g, d] for d in (0, 1)] for g in ("g1", "g2", "g3", "g4")] == [[True, True], [True, False], [True, True], [False, True]]
    assert v.to_local_batch([6, 0, 7, 6])[3].tolist() == [6, 0, 7, 6]
    with pytest.raises(IndexError):
        v.read([8])
    with pytest.raises(FeatureError):
        v.export()
    inner = v.export(var_join="inner")
    assert [r["feature_id"] for r in inner["var"].collect()] == ["g1", "g3"]
    got = {(r["row"], r["gene"]): r["value"] for r in inner["X"].collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (2, 0): 3, (4, 1): 1, (6, 1): 3, (6, 0): 1}
    assert {r["dataset_id"] for r in v.obs.collect()} == {"a", "b"}
    with pytest.raises(TypeError):
        v.take_metadata([0], "cell_id")
    assert [r["cell_id"] for r in v.take_metadata([5, 0, 5], ["cell_id", "cell_id"]).orderBy("pos").collect()] == ["d2", "c1", "d2"]
    with pytest.raises(K.CorpusError):
        v.take_metadata([0], ["nothing"])


def test_dense(two):
    _, a, b = two
    out = K.concat({"a": a, "b": b}).dense_counts([4, 0], ["g3", "g2"]).orderBy("pos").collect()
    assert [(r["counts"], r["measured"]) for r in out] == [([1.0, 0.0], [True, False]), ([2.0, 0.0], [True, True])]


def test_annotation(spark, two):
    _, a, _ = two
    extra = spark.createDataFrame([(i, f"c{i + 1}", i / 2) for i in range(4)], "local_row_index long, cell_id string, score double")
    done = a.add_obs(extra)
    assert [r["score"] for r in done.members[0].obs.orderBy("local_row_index").collect()] == [0.0, 0.5, 1.0, 1.5]
    for bad in (extra.limit(3), extra.withColumn("cell_id", F.lit("x")), extra.withColumnRenamed("score", "total_counts"), extra.withColumnRenamed("score", "dataset_id")):
        with pytest.raises(K.CorpusError):
            a.add_obs(bad)
    done.save_obs("scores")
    assert "score" in K.open_corpus(spark, a.members[0].path, ex_obs="scores").members[0].obs.columns


def test_conflicts_and_mixed_types(spark, two, tmp_path):
    _, a, _ = two
    coo, obs, var = tables(spark, [[0.5, 0], [0, 1.25]], "xy", ["g1", "g9"])
    c = K.convert(coo, obs, var.withColumn("symbol", F.lit("other")), str(tmp_path / "c"), layer="norm", no_count=True)
    assert "total_counts" not in c.members[0].obs.columns
    a2 = K.Corpus(spark, [K.Member("a", a.members[0].expression, a.members[0].obs.drop("total_counts"), a.members[0].var.withColumn("symbol", F.lit("one")), 4, 3)])
    v = K.concat({"a": a2, "c": c})
    assert v.expression.schema["counts"].dataType.simpleString() == "array<double>"
    with pytest.raises(K.CorpusError):
        K.concat({"a": a2, "c": c}, var_columns=["symbol"])
    with pytest.raises(ValueError):
        K.concat({"a": a, "c": c})  # differing columns


def test_many_files(spark, tmp_path):
    cells = spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate([("a", 0), ("a", 3), ("b", 1), ("b", 2), ("a", 4), ("r", 2), ("r", 0)])], "local_row_index long, file_id string, local_row long")
    order = {"a": ["G1", "G2", "G3", "sgA", "sgB"], "b": ["G3", "G1", "G2", "sgB", "sgA"], "r": ["G2", "G3", "G1"]}
    feats = [(f, i, g, "Gene Expression" if g[0] == "G" else "CRISPR Guide Capture") for f, o in order.items() for i, g in enumerate(o)]
    features = spark.createDataFrame(feats, "file_id string, origin_index int, feature_id string, feature_type string")
    value = {f: [[(r * 7 + hash_(g)) % 4 for g in o] for r in range(5)] for f, o in order.items()}
    files = spark.createDataFrame([(f, r, j, float(v)) for f, m in value.items() for r, row in enumerate(m) for j, v in enumerate(row) if v], "file_id string, row long, gene int, value double")
    genes = spark.createDataFrame([(0, "G1"), (1, "G2"), (2, "G3")], "origin_index int, feature_id string")
    guides = spark.createDataFrame([(0, "sgA"), (1, "sgB")], "origin_index int, feature_id string")
    c = K.convert_files(files, cells, features, genes, str(tmp_path / "m"), guides)
    got = {(r["row"], r["gene"]): r["value"] for r in c.coo().collect()}
    want = {(i, j): value[x["file_id"]][x["local_row"]][order[x["file_id"]].index(g)] for i, x in enumerate(cells.orderBy("local_row_index").collect()) for j, g in enumerate(["G1", "G2", "G3"])}
    assert got == {k: v for k, v in want.items() if v}
    rows, names = c.read_extra("guides", [5, 0])
    assert names.count() == 2 and [r["genes"] for r in rows.collect()][0] is None
    with pytest.raises(FeatureError):
        K.convert_files(files, cells, features, genes.limit(2), str(tmp_path / "n"))


def test_ranges_are_not_listed_on_the_driver(spark):
    import tracemalloc

    for ids in (range(6, -1, -1), range(3, 20, 4), range(0), range(5, 5), range(2, -9, -3)):
        assert [tuple(r) for r in G.request(spark, ids).orderBy("pos").collect()] == list(enumerate(ids))
    tracemalloc.start()
    asked = G.request(spark, range(299_999, -1, -1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20 and tuple(asked.agg(F.min("id"), F.max("id"), F.count("pos"), F.min(F.col("pos") + F.col("id")), F.max(F.col("pos") + F.col("id"))).first()) == (0, 299_999, 300_000, 299_999, 299_999)


def hash_(g):
    return sum(map(ord, g))


def test_reorder(spark, tmp_path):
    t = spark.range(60).select(F.col("id").alias("global_row_index"), (F.col("id") * 3).alias("v"))
    order = spark.createDataFrame([(r, i) for i, r in enumerate(range(59, 28, -1))], "row long, new_row long")
    out = write_reordered(t, order, str(tmp_path / "r"), 3).orderBy("global_row_index").collect()
    assert [(r["global_row_index"], r["source_row"], r["v"]) for r in out] == [(i, r, 3 * r) for i, r in enumerate(range(59, 28, -1))]


def test_index(tmp_path):
    root = str(tmp_path)
    for d, n in (("a", 1000), ("b", 500), ("c", 750)):
        M.register(root, d, n)
    last = M.register(root, "d", 200)
    assert (last["global_start"], last["global_end"]) == (2250, 2450)
    with pytest.raises(M.ManageError):
        M.register(root, "a", 1)
    with pytest.raises(M.ManageError):
        M.register(root, "e", 1, topology="aggregate")


def test_materialize_compose_gc(spark, tmp_path):
    root = str(tmp_path / "r")
    for d in ("one", "two"):
        coo, obs, var = tables(spark, MATRIX, "abcd", ["g1", "g2", "g3"])
        M.materialize_dataset(root, d, coo, obs.drop("dataset_id"), var, {"readiness": "pass", "count_source": ".X"})
    with pytest.raises(M.ManageError):
        M.materialize_dataset(root, "three", coo, obs, var, {"readiness": "fail"})
    assert M.validate(root) == [] and len(M.validate(root, strict=True)) == 2
    (tmp_path / "r" / "stray" / "meta").mkdir(parents=True)
    assert M.collect_garbage(root) == [f"{root}/stray"] and M.collect_garbage(root, False) and not (tmp_path / "r" / "stray").exists()
    out = M.compose(str(tmp_path / "s"), [(root, "two")])
    assert out["datasets"][0]["global_end"] == 4 and spark.read.parquet(f"{tmp_path}/s/two/matrix/two.parquet").count() == 4


def test_streaming(spark, tmp_path):
    from matrixlake.streaming.ingest import ingest

    for i in range(2):
        spark.createDataFrame([(2 * i, 0, 1.0), (2 * i + 1, 1, 2.0)], "row long, gene int, value double").write.parquet(f"{tmp_path}/land/p{i}")
    land = str(tmp_path / "flat")
    spark.read.parquet(f"{tmp_path}/land/p0", f"{tmp_path}/land/p1").write.parquet(land)
    ingest(spark, land, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_replaced_tables_and_saved_features(spark, two):
    _, a, b = two
    var = a.members[0].var.withColumn("highly_variable", F.col("origin_index") != 1)
    a.with_var(var).save_var()
    again = K.open_corpus(spark, a.members[0].path, ex_var="")
    assert [r["hvg_rank"] for r in again.hvg(1).orderBy("origin_index").collect()] == [1, 0, 2]
    with pytest.raises(K.CorpusError):
        a.with_var(var.limit(2)).save_var()
    v = K.concat({"a": a, "b": b}, var={"a": var}, obs={"b": b.members[0].obs})
    assert v.global_vocab_size == 4 and v.max_local_vocab == 3 and v.to_local_feature_ids() == ["g1", "g2", "g3", "g4"]
    with pytest.raises(K.CorpusError):
        K.concat({"a": a}, obs={"z": a.members[0].obs})
    with pytest.raises(K.CorpusError):
        K.concat({"a": a}, obs={"a": a.members[0].obs.limit(1)})
    taken = v.take_metadata([5, 0, 5], ["cell_id"])
    assert [r["cell_id"] for r in K.unique_names(taken).orderBy("pos").collect()] == ["d2", "c1", "d2-1"]


def test_staging(spark, tmp_path):
    from matrixlake.sources.staging import estimate, held, stage, staged

    source = tmp_path / "t.parquet"
    spark.range(1000).write.parquet(str(source))
    with staged(str(source), str(tmp_path / "fast")) as path:
        assert estimate(path) == estimate(str(source)) and spark.read.parquet(path).count() == 1000
        with pytest.raises(FileExistsError):
            stage(str(source), str(tmp_path / "fast"))
    assert not (tmp_path / "fast" / "t.parquet").exists()
    with held(spark.range(5)) as df:
        assert df.count() == 5


def test_command_line(spark, tmp_path):
    from matrixlake.cli import main

    coo, obs, var = tables(spark, MATRIX, "abcd", ["g1", "g2", "g3"])
    for name, df in (("matrix", coo), ("obs", obs.drop("dataset_id")), ("var", var)):
        df.write.parquet(f"{tmp_path}/src/{name}.parquet")
    assert main(["convert", "--source", f"{tmp_path}/src", "--output", f"{tmp_path}/c"]) == 0
    assert main(["inspect", "--source", f"{tmp_path}/src", "--dataset-id", "d", "--output", f"{tmp_path}/i"]) == 0
    put = ["materialize", "--corpus", f"{tmp_path}/r", "--source", f"{tmp_path}/src", "--dataset-id", "d", "--inspection-summary", f"{tmp_path}/i/d/dataset-summary.yaml"]
    assert main([*put, "--dry-run"]) == 0 and not (tmp_path / "r").exists()
    assert main(put) == 0 and main(["corpus-validate", "--corpus", f"{tmp_path}/r"]) == 0
    assert main(["draft-schema", "--dataset-id", "d", "--obs", f"{tmp_path}/src/obs.parquet", "--var", f"{tmp_path}/src/var.parquet", "--output", f"{tmp_path}/s.yaml"]) == 0
    assert main(["canonicalize", "--corpus", f"{tmp_path}/r", "--dataset-id", "d", "--schema", f"{tmp_path}/s.yaml"]) == 0
    assert main(["corpus-validate", "--corpus", f"{tmp_path}/r", "--strict"]) == 0
    assert main(["corpus-compose", "--output", f"{tmp_path}/z", "--pick", f"{tmp_path}/r:d"]) == 0 and main(["corpus-gc", "--corpus", f"{tmp_path}/r", "--dry-run"]) == 0
    with pytest.raises(SystemExit):
        main(["inspect", "--output", "x"])
