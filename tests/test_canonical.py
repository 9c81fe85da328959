import warnings

import pytest

from matrixlake.functions import text as X
from matrixlake.plans import canonical as H
from matrixlake.plans import drafting as D
from matrixlake.plans import inspection as I
from matrixlake.queries.canonical import SCHEMA
from matrixlake.sources import tables as T

CASES = [
    (X.strip_suffix, {"suffix": "_sg1"}, {"CTRL_sg1": "CTRL", "CTRL": "CTRL"}),
    (X.strip_prefix, {"prefix": "prefix_"}, {"prefix_GENE": "GENE"}),
    (X.regex_sub, {"pattern": r"_v\d+", "replacement": ""}, {"GENE_v1": "GENE"}),
    (X.map_control_labels, {"candidates": ["ctrl", "ntc", "non-targeting"]}, {" Non-Targeting ": "ctrl", "TP53": "TP53"}),
    (X.strip_guide_suffix, {}, {"NTC_sg1": "NTC", "X__2": "X", "KRAS-g3": "KRAS"}),
    (X.dose_parse, {}, {"100nM": "100", "50 nM": "50", "10 μM": "10", "5 μg/kg": "5", "42": "42", "unknown": "NA", "": "NA", "1.5uM": "1.5", "1e5": "1e5", "5d": "5"}),
    (X.dose_unit, {}, {"100nM": "nm", "1.5uM": "um", "10 μM": "um", "10mg/kg": "mg/kg", "unknown": "NA"}),
    (X.normalize_dose_unit, {}, {"μM": "um", "": "NA", "furlong": "furlong"}),
    (X.timepoint_parse, {}, {"24h": "24", "48 hr": "48", "3 days": "3", "30m": "30", "72": "72", "unknown": "NA"}),
    (X.timepoint_unit, {}, {"48 hr": "h", "7d": "d", "15 min": "m"}),
    (X.normalize_time_unit, {}, {"Hours": "h"}),
    (X.split_on_delimiter, {"delimiter": "+", "part": 1}, {"TP53+MDM2": "MDM2", "TP53": "NA"}),
    (X.split_on_delimiter, {"delimiter": ",", "part": 1}, {"a,,c": "NA", "TP53 , MDM2": "MDM2"}),
    (X.split_on_delimiter, {"delimiter": "+", "part": -1}, {"a+b": "NA"}),
    (X.map_values, {"mapping": {"Homo sapiens": "human"}}, {"Homo sapiens": "human", "x": "x"}),
    (X.strip_ensembl_version, {}, {"ENSG00000141510.18": "ENSG00000141510", "AC1.2": "AC1.2"}),
    (X.normalize_boolean, {}, {"Yes": "true", " 0 ": "false", "FALSE": "false", "maybe": "maybe"}),
    (X.normalize_case, {"mode": "title"}, {"foo-bar baz": "Foo-Bar Baz"}),
    (X.replace_empty_with_null, {}, {"  ": "NA", " a ": " a "}),
    (X.strip_whitespace, {}, {"　a ": "a"}),
]


@pytest.mark.parametrize("f,args,want", CASES, ids=[f"{f.__name__}-{i}" for i, (f, _, _) in enumerate(CASES)])
def test_transform(spark, f, args, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r["v"]: r["o"] for r in df.select("v", f(F.col("v"), **args).alias("o")).collect()} == want


def test_chain(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("NA",), (" ",), ("x",), (None,)], "v string")
    one = lambda steps, fb="fb": [r[0] for r in df.select(X.chain(F.col("v"), steps, fb)).collect()]
    assert one([{"name": "strip_whitespace"}]) == ["fb", "fb", "x", "fb"]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert one([{"name": "nothing"}]) == ["fb", "fb", "x", "fb"]
    assert seen
    assert one([{"name": "strip_prefix", "args": {"bad": 1}}]) == ["fb"] * 4
    assert one([{"name": "normalize_case", "args": {"mode": "odd"}}]) == ["fb"] * 4


def test_schema_round_trip(tmp_path):
    s = H.Schema.from_dict(SCHEMA)
    s.write(tmp_path / "s.yaml")
    assert H.Schema.read(tmp_path / "s.yaml").to_dict() == s.to_dict()
    for bad in ({"kind": "x"}, {"dataset_id": ""}, {"obs_column_mappings": [{"canonical_name": "a", "strategy": "odd"}]}, {"obs_column_mappings": [{"canonical_name": "a", "strategy": None}] * 2}, {"obs_column_mappings": [{"canonical_name": "a", "strategy": "join"}]}):
        with pytest.raises(H.SchemaError):
            H.Schema.from_dict(SCHEMA | bad)


def test_missing_columns(spark):
    raw = spark.createDataFrame([(0, "a")], "local_row_index long, x string")
    with pytest.raises(H.SchemaError):
        H.compile_mapping(H.Mapping("o", "coalesce", source_columns=("y",)), raw.columns)
    with pytest.raises(H.SchemaError):
        H.canonical_obs(raw, H.Schema("d"))
    with pytest.warns(UserWarning):
        H.compile_mapping(H.Mapping("o", "source-field", source_column="y"), raw.columns)


def test_canonicalize(spark, tmp_path):
    from matrixlake.queries.canonical import _raw

    raw = _raw(spark, "/root/testdata/sf0.001").limit(20)
    T.sidecar(raw, ["cell_id", "dataset_id", "local_row_index"], "raw_fields").write.parquet(str(tmp_path / "o"))
    var = spark.createDataFrame([(0, "G1", "Brand#1"), (1, "G2", "x")], "origin_index int, feature_id string, brand string")
    T.sidecar(var, ["origin_index", "feature_id"], "raw_var").write.parquet(str(tmp_path / "v"))
    p = H.canonicalize(spark, str(tmp_path / "o"), str(tmp_path / "v"), H.Schema.from_dict(SCHEMA), str(tmp_path / "out"))
    assert spark.read.parquet(p["obs"]).count() == 20 and spark.read.parquet(p["var"]).columns[:4] == ["origin_index", "gene_id", "canonical_gene_id", "global_id"]
    assert T.read_yaml(p["vocab"])["obs"]["perturb_type"]


def test_gene_map_file(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# head\nA\tx\n\nB\ty\nA\tz\n")
    assert {r["gene"]: r["mapped"] for r in T.read_gene_map(spark, str(tmp_path / "m.tsv")).collect()} == {"A": "z", "B": "y"}
    (tmp_path / "bad.tsv").write_text("A\n")
    with pytest.raises(ValueError):
        T.read_gene_map(spark, str(tmp_path / "bad.tsv"))


def test_input_list(tmp_path):
    f = tmp_path / "l.csv"
    f.write_text("source, dataset_id ,inspection_summary\n a , b, c \n")
    assert T.read_input_list(str(f)) == [{"source": "a", "dataset_id": "b", "inspection_summary": "c"}]
    for bad in ("source,dataset_id\na,b\n", "source,dataset_id,inspection_summary\n", "source,dataset_id,inspection_summary\na,,c\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            T.read_input_list(str(f))


def test_drafting():
    columns = "guide_1 guide_2 genotype treatment cell_type cellline batch site donor_id passage doublet_score dataset_id cell_id".split()
    s = {m.canonical_name: m for m in D.draft("d", columns, ["feature_id"]).obs}
    got = {n: s[n].source_column for n in ("perturb_label", "cell_context", "condition", "perturb_type", "batch_id", "donor_id")}
    assert got == {"perturb_label": "guide_1", "cell_context": "cell_type", "condition": "genotype", "perturb_type": "treatment", "batch_id": "batch", "donor_id": "donor_id"}
    assert sum(m.strategy == "null" for m in D.draft("d", ["cell_id", "guide_1"], []).obs) >= 5
    assert D.find_column("perturb_label", ["x_guide_id"]) == "x_guide_id"
    aligned = {"perturbation": ["A", None, "B"], "target_gene": [None, "C", None]}
    s = {m.canonical_name: m for m in D.draft("d", list(aligned), [], aligned=aligned).obs}
    assert s["perturb_label"].strategy == "coalesce" and set(s["perturb_label"].source_columns) == set(aligned)
    assert D.gene_mapping_for(["ENSG01", "ENSMUSG2", "x"])["enabled"] and not D.gene_mapping_for(["TP53"])["enabled"]


def test_inspection(spark):
    obs = spark.createDataFrame([(0, "NTC", "yes"), (1, "STAT1", "no"), (2, "non-targeting", "yes")], "local_row_index long, perturbation string, is_control string")
    got = {r["column"]: (r["confidence"], r["labels"]) for r in I.control_candidates(obs).collect()}
    assert got == {"perturbation": ("high", ["NTC", "non-targeting"]), "is_control": ("high", ["yes"])}
    coo = lambda m: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v], "row long, gene int, value double")
    counts = [[1, 0, 3], [0, 2, 0], [4, 0, 1]]
    out = I.inspect(obs, {".X": (coo(counts), 3, 3), "lognorm": (coo([[0.5, 0, 1.1], [0, 0.3, 0], [2, 0, 0.7]]), 3, 3)}, "d")
    assert out["count_source"] == ".X" and out["readiness"] == "pass"
    assert I.control_candidates(spark.createDataFrame([(0, "a")], "local_row_index long, x string")).count() == 0
