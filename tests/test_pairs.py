import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matrixlake.operators import groups as P
from matrixlake.operators import sampling as S

src, tgt = P.src, P.tgt


def table(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row long, {schema}")


@pytest.fixture(scope="module")
def lines(spark):
    kinds = [("K562", "ctrl")] * 3 + [("K562", "KLF1")] * 3 + [("K562", "GATA1")] * 3 + [("RPE1", "ctrl")] * 3 + [("RPE1", "KLF1")] * 3
    return P.make_groups(table(spark, kinds, "cell_line string, perturbation string"), ["cell_line", "perturbation"])


def controls(g):
    return P.cross(g, on=["cell_line"], source="perturbation = 'ctrl'", target="perturbation <> 'ctrl'")


def test_pairs_in_development(spark):
    rows = [("ctrl", -1, None)] * 40 + [("ctrl", t, None) for t in (3, 7, 10) for _ in range(20)] + [(f"P{p}", t, d) for p in range(10) for t in (3, 7, 10) for d in (1.0, 10.0) for _ in range(10)]
    g = P.make_groups(table(spark, rows, "perturbation string, time int, dose double"), ["perturbation", "time", "dose"])
    assert g.table.count() == 64
    is_ctrl = "perturbation = 'ctrl'"
    assert P.cross(g, source=f"{is_ctrl} and time = -1", target="time > 0").count() == 63
    assert P.cross(g, on=["time"], source=is_ctrl, target=f"not ({is_ctrl})").count() == 60
    assert P.cross(g, on=["perturbation"], source="dose = 1.0", target="dose = 10.0", where=src.time == tgt.time).count() == 30


def test_on(lines):
    got = {(r["source_cell_line"], r["target_perturbation"]) for r in controls(lines).collect()}
    assert got == {("K562", "GATA1"), ("K562", "KLF1"), ("RPE1", "KLF1")}


def test_nulls_and_nan_are_groups(spark):
    g = P.make_groups(spark.createDataFrame([(0, None), (1, float("nan")), (2, 1.0)], "row long, x double"), ["x"])
    assert sorted(r["n_cells"] for r in g.table.collect()) == [1, 2] and g.rows.count() == 3


def test_fallback(spark):
    g = P.make_groups(table(spark, [("D1", "T", "ctrl"), ("D1", "T", "KLF1"), ("D2", "T", "KLF1")], "donor string, tissue string, p string"), ["donor", "tissue", "p"])
    strict = P.cross(g, on=["donor", "tissue"], source="p = 'ctrl'", target="p <> 'ctrl'").withColumn("rule", F.lit("same_donor"))
    other = P.cross(g, on=["tissue"], source="p = 'ctrl'", target="p <> 'ctrl'").join(strict.select("target_group"), "target_group", "left_anti").withColumn("rule", F.lit("fallback"))
    got = {(r["target_donor"], r["rule"]) for r in P.combine(strict, other).collect()}
    assert got == {("D1", "same_donor"), ("D2", "fallback")}


def test_top_k(spark):
    plan = [[5, 1, 0.5], [4, 2, 0.1], [3, 2.5, 0.2], [6, 0.3, 0.4]]
    links = spark.createDataFrame([("p", i, 4 + j, float(w)) for i, r in enumerate(plan) for j, w in enumerate(r)], "pair string, source_row long, target_row long, weight double")
    got = {(r["source_row"], r["target_row"]): r["weight"] for r in P.heaviest(links, 1).collect()}
    assert got == {(0, 4): 5, (1, 4): 4, (2, 4): 3, (3, 4): 6, (2, 5): 2.5, (0, 6): 0.5}


def test_weight_zero_is_never_drawn(spark, lines):
    pairs = controls(lines).withColumn("w", F.when(F.col("target_perturbation") == "GATA1", 0).otherwise(1))
    s = S.Sampler(lines, pairs, weight="w")
    drawn = s.draw_bundles(spark.range(300).select(F.col("id").cast("string").alias("sample")))
    names = {r["target_perturbation"] for r in drawn.join(s.pairs, "bundle").collect()}
    assert drawn.count() == 300 and names == {"KLF1"}


def test_epoch_covers_each_cell_once(lines):
    pairs = controls(lines)
    got = S.Sampler(lines, pairs).epoch_rows(3, 5, cover="target").collect()
    assert Counter(r["target_row"] for r in got) == Counter([3, 4, 5, 6, 7, 8, 12, 13, 14])
    again = S.Sampler(lines, pairs).epoch_rows(3, 5, cover="target").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_linked_partners(spark, lines):
    pairs = controls(lines)
    links = spark.createDataFrame([(0, 3, 0.7), (0, 4, 0.3), (1, 5, 1.0)], "source_row long, target_row long, weight double")
    got = S.Sampler(lines, pairs.where("target_perturbation = 'KLF1'"), links="table", link_table=links).epoch_rows(0, 1).collect()
    assert {r["source_row"] for r in got} == {0, 1} and all((r["source_row"], r["target_row"]) in {(0, 3), (0, 4), (1, 5)} for r in got)
    with pytest.raises(ValueError):
        S.Sampler(lines, pairs, links="self")
    with pytest.raises(ValueError):
        S.Sampler(lines, pairs, links="table")


def test_small_groups(spark):
    g = P.make_groups(table(spark, [("c",)] * 10 + [("A",)] * 10 + [("B",)] * 2, "p string"), ["p"])
    pairs = P.cross(g, source="p = 'c'", target="p <> 'c'")
    assert P.drop_small(pairs, 5, 5).count() == 1 and P.drop_small(pairs, 5, "all").count() == 2
    s = S.Sampler(g, pairs, n_source=5)
    sizes = s.sample(spark.range(30).select(F.col("id").cast("string").alias("sample"))).where("side = 'target'").groupBy("sample").count()
    assert {r["count"] for r in sizes.collect()} == {2, 5}


def test_chunks(spark):
    g = P.make_groups(table(spark, [("c",)] * 10, "p string"), ["p"])
    sizes = lambda **k: sorted(r["count"] for r in S.epoch_chunks(g, g.table.select("group"), 4, **k).groupBy("chunk").count().collect())
    assert sizes() == [2, 4, 4] and sizes(drop_last=True) == [4, 4]


def test_batches(spark):
    g = P.make_groups(table(spark, [("c",)] * 7 + [("A",)] * 5, "p string"), ["p"])
    size = lambda df: sorted(r["count"] for r in df.groupBy("batch").count().collect())
    assert size(S.cell_batches(g, 5)) == [2, 5, 5]
    assert size(S.cell_batches(g, 3, same_group=True)) == [1, 2, 3, 3, 3]
    one, two = (sorted((r["batch"], r["ord"], r["row"]) for r in S.cell_batches(g, 5, epoch=e).collect()) for e in (0, 1))
    assert one != two


def test_runs_are_neighbours(spark):
    g = P.make_groups(table(spark, [("c",)] * 23 + [("A",)] * 24, "p string"), ["p"])
    s = S.Sampler(g, P.cross(g, source="p = 'c'", target="p = 'A'"), n_source=6, run_length=4)
    out = s.sample(spark.range(40).select(F.col("id").cast("string").alias("sample"))).where("side = 'target'").collect()
    by = {}
    for r in out:
        by.setdefault(r["sample"], []).append((r["ord"], r["row"]))
    for rows in by.values():
        rows = [r - 23 for _, r in sorted(rows)]
        breaks = sum((b - a) % 24 != 1 for a, b in zip(rows, rows[1:], strict=False))
        assert len(set(rows)) == 6 and breaks <= 1


def test_write_order(spark):
    rows = [(p, lane) for p in ("B", "A", None) for _ in range(50) for lane in (1, 2)]
    g = P.make_groups(table(spark, rows, "p string, lane int"), ["p", "lane"])
    order, blocks = P.write_order(g, 4)
    got = [(r["p"], r["lane"], r["start"], r["stop"]) for r in blocks.orderBy("start").collect()]
    assert got == [(p, lane, i * 50, i * 50 + 50) for i, (p, lane) in enumerate((p, x) for p in (None, "A", "B") for x in (1, 2))]
    assert sorted(r["new_row"] for r in order.collect()) == list(range(300))


def test_ranks_over_many_slots(spark, monkeypatch):
    """A group that spans many slots has the ranks that one sort of it gives."""
    monkeypatch.setattr(P, "SLOT_BITS", 3)
    monkeypatch.setattr(P, "SLOT_DIGITS", 1)
    rows = [(r, "hot" if r % 3 else "rare") for r in range(-5, 300)]
    g = P.make_groups(spark.createDataFrame(rows, "row long, kind string"), "kind")
    name = {r["group"]: r["kind"] for r in g.table.collect()}
    want = {(r, rank) for kind in ("hot", "rare") for rank, r in enumerate(sorted(r for r, k in rows if k == kind))}
    assert {(r["row"], r["k"]) for r in g.members().collect()} == want
    draw = lambda r: (hashlib.md5(f"4:{r}".encode()).hexdigest(), r)
    shuffle = {(kind, r): rank for kind in ("hot", "rare") for rank, r in enumerate(sorted((r for r, k in rows if k == kind), key=draw))}
    start = {"hot": 0, "rare": sum(k == "hot" for _, k in rows)}
    order, _ = P.write_order(g, 4)
    got = {(name[r["group"]], r["row"]): r["new_row"] - start[name[r["group"]]] for r in order.collect()}
    assert got == shuffle


@pytest.mark.parametrize(("block", "scale", "odd"), [(8192, 1, [(4, None), (2, [1, 2**40, -3])]), (3, 10**6, [])])
def test_links_by_dot_are_those_of_all_candidates(spark, monkeypatch, block, scale, odd):
    """Ties, copies, a group with itself, one direction only; sums in 24 and in 53 bits; and odd vectors, which go the plain way."""
    monkeypatch.setattr(P, "BLOCK", block)
    g = P.make_groups(table(spark, [("abcd"[i % 7 % 4],) for i in range(37)] + [("e",)], "kind string"), ["kind"])
    both = P.cross(g, source="kind in ('a', 'b', 'e')")
    vectors = [(i, [scale * ((i * 7 + j * 3) % 5 - 2) for j in range(3)]) for i in range(38)]
    for change in ({}, *({i: v} for i, v in odd)):
        rows = [(i, change.get(i, v)) for i, v in vectors]
        features = spark.createDataFrame(rows, "row long, feature array<long>")
        for pairs, k in ((both, 2), (both.where("source_group < target_group"), 1)):
            want = P.links_by_expression(g, pairs, features, P.dot, k).select("pair", "source_row", "target_row", "weight")
            got = P.links_by_dot(g, pairs, features, k)
            assert got.dtypes == want.dtypes
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
