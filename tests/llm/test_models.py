"""Byte model, language mixture, toxicity, chat snapshots, pipeline."""

import math
import os
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixlake.llm import chat_format, language_id, ppm, toxicity
from matrixlake.llm.common import bucket

SF = "/root/testdata/sf0.01"


def held_out(d, of, keep):
    return zlib.crc32(("" if d is None else str(d)).encode()) % of == keep


def brute_scores(rows, order):
    tokens = [(d, [*(t or "").encode().lower().split(), b"\n"]) for d, t in rows]
    words, runs = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    norm = lambda w: b"\xff" * order + b" ".join(w[:-1]) + b"\xff"
    for d, w in tokens:
        if not held_out(d, 10, 0):
            words.update(w)
            t = norm(w)
            for p in range(order, len(t)):
                for j in range(order + 1):
                    runs[j][t[p - j : p]][t[p]] += 1
    total, kinds = sum(words.values()), len(words)

    def price(ctx, s):
        out, gone = 0.0, set()
        for j in range(order, -1, -1):
            seen = runs[j].get(ctx[order - j :])
            left = {k: v for k, v in (seen or {}).items() if k not in gone}
            if not left:
                continue
            if s in left:
                return out + math.log10(left[s] / (sum(left.values()) + len(left)))
            out += math.log10(len(left) / (sum(left.values()) + len(left)))
            gone |= set(seen)
        return out - math.log10(256 - len(gone))

    out = []
    for d, w in tokens:
        t = norm(w)
        base = sum(math.log10((words[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        out.append((d, not held_out(d, 10, 0), len(w), sum(x in words for x in w), total, base, sum(price(t[p - order : p], t[p]) for p in range(order, len(t)))))
    return out


@pytest.mark.parametrize("options", [{}, {"block_runs": 300, "block_words": 0}, {"block_runs": 120}])
def test_ppm(spark, options):
    rows = [r for r in cases.texts() if len(r[1] or "") < 5000]
    got = ppm.ppm_score(cases.frame(spark, rows, clash=("n", "a", "key", "score")), bucket("doc_id", 10) != 0, **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, round(r[5], 6))
    want = sorted(brute_scores(rows, ppm.ORDER), key=key)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_ppm_without_rows(spark):
    assert ppm.ppm_score(cases.empty(spark), F.lit(True)).count() == 0
    got = ppm.ppm_score(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).first()
    assert got["train_tokens"] == 0 and got["score"] == pytest.approx(3 * math.log10(1 / 256)) and got["n_known"] == 0


def test_trie_gives_probabilities():
    rng = np.random.default_rng(1)
    data = [bytes(rng.integers(97, 102, 60).astype(np.uint8)) for _ in range(20)]
    codes, _ = ppm.runs(data, 3)
    letters = np.bincount((codes & np.uint64(255)).astype(int), minlength=256)
    trie = ppm.Trie(*ppm.tally(codes), letters, 3)
    for context in (b"abc", b"zzz", b"\xff\xff\xff", b"eea"):
        ctx = int.from_bytes(context, "big") << 8
        assert (10 ** trie.price(np.arange(256, dtype=np.uint64) | np.uint64(ctx))).sum() == pytest.approx(1)


def test_languages(spark):
    rows = [r for r in cases.texts()]
    lang = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")
    df = cases.frame(spark, rows, clash=("score", "lang_pred", "n")).withColumn("lang", lang)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language_id.identify(df, language_id.fit(df, bucket("doc_id", 4) != 2)).collect()}
    for d, t in rows:
        assert ((d, "und") in got) == (not t or not any(map(str.isalpha, t))) or d in (None, 18, 19)
    assert all(0 <= s <= 1 for s in got.values())
    assert language_id.identify(cases.empty(spark), language_id.fit(df, F.lit(True))).count() == 0
    none = language_id.fit(df, F.lit(False))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}


def test_mixture_of_two_languages(spark):
    a, b = "sol luna mar cielo tierra agua fuego".split(), "wald berg fluss stein himmel sturm".split()
    r = np.random.default_rng(0)
    say = lambda w, n: " ".join(r.choice(w, n))
    train = [(i, say(a, 50), "aa") for i in range(20)] + [(100 + i, say(b, 50), "bb") for i in range(20)]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), F.lit(True))
    test = spark.createDataFrame([(1, say(a, 75) + " " + say(b, 25)), (2, say(b, 40))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(test, model).collect()}
    assert got[1]["lang_pred"] == "aa" and got[1]["score"] == pytest.approx(0.75, abs=0.05) and len(got[1]["shares"]) == 2
    assert got[2]["lang_pred"] == "bb" and len(got[2]["shares"]) == 1


def test_mixtures_against_brute_force():
    """Sets of languages and shares, one document at a time, by plain loops; six languages in equal parts are all found."""
    r = np.random.default_rng(5)
    langs, n = 7, np.array([1, 3, 40, 200, 600, 5])
    p = np.exp(-r.gamma(2.0, 2.0, (int(n.sum()), langs))).astype(np.float32)
    p[244:844] = 1e-4
    p[np.arange(244, 844), np.arange(600) % 6] = 1
    got = language_id.infer(p.copy(), n)

    def fit(q, share, rounds):
        for _ in range(rounds):
            w = q * share
            share = (w / w.sum(1, keepdims=True)).mean(0)
        return share, float(np.log((q * share).sum(1)).sum())

    for d, (lo, m) in enumerate(zip(np.cumsum(n) - n, n, strict=True)):
        q = p[lo : lo + m].astype(float)
        full, _ = fit(q, np.full(langs, 1 / langs), language_id.ROUNDS)
        order, best, top, waited = np.argsort(-full, kind="stable"), None, -np.inf, 0
        for k in range(1, langs + 1):
            share = np.zeros(langs)
            share[order[:k]] = np.maximum(full[order[:k]], 1e-3)
            share, value = fit(q, share / share.sum(), 0 if k == 1 else language_id.ROUNDS // 2)
            value -= 0.5 * (k - 1) * np.log(max(m, 2))
            best, top, waited = (share, value, 0) if value > top else (best, top, waited + 1)
            if waited == language_id.PATIENCE:
                break
        assert got[d] == pytest.approx(best, abs=2e-3)
    assert (got[4] > 0).sum() == 6 and got[4][:6] == pytest.approx(np.full(6, 1 / 6), abs=0.01)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got >= 0.98


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.query(spark, sf).join(labels, "doc_id").where("held_out").agg(F.sum(F.expr("predicted * toxic")), F.sum("predicted"), F.sum("toxic"), F.max("score"), F.min("score")).first()
    assert r[0] / r[1] >= 0.95 and r[0] / r[2] >= 0.85 and 0 <= r[4] <= r[3] <= 1


def test_toxicity_edges(spark):
    df = cases.frame(spark, clash=("score", "toxic", "_id"))
    labels = spark.createDataFrame([(5, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, F.lit(True))
    assert {r["_s"] for r in toxicity.score(df, model, out_col="_s").collect()} == {0.0}
    words = [(i, "you are a vile1 person" if i % 3 == 0 else "a kind person writes words") for i in range(300)]
    docs = spark.createDataFrame(words, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(df.unionByName(docs.select("doc_id", "text"), allowMissingColumns=True), model, out_col="_s")
    assert got.count() == len(cases.texts()) + 300 and got.where("text like '%vile1%' and _s < 0.7 or text like '%kind person%' and _s >= 0.7").isEmpty()
    assert toxicity.score(cases.empty(spark), model).count() == 0


def test_features_against_loops():
    """The features of cases, by plain loops over words."""
    lexicon = {b"vile": 3.0, b"bad*": 1.5, b"idio*": 2.75}
    texts = ["You are VILE, you badly-made thing!!", "v1le talk? no", "calm words 123", "", None, "IDIOT", "nothing here then after a very long while of words vile", "ihr seid 1d1ots"]
    names = toxicity.FEATURES
    for t, row in zip(texts, toxicity.features([x.encode() if x is not None else None for x in texts], toxicity.Words(lexicon)), strict=True):
        x = dict(zip(names, row.tolist(), strict=True))
        words = (t or "").split()
        weights, second = [], []
        for w in words:
            w = w.strip(".,!?;:\"'()[]{}<>*#%&$|-_=/~`").lower()
            plain = "".join(c for c in w if c not in "-._*").translate(str.maketrans("0134578@$!|+", "oieastbasiit"))
            options = [w] if w.isdigit() else [w, plain]
            weights.append(max((lexicon.get(k.encode(), 0.0) for o in options for k in [o, *(o[:i] + "*" for i in range(4, min(10, len(o) + 1)))]), default=0.0))
            second.append(w in toxicity.SECOND)
        n, strong = max(1, len(words)), [i for i, v in enumerate(weights) if v >= toxicity.STRONG]
        gaps = [min((abs(i - j) for j, s in enumerate(second) if s), default=None) for i in strong]
        assert x["words"] == pytest.approx(math.log1p(len(words))) and x["hits"] == sum(v > 0 for v in weights) and x["weight_max"] == max(weights, default=0)
        assert x["weight_rate"] == pytest.approx(sum(weights) / n) and x["strong"] == len(strong) and x["second_rate"] == pytest.approx(sum(second) / n)
        assert x["near_second"] == sum(g is not None and g <= toxicity.NEAR for g in gaps) and x["nearest"] == pytest.approx(max((1 / (1 + g) for g in gaps if g is not None), default=0))
        letters = [c for c in (t or "") if c.isalpha()]
        assert x["capital_rate"] == pytest.approx(sum(c.isupper() for c in letters) / max(1, len(letters))) and x["exclaim_rate"] == pytest.approx((t or "").count("!") / max(1, len(t or "")))


def test_one_tree_against_all_splits():
    """The first split of a tree is the best of all, by trying each; its leaves are Newton steps."""
    r = np.random.default_rng(4)
    x = r.integers(0, 6, (300, 3)).astype(float)
    y = ((x[:, 1] > 3) ^ (r.random(300) < 0.1)).astype(float)
    model = toxicity.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    gain = lambda m: sum(g[k].sum() ** 2 / (h[k].sum() + 1) for k in (m, ~m))
    best = max(((gain(x[:, j] > c), j, c) for j in range(3) for c in range(5)), key=lambda b: b[0])
    feature, cut, value = model.trees[0]
    assert feature[0] == best[1] == 1 and np.array_equal(x[:, 1] > cut[0], x[:, 1] > best[2])
    right = x[:, 1] > cut[0]
    assert value == pytest.approx([-g[k].sum() / (h[k].sum() + 1) * model.rate for k in (~right, right)])


def test_isotonic_is_the_least_squares_fit():
    r = np.random.default_rng(9)
    s, y = np.arange(40.0), (r.random(40) < np.linspace(0.1, 0.9, 40)).astype(float)
    at, level = toxicity.isotonic(s, y)
    # minimax formula of monotone regression
    want = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    steps = sorted(set(np.round(want, 9).tolist()))
    assert np.round(level, 9).tolist() == steps and (np.diff(at) > 0).all()


def test_training_takes_one_row_an_id(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 50} is {'vile' if i % 50 < 20 else 'kind'}") for i in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(50)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert 0 < model.share < 1
    long = spark.createDataFrame([(1, "kind words " * 50_000), (2, None)], "doc_id long, text string")
    assert toxicity.score(long, model).where("score between 0 and 1").count() == 2


def test_isotonic_rises():
    r = np.random.default_rng(2)
    s = r.normal(size=500)
    x, y = toxicity.isotonic(s, (r.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and 0 <= y[0] and y[-1] <= 1


def snapshots():
    chat = lambda c, n, tail="": [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" + (tail if t == n - 1 else "")) for t in range(n)]
    rows = chat(1, 2) + chat(2, 4) + chat(3, 6) + chat(4, 6) + chat(5, 4, " other") + chat(6, 1) + chat(7, 700) + chat(8, 300)
    return rows + [(9, None, None, None), (9, 0, "user", ""), (None, 0, "user", "nobody"), (10, 0, "user", "x"), (10, 0, "user", "x"), (11, 0, "user", "x")]


@pytest.mark.parametrize("part", [256, 2])
def test_snapshots(spark, part):
    rows = snapshots()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or "", role, text))
    full = {c: [x[4:] for x in sorted(v)] for c, v in by.items()}
    keep = {}
    for c, v in full.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in full.values())
        same = [x for x, w in full.items() if w == v]
        if not longer and (None in same or c == min(same)):
            keep[c] = (len(v), len(same), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in v))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("k", "part", "h", "n", "pos")})
    parts = defaultdict(dict)
    for r in chat_format.render_conversations(df, part).collect():
        parts[r["conv_id"]][r["part"]] = (r["rendered"], r["n_turns"], r["n_logged"])
    got = {c: (next(iter(p.values()))[1], next(iter(p.values()))[2], "".join(p[k][0] for k in sorted(p))) for c, p in parts.items()}
    assert got == keep and set(got) == {7, 5, 9, None, 10}
    assert all(len(p) == -(-keep[c][0] // part) and sorted(p) == list(range(len(p))) for c, p in parts.items())
    assert chat_format.render_conversations(df.where("false")).count() == 0


def test_many_turns_of_one_number(spark):
    """Rows without id, turn numbers that repeat and rows that are equal come in parts of bounded size."""
    rows = [(None, None, "user", f"t{i % 900}") for i in range(3000)] + [(1, 0, "user", "same")] * 1000 + [(2, i * 10**9, "user", f"turn {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = chat_format.render_conversations(df).collect()
    assert all(r["part_turns"] <= 256 for r in got)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["part"]):
        by[r["conv_id"]].append(r["rendered"])
    line = "<|im_start|>user\n{}<|im_end|>\n"
    assert "".join(by[1]) == line.format("same") * 1000 and "".join(by[2]) == "".join(line.format(f"turn {i}") for i in range(700))
    assert Counter("".join(by[None]).split("<|im_end|>\n")[:-1]) == Counter({f"<|im_start|>user\nt{i}": 3 + (i < 300) for i in range(900)})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    """Each stage keeps what its operator keeps, and nothing clean is lost."""
    import corpus_pipeline as P

    from matrixlake.llm import decontamination, near_dedup, packing, pii
    from matrixlake.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        seen[name], docs = (docs, out), out
    before, after = seen["near_dedup"]
    kept = {r[0] for r in near_dedup.near_duplicates(before, 5).where("kept").collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(kept)
    before, after = seen["decontamination"]
    found = decontamination.judge(decontamination.find_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in found.where("not contaminated").select("doc_id").collect()}
    before, after = seen["pii"]
    assert before.count() == after.count() and pii.find_personal_data(after).where("size(base) > 0").isEmpty()
    assert after.where("n_chars <> length(text)").isEmpty()
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert pieces.agg(F.sum(F.expr("octet_length(ids) div 4"))).first()[0] == packing.pack(docs).select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
