"""Packing, decontamination, near-duplicates, substrings, personal data: against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixlake.llm import common, decontamination, graph, near_dedup, packing, pii, substring_dedup


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# packing


def encoded(text):
    tok = packing.encoder(packing.default_tokenizer(), 2).tokenizer
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def check_pieces(pieces, rows, size):
    """Every id in exactly one piece, sequences gapless; returns ids of padding."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        by_seq[p["sequence_id"]].append((p["offset"], len(ids)))
        by_doc[p["doc_id"]].append((p["start"], p["doc_tokens"], ids))
    pad = 0
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    want = Counter((d, tuple(encoded(t))) for d, t in rows)
    for d, parts in by_doc.items():
        docs = [list(k[1]) for k, n in want.items() if k[0] == d for _ in range(n)]
        assert Counter(i for _, _, ids in parts for i in ids) == Counter(i for t in docs for i in t)
        for start, total, ids in parts:
            assert any(len(t) == total and t[start : start + len(ids)] == ids for t in docs)
    assert set(by_doc) == {d for d, _ in rows}
    return pad


@pytest.mark.parametrize("size,block", [(4096, 1 << 20), (64, 500)])
def test_packing(spark, size, block):
    df = cases.frame(spark, clash=("ids", "offset", "start"))
    pieces = packing.pack(df, size=size, block_tokens=block).collect()
    total = sum(len(encoded(t)) for _, t in cases.texts())
    assert check_pieces(pieces, cases.texts(), size) <= 0.25 * total
    assert packing.pack(cases.empty(spark)).count() == 0


def test_best_cuts_are_optimal():
    """Against all choices of cuts, by plain dynamic programming over pairs."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        size, total = 16, int(rng.integers(20, 90))
        marks = np.unique(np.r_[0, np.sort(rng.choice(np.arange(1, total + 1), 25)), np.arange(0, total, 8), total])
        penalty = rng.integers(0, 9, len(marks))
        cuts = packing.best_cuts(marks, penalty, total, size)
        at = marks.tolist()
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + size - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= size)
        got, before = 0, 0
        for c in cuts:
            assert c - before <= size
            got += size - (c - before) + penalty[at.index(c)]
            before = c
        assert total - before <= size
        assert got == min(best[j] for j in range(len(at)) if total - at[j] <= size)


def test_encoder_is_exact():
    import random

    r, enc = random.Random(2), packing.encoder(packing.default_tokenizer(), 2)
    letters = "abzABZ09 '.,!?|éÉİıΣςßÜñ́  　\t\n<>|endoftext日本🎉\x00\x1c'sre. , "
    found = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    ids, n = enc.encode([t.encode() for t in found])
    assert ids.tolist() == [i for t in found for i in encoded(t)] and n.tolist() == [len(encoded(t)) for t in found]


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows[tuple(w[k : k + 13])].add(i)
    out = Counter()
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[d, len(w), len(hit), ",".join(sorted(map(str, found)))] += 1
    return out


ITEMS = [(1, cases.PASSAGE), (2, "Two, WORDS!"), (3, None), (4, ""), (5, "one"), (6, cases.PASSAGE + " and more of it here to be seen by all"), (1, "3 14"), (None, "one"), (7, " ".join(cases.PASSAGE.split()[5:25]))]


@pytest.mark.parametrize("broadcast", [decontamination.BROADCAST_BYTES, -1])
def test_decontamination(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", broadcast)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = cases.frame(spark, clash=("items", "hits", "n_words", "k", "_mark", "mark", "doc"))
    found = decontamination.judge(decontamination.find_contamination(df, bench))
    got = rows_of(found.withColumn("listed", F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))), "doc_id", "n_words", "n_hit", "listed")
    assert got == contaminated(cases.texts(), ITEMS)
    assert found.where("contaminated <> (n_hit > 0 and 20 * n_hit >= n_words)").isEmpty()
    assert found.where("n_hit <> aggregate(hits, 0L, (s, x) -> s + x.end - x.start)").isEmpty()
    left = decontamination.drop_contaminated(df, bench)
    assert left.columns == df.columns and left.where("_mark <> 'extra _mark' or mark <> 'extra mark' or doc <> 'extra doc'").isEmpty()
    assert rows_of(left, "doc_id") == rows_of(found.where("not contaminated"), "doc_id")


def test_decontamination_by_a_very_long_item(spark, monkeypatch):
    """An item of 200,000 distinct words, in many parts, and a document that holds a stretch across two of them."""
    monkeypatch.setattr(decontamination, "PART", 7000)
    w = [f"w{i}x" for i in range(200_000)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[50:80]))], "item_id long, text string")
    rows = [(1, "before " + " ".join(w[6990:7020]) + " after"), (2, " ".join(w[55:75])), (3, " ".join(w[100_000:100_012])), (4, None), (5, " ".join(w[40_000:160_000]))]
    found = decontamination.find_contamination(cases.frame(spark, rows), bench)
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in found.collect()} == {1: (30, [1]), 2: (20, [1, 2]), 3: (0, []), 4: (0, []), 5: (120_000, [1])}


def test_decontamination_without_rows(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_contamination(cases.empty(spark), bench).count() == 0
    clean = decontamination.judge(decontamination.find_contamination(cases.frame(spark), bench.where("false")))
    assert clean.where("contaminated or n_hit > 0 or n_items > 0").isEmpty() and clean.count() == len(cases.texts())


def test_decontamination_creates_no_file_for_each_part_of_the_documents(spark, monkeypatch, tmp_path):
    """Each file that an executor creates may start a process, which for a moment counts with all of the executor's memory."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(i, f"{i} {cases.PASSAGE}" if i % 5 == 0 else f"one {i}") for i in range(400)]
    found = decontamination.judge(decontamination.find_contamination(cases.frame(spark, rows).repartition(40), bench))
    got = rows_of(found.withColumn("listed", F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))), "doc_id", "n_words", "n_hit", "listed")
    assert got == contaminated(rows, ITEMS)
    assert max(len(list(t.glob("part-*"))) for t in tmp_path.iterdir()) < 40
    assert found.rdd.getNumPartitions() < 40


# near-duplicates


def components(rows, k, percent=80):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return Counter((d, len(s), None if d is None else top(d), d is None or top(d) == d) for d, s in sets)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    got = rows_of(near_dedup.near_duplicates(cases.frame(spark, clash=cases.CLASH), k), "doc_id", "n_shingles", "component_id", "kept")
    assert got == components(cases.texts(), k)
    assert near_dedup.near_duplicates(cases.empty(spark), k).count() == 0


def test_chains_and_mixed_buckets(spark):
    """A group of near copies whose pairs lie on both sides of the threshold."""
    import random

    r = random.Random(8)
    base = [r.choice(cases.WORDS) + str(i) for i in range(100)]
    rows = []
    for d in range(250):
        w = list(base)
        for i in r.sample(range(100), r.randint(0, 9)):
            w[i] = f"edit{d}_{i}"
        rows.append((d, " ".join(w)))
    for d in range(250, 300):  # each is near the one before it
        prev = rows[-1][1].split()
        prev[r.randrange(len(prev))] = f"step{d}"
        rows.append((d, " ".join(prev)))
    r.shuffle(rows)
    got = rows_of(near_dedup.near_duplicates(cases.frame(spark, rows), 4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == components(rows, 4)


@pytest.mark.parametrize("work", [near_dedup.near_duplicates, substring_dedup.substring_dedup])
def test_ids_must_be_integers(spark, work):
    with pytest.raises(TypeError, match="integers"):
        work(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 2000
        both = int(2 * n * share / (1 + share))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.r_[a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)]
        low = near_dedup.minima(np.r_[a, b], np.array([n, n]))
        x, y = near_dedup.packed(low).view(np.uint64)
        bad = sum(bin(int(((p ^ q) | ((p ^ q) >> np.uint64(1))) & np.uint64(0x5555555555555555))).count("1") for p, q in zip(x, y, strict=True))
        assert abs(((1 - bad / near_dedup.PERMS) - 0.25) / 0.75 - share) < 0.16


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (3, 2), (20, 21)] + [(100, 101 + i) for i in range(50)] + [(i, i + 1) for i in range(200, 260)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {1: 1, 2: 1, 3: 1, 4: 4, **dict.fromkeys(range(5, 10), 5), 20: 20, 21: 20, **dict.fromkeys(range(100, 151), 100), **dict.fromkeys(range(200, 261), 200)}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# substrings


def without_repeats(rows, length):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - length + 1 if d is not None else 0):
            key = tuple(w[i : i + length])
            first[key] = min(d, first.get(key, d))
    out = Counter()
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1 if d is not None else 0):
            if first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out[d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    return out


@pytest.mark.parametrize("length,bits", [(13, 29), (4, 3), (1, 29)])
def test_substrings(spark, length, bits, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEED_BITS", bits)  # with 3, repeated half windows are joined
    got = substring_dedup.substring_dedup(cases.frame(spark, clash=cases.CLASH), length)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == without_repeats(cases.texts(), length)
    assert substring_dedup.substring_dedup(cases.empty(spark), length).count() == 0


def test_longest_repeats(spark):
    """Doubling ends at the longest length that two texts share, against counting every length."""
    rows = [r for r in cases.texts() if r[0] not in (None, 18, 19)]
    texts = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        texts.setdefault(t or "", d)
    words = {d: t.encode().split() for t, d in texts.items()}
    want, length = {}, 4
    while True:
        where = defaultdict(set)
        for d, w in words.items():
            for i in range(len(w) - length + 1):
                where[tuple(w[i : i + length])].add(d)
        more = {d: length for v in where.values() if len(v) > 1 for d in v}
        if not more:
            break
        want.update(more)
        length *= 2
    got = {r["doc"]: r["length"] for r in substring_dedup.longest_repeats(cases.frame(spark, rows), 4).collect()}
    assert got == want and max(got.values()) == 64
    assert substring_dedup.longest_repeats(cases.empty(spark), 4).count() == 0


# personal data

KINDS = ("email", "ip", "card", "phone")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0]))


def fuzz(n):
    import random

    r = random.Random(4)
    alphabet = "abA.@-_%+ 0123456789()é🎉\n"
    return [(1000 + i, "".join(r.choice(alphabet[:12] if i % 3 == 0 else "0123456789 -+.()" if i % 3 == 1 else alphabet) for _ in range(r.randint(0, 60)))) for i in range(n)]


def test_personal_data(spark):
    rows = cases.texts() + fuzz(1500)
    got = pii.find_personal_data(cases.frame(spark, rows, clash=cases.CLASH))
    found = Counter((r["doc"], tuple((s["start"], s["kind"], s["end"]) for s in r["base"])) for r in got.collect())
    assert found == Counter((d, tuple(base_spans(t))) for d, t in rows)
    assert pii.find_personal_data(cases.empty(spark)).count() == 0
    assert pii.sanitise(cases.empty(spark)).count() == 0


def test_disclosing_terms(spark):
    """A word that is only ever near one address goes; words that are common or near copies of one context stay."""
    rows = [(i, f"note number {cases.WORDS[i]} about zanzibarius contact anna@example.org thanks for {cases.WORDS[i + 7]}") for i in range(8)]
    rows += [(50 + i, f"about {cases.WORDS[i]} thanks for contact note number {i}") for i in range(40)] + [(100 + i, "exact copyword bob@example.org here") for i in range(9)]
    got = {r["doc"]: [(s["start"], s["end"], s["value"]) for s in r["spans"] if s["kind"] == 4] for r in pii.find_personal_data(cases.frame(spark, rows)).collect()}
    text = dict(rows)
    assert all([text[d][a:b] for a, b, _ in got[d]] == ["zanzibarius"] for d in range(8)) and not any(got[d] for d in got if d >= 50)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(cases.frame(spark, rows)).collect()}
    assert "zanzibarius" not in clean[0] and "[EMAIL]" in clean[0] and "example.org" not in clean[0] and clean[50] == text[50]


def test_disclosing_terms_away_from_their_entity(spark):
    """A surname said 6 times next to one address and 5 times alone (in either case, in another sentence, without an id) goes everywhere."""
    rows = [(i, f"note {cases.WORDS[i]} about zanzibarius contact anna@example.org thanks") for i in range(6)]
    rows += [(20 + i, f"about {cases.WORDS[i]} thanks for contact note number {i}") for i in range(20)]
    rows[5] = (5, rows[5][1] + ". One two three four five six seven. Then zanzibarius left")
    rows += [(50, "ZANZIBARIUS was seen and zanzibarius waved"), (51, "only zanzibarius"), (51, "only zanzibarius"), (52, "zanzibariusx stays")]
    clean = pii.sanitise(cases.frame(spark, rows)).collect()
    assert not any("zanzibarius" in (r["text"] or "").lower().replace("zanzibariusx", "") for r in clean)
    assert Counter(r["text"] for r in clean if r["doc_id"] in (50, 51, 52)) == Counter(["[TERM] was seen and [TERM] waved", "only [TERM]", "only [TERM]", "zanzibariusx stays"])
    rows[-3] = (None, "only zanzibarius")
    assert {r["text"] for r in pii.sanitise(cases.frame(spark, rows)).where("doc_id is null").collect()} == {"only [TERM]"}
    found = pii.find_personal_data(cases.frame(spark, rows)).where("doc = 5").first()
    assert [s["value"] for s in found["spans"] if s["kind"] == 4] == ["[TERM]", "[TERM]"]


def test_disclosing_terms_of_any_kind_anywhere_in_the_document(spark):
    """A name far from its address, a short one, one with digits, and one of an entity with two contexts."""
    far = "who runs the harbour office in town and has done so for a long time with all that goes on there every day of the year mail"
    rows = [(i, f"{cases.WORDS[i]} zanzibarius or li or k9x {far} x@y.org {cases.WORDS[i + 7]}") for i in range(5)] + [(10 + i, f"{cases.WORDS[i]} quorvex {far} p@q.org") for i in range(2)]
    rows += [(20 + i, f"{far} or {cases.WORDS[i]} {i}") for i in range(40)]
    rows[6] = (11, rows[6][1] + " and more")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(cases.frame(spark, rows)).collect()}
    assert all(not {"zanzibarius", "li", "k9x", "quorvex"} & set(t.split()) for t in clean.values())
    assert all(clean[d] == t for d, t in rows if d >= 20)


def test_sanitise(spark):
    rows = [(1, "a@b.cd, +49 (30) 123-45678 and 1.2.3.4"), (2, None), (3, "clean"), (3, "clean"), (None, "x@y.zz")]
    df = cases.frame(spark, rows, clash=("_mark", "value"))
    got = rows_of(pii.sanitise(df).select("doc_id", "text"), "doc_id", "text")
    assert got == Counter([(1, "[EMAIL], [PHONE] and [IP]"), (2, None), (3, "clean"), (3, "clean"), (None, "[EMAIL]")])


def test_long_digit_runs_end_in_time(spark):
    rows = [(1, "1" * 200_000), (2, "a" * 200_000), (3, "1.1" * 50_000), (4, "+" * 100_000), (5, "1 " * 100_000)]
    got = {r["doc"]: r["base"] for r in pii.find_personal_data(cases.frame(spark, rows)).collect()}
    assert [(b["start"], b["kind"], b["end"]) for b in got[3]] == base_spans(rows[2][1]) and len(got[3]) > 9000
    assert not any(got[d] for d in (1, 2, 4, 5))


def test_texts_of_many_matches(spark):
    """Work in proportion to the text: 80,000 addresses in one text, found and replaced."""
    text = " ".join(f"user{i}@mail{i % 7}.org" for i in range(80_000)) + " +49 (30) 123-45678"
    df = cases.frame(spark, [(1, text)])
    spans = pii.find_personal_data(df).first()["base"]
    assert [(s["start"], s["kind"], s["end"]) for s in spans] == base_spans(text)
    assert pii.sanitise(df).first()["text"] == "[EMAIL] " * 80_000 + "[PHONE]"


def test_running_sums(spark):
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 5000):
        x = [(i * 7919) % 101 for i in range(n)]
        df = spark.createDataFrame([(x,)], "x array<bigint>")
        got = df.select(F.expr(pii.running("x", "0L", "s + y")).alias("s"), F.expr(pii.running("x", "0L", "greatest(s, y)")).alias("m"), F.expr(pii.running("x", "0L", "greatest(s, y)", 1)).alias("k")).first()
        assert got["s"] == [sum(x[:i]) for i in range(n)] and got["m"] == got["k"] == [max([0, *x[:i]]) for i in range(n)]


def test_overlaps(spark):
    """Spans of terms that overlap one of the base go, against comparing all."""
    import random

    r = random.Random(7)
    span = lambda kind: (a := r.randint(0, 200), kind, a + r.randint(1, 12), "v")
    for _ in range(6):
        base, more = sorted(span(r.randint(0, 3)) for _ in range(12)), sorted({span(4) for _ in range(20)})
        want = sorted([*base, *(m for m in more if not any(b[0] < m[2] and m[0] < b[2] for b in base))])
        df = spark.createDataFrame([(base, more)], f"base {pii._SPANS}, more {pii._SPANS}")
        assert [tuple(x) for x in df.select(F.expr(pii._without_overlaps("base", "more")).alias("s")).first()["s"]] == want


def test_hashes_of_queries(spark):
    """The digest columns of the registered queries follow from the operators' outputs."""
    text = "kept words"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kept = substring_dedup.substring_dedup(df).select(F.sha2(F.col("kept_text").cast("binary"), 256)).first()[0]
    assert kept == hashlib.sha256(text.encode()).hexdigest()
    ids = encoded(text)
    for p in packing.pack(df).select("start", F.expr("octet_length(ids) div 4").alias("n"), F.crc32("ids").alias("crc")).collect():
        assert p["crc"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["n"]], "<u4").tobytes())
