"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon, how near its terms stand to the
second person, shares of capitals, digits and punctuation, and rates of
disguised spelling. The lexicon holds words and beginnings of words that occur
far oftener in toxic texts, learned from labelled rows; words are also looked up
with digits and signs read as letters.

Labelled rows for training are a bounded sample of ``max_rows``, those of the
smallest id hashes, so that they fit a broadcast and the driver. They are dealt
by hash in three: for the lexicon, the trees, and the calibration.

Defined results: null and empty texts have features of no words and a score like
any other; a document with several labels counts as toxic if one says so; null
labels and labels without document are ignored; repeated rows are scored one by
one, while training takes one text of an id. Without labels of both kinds every score is the share of toxic labels (0
without any). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import CACHE_WORDS, bucket, materialize, slices, task

MAX_ROWS = 12_000
LEXICON_SIZE = 4000
THRESHOLD = 0.7
STRONG = 2.5
NEAR = 5
# Words of the second person, and signs that stand for letters
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
_LETTERS = bytes.maketrans(b"0134578@$!|+", b"oieastbasiit")
_EDGES = b" .,!?;:\"'()[]{}<>*#%&$|-_=/~`"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings of 4 to 9 bytes, marked as such."""
    return [word, *(word[:k] + b"*" for k in range(4, min(10, len(word) + 1)))]


class Words(dict):
    """Per word: weight in 1/16 above four bits for second person, disguised, sign inside, capitals."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def weight(self, word: bytes) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = raw.strip(_EDGES)
        low = word.lower()
        weight, flags = self.weight(low) if low else 0.0, 0
        plain = low.translate(_LETTERS, b"-._*")
        if plain != low and not low.isdigit():
            inside = any(48 <= b <= 57 or b in _MARKS for b in low) and any(97 <= b <= 122 for b in low)
            flags |= 4 * inside
            other = self.weight(plain) if plain else 0.0
            if other > weight:
                weight, flags = other, flags | 2
        if low.decode(errors="ignore") in SECOND:
            flags |= 1
        if len(word) > 2 and word.isupper():
            flags |= 8
        out = self[raw] = (min(1 << 20, round(weight * 16)) << 4) | flags
        return out


FEATURES = ("words", "hits", "hit_rate", "weight_rate", "weight_max", "strong", "strong_rate", "disguised_rate", "sign_rate", "second_rate", "near_second", "nearest", "capital_rate", "shout_rate", "exclaim_rate", "question_rate", "mark_rate", "digit_rate", "weight_mean")


def features(texts: list, words: Words) -> np.ndarray:
    """A row of FEATURES for each text."""
    split = [t.split() if t else () for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    code = np.fromiter((c for s in split for c in map(words.__getitem__, s)), np.int64, int(n.sum()))
    owner = np.repeat(np.arange(len(n)), n)
    weight, size = (code >> 4) / 16.0, len(n)
    per = lambda mask, w=None: np.bincount(owner[mask], None if w is None else w[mask], size)
    hit, strong, second = weight > 0, weight >= STRONG, (code & 1) == 1
    top = np.zeros(size)
    np.maximum.at(top, owner[hit], weight[hit])
    near, nearest = np.zeros(size), np.zeros(size)
    at, pron = np.flatnonzero(strong), np.flatnonzero(second)
    if len(at) and len(pron):
        right = np.searchsorted(pron, at)
        gap = np.full(len(at), 1 << 30)
        for side in (right - 1, right):
            ok = (side >= 0) & (side < len(pron))
            q = pron[np.clip(side, 0, len(pron) - 1)]
            gap = np.where(ok & (owner[q] == owner[at]), np.minimum(gap, np.abs(q - at)), gap)
        near = np.bincount(owner[at], gap <= NEAR, size)
        np.maximum.at(nearest, owner[at], np.where(gap < 1 << 30, 1 / (1 + gap), 0))
    length = np.fromiter((len(t or b"") for t in texts), np.int64, size)
    missing = lambda drop: np.fromiter((len(t) - len(t.translate(None, drop)) if t else 0 for t in texts), np.int64, size)
    upper, lower, digit, mark = (missing(x) for x in (_UPPER, _LOWER, _DIGITS, _MARKS))
    exclaim, question = (np.fromiter((t.count(c) if t else 0 for t in texts), np.int64, size) for c in (b"!", b"?"))
    some, chars = np.maximum(n, 1), np.maximum(length, 1)
    hits, weights = per(hit), per(hit, weight)
    columns = (
        np.log1p(n), hits, hits / some, weights / some, top, per(strong), per(strong) / some, per((code & 2) > 0) / some, per((code & 4) > 0) / some, per(second) / some,
        near, nearest, upper / np.maximum(upper + lower, 1), per((code & 8) > 0) / some, exclaim / chars, question / chars, mark / chars, digit / chars, weights / np.maximum(hits, 1),
    )
    return np.stack(columns, 1).astype(np.float64)


class Trees:
    """Boosted regression trees on the logistic loss; splits at quantiles, second-order gains."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = math.log(rate / (1 - rate))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        place = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), self.start)
        nodes = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                mine = np.flatnonzero(at == node)
                best = (1e-6, None, None)
                gt, ht = g[mine].sum(), h[mine].sum()
                for j, e in enumerate(edges):
                    if not len(e) or len(mine) < 2:
                        continue
                    gl = np.cumsum(np.bincount(place[mine, j], g[mine], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(place[mine, j], h[mine], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < self.least / 4) | (ht - hl < self.least / 4)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                right = np.zeros(len(mine), bool)
                if best[1] is not None:
                    feature[node], cut[node] = best[1], edges[best[1]][best[2]]
                    right = x[mine, best[1]] > cut[node]
                at[mine] = 2 * node + 1 + right
            leaf = at - nodes
            value = -np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + self.ridge) * self.rate
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[every, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising points (score, share) to interpolate between."""
    o = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # total, number, sum of scores
    for s, y in zip(score[o].tolist(), label[o].tolist(), strict=True):
        blocks.append([y, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, lexicon: dict[bytes, float], trees: Trees | None, points: tuple[np.ndarray, np.ndarray], share: float):
        self.lexicon, self.trees, self.points, self.share = lexicon, trees, points, share

    def score(self, texts: list, words: Words) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(np.interp(self.trees.margin(features(texts, words)), *self.points), 0, 1)


def _lexicon(rows: DataFrame, size: int) -> dict[bytes, float]:
    @task("toxicity")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found: tuple[Counter, Counter] = Counter(), Counter()
            for t, y in zip(texts, part.column(1).to_pylist(), strict=True):
                distinct = {w.strip(_EDGES) for w in (t or b"").lower().split()}
                found[y].update({k for w in distinct if w for k in terms_of(w)})
            keys = list(found[0] | found[1])
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], names=["term", "pos", "neg"])

    n = rows.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    pos, neg = n["pos"] or 0, n["neg"] or 0
    if not pos or not neg:
        return {}
    counts = rows.select("text", "toxic").mapInArrow(count, "term binary, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.expr(f"ln((pos + 0.5) / ({pos} - pos + 0.5)) - ln((neg + 0.5) / ({neg} - neg + 0.5))")
    top = counts.where("pos >= 3").withColumn("w", odds).where("w >= 1").orderBy(F.desc("w"), F.desc("pos"), "term").limit(size).collect()
    return {bytes(r["term"]): r["w"] for r in top}


def fit(docs: DataFrame, labels: DataFrame, training: F.Column, max_rows: int = MAX_ROWS, lexicon_size: int = LEXICON_SIZE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """``training`` is a condition on the id; ``labels`` has id and label (0 or 1)."""
    spark = docs.sparkSession
    known = labels.where(training & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    fold = F.expr("pmod(xxhash64(_id, 7), 10)")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    # one row an id, that of the smallest hash: the bound on labels is one on rows, however often an id occurs
    rows = rows.groupBy("_id", "toxic").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))
    rows = materialize(rows.select("text", "toxic", fold.alias("fold")), "labelled")
    lexicon = _lexicon(rows.where("fold < 4"), lexicon_size)
    sent = spark.sparkContext.broadcast(lexicon)

    @task("toxicity")
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value)
        for part, texts in slices(batches, "text"):
            yield pa.record_batch([part.column(1), part.column(2), pa.array(list(features(texts, words)), pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    got = rows.where("fold >= 4").mapInArrow(describe, "toxic int, fold long, x array<double>").toPandas()
    y = got["toxic"].to_numpy().astype(float)
    share = float(y.mean()) if len(y) else 0.0
    cal = got["fold"].to_numpy() >= 8 if len(y) else np.zeros(0, bool)
    if not (0 < share < 1) or not 0 < y[~cal].mean() < 1 or not cal.any():
        return Model(lexicon, None, (np.zeros(1), np.zeros(1)), share)
    x = np.stack(got["x"].to_list())
    o = np.lexsort((*x.T, y, cal))  # rows come in any order; sums of floats should not depend on it
    x, y, cal = x[o], y[o], cal[o]
    trees = Trees().fit(x[~cal], y[~cal])
    return Model(lexicon, trees, isotonic(trees.margin(x[cal]), y[cal]), share)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(c for c in docs.columns if c != out_col))
    names = docs.columns

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        words = Words(model.lexicon)
        for rows, texts in slices(batches, text_col):
            yield pa.record_batch([*rows.columns, pa.array(model.score(texts, words))], names=[*names, out_col])

    return docs.mapInArrow(run, docs.withColumn(out_col, F.lit(0.0)).schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = bucket("doc_id", 3) == 1
    scored = score(docs.select("doc_id", "text"), fit(docs, labels.select("doc_id", "toxic"), ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
