"""Language identification by inference of a mixture of languages.

A language is a distribution over byte trigrams of words, learned from labelled
texts; a word's likelihood under a language is the product over its trigrams.
A document is taken as words drawn from several languages: expectation-
maximisation estimates their proportions (``ROUNDS`` rounds), then sets of the 1,
2, ... strongest languages are fitted again and the one of the highest likelihood,
less half the logarithm of the number of words for each further language, is
chosen. A document's set grows until ``PATIENCE`` further languages in a row have
not raised that value, up to all learned languages.

Trigrams are hashed to 2**18 places, so a model has a bound in size by language.
Likelihoods of words are kept in a bounded cache; the rest is array work over
slices of texts. Nothing but the counts of trigrams is shuffled.

Defined results: a text without letters, an empty or a null one gives ``und``
with score 0 and no shares, and so does a model without languages; more than
``MAX_LANGUAGES`` learned labels are a ValueError; repeated rows
count and are judged as often as they occur; an empty table gives an empty
result. Columns besides id, text and the label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import bucket, materialize, slices, task

PLACES = 1 << 18
ALPHA = 0.5
ROUNDS = 6
PATIENCE = 2
#: a megabyte of log probabilities each, on the driver and in a broadcast
MAX_LANGUAGES = 200
UNKNOWN = "und"
#: letters stay, in lower case for A-Z; digits, punctuation and controls part words
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _places(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 18)


def count_trigrams(rows: DataFrame) -> DataFrame:
    """(lang, place, n) from columns ``text`` and ``lang``."""

    @task("language")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part, texts in slices(batches, "text"):
            by_lang: dict[str, list[bytes]] = {}
            for t, g in zip(texts, part.column(1).to_pylist(), strict=True):
                by_lang.setdefault(g, []).extend((t or b"").translate(_FOLD).split())
            for g, words in by_lang.items():
                if words:
                    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
                    mid = data[1:-1] != 32  # one trigram around each letter
                    n = np.bincount(_places(data)[mid], minlength=PLACES)
                    total[g] = total[g] + n if g in total else n
        for g, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([g] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "place", "n"])

    return rows.select("text", "lang").mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of trigrams by language, and a cache of words' log likelihoods."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        seen = max(1, int((counts.sum(0) > 0).sum()))
        self.logs = np.log((counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * seen)).astype(np.float32).T.copy()

    def __getstate__(self):
        return {"languages": self.languages, "logs": self.logs}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def reset(self) -> None:
        self.limit = max(20_000, (64 << 20) // (4 * max(1, len(self.languages))) if len(self.languages) > 40 else 250_000)
        self.index, self.known = _Index(), np.zeros((0, len(self.languages)), np.float32)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log likelihoods, a row for each word."""
        if len(self.index) > self.limit:
            self.reset()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.pending:
            data = np.frombuffer(b" " + b" ".join(new) + b" ", np.uint8)
            mid = data[1:-1] != 32
            size = np.fromiter(map(len, new), np.int64, len(new))
            rows = np.add.reduceat(self.logs[_places(data)[mid]], np.cumsum(size) - size, axis=0)
            used = len(self.index) - len(new)
            if len(self.index) > len(self.known):
                self.known = np.concatenate([self.known[:used], np.zeros((max(1 << 14, len(self.index)), self.known.shape[1]), np.float32)])
            self.known[used : len(self.index)] = rows
            self.index.pending = []
        return self.known[at]


class _Index(dict):
    def __init__(self):
        super().__init__()
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.pending.append(word)
        return at


def fit(docs: DataFrame, training: F.Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """At most 2**18 counts by language reach the driver."""
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = materialize(count_trigrams(rows), "trigrams")
    many = counted.agg(F.count_distinct("lang")).first()[0]
    if many > MAX_LANGUAGES:
        raise ValueError(f"{many} languages are labelled, {MAX_LANGUAGES} at most can be learned")
    got = counted.toPandas()
    languages = sorted(got["lang"].unique().tolist())
    counts = np.zeros((len(languages), PLACES), np.float64)
    if len(got):
        number = {g: i for i, g in enumerate(languages)}
        counts[got["lang"].map(number).to_numpy(), got["place"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def em(p: np.ndarray, owner: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and the log likelihood with them; ``p``: likelihoods of words, scaled by word."""
    for _ in range(rounds):
        w = p * share[owner]
        w /= w.sum(1, keepdims=True) + np.float32(1e-30)
        share = (np.add.reduceat(w, starts, axis=0) / n[:, None]).astype(np.float32)
    total = (p * share[owner]).sum(1)
    return share, np.add.reduceat(np.log(total + np.float32(1e-30)), starts)


def infer(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions by document (rows) after the choice of the set of languages; ``n``: words, all positive."""
    langs = p.shape[1]
    owner, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    full, _ = em(p, owner, starts, n, np.full((len(n), langs), 1 / langs, np.float32), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(langs)[None], axis=1)
    best, best_value = np.zeros_like(full), np.full(len(n), -np.inf)
    left, waited = np.arange(len(n)), np.zeros(len(n), np.int64)  # documents whose set may still grow
    for k in range(1, langs + 1):
        share = np.where(rank[left] < k, np.maximum(full[left], np.float32(1e-3)), 0).astype(np.float32)
        share, value = em(p, owner, starts, n, share / share.sum(1, keepdims=True), 0 if k == 1 else ROUNDS // 2)
        value = value - 0.5 * (k - 1) * np.log(np.maximum(n, 2))
        better = value > best_value[left]
        best[left[better]], best_value[left[better]] = share[better], value[better]
        waited = np.where(better, 0, waited + 1)
        go = waited < PATIENCE
        if not go.any():
            break
        if not go.all():
            p, n, left, waited = p[go[owner]], n[go], left[go], waited[go]
            owner, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    return best


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()[:64])) or any(map(str.isalpha, text.decode()))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``: the share of that language, ``shares``: of the chosen set, strongest first)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @task("language")
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = model.languages
        for rows, texts in slices(batches, text_col):
            split = [t.translate(_FOLD).split() if t and names and has_letter(t) else [] for t in texts]
            n = np.fromiter(map(len, split), np.int64, len(split))
            some = np.flatnonzero(n)
            pred, score, shares = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            if len(some):
                logs = model.words([w for s in split for w in s])
                logs -= logs.max(1, keepdims=True)
                share = infer(np.exp(np.maximum(logs, np.float32(-30))), n[some])
                for i, row in zip(some.tolist(), share.tolist(), strict=True):
                    chosen = sorted(((-x, j) for j, x in enumerate(row) if x > 0))
                    pred[i], score[i] = names[chosen[0][1]], min(1.0, -chosen[0][0])
                    shares[i] = [{"lang": names[j], "share": -x} for x, j in chosen]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.record_batch([rows.column(0), pa.array(pred), pa.array(score), pa.array(shares, kind)], names=["id", "lang_pred", "score", "shares"])

    schema = f"id {id_type}, lang_pred string, score double, shares array<struct<lang:string,share:double>>"
    return docs.select(id_col, text_col).mapInArrow(predict, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = bucket("doc_id", 4) == 2
    return identify(docs, fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
