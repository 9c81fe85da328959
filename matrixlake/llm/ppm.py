"""Scores by prediction by partial matching over bytes.

Training counts every run of ``order + 1`` bytes of the training texts; the
counts of all shorter contexts are sums of these, so one table is the whole
context trie. A byte is coded in the longest context that was seen. Escapes are
estimated by the number of distinct bytes of the context (method C), and after an
escape the bytes of the longer context are excluded from the shorter one. In a
trained trie the bytes seen after a context are also seen after each of its
suffixes, so what exclusion takes from a shorter context is one number per
longer context, and the price of a byte depends on its last ``order + 1`` bytes
alone. Prices are therefore looked up by run, in arrays, and worked out once.
Bytes that no context has are equally likely among those not excluded.

Texts are lower-cased (A-Z) and their words joined by one space; byte 255, which
UTF-8 lacks, marks the end and, repeated, what stands before a text.

The trie is collected and broadcast while it has at most ``block_runs`` runs; a
larger one is split by the end of the context, which all longer contexts of a
position share: by its last byte, and where one byte has too many runs by its last
two, three and so on, so that a part never has more than ``block_runs`` runs (256
at least). Contexts shorter than the deepest split are in every part. Each part
scores its positions in a scan of its own. Counts
of words for the base score are broadcast up to ``block_words`` words and joined
beyond.

Defined results: a null or empty text has the end token alone; repeated rows are
counted and scored as often as they occur; a null id counts as empty text when
rows are dealt to training. Without any training row all bytes are equally
likely and the base score has V = N = 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import bucket, hash_words, materialize, slices, task

ORDER = 5
BLOCK_RUNS = 6_000_000
BLOCK_WORDS = 6_000_000
MEMO_BITS = 20
#: bytes of texts at a time; arrays of a slice take about 60 times as much
SLICE = 1 << 19
END = 255
END_WORD = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds a line end
_MULT = np.uint64(0x9E3779B97F4A7C15)


def runs(texts: list, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``order + 1`` bytes up to each coded byte, and each text's number of coded bytes (its end included)."""
    pad = b"\xff" * order
    norm = [b" ".join(t.lower().split()) + pad if t else pad for t in texts]
    n = np.fromiter(map(len, norm), np.int64, len(norm))
    data = np.frombuffer(pad + b"".join(norm), np.uint8)
    total = len(data) - order
    code = np.zeros(total, np.uint64)
    for j in range(order + 1):
        code <<= np.uint64(8)
        code |= data[j : j + total]
    keep = np.ones(total, bool)
    ends = np.cumsum(n)
    for j in range(1, order):
        keep[ends - j] = False
    return code[keep], n - order + 1


def tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        s = np.sort(codes)
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        return s[first], np.diff(np.r_[first, len(s)])
    o = np.argsort(codes, kind="stable")
    s, c = codes[o], counts[o]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[first], np.add.reduceat(c, first) if len(first) else c


def small(a: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    return a.astype(np.uint16 if not len(a) or a.max() < 1 << 16 else np.uint32 if a.max() < 1 << 32 else np.int64)


class Gather:
    """Counts by code, merged now and then; what has become too large is handed on."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.parts, self.held = limit, [], 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(tally(codes))
        self.held += len(self.parts[-1][0])
        if self.held > self.limit and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    def merged(self):
        return tally(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def take(self, least: int = 0):
        if self.held <= least:
            return None
        out = self.merged()
        self.parts, self.held = [], 0
        return out


class Trie:
    """Contexts of all lengths up to ``order`` from runs of one more byte and, for the empty context, all bytes' counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, letters: np.ndarray, order: int, lower: dict | None = None):
        """``lower``: runs and counts of contexts by length, where ``codes`` are a part that lacks some of theirs."""
        self.order = order
        self.gram, self.count, self.ctx, self.total, self.kinds, self.taken = ([None] * (order + 1) for _ in range(6))
        for j in range(order, -1, -1):
            if j == order:
                g, c = tally(codes, counts)
            elif lower and j in lower:
                g, c = lower[j]
            elif j == 0:
                g = np.flatnonzero(letters).astype(np.uint64)
                c = letters[letters > 0]
            else:
                g, c = tally(self.gram[j + 1] & np.uint64((1 << (8 * (j + 1))) - 1), self.count[j + 1])
            first = np.flatnonzero(np.r_[True, (g[1:] >> np.uint64(8)) != (g[:-1] >> np.uint64(8))]) if len(g) else np.zeros(0, np.int64)
            self.gram[j], self.count[j] = g, c.astype(np.int64)
            self.ctx[j] = g[first] >> np.uint64(8)
            self.total[j] = np.add.reduceat(self.count[j], first) if len(first) else np.zeros(0, np.int64)
            self.kinds[j] = np.diff(np.r_[first, len(g)])
        for j in range(1, order + 1):
            # what the bytes seen after a context count for after its suffix
            below = self.count[j - 1][np.searchsorted(self.gram[j - 1], self.gram[j] & np.uint64((1 << (8 * j)) - 1))]
            first = np.cumsum(self.kinds[j]) - self.kinds[j]
            self.taken[j] = np.add.reduceat(below, first) if len(first) else below
        for part in (self.count, self.total, self.kinds, self.taken):
            part[:] = [x if x is None else small(x) for x in part]

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def price(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each run's last byte after the bytes before it."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        gone_total, gone_kinds = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)  # excluded by the longer context
        for j in range(self.order, -1, -1):
            g = codes[left] & np.uint64((1 << (8 * (j + 1))) - 1)
            node, known = self._find(self.ctx[j], g >> np.uint64(8))
            at_node = lambda a: np.where(known, a[node].astype(np.int64) if len(a) else 0, 0)  # noqa: B023, E731
            total, kinds = at_node(self.total[j]), at_node(self.kinds[j])
            t, d = total - gone_total[left], kinds - gone_kinds[left]
            at, seen = self._find(self.gram[j], g)
            open_ = d > 0  # else nothing is left to code here, and the escape is certain
            c = self.count[j][at].astype(np.int64) if len(self.count[j]) else np.zeros(len(g), np.int64)
            hit = seen & open_
            out[left[hit]] += np.log10(c[hit] / (t[hit] + d[hit]))
            miss = ~hit & open_
            out[left[miss]] += np.log10(d[miss] / (t[miss] + d[miss]))
            if j:
                gone_total[left[known]] = at_node(self.taken[j])[known]
                gone_kinds[left[known]] = kinds[known]
            else:
                gone_kinds[left] = kinds
            left = left[~hit]
        out[left] -= np.log10(256 - gone_kinds[left])
        return out


class Memo:
    """Values by 64-bit key; a key that is not held is worked out and takes the place of another."""

    def __init__(self, work, bits: int = MEMO_BITS):
        self.work, self.shift = work, np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
        self.full = np.zeros(1 << bits, bool)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * _MULT) >> self.shift).astype(np.int64)
        out = self.values[at]
        miss = np.flatnonzero((self.keys[at] != keys) | ~self.full[at])
        if len(miss):
            some, back = np.unique(keys[miss], return_inverse=True)
            got = self.work(some)
            out[miss] = got[back]
            at = ((some * _MULT) >> self.shift).astype(np.int64)
            self.keys[at], self.values[at], self.full[at] = some, got, True
            # of two new keys for one place the later one stays, in all three arrays
        return out


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n))
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some])
    return out


def train(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): counts of runs (kind 0) and of words and ends (kind 1) in a text column named ``text``."""

    @task("words")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathers = Gather(), Gather()

        def out(kind, got):
            return pa.record_batch([pa.array(np.full(len(got[0]), kind, np.int32)), pa.array(got[0].view(np.int64)), pa.array(got[1].astype(np.int64))], names=["kind", "key", "n"])

        for _, texts in slices(batches, "text", SLICE):
            gathers[0].add(runs(texts, order)[0])
            h, _ = hash_words(texts, lower=True)
            gathers[1].add(np.concatenate([h, np.full(len(texts), END_WORD)]))
            for kind in (0, 1):
                if got := gathers[kind].take(2_000_000):
                    yield out(kind, got)
        for kind in (0, 1):
            if got := gathers[kind].take():
                yield out(kind, got)

    return rows.mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", "n").toArrow()
    keys, n = got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy().astype(np.int64)
    o = np.argsort(keys)
    return keys[o], n[o]


def split_contexts(letters: DataFrame, order: int, block_runs: int) -> list[list[tuple[int, int]]]:
    """Blocks of (length, value) of ends of contexts, each with at most ``block_runs`` runs: ends that have more are made longer."""
    blocks: list[list[tuple[int, int]]] = [[]]
    held, long = 0, None
    for depth in range(1, order + 1):
        mask = lambda d: (1 << 8 * d) - 1
        rows = letters if long is None else letters.where(F.expr(f"shiftrightunsigned(key, 8) & {mask(depth - 1)}L").isin(long))
        ends = rows.groupBy(F.expr(f"shiftrightunsigned(key, 8) & {mask(depth)}L").alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()
        long = [r["e"] for r in ends if r["n"] > block_runs and depth < order]
        for n, e in sorted((r["n"], r["e"]) for r in ends if r["n"] <= block_runs or depth == order):
            if held and held + n > block_runs:
                blocks.append([])
                held = 0
            blocks[-1].append((depth, e))
            held += n
        if not long:
            break
    return blocks


def in_block(block: list[tuple[int, int]]) -> F.Column:
    out = F.lit(False)
    for depth in sorted({d for d, _ in block}):
        out = out | F.expr(f"shiftrightunsigned(key, 8) & {(1 << 8 * depth) - 1}L").isin([e for d, e in block if d == depth])
    return out


class Owners:
    """Which contexts block number ``mine`` scores; those with an end that no block has belong to the last one."""

    def __init__(self, blocks: list[list[tuple[int, int]]], mine: int):
        ends = sorted((d, e, i) for i, block in enumerate(blocks) for d, e in block)
        self.tables = [(d, np.array([e for x, e, _ in ends if x == d], np.uint64), np.array([i == mine for x, _, i in ends if x == d])) for d in sorted({d for d, _, _ in ends})]
        self.rest = mine == len(blocks) - 1

    def __call__(self, contexts: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(contexts), self.rest), np.ones(len(contexts), bool)
        for depth, ends, own in self.tables:
            at, seen = Trie._find(ends, contexts & np.uint64((1 << 8 * depth) - 1))
            seen &= open_
            out[seen] = own[at[seen]]
            open_ &= ~seen
        return out


def ppm_score(docs: DataFrame, training: F.Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", block_runs: int = BLOCK_RUNS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per row of ``docs``: id, ``in_training``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("in_training"))
    counts = materialize(train(rows.where("in_training").select("text"), order), "counts")
    letters, words = counts.where("kind = 0"), counts.where("kind = 1")
    n_words, n_tokens = (x or 0 for x in words.agg(F.count(F.lit(1)), F.sum("n")).first())
    by_byte = letters.groupBy(F.expr("cast(key & 255 as int)").alias("b")).agg(F.sum("n").alias("n")).collect()
    zero = np.zeros(256, np.int64)
    for r in by_byte:
        zero[r["b"]] = r["n"]
    blocks = split_contexts(letters, order, block_runs)
    deepest = max((depth for block in blocks for depth, _ in block), default=1)
    lower = {j: _arrays(letters.groupBy(F.expr(f"key & {(1 << 8 * (j + 1)) - 1}L").alias("key")).agg(F.sum("n").alias("n"))) for j in range(1, deepest)}
    known = None
    if n_words <= block_words:
        keys, n = _arrays(words)
        known = spark.sparkContext.broadcast((keys, small(n)))
        del keys, n
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "text", "in_training", "n_tokens", "n_known", "base_score", "score"]
    schema = f"id {id_type}, text string, in_training boolean, n_tokens long, n_known long, base_score double, score double"
    out = rows.select("id", "text", "in_training", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    floor = float(np.log10(0.1 / (n_tokens + 0.1 * (n_words + 1)))) if n_tokens or n_words else float(np.log10(0.1 / 0.1))
    for k, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(Trie(*_arrays(letters.where(in_block(block)) if len(blocks) > 1 else letters), zero, order, lower))
        owners = Owners(blocks, k)
        tokens = k == 0

        @task("words")
        def score(batches: Iterator[pa.RecordBatch], sent=sent, owners=owners, tokens=tokens, whole=len(blocks) == 1, last=k == len(blocks) - 1) -> Iterator[pa.RecordBatch]:
            price = Memo(sent.value.price)
            if tokens and known is not None:
                keys, counted = known.value

                def value(h):
                    at, seen = Trie._find(keys, h)
                    c = counted[at].astype(np.int64) if len(keys) else np.zeros(len(h), np.int64)
                    return np.where(seen, np.log10((c + 0.1) / (n_tokens + 0.1 * (n_words + 1))), floor)

                worth = Memo(value)
            for part, texts in slices(batches, "text", SLICE):
                codes, n = runs(texts, order)
                if whole:
                    got = _sums(price(codes), n)
                else:
                    own = owners(codes >> np.uint64(8))
                    p = np.zeros(len(codes))
                    p[own] = price(codes[own])
                    got = _sums(p, n)
                columns = [part.column(i) for i in range(7)]
                columns[6] = pa.array(part.column(6).to_numpy(zero_copy_only=False) + got)
                if tokens:
                    h, many = hash_words(texts, lower=True)
                    columns[3] = pa.array(many + 1)
                    if known is not None:
                        v = worth(h)
                        end = float(worth(np.array([END_WORD]))[0])
                        columns[4] = pa.array(_sums((v > floor).astype(float), many).astype(np.int64) + (end > floor))
                        columns[5] = pa.array(_sums(v, many) + end)
                if last:
                    columns[1] = pa.nulls(part.num_rows, pa.string()) if known is not None else part.column(1)
                yield pa.record_batch(columns, names=names)

        out = out.mapInArrow(score, schema)
    if known is None:
        out = _joined_base(out, words, n_tokens, n_words)
    total = F.lit(n_tokens).cast("long").alias("train_tokens")
    return out.select(F.col("id").alias(id_col), "in_training", "n_tokens", "n_known", total, "base_score", "score")


def _joined_base(out: DataFrame, words: DataFrame, n_tokens: int, n_words: int) -> DataFrame:
    """The base score by a join of each text's distinct words with the counts, for vocabularies too large to broadcast."""
    a = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = out.select(a.alias("a"), "text").groupBy("a").agg(F.max("text").alias("text"))

    @task("words")
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            h, n = hash_words(texts, lower=True)
            own = np.repeat(np.arange(len(n)), n)
            o = np.lexsort((h, own))
            h, own = h[o], own[o]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, np.int64)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            every = np.arange(len(n))
            yield pa.record_batch(
                [pa.array(np.r_[ids[own[first]], ids[every]]), pa.array(np.r_[h[first], np.full(len(n), END_WORD)].view(np.int64)), pa.array(np.r_[np.diff(np.r_[first, len(h)]), np.ones(len(n), np.int64)])],
                names=["a", "key", "m"],
            )

    worth = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / (n_tokens + 0.1 * (n_words + 1)))
    sums = texts.mapInArrow(distinct, "a long, key long, m long").join(words.select("key", "n"), "key", "left").groupBy("a").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("n_known"), F.sum(F.col("m") * worth).alias("base_score"))
    return out.drop("n_known", "base_score").withColumn("a", a).join(sums, "a").drop("a")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = bucket("doc_id", 10) == 0
    return ppm_score(docs, ~held).select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
