"""Packing of tokenised documents into sequences by order-preserving dynamic programming.

The documents of a partition, in order, are one stream of tokens. A window may
end after a document (no penalty), after a sentence (a small one), or inside a
long sentence at a fixed grid (a larger one). Over these cuts, f(j) = penalty(j)
+ min over cuts i at most ``size`` tokens before j of f(i) + size - (j - i): the
padding that the window i..j leaves. f(i) + i does not depend on j, so the
minimum comes from a monotone queue and every cut is handled once.

Work goes on in blocks of a bounded number of tokens; what follows the last
chosen cut of a block moves to the next one. The rest at a partition's end is
cut at powers of two, which need no padding. There is no shuffle.

Defined results: a null or empty text is the end token alone; repeated rows are
packed as often as they occur; an empty table gives no pieces; a null id stays
null. Columns besides id and text are ignored.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import cached_by, slices, task

SIZE = 4096
END_ID = 2
SENTENCE_PENALTY = 4
INSIDE_PENALTY = 24
GRID = 32
BLOCK_TOKENS = 1 << 20
#: distinct pieces of text whose ids a worker keeps, about 200 bytes each
CACHE_PIECES = 600_000
_STOP = re.compile(rb"(?<=[a-z])[,.](?=[ \n])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Token ids of pieces of text between ASCII white space, kept in one growing array.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its pieces, one after the other; each distinct piece is encoded
    once while it stays in the bounded cache.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.limit = end_id, CACHE_PIECES
        stop = re.compile(r"[.!?]+[\"')\]]*(</w>)?$")
        vocabulary = self.tokenizer.get_vocab()
        self.stops = np.zeros(max(vocabulary.values()) + 1, bool)
        self.stops[[i for t, i in vocabulary.items() if stop.fullmatch(t)]] = True
        self.closes = np.zeros(len(self.stops), bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # true if a plain word is one run of tokens of which only the last closes
        self.plain = self.closes[self.tokenizer.encode("word", add_special_tokens=False).ids[-1]] and self.tokenizer.encode("wörd wörds", add_special_tokens=False).ids == [
            i for w in ("wörd", "WÖRDS") for i in self.tokenizer.encode(w, add_special_tokens=False).ids
        ]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.folds = ids("Word, Two. Ab") == ids("word , two . ab")
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offset, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.pending: list[bytes] = []
        self[b"\n"] = 0  # never a piece; stands for the document's end
        self._add(np.array([0]), np.array([self.end_id]), np.array([1]))

    def __missing__(self, piece: bytes) -> int:
        at = self[piece] = len(self)
        self.pending.append(piece)
        return at

    def _add(self, at: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Pieces number ``at``: ``ids`` holds theirs, one after the other, ``n`` each."""
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while len(self) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.store[self.used : self.used + len(ids)] = ids
        self.offset[at], self.length[at] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)

    def _learn(self, first: int, pieces: list[bytes]) -> None:
        """Words of Latin letters are encoded many at a time, since a word's ids end with the one that closes it."""
        plain, odd = [], []
        for i, p in enumerate(pieces, first):
            w = p.decode()
            (plain if self.plain and w.isalpha() and (p.isascii() or max(w) < "\u0130") else odd).append((i, w))
        groups = [" ".join([w for _, w in plain[a : a + 200]]) for a in range(0, len(plain), 200)]
        for pairs, texts in ((plain, groups), (odd, [w for _, w in odd])):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.concatenate([np.asarray(x, np.uint32) for x in found]) if found else np.zeros(0, np.uint32)
            n = np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0) if pairs is plain else np.fromiter(map(len, found), np.int64, len(found))
            self._add(np.fromiter((i for i, _ in pairs), np.int64, len(pairs)), ids, n)

    def prepared(self, text: bytes) -> bytes:
        """A text of the same ids with fewer distinct pieces: in lower case, a comma or full stop after a letter set off."""
        return _STOP.sub(rb" \g<0>", text.lower()) if self.folds and b"<|" not in text else text

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by the end id, and each text's number of ids."""
        if len(self) > self.limit:
            self.reset()
        known = len(self)
        pieces = [[*self.prepared(t).split(), b"\n"] if t else [b"\n"] for t in texts]
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.fromiter((i for p in pieces for i in map(self.__getitem__, p)), np.int64, int(n.sum()))
        if self.pending:
            new, self.pending = self.pending, []
            self._learn(known, new)
        length = self.length[at]
        ends = np.cumsum(length)
        where = np.repeat(self.offset[at] - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)
        last = ends[np.cumsum(n) - 1]
        return self.store[where], np.diff(last, prepend=0)


_encoders: dict[tuple[str, int], Encoder] = {}
cached_by("packing", _encoders.clear)


def encoder(path: str, end_id: int) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def cut_points(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, rising, and their penalties; ``ends``: of the documents."""
    total = len(ids)
    penalty = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(stops[ids]) + 1
    penalty[at] = SENTENCE_PENALTY
    free = np.zeros(total + 1, bool)
    free[at] = True
    free[ends] = True
    penalty[ends] = 0
    free[0] = True
    marks = np.flatnonzero(free)
    grid = min(GRID, size)
    gap = np.diff(np.r_[marks, total])
    long = np.flatnonzero(gap > grid)
    if len(long):
        more = (gap[long] - 1) // grid
        step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        inside = np.repeat(marks[long], more) + step * grid
        free[inside] = True
        penalty[inside] = INSIDE_PENALTY
    marks = np.flatnonzero(free)
    return marks, penalty[marks]


def best_cuts(marks: np.ndarray, penalty: np.ndarray, total: int, size: int = SIZE) -> list[int]:
    """Ends of the windows, rising; the rest after the last of them has at most ``size`` tokens and is open."""
    at, cost = marks.tolist(), penalty.tolist()
    best, back = [0] * len(at), [-1] * len(at)
    queue = deque([0])  # indexes of earlier cuts, best[i] + at[i] rising
    key = [at[0]] + [0] * (len(at) - 1)
    for j in range(1, len(at)):
        here = at[j]
        low = here - size
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value = best[j] = key[i] + size - here + cost[j]
        mine = key[j] = value + here
        while queue and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    first = int(np.searchsorted(marks, total - size, side="left"))
    j = min(range(first, len(at)), key=lambda k: (best[k], -k))
    cuts = []
    while j > 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def powers(n: int, size: int) -> list[int]:
    """Ends of windows of power-of-two lengths that together are n."""
    out, at = [], 0
    while at < n:
        step = min(size, 1 << ((n - at).bit_length() - 1))
        at += step
        out.append(at)
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """A row per piece: id, ``start`` (ids of its document before it), ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``
    (unsigned 32-bit little-endian). ``size`` must be a power of two; ``cache_pieces`` bounds what a worker remembers."""
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType

    @task("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        enc.limit = cache_pieces
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        arrow_type = None
        names, total, base, length, parts = [], [], [], [], []  # the block's documents

        def flush(last: bool):
            nonlocal sequence, names, total, base, length, parts
            ids = np.concatenate(parts)
            n = np.concatenate(length)
            tot, bas = np.concatenate(total), np.concatenate(base)
            ends = np.cumsum(n)
            cuts = best_cuts(*cut_points(ids, ends, enc.stops, size), len(ids), size)
            if last:
                done = cuts[-1] if cuts else 0
                cuts += [done + p for p in powers(len(ids) - done, size)]
            done = cuts[-1] if cuts else 0
            to = np.union1d(ends[ends <= done], np.asarray(cuts, np.int64))
            begin = np.r_[0, to[:-1]] if len(to) else to
            doc = np.searchsorted(ends, begin, side="right")
            window = np.searchsorted(cuts, begin, side="right")
            opened = np.r_[0, np.asarray(cuts, np.int64)][window]
            raw = ids.astype("<u4").tobytes()
            first = ends - n
            out = pa.record_batch(
                [
                    pa.array([names[d] for d in doc.tolist()], arrow_type),
                    pa.array(begin - first[doc] + bas[doc], pa.int64()),
                    pa.array(tot[doc], pa.int64()),
                    pa.array(window + sequence, pa.int64()),
                    pa.array(begin - opened, pa.int64()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), to.tolist(), strict=True)], pa.binary()),
                ],
                names=["id", "start", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            sequence += len(cuts)
            keep = int(np.searchsorted(ends, done, side="right"))  # the first document not wholly placed
            names = names[keep:]
            left = n[keep:].copy()
            moved = bas[keep:].copy()
            if len(left) and first[keep] < done:
                moved[0] += done - first[keep]
                left[0] -= done - first[keep]
            total, base, length, parts = [tot[keep:]], [moved], [left], [ids[done:]]
            return out

        waiting = 0
        for rows, texts in slices(batches, text_col):
            column = rows.column(rows.schema.get_field_index(id_col))
            arrow_type = column.type
            ids, n = enc.encode(texts)
            names += column.to_pylist()
            total.append(n)
            base.append(np.zeros(len(n), np.int64))
            length.append(n)
            parts.append(ids)
            waiting += len(ids)
            if waiting >= block_tokens:
                yield flush(False)
                waiting = sum(map(len, parts))
        if sum(map(len, parts)):
            yield flush(True)

    schema = f"id {id_type.simpleString()}, start long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select(
        "doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
