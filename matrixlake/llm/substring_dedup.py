"""Substring deduplication by level-wise doubling.

Level 1 looks at windows of half the length. Every full window is stood for by
the smallest hash among the half windows inside it, so that equal full windows
always share that half window and only about a quarter of all half windows need
to be counted. Half windows seen in one document alone end there: the repeated
ones are counted and kept in a bitmap of 64 bits or more for each (a wrong "repeated"
costs work, never a result), or joined where the bitmap would pass its bound.
Level 2 extends the surviving windows alone to twice the length (overlapping by
one word where the length is odd) and counts them by 96 bits of two hashes. That
length is what is removed by, and no longer level can change what is removed;
``longest_repeats`` goes on doubling, each level on what the one before left,
until no candidates survive.

Exact copies are settled first, by a hash of the whole text: every window of a
copy also starts in the copy with the smallest id.

Defined results: a null text has no words; a text shorter than the window keeps
all its words; rows with a null id are never removed from and remove nothing;
repeated rows (same id, same text) are one document, and a second text under the
same id is judged on its own, but not against its namesake (its id is not
smaller). An empty table gives an empty result. Ids of another type than integers
are a TypeError. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import bitmap_of, bits_for, discard, hash_words, in_bitmap, integer_ids, materialize, slices, sliding_min, task, window_hashes

#: a bitmap of repeated half windows has 2**30 bits at most (128 MB); more of them than an eighth of that are joined
SEED_BITS = 30
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: part of a text's hash, from the hash
_MARK = "shiftright(shiftleft(a, 32), 32)"


def _hash(column: str) -> list:
    t = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(1), t)]


def _windows(texts: list, length: int):
    """Word hashes, words by text, and for each window its start, text and smallest half-window hash."""
    h, n = hash_words(texts, lower=False)
    owner = np.repeat(np.arange(len(texts)), n)
    half = (length + 1) // 2
    low = sliding_min(window_hashes(h, half), length - half + 1)
    ok = np.flatnonzero(owner[: len(low)] == owner[length - 1 :]) if len(low) else np.zeros(0, np.int64)
    return h, n, owner, ok, low


def _candidates(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(windows, copies, shared): hash, document and position of windows that may be repeated; documents that are copies
    of one with a smaller id; whether different texts share an id."""
    spark = docs.sparkSession
    integer_ids(docs, id_col)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    a, b = _hash("text")
    hashed = base.select("doc", a.alias("a"), b.alias("b"))
    first = materialize(hashed.groupBy("a", "b").agg(F.min("doc").alias("low"), F.max("doc").alias("high")), "texts")
    copies = hashed.join(first.where("low < high"), ["a", "b"]).where("doc > low").select("doc", "a").distinct()
    shared_id = not hashed.groupBy("doc").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x < y").isEmpty()
    # a document whose bit is not set is surely a copy; a wrongly set bit only costs work
    first_bits = bits_for(first.count())
    firsts = spark.sparkContext.broadcast(bitmap_of(first.select(F.xxhash64("low", "a").alias("k")), "k", first_bits).tobytes())
    a = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = base.select("doc", "text", a.alias("a"), F.xxhash64("doc", a).alias("k"))

    def doc_of(rows: pa.RecordBatch, texts: list):
        ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        k = rows.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        keep = in_bitmap(np.frombuffer(firsts.value, np.uint8), k, first_bits).tolist()
        return ids, [t if x else b"" for t, x in zip(texts, keep, strict=True)]

    @task("words")
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            ids, texts = doc_of(rows, texts)
            _, _, owner, ok, low = _windows(texts, length)
            s, d = low[ok], owner[ok]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            yield pa.record_batch([pa.array(s[new].view(np.int64)), pa.array(ids[d[new]])], names=["seed", "doc"])

    found = rows.mapInArrow(seeds, "seed long, doc long").groupBy("seed").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    found = materialize(found.where("low < high").select("seed"), "seeds")
    many = found.count()
    joined, seed_bits = many > 1 << (SEED_BITS - 3), bits_for(many, SEED_BITS)
    repeated = spark.sparkContext.broadcast(b"\0" if joined else bitmap_of(found, "seed", seed_bits).tobytes())

    @task("words")
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(repeated.value, np.uint8)
        for rows, texts in slices(batches, "text"):
            ids, texts = doc_of(rows, texts)
            mark = rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if shared_id else np.zeros(len(ids), np.int64)
            h, n, owner, ok, low = _windows(texts, length)
            ok = ok if joined else ok[in_bitmap(bitmap, low[ok], seed_bits)]
            if not len(ok):
                continue
            at = ok - (np.cumsum(n) - n)[owner[ok]]
            full = window_hashes(h, length)[ok]
            check = (window_hashes(h, length, _SECOND)[ok] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            columns = [pa.array(full.view(np.int64)), pa.array(check), pa.array(ids[owner[ok]]), pa.array((mark[owner[ok]] << 32) | at)]
            yield pa.record_batch([*columns, pa.array(low[ok].view(np.int64))] if joined else columns, names=["h", "c", "doc", "at", "seed"][: 4 + joined])

    # "at" holds the word position in its low 32 bits and, where texts share an id, part of the text's hash in the high ones
    candidates = rows.mapInArrow(extend, "h long, c int, doc long, at long" + ", seed long" * joined)
    candidates = materialize(candidates.join(found, "seed", "left_semi").drop("seed") if joined else candidates, "windows")
    discard(found)
    return candidates, copies.select("doc", F.expr(_MARK if shared_id else "0L").alias("mark")).distinct(), shared_id


def _repeated(windows: DataFrame) -> DataFrame:
    """(h, c, low) of windows in more than one document. Read back, so that both sides of a join with it are dealt anew and a hot window can be split."""
    return materialize(windows.groupBy("h", "c").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h", "c", "low"), "repeated")


def repeated_windows(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, bool]:
    """(covered, copies): start positions of windows that also start in a document with a smaller id, by document and text;
    the documents that are copies of one with a smaller id; and whether different texts share an id."""
    candidates, copies, shared_id = _candidates(docs, length, id_col, text_col)
    covered = candidates.join(_repeated(candidates), ["h", "c"]).where("low < doc").select("doc", F.expr("shiftright(at, 32)").alias("mark"), F.expr("cast(at & 4294967295 as int)").alias("start"))
    return covered, copies, shared_id


def longest_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, length): for each document with a window that another text has too, the longest of ``length``, twice that, and so on.

    A window of twice the length is named by the names of its halves, both of
    which must have survived. Of equal texts the smallest id stands for all.
    """
    candidates, _, _ = _candidates(docs, length, id_col, text_col)
    now = materialize(candidates.join(_repeated(candidates), ["h", "c"], "left_semi"), "level")
    found = None
    while not now.isEmpty():
        level = now.select("doc").distinct().withColumn("length", F.lit(length).cast("long"))
        found = level if found is None else found.unionByName(level)
        second = now.select("doc", (F.col("at") - length).alias("at"), F.col("h").alias("h2"), F.col("c").alias("c2"))
        twice = now.join(second, ["doc", "at"]).select(F.xxhash64("h", "h2", "c", "c2").alias("h"), F.hash("h", "c", "h2", "c2").alias("c"), "doc", "at")
        twice = materialize(twice, "level")
        now = materialize(twice.join(_repeated(twice), ["h", "c"], "left_semi"), "level")
        length *= 2
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc long, length long")
    return found.groupBy("doc").agg(F.max("length").alias("length"))


def substring_dedup(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and ``removed`` (spans of word positions, end exclusive)."""
    covered, copies, shared_id = repeated_windows(docs, length, id_col, text_col)
    id_type = docs.schema[id_col].dataType
    marks = covered.select("doc", "mark", "start", F.lit(False).alias("copy")).unionByName(copies.select("doc", "mark", F.lit(None).cast("int").alias("start"), F.lit(True).alias("copy")))
    marks = marks.groupBy("doc", "mark").agg(F.collect_list("start").alias("starts"), F.max("copy").alias("copy"))
    a = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc"), (a if shared_id else F.lit(0)).alias("a"))
    rows = rows.select("id", "text", "doc", F.expr(_MARK if shared_id else "0L").alias("mark"))
    joined = rows.join(marks, ["doc", "mark"], "left").select("id", "text", "starts", "copy")

    @task("words")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            words = [t.split() if t else [] for t in texts]
            starts, copy = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            removed, kept, spans = [], [], []
            for w, s, c in zip(words, starts, copy, strict=True):
                n = len(w)
                if c:
                    runs = [(0, n)] if n >= length else []
                elif s:
                    s = np.unique(np.asarray(s, np.int64))
                    cut_at = np.flatnonzero(s[1:] > s[:-1] + length)
                    runs = list(zip(s[np.r_[0, cut_at + 1]].tolist(), (s[np.r_[cut_at, len(s) - 1]] + length).tolist(), strict=True))
                else:
                    runs = []
                gone, at, parts = 0, 0, []
                for lo, hi in runs:
                    parts += w[at:lo]
                    gone, at = gone + hi - lo, hi
                parts += w[at:]
                removed.append(gone)
                kept.append(b" ".join(parts))
                spans.append([{"start": lo, "end": hi} for lo, hi in runs])
            yield pa.record_batch(
                [
                    rows.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["id", "n_words", "n_removed", "kept_text", "removed"],
            )

    schema = f"id {id_type.simpleString()}, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT i + o) AS p FROM win JOIN f USING (k), (SELECT unnest(range(13)) AS o) WHERE m < doc_id GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
