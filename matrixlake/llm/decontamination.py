"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Benchmark items are cut into windows of ``length`` words (an item of fewer words
is one window). A window must be contained exactly, so the prefix that a set
join at containment 1 has to look up is one shingle: the window's rarest, by
counts over all documents. A document position that holds that shingle fixes
where the window would start; the window has to lie inside the document (length
and position bound) and its words are then compared.

Windows, shingles, counts and candidates are tables, so neither an item nor the
benchmark has a bound in size. Documents are scanned twice (to count shingles, to
list positions that may hold a prefix); bitmaps of bounded size keep what cannot
match from being a row: a bit set by another shingle costs work, never a result.
Tables are broadcast below ``BROADCAST_BYTES`` by their counted size, else joined
by a shuffle.

Defined results: a null or wordless text has no words, no hits and no items and
is not contaminated; null or wordless items match nothing; items with the same
id are one item with several texts; repeated documents are judged one by one; an
empty benchmark leaves every document clean. ``find_contamination`` ignores other
columns, ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import bitmap_of, bits_for, hash_split, in_bitmap, keep, materialize, mix, slices, task, unused, window_hashes

LENGTH = 13
SHINGLE = 3
BROADCAST_BYTES = 32 << 20
#: partitions of documents whose rows, a few numbers each, make one partition of the result
FEWER = 4
#: windows of an item that are handed on at a time
PART = 20_000
#: A-Z to a-z; a word is a run of 0-9, a-z and what is beyond ASCII
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def shingle_keys(h: np.ndarray, k: int) -> np.ndarray:
    return mix(window_hashes(h, k) + np.uint64(k))


def _windows(benchmark: DataFrame, item_col: str, text_col: str, length: int) -> DataFrame:
    """(item, w, n, k, shingles): each window of each item, as its words joined by blanks, with its n - k + 1 shingles of k words."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))

    @task("words")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            for i, w in enumerate(map(words, texts)):
                n = min(length, len(w))
                k = min(SHINGLE, n)
                for a in range(0, len(w) - n + 1 if n else 0, PART):
                    some = w[a : a + PART + n - 1]
                    many, each = len(some) - n + 1, n - k + 1
                    keys = np.lib.stride_tricks.sliding_window_view(shingle_keys(hash_split([some])[0], k), each)
                    columns = [
                        part.column(0).take(pa.array(np.full(many, i))),
                        pa.array([b" ".join(some[j : j + n]) for j in range(many)], pa.binary()),
                        pa.array(np.full(many, n, np.int32)),
                        pa.array(np.full(many, k, np.int32)),
                        pa.ListArray.from_arrays(np.arange(many + 1, dtype=np.int32) * each, pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64))),
                    ]
                    yield pa.record_batch(columns, names=["item", "w", "n", "k", "shingles"])

    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(cut, f"item {kind}, w binary, n int, k int, shingles array<long>")


def _listed(sizes: list[int], bitmap: bytes, bits: int):
    """Of each slice of texts: words, hashes, and by k the positions whose shingle may be in the bitmap."""

    def work(texts: list):
        split = [words(t) for t in texts]
        h, n = hash_split(split)
        owner = np.repeat(np.arange(len(n)), n)
        found = []
        for k in sizes:
            keys = shingle_keys(h, k)
            ok = in_bitmap(np.frombuffer(bitmap, np.uint8), keys, bits)
            ok &= owner[: len(keys)] == owner[k - 1 :][: len(keys)]
            at = np.flatnonzero(ok)
            found.append((k, at, keys[at]))
        return split, n, owner, found

    return work


def _hits(docs: DataFrame, benchmark: DataFrame, length: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, mark, n_words) of every row; (doc, mark, n_hit, hits, items) of the documents, by id and hash of the text, that some window occurs in."""
    spark = docs.sparkSession
    windows = materialize(_windows(benchmark, item_col, item_text_col, length), "windows")
    sizes = [r["k"] for r in windows.select("k").distinct().orderBy("k").collect()]
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("doc"), mark.alias("mark"), F.col(text_col).alias("text"))

    once = windows.groupBy("w").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("shingles").alias("shingles"))
    placed = materialize(once.select("w", "n", "k", F.posexplode("shingles").alias("j", "shingle")), "shingles")
    known = placed.select("shingle").distinct()
    bits = bits_for(placed.count())
    sent = spark.sparkContext.broadcast(bitmap_of(known, "shingle", bits).tobytes())

    @task("words")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _listed(sizes, sent.value, bits)
        for _, part in slices(batches, "text"):
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys for _, _, keys in work(part)[3])]), return_counts=True)
            if len(key):
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "m"])

    counts = texts.select("text").mapInArrow(count, "shingle long, m long").groupBy("shingle").agg(F.sum("m").alias("m"))
    # a window with a shingle that no document has occurs nowhere
    rarest = placed.join(counts, "shingle", "left").groupBy("w", "n", "k").agg(F.min(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "shingle", "j")).alias("x"))
    prefix = materialize(rarest.where("x.m > 0").select("w", "n", "k", "x.shingle", "x.j"), "prefix")
    n_prefix, bytes_prefix = prefix.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("w") + 64), F.lit(0))).first()
    bits2 = bits_for(n_prefix)
    sent2 = spark.sparkContext.broadcast(bitmap_of(prefix, "shingle", bits2).tobytes())

    @task("words")
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _listed(sizes, sent2.value, bits2)
        for rows, part in slices(batches, "text"):
            split, n, owner, found = work(part)
            first = np.cumsum(n) - n
            for k, at, keys in found:
                for a in range(0, len(at), PART):
                    p, own = at[a : a + PART], owner[at[a : a + PART]]
                    pos = p - first[own]
                    lo = np.maximum(0, pos - (length - k))
                    around = [b" ".join(split[d][x : i + length]) for d, x, i in zip(own.tolist(), lo.tolist(), pos.tolist(), strict=True)]
                    take = pa.array(own)
                    columns = [rows.column(0).take(take), rows.column(1).take(take), pa.array(n[own]), pa.array(keys[a : a + PART].view(np.int64)), pa.array(pos.astype(np.int64)), pa.array((pos - lo).astype(np.int32)), pa.array(around, pa.binary())]
                    yield pa.record_batch(columns, names=names)
            none = [pa.nulls(len(n), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(n), *none], names=names)

    kind = texts.schema["doc"].dataType.simpleString()
    names = ["doc", "mark", "n_words", "shingle", "pos", "before", "around"]
    seen = keep(texts.mapInArrow(look, f"doc {kind}, mark long, n_words long, shingle long, pos long, before int, around binary"))
    both = seen.where("shingle is not null").join(F.broadcast(prefix) if bytes_prefix <= BROADCAST_BYTES else prefix, "shingle").where("before >= j")
    same = F.expr("array_join(slice(split(cast(around as string), ' '), before - j + 1, n), ' ') = cast(w as string)")
    hits = materialize(both.where(same).select("doc", "mark", (F.col("pos") - F.col("j")).alias("start"), F.col("n").cast("long").alias("n"), "w").distinct(), "hits")

    spans = hits.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("hits"))

    @task("words")
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            held, covered = [], []
            for x in rows.column(2).to_pylist():
                s = np.array(sorted((h["start"], h["end"]) for h in x), np.int64).reshape(-1, 2)
                reach = np.maximum.accumulate(s[:, 1])
                new = np.r_[True, s[1:, 0] > reach[:-1]]
                lo, hi = s[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]
                held.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                covered.append(int((hi - lo).sum()))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(covered, pa.int64()), pa.array(held, rows.schema.field(2).type)], names=["doc", "mark", "n_hit", "hits"])

    spans = spans.mapInArrow(merge, f"doc {kind}, mark long, n_hit long, hits array<struct<start:long,end:long>>")
    of = windows.select("w", "item").distinct()
    listed = hits.select("doc", "mark", "w").distinct().join(of, "w").groupBy("doc", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "items")
    out = spans.join(listed, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
    return seen.where("shingle is null").select("doc", "mark", "n_words"), materialize(out.select("doc", "mark", "n_hit", "hits", "items"), "contaminated")


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, ``mark`` (hash of the text), ``n_words``, ``n_hit``, ``hits`` (merged spans of hit words, end exclusive) and ``items`` (ids found, sorted)."""
    rows, found = _hits(docs, benchmark, length, id_col, text_col, item_col, item_text_col)
    bound = found.agg(F.coalesce(F.sum(F.expr("64 + 16 * size(hits) + 32 * size(items)")), F.lit(0))).first()[0]
    found = found.withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    rows = rows.coalesce(max(rows.rdd.getNumPartitions() // FEWER, docs.sparkSession.sparkContext.defaultParallelism))
    joined = rows.join(F.broadcast(found) if bound <= BROADCAST_BYTES else found, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    none = [F.lit(0).cast("long"), *(F.array().cast(found.schema[c].dataType) for c in ("hits", "items"))]
    return joined.select(F.col("doc").alias(id_col), "mark", "n_words", *(F.coalesce(c, x).alias(c) for c, x in zip(("n_hit", "hits", "items"), none, strict=True)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, without the documents that ``judge`` finds contaminated; only id and text pass through Python."""
    found = judge(find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options), share)
    gone = materialize(found.where("contaminated").select(F.col(id_col).alias("doc"), "mark").distinct(), "gone")
    bound = gone.agg(F.coalesce(F.sum(32 + F.length(F.col("doc").cast("string"))), F.lit(0))).first()[0]
    mine = unused(docs.columns, "mark"), unused(docs.columns, "doc")
    gone = gone.select(F.col("doc").alias(mine[1]), F.col("mark").alias(mine[0]))
    return docs.join(F.broadcast(gone) if bound <= BROADCAST_BYTES else gone, docs[id_col].eqNullSafe(gone[mine[1]]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone[mine[0]]), "left_anti")


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_items`` and ``contaminated``: some word is hit, and one word in ``share`` at least."""
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    listed = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
found AS (SELECT doc_id, i, occ.n, item_id FROM occ JOIN win USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), (SELECT unnest(range(13)) AS o) WHERE o < n GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(l), 0) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
