"""MinHash near-deduplication with b-bit signatures.

A document's set are its distinct word shingles. Of each permutation's minimum
only the low two bits are kept, packed in longs; bands of full minima name
candidates. Pairs of one band are first compared by counting equal bit pairs,
corrected for the quarter of them that agree by chance; those not surely below
the threshold are confirmed on the full sets, exactly.

No pairs are formed within a bucket. Documents with equal sets are one class
with one representative. Then
1. each representative is compared with the smallest id of its buckets (one pair
   each), then with the smallest ids of its other buckets unless they already
   belong together;
2. buckets that still hold several components are joined with themselves across
   components; bounds on set sizes and a test of longer signatures are part of
   the join condition, so pairs that fail them are never rows.
After this every pair that shares a band and passes the signature test is either
in one component or was refuted, so no link between candidates is lost. With 32
bands of 5, a pair at similarity 0.8 shares none with probability 3e-6.

Defined results: a null, empty or wordless text has an empty set, is linked with
nothing and kept; a text of fewer words than a shingle is one shingle; rows that
share an id are one document (each row keeps its own ``n_shingles``); rows with a
null id are kept, with a null component. An empty table gives an empty result. Ids
of another type than integers are a TypeError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import hash_words, integer_ids, materialize, mix, slices, task, window_hashes
from matrixlake.llm.graph import connected_components

BANDS, ROWS = 32, 5
PERMS = BANDS * ROWS
BITS = 2
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1)
#: at similarity 0.8 a signature's estimate deviates by 0.038; a pair is refuted when it lies 4.5 of them below
SLACK = 0.17
#: permutations of the long signatures, of one bit each, of documents in mixed buckets (deviation 0.0133), which are refuted 4.5 below
LONG = 2048
LONG_SLACK = 0.06
#: ids are broadcast up to this many
BROADCAST_IDS = 2_000_000
_LONG_XOR = _rng.integers(0, 1 << 32, LONG, dtype=np.uint32)
_LONG_ODD = _rng.integers(0, 1 << 32, LONG, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their number by text."""
    h, n = hash_words(texts, lower=True)
    ends = np.cumsum(n)
    win = window_hashes(h, k)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    for i, (e, m) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
        if not m:
            continue
        s = np.unique(win[e - m : e - k + 1]) if m >= k else mix(window_hashes(h[e - m : e], m) + np.uint64(m))
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def minima(values: np.ndarray, sizes: np.ndarray, xor: np.ndarray = _XOR, odd: np.ndarray = _ODD) -> np.ndarray:
    """Minimum of each permutation over each non-empty set: one row a set."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    low = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.empty((len(xor), len(starts)), np.uint32)
    block = 1 << 15  # values at a time, so that they stay in the processor's cache
    firsts = [0, *(np.flatnonzero(np.diff(starts // block)) + 1).tolist(), len(starts)]
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if a == b:
            continue
        lo, hi = int(starts[a]), int(starts[b]) if b < len(starts) else len(low)
        x, at = low[lo:hi], starts[a:b] - lo
        for p in range(len(xor)):
            y = x ^ xor[p]
            y *= odd[p]
            out[p, a:b] = np.minimum.reduceat(y, at)
    return np.ascontiguousarray(out.T)


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), BANDS)).copy()
    grouped = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 in a long."""
    four = (low & np.uint32(3)).astype(np.uint8).reshape(len(low), -1, 4)
    return np.ascontiguousarray(four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6).view("<i8")


def packed_one(low: np.ndarray) -> np.ndarray:
    """The lowest bit of each minimum, 64 in a long."""
    return np.packbits((low & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little").view("<i8")


def estimate(x: str, y: str) -> str:
    """SQL: similarity of two signatures (arrays of longs), corrected for chance agreement of 1 in 4."""
    odd = [f"bit_count((({x}[{i}] ^ {y}[{i}]) | shiftrightunsigned({x}[{i}] ^ {y}[{i}], 1)) & 6148914691236517205)" for i in range(PERMS * BITS // 64)]
    return f"((1 - ({' + '.join(odd)}) / {PERMS}D) - 0.25D) / 0.75D"


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, sa, sb, sig, bands) for every row; sa and sb name the set."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    @task("words")
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", most=5000):
            values, sizes = shingle_sets(texts, shingle)
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            sa, sb = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            sig: list = [[]] * len(sizes)
            bands: list = [[]] * len(sizes)
            if len(some):
                sa[some] = np.add.reduceat(mix(values), starts)
                sb[some] = np.bitwise_xor.reduceat(mix(values + np.uint64(0x9E3779B97F4A7C15)), starts)
                low = minima(values, sizes)
                for i, s, b in zip(some.tolist(), packed(low), band_keys(low), strict=True):
                    sig[i], bands[i] = s, b
            longs = pa.list_(pa.int64())
            yield pa.record_batch([part.column(0), pa.array(sizes), pa.array(sa.view(np.int64)), pa.array(sb.view(np.int64)), pa.array(sig, longs), pa.array(bands, longs)], names=["doc", "n", "sa", "sb", "sig", "bands"])

    return rows.mapInArrow(sign, "doc long, n long, sa long, sb long, sig array<long>, bands array<long>")


def long_signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, n, s0, s1, ...): one bit each of many more minima, for texts that are in mixed buckets."""

    @task("words")
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches, "text", 1 << 19, 1000):
            values, sizes = shingle_sets(found, shingle)
            some = pa.array(sizes > 0)
            if sizes.any():
                yield pa.record_batch([part.column(0).filter(some), pa.array(sizes[sizes > 0]), *(pa.array(c) for c in np.ascontiguousarray(packed_one(minima(values, sizes, _LONG_XOR, _LONG_ODD)).T))], names=["node", "n", *(f"s{i}" for i in range(LONG // 64))])

    return texts.select("node", "text").mapInArrow(sign, "node long, n long, " + ", ".join(f"s{i} long" for i in range(LONG // 64)))


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets have 100 * intersection >= percent * union."""
    joined = pairs.join(texts.toDF("x", "tx"), "x").join(texts.toDF("y", "ty"), "y").select("x", "y", "tx", "ty")

    @task("words")
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for part, tx in slices(batches, "tx"):
            ids = part.column(1).to_pylist()
            ty = part.column(3).cast(pa.binary())
            values, sizes = shingle_sets(tx, shingle)
            ends, ok = np.cumsum(sizes), np.zeros(len(tx), bool)
            for i in range(len(tx)):
                if ids[i] != last:
                    last, mine = ids[i], shingle_sets([ty[i].as_py()], shingle)[0]
                theirs = values[ends[i] - sizes[i] : ends[i]]
                both = len(np.intersect1d(theirs, mine, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(theirs) + len(mine) - both)
            yield pa.record_batch([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], names=["x", "y"])

    return joined.mapInArrow(compare, "x long, y long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    integer_ids(docs, id_col)
    signed = materialize(signatures(docs, shingle, id_col, text_col), "signatures")
    named = signed.where("n > 0 and doc is not null")
    # only sets that several documents have; written, so that a hot one is split in the joins
    several = named.groupBy("sa", "sb", "n").agg(F.min("doc").alias("rep"), F.max("doc").alias("high")).where("rep < high").select("sa", "sb", "n", "rep")
    several = materialize(several, "equal-sets")
    reps = materialize(named.join(several, ["sa", "sb", "n"], "left").where("rep is null or doc = rep").select(F.col("doc").alias("rep"), "n", "sig", "bands"), "representatives")
    slot = reps.select("rep", F.explode("bands").alias("band"))
    lead = slot.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("band", "lead")
    shared = materialize(slot.join(lead, "band"), "shared")
    pairs = materialize(shared.where("rep <> lead").select(F.col("rep").alias("x"), F.col("lead").alias("y")).distinct(), "leads")
    member = materialize(shared.select(F.col("rep").alias("node")).distinct(), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where("text is not null")
    texts = materialize(texts.join(F.broadcast(member) if member.count() <= BROADCAST_IDS else member, "node", "left_semi"), "texts")
    sigs = reps.join(member.withColumnRenamed("node", "rep"), "rep", "left_semi").select("rep", "sig", "n")

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sigs.toDF("x", "sx", "nx"), "x").join(sigs.toDF("y", "sy", "ny"), "y")
        return both.where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) and {estimate('sx', 'sy')} >= {percent / 100 - SLACK}").select("x", "y")

    first = materialize(confirm(likely(pairs.groupBy("x").agg(F.min("y").alias("y"))), texts, shingle, percent), "confirmed")
    up = lambda c, as_name: first.select(F.col("x").alias(c), F.col("y").alias(as_name))
    rest = pairs.join(up("x", "px"), "x", "left").join(up("y", "py"), "y", "left").where("coalesce(px, x) <> coalesce(py, y)").select("x", "y")
    links = first.unionByName(materialize(confirm(likely(rest), texts, shingle, percent), "confirmed"))
    parts = materialize(connected_components(links), "components")
    tagged = shared.join(parts.toDF("rep", "c"), "rep", "left").select("band", "rep", F.coalesce("c", "rep").alias("c"))
    split = tagged.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band", "low")
    held = materialize(tagged.join(split, "band"), "split")
    joined = None  # components tied together by links across them
    if not held.isEmpty():
        wanted = held.select(F.col("rep").alias("node")).distinct()
        sketch = materialize(long_signatures(texts.join(wanted, "node", "left_semi"), shingle), "sketches")
        longs = range(LONG // 64)
        bands = reps.join(wanted.withColumnRenamed("node", "rep"), "rep", "left_semi").select("rep", "bands")
        held = held.join(sketch.withColumnRenamed("node", "rep").join(bands, "rep"), "rep")
        left = held.where("c <> low").select("band", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("bands").alias("bx"), *(F.col(f"s{i}").alias(f"x{i}") for i in longs))
        right = held.select("band", F.col("band").alias("right_band"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), (F.col("c") == F.col("low")).alias("base"), F.col("bands").alias("by"), *(F.col(f"s{i}").alias(f"y{i}") for i in longs))
        # a pair is made in the first of the buckets that it shares;
        # a similarity of t leaves at most (1 - t) / 2 of the bits unequal, but for chance
        most = int((1 - percent / 100 + LONG_SLACK) / 2 * LONG)
        alike = f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) and {' + '.join(f'bit_count(x{i} ^ y{i})' for i in longs)} <= {most} and array_min(array_intersect(bx, by)) = right_band"
        near = left.join(right, (left["band"] == right["band"]) & F.expr(f"cx <> cy and (base or x > y) and {alike}")).select("x", "y").distinct()
        more = materialize(confirm(near, texts, shingle, percent), "confirmed")
        if not more.isEmpty():
            of = lambda c: parts.toDF(c, f"c{c}")
            ends = more.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("cx", "x").alias("a"), F.coalesce("cy", "y").alias("b"))
            joined = materialize(connected_components(ends), "components")
    top = reps.select("rep").distinct().join(parts.toDF("rep", "c"), "rep", "left").select("rep", F.coalesce("c", "rep").alias("c"))
    if joined is not None:
        top = top.join(joined.toDF("c", "d"), "c", "left").select("rep", F.coalesce("d", "c").alias("c"))
    top = materialize(top, "tops")  # read back, so that the many copies of one text are split in the join
    rows = signed.select("doc", "n", "sa", "sb").join(several, ["sa", "sb", "n"], "left").select("doc", "n", "sa", "sb", F.when(F.col("n") > 0, F.coalesce("rep", "doc")).alias("rep"))
    if not named.groupBy("doc").agg(F.count_distinct("sa", "sb", "n").alias("k")).where("k > 1").isEmpty():
        # one id with several sets ties their components together
        tied = materialize(connected_components(rows.where("rep is not null").join(top, "rep").select(F.col("doc").alias("a"), F.col("c").alias("b")).unionByName(top.select(F.col("rep").alias("a"), F.col("c").alias("b")))), "components")
        parts = rows.select("doc", "n").join(tied.toDF("doc", "c"), "doc", "left")
    else:
        parts = rows.where("doc is not null").join(top, "rep", "left").select("doc", "n", "c").unionByName(rows.where("doc is null").select("doc", "n", F.lit(None).cast("long").alias("c")))
    kind = docs.schema[id_col].dataType
    out = parts.select("doc", "n", F.coalesce("c", "doc").alias("c"))
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("c").cast(kind).alias("component_id"), F.coalesce(F.col("c") == F.col("doc"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON ends.a = reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""
