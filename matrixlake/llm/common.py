"""What the text operators share: slices of Arrow batches, word hashes, window hashes, bitmaps, written tables.

Texts reach Python as UTF-8 bytes in Arrow batches. A batch is worked off in
slices of a bounded number of bytes, so memory follows the slice and not the
batch; only one very long text can exceed it.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
CACHE_WORDS = 300_000
BITMAP_BITS = 27
_MULT = np.uint64(0x9E3779B97F4A7C15)


_caches: dict[str, Callable[[], None]] = {}


def cached_by(owner: str, drop: Callable[[], None]) -> None:
    """Name a cache that a worker keeps between tasks, and how to drop it."""
    _caches[owner] = drop


def task(owner: str):
    """For functions over batches: caches of other owners go before the work, freed memory goes back after it.

    Workers are used again by later stages; what one stage keeps must not add to
    what the next one needs. The session's Arrow batches are bounded by bytes, too:
    ten thousand long texts, Spark's bound by rows, may be any size.
    """
    _bound_batches(SparkSession.getActiveSession())

    def wrap(work):
        @functools.wraps(work)
        def run(batches):
            _claim(owner)
            _trim()
            try:
                yield from work(batches)
            finally:
                _trim()

        return run

    return wrap


def _bound_batches(spark: SparkSession | None) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _claim(owner: str) -> None:
    for name, drop in _caches.items():
        if name != owner:
            drop()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one in the local temporary folder only where that is unset and Spark runs in this process alone (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "matrixlake-checkpoints")
    return root.rstrip("/") + "/matrixlake"


def unused(columns, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns (Spark does not tell case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of what is run inside are deleted when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def keep(df: DataFrame) -> DataFrame:
    """Work out into blocks on the executors' disks, at once: two reads of one plan would both do it. Lost blocks are worked out again.

    For tables with a partition for each part of the input, without a shuffle.
    ``materialize`` creates a file for each: without its native library Hadoop's local
    file system has the JVM start a chmod for every file, and a process that starts
    shares the executor's whole memory for some milliseconds, so what sums memory
    over processes counts that twice.
    """
    df.persist(StorageLevel.DISK_ONLY).count()
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no result reads any more, before the driver ends."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def integer_ids(df: DataFrame, id_col: str) -> None:
    """For operators that take the smallest id: a clear error instead of a cast that fails in a task."""
    kind = df.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"column {id_col} must hold integers, not {kind}")


def as_bytes(column: pa.Array) -> pa.Array:
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    return column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.binary())


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, their texts as bytes or None), at most ``limit`` bytes (or one row) and ``most`` rows at a time."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = as_bytes(batch.column(batch.schema.get_field_index(text)))
        size = np.asarray(column.offsets if hasattr(column, "offsets") else np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1], dtype=np.int64)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
            to = min(to, n, at + most)
            yield batch.slice(at, to - at), column.slice(at, to - at).to_pylist()
            at = to


class WordHash(dict):
    """64-bit hashes of words, computed once while the word stays in the bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHash()
cached_by("words", _words.clear)


def hash_words(texts: list, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) and each text's number of words."""
    return hash_split([(t.lower() if lower else t).split() if t else () for t in texts])


def hash_split(split: list) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts that are lists of words already."""
    n = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter((h for words in split for h in map(_words.__getitem__, words)), np.uint64, int(n.sum())), n


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int, mult: np.uint64 = _MULT) -> np.ndarray:
    """Hash of each run of k words of the concatenated texts; runs over a text's end are the caller's to drop."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= mult
        out += h[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(x) - k + 1)
    have, out = 1, x
    while have < k:
        step = min(have, k - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out[:n]


def bits_for(n: int, most: int = BITMAP_BITS) -> int:
    """So many bits that at most one in 64 is set by n keys, while the bitmap has at most 2**most bits (27: 16 MB)."""
    return max(16, min(most, (64 * n).bit_length()))


def bitmap_of(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap over the top bits of 64-bit hashes: at most 2**bits bits reach the driver, whatever the number of keys."""
    slot = F.expr(f"shiftrightunsigned({column}, {64 - bits})")
    with dropping_shuffles(keys.sparkSession):
        rows = keys.select(slot.alias("s")).groupBy(F.expr("s div 32768").alias("b")).agg(F.expr("bitmap_construct_agg(s % 32768)").alias("m")).toPandas()
    out = np.zeros((max(1, 1 << (bits - 15)), 4096), np.uint8)
    for b, m in zip(rows["b"], rows["m"], strict=True):
        out[int(b)] = np.frombuffer(bytes(m), np.uint8)
    return out.reshape(-1)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    s = h >> np.uint64(64 - bits)
    return (bitmap[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bucket(doc_id: str, of: int) -> F.Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of
