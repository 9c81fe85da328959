"""Media columns as lossless WebP: text bytes stored as pictures, read back, and features of what was read.

Defined results: a null or empty text is a payload of padding alone; equal texts
give equal files; repeated rows are stored as often as they occur; a null id
stays null; an empty table gives an empty result. A file that is null or cannot be
read (another format, a broken or shortened stream) has a null payload and feature
and no pictures; it does not stop the others. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import slices, task
from matrixlake.llm.webp import ROW, decode, decode_bytes, encode_bytes

PAD = b"\xff"
#: what a broken stream can raise
_BROKEN = (ValueError, IndexError, struct.error)


def _or_none(work, media: bytes | None):
    try:
        return work(media) if media else None
    except _BROKEN:
        return None


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + PAD * (-len(text) % ROW if text else ROW)


def feature_of(payload: bytes) -> str:
    """Which of 64 equal stretches of the samples are brighter than the whole: 16 hexadecimal digits."""
    data = np.frombuffer(payload, np.uint8)
    edge = np.arange(65) * len(data) // 64
    sums = np.add.reduceat(data, edge[:-1], dtype=np.int64)
    above = sums * len(data) > int(sums.sum()) * np.diff(edge)
    return np.packbits(above).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_bytes``, ``media``): each text's UTF-8 bytes, padded to rows of pixels, as a lossless WebP file."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @task("media")
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text_col, 4 << 20):
            yield pa.record_batch([rows.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([encode_bytes(payload_of(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(store, f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds ``payload`` (the samples read back) and ``feature``."""
    names = [c for c in media.columns if c not in ("payload", "feature")]
    media = media.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema) + ", payload binary, feature string"

    @task("media")
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, files in slices(batches, media_col, 4 << 20):
            got = [_or_none(decode_bytes, m) for m in files]
            yield pa.record_batch([*rows.columns, pa.array(got, pa.binary()), pa.array([feature_of(g) if g else None for g in got], pa.string())], names=[*names, "payload", "feature"])

    return media.mapInArrow(read, schema)


def to_pixels(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """A row per picture of each file: id, ``picture``, ``width``, ``height``, ``argb`` (rows of unsigned 32-bit values in longs)."""
    id_type = media.schema[id_col].dataType.simpleString()

    @task("media")
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, files in slices(batches, media_col, 4 << 20):
            ids = rows.column(0).to_pylist()
            found = [(i, k, p) for i, m in zip(ids, files, strict=True) for k, p in enumerate(_or_none(decode, m) or [])]
            yield pa.record_batch(
                [
                    pa.array([f[0] for f in found], rows.schema.field(0).type),
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array([f[2].shape[1] for f in found], pa.int32()),
                    pa.array([f[2].shape[0] for f in found], pa.int32()),
                    pa.array([f[2].reshape(-1).astype(np.int64) for f in found], pa.list_(pa.int64())),
                ],
                names=["id", "picture", "width", "height", "argb"],
            )

    return media.select(id_col, media_col).mapInArrow(read, f"id {id_type}, picture int, width int, height int, argb array<long>").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    stored = read_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
