"""Lossless pictures: exact round trips over every feature of the format."""

import random

import cases
import numpy as np
import pytest
import writer

from matrixlake.llm import webp, webp_columns


def picture(kind, height, width, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "noise":
        return rng.integers(0, 1 << 32, (height, width), dtype=np.uint32)
    if kind == "smooth":
        y, x = np.mgrid[:height, :width]
        return webp.join(np.stack([(x * 3 + y) & 255, (x + y * 2) & 255, (x * y) & 255, np.full_like(x, 255)], -1))
    colors = rng.integers(0, 1 << 32, int(kind), dtype=np.uint32)
    return colors[rng.integers(0, int(kind), (height, width))]


@pytest.mark.parametrize("kind,transforms", [
    ("noise", ()), ("noise", ("cross",)), ("noise", ("predictor",)), ("smooth", ("predictor", "cross", "green")), ("smooth", ("green", "predictor")),
    ("1", ("palette",)), ("2", ("palette",)), ("3", ("palette",)), ("4", ("palette",)), ("9", ("palette", "predictor")), ("16", ("palette",)), ("40", ("palette",)), ("200", ()),
])
@pytest.mark.parametrize("cache_bits,repeats,group_bits", [(0, False, 0), (0, True, 0), (5, True, 0), (3, True, 2), (11, False, 3)])
def test_round_trip(kind, transforms, cache_bits, repeats, group_bits):
    p = picture(kind, 13, 21)
    media = writer.encode(p, transforms, cache_bits, repeats, group_bits)
    (got,) = webp.decode(media)
    assert np.array_equal(got, p)


@pytest.mark.parametrize("size", [(1, 1), (1, 50), (50, 1), (40, 40)])
def test_sizes(size):
    p = picture("smooth", *size)
    assert np.array_equal(webp.decode(writer.encode(p, ("predictor", "green"), 4))[0], p)


def test_payloads():
    r = random.Random(1)
    for n in (1, 2, 3, 9, 200):
        for k in (1, 2, 3, 5, 17, 100, 129, 256):
            data = bytes(r.choices(r.sample(range(256), k), k=576 * n))
            media = webp.encode_bytes(data)
            assert webp.decode_bytes(media) == data
            assert media == webp.encode_bytes(data)
    with pytest.raises(ValueError):
        webp.encode_bytes(b"")
    with pytest.raises(ValueError):
        webp.encode_bytes(b"x" * 577)


def test_slow_and_fast_ways_agree():
    data = bytes(random.Random(3).choices(range(97, 130), k=576 * 3))
    media = webp.encode_bytes(data)
    bits = webp.Bits(media[20:])
    bits.at = 40
    (undo,), _, _ = webp.read_transforms(bits, webp.ROW, 3)
    code = webp.read_codes(bits, webp.ROW, 3, True)[4][0][0]
    read = np.array([code.read(bits) for _ in range(len(data))], np.uint32)
    assert ((undo(read.reshape(3, webp.ROW) << 8) >> 8) & 255).astype(np.uint8).tobytes() == data


def test_several_pictures(monkeypatch):
    monkeypatch.setattr(webp, "MAX_SIDE", 4)
    data = bytes(range(256)) * 9 * 5
    media = webp.encode_bytes(data)
    assert len(webp.decode(media)) == 5 and webp.decode_bytes(media) == data


@pytest.mark.parametrize("cut", [5, 19, 30, -1])
def test_damaged(cut):
    media = webp.encode_bytes(b"some text" * 64)
    with pytest.raises(Exception):  # noqa: B017
        webp.decode(media[:cut])


def test_columns(spark):
    df = cases.frame(spark, clash=("media", "payload", "n_bytes", "id"))
    rows = webp_columns.read_media(webp_columns.to_media(df)).collect()
    want = sorted((d is None, d or 0, webp_columns.payload_of((t or "").encode()), len((t or "").encode())) for d, t in cases.texts())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["payload"]), r["n_bytes"]) for r in rows) == want
    assert len({bytes(r["media"]) for r in rows}) == len({bytes(r["payload"]) for r in rows}) and all(len(r["feature"]) == 16 for r in rows)
    assert webp_columns.read_media(webp_columns.to_media(cases.empty(spark))).count() == 0


def test_pixels(spark):
    p = picture("smooth", 5, 7)
    df = spark.createDataFrame([(1, bytearray(writer.encode(p, ("predictor",)))), (2, None)], "k long, media binary")
    (r,) = webp_columns.to_pixels(df, "k").collect()
    assert (r["width"], r["height"], r["argb"]) == (7, 5, p.reshape(-1).astype(int).tolist())


def test_stored_texts_use_palette_codes_and_references():
    """What the encoder writes goes through the palette, codes of unequal lengths and back-references."""
    from matrixlake.llm import webp

    text = b"a line that comes again, word by word\n" * 5 + b"other words, each once; 1 2 3 " * 3
    payload = text + b"\xff" * (-len(text) % webp.ROW)
    media = webp.encode_bytes(payload)
    bits = webp.Bits(media[20:])
    bits.at = 40
    undo, now, _ = webp.read_transforms(bits, webp.ROW, len(payload) // webp.ROW)
    assert len(undo) == 1 and now == webp.ROW
    _, _, _, _, (groups,) = webp.read_codes(bits, now, 1, True)
    assert len({n for _, n in groups[0].table}) > 3
    assert [r[2] for r in webp.references(payload, np.frombuffer(payload, np.uint8))] == [38, 38, 38, 38, 1]
    assert webp.decode_bytes(media) == payload and len(media) < len(payload) // 2


def test_fast_and_slow_decoding_agree(monkeypatch):
    import random

    from matrixlake.llm import webp

    r = random.Random(3)
    words = [bytes(r.choices(b"abcdefgh XYZ09,.\n\xc3\xa9", k=r.randint(1, 40))) for _ in range(60)]
    for n in (1, 30, 400):
        text = b"".join(r.choice(words) + (b"\n" if r.random() < 0.2 else b" ") for _ in range(n)) + b"q" * r.randint(0, 5000)
        payload = text + b"\xff" * (-len(text) % webp.ROW)
        media = webp.encode_bytes(payload)
        assert webp.decode_bytes(media) == payload
        with monkeypatch.context() as m:
            m.setattr(webp, "WIDE", 0)  # pixel by pixel
            assert webp.decode_bytes(media) == payload
        for cut in (1, len(media) // 3):
            short = media[20 : len(media) - cut - (media[16] & 1)]
            with pytest.raises((ValueError, IndexError)):
                webp.decode_stream(short[: max(6, len(short) // 2)])


def test_extended_container_and_broken_files(spark):
    import struct

    from matrixlake.llm import webp, webp_columns

    media = webp.encode_bytes(b"x y z " * 96)
    chunk = media[12:]
    extra = b"VP8X" + struct.pack("<I", 10) + bytes(10) + b"EXIF" + struct.pack("<I", 3) + b"abc\0"
    wide = b"RIFF" + struct.pack("<I", 4 + len(extra) + len(chunk)) + b"WEBP" + extra + chunk
    assert webp.decode_bytes(wide) == b"x y z " * 96
    files = spark.createDataFrame([(1, wide), (2, media[:40]), (3, b"GIF89a"), (4, None), (5, media)], "id long, media binary")
    got = {r["id"]: r["payload"] for r in webp_columns.read_media(files).collect()}
    assert {k: v is not None for k, v in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert {r["id"] for r in webp_columns.to_pixels(files, "id").collect()} == {1, 5}
