"""Lossless WebP (VP8L) streams: a decoder for the whole format, and an encoder for byte payloads.

The decoder reads prefix codes (single or in groups chosen by an entropy image),
back-references with two-dimensional short distances and the colour cache, and
undoes the predictor, cross-colour, subtract-green and palette transforms. Where
only the green samples carry information and there is no colour cache, up to three
codes that begin at a bit are looked up by the next 16 bits, for every bit at once;
one pass follows them through the stream, and the samples are looked up together; any other stream is decoded
pixel by pixel. What stands before the pixels is read once while the same bits
come again.

The encoder stores bytes as rows of 576 pixels behind a palette, with prefix codes
of unequal lengths and back-references for runs of one byte and for lines that
were there before. Code lengths follow fixed weights of the classes of bytes that
occur (a rule, not the text's own counts), so that few different headers exist.
The other transforms and the colour cache would enlarge such files: neighbouring
bytes of a text are not near each other in value, and there is one sample a pixel.
More bytes than one picture may have rows are stored as several pictures, one
after the other.
"""

from __future__ import annotations

import heapq
import struct
from itertools import repeat

import numpy as np

ROW = 576
MAX_SIDE = 16384

# Fixed values of the format
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD


class Bits:
    """Reader of a stream's bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends too early")
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        out = (int.from_bytes(self.data[a:b], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return (int.from_bytes(self.data[a : a + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


def reverse(x: int, n: int) -> int:
    return int(format(x, f"0{n}b")[::-1], 2) if n else 0


class Code:
    """A canonical prefix code, from the lengths of its symbols."""

    def __init__(self, lengths: dict[int, int]):
        used = {s: n for s, n in lengths.items() if n}
        self.only = next(iter(used)) if len(used) == 1 else None
        self.top = max(used.values(), default=0)
        if self.only is None and sum(1 << (self.top - n) for n in used.values()) != 1 << self.top:
            raise ValueError("the prefix code is not complete")
        self.table: list = []
        self.groups = None
        if self.only is None:
            self.spread(used)

    def spread(self, used: dict[int, int]) -> None:
        self.table, code, last = [None] * (1 << self.top), 0, 0
        for n, s in sorted((n, s) for s, n in used.items()):
            code <<= n - last
            last = n
            for x in range(reverse(code, n), 1 << self.top, 1 << n):
                self.table[x] = (s, n)
            code += 1

    def read(self, bits: Bits) -> int:
        """The next symbol."""
        if self.only is not None:
            return self.only
        s, n = self.table[bits.peek(self.top)]
        bits.at += n
        if bits.at > bits.end:
            raise ValueError("the stream ends too early")
        return s


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        return Code({first: 1, bits.read(8): 1} if two else {first: 1})
    count = 4 + bits.read(4)
    lengths = Code({CODE_LENGTH_ORDER[i]: n for i in range(count) if (n := bits.read(3))})
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    out: dict[int, int] = {}
    at, before = 0, 8
    while at < size and left:
        left -= 1
        n = lengths.read(bits)
        if n < 16:
            if n:
                out[at] = before = n
            at += 1
        elif n == 16:
            for _ in range(3 + bits.read(2)):
                out[at] = before
                at += 1
        else:
            at += 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
    if at > size:
        raise ValueError("too many code lengths")
    return Code(out)


def extended(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


WIDE = 16
TOGETHER = 3


def groups_of(code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the next 16 bits: how many bits the samples take that they hold whole (three at most), their number, the samples."""
    if code.groups is None:
        size = np.array([n if x < 256 else 0 for x, n in code.table], np.uint8)  # 0: not a sample
        value = np.array([min(x, 255) for x, _ in code.table], np.uint8)
        window, mask = np.arange(1 << WIDE, dtype=np.uint32), np.uint32((1 << code.top) - 1)
        bits, count, samples = (np.zeros((1 << WIDE, *more), np.uint8) for more in ((), (), (TOGETHER,)))
        open_ = np.ones(1 << WIDE, bool)
        for k in range(TOGETHER):
            left = (window >> bits.astype(np.uint32)) & mask
            n = size[left]
            open_ &= (n > 0) & (bits + n <= WIDE)
            samples[open_, k] = value[left[open_]]
            bits[open_] += n[open_]
            count += open_
        code.groups = bits, count, samples
    return code.groups


def unpack(bits: Bits, green: Code, distance: Code, width: int, total: int) -> np.ndarray:
    """Green samples of an image whose other samples are constant and that has no colour cache."""
    size, count, samples = groups_of(green)
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, len(bits.data) - first, first)
    raw = np.concatenate([raw, np.zeros(2, np.uint8)]).astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    step = np.empty((len(wide), 8), np.uint8)
    for k in range(8):
        step[:, k] = size[(wide >> np.uint32(k)).astype(np.uint16)]
    step = step.tobytes() + bytes(2 * WIDE)
    out = np.empty(total, np.uint8)
    done, p, last = 0, bits.at - 8 * first, bits.end - 8 * first
    every = np.arange(TOGETHER)
    while done < total:
        starts: list[int] = []
        add = starts.append
        for _ in repeat(None, total - done):
            n = step[p]
            if not n:
                break
            add(p)
            p += n
        at = np.array(starts, np.int64)
        window = (wide[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.uint16)
        held = np.cumsum(count[window], dtype=np.int64)
        got = samples[window][every < count[window][:, None]][: total - done]
        out[done : done + len(got)] = got
        done += len(got)
        if done == total:  # the last group may reach into what follows the image
            k = int(np.searchsorted(held, len(got)))
            bits.at = int(at[k]) + 8 * first
            for _ in range(len(got) - int(held[k] - count[window[k]])):
                green.read(bits)
            return out
        if p >= last:
            raise ValueError("the stream ends too early")
        bits.at = p + 8 * first
        length, d = read_reference(bits, green.read(bits) - 256, distance, width, done)
        length = min(length, total - done)
        source = out[done - d : done]
        out[done : done + length] = source[:length] if d >= length else np.resize(source, length)
        done, p = done + length, bits.at - 8 * first
    bits.at = p + 8 * first
    return out


def read_reference(bits: Bits, code: int, distance: Code, width: int, n: int) -> tuple[int, int]:
    """(length, distance) of a back-reference at pixel n."""
    length = extended(bits, code)
    d = extended(bits, distance.read(bits))
    if d > 120:
        d -= 120
    else:
        x, y = SHORT_DISTANCES[d - 1]
        d = max(1, x + y * width)
    if d > n:
        raise ValueError("a back-reference points before the image")
    return length, d


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image, row by row."""
    return read_body(bits, read_codes(bits, width, height, main), width, height)


def read_codes(bits: Bits, width: int, height: int, main: bool) -> tuple:
    """What stands before the pixels: size of the colour cache, blocks and their groups of codes, the groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, across, choose = 0, 1, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        choose = ((read_pixels(bits, across, -(-height >> block), False) >> 8) & 0xFFFF).tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    return cache_bits, block, across, choose, [[read_code(bits, n) for n in sizes] for _ in range(max(choose) + 1 if choose else 1)]


def read_body(bits: Bits, codes: tuple, width: int, height: int) -> np.ndarray:
    cache_bits, block, across, choose, groups = codes
    cache = [0] * (1 << cache_bits) if cache_bits else []
    total = width * height
    green, red, blue, alpha, distance = groups[0]
    if choose is None and not cache and None not in (red.only, blue.only, alpha.only):
        rest = (alpha.only << 24) | (red.only << 16) | blue.only
        if green.only is not None and green.only < 256:
            return np.full(total, rest | (green.only << 8), np.uint32)
        if green.only is None and green.top <= WIDE:
            return (unpack(bits, green, distance, width, total).astype(np.uint32) << np.uint32(8)) | np.uint32(rest)
    out: list[int] = []
    filled = 0  # pixels that are in the cache already

    def fill():
        nonlocal filled
        for v in out[filled:]:
            cache[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        filled = len(out)

    while (n := len(out)) < total:
        if choose:
            green, red, blue, alpha, distance = groups[choose[(n // width >> block) * across + (n % width >> block)]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append((a << 24) | (r << 16) | (s << 8) | b)
        elif s < 280:
            length, d = read_reference(bits, s - 256, distance, width, n)
            for i in range(n, min(total, n + length)):
                out.append(out[i - d])
        else:
            fill()
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def split(argb: np.ndarray) -> np.ndarray:
    """Samples as blue, green, red, alpha."""
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(*argb.shape, 4)


def join(samples: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(samples.astype(np.uint8)).view("<u4").reshape(samples.shape[:-1]).astype(np.uint32)


def predict(mode: int, left, top, top_left, top_right):
    """The predictor's value; samples as rows of four signed integers."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        nearer_left = np.abs(top - top_left).sum() < np.abs(left - top_left).sum()
        return left if nearer_left else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        step = mean - top_left
        return np.clip(mean + np.trunc(step / 2).astype(np.int64), 0, 255)  # division towards zero
    simple = (
        lambda: np.array([0, 0, 0, 255]), lambda: left, lambda: top, lambda: top_right, lambda: top_left,
        lambda: half(half(left, top_right), top), lambda: half(left, top_left), lambda: half(left, top), lambda: half(top_left, top),
        lambda: half(top, top_right), lambda: half(half(left, top_left), half(top, top_right)),
    )
    return simple[mode]() if mode < len(simple) else np.array([0, 0, 0, 255])


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = pixels.shape
    out = split(pixels).astype(np.int64)
    for y in range(height):
        for x in range(width):
            if not y:
                p = out[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif not x:
                p = out[y - 1, 0]
            else:
                corner = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                p = predict(int(modes[y >> size_bits, x >> size_bits]), out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], corner)
            out[y, x] = (out[y, x] + p) & 255
    return join(out)


def color_delta(multiplier: np.ndarray, sample: np.ndarray) -> np.ndarray:
    return (multiplier.astype(np.int8).astype(np.int64) * sample.astype(np.uint8).astype(np.int8)) >> 5


def undo_cross_color(pixels: np.ndarray, factors: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = pixels.shape
    f = split(factors)[(np.arange(height) >> size_bits)[:, None], (np.arange(width) >> size_bits)[None]]
    s = split(pixels).astype(np.int64)
    s[..., 2] = (s[..., 2] + color_delta(f[..., 0], s[..., 1])) & 255
    s[..., 0] = (s[..., 0] + color_delta(f[..., 1], s[..., 1]) + color_delta(f[..., 2], s[..., 2])) & 255
    return join(s)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    s = split(pixels).astype(np.int64)
    s[..., 0] = (s[..., 0] + s[..., 1]) & 255
    s[..., 2] = (s[..., 2] + s[..., 1]) & 255
    return join(s)


def undo_palette(pixels: np.ndarray, table: np.ndarray, packed_bits: int, width: int) -> np.ndarray:
    green = (pixels >> 8) & 255
    if packed_bits:
        each = 8 >> packed_bits
        x = np.arange(width)
        green = (green[:, x >> packed_bits] >> ((x & ((1 << packed_bits) - 1)) * each).astype(np.uint32)) & ((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[green]


_known: dict[tuple[int, bytes], list[tuple[int, int, list, int, tuple]]] = {}


def decode_stream(data: bytes) -> np.ndarray:
    """ARGB pixels, height by width, of what a VP8L chunk holds."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now, codes = _header(bits, width, height)
    pixels = read_body(bits, codes, now, height).reshape(height, now)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


def _header(bits: Bits, width: int, height: int) -> tuple[list, int, tuple]:
    """Transforms, width and codes of the pixels; bits read before are not read again where they do not depend on the height."""
    key = width, bits.data[5:21]
    for n, value, undo, now, codes in _known.get(key, ()):
        if bits.at + n <= bits.end and int.from_bytes(bits.data[5 : 5 + (n + 7) // 8], "little") & ((1 << n) - 1) == value:
            bits.at += n
            return undo, now, codes
    start = bits.at
    undo, now, tall = read_transforms(bits, width, height)
    codes = read_codes(bits, now, height, True)
    if not tall and codes[3] is None:
        n = bits.at - start
        if len(_known) > 500:
            _known.clear()
        _known.setdefault(key, []).append((n, int.from_bytes(bits.data[5 : 5 + (n + 7) // 8], "little") & ((1 << n) - 1), undo, now, codes))
    return undo, now, codes


def read_transforms(bits: Bits, width: int, height: int) -> tuple[list, int, bool]:
    """How to undo the transforms, in order; the width of the coded pixels; whether that depends on the height."""
    undo, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is given twice")
        seen.add(kind)
        if kind < 2:
            size_bits = bits.read(3) + 2
            w, h = -(-now >> size_bits), -(-height >> size_bits)
            data_of = read_pixels(bits, w, h, False).reshape(h, w)
            if kind:
                undo.append(lambda p, d=data_of, b=size_bits: undo_cross_color(p, d, b))
            else:
                undo.append(lambda p, d=(data_of >> 8) & 15, b=size_bits: undo_predictor(p, d, b))
        elif kind == 2:
            undo.append(undo_subtract_green)
        else:
            n = bits.read(8) + 1
            table = join(np.cumsum(split(read_pixels(bits, n, 1, False)).astype(np.int64), axis=0) & 255)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda p, t=table, b=packed, w=now: undo_palette(p, t, b, w))
            now = -(-now >> packed)
    return undo, now, bool(seen & {0, 1})


def decode(media: bytes) -> list[np.ndarray]:
    """The pictures of one or more RIFF files, one after the other; of an extended file, its lossless chunk."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        if end > len(media):
            raise ValueError("the file ends too early")
        chunk, found = at + 12, False
        while chunk + 8 <= end and not found:
            n = struct.unpack_from("<I", media, chunk + 4)[0]
            if chunk + 8 + n > end:
                raise ValueError("the file ends too early")
            if media[chunk : chunk + 4] == b"VP8L":
                out.append(decode_stream(media[chunk + 8 : chunk + 8 + n]))
                found = True
            chunk += 8 + n + (n & 1)
        if not found:
            raise ValueError("the file has no lossless picture")
        at = end + (end - at & 1)
    return out


def container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(weights: dict[int, float], limit: int) -> dict[int, int]:
    """Lengths of a prefix code (Huffman's); small weights are raised until no code is longer than ``limit``."""
    if len(weights) == 1:
        return dict.fromkeys(weights, 1)
    floor = 0.0
    while True:
        heap = [(max(w, floor), s, (s,)) for s, w in sorted(weights.items())]
        heapq.heapify(heap)
        out = dict.fromkeys(weights, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], (*a[2], *b[2])))
        if max(out.values()) <= limit:
            return out
        floor = max(2 * floor, sum(weights.values()) / (1 << limit))


def codes_of(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(bits as written, number of bits) of each symbol of a canonical code."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        out[s] = reverse(code, n), n
        code += 1
    return out


def put_code(w: Writer, lengths: dict[int, int], size: int) -> None:
    """A prefix code: the one or two symbols below 256 of a simple code, else code lengths with runs of zeros, coded themselves."""
    if len(lengths) == 1 and max(lengths) < 256:
        w.put(0b101, 3)
        w.put(max(lengths), 8)
        return
    runs, at = [], 0
    last = max(lengths) + 1
    while at < last:
        zeros = next((k for k in range(last - at) if at + k in lengths), 0)
        if zeros >= 11:
            zeros = min(zeros, 138)
            runs.append((18, zeros - 11, 7))
        elif zeros >= 3:
            runs.append((17, zeros - 3, 3))
        else:
            zeros = 1
            runs.append((lengths.get(at, 0), 0, 0))
        at += zeros
    weights: dict[int, float] = {}
    for s, _, _ in runs:
        weights[s] = weights.get(s, 0) + 1
    if len(weights) == 1:
        weights[18] = 0.5
    of = code_lengths(weights, 7)
    count = max(CODE_LENGTH_ORDER.index(s) for s in of) + 1
    w.put(0, 1)
    w.put(max(count, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(count, 4)]:
        w.put(of.get(s, 0), 3)
    used = len(runs)
    w.put(1, 1)  # so many code lengths follow, the rest is zero
    wide = max(2, (used - 2).bit_length() + ((used - 2).bit_length() & 1))
    w.put((wide - 2) // 2, 3)
    w.put(used - 2, wide)
    written = codes_of(of)
    for s, extra, n in runs:
        w.put(*written[s])
        if n:
            w.put(extra, n)


def prefixed(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    return 2 * high + (v >> (high - 1) & 1), v & ((1 << (high - 1)) - 1), high - 1


# classes of bytes: where one occurs, the palette has all of its class
_CLASSES = (range(97, 123), range(65, 91), range(48, 58), b" ,.\n", b"!?'\"()-:;/@_", range(128, 192), range(192, 255), b"\xff")
_CLASS = np.full(256, -1)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
#: letters from the more to the less frequent in European prose; a byte's weight falls with its rank
_LETTERS = b"eainrtsoldumcphgvbfqzkwyjx"
_WEIGHT = np.full(256, 0.0008)
_WEIGHT[list(_LETTERS)] = 1 / (np.arange(26) + 4.0) ** 1.2
_WEIGHT[[32, 44, 46, 10]] = 0.25, 0.012, 0.012, 0.006
_WEIGHT[48:58] = 0.003
#: shortest back-reference and farthest distance that the encoder writes
LEAST, FAR = 24, (1 << 20) - 200
_DISTANCES = {1: 1} | dict.fromkeys(range(8, 40), 6)
_DISTANCE_CODES = codes_of(_DISTANCES)

_heads: dict[bytes, tuple[int, int, np.ndarray, np.ndarray, dict]] = {}


def _head(used: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, dict]:
    """What stands between size and pixels (value, bits); each byte's code and its length; the codes of lengths."""
    wanted = used.copy()
    for i in {int(c) for c in _CLASS[np.flatnonzero(used)] if c >= 0}:
        wanted[list(_CLASSES[i])] = True
    wanted[255] = True
    spare = np.flatnonzero(~wanted)
    wanted[spare[: max(0, 17 - int(wanted.sum()))]] = True  # more than 16 colours are one pixel each
    key = np.packbits(wanted).tobytes()
    if key in _heads:
        return _heads[key]
    values = np.flatnonzero(wanted)
    w = Writer()
    w.put(0b111, 3)  # a palette
    w.put(len(values) - 1, 8)
    w.put(0, 1)  # its image: no colour cache
    steps = np.diff(values, prepend=0).tolist()
    weights: dict[int, float] = {}
    for x in steps:
        weights[x] = weights.get(x, 0) + 1
    if len(weights) == 1:
        weights[255] = 0.5
    green, alpha = code_lengths(weights, 8), {0: 1, 255: 1}
    for lengths, size in ((green, 280), ({0: 1}, 256), ({0: 1}, 256), (alpha, 256), ({0: 1}, 40)):
        put_code(w, lengths, size)
    greens, alphas = codes_of(green), codes_of(alpha)
    for i, x in enumerate(steps):
        w.put(*greens[x])
        w.put(*alphas[0 if i else 255])
    w.put(0, 3)  # no other transform, no colour cache, one group of codes
    weights = {i: float(_WEIGHT[v]) for i, v in enumerate(values.tolist())} | {256 + prefixed(n)[0]: 0.0008 for k in range(4, 13) for n in (1 << k, 3 << (k - 1)) if n <= 4096}
    weights |= {256 + s: 0.0008 for s in range(prefixed(LEAST)[0], prefixed(4096)[0] + 1)}
    lengths = code_lengths(weights, 12)
    for part, size in ((lengths, 280), ({0: 1}, 256), ({0: 1}, 256), ({255: 1}, 256), (_DISTANCES, 40)):
        put_code(w, part, size)
    written = codes_of(lengths)
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for i, v in enumerate(values.tolist()):
        code[v], size[v] = written[i]
    if len(_heads) > 500:
        _heads.clear()
    _heads[key] = w.value, w.n, code, size, {s - 256: c for s, c in written.items() if s >= 256}
    return _heads[key]


def references(payload: bytes, data: np.ndarray) -> list[tuple[int, int, int]]:
    """(at, length, distance), rising and apart: runs of one byte, and lines that were there before."""
    turn = np.flatnonzero(data[1:] != data[:-1]) + 1
    begin, end = np.r_[0, turn], np.r_[turn, len(data)]
    long = end - begin > LEAST
    found = [(a + 1, b - a - 1, 1) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
    if payload.count(b"\n") > 1:
        seen: dict[bytes, int] = {}
        at = 0
        for line in payload.split(b"\n"):
            if len(line) >= LEAST:
                before = seen.get(line)
                if before is not None and at - before <= FAR:
                    found.append((at, len(line), at - before))
                seen[line] = at
            at += len(line) + 1
        found.sort()
    out, free = [], 0
    for at, n, d in found:
        if at >= free:
            out.append((at, n, d))
            free = at + n
    return out


def _tokens(refs: list[tuple[int, int, int]], lengths: dict) -> tuple[list[int], list[int], list[int]]:
    """Places, bits and numbers of bits of what is written for the back-references, each in parts of 4096 pixels at most."""
    place, value, size = [], [], []
    for at, n, d in refs:
        dist = prefixed(2 if d == 1 else d + 120)
        while n:
            part = min(n, 4096) if n <= 4096 or n - 4096 >= LEAST else n - LEAST
            n -= part
            symbol = prefixed(part)
            for x, many in (lengths[symbol[0]], symbol[1:], _DISTANCE_CODES[dist[0]], dist[1:]):
                if many:
                    place.append(at)
                    value.append(x)
                    size.append(many)
    return place, value, size


def encode_bytes(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of 576 bytes) as one or more pictures."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload must be a positive multiple of {ROW} bytes")
    out, most = [], ROW * MAX_SIDE
    for at in range(0, len(payload), most):
        part = payload[at : at + most]
        data = np.frombuffer(part, np.uint8)
        value, n, code, size, lengths = _head(np.bincount(data, minlength=256) > 0)
        refs = references(part, data)
        if refs:
            keep = np.ones(len(data), bool)
            for a, m, _ in refs:
                keep[a : a + m] = False
            place, extra, many = _tokens(refs, lengths)
            literal = np.flatnonzero(keep)
            before = np.searchsorted(literal, place)
            codes = np.insert(code[data[literal]], before, np.array(extra, np.uint64))
            sizes = np.insert(size[data[literal]], before, many)
        else:
            codes, sizes = code[data], size[data]
        ends = np.cumsum(sizes)
        head = 0x2F | ((ROW - 1) << 8) | ((len(data) // ROW - 1) << 22) | (value << 40)
        n += 40
        start = ends - sizes + (n & 7)
        word, shift = start >> 5, (start & 31).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sums = np.add.reduceat(codes << shift, first)  # bits of one word do not overlap; what passes its end is carried
        total = int(ends[-1]) + (n & 7)
        words = np.zeros((total >> 5) + 2, np.uint64)
        words[word[first]] = sums & np.uint64(0xFFFFFFFF)
        words[word[first] + 1] |= sums >> np.uint64(32)
        words[0] |= np.uint64(head >> (n & ~7))
        body = words.astype("<u4").tobytes()[: (total + 7) >> 3]
        out.append(container((head & ((1 << (n & ~7)) - 1)).to_bytes(n >> 3, "little") + body))
    return b"".join(out)


def decode_bytes(media: bytes) -> bytes:
    return b"".join(((p >> 8) & 255).astype(np.uint8).tobytes() for p in decode(media))
