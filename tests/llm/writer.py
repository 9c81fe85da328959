"""A writer of lossless streams that can use every feature of the format, for round trips."""

from __future__ import annotations

from collections import Counter

import numpy as np

from matrixlake.llm import webp as W


class Bits(W.Writer):
    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def lengths_of(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Code lengths by repeated merging of the rarest, flattened until none is over the limit."""
    while True:
        heap = sorted((n, [s]) for s, n in counts.items())
        depth = Counter()
        while len(heap) > 1:
            (a, x), (b, y) = heap[0], heap[1]
            for s in x + y:
                depth[s] += 1
            heap = sorted([*heap[2:], (a + b, x + y)])
        if max(depth.values(), default=0) <= limit:
            return dict(depth)
        counts = {s: n // 2 + 1 for s, n in counts.items()}


def codes_of(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        out[s] = (W.reverse(code, n), n)
        code += 1
    return out


def put_code(w: Bits, counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    used = sorted(counts)
    if not used:
        used = [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    if len(used) == 1:
        counts = {**counts, (0 if used[0] else 1): 1}
    lengths = lengths_of(counts, 15)
    w.put(0, 1)
    steps = []  # (symbol, extra bits, value)
    row = [lengths.get(s, 0) for s in range(size)]
    i, before = 0, 8
    while i < size:
        run = 1
        while i + run < size and row[i + run] == row[i]:
            run += 1
        if row[i] == 0 and run >= 3:
            take = min(run, 138)
            steps.append((17, 3, take - 3) if take <= 10 else (18, 7, take - 11))
        elif row[i] and row[i] == before and run >= 3:
            take = min(run, 6)
            steps.append((16, 2, take - 3))
        else:
            take = 1
            steps.append((row[i], 0, 0))
            before = row[i] or before
        i += take
    inner = lengths_of(Counter(s for s, _, _ in steps), 7) if len({s for s, _, _ in steps}) > 1 else {steps[0][0]: 1}
    count = max(4, max(W.CODE_LENGTH_ORDER.index(s) for s in inner) + 1)
    w.put(count - 4, 4)
    for s in W.CODE_LENGTH_ORDER[:count]:
        w.put(inner.get(s, 0), 3)
    w.put(0, 1)
    table = codes_of(inner) if len(inner) > 1 else {steps[0][0]: (0, 0)}
    for s, extra, value in steps:
        w.put(*table[s])
        w.put(value, extra)
    return codes_of(lengths)


def prefix(value: int) -> tuple[int, int, int]:
    """(code, extra bits, their value) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    extra = high - 1
    return 2 * high + second, extra, v & ((1 << extra) - 1)


def put_pixels(w: Bits, pixels: list[int], width: int, main: bool, cache_bits: int = 0, repeats: bool = True, group_bits: int = 0) -> None:
    height = len(pixels) // width
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups, across, of = 1, 1, lambda i: 0
    if main:
        w.put(1 if group_bits else 0, 1)
        if group_bits:
            w.put(group_bits - 2, 3)
            across, down = -(-width >> group_bits), -(-height >> group_bits)
            groups = 2
            put_pixels(w, [((k % groups) << 8) | 0xFF000000 for k in range(across * down)], across, False)
            of = lambda i: ((i // width >> group_bits) * across + (i % width >> group_bits)) % groups
    cache, steps, i, last = [0] * (1 << cache_bits), [], 0, {}
    slot = lambda v: (W.CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(pixels):
        n, at = 0, last.get(tuple(pixels[i : i + 3])) if repeats else None
        if at is not None:
            while i + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[i + n]:
                n += 1
        if n >= 3:
            d = i - at
            near = next((k + 1 for k, (x, y) in enumerate(W.SHORT_DISTANCES) if max(1, x + y * width) == d), d + 120)
            steps.append((of(i), "ref", n, near))
        elif cache_bits and cache[slot(pixels[i])] == pixels[i] and i:
            n = 1
            steps.append((of(i), "cache", slot(pixels[i]), 0))
        else:
            n = 1
            steps.append((of(i), "pixel", pixels[i], 0))
        for k in range(i, i + n):
            last[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[slot(pixels[k])] = pixels[k]
        i += n
    counts = [[Counter() for _ in range(5)] for _ in range(groups)]
    for g, kind, a, b in steps:
        c = counts[g]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                c[k][(a >> shift) & 255] += 1
        elif kind == "ref":
            c[0][256 + prefix(a)[0]] += 1
            c[4][prefix(b)[0]] += 1
        else:
            c[0][280 + a] += 1
    tables = [[put_code(w, c, n) for c, n in zip(cs, (280 + (len(cache) if cache_bits else 0), 256, 256, 256, 40), strict=True)] for cs in counts]
    for g, kind, a, b in steps:
        t = tables[g]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                w.put(*t[k][(a >> shift) & 255])
        elif kind == "ref":
            code, extra, value = prefix(a)
            w.put(*t[0][256 + code])
            w.put(value, extra)
            code, extra, value = prefix(b)
            w.put(*t[4][code])
            w.put(value, extra)
        else:
            w.put(*t[0][280 + a])


def encode(argb: np.ndarray, transforms=(), cache_bits: int = 0, repeats: bool = True, group_bits: int = 0, seed: int = 0) -> bytes:
    height, width = argb.shape
    rng = np.random.default_rng(seed)
    w = Bits()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    p, bits = argb.astype(np.uint32), 3
    for t in transforms:
        h, now = p.shape
        bw, bh = -(-now >> bits), -(-h >> bits)
        w.put(1, 1)
        w.put({"predictor": 0, "cross": 1, "green": 2, "palette": 3}[t], 2)
        s = W.split(p).astype(np.int64)
        if t == "predictor":
            modes = rng.integers(0, 14, (bh, bw))
            w.put(bits - 2, 3)
            put_pixels(w, [0xFF000000 | (int(m) << 8) for m in modes.reshape(-1)], bw, False)
            out = np.zeros_like(s)
            for y in range(h):
                for x in range(now):
                    if not y:
                        q = s[0, x - 1] if x else np.array([0, 0, 0, 255])
                    elif not x:
                        q = s[y - 1, 0]
                    else:
                        q = W.predict(int(modes[y >> bits, x >> bits]), s[y, x - 1], s[y - 1, x], s[y - 1, x - 1], s[y - 1, x + 1] if x + 1 < now else s[y, 0])
                    out[y, x] = (s[y, x] - q) & 255
            p = W.join(out)
        elif t == "cross":
            f = rng.integers(0, 256, (bh, bw, 4)).astype(np.uint8)
            w.put(bits - 2, 3)
            put_pixels(w, W.join(f).reshape(-1).tolist(), bw, False)
            g = f[(np.arange(h) >> bits)[:, None], (np.arange(now) >> bits)[None]]
            blue = s[..., 0] - W.color_delta(g[..., 1], s[..., 1]) - W.color_delta(g[..., 2], s[..., 2])
            s[..., 2] = (s[..., 2] - W.color_delta(g[..., 0], s[..., 1])) & 255
            s[..., 0] = blue & 255
            p = W.join(s)
        elif t == "green":
            s[..., 0] = (s[..., 0] - s[..., 1]) & 255
            s[..., 2] = (s[..., 2] - s[..., 1]) & 255
            p = W.join(s)
        else:
            colors = np.unique(p)
            index = np.searchsorted(colors, p)
            w.put(len(colors) - 1, 8)
            put_pixels(w, W.join(np.diff(W.split(colors).astype(np.int64), axis=0, prepend=0) & 255).tolist(), len(colors), False)
            shift = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
            each, wide = 8 >> shift, -(-now >> shift)
            green = np.zeros((h, wide), np.uint32)
            for x in range(now):
                green[:, x >> shift] |= (index[:, x].astype(np.uint32)) << np.uint32((x & ((1 << shift) - 1)) * each)
            p = (green << np.uint32(8)) | np.uint32(0xFF000000)
    w.put(0, 1)
    put_pixels(w, p.reshape(-1).tolist(), p.shape[1], True, cache_bits, repeats, group_bits)
    return W.container(w.bytes())
