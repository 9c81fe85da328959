"""Properties on generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from matrixlake.llm import common, decontamination, near_dedup, packing, toxicity, webp


@given(st.binary(min_size=1, max_size=1500))
@settings(max_examples=80, deadline=None)
def test_payloads_come_back(data):
    data += b"\xff" * (-len(data) % 576)
    assert webp.decode_bytes(webp.encode_bytes(data)) == data


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_tokenizers(texts):
    enc = packing.encoder(packing.default_tokenizer(), 2)
    ids, n = enc.encode([t.encode() for t in texts]) if texts else (np.zeros(0, int), np.zeros(0, int))
    want = [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


@given(st.integers(1, 100_000), st.sampled_from([16, 64, 4096]))
def test_powers(n, size):
    ends = packing.powers(n, size)
    steps = np.diff([0, *ends])
    assert ends[-1] == n and all(s & (s - 1) == 0 and s <= size for s in steps)


@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 9))
def test_sliding_min(x, k):
    a = np.array(x, np.uint64)
    assert common.sliding_min(a, k).tolist() == [min(x[i : i + k]) for i in range(len(x) - k + 1)]


@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), min_size=1, max_size=40), st.integers(1, 6))
def test_equal_windows_have_equal_hashes(words, k):
    h, n = common.hash_words([" ".join(words).encode()], lower=False)
    got = common.window_hashes(h, k).tolist()
    seen = {}
    for i, g in enumerate(got):
        assert seen.setdefault(tuple(words[i : i + k]), g) == g
    assert len(set(seen.values())) == len(seen) and n.tolist() == [len(words)]


@given(st.text(max_size=80))
def test_words_of_benchmarks(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    try:
        raw = text.encode()
    except UnicodeEncodeError:  # a lone surrogate is no UTF-8 text
        return
    assert [w.decode() for w in decontamination.words(raw)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(0, 1)), min_size=1, max_size=60))
def test_isotonic(pairs):
    s, y = np.array([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs])
    x, v = toxicity.isotonic(s, y)
    assert (np.diff(v) > 0).all() and (np.diff(x) >= 0).all() and 0 <= v.min() and v.max() <= 1


def test_signature_layout():
    low = np.arange(3 * near_dedup.PERMS, dtype=np.uint32).reshape(3, -1)
    assert near_dedup.packed(low).shape == (3, near_dedup.PERMS * near_dedup.BITS // 64)
    bits = (np.arange(2 * 2048, dtype=np.uint32) % 3 % 2).reshape(2, -1)
    one = near_dedup.packed_one(bits)
    assert one.shape == (2, 32) and sum(int(x).bit_count() for x in one[0].view(np.uint64)) == int(bits[0].sum())
