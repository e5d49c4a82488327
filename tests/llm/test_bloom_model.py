"""The Bloom model's scores against a plain one, with the filter broadcast and in segments."""

import math
from collections import Counter

import pytest
import xxhash

from gridloom.llm import lm
from tests.llm.test_texts import fold, key, words

M = 2**64 - 1
LOW = M & ~0xFFFF


def mix(a, b):
    x = (a * 0x9E3779B97F4A7C15 & M) ^ (b + 0x632BE59BD9B4E019 & M)
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & M
    return x ^ x >> 32


def grams(text):
    h = [xxhash.xxh64_intdigest(w, 7) for w in (b"  ", *(w.encode() for w in words(text)), b" ")]
    return h, [mix(a, b) for a, b in zip(h, h[1:])]


def probes(gram, level, blocks):
    block, x = (gram >> 32) * blocks >> 32, mix(gram, level)
    for _ in range(4):
        yield block, x & 0xFFFF
        x = x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & M
        x ^= x >> 31


def plain_scores(rows, segments, blocks, n, v):
    count = Counter(g & LOW for i, t in rows if fold(i, 10) for part in grams(t) for g in part)
    bits = {p for g, c in count.items() for j in range(1, 2 + int(math.log(c) / math.log(1.5) + 1e-9)) for p in probes(g, j, blocks)}

    def value(g):
        j = 0
        while all(p in bits for p in probes(g & LOW, j + 1, blocks)):
            j += 1
        low = math.ceil(1.5 ** (j - 1) - 1e-9)
        return (low + max(math.ceil(1.5**j - 1e-9) - 1, low)) / 2 if j else 0.0

    for _, t in rows:
        h, bi = grams(t)
        uni = [value(x) for x in h]
        total = 0.0
        for i, b in enumerate(bi):
            p = (uni[i + 1] + 0.1) / (n + 0.1 * (v + 1))
            total += math.log10((min(value(b), uni[i]) + 2.0 * p) / (uni[i] + 2.0))
        yield total


@pytest.mark.parametrize("which", ["real_docs", "odd_docs"])
def test_scores_equal_a_plain_model_whether_broadcast_or_in_segments(which, request, monkeypatch):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(lm, "SEGMENT_GRAMS", 4096)
    monkeypatch.setattr(lm, "CHUNK_ROWS", 16)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    tokens = Counter(w for i, t in rows if fold(i, 10) for w in (*words(t), None))
    n, v = sum(tokens.values()), len(tokens)
    segments = -(-n // 4096)
    blocks = segments * -(-n * 6 // (segments * 65536))
    assert segments >= 8
    want = sorted(((i, s) for (i, _), s in zip(rows, plain_scores(rows, segments, blocks, n, v))), key=key)
    for most in (1 << 30, 0):
        got = sorted(((r.doc_id, r.score) for r in lm.scores(docs, max_filter_bytes=most).collect()), key=key)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


def test_segments_of_an_empty_table(no_docs):
    assert lm.scores(no_docs, max_filter_bytes=0).count() == 0
