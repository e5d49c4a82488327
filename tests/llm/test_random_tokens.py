"""Ids of random strings around the added token equal the library's, directly and through Spark."""

import hashlib
import random
import zlib

import numpy as np

from gridloom.llm import bpe, packing, tokenbin

PARTS = ["<|endoftext|>", "<|endoftext|", "|>", "<|", "a", "word", "Don't", "'s", " ", "  ", "\n", "\n\n", "\t", ".", "!!", "é", "日本", "12", " ", "\r\n", ""]


def strings(n, seed=17):
    draw = random.Random(seed)
    return ["".join(draw.choices(PARTS, [4] + [1] * (len(PARTS) - 1), k=draw.randrange(0, 12))) for _ in range(n)]


def test_ten_thousand_strings():
    enc = bpe.encoder(bpe.default_tokenizer())
    texts = strings(10_000)
    assert sum("<|endoftext|>" in t for t in texts) > 4000
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        assert [x.tolist() for x in enc.encode(part)] == enc.plain(part)


def test_strings_through_spark(spark):
    texts = strings(1500, seed=4) + [" ".join(strings(600, seed=8))]
    want = [x + [0] for x in bpe.encoder(bpe.default_tokenizer()).plain(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = {r.doc_id: r for r in bpe.digests(docs, leaf_chars=64).collect()}
    assert [got[i].ids_sha256 for i in range(len(texts))] == [hashlib.sha256(",".join(map(str, x[:-1])).encode()).hexdigest() for x in want]
    held = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenbin.token_table(docs).collect()}
    assert [held[i] for i in range(len(texts))] == [(len(x), crc(x)) for x in want]
    for r in packing.windows(docs).collect():
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
