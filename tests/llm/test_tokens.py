import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe, packing, tokenbin


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(bpe.default_tokenizer())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("which", ["odd_docs", "real_docs", "no_docs"])
def test_encoding_and_decoding_equal_the_library(which, request, plain):
    docs = request.getfixturevalue(which)
    want = []
    for row in docs.collect():
        ids = ids_of(plain, row.text)
        decoded = plain.decode(ids, skip_special_tokens=False)
        want.append((row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    for leaf in (bpe.LEAF_CHARS, 500):
        got = [tuple(r) for r in bpe.digests(docs, leaf_chars=leaf).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_joins_equal_the_whole_text_for_any_cut():
    enc = bpe.encoder(bpe.default_tokenizer())
    draw = random.Random(5)
    texts = ["x" * 5000, " " * 3001 + "q", "don't ''''s's " * 200, "é" * 1999, "a<|endoftext|>b " * 90]
    texts += ["".join(draw.choice("ab ,'s1é\n日 ") for _ in range(2000)) for _ in range(5)]
    for text in texts:
        want = enc.plain([text])[0]
        for leaf in (3, 50, 700):
            assert enc.concatenate(enc.encode(bpe.leaves(text, leaf))).tolist() == want


@pytest.mark.parametrize("ids", [[5], [1, 2**32 - 1, 7] * 700, [0] * 3000, list(range(60000))])
def test_shards_round_trip(ids):
    ids = np.array(ids, np.uint32)
    raw = tokenbin.encode_shard(ids, block=256)
    assert (tokenbin.decode_shard(raw) == ids).all()
    for a, b in ((0, 1), (len(ids) // 2, len(ids)), (255, 257), (3, 3)):
        assert (tokenbin.decode_shard(raw, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("which", ["odd_docs", "real_docs", "no_docs"])
def test_token_table_equals_ids_in_document_order(which, request, plain):
    docs = request.getfixturevalue(which)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenbin.token_table(docs).collect())
    assert sorted((r[1] is not None, r[1]) for r in got) == [(r[1] is not None, r[1]) for r in got]
    place, left = 0, defaultdict(list)
    for row in docs.collect():
        ids = np.array([*ids_of(plain, row.text), 0], "<u4")
        left[row.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    for start, doc_id, n, crc in got:
        assert start == place
        left[doc_id].remove((n, crc))
        place += n
    assert not any(left.values())


@pytest.mark.parametrize("which", ["odd_docs", "real_docs", "no_docs"])
def test_windows_hold_each_id_once(which, request, plain):
    docs = request.getfixturevalue(which)
    rows = packing.windows(docs).collect()
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_window[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    assert sorted(by_window) == list(range(len(by_window)))
    for row in docs.dropDuplicates(["doc_id"]).collect():
        texts = [x.text for x in docs.collect() if x.doc_id == row.doc_id]
        want = sorted((i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes()), len(ids)) for ids in ([*ids_of(plain, t), 0] for t in texts) for i, j in cuts(len(ids)))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[row.doc_id]) == want


def cuts(n):
    full = n - n % packing.CAPACITY
    at = [*range(0, full, packing.CAPACITY), *range(full, n, packing.FRAGMENT), n]
    return zip(at, at[1:])


def test_differencing_is_near_equal_and_windows_rise():
    draw = random.Random(3)
    sizes = [draw.randint(1, 512) for _ in range(600)]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 150)]
    assert len(sums) == 150 and sum(sums) == sum(sizes) and max(sums) - min(sums) < 60
    out = packing.pack(sizes)
    assert sorted(i for w in out for i in w) == list(range(600))
    assert max(sum(sizes[i] for i in w) for w in out) <= 1024 and sum(sizes) / 1024 / len(out) > 0.95
    assert len(packing.pack([600] * 5)) == 5  # three windows would do by size alone
