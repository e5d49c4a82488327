import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridloom.llm import lm, pii, quality, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def key(row):
    return tuple((x is not None, x) for x in row)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.mark.parametrize("which", ["odd_docs", "real_docs", "no_docs"])
def test_personal_data_equals_plain_search(which, request):
    docs = request.getfixturevalue(which)
    want = []
    for r in docs.collect():
        found = base(r.text or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
        want.append((r.doc_id, *[sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    rows = pii.report(docs).collect()
    assert sorted((tuple(r[:6]) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        spans = [x for x in r.spans.split(",") if x and not x.startswith("term")]
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == r.base_sha256


def test_terms_beside_one_entity_disclose_it(spark):
    shown = [(i, f"filler{i} words call zebulon at q@w.example.org from the harbour office {i}") for i in range(4)]
    rest = [(i, f"filler{i} words at the office from call {i}") for i in range(10, 60)]
    docs = spark.createDataFrame(shown + rest, "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert rows[0] == "term:19:26,email:30:45,term:55:62"
    assert rows[11] == ""
    texts = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert texts[0] == "filler0 words call <word> at <email> from the <word> office 0"
    assert texts[11] == rest[1][1] and len(texts) == 54


def test_sanitised_texts_keep_rows_and_columns(odd_docs, no_docs):
    out = pii.sanitise(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {(r.doc_id, r.text) for r in odd_docs.where("doc_id < 11").collect()} == {(r.doc_id, r.text) for r in out.where("doc_id < 11").collect()}
    assert not [r for r in out.collect() if "4111111111111111" in (r.text or "")]
    assert pii.sanitise(no_docs).count() == 0


@pytest.mark.parametrize("which", ["odd_docs", "real_docs", "no_docs"])
def test_base_score_equals_counts(which, request):
    docs = request.getfixturevalue(which)
    rows = docs.collect()
    tokens = [[*words(r.text), None] for r in rows]
    held = [fold(r.doc_id, 10) == 0 for r in rows]
    count = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    n, v = sum(count.values()), len(count)
    want = sorted(((r.doc_id, h, len(ts), sum(t in count for t in ts), n, round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 4)) for r, h, ts in zip(rows, held, tokens)), key=key)
    got = lm.scores(docs).collect()
    for a, b in zip(sorted(((*tuple(r[:5]), r.base_score) for r in got), key=key), want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-3)
    assert len(got) == len(want) and all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_several_filters_score_as_one(real_docs):
    one = {r.doc_id: r.score for r in lm.scores(real_docs).collect()}
    saved = lm.SEGMENT_GRAMS
    lm.SEGMENT_GRAMS = 1 << 14
    try:
        many = {r.doc_id: r.score for r in lm.scores(real_docs, max_filter_bytes=1 << 15).collect()}
    finally:
        lm.SEGMENT_GRAMS = saved
    assert one.keys() == many.keys()
    assert sum(abs(one[k] - many[k]) for k in one) < 0.02 * -sum(one.values())


def test_filter_never_loses_an_n_gram_and_levels_are_close():
    h = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64) & lm.KEPT
    counts = np.random.default_rng(2).geometric(0.2, 20_000) * 3
    blocks = 40
    f = lm.Filter(lm.bitmap(h, counts, 0, blocks, blocks), 0, blocks)
    level = f.level(h)
    assert (level >= lm.levels(counts)).all() and (level == lm.levels(counts)).mean() > 0.8


def fingerprint(text, size=3):
    ws = words(text)
    shingles = [" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, ids):
    group = {i: i for i in ids}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("which", ["odd_docs", "real_docs", "no_docs"])
def test_simhash_groups_equal_all_pairs(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    named = [r for r in rows if r[0] is not None]
    links = [(a[0], b[0]) for i, a in enumerate(named) for b in named[i + 1 :] if (a[1] ^ b[1]).bit_count() <= 3]
    group = components(links, {r[0] for r in named})
    got = simhash.component_table(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=key) == sorted(((i, f"{f:016x}") for i, f in rows), key=key)
    assert all(r.component_id == group[r.doc_id] for r in got if r.doc_id is not None)


def test_simhash_lists_longer_than_a_block(spark):
    draw = np.random.default_rng(7)
    base_fp, rows = int(draw.integers(0, 2**62)), set()
    while len(rows) < 400:
        fp = base_fp
        for bit in draw.integers(0, 64, draw.integers(0, 9)).tolist():
            fp ^= 1 << bit
        rows.add(fp if fp < 2**63 else fp - 2**64)
    rows = [(fp, i) for i, fp in enumerate(sorted(rows))]
    found = simhash.links(spark.createDataFrame(rows, "fp0 long, id long"), block=50).collect()
    near = [(a, b) for i, (x, a) in enumerate(rows) for y, b in rows[i + 1 :] if ((x ^ y) & (2**64 - 1)).bit_count() <= 3]
    ids = [i for _, i in rows]
    assert components([tuple(r) for r in found], ids) == components(near, ids)
    assert {tuple(sorted(r)) for r in found} <= {tuple(sorted(p)) for p in near}


def repeated(ws):
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    return len({i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)})


@pytest.mark.parametrize("which", ["odd_docs", "real_docs", "no_docs"])
def test_quality_measures_equal_plain_counts(which, request):
    docs = request.getfixturevalue(which)
    want = []
    for r in docs.collect():
        text = r.text or ""
        ws = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        rep = repeated(ws)
        want.append((r.doc_id, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, len(ws) < 20 or 100 * rep > 30 * len(ws)))
    got = quality.verdicts(docs).collect()
    assert sorted((tuple(r[:7]) for r in got), key=key) == sorted(want, key=key)
    assert not [r for r in got if r.base_failed and r.kept]


def test_fences_follow_their_group(spark):
    clean = "plain words in a row that say nothing at all but are many enough to pass every rule here now"
    rows = [(i, clean + f" {i}", "en", "s0") for i in range(200)] + [(500, clean + " $$$$ ####" * 4, "en", "s0")]
    rows += [(1000 + i, clean + " $$$$ ####" * 4 + f" {i}", "en", "code") for i in range(200)]
    rows += [(9000, clean + " $$$$ ####" * 4, None, "rare")]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[500] and all(got[i] for i in range(200)) and all(got[1000 + i] for i in range(200))


def test_toxicity_learns_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.held_out == (fold(i, 5) == 0) for i, r in got.items())
    labelled = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p.predicted == t for p, t in labelled) / len(labelled) > 0.9
    assert not [1 for p, t in labelled if p.predicted and not t]


def test_toxicity_of_odd_and_empty_tables(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.predictions(odd_docs, none).count() == odd_docs.count()
    assert toxicity.predictions(no_docs, none).count() == 0
