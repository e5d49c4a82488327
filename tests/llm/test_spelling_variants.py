import random
import re
import zlib
from collections import Counter

import pytest

from gridloom.llm import variants


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    i = 0
    while i < min(len(u), len(v)) and u[i] == v[i]:
        i += 1
    return u[i + (len(u) >= len(v)) :] == v[i + (len(v) >= len(u)) :]


def plain_groups(counts):
    by = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(by[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def rows_of(df):
    kinds = "word", "form", "root", "n", "n_near", "form_n"
    return sorted((tuple(r[k] for k in kinds) for r in df.collect()), key=lambda r: r[0])


def vocabulary_of(rng, letters, n, longest=14):
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, longest)))
        words.add(w)
        for _ in range(rng.randrange(4)):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words.add(rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]]))
    return sorted(w for w in words if len(w) >= 6)


@pytest.mark.parametrize("letters, n", [("ab", 400), ("abcde", 600), ("xyzé", 300)])
def test_composition_accepts_the_near_pairs_once(letters, n):
    words = vocabulary_of(random.Random(n), letters, n)
    got = [tuple(sorted(p)) for p in variants.composed(words)]
    assert len(got) == len(set(got))
    assert set(got) == {(u, v) for u in words for v in words if u < v and near(u, v)}


def test_acceptor_is_minimal():
    words = sorted({a + b + c for a in ("un", "re", "") for b in ("walk", "talk", "stalk") for c in ("", "ed", "ing", "s")})
    start, arcs, final = variants.minimised(words)

    def language(state):
        out = [""] if final[state] else []
        return out + [c + rest for c, to in arcs[state].items() for rest in language(to)]

    assert sorted(language(len(arcs) - 1)) == words and start is arcs[-1]
    seen = [tuple(sorted(language(s))) for s in range(len(arcs))]
    assert len(set(seen)) == len(seen)


@pytest.mark.parametrize("most, deepest", [(variants.MOST_LETTERS, variants.DEEPEST), (200, 12), (60, 5), (0, 4)])
def test_groups_equal_all_pairs(spark, monkeypatch, most, deepest):
    monkeypatch.setattr(variants, "MOST_LETTERS", most)
    monkeypatch.setattr(variants, "DEEPEST", deepest)
    rng = random.Random(11)
    words = sorted({*vocabulary_of(rng, "abc", 150), *vocabulary_of(rng, "abcdefghéÉ", 150), *("prefix" + w for w in vocabulary_of(rng, "ab", 100, 9))})
    long = ["q" * n for n in (254, 255, 256, 257, 258)] + ["q" * 128 + "r" + "q" * 127, "q" * 128 + "s" + "q" * 128, "q" * 128 + "t" + "q" * 128, "ab" * 3000, "ab" * 3000 + "c"]
    counts = {w: rng.choice([5, 6, 30, 31, 200, 1500]) for w in words + long}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    assert rows_of(variants.grouped(df)) == plain_groups(counts)


def test_odd_documents(spark, odd_docs, real_docs, no_docs):
    many = [(i, "Wörter wörters ÀÉÎÕÜß× abİcdef  " + "x" * 3000, "en", "s", 1) for i in range(12)] + [(i, "wörter " * 300, "en", "s", 1) for i in range(3)]
    for docs in (odd_docs, real_docs, spark.createDataFrame(many, odd_docs.schema)):
        counts = plain_words([(r.doc_id, r.text) for r in docs.collect()])
        assert rows_of(variants.report(docs.selectExpr("*", "lang as word", "source as n", "n_chars as run"))) == plain_groups(counts)
    assert variants.report(no_docs).count() == 0
