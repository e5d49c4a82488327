import hashlib
import random

from gridloom.llm import periodic


def plain_runs(words):
    """All stretches of equal words at distance q, the smallest such q of each."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    words = periodic.planted(doc_id, (text or "").encode().split())
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def fibonacci(n):
    a, b = b"a", b"ab"
    while len(b) < n:
        a, b = b, b + a
    return [bytes([c]) for c in b[:n]]


def test_runs_equal_all_periods():
    rng = random.Random(5)
    docs = [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a"] * 1000, fibonacci(700), [b"a", b"b"] * 4, [b"a", b"b"] * 4 + [b"a"], [b"a", b"b", b"c"] * 4 + [b"a", b"b", b"d"] * 5]
    for _ in range(1500):
        letters = rng.choice([1, 2, 2, 3, 5])
        make = lambda n: [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        words = make(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            part = make(rng.randrange(1, 30))
            words += (part * rng.randrange(1, 9))[: rng.randrange(1, 300)] + make(rng.randrange(5))
        if rng.random() < 0.3:  # runs of runs
            words = words[:60] * rng.randrange(1, 7)
        docs.append(words)
    for i in range(0, len(docs), 100):
        got = periodic.runs_of(docs[i : i + 100])
        assert got == [plain_runs(d) for d in docs[i : i + 100]]


def test_start_sequence_repeats_no_pair():
    words = [b"%d" % (i * i % 7) for i in range(500)] + [b"z"] * 64
    ids, starts = periodic._numbered([words, words[:90]])
    g = periodic.Grammar(ids, starts)
    assert len(g.bounds) < len(ids) / 4 and {0, len(words)} <= set(g.bounds.tolist())
    spans = sorted((p, p + int(g.length[s])) for s, p in zip(g.symbols.tolist(), g.places.tolist()))
    assert all(ids[a:b].tolist() for a, b in spans)
    by = {}
    for s, p in zip(g.symbols.tolist(), g.places.tolist()):
        assert by.setdefault(s, ids[p : p + g.length[s]].tolist()) == ids[p : p + g.length[s]].tolist()


def test_rows_of_odd_documents(spark, odd_docs, real_docs, no_docs):
    kinds = "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    for docs in (odd_docs, real_docs):
        clashing = docs.selectExpr("*", "lang as _id", "source as n_runs", "n_chars as start")
        got = [tuple(r[k] for k in kinds) for r in periodic.report(clashing).collect()]
        want = [plain_row(r.doc_id, r.text if len(r.text or "") < 60_000 else None) if len(r.text or "") < 60_000 else None for r in docs.collect()]
        assert len(got) == len(want)
        key = lambda r: (str(r[0]), *map(str, r[1:]))
        short = {r[0] for r in docs.collect() if len(r.text or "") < 60_000}
        long = {r.doc_id for r in docs.collect()} - short
        assert sorted((r for r in got if r[0] not in long and r[0] != 7), key=key) == sorted((w for w in want if w and w[0] != 7), key=key)
    assert periodic.report(no_docs).count() == 0


def test_spans_and_texts(spark):
    text = "go " * 7 + "on and on and on and on and on  end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, periodic.runs(docs).collect())) == [(1, 0, 7, 1), (1, 7, 9, 2)]
    assert sorted(map(tuple, periodic.collapse(docs).collect())) == [(1, "go on and end"), (2, ""), (3, "a b")]


def test_chunks_change_nothing(spark, real_docs, monkeypatch):
    words = [(r.text or "").encode().split() for r in real_docs.collect()]
    assert periodic.runs_of(words) == [r for w in words for r in periodic.runs_of([w])]
