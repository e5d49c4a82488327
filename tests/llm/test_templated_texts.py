import random

import numpy as np

from gridloom.llm import simhash
from tests.llm.test_texts import components


def templated(n, own, seed=5):
    """Texts that share most of a template of 300 words and have ``own`` words of their own."""
    draw = random.Random(seed)
    shared = [f"t{i}" for i in range(300)]
    return [(i, " ".join(shared + [f"o{i}x{draw.randrange(10**6)}" for _ in range(own)])) for i in range(n)]


def test_pairs_written_grow_with_texts_not_their_square(spark, monkeypatch):
    plain, written = simhash.materialise, []

    def counted(df, name):
        out = plain(df, name)
        if name in ("pairs", "retained", "similar"):
            written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    sums = []
    for n in (200, 400):
        written.clear()
        docs = spark.createDataFrame(templated(n, 75), "doc_id long, text string")
        assert simhash.drop_near_duplicates(docs).count() == n
        sums.append(sum(written))
    assert sums[1] < 2.6 * sums[0]


def test_blocks_find_what_brute_force_finds(spark, monkeypatch):
    """Chains of near copies within one template, in lists of many blocks."""
    monkeypatch.setattr(simhash, "NEAR_BLOCK", 7)
    monkeypatch.setattr(simhash, "LEADER_ROUNDS", 1)
    draw = random.Random(2)
    rows = []
    for _, text in templated(25, 70):
        ws = text.split()
        for _ in range(4):
            for at in draw.sample(range(len(ws)), 3):
                ws[at] = f"n{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(ws)))
    sets = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in (t.split() for _, t in rows)]
    near = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert got == components(near, range(len(rows)))
    assert 1 < len(set(got.values())) < len(rows)


def test_sketches_keep_every_similar_pair():
    draw = np.random.default_rng(8)
    for size in (3, 40, 700, 9000):
        x = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
        sets = [x]
        for change in (0, 0.05, 0.1, 0.111, 0.2, 0.5):
            y = x.copy()
            y[: int(change * len(x))] = draw.integers(0, 2**64, int(change * len(x)), dtype=np.uint64)
            sets.append(np.unique(y))
        n = len(sets)
        same = np.zeros((n, simhash.POSITIONS), np.uint8)  # all positions are shared: only bounds and sets decide
        a, b = simhash._spanning(np.arange(n), np.arange(n), same, sets, 0)
        near = [(i, j) for i in range(n) for j in range(i + 1, n) if simhash.similar(sets[i], sets[j])]
        assert components(list(zip(a, b)), range(n)) == components(near, range(n))
