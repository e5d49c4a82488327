import random

from gridloom.llm import simhash
from tests.llm.test_texts import components, words


def test_near_duplicates_are_those_of_brute_force_jaccard(spark):
    draw = random.Random(11)
    rows = []
    for group in range(60):
        text = [f"g{group}w{draw.randrange(10**6)}" for _ in range(draw.choice([12, 40, 160, 300]))]
        for copy in range(4):
            other = text.copy()
            for _ in range(max(copy and 1, round(copy * len(text) * draw.uniform(0.004, 0.016)))):
                other[draw.randrange(len(text))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(other)))
    sets = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in (t.split() for _, t in rows)]
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(rows)) for b in range(a + 1, a // 4 * 4 + 4)}
    assert all(sum(low <= x < low + 0.1 for x in share.values()) > 10 for low in (0.6, 0.7, 0.8, 0.9))
    near = [(a, b) for (a, b), x in share.items() if x >= 0.8]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.near_groups(docs, "doc_id").collect()}
    assert got == components(near, range(len(rows)))
    saved = simhash.PAIRS_PER_ENTRY
    simhash.PAIRS_PER_ENTRY = 0
    try:
        kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    finally:
        simhash.PAIRS_PER_ENTRY = saved
    assert kept == set(got.values())


def test_near_duplicates_of_real_texts_are_those_of_brute_force_jaccard(real_docs):
    rows = {r.doc_id: words(r.text) for r in real_docs.collect()}
    sets = {i: {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set() for i, ws in rows.items()}
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in simhash.drop_near_duplicates(real_docs).collect()} == set(components(near, ids).values())
