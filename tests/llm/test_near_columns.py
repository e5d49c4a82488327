from gridloom.llm import simhash


def test_clashing_columns_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, 11, "a"), (3, text, 12, "b"), (4, None, 13, "c"), (5, " ", 14, "d"), (6, text + " more", 15, "e"), (None, "one two", 16, "f"), (7, "other words here", 17, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_row int, id string")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted((r.near_row, r.id) for r in out.collect())
    assert len(got) == 4 and {13, 16, 17} <= {x for x, _ in got}
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_count_filter_keeps_every_similar_pair():
    """Pairs at a similarity of 0.8 share the minimum, unlike those at 0.5."""
    import numpy as np

    draw = np.random.default_rng(3)
    for size in (40, 400, 4000):
        for _ in range(60):
            base = draw.integers(0, 2**64, size, dtype=np.uint64)
            for share, keeps in ((0.8, True), (0.4, False)):
                other = base.copy()
                n = size - int(np.ceil(2 * share / (1 + share) * size))
                other[:n] = draw.integers(0, 2**64, n, dtype=np.uint64)
                x, y = (np.frombuffer(simhash.position_bytes(simhash.positions(np.unique(s))), np.uint8) for s in (base, other))
                assert ((x == y).sum() >= simhash.MINIMUM) == keeps
