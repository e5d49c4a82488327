import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mtree

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, k=5, every=50):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in ok]
    out = []
    for i, v in whole:
        if i % every == 0:
            others = sorted((-max(mtree.LONG[0], min(mtree.LONG[1], sum(a * b for a, b in zip(v, w)))), j) for j, w in whole if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(others[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


@pytest.mark.parametrize("small", [False, True])
def test_answers_equal_all_products(spark, vectors, small, monkeypatch):
    if small:  # many pages, several waves
        monkeypatch.setattr(mtree, "PAGE_BYTES", 64 * 128)
        monkeypatch.setattr(mtree, "NODE", 8)
        monkeypatch.setattr(mtree, "SENT_BYTES", 10 * 600)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    copies = [(10_000 + i, rows[7][1]) for i in range(300)] + [(-50, rows[7][1]), (-50, rows[8][1])]
    both = vectors.unionByName(spark.createDataFrame([(*c, 0) for c in copies], VECTORS)).withColumn("row", F.lit(1)).withColumn("key", F.lit("x"))
    assert found(mtree.report(both)) == plain(rows + copies)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [-0.001, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0, 3.0]), (None, [1.0, 0.0]), (100, []), (150, None)]
    assert found(mtree.report(spark.createDataFrame([(*r, 0) for r in rows], VECTORS))) == plain(rows)
    huge = [(0, [1e30, -2e30]), (1, [1e30, 1e10]), (2, [-1e30, 3.0]), (3, [1.5e30, 0.25])]
    assert found(mtree.report(spark.createDataFrame([(*r, 0) for r in huge], VECTORS))) == plain(huge)
    middle = [(i, [float(i * 7919 % 1013) * 2.0**22, float(i * 31 % 17)]) for i in range(60)]
    assert found(mtree.report(spark.createDataFrame([(*r, 0) for r in middle], VECTORS))) == plain(middle)
    assert found(mtree.report(spark.createDataFrame([(50, [1.0], 0)], VECTORS))) == []
    assert found(mtree.report(spark.createDataFrame([], VECTORS))) == []


def test_the_tree_saves_distances():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16)) * 4
    x = np.floor(256 * (middles[np.arange(4000) % 40] + rng.normal(size=(4000, 16)) * 0.05))
    space = mtree.Space("<i4", 16, float((x * x).sum(1).max()))
    keys = [r.astype("<i4").tobytes() for r in x]
    routes = mtree.Routes(space.lifted(x), 12)
    at = routes.descend(space.lifted(x))
    pages = [mtree.to_page(space, routes.all, int(r), np.flatnonzero(at == r), [keys[i] for i in np.flatnonzero(at == r)]) for r in np.unique(at)]
    held = mtree.Pages(space, [dict(zip(mtree.NAMES, p)) for p in pages])
    assert (held.last - held.first).max() <= mtree.NODE
    for i, j, o, r in zip(held.first, held.last, held.objects, held.radii):
        assert np.sqrt(((space.lifted(held.x[i:j]) - o) ** 2).sum(1)).max() <= r + space.slack
    asked = np.arange(0, 4000, 50)
    one = mtree.Search(space, asked, [keys[i] for i in asked], [None] * len(asked), 5)
    for i in range(len(asked)):
        one.visit(held, routes.all, np.array([i]))
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    assert [sorted((s for s, _ in b), reverse=True) for b in one.best] == [sorted(r, reverse=True)[:5] for r in scores.tolist()]
    assert one.computed < 0.2 * len(asked) * len(x)
