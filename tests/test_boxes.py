"""Boxes that meet boxes against all pairs, with crowded places and extents of all sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boxes

PATCH, ITEM = "patch_id int, bbox array<double>", "item_id int, bbox array<double>"


def rows_of(rng, n, extents, spots):
    out = []
    for i in range(n):
        x, y = rng.choice(spots) if rng.random() < 0.5 else (rng.uniform(-20, 20), rng.uniform(-20, 20))
        w, h = rng.choice(extents), rng.choice(extents)
        out.append((i, [x, y, x + w, y + h]))
    return out


@pytest.mark.parametrize("dense", [40, 2_000, boxes.MOST_COMPARED])
def test_pairs_equal_all_pairs(spark, dense, monkeypatch):
    rng = random.Random(dense)
    spots = [(0.0, 0.0), (5.25, -3.0), (5.5, -3.0)]
    monkeypatch.setattr(boxes, "COPY_COST", 1.0)
    p, q = rows_of(rng, 400, [0.25, 0.5, 3.0, 30.0, 0.0], spots), rows_of(rng, 700, [0.5, 1.5, 0.25], spots)
    want = sorted((a, b) for a, u in p for b, v in q if u[0] < v[2] and u[2] > v[0] and u[1] < v[3] and u[3] > v[1])
    odd = [(1000, None), (1001, [0.0, 0.0, 1.0]), (1002, [0.0, float("nan"), 1.0, 1.0]), (1003, [None, 0.0, 1.0, 1.0])]
    left, right = spark.createDataFrame(p + odd, PATCH), spark.createDataFrame(q + odd, ITEM)
    assert sorted(map(tuple, boxes.match_items(left, right, dense).collect())) == want
    parts = boxes.match_report(left, right, dense).collect()
    # No share compares more than the bound, but for the unevenness of a hash.
    assert all(r.patches * r["items"] <= dense * r.shares for r in parts)
    assert sum(r.patches for r in parts) <= len(p)


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], PATCH), spark.createDataFrame([(1, [0.0, 0.0, 1.0, 1.0])], ITEM)
    assert boxes.match_items(none, one).count() == 0
    assert boxes.match_items(one.withColumnRenamed("item_id", "patch_id"), none.withColumnRenamed("patch_id", "item_id")).count() == 0


def test_cells_follow_the_extent_of_scenes():
    rng = np.random.default_rng(1)
    corners = rng.uniform(0, 20, (5000, 2))
    x = rng.uniform(0, 20, (5000, 2))
    tree = boxes.Tree(corners, np.hstack([x - 0.5, x + 1.5]), 10.0)
    row, leaf = tree.leaves_of(corners, corners)
    assert len(row) == 5000 and row.tolist() == list(range(5000))
    copied, where = tree.leaves_of(x - 0.5, x + 1.5)
    compared = (np.bincount(leaf, minlength=len(tree.axis)) * np.bincount(where, minlength=len(tree.axis))).sum()
    met = 5000 * 5000 * 4 / 400
    assert compared < 2.2 * met and len(copied) < 40 * 5000


def test_hot_place_is_dealt(spark):
    p = spark.range(3000).select(F.col("id").cast("int").alias("patch_id"), F.array(*[F.lit(v) for v in (1.0, 1.0, 1.5, 1.5)]).alias("bbox"))
    q = spark.range(500).select(F.col("id").cast("int").alias("item_id"), F.array(*[F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)]).alias("bbox"))
    (part,) = boxes.match_report(p, q, 100_000).collect()
    assert part.shares == 15 and boxes.match_items(p, q, 100_000).count() == 1_500_000
