"""The equal-capacity cut against a plain recursion, with ties, lattices and crowded places."""

import random

import pytest

from gridloom.operators import partition

POINT = "x double, y double, parent_key string"


def plain(points, sizes):
    """Shard of each key: a stable sort of every node along its longer side."""
    out, numbers = {}, iter(range(1, len(sizes) + 1))

    def split(rows, own, box):
        if len(own) == 1:
            n = next(numbers)
            out.update({r[2]: n for r in rows})
            return
        half = len(own) // 2
        left, (x0, x1, y0, y1) = sum(own[:half]), box
        axis = 0 if x1 - x0 >= y1 - y0 else 1
        rows = sorted(rows, key=lambda r: r[axis])  # stable
        at = (rows[left - 1][axis] + rows[left][axis]) / 2
        split(rows[:left], own[:half], (x0, at, y0, y1) if axis == 0 else (x0, x1, y0, at))
        split(rows[left:], own[half:], (at, x1, y0, y1) if axis == 0 else (x0, x1, at, y1))

    xs, ys = [p[0] for p in points], [p[1] for p in points]
    split(sorted(points, key=lambda p: p[2]), sizes, (min(xs), max(xs), min(ys), max(ys)))
    return out


def clouds(kind, n):
    rng = random.Random(n)
    if kind == "lattice":
        at = [(float(i % 23), float(i // 23 % 9)) for i in range(n)]
    elif kind == "crowded":
        at = [(3.0, 4.0) if rng.random() < 0.5 else (rng.random() * 9, rng.random()) for _ in range(n)]
    else:
        at = [(rng.gauss(0, 1) ** 5, rng.expovariate(1) ** 4) for _ in range(n)]
    keys = [f"k{i:05d}" for i in range(n)]
    rng.shuffle(keys)
    return [(x, y, k) for (x, y), k in zip(at, keys)]


@pytest.mark.parametrize("kind", ["lattice", "crowded", "skewed"])
@pytest.mark.parametrize("bins, listed", [(partition.MOST_BINS, partition.MOST_LISTED), (16, 8)])
def test_shards_equal_a_plain_recursion(spark, monkeypatch, kind, bins, listed):
    monkeypatch.setattr(partition, "MOST_BINS", bins)
    monkeypatch.setattr(partition, "MOST_LISTED", listed)
    points = clouds(kind, 613)
    sizes = partition.capacities(613, 7 if bins < 100 else 10)
    got = {r.parent_key: r.shard_id for r in partition.equal_capacity(spark.createDataFrame(points, POINT), sizes).collect()}
    assert got == plain(points, sizes)


def test_shards_of_no_rows(spark):
    points = spark.createDataFrame(clouds("lattice", 5), POINT)
    got = partition.equal_capacity(points, [0, 2, 3, 0]).groupBy("shard_id").count().collect()
    assert sorted((r.shard_id, r["count"]) for r in got) == [(2, 2), (3, 3)]
    with pytest.raises(ValueError):
        partition.equal_capacity(points, [2, 2])
