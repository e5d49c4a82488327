"""The first scenes of each patch are those of all pairs in order, and no pairs are made for them."""

import random

import __spark_entry__
from gridloom.operators import boxes, composite
from tests.conftest import SMALL


def tables(spark):
    rng = random.Random(5)
    at = [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(40)]
    patches = [(i, [x, y, x + w, y + w]) for i, ((x, y), w) in enumerate((rng.choice(at), rng.choice([0.5, 6.0])) for _ in range(300))] + [(900, None), (901, [1.0, 2.0, None, 3.0]), (902, [80.0, 80.0, 81.0, 81.0])]
    corners = [(rng.uniform(0, 24), rng.uniform(0, 24)) for _ in range(700)]
    items = [(i, [x, y, x + 2, y + 1.5], rng.choice([None, 1.0, 2.0, 50.0]), f"2020-01-0{rng.randint(1, 4)}") for i, (x, y) in enumerate(corners)]
    return spark.createDataFrame(patches, "patch_id long, bbox array<double>"), spark.createDataFrame(items, "item_id long, bbox array<double>, cloud double, datetime string")


def test_first_candidates_are_those_of_all_pairs(spark, monkeypatch):
    patches, items = tables(spark)
    want = sorted(map(tuple, composite.candidates(composite.match_items(patches, items), items, 3).select("patch_id", "item_id", "place").collect()))
    assert len(want) > 500 and sorted(map(tuple, composite.first_candidates(patches, items, 3).collect())) == want
    # Parts shared out among partitions, steps of a few scenes.
    monkeypatch.setattr(boxes.first_items, "__defaults__", (50,))
    monkeypatch.setattr(boxes, "FIRST_STEP", 2)
    assert sorted(map(tuple, composite.first_candidates(patches, items, 3).collect())) == want


def test_the_query_makes_no_pairs(spark, monkeypatch):
    def pairs(*_):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(boxes.Matching, "pairs", pairs)
    assert __spark_entry__.queries()["fn24_join10_candidates"](spark, SMALL).count() > 0
