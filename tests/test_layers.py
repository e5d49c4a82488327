"""Layers, seeds, hash texts and statuses of the registry, against plain versions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import composite, frames, membership, overlaps, registry, sampling, spatial

CANDIDATES = "macro_id string, grid_id string, local_col int, local_row int, parent_key string"
RING = "array<struct<x:double,y:double>>"


def digest(seed, text):
    return hashlib.sha256(f"{seed}:{text}".encode()).hexdigest()


def drawn(cells, seed, label, count, first=0):
    """Plain walk: macrocells by hash, in each the first cell by the hash under seed + number chosen before."""
    macros = sorted({c[0] for c in cells}, key=lambda m: digest(seed, label + m))[:count]
    out = []
    for m in macros:
        own = seed + first + len(out)
        out.append((m, min((c for c in cells if c[0] == m), key=lambda c: digest(own, f"candidate-cell:{m}:{c[2]}:{c[3]}"))[4]))
    return out


def grid(macros, zone=50):
    name = f"utm{zone}n"
    return [(f"{name}_c{m}_r0", name, i % 10, i // 10, f"{zone}:{m}:{i}") for m in macros for i in range(0, 100, 7)]


def test_fallback_goes_on_counting_and_names_its_status(spark):
    strict, near = grid(range(4)), grid(range(12))
    got = sampling.with_fallback(spark.createDataFrame(strict, CANDIDATES), spark.createDataFrame(near, CANDIDATES), 9, 7).collect()
    want = [(*x, "verified_boundary_crossing_ocean") for x in drawn(strict, 9, "coastal:macro:", 4)]
    rest = [c for c in near if c[0] not in {x[0] for x in strict}]
    want += [(*x, "near_coast_pending") for x in drawn(rest, 9, "near-coast-fallback:", 3, 4)]
    assert sorted((r.macro_id, r.parent_key, r.status) for r in got) == sorted(want)
    with pytest.raises(ValueError):
        sampling.with_fallback(spark.createDataFrame(strict, CANDIDATES), spark.createDataFrame(near, CANDIDATES), 9, 13)


def test_balanced_cells_are_seeded_by_zone(spark):
    cells = grid(range(9), 49) + grid(range(100, 104), 50)
    got = sampling.spatially_balanced(spark.createDataFrame(cells, CANDIDATES), 11, 5).collect()
    want = []
    for zone, quota in ((49, 3), (50, 2)):
        want += drawn([c for c in cells if c[1] == f"utm{zone}n"], 11 + zone, "utm_spatial_balance_supplement:macro:", quota)
    assert sorted((r.macro_id, r.parent_key) for r in got) == sorted(want)


def test_unknown_regions_are_skipped_or_capped(spark):
    pool = spark.createDataFrame([(f"p{i}", f"m{i}", "unknown" if i < 3 else None if i < 6 else "south", "s", i + 1) for i in range(9)], "patch_id string, macro_id string, region string, stratum string, place int")
    base = spark.createDataFrame([("b", "m", None, ["s"])], "patch_id string, macro_id string, region string, strata array<string>")
    fill = lambda allow: sorted(r.patch_id for r in sampling.fill_quotas(pool, base, {"s": 5}, 1, 0.5, 100, allow).collect())
    assert fill(False) == ["p6", "p7", "p8"]
    assert fill(True) == ["p0", "p1", "p6", "p7"]  # the base row counts for the unknown region, whose cap is 3


def test_overlap_removes_the_supplement_and_then_the_larger_hash(spark):
    rows = [("west", 32646, 607, 2911, "base_expected_1pct"), ("east", 32647, 173, 2911, "utm_spatial_balance_supplement")]
    columns = "id string, grid_epsg int, grid_col int, grid_row int, layer string"
    assert [r.id for r in overlaps.losers(spark.createDataFrame(rows, columns)).collect()] == ["east"]
    same = [(*r[:4], "coastal_supplement") for r in rows]
    assert [r.id for r in overlaps.losers(spark.createDataFrame(same, columns)).collect()] == [max("west", "east", key=lambda i: digest(0, i))]
    assert sampling.PRIORITY["utm_spatial_balance_supplement"] < sampling.PRIORITY["coastal_supplement"]


def test_near_coast_counts_points_in_the_sea(spark):
    square = lambda x0, x1: [(x0, 0.0), (x1, 0.0), (x1, 10.0), (x0, 10.0)]
    shape = lambda name, x0, x1: spark.createDataFrame([(name, square(x0, x1))], f"name string, ring {RING}")
    points = spark.createDataFrame([(1, 5.01, 5.0), (2, 4.99, 5.0), (3, 5.2, 5.0), (4, 4.8, 5.0)], "point_id int, x double, y double")
    got = spatial.near_coast(points, shape("sea", 4.5, 9.0), shape("land", 0.0, 5.0))
    assert sorted(r.point_id for r in got.collect()) == [1, 2]


def test_fusion_of_large_scores(spark):
    rows = spark.createDataFrame([("p", 1, 900.0, 2.0, True), ("p", 1, 901.0, 4.0, True), ("p", 1, 9999.0, 8.0, False), ("q", 1, 5.0, 3.0, False)], "patch_id string, month int, score double, value double, available boolean")
    got = {r.patch_id: r.value for r in frames.fused(rows).collect()}
    assert got["p"] == pytest.approx((2 + 4 * math.e) / (1 + math.e)) and got["q"] == 0


def test_digest_does_not_depend_on_partitions_or_buckets(spark, monkeypatch):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    one = membership.content_digest(rows, ["id", "v"]).first()
    monkeypatch.setattr(membership, "DIGEST_ROWS", 10)
    monkeypatch.setattr(membership, "DIGEST_FAN", 8)
    many = [membership.content_digest(x, ["id", "v"]).first() for x in (rows, rows.repartition(9))]
    assert many[0] == many[1] and many[0].n == one.n == 5000
    assert membership.content_digest(rows.limit(4999), ["id", "v"]).first().digest != many[0].digest
    assert membership.content_digest(rows.limit(0), ["id", "v"]).first().n == 0


def test_crowded_cells_give_the_same_pairs(spark):
    boxes = lambda n, step, size: [(i, [i * step % 3.0 - 1.5, i * 0.37 % 2.0 - 1.0, i * step % 3.0 - 1.5 + size, i * 0.37 % 2.0 - 1.0 + size]) for i in range(n)]
    p, q = boxes(120, 0.211, 0.4), boxes(300, 0.137, 0.7)
    want = sorted((a, b) for a, u in p for b, v in q if u[0] < v[2] and u[2] > v[0] and u[1] < v[3] and u[3] > v[1])
    patches, items = spark.createDataFrame(p, "patch_id int, bbox array<double>"), spark.createDataFrame(q, "item_id int, bbox array<double>")
    for dense in (5, 60, 100_000):
        assert sorted(tuple(r) for r in composite.match_items(patches, items, dense=dense).collect()) == want


def test_layered_registry_fills_every_layer(spark):
    whole = spark.createDataFrame([("all", [(60.0, 0.0), (150.0, 0.0), (150.0, 80.0), (60.0, 80.0)])], f"name string, ring {RING}")
    inventory = "macro_id string, grid_id string, local_col int, local_row int, parent_key string, grid_epsg int, grid_col int, grid_row int, longitude double, latitude double"
    cells = [(f"utm50n_c{m}_r250", "utm50n", i, 0, f"32650:{m * 10 + i}:2500", 32650, m * 10 + i, 2500, 117.0 + m / 100, 29.0) for m in range(30, 60) for i in range(10)]
    rows = spark.createDataFrame(cells, inventory)
    record = "place int, patch_id string, grid_epsg int, grid_id string, grid_col int, grid_row int, macro_id string, longitude double, latitude double, sampling_tier string"
    old = [(i, f"p{i // 2}" if i < 2 else f"p{i}", 32650, "utm50n", 300 + i, 2500, f"utm50n_c{30 + i // 10}_r250", 117.1, 29.0, "base_spatial" if i < 8 else "semantic_audit_reserve") for i in range(12)]
    coast = rows.where("grid_col >= 500")
    targets = {"base_expected_1pct": 5, "coastal_supplement": 4, "utm_spatial_balance_supplement": 6, "semantic_and_difficult_supplement": 3}
    found = registry.layered_registry(spark.createDataFrame(old, record), rows, coast, coast, targets, 7, whole, whole).collect()
    by_layer = {k: [r for r in found if r.layer == k] for k in targets}
    assert {k: len(v) for k, v in by_layer.items()} == targets
    assert len({(r.grid_epsg, r.grid_col, r.grid_row) for r in found}) == len(found)
    supplements = [r.macro_id for r in found if r.layer != "base_expected_1pct"]
    assert len(set(supplements)) == len(supplements)
    assert {r.inclusion_probability for r in by_layer["base_expected_1pct"]} == {0.01} and {r.admin1 for r in found} == {"all"}
    base = sorted(r.macro_id for r in by_layer["base_expected_1pct"])
    assert "utm50n_c30_r250" in base and len(set(base)) == 5
    used = set(base)
    plain = [c[:5] for c in cells if c[0] != "utm50n_c30_r250"]
    topped = drawn(plain, 7 + 5, "base_expected_1pct:macro:", 4)
    assert {m for m, _ in topped} == used - {"utm50n_c30_r250"}
    taken = {k for _, k in topped} | {f"32650:{r.grid_col}:{r.grid_row}" for r in by_layer["base_expected_1pct"]}
    sea = drawn([c[:5] for c in cells if c[6] >= 500 and c[4] not in taken], 7 + 4, "coastal:macro:", 4)
    assert sorted(k for _, k in sea) == sorted(f"32650:{r.grid_col}:{r.grid_row}" for r in by_layer["coastal_supplement"])


def test_repair_moves_records_to_their_owner(spark):
    whole = spark.createDataFrame([("all", [(60.0, 0.0), (150.0, 0.0), (150.0, 80.0), (60.0, 80.0)])], f"name string, ring {RING}")
    record = "place int, patch_id string, grid_epsg int, grid_id string, grid_col int, grid_row int, macro_id string, longitude double, latitude double"
    rows = [(1, "a", 32651, "utm51n", 5, 5, "m", 117.2, 30.0), (2, "b", 32650, "utm50n", 6, 6, "m", 117.2, 31.0), (3, "b", 32650, "utm50n", 7, 7, "m", 117.3, 31.0), (4, "c", 32651, "utm51n", 8, 8, "m", 117.2, 85.0)]
    kept, report = registry.repaired(spark.createDataFrame(rows, record), whole)
    got = {r.place: r for r in kept.collect()}
    assert set(got) == {1, 2} and got[1].grid_epsg == 32650 and got[1].patch_id == f"ownerfix_epsg32650_c{got[1].grid_col}_r{got[1].grid_row}"
    assert got[1].macro_id == f"utm50n_c{got[1].grid_col // 10}_r{got[1].grid_row // 10}" and abs(got[1].longitude - 117.2) < 0.01
    assert tuple(report.first()) == (2, 1, 1, 1)


def test_inventory_keeps_the_area_of_its_parts(spark):
    from gridloom.functions.geometry import ring_area
    from gridloom.functions.projection import equal_area

    ring = [(116.3, 30.0), (121.4, 30.2), (120.9, 31.1), (118.0, 30.7), (116.5, 31.0)]
    parts = spark.createDataFrame([("a", 0, ring)], f"name string, place int, ring {RING}")
    got = spatial.macro_inventory(parts).collect()
    assert {r.grid_epsg for r in got} == {32650, 32651} and {r.admin1 for r in got} == {"a"}
    area = parts.select(ring_area(F.transform("ring", lambda p: equal_area(p["x"], p["y"]))).alias("a")).first().a
    assert sum(r.land_fraction for r in got) * 12_800**2 == pytest.approx(area, rel=2e-3)
    assert all(0 < r.land_fraction <= 1 for r in got)


def test_a_layer_is_filled_up_after_an_overlap(spark):
    columns = "macro_id string, id string, parent_key string, local_col int, local_row int, grid_epsg int, grid_row int, grid_col int"
    rows = [("m1", "west", "west", 7, 1, 32646, 2911, 607, "base_expected_1pct"), ("m2", "east", "east", 3, 1, 32647, 2911, 173, "utm_spatial_balance_supplement")]
    pool = [(m, f"{m}{i}", f"{m}{i}", i, 0, 32646, 2911, 400 + 10 * k + i) for k, m in enumerate(("m2", "m5", "m6")) for i in range(5)]
    got = overlaps.resolved(spark.createDataFrame(rows, columns + ", layer string"), {k: spark.createDataFrame(pool, columns) for k in sampling.PRIORITY}, 3).collect()
    plain = [(c[0], "", c[3], c[4], c[2]) for c in pool if c[0] != "m2"]
    want = drawn(plain, 3 + 70_000 + 1, "utm_spatial_balance_supplement:macro:", 1)
    assert sorted((r.macro_id, r.id, r.layer) for r in got) == sorted([("m1", "west", "base_expected_1pct"), (*want[0], "utm_spatial_balance_supplement")])
