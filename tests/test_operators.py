"""Hand values of operators that SQL does not express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry, projection
from gridloom.functions.cells import canonical_bounds
from gridloom.operators import audits, composite, evaluation, manifest, overlaps, partition, probes, sampling, spatial
from gridloom.operators.ranking import exact_rank
from gridloom.sources import records, sinks

RING = "array<struct<x:double,y:double>>"


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_projection_round_trip_and_cell_shape(spark):
    rows = spark.createDataFrame([(116.3, 39.85, 32650), (73.5, 18.2, 32643), (134.9, 53.0, 32653)], "lon double, lat double, epsg int")
    xy = rows.withColumn("u", projection.utm_forward(F.col("lon"), F.col("lat"), F.col("epsg")))
    for r in xy.select("*", projection.utm_inverse(F.col("u.x"), F.col("u.y"), F.col("epsg")).alias("b")).collect():
        assert abs(r.b.lon - r.lon) < 1e-9 and abs(r.b.lat - r.lat) < 1e-9
    ring = geometry.footprint(F.lit(32643), canonical_bounds(F.lit(312), F.lit(3346)))
    r = spark.range(1).select(ring.alias("r")).select(geometry.cell_is_valid(F.lit(32643), F.col("r")).alias("ok"), F.length(geometry.ring_wkb(F.col("r"))).alias("n")).first()
    assert r.ok and r.n == 93


def test_equal_area_keeps_areas(spark):
    ring = spark.createDataFrame([(square(100.0, 30.0, 0.01),)], f"r {RING}")
    area = ring.select(geometry.ring_area(F.transform("r", lambda p: projection.equal_area(p["x"], p["y"]))).alias("a")).first().a
    e2, phi = projection.E2, math.radians(30.005)
    m, n = projection.A * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5, projection.A / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    assert area == pytest.approx(math.radians(0.01) ** 2 * m * n * math.cos(phi), rel=1e-6)


def test_ring_functions(spark):
    rows = spark.createDataFrame([(square(0.0, 0.0, 2.0), list(reversed(square(0.0, 0.0, 2.0)))[1:] + [(0.0, 2.0)])], f"a {RING}, b {RING}")
    a, b = F.col("a"), F.col("b")
    r = rows.select((geometry.footprint_hash(a) == geometry.footprint_hash(b)).alias("same"), geometry.vertex_difference(a, b).alias("d"), geometry.hausdorff(a, F.transform(a, lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y")))).alias("h"), F.size(geometry.densified(a, 0.5)).alias("n")).first()
    assert r.same and r.d == 0 and r.h == 1 and r.n == 16


def test_clip_areas():
    box = np.array(square(0.0, 0.0, 2.0))
    assert geometry.clip_area(np.array(square(1.0, 1.0, 5.0)), box) == pytest.approx(1)
    assert geometry.clip_area(np.array([(0, 0), (4, 0), (0, 4)], float), box[::-1]) == pytest.approx(4)
    assert geometry.clip_area(np.array([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)], float), box) == pytest.approx(3)
    assert geometry.clip_area(np.array(square(5.0, 5.0, 1.0)), box) == 0


def test_covered_includes_the_outline(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 1.5, 0.5), (4, 0.0, 0.0)], "point_id int, x double, y double")
    shape = spark.createDataFrame([("a", square(0.0, 0.0, 1.0))], f"name string, ring {RING}")
    assert sorted(r.point_id for r in spatial.covered(points, shape).collect()) == [1, 2, 4]


def test_largest_overlap_and_shares(spark):
    cells = spark.createDataFrame([("c", square(0.0, 0.0, 2.0)), ("d", square(9.0, 9.0, 1.0))], f"id string, ring {RING}")
    parts = spark.createDataFrame([("west", 0, square(-1.0, 0.0, 1.5, 2.0)), ("east", 1, square(0.5, 0.0, 3.0, 2.0))], f"name string, place int, ring {RING}")
    assert {r.id: r.name for r in spatial.largest_overlap(cells, parts).collect()} == {"c": "east", "d": "unknown"}
    assert {r.id: r.share for r in spatial.covered_share(cells, parts).collect()} == {"c": pytest.approx(1), "d": 0}
    sea = spark.createDataFrame([("sea", 0, square(1.0, 0.0, 3.0, 2.0))], f"name string, place int, ring {RING}")
    land = spark.createDataFrame([("land", 0, square(-1.0, 0.0, 2.0, 2.0))], f"name string, place int, ring {RING}")
    assert [r.id for r in spatial.coastal(cells, sea, land).collect()] == ["c"]


def test_overlap_pairs_of_neighbouring_zones(spark):
    rows = spark.createDataFrame([("w", 32646, 600, 3000), ("e", 32647, 156, 3000), ("f", 32647, 300, 3000)], "id string, grid_epsg int, grid_col int, grid_row int")
    lon = rows.select("id", geometry.patch_bounds(F.col("grid_epsg"), F.col("grid_col"), F.col("grid_row")).alias("b")).collect()
    pairs = spatial.overlap_pairs(rows).collect()
    boxes = {r.id: r.b for r in lon}
    touching = boxes["w"][0] < boxes["e"][2] and boxes["e"][0] < boxes["w"][2]
    assert {(p.left_id, p.right_id) for p in pairs} == ({("w", "e")} if touching else set())
    assert all(0 < p.fraction <= 1.001 for p in pairs)
    assert not spatial.overlap_pairs(rows, same_zone=True).collect()
    gone = overlaps.losers(rows.withColumn("layer", F.lit("base_expected_1pct")), 1).collect()
    assert len(gone) == sum(p.fraction > 0.01 for p in pairs)


def test_exact_rank_is_independent_of_partitions(spark):
    rows = spark.range(20_000).select("id", (F.col("id") * 7919 % 101).alias("v"))
    want = {r.id: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r.v, r.id)))}
    for n, buckets in ((1, 7), (17, 3), (5, 64)):
        assert {r.id: r["rank"] for r in exact_rank(rows.repartition(n), [F.col("v"), F.col("id")], buckets=buckets).collect()} == want


def test_equal_capacity_of_twelve_points(spark):
    rows = [(f"k{c}{r}", float(c), float(r)) for c in range(6) for r in range(2)]
    got = partition.equal_capacity(spark.createDataFrame(rows, "parent_key string, x double, y double"), [2] * 6).collect()
    assert sorted(r.shard_id for r in got) == sorted(list(range(1, 7)) * 2)
    assert partition.capacities(5_785_781, 10) == [578_578] * 9 + [578_579]
    halves = partition.equal_capacity(spark.createDataFrame(rows, "parent_key string, x double, y double"), [6, 6]).collect()
    assert {r.shard_id for r in halves if r.x < 3} == {1} and {r.shard_id for r in halves if r.x >= 3} == {2}


def test_dissolve_an_l_shape(spark):
    cells = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 2)], "col int, row int, shard_id int")
    got = {r.shard_id: (r.area, r.perimeter) for r in partition.dissolved(cells, ["shard_id"], 1).collect()}
    assert got == {1: (3, 8), 2: (1, 4)}
    assert partition.dissolved(cells, [], 1).first().area == 4
    corner = spark.createDataFrame([(0, 0, 1), (1, 1, 1)], "col int, row int, shard_id int")
    assert [(r.x, r.y) for r in partition.self_touching(corner, ["shard_id"]).collect()] == [(1, 1)]


def test_quota_fill_keeps_caps(spark):
    pool = spark.createDataFrame([(f"p{i}", f"m{i // 2}", "north" if i < 6 else "south", "s", i + 1) for i in range(8)], "patch_id string, macro_id string, region string, stratum string, place int")
    base = spark.createDataFrame([], "patch_id string, macro_id string, region string, strata array<string>")
    got = sampling.fill_quotas(pool, base, {"s": 2}, 1, 0.5, 100).collect()
    assert sorted(r.region for r in got) == ["north", "south"]
    assert [r.patch_id for r in sampling.fill_quotas(pool, base, {"s": 3}, 1, 1.0, 2).collect()] == ["p0", "p2"]


def test_sqrt_allocation(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 4)], "name string, n long")
    assert {r.name: r.quota for r in sampling.sqrt_allocation(rows, "name", "n", 12).collect()} == {"a": 10, "b": 2}


def test_seam_policy_of_the_national_grid(spark):
    numbers = [(2842239086.43, 5785781, 0, 0, 0)]
    report = spark.createDataFrame(numbers, "overlap_area double, cells long, same_zone_overlaps long, owner_mismatches long, hash_mismatches long")
    got = audits.seam_policy(report).first()
    assert got.passed and round(got.duplicate_fraction, 8) == 0.00029983
    assert not audits.seam_policy(report.withColumn("hash_mismatches", F.lit(1))).first().passed


def test_composite_strategies(spark):
    nan = float("nan")
    rows = [("p", "s1", 1, i, i, "vv", 0, v, ok) for i, (v, ok) in enumerate([(0.0, False), (2.0, True)])]
    rows += [("p", "s2", 1, i, i, "b", 0, v, True) for i, v in enumerate([1.0, nan, 9.0, 2.0])]
    px = spark.createDataFrame(rows, "patch_id string, source string, month int, scene_id int, scene_order int, band string, pixel int, value double, valid boolean")
    assert {r.source: r.value for r in composite.composite(px).collect()} == {"s1": 2.0, "s2": 2.0}
    scene = {r.source: r.value for r in composite.composite(px, "scene").collect()}
    assert scene["s1"] == 2.0 and math.isnan(scene["s2"])


def test_metrics_at_the_published_threshold(spark):
    rows = spark.createDataFrame([(3.0, 0.9, 1), (2.0, 0.8, 1), (-1.0, 0.2, 0), (5.0, 0.9, -1)], "logit double, score double, label int")
    m = evaluation.binary_metrics(rows, 0.7).first()
    assert (m.tp, m.fp, m.fn, m.f1) == (2, 0, 0, 1)
    r = evaluation.ranking_metrics(rows).first()
    assert r.average_precision == 1 and r.roc_auc == 1
    one = evaluation.ranking_metrics(rows.where("label = 1")).first()
    assert one.average_precision is None and one.roc_auc is None
    assert evaluation.best_threshold(rows).first().threshold == 0.8


def test_embedding_contract_and_uniformity(spark):
    unit = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert evaluation.embedding_contract(unit, 2).first().passed
    bad = spark.createDataFrame([(1, [1.0, 1.0]), (2, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    assert not evaluation.embedding_contract(bad, 2).first().passed
    assert evaluation.uniformity(unit).first().uniformity == pytest.approx(-4)
    assert evaluation.uniformity(unit.where("vec_id = 1")).first().uniformity == 0


def test_probes_separate_a_half_space(spark):
    draw = np.random.default_rng(1)
    rows = [([float(x) for x in v], int(v[0] > 0), ["train", "val", "test"][i % 3]) for i, v in enumerate(draw.normal(size=(300, 4)))]
    m = probes.evaluate(spark.createDataFrame(rows, "features array<double>, label int, split string")).first()
    assert m.f1 > 0.9 and m.roc_auc > 0.95


def test_manifest_round_trip_and_tampering(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r", {"s2": ["x/1"]}, None), ("b", "r", {"s2": None}, "a")], manifest.RECORD)
    path = str(tmp_path / "m")
    manifest.write_manifest(rows, path, [202401])
    assert manifest.load_manifest(spark, path, "r", [202401]).count() == 2
    with pytest.raises(ValueError):
        manifest.load_manifest(spark, path, "r", [202402])
    rows.limit(1).write.mode("append").json(f"{path}/records")
    assert not manifest.manifest_report(spark, path).first().passed
    with pytest.raises(ValueError):
        manifest.write_manifest(rows.unionAll(rows), str(tmp_path / "n"), [202401])


def test_strict_records_name_bad_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \n{"a": 2}\n')
    good, bad = records.read_records(spark, str(tmp_path / "r.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and sorted(r.line for r in bad.collect()) == ["[1]", '{"a": ']


def test_cell_sink_and_scan(spark, tmp_path):
    cells = spark.createDataFrame([(f"k{i}", "utm50n", i) for i in range(12)], "parent_key string, grid_id string, grid_row int")
    counts = sinks.write_cells(cells, cells.where("grid_row < 2"), str(tmp_path / "c"))
    assert {r.partition: r.n for r in counts.collect()} == {"all": 12, "sampled": 2, "unsampled": 10}
    assert records.scan_cells(spark, str(tmp_path / "c"), ["parent_key"], "sampled").count() == 2
    with pytest.raises(ValueError):
        records.scan_cells(spark, str(tmp_path / "c"), ["absent"])
    with pytest.raises(ValueError):
        records.load_fold(spark.createDataFrame([], "fold int, train array<string>, val array<string>, test array<string>"), 1)


def test_patch_grid_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"patches": [{"patch_id": "a", "bounds": [1.0, 2.0, 13.0, 14.0]}]}')
    grid = records.read_patch_grid(spark, str(tmp_path / "g.json"))
    r = records.grid_extent(grid).first()
    assert (r["left"], r["bottom"], r["right"], r["top"], r.width, r.height) == (0, 0, 20, 20, 2, 2)
