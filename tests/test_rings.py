"""The ring kernels of a batch against plain polygons."""

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry, projection
from gridloom.functions import rings as R


def plain_clip(subject, clip):
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2
    clip = clip if area(clip) > 0 else clip[::-1]
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in subject]
        out = []
        for i, (p, s) in enumerate(zip(subject, side)):
            q, t = subject[(i + 1) % len(subject)], side[(i + 1) % len(subject)]
            out += [p] if s >= 0 else []
            if s > 0 > t or s < 0 < t:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        subject = out
        if not subject:
            return 0.0
    return abs(area(subject)) if len(subject) > 2 else 0.0


def packed(polygons):
    flat = np.array([c for p in polygons for c in p], float).reshape(-1, 2)
    return R.Rings.packed(flat[:, 0], flat[:, 1], np.array([len(p) for p in polygons], np.int64))


def stars(rng, n):
    """Simple polygons around random middles, 0 to 40 corners, some clockwise."""
    out = []
    for _ in range(n):
        k = int(rng.integers(0, 40))
        turn = np.sort(rng.uniform(0, 2 * np.pi, k))
        r, (x, y) = rng.uniform(0.3, 2, k), rng.uniform(-2, 2, 2)
        ring = [(x + a * np.cos(t), y + a * np.sin(t)) for a, t in zip(r, turn)]
        out.append(ring[::-1] if rng.random() < 0.5 else ring)
    return out


def convex(rng, n):
    out = []
    for _ in range(n):
        k = int(rng.integers(3, 7))
        turn, (x, y) = np.sort(rng.uniform(0, 2 * np.pi, k)), rng.uniform(-2, 2, 2)
        ring = [(x + 1.5 * np.cos(t), y + 1.5 * np.sin(t)) for t in turn]
        out.append(ring[::-1] if rng.random() < 0.5 else ring)
    return out


@pytest.mark.parametrize("slots", [R.SLOTS, 300])
def test_clipped_areas_equal_plain_clipping(monkeypatch, slots):
    monkeypatch.setattr(R, "SLOTS", slots)
    rng = np.random.default_rng(1)
    subjects, boxes = stars(rng, 600), convex(rng, 600)
    want = np.array([plain_clip(s, b) if len(s) > 2 else 0.0 for s, b in zip(subjects, boxes)])
    assert np.abs(R.clipped_area(packed(subjects), packed(boxes)) - want).max() < 1e-9
    assert np.abs(R.clipped(packed(subjects), packed(boxes)).area() - want).max() < 1e-9
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    beside = [[(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]]
    assert R.clipped_area(packed(square), packed(square))[0] == 1 and R.clipped_area(packed(square), packed(beside))[0] == 0
    assert len(R.clipped_area(packed([]), packed([]))) == 0


def test_canonical_rings_and_published_wkb():
    """The unit square as WKB: POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))."""
    want = struct.pack("<BIII10d", 1, 3, 1, 5, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0)
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    turned = [square[i:] + square[:i] for i in range(4)]
    rows = turned + [t[::-1] for t in turned] + [square[:3], []]
    missing = np.zeros(len(rows), bool)
    missing[-1] = True
    got = R.wkb(R.canonical(packed(rows)), missing).to_pylist()
    assert got[:8] == [want] * 8 and got[-1] is None
    assert got[8] == struct.pack("<BIII8d", 1, 3, 1, 4, 0, 0, 1, 1, 1, 0, 0, 0)


def test_projections_equal_the_column_expressions(spark):
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(73, 135, 500), rng.uniform(1, 54, 500)
    epsg = (32601 + np.floor((lon + 180) / 6)).astype(int)
    df = spark.createDataFrame(list(zip(range(500), lon.tolist(), lat.tolist(), epsg.tolist())), "i int, lon double, lat double, epsg int")
    rows = df.select("i", projection.utm_forward(F.col("lon"), F.col("lat"), F.col("epsg")).alias("m"), projection.equal_area(F.col("lon"), F.col("lat")).alias("a")).orderBy("i").collect()
    x, y = R.metres(lon, lat, epsg)
    assert np.abs(x - [r.m.x for r in rows]).max() < 1e-6 and np.abs(y - [r.m.y for r in rows]).max() < 1e-6
    back = R.degrees(x, y, epsg)
    assert np.abs(back[0] - lon).max() < 1e-11 and np.abs(back[1] - lat).max() < 1e-11
    flat = R.equal_area(lon, lat)
    assert np.abs(flat[0] - [r.a.x for r in rows]).max() < 1e-6 and np.abs(flat[1] - [r.a.y for r in rows]).max() < 1e-6


def test_checks_of_a_footprint(spark):
    from gridloom.functions.cells import canonical_bounds

    cells = spark.createDataFrame([(i, 32650, 400 + i, 2600) for i in range(5)] + [(5, None, 1, 1)], "i int, epsg int, col int, row int")
    ring = geometry.footprint(F.col("epsg"), canonical_bounds(F.col("col"), F.col("row")))
    moved = F.transform("ring", lambda p: F.struct((p["x"] + 1e-5).alias("x"), p["y"].alias("y")))
    rows = cells.withColumn("ring", ring).withColumn("ring", F.when(F.col("i") == 1, moved).when(F.col("i") == 2, F.slice("ring", 1, 3)).when(F.col("i") == 3, F.reverse("ring")).when(F.col("i") != 4, F.col("ring")))
    got = {r.i: r for r in rows.select("i", geometry.footprint_checks(F.col("epsg"), F.col("col"), F.col("row"), F.col("ring")).alias("c"), geometry.footprint_hash(F.col("ring")).alias("h")).collect()}
    assert got[0].c.difference < 1e-9 and got[0].c.valid and hashlib.sha256(bytes(got[0].c.wkb)).hexdigest() == got[0].h
    assert got[1].c.difference == pytest.approx(1e-5, rel=1e-3) and got[1].c.valid
    assert got[2].c.difference > 1e-3 and not got[2].c.valid  # the Hausdorff distance of a triangle
    assert got[3].c.difference < 1e-9 and got[3].c.valid
    assert got[4].c is None and got[4].h is None and got[5].c is None


def test_lists_with_nulls_keep_their_rows():
    rows = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 0.0, "y": 2.0}], None, [], [{"x": 1.0, "y": 1.0}]]
    rings, missing = R.of_arrow(pa.array(rows, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    assert rings.size.tolist() == [3, 0, 0, 1] and missing.tolist() == [False, True, False, False]
    assert rings.area().tolist() == [2, 0, 0, 0] and rings.arrow(missing).to_pylist() == rows
