"""Footprints and rings: arrays of (x, y) corners, without the closing one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, StructField, StructType

from gridloom.functions import rings as R
from gridloom.functions.cells import CELL_M, canonical_bounds, parent_key, utm_owner_epsg
from gridloom.functions.projection import CIRCLE, let, utm_forward, utm_inverse


RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
#: How far the sides and the area of a cell may be off, in metres and square metres.
SIDE_TOLERANCE, AREA_TOLERANCE = 1e-3, 1.0


def corners(bounds: Column) -> list[tuple[Column, Column]]:
    """Lower left, lower right, upper right, upper left of array(left, bottom, right, top)."""
    left, bottom, right, top = (F.get(bounds, F.lit(i)).cast("double") for i in range(4))
    return [(left, bottom), (right, bottom), (right, top), (left, top)]


def footprint(epsg: Column, bounds: Column) -> Column:
    """array<struct<x, y>>: the cell's corners in degrees."""
    return _footprint(epsg.cast("long"), F.transform(bounds, lambda v: v.cast("double")))


@F.arrow_udf(RING)
def _footprint(epsg: pa.Array, bounds: pa.Array) -> pa.Array:
    rings, missing = _degrees(epsg, bounds)
    return rings.arrow(missing)


def _degrees(epsg: pa.Array, bounds: pa.Array) -> tuple[R.Rings, np.ndarray]:
    """Rings in degrees of boxes array(left, bottom, right, top) in metres of their zones, and which are missing."""
    zone, missing = R.column(epsg, np.int64)
    missing = missing | np.asarray(bounds.is_null())
    box = np.zeros((len(zone), 4))
    box[~np.asarray(bounds.is_null())] = bounds.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    x, y = R.degrees(box[:, [0, 2, 2, 0]], box[:, [1, 1, 3, 3]], zone[:, None])
    return R.Rings(x, y, np.where(missing, 0, 4)), missing


def footprint_plane(epsg: Column, bounds: Column) -> Column:
    """struct(box, flat, area): a cell's box in degrees (west, south, east, north), its ring on the equal-area plane and its area there."""
    return _plane(epsg.cast("long"), F.transform(bounds, lambda v: v.cast("double")))


@F.arrow_udf(StructType([StructField("box", ArrayType(DoubleType())), StructField("flat", RING), StructField("area", DoubleType())]))
def _plane(epsg: pa.Array, bounds: pa.Array) -> pa.Array:
    ring, missing = _degrees(epsg, bounds)
    sides = np.stack([ring.x.min(1, initial=np.inf), ring.y.min(1, initial=np.inf), ring.x.max(1, initial=-np.inf), ring.y.max(1, initial=-np.inf)], 1)
    flat = R.Rings(*R.equal_area(ring.x, ring.y), ring.size)
    box = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(sides) + 1, 4, np.int32)), pa.array(sides.ravel()))
    return pa.StructArray.from_arrays([box, flat.arrow(), pa.array(flat.area())], ["box", "flat", "area"], mask=pa.array(missing))


def ring_bounds(ring: Column) -> Column:
    part = lambda r, k: F.transform(r, lambda p: p[k])
    return let(ring, lambda r: F.array(F.array_min(part(r, "x")), F.array_min(part(r, "y")), F.array_max(part(r, "x")), F.array_max(part(r, "y"))))


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area; rings of fewer than three corners have none."""

    def area(r: Column) -> Column:
        return F.when(F.size(r) >= 3, F.abs(doubled_area(r)) / 2).otherwise(0.0)

    return let(ring, area)


def following(r: Column) -> Column:
    """The ring turned by one corner."""
    return F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def doubled_area(r: Column) -> Column:
    terms = F.zip_with(r, following(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def canonical_ring(ring: Column, digits: int = 9) -> Column:
    """Rounded, counter-clockwise, starting at the least corner: equal for equal outlines."""
    rounded = F.transform(ring, lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))
    wound = let(rounded, lambda r: F.when(doubled_area(r) < 0, F.reverse(r)).otherwise(r))

    def turned(r: Column) -> Column:
        at = F.array_position(r, F.array_min(r)).cast("int")
        return F.concat(F.slice(r, at, F.size(r)), F.slice(r, F.lit(1), at - 1))

    return let(wound, turned)


def footprint_hash(ring: Column) -> Column:
    """SHA-256 of the WKB of the canonical ring: 9 decimals, clockwise from the least corner, closed, little-endian."""
    return F.sha2(_wkb(ring, F.lit(True)), 256)


def ring_wkb(ring: Column) -> Column:
    """Little-endian WKB polygon with one closed ring, the corners as they are."""
    return _wkb(ring, F.lit(False))


@F.arrow_udf(BinaryType())
def _wkb(ring: pa.Array, canonical: pa.Array) -> pa.Array:
    rings, missing = R.of_arrow(ring)
    return R.wkb(R.canonical(rings) if len(canonical) and canonical[0].as_py() else rings, missing)


def vertex_difference(a: Column, b: Column) -> Column:
    """Largest coordinate difference of corresponding corners of two canonical rings; null if their counts differ."""
    diff = F.zip_with(canonical_ring(a), canonical_ring(b), lambda p, q: F.greatest(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"])))
    return F.when(F.size(a) == F.size(b), F.array_max(diff))


def hausdorff(a: Column, b: Column) -> Column:
    """Largest distance from a corner of either ring to the other ring's outline."""
    return F.greatest(_one_way(a, b), _one_way(b, a))


def _one_way(a: Column, b: Column) -> Column:
    return F.array_max(F.transform(a, lambda p: distance_to_ring(p["x"], p["y"], b)))


def distance_to_ring(x: Column, y: Column, ring: Column) -> Column:
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.array_min(F.zip_with(ring, after, lambda p, q: segment_distance(x, y, p["x"], p["y"], q["x"], q["y"])))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def cell_is_valid(epsg: Column, ring: Column, side: float = CELL_M, side_tolerance: float = SIDE_TOLERANCE, area_tolerance: float = AREA_TOLERANCE) -> Column:
    """Projected back to its zone, a footprint is a square of the nominal side and area."""

    def square(flat: Column) -> Column:
        close = lambda b, i: F.abs(F.get(b, F.lit(i + 2)) - F.get(b, F.lit(i)) - side) <= side_tolerance
        sides = let(ring_bounds(flat), lambda b: close(b, 0) & close(b, 1))
        return sides & (F.abs(ring_area(flat) - side * side) <= area_tolerance)

    def whole(flat: Column) -> Column:
        """Half a circle up, northings start again; a ring across that place goes on."""
        top = F.array_max(F.transform(flat, lambda p: p["y"]))
        return F.transform(flat, lambda p: F.struct(p["x"].alias("x"), (p["y"] + F.when(top - p["y"] > CIRCLE / 2, CIRCLE).otherwise(0.0)).alias("y")))

    return let(let(F.transform(ring, lambda p: utm_forward(p["x"], p["y"], epsg)), whole), square)


def patch_bounds(epsg: Column, col: Column, row: Column) -> Column:
    """array(west, south, east, north) from two opposite corners."""
    b = canonical_bounds(col, row)
    get = lambda i: F.get(b, F.lit(i)).cast("double")
    both = F.struct(utm_inverse(get(0), get(1), epsg).alias("p"), utm_inverse(get(2), get(3), epsg).alias("q"))
    pick = lambda f, b, k: f(b["p"][k], b["q"][k])
    return let(both, lambda b: F.array(pick(F.least, b, "lon"), pick(F.least, b, "lat"), pick(F.greatest, b, "lon"), pick(F.greatest, b, "lat")))


def snap_to_owner(lon: Column, lat: Column, side: float = CELL_M) -> Column:
    """struct(epsg, col, row, lon, lat, key, owned): the owner cell of a point; owned if its centre has the same owner."""

    def owner(epsg: Column) -> Column:
        return let(utm_forward(lon, lat, epsg), lambda xy: cell(epsg, F.floor(xy["x"] / side).cast("int"), F.floor(xy["y"] / side).cast("int")))

    def cell(epsg: Column, col: Column, row: Column) -> Column:
        return let(
            F.struct(col.alias("col"), row.alias("row"), utm_inverse((col + 0.5) * side, (row + 0.5) * side, epsg).alias("c")),
            lambda s: F.struct(
                epsg.alias("epsg"), s["col"].alias("col"), s["row"].alias("row"), s["c"]["lon"].alias("lon"), s["c"]["lat"].alias("lat"), parent_key(epsg, s["col"], s["row"]).alias("key"), (utm_owner_epsg(s["c"]["lon"], s["c"]["lat"]) == epsg).alias("owned")
            ),
        )

    return let(utm_owner_epsg(lon, lat), owner)


def densified(ring: Column, step: float = 0.01) -> Column:
    """Each edge cut into pieces no longer than ``step``, order kept."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def cut(p: Column, q: Column) -> Column:
        n = F.greatest(F.ceil(F.hypot(q["x"] - p["x"], q["y"] - p["y"]) / step).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((p["x"] + (q["x"] - p["x"]) * i / n).alias("x"), (p["y"] + (q["y"] - p["y"]) * i / n).alias("y")))

    return F.flatten(F.zip_with(ring, after, cut))


def zones_of(west: Column, east: Column) -> Column:
    """UTM zones that an extent touches."""
    zone = lambda x: F.least(F.greatest(F.floor((x + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")
    return F.sequence(zone(west), zone(east))


def clipped(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """The ring's part inside a box; empty where they do not meet."""
    w, s, e, n = (c.cast("double") for c in (west, south, east, north))
    return _clipped(ring, F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((w, s), (e, s), (e, n), (w, n))]))


@F.arrow_udf(RING)
def _clipped(subject: pa.Array, box: pa.Array) -> pa.Array:
    (a, missing), (b, also) = R.of_arrow(subject), R.of_arrow(box)
    return R.clipped(a, b).arrow(missing | also)


def overlap_area(subject: Column, clip: Column) -> Column:
    """Area of ring ``subject`` inside the convex ring ``clip``."""
    return _overlap(subject, clip)


@F.arrow_udf(DoubleType())
def _overlap(subject: pa.Array, clip: pa.Array) -> pa.Array:
    (a, missing), (b, also) = R.of_arrow(subject), R.of_arrow(clip)
    return pa.array(R.clipped_area(a, b), mask=missing | also)


def clip_area(subject: np.ndarray, clip: np.ndarray) -> float:
    """Area of one polygon inside a convex one."""
    one = lambda ring: R.Rings.packed(ring[:, 0], ring[:, 1], np.array([len(ring)]))
    return float(R.clipped_area(one(subject), one(clip))[0])


def footprint_checks(epsg: Column, col: Column, row: Column, ring: Column) -> Column:
    """struct(difference, wkb, valid) of a cell's ring, all of a batch at once: the greatest difference of its corners from the
    nominal footprint's (the Hausdorff distance where their numbers differ), the WKB of the canonical ring, and whether the ring
    is a cell's square when projected back to its zone. Null for a null ring or cell."""
    return _checks(epsg.cast("long"), col.cast("long"), row.cast("long"), ring)


@F.arrow_udf(StructType([StructField("difference", DoubleType()), StructField("wkb", BinaryType()), StructField("valid", BooleanType())]))
def _checks(epsg: pa.Array, col: pa.Array, row: pa.Array, ring: pa.Array) -> pa.Array:
    (zone, m0), (c, m1), (r, m2) = (R.column(v, np.int64) for v in (epsg, col, row))
    rings, m3 = R.of_arrow(ring)
    missing = m0 | m1 | m2 | m3
    own = R.canonical(rings)
    apart = R.difference(own, R.canonical(R.squares(c, r, zone, float(CELL_M))))
    square = R.square_again(R.canonical(rings, 12), zone, float(CELL_M), SIDE_TOLERANCE, AREA_TOLERANCE)
    return pa.StructArray.from_arrays([pa.array(apart), R.wkb(own, m3), pa.array(square)], ["difference", "wkb", "valid"], mask=pa.array(missing))
