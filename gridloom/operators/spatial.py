"""Spatial joins by buckets: candidates by equi-join on grid cells, exact tests after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import CELL_M, boxes_intersect, canonical_bounds, parent_key, utm_owner_epsg
from gridloom.functions.geometry import clipped, corners, densified, footprint_plane, overlap_area, ring_area, ring_bounds, segment_distance, zones_of
from gridloom.functions.projection import equal_area, utm_forward, utm_inverse
from gridloom.operators.ranking import settled


def edges_of(polygons: DataFrame) -> DataFrame:
    """(name, x1, y1, x2, y2) of the rings of (name, ring)."""
    after = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    pairs = F.explode(F.zip_with("ring", after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))))
    return polygons.select("name", pairs.alias("e")).select("name", "e.*")


def covered(points: DataFrame, polygons: DataFrame, band: float = 0.5) -> DataFrame:
    """(points..., name): points inside or on the outline of each polygon.

    Edges and points are dealt to bands of y; a point meets the edges of its band only, counts the
    crossings to its right, and is on the outline if it touches an edge. ``points``: point_id, x, y.
    """
    e = edges_of(polygons)
    low, high = F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)
    dealt = e.withColumn("band", F.explode(F.sequence(low, high)))
    rows = points.withColumn("band", F.floor(F.col("y") / band)).join(dealt, "band")
    x, y = F.col("x"), F.col("y")
    between = ((F.col("y1") > y) != (F.col("y2") > y))
    at = F.try_divide((F.col("x2") - F.col("x1")) * (y - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")
    crossing = F.when(between & (x < at), 1).otherwise(0)
    touch = segment_distance(x, y, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) == 0
    found = rows.groupBy("point_id", "name").agg(F.sum(crossing).alias("crossings"), F.max(touch).alias("touch"))
    return found.where("crossings % 2 = 1 or touch").select("point_id", "name")


NOT_COVERED = "ADM1_NOT_COVERED_BY_FROZEN_SOURCE"


def assigned_region(points: DataFrame, polygons: DataFrame, default: str = NOT_COVERED) -> DataFrame:
    """Points with the name of each region that covers them, or the default."""
    return points.join(covered(points, polygons), "point_id", "left").withColumn("name", F.coalesce("name", F.lit(default)))


def enumerate_cells(macros: DataFrame, boundary: DataFrame | None = None, side: int = 10) -> DataFrame:
    """The cells of macrocells whose centre the zone owns and the boundary covers.

    ``macros``: macro_id, grid_epsg, macro_col, macro_row; ``boundary``: name, ring.
    """
    steps = F.sequence(F.lit(0), F.lit(side - 1))
    rows = macros.withColumn("local_col", F.explode(steps)).withColumn("local_row", F.explode(steps))
    rows = rows.withColumn("grid_col", F.col("macro_col") * side + F.col("local_col")).withColumn("grid_row", F.col("macro_row") * side + F.col("local_row"))
    centre = utm_inverse((F.col("grid_col") + 0.5) * CELL_M, (F.col("grid_row") + 0.5) * CELL_M, F.col("grid_epsg"))
    rows = rows.withColumn("c", centre).withColumn("longitude", F.col("c.lon")).withColumn("latitude", F.col("c.lat")).drop("c")
    rows = rows.withColumn("parent_key", parent_key(F.col("grid_epsg"), F.col("grid_col"), F.col("grid_row"))).where(F.col("grid_epsg") == utm_owner_epsg(F.col("longitude"), F.col("latitude")))
    if boundary is None:
        return rows
    inside = covered(rows.select(F.col("parent_key").alias("point_id"), F.col("longitude").alias("x"), F.col("latitude").alias("y")), boundary)
    return rows.join(inside.select(F.col("point_id").alias("parent_key")).distinct(), "parent_key", "left_semi")


def grid_counts(macros: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    return enumerate_cells(macros, boundary).groupBy("grid_epsg").agg(F.count(F.lit(1)).alias("n"))


def buckets(box: Column, size: float) -> Column:
    at = lambda i: F.floor(F.get(box, F.lit(i)) / size)
    return F.flatten(F.transform(F.sequence(at(0), at(2)), lambda x: F.transform(F.sequence(at(1), at(3)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def placed_footprints(cells: DataFrame, size: float = 0.05) -> DataFrame:
    """(id, grid_epsg, box, flat, area, b): footprints of ``cells`` (id, grid_epsg, grid_col, grid_row) on the equal-area plane,
    once for each bucket that their box in degrees touches."""
    plane = footprint_plane(F.col("grid_epsg"), canonical_bounds(F.col("grid_col"), F.col("grid_row")))
    rows = cells.select("id", "grid_epsg", plane.alias("p")).select("id", "grid_epsg", "p.*")
    return rows.withColumn("b", F.explode(buckets(F.col("box"), size)))


def footprint_pairs(left: DataFrame, right: DataFrame, meets: Column, size: float = 0.05) -> DataFrame:
    """(left_id, right_id, area, fraction) of placed footprints l and r that overlap where ``meets``, reported by one bucket.

    Both sides may be large whatever their statistics say (those of a checkpoint are its source files'), so neither is broadcast.
    """
    left, right = left.hint("merge").alias("l"), right.hint("merge").alias("r")
    a, b = [F.get("l.box", F.lit(i)) for i in range(4)], [F.get("r.box", F.lit(i)) for i in range(4)]
    owner = (F.floor(F.greatest(a[0], b[0]) / size) == F.col("l.b.x")) & (F.floor(F.greatest(a[1], b[1]) / size) == F.col("l.b.y"))
    met = left.join(right, (F.col("l.b") == F.col("r.b")) & meets & boxes_intersect(a, b) & owner)
    pairs = met.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), F.col("l.flat").alias("p"), F.col("r.flat").alias("q"), F.least("l.area", "r.area").alias("smaller"))
    area = pairs.withColumn("area", overlap_area(F.col("p"), F.col("q"))).where("area > 0")
    return area.select("left_id", "right_id", "area", (F.col("area") / F.col("smaller")).alias("fraction"))


def overlap_pairs(cells: DataFrame, adjacent_only: bool = True, same_zone: bool = False, size: float = 0.05) -> DataFrame:
    """(left_id, right_id, area, fraction) of footprints that overlap, each pair once.

    ``cells``: id, grid_epsg, grid_col, grid_row. Boxes are dealt to buckets no smaller than a
    footprint and a pair is reported by one bucket. With ``adjacent_only`` zone n meets n + 1 only;
    with ``same_zone`` cells of one zone meet. Areas are in the equal-area projection.
    """
    if same_zone:
        return repeated_cells(cells)
    rows = placed_footprints(cells, size)
    if adjacent_only:
        meets = F.col("l.grid_epsg") + 1 == F.col("r.grid_epsg")
    else:
        meets = (F.col("l.id") < F.col("r.id")) & (F.col("l.grid_epsg") != F.col("r.grid_epsg"))
    return footprint_pairs(rows, rows, meets, size)


def repeated_cells(cells: DataFrame) -> DataFrame:
    """overlap_pairs of one zone: its cells lie on one lattice, so two that overlap are the same cell, and no footprint is asked.

    Degrees would not tell rows apart that are a whole meridian circle from each other.
    """
    place = ["grid_epsg", "grid_col", "grid_row"]
    side = lambda n: cells.select(F.col("id").alias(n), *place).hint("merge")
    pairs = side("left_id").join(side("right_id"), place).where("left_id < right_id")
    area = footprint_plane(F.col("grid_epsg"), canonical_bounds(F.col("grid_col"), F.col("grid_row")))["area"]
    return pairs.select("left_id", "right_id", area.alias("area"), F.lit(1.0).alias("fraction"))


def overlap_report(pairs: DataFrame, limit: float = 0.01) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("fraction") > limit).cast("long")).alias("over_limit"), F.max("fraction").alias("max_fraction"), F.sum("area").alias("overlap_area"))


def largest_overlap(cells: DataFrame, parts: DataFrame, size: float = 1.0, default: str = "unknown") -> DataFrame:
    """(id, name): for each convex cell ring the region whose parts overlap it most; the first in ``place`` on ties.

    ``parts``: name, place, ring (any simple polygon).
    """
    c = cells.select("id", F.col("ring").alias("clip"), F.explode(buckets(ring_bounds(F.col("ring")), size)).alias("b"))
    p = parts.select("name", "place", "ring", F.explode(buckets(ring_bounds(F.col("ring")), size)).alias("b"))
    pairs = c.join(p, "b").dropDuplicates(["id", "name", "place"])
    areas = pairs.withColumn("area", overlap_area(F.col("ring"), F.col("clip"))).where("area > 0")
    best = areas.groupBy("id").agg(F.min_by("name", F.struct(-F.col("area"), F.col("place"))).alias("name"))
    return cells.select("id").join(best, "id", "left").withColumn("name", F.coalesce("name", F.lit(default)))


def covered_share(cells: DataFrame, parts: DataFrame, size: float = 1.0, equal: bool = False) -> DataFrame:
    """(id, share): part of each cell's area that the polygons cover (parts do not overlap), ``equal``: on the equal-area plane."""
    flat = lambda c: F.transform(c, lambda p: equal_area(p["x"], p["y"])) if equal else F.col(c)
    c = cells.select("id", F.col("ring").alias("clip"), F.explode(buckets(ring_bounds(F.col("ring")), size)).alias("b"))
    p = parts.select("name", "place", "ring", F.explode(buckets(ring_bounds(F.col("ring")), size)).alias("b"))
    pairs = c.join(p, "b").dropDuplicates(["id", "name", "place"])
    areas = pairs.withColumn("area", overlap_area(flat("ring"), flat("clip"))).groupBy("id").agg(F.sum("area").alias("area"))
    whole = cells.select("id", ring_area(flat("ring")).alias("full"))
    return whole.join(areas, "id", "left").select("id", (F.coalesce("area", F.lit(0.0)) / F.col("full")).alias("share"))


def at_outline(cells: DataFrame, polygons: DataFrame, size: float = 0.05) -> DataFrame:
    """Cells (id, ring) whose box meets a bucket of the box of an edge: all that an outline passes, and some near one."""
    e = edges_of(polygons)
    box = F.array(F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"))
    dealt = e.select(F.explode(buckets(box, size)).alias("b")).distinct()
    return cells.withColumn("b", F.explode(buckets(ring_bounds(F.col("ring")), size))).join(dealt, "b", "left_semi").dropDuplicates(["id"]).select("id", "ring")


def coastal(cells: DataFrame, ocean: DataFrame, land: DataFrame, least: float = 0.001) -> DataFrame:
    """Cells (id, ring) that meet the ocean and of whose area land and the rest are ``least`` each at least.

    An outline of the land passes these; others are not clipped.
    """
    cells = settled(at_outline(cells, land))
    share = covered_share(cells, land, equal=True).join(covered_share(cells, ocean, equal=True).withColumnRenamed("share", "sea"), "id")
    return share.where((F.col("sea") > 0) & (F.col("share") >= least) & (1 - F.col("share") >= least)).select("id")


def near_outline(points: DataFrame, polygons: DataFrame, distance: float = 0.035, size: float = 0.05) -> DataFrame:
    """(point_id, distance): points within ``distance`` of an outline, by bucketed segments."""
    e = edges_of(polygons)
    box = F.array(F.least("x1", "x2") - distance, F.least("y1", "y2") - distance, F.greatest("x1", "x2") + distance, F.greatest("y1", "y2") + distance)
    dealt = e.withColumn("b", F.explode(buckets(box, size)))
    rows = points.withColumn("b", F.struct(F.floor(F.col("x") / size).alias("x"), F.floor(F.col("y") / size).alias("y"))).join(dealt, "b")
    d = segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return rows.groupBy("point_id").agg(F.min(d).alias("distance")).where(F.col("distance") <= distance)


def near_coast(points: DataFrame, ocean: DataFrame, boundary: DataFrame, distance: float = 0.035) -> DataFrame:
    """(point_id): points within ``distance`` of the ocean, where one inside has distance 0, and of the boundary's outline."""
    by_sea = near_outline(points, ocean, distance).select("point_id").unionByName(covered(points, ocean).select("point_id")).distinct()
    return by_sea.join(near_outline(points, boundary, distance).select("point_id"), "point_id")


def macro_inventory(parts: DataFrame, side_m: int = 12_800, step: float = 0.01) -> DataFrame:
    """(grid_epsg, macro_col, macro_row, land_fraction, estimated_patch_count, admin1) of macrocells with land.

    ``parts``: name, place and ring in degrees, without overlaps. A part is cut to the strip of each zone that
    it touches, its edges are divided (a meridian is curved on the plane), and it is projected; what is
    left is cut into columns of macrocells, then into cells. ``admin1`` is the name with the largest area.
    """
    box = ring_bounds(F.col("ring"))
    rows = parts.withColumn("box", box).withColumn("zone", F.explode(zones_of(F.get("box", F.lit(0)), F.get("box", F.lit(2)))))
    west = F.col("zone") * 6.0 - 186.0
    strip = clipped(F.col("ring"), west, F.get("box", F.lit(1)) - 0.01, west + 6, F.get("box", F.lit(3)) + 0.01)
    rows = rows.select("name", "place", (F.lit(32600) + F.col("zone")).cast("int").alias("grid_epsg"), strip.alias("ring")).where(F.size("ring") >= 3)
    metres = F.transform(densified(F.col("ring"), step), lambda p: utm_forward(p["x"], p["y"], F.col("grid_epsg")))
    rows = rows.withColumn("ring", metres).withColumn("box", ring_bounds(F.col("ring")))
    at = lambda i: F.floor(F.get("box", F.lit(i)) / side_m).cast("int")
    columns = rows.withColumn("macro_col", F.explode(F.sequence(at(0), at(2))))
    left = F.col("macro_col") * side_m
    column = clipped(F.col("ring"), left, F.get("box", F.lit(1)) - 1, left + side_m, F.get("box", F.lit(3)) + 1)
    columns = columns.withColumn("ring", column).where(F.size("ring") >= 3).withColumn("box", ring_bounds(F.col("ring")))
    cells = columns.withColumn("macro_row", F.explode(F.sequence(at(1), at(3))))
    square = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners(canonical_bounds(F.col("macro_col"), F.col("macro_row"), side_m))])
    cells = cells.withColumn("area", overlap_area(F.col("ring"), square)).where("area > 0")
    named = cells.groupBy("grid_epsg", "macro_col", "macro_row", "name").agg(F.sum("area").alias("area"), F.min("place").alias("place"))
    share = F.sum("area") / float(side_m) ** 2
    best = F.min_by("name", F.struct(-F.col("area"), F.col("place")))
    found = named.groupBy("grid_epsg", "macro_col", "macro_row").agg(F.round(share, 6).alias("land_fraction"), F.round(share * 100, 3).alias("estimated_patch_count"), best.alias("admin1"))
    return found.where("land_fraction > 0")


def inventory_summary(macros: DataFrame) -> DataFrame:
    """Totals, estimated patches and a hundredth of them by zone, province and overall (rollup)."""
    return macros.rollup("grid_epsg", "admin1").agg(F.count(F.lit(1)).alias("macrocells"), F.sum("estimated_patch_count").alias("patches"), (F.sum("estimated_patch_count") * 0.01).alias("one_percent"))


def patch_grid(extents: DataFrame, width: float, height: float) -> DataFrame:
    """Cells of (name, left, bottom, right, top), column by column, clipped at the far edges, with ids pCCC_rRRR."""
    cols = F.greatest(F.ceil((F.col("right") - F.col("left")) / width), F.lit(1))
    rows = F.greatest(F.ceil((F.col("top") - F.col("bottom")) / height), F.lit(1))
    grid = extents.withColumn("c", F.explode(F.sequence(F.lit(0), cols - 1))).withColumn("r", F.explode(F.sequence(F.lit(0), rows - 1)))
    x, y = F.col("left") + F.col("c") * width, F.col("bottom") + F.col("r") * height
    box = F.array(x, y, F.least(x + width, F.col("right")), F.least(y + height, F.col("top")))
    return grid.select("name", F.format_string("p%03d_r%03d", F.col("c").cast("int"), F.col("r").cast("int")).alias("patch_id"), box.alias("bounds"))


def aligned_window(pixels: DataFrame, width: int, height: int, nodata: float) -> DataFrame:
    """Every pixel (x, y) of each patch's window, values where there are any, else ``nodata``.

    ``pixels``: patch_id, x, y as offsets in the window; those outside are dropped.
    """
    ids = pixels.select("patch_id").distinct()
    window = ids.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return window.join(pixels, ["patch_id", "x", "y"], "left").withColumn("value", F.coalesce("value", F.lit(nodata)))
