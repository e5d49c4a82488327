"""Keys, zones, bounds and hashes of 1,280 m cells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_M = 1280
MACRO_SIDE = 10
FIRST_EPSG, LAST_EPSG = 32643, 32653


def parent_key(epsg: Column, col: Column, row: Column) -> Column:
    """``epsg:col:row``; null if any part is."""
    return F.concat(epsg.cast("string"), F.lit(":"), col.cast("string"), F.lit(":"), row.cast("string"))


def utm_owner_zone(lon: Column) -> Column:
    """Zone of half-open 6 degree strips, clamped to 1..60."""
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def utm_owner_epsg(lon: Column, lat: Column) -> Column:
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_owner_zone(lon)).cast("int")


def owner_in_range(epsg: Column, first: int = FIRST_EPSG, last: int = LAST_EPSG) -> Column:
    return epsg.between(first, last)


def canonical_bounds(col: Column, row: Column, side: int = CELL_M) -> Column:
    """array(left, bottom, right, top) in metres of the owner zone."""
    col, row = col.cast("long"), row.cast("long")
    return F.array(col * side, row * side, (col + 1) * side, (row + 1) * side)


def macro_key(value: Column, side: int = MACRO_SIDE) -> Column:
    """Index of the macrocell along one axis: floor division, not truncation."""
    return F.floor(value / side).cast("long")


def local_index(value: Column, side: int = MACRO_SIDE) -> Column:
    return F.pmod(value, F.lit(side)).cast("int")


def grid_id(epsg: Column) -> Column:
    return F.concat(F.lit("utm"), F.lpad((epsg % 100).cast("string"), 2, "0"), F.when(epsg < 32700, "n").otherwise("s"))


def identity_hash(epsg: Column, col: Column, row: Column, kind: str = "grid") -> Column:
    """SHA-256 of ``atlas:epsg:col:row`` (grid) or ``epsg:col:row:1280`` (registry)."""
    key = parent_key(epsg, col, row)
    return F.sha2(F.concat(F.lit("atlas:"), key) if kind == "grid" else F.concat(key, F.lit(f":{CELL_M}")), 256)


def metadata_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON of the named columns in name order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def stable_hash(seed: Column | int | str, value: Column) -> Column:
    """Hex SHA-256 of ``seed:value``; the order of hex texts is that of the bytes."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat(seed.cast("string"), F.lit(":"), value.cast("string")), 256)


def stable_unit_hash(seed: Column | int | str, value: Column) -> Column:
    """[0, 1): the first 8 bytes of the hash over 2^64."""
    return F.conv(F.substring(stable_hash(seed, value), 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def strata_list(text: Column) -> Column:
    """A comma-separated text as a list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def stratum_score(scores: Column, stratum: Column) -> Column:
    return F.coalesce(F.try_element_at(scores, stratum), F.lit(1.0))


def stratum_tie(seed: Column | int | str, stratum: Column, patch_id: Column) -> Column:
    return -stable_unit_hash(seed, F.concat(stratum, F.lit(":"), patch_id.cast("string")))


def boxes_intersect(a: list[Column], b: list[Column]) -> Column:
    """Strict: boxes that only touch do not intersect. Each is [left, bottom, right, top]."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def bounds_close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    same = F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda ok: ok)
    return (F.size(a) == F.size(b)) & same


def snapped_extent(left: Column, bottom: Column, right: Column, top: Column, step: float = 10.0) -> Column:
    """Extent snapped outward to ``step`` and its raster shape."""
    low = lambda x: F.floor(x / step) * step
    high = lambda x: F.ceil(x / step) * step
    size = lambda a, b: ((high(b) - low(a)) / step).cast("long")
    return F.struct(low(left).cast("double").alias("left"), low(bottom).cast("double").alias("bottom"), high(right).cast("double").alias("right"), high(top).cast("double").alias("top"), size(left, right).alias("width"), size(bottom, top).alias("height"))


def window_offset(value: Column, origin: Column | float, step: float = 10.0) -> Column:
    """Integer pixel offset of a coordinate on the master grid."""
    return F.floor((value - origin) / step).cast("long")
