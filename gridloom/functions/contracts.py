"""Record contracts: an array of the names of the rules that a record breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.cells import bounds_close, canonical_bounds, local_index, owner_in_range, parent_key


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition is not true; an unknown outcome breaks the rule."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]))


def parent_cell_rules(key: Column, epsg: Column, col: Column, row: Column, bounds: Column, local_col: Column, local_row: Column) -> dict[str, Column]:
    return {
        "required": key.isNotNull() & epsg.isNotNull() & col.isNotNull() & row.isNotNull(),
        "key": key == parent_key(epsg, col, row),
        "bounds": bounds_close(bounds, canonical_bounds(col, row)),
        "local_index": (local_col == local_index(col)) & (local_row == local_index(row)),
        "owner_zone": owner_in_range(epsg),
    }


def atlas_rules(patch_id: Column, col: Column, row: Column, bounds: Column, declared: Column, eligible: Column) -> dict[str, Column]:
    return {
        "patch_id": patch_id.isNotNull() & (patch_id.cast("string") != ""),
        "indices": col.isNotNull() & row.isNotNull(),
        "bounds": F.size(bounds) == 4,
        "declared_count": declared.between(1, 100),
        "eligible": eligible.isNotNull(),
    }


def safe_path(path: Column) -> Column:
    """Relative POSIX path: not empty or absolute, no ``..``, backslash or address."""
    return (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.array_contains(F.split(path, "/"), "..")


def manifest_rules(sources: Column, fields: Column, allowed: list[str], required: list[str]) -> dict[str, Column]:
    paths = F.flatten(F.map_values(F.map_filter(sources, lambda k, v: v.isNotNull())))
    return {
        "unknown_field": F.size(F.array_except(fields, F.array(*map(F.lit, allowed)))) == 0,
        "missing_field": F.size(F.array_except(F.array(*map(F.lit, required)), fields)) == 0,
        "path": F.forall(paths, safe_path),
    }


def source_slots(sources: Column, mapping: dict[str, str], slots: list[str]) -> Column:
    """map canonical slot -> paths: physical names are renamed, slots without a source are null."""
    pairs = {v: k for k, v in mapping.items()}
    return F.create_map(*[x for s in slots for x in (F.lit(s), F.try_element_at(sources, F.lit(pairs.get(s, s))))])


def available(paths: Column) -> Column:
    """A slot is there if it has a path; null and empty lists are not."""
    return F.coalesce(F.size(paths) > 0, F.lit(False))


def tag_categories(tags: Column, rules: dict[str, list[tuple[str, list[str] | None]]]) -> Column:
    """Sorted categories of a tag map: any (key, value set or any value) of a category suffices."""

    def fits(key: str, values: list[str] | None) -> Column:
        value = F.try_element_at(tags, F.lit(key))
        return value.isNotNull() if values is None else F.coalesce(value.isin(values), F.lit(False))

    found = []
    for category, pairs in sorted(rules.items()):
        any_of = F.lit(False)
        for key, values in pairs:
            any_of = any_of | fits(key, values)
        found.append(F.when(any_of, F.lit(category)))
    return F.array_compact(F.array(*found))


#: Categories of map features by their tags; fixed values.
OSM_RULES: dict[str, list[tuple[str, list[str] | None]]] = {
    "building": [("building", None)],
    "road": [("highway", None)],
    "railway": [("railway", None)],
    "water": [("natural", ["water"]), ("waterway", None), ("landuse", ["reservoir", "basin"])],
    "construction": [("landuse", ["construction"]), ("highway", ["construction"]), ("building", ["construction"])],
    "green": [("landuse", ["forest", "grass", "meadow", "recreation_ground"]), ("leisure", ["park", "garden"]), ("natural", ["wood", "grassland"])],
}
