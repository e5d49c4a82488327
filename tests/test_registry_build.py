"""A whole registry: layers in order, reasons by slot, seeds of the draws, overlaps resolved, the report."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions.cells import CELL_M
from gridloom.functions.projection import utm_inverse
from gridloom.operators import registry, spatial
from tests.test_layers import RING, drawn

TARGETS = {"base_expected_1pct": 20, "coastal_supplement": 6, "utm_spatial_balance_supplement": 12, "semantic_and_difficult_supplement": 9}
CANDIDATE = "macro_id string, grid_id string, local_col int, local_row int, parent_key string, grid_epsg int, grid_col int, grid_row int"


@pytest.fixture(scope="module")
def built(spark):
    """Both sides of a seam and a part far from it; every cell is owned by its zone there."""
    cells = []
    for zone, cols in ((32646, range(596, 612)), (32647, range(168, 186)), (32650, range(400, 440))):
        for col in cols:
            for row in range(2900, 2920):
                cells.append((f"utm{zone - 32600}n_c{col // 10}_r{row // 10}", f"utm{zone - 32600}n", col % 10, row % 10, f"{zone}:{col}:{row}", zone, col, row))
    # Macrocells of 2 x 2 cells make enough of them.
    cells = [(f"{c[1]}_c{c[6] // 2}_r{c[7] // 2}", c[1], c[6] % 2, c[7] % 2, *c[4:]) for c in cells]
    centre = utm_inverse((F.col("grid_col") + 0.5) * CELL_M, (F.col("grid_row") + 0.5) * CELL_M, F.col("grid_epsg"))
    rows = spark.createDataFrame(cells, CANDIDATE).withColumn("c", centre)
    rows = rows.select(*[c.split()[0] for c in CANDIDATE.split(", ")], F.round("c.lon", 7).alias("longitude"), F.round("c.lat", 7).alias("latitude"))
    zone = 32601 + F.floor((F.col("longitude") + 180) / 6)
    rows = rows.where(F.col("grid_epsg") == zone)
    whole = spark.createDataFrame([("all", [(60.0, 0.0), (150.0, 0.0), (150.0, 80.0), (60.0, 80.0)])], f"name string, ring {RING}")
    owned = rows.collect()
    over = spatial.overlap_pairs(rows.withColumn("id", F.col("parent_key")), adjacent_only=False).where("fraction > 0.01").orderBy("left_id", "right_id").collect()
    pairs, seen = [], set()
    for r in over:  # four pairs that overlap, in eight macrocells
        both = [next(c for c in owned if c.parent_key == k) for k in (r.left_id, r.right_id)]
        if len(pairs) < 8 and not seen & {c.macro_id for c in both}:
            seen |= {c.macro_id for c in both}
            pairs += both
    assert len(pairs) == 8
    old = [(i, f"old{i}", r.grid_epsg, r.grid_id, r.grid_col, r.grid_row, r.macro_id, r.longitude, r.latitude, "base_spatial") for i, r in enumerate(pairs)]
    existing = spark.createDataFrame(old, "place int, patch_id string, grid_epsg int, grid_id string, grid_col int, grid_row int, macro_id string, longitude double, latitude double, sampling_tier string")
    strict, near = rows.where("grid_epsg = 32650 and grid_col < 404"), rows.where("grid_epsg = 32650 and grid_col < 420")
    policy = spark.createDataFrame([(2, "forest", 4), (1, "water", 3), (3, "urban", 2)], "place int, reason string, quota int")
    plan = registry.RegistryPlan(existing, rows, strict, near, TARGETS, policy, 7, whole, whole)
    records, log, report = plan.build()
    return owned, seen, [r.asDict() for r in records.collect()], log.collect(), report.first()


def test_report_passes(built):
    _, _, records, _, report = built
    assert report.passed and report.overlaps == 0 and report.rows == sum(TARGETS.values())
    assert {k: sum(r["layer"] == k for r in records) for k in TARGETS} == TARGETS


def test_overlaps_were_found_and_left(built):
    _, _, records, log, _ = built
    assert log and not {r.remove_id for r in log} & {r["patch_id"] for r in records}
    assert all({r.left_id, r.right_id} >= {r.remove_id} and r.fraction > 0.01 for r in log)


def test_reasons_and_seeds_of_the_first_draw(built):
    owned, seen, records, log, _ = built
    by = {k: [r for r in records if r["layer"] == k] for k in TARGETS}
    kept = [r for r in by["base_expected_1pct"] if r["sampling_primary_reason"] == "base_spatial" and r["added_round"] is None]
    assert all(r["patch_id"].startswith("old") and r["selection_subseed"] is None for r in kept)
    first = {r["selection_subseed"]: r for r in by["semantic_and_difficult_supplement"] if r["added_round"] is None}
    slots = ["water"] * 3 + ["forest"] * 4 + ["urban"] * 2
    assert first and all(r["sampling_primary_reason"] == slots[s - 7 - 62_000] for s, r in first.items())
    assert all(r["sampling_reasons"] == [f"provisional_quota:{r['sampling_primary_reason']}", "requires_semantic_atlas_reranking"] and r["semantic_verification_status"] == "pending" for r in by["semantic_and_difficult_supplement"])
    # What a removed record stood for is taken over by the one that fills its place.
    assert sorted(r["sampling_primary_reason"] for r in by["semantic_and_difficult_supplement"]) == sorted(slots)
    space = by["utm_spatial_balance_supplement"]
    assert all(r["sampling_primary_reason"].startswith("sqrt_utm_balance:utm") for r in space)
    assert all(r["selection_subseed"] >= 7 + TARGETS["utm_spatial_balance_supplement"] + int(r["grid_id"][3:5]) for r in space if r["added_round"] is None)
    coast = {r["coastal_status"]: (r["sampling_primary_reason"], r["sampling_reasons"]) for r in by["coastal_supplement"]}
    assert all(coast[k][0] == registry_reason for k, registry_reason in (("verified_boundary_crossing_ocean", "verified_boundary_crossing_and_ocean"), ("near_coast_pending", "near_coast_requires_detailed_review")) if k in coast)
    assert {r["sampling_seed"] for r in records} == {7}


def test_base_is_topped_up_as_a_plain_walk_does(built):
    owned, seen, records, log, _ = built
    base = [r for r in records if r["layer"] == "base_expected_1pct" and r["added_round"] is None]
    gone = {r.remove_id for r in log}
    plain = [(r.macro_id, "", r.local_col, r.local_row, r.parent_key) for r in owned if r.macro_id not in seen]
    want = drawn(plain, 7 + 20, "base_expected_1pct:macro:", 12)
    names = {r.parent_key: f"candidate_{r.macro_id}_c{r.local_col}_r{r.local_row}" for r in owned}
    topped = {r["patch_id"] for r in base if not r["patch_id"].startswith("old")}
    assert topped == {names[k] for _, k in want} - gone
    assert all(r["sampling_primary_reason"] == "base_expected_1pct_owner_zone_replenishment" for r in base if not r["patch_id"].startswith("old"))
