"""The layered registry: repaired base cells, then supplements by layer, each layer drawn after those before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.cells import grid_id, utm_owner_epsg
from gridloom.functions.geometry import snap_to_owner
from gridloom.operators.audits import registry_audit
from gridloom.operators.overlaps import OverlapIndex, resolution
from gridloom.operators.ranking import exact_rank, settled
from gridloom.operators.sampling import complete, macro_limit, normalised_registry, quota_slots, reasons_of, replacements, spatially_balanced, with_fallback
from gridloom.operators.spatial import assigned_region, covered

#: Added to the seed of the semantic layer, fixed value.
SEMANTIC_SEED = 62_000


def macro_name(grid, col, row, side: int = 10):
    """``<grid>_c<macro column>_r<macro row>``."""
    at = lambda c: F.floor(c / side).cast("string")
    return F.concat(grid, F.lit("_c"), at(col), F.lit("_r"), at(row))


def repaired(records: DataFrame, boundary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, counters): records in a zone that does not own their centre move to the owner's cell.

    ``records``: place (their order), patch_id, grid_epsg, grid_id, grid_col, grid_row, macro_id, longitude,
    latitude and more. A record whose new centre has another owner or lies outside ``boundary`` (name, ring)
    is dropped, as are later records with a patch_id that came before.
    """
    lon, lat = F.col("longitude"), F.col("latitude")
    rows = records.withColumn("_wrong", F.col("grid_epsg") != utm_owner_epsg(lon, lat)).withColumn("_s", snap_to_owner(lon, lat))
    moved = rows.where("_wrong")
    inside = covered(moved.select(F.col("place").alias("point_id"), F.col("_s.lon").alias("x"), F.col("_s.lat").alias("y")), boundary).select(F.col("point_id").alias("place")).distinct().withColumn("_in", F.lit(True))
    checked = rows.join(inside, "place", "left").withColumn("_ok", F.col("_s.owned") & F.coalesce("_in", F.lit(False)))
    new = {
        "grid_epsg": F.col("_s.epsg"),
        "grid_id": grid_id(F.col("_s.epsg")),
        "grid_col": F.col("_s.col"),
        "grid_row": F.col("_s.row"),
        "macro_id": macro_name(grid_id(F.col("_s.epsg")), F.col("_s.col"), F.col("_s.row")),
        "patch_id": F.concat(F.lit("ownerfix_epsg"), F.col("_s.epsg").cast("string"), F.lit("_c"), F.col("_s.col").cast("string"), F.lit("_r"), F.col("_s.row").cast("string")),
        "longitude": F.round("_s.lon", 7),
        "latitude": F.round("_s.lat", 7),
    }
    kept = checked.where(~F.col("_wrong") | F.col("_ok"))
    fixed = kept.withColumns({k: F.when(F.col("_wrong"), v).otherwise(F.col(k)) for k, v in new.items()})
    fixed = settled(fixed.withColumn("_n", F.row_number().over(Window.partitionBy("patch_id").orderBy("place"))))
    wrong = F.col("_wrong").cast("long")
    report = checked.agg(F.coalesce(F.sum(wrong), F.lit(0)).alias("owner_zone_mismatch"), F.coalesce(F.sum((F.col("_wrong") & F.col("_ok")).cast("long")), F.lit(0)).alias("owner_zone_repaired"))
    report = report.withColumn("dropped_outside_after_repair", F.col("owner_zone_mismatch") - F.col("owner_zone_repaired"))
    repeats = fixed.agg(F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)).alias("dropped_duplicate_patch_id"))
    return fixed.where("_n = 1").select(*records.columns), report.crossJoin(repeats)  # one-row reports


#: Reasons of drawn cells that no policy names; fixed values.
TOPPED_UP, BALANCED_BY = "base_expected_1pct_owner_zone_replenishment", "sqrt_utm_balance:"
LAYER_NAMES = ["base_expected_1pct", "coastal_supplement", "utm_spatial_balance_supplement", "semantic_and_difficult_supplement"]
KEPT = ["macro_id", "grid_id", "grid_epsg", "grid_col", "grid_row", "longitude", "latitude"]


def candidate_patch() -> Column:
    return F.concat(F.lit("candidate_"), F.col("macro_id"), F.lit("_c"), F.col("local_col").cast("string"), F.lit("_r"), F.col("local_row").cast("string"))


def drawn_layers(existing: DataFrame, candidates: DataFrame, strict: DataFrame, near: DataFrame, targets: dict[str, int], seed: int, boundary: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """The layers before they are normalised: patch_id, parent_key, layer, tier, status, reasons, ``selection_subseed``, ``place`` (their order) and KEPT.

    A slot of the semantic layer has the reason that ``policy`` (place, reason, quota) gives it, in order; without a policy, or beyond its
    quotas, its tier. Each layer is written before the next is drawn from what is left.
    """
    base_n, coast_n, space_n, semantic_n = (targets[n] for n in LAYER_NAMES)
    fixed, _ = repaired(existing, boundary)
    identity = Window.partitionBy("grid_epsg", "grid_col", "grid_row").orderBy("place")
    once = fixed.withColumn("_n", F.row_number().over(identity)).where("_n = 1").drop("_n").where("sampling_tier = 'base_spatial'")
    limited = macro_limit(once.withColumn("is_base", F.lit(True)), seed).where("kept")
    tier = F.lit("base_spatial")
    own = F.col("selection_subseed").cast("long") if "selection_subseed" in existing.columns else F.lit(None).cast("long")
    first = limited.select("patch_id", *KEPT, F.concat_ws(":", "grid_epsg", "grid_col", "grid_row").alias("parent_key"), tier.alias("sampling_tier"), F.lit(LAYER_NAMES[0]).alias("layer"), F.lit(None).cast("string").alias("coastal_status"), tier.alias("sampling_primary_reason"), F.array(tier).alias("sampling_reasons"), own.alias("selection_subseed"), F.col("place").cast("long").alias("place"))
    chosen = settled(first)
    after = (existing.agg(F.max("place")).first()[0] or 0) + 1

    def add(picked: DataFrame, tier: str, layer: str, count: int, reason: Column, subseed: Column) -> DataFrame:
        """``picked``: parent_key, ordinal and what ``reason`` and ``subseed`` name; a layer's places follow those before it."""
        nonlocal after
        status = F.col("status") if "status" in picked.columns else F.lit(None).cast("string")
        primary, reasons = reasons_of(layer, reason, status)
        said = picked.select("parent_key", status.alias("coastal_status"), primary.alias("sampling_primary_reason"), reasons.alias("sampling_reasons"), subseed.cast("long").alias("selection_subseed"), (F.lit(after) + F.col("ordinal")).cast("long").alias("place"))
        rows = candidates.join(said, "parent_key")
        new = settled(rows.select(candidate_patch().alias("patch_id"), *KEPT, "parent_key", F.lit(tier).alias("sampling_tier"), F.lit(layer).alias("layer"), *said.columns[1:]).select(*chosen.columns))
        after += count
        return complete(new, count, layer)

    missing = base_n - chosen.count()
    if missing > 0:
        rest = candidates.join(chosen.select("macro_id"), "macro_id", "left_anti")
        more = replacements(rest, seed + base_n, LAYER_NAMES[0], missing, chosen)
        chosen = chosen.unionByName(add(more, "base_spatial", LAYER_NAMES[0], missing, F.lit(TOPPED_UP), F.lit(seed + base_n) + F.col("ordinal")))
    coast = add(with_fallback(strict, near, seed + coast_n, coast_n, chosen), "coastal_ocean_adjacent_supplement", LAYER_NAMES[1], coast_n, F.lit(None).cast("string"), F.lit(seed + coast_n) + F.col("ordinal"))
    chosen = chosen.unionByName(coast)
    zone = F.regexp_extract("grid_id", "([0-9]+)", 1).cast("int")
    balanced = spatially_balanced(candidates, seed + space_n, space_n, chosen, coast)
    space = add(balanced, "spatial_stratified_supplement", LAYER_NAMES[2], space_n, F.concat(F.lit(BALANCED_BY), F.col("grid_id")), F.lit(seed + space_n) + zone + F.col("ordinal"))
    chosen = chosen.unionByName(space)
    rest = candidates.join(coast.unionByName(space).select("macro_id"), "macro_id", "left_anti")
    drawn = replacements(rest, seed + SEMANTIC_SEED, LAYER_NAMES[3], semantic_n, chosen)
    tier = "semantic_audit_reserve"
    if policy is not None:
        # The policy's slots, in its order: as many rows as its quotas say.
        slots = exact_rank(quota_slots(policy), [F.col("place"), F.col("slot")], name="ordinal").select("ordinal", "reason")
        drawn = drawn.join(slots, "ordinal", "left")
    reason = F.coalesce(F.col("reason"), F.lit(tier)) if policy is not None else F.lit(tier)
    semantic = add(drawn, tier, LAYER_NAMES[3], semantic_n, reason, F.lit(seed + SEMANTIC_SEED) + F.col("ordinal"))
    return settled(chosen.unionByName(semantic))


def finished(layers: DataFrame, seed: int, provinces: DataFrame) -> DataFrame:
    """Drawn layers with their province, normalised, in order of zone, row, column and id."""
    everything = layers.withColumn("sampling_seed", F.lit(seed)).withColumn("semantic_verification_status", F.when(F.col("layer") == LAYER_NAMES[3], "pending").otherwise("not_applicable"))
    centres = everything.select(F.col("patch_id").alias("point_id"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    named = assigned_region(centres, provinces).select(F.col("point_id").alias("patch_id"), F.col("name").alias("admin1"))
    return normalised_registry(everything.join(named, "patch_id")).orderBy("grid_epsg", "grid_row", "grid_col", "patch_id")


def layered_registry(existing: DataFrame, candidates: DataFrame, strict: DataFrame, near: DataFrame, targets: dict[str, int], seed: int, boundary: DataFrame, provinces: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """The registry in order of zone, row, column and id, overlaps not yet resolved.

    ``existing``: the columns of ``repaired`` and sampling_tier; only its base layer is kept. ``candidates``: macro_id,
    grid_id, local_col, local_row, parent_key, grid_epsg, grid_col, grid_row, longitude, latitude of cells that
    pass owner and boundary; ``strict`` and ``near`` those that pass the coast tests. ``targets``: rows of each
    layer, which too few candidates make an error; ``policy``: see ``drawn_layers``.
    """
    return finished(drawn_layers(existing, candidates, strict, near, targets, seed, boundary, policy), seed, provinces)


@dataclass
class RegistryPlan:
    """All that a registry is built of; see ``layered_registry`` for the tables. ``required``: fields that no record may lack."""

    existing: DataFrame
    candidates: DataFrame
    strict: DataFrame
    near: DataFrame
    targets: dict[str, int]
    policy: DataFrame
    seed: int
    boundary: DataFrame
    provinces: DataFrame
    required: tuple[str, ...] = ("patch_id", "identity_hash", "footprint_hash", "macro_id", "sampling_primary_reason", "admin1")
    rounds: int = 5

    def build(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(records, log, report): layers are drawn in order, overlaps resolved with reasons and the coast's fallback, records
        normalised, and the result audited (AGG-09). ``log``: every overlap and the side that left; the report's ``passed`` also
        asks for no overlap left and for the targets."""
        layers = drawn_layers(self.existing, self.candidates, self.strict, self.near, self.targets, self.seed, self.boundary, self.policy)
        pool = self.candidates.withColumns({"patch_id": candidate_patch(), "id": candidate_patch()})
        done, log = resolution(layers.withColumn("id", F.col("patch_id")), {k: pool for k in self.targets}, self.seed, self.rounds, self.targets, (self.strict, self.near))
        records = settled(finished(done.drop("id"), self.seed, self.provinces))
        left = OverlapIndex(records.withColumn("id", F.col("patch_id"))).pairs.agg(F.count(F.lit(1)).alias("overlaps"))
        wanted = F.lit(True)
        counts = records.groupBy().agg(*[F.count(F.when(F.col("layer") == k, 1)).alias(f"n_{k}") for k in self.targets])
        for k, n in self.targets.items():
            wanted = wanted & (F.col(f"n_{k}") == n)
        crossing = records.join(self.strict.select("grid_epsg", "grid_col", "grid_row"), ["grid_epsg", "grid_col", "grid_row"], "left_semi").select("patch_id")
        report = registry_audit(records, list(self.required), self.boundary, crossing).crossJoin(left).crossJoin(counts)  # one-row reports
        return records, log, report.withColumn("passed", F.col("passed") & (F.col("overlaps") == 0) & wanted)
