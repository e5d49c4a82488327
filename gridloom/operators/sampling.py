"""Deterministic stratified sampling from hashes: every choice is a rank, never a draw."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.cells import macro_key, stable_hash, stable_unit_hash, stratum_score, stratum_tie
from gridloom.operators.ranking import exact_rank, settled


def with_macro(atlas: DataFrame, side: int = 10) -> DataFrame:
    return atlas.withColumn("macro_col", macro_key(F.col("grid_col"), side)).withColumn("macro_row", macro_key(F.col("grid_row"), side))


MACRO = ["grid_id", "macro_row", "macro_col"]


def macro_completeness(atlas: DataFrame, side: int = 10) -> DataFrame:
    """Macrocells whose declared count is not unique or not what is there."""
    found = with_macro(atlas, side).groupBy(*MACRO).agg(F.count(F.lit(1)).alias("observed"), F.min("macro_candidate_count").alias("least"), F.max("macro_candidate_count").alias("most"))
    return found.where("least <> most or observed <> least")


def macro_winners(atlas: DataFrame, seed: int, side: int = 10) -> DataFrame:
    """One eligible record per macrocell: the smallest unit hash of its patch id, then the id."""
    rows = with_macro(atlas, side).where("eligible").withColumn("unit", stable_unit_hash(seed, F.col("patch_id")))
    return rows.groupBy(*MACRO).agg(F.min_by("patch_id", F.struct("unit", "patch_id")).alias("patch_id"), F.min("unit").alias("unit"), F.count(F.lit(1)).alias("eligible_count"))


def base_selection(winners: DataFrame, seed: int, probability: float) -> DataFrame:
    """Winners accepted with the probability that any of their macrocell's records would be."""
    text = F.format_string("base-macrocell:('%s', %d, %d)", F.col("grid_id"), F.col("macro_row"), F.col("macro_col"))
    return winners.where(stable_unit_hash(seed, text) < F.least(F.lit(1.0), F.col("eligible_count") * probability))


def stratum_pool(atlas: DataFrame, seed: int, quotas: dict[str, int], multiplier: int) -> DataFrame:
    """The best ``quota * multiplier`` records of each stratum, by score, then hash, then id."""
    rows = atlas.where("eligible").select("*", F.explode("strata").alias("stratum")).where(F.col("stratum").isin(list(quotas)))
    score, tie = stratum_score(F.col("stratum_scores"), F.col("stratum")), stratum_tie(seed, F.col("stratum"), F.col("patch_id"))
    ranked = rows.withColumn("score", score).withColumn("tie", tie)
    order = Window.partitionBy("stratum").orderBy(F.desc("score"), F.desc("tie"), "patch_id")
    size = F.create_map(*[F.lit(x) for k, q in quotas.items() for x in (k, q * multiplier)])
    # The group limit keeps at most the largest pool before the shuffle.
    most = max(quotas.values(), default=0) * multiplier
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).where(F.col("place") <= size[F.col("stratum")])


def fill_quotas(pool: DataFrame, base: DataFrame, quotas: dict[str, int], per_macro: int, region_share: float, max_total: int, allow_unknown: bool = False) -> DataFrame:
    """Greedy supplements (patch_id, stratum): strata in policy order, caps per macrocell and region.

    ``pool`` is bounded by the policy (quota times multiplier), so the walk is one group; ``base``
    rows carry patch_id, macro_id, region and strata and count towards quotas and caps. A region may
    hold ceil(quota * share) of a stratum; a missing region is the region ``unknown``, which is skipped
    unless allowed and then capped like any other.
    """
    columns = ["patch_id", "macro_id", "region", "stratum", "place"]
    named = F.coalesce("region", F.lit("unknown")).alias("region")
    wanted = pool.select("patch_id", "macro_id", named, "stratum", "place", F.lit(False).alias("in_base"))
    covered = base.select("patch_id", "macro_id", named, F.explode("strata").alias("stratum")).where(F.col("stratum").isin(list(quotas)))
    counts = covered.groupBy("stratum", "region").agg(F.count(F.lit(1)).cast("int").alias("place")).select(F.lit(None).cast(pool.schema["patch_id"].dataType).alias("patch_id"), F.lit(None).cast("string").alias("macro_id"), "region", "stratum", "place", F.lit(True).alias("in_base"))
    chosen_before = base.count()
    everything = wanted.join(base.select("patch_id"), "patch_id", "left_anti").select(*columns, "in_base").unionByName(counts)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        macros: dict = {}
        out, total = [], chosen_before
        for stratum, quota in quotas.items():
            own = pdf[pdf["stratum"] == stratum]
            regions = {r: int(n) for r, n in own[own["in_base"]][["region", "place"]].itertuples(index=False)}
            have, cap = sum(regions.values()), math.ceil(quota * region_share)
            for r in own[~own["in_base"]].sort_values("place").itertuples(index=False):
                if have >= quota or total >= max_total:
                    break
                full = macros.get(r.macro_id, 0) >= per_macro or regions.get(r.region, 0) >= cap
                if r.patch_id in taken or full or r.region == "unknown" and not allow_unknown:
                    continue
                taken.add(r.patch_id)
                macros[r.macro_id] = macros.get(r.macro_id, 0) + 1
                regions[r.region] = regions.get(r.region, 0) + 1
                have, total = have + 1, total + 1
                out.append((r.patch_id, stratum, r.region))
        return pd.DataFrame(out, columns=["patch_id", "stratum", "region"])

    kind = pool.schema["patch_id"].dataType.simpleString()
    return everything.withColumn("walk", F.length("stratum") * 0).groupBy("walk").applyInPandas(walk, f"patch_id {kind}, stratum string, region string")


def sampling_report(quotas: dict[str, int], base: DataFrame, added: DataFrame) -> DataFrame:
    """(stratum, requested, base, added, final, unmet) in policy order."""
    spark = base.sparkSession
    asked = spark.createDataFrame([(i, k, q) for i, (k, q) in enumerate(quotas.items())], "place int, stratum string, requested int")
    of_base = base.select(F.explode("strata").alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("base"))
    of_added = added.groupBy("stratum").agg(F.count(F.lit(1)).alias("added"))
    rows = asked.join(of_base, "stratum", "left").join(of_added, "stratum", "left").na.fill(0, ["base", "added"])
    final = F.col("base") + F.col("added")
    return rows.select("place", "stratum", F.col("requested").cast("long").alias("requested"), "base", "added", final.alias("final"), F.greatest(F.col("requested") - final, F.lit(0)).cast("long").alias("unmet"))


def macro_limit(records: DataFrame, seed: int) -> DataFrame:
    """Adds ``kept``: one base and one supplementary record per macrocell, the smallest hash."""
    text = F.concat_ws(":", F.lit("macro-limit"), F.col("macro_id"), F.when(F.col("is_base"), "True").otherwise("False"), F.col("patch_id").cast("string"))
    order = Window.partitionBy("macro_id", "is_base").orderBy(stable_hash(seed, text), "patch_id")
    return records.withColumn("kept", F.row_number().over(order) == 1)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds ``kept``: the first row of each key in ``order``."""
    return df.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def overlap_loser(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Of two overlapping records the one with the higher priority number goes, then the larger hash."""
    a, b = F.struct(left["priority"], left["hash"]), F.struct(right["priority"], right["hash"])
    return F.when(a > b, left["id"]).otherwise(right["id"])


def sqrt_allocation(groups: DataFrame, name: str, count: str, total: int) -> DataFrame:
    """Adds ``quota``: shares of ``total`` by the square root of the count, largest remainders first.

    Equal remainders go to the greater name. ``groups`` has a row per group and fits one window.
    """
    share = F.sqrt(F.col(count).cast("double")) / F.sum(F.sqrt(F.col(count).cast("double"))).over(Window.partitionBy()) * total
    rows = groups.withColumn("_exact", share).withColumn("_whole", F.floor("_exact").cast("long"))
    rest = F.lit(total) - F.sum("_whole").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_whole")), F.desc(name)))
    return rows.withColumn("quota", (F.col("_whole") + (place <= rest).cast("long")).cast("long")).drop("_exact", "_whole")


def cell_of_each(candidates: DataFrame, placed: DataFrame, seed: Column) -> DataFrame:
    """(macro_id, ordinal, parent_key): of each placed macrocell the cell of least hash under its own seed."""
    text = F.concat(F.lit("candidate-cell:"), F.col("macro_id"), F.lit(":"), F.col("local_col").cast("string"), F.lit(":"), F.col("local_row").cast("string"))
    ranked = candidates.join(placed, "macro_id").withColumn("_h", stable_hash(seed.cast("string"), text))
    return ranked.groupBy("macro_id", "ordinal").agg(F.min_by("parent_key", F.struct("_h", "parent_key")).alias("parent_key"))


def replacements(candidates: DataFrame, seed: int, layer: str, count: int, existing: DataFrame | None = None, label: str | None = None, first: int = 0, accept: Callable[[DataFrame], DataFrame] | Column | None = None) -> DataFrame:
    """``count`` cells, one per macrocell: macrocells by hash, in each the cell of least hash.

    ``candidates`` (macro_id, local_col, local_row, parent_key) have passed all predicates, so a
    macrocell succeeds whatever its place; its cell order depends on how many came before it, ``first``
    of them in an earlier call. Macrocells are hashed under ``label``, usually ``<layer>:macro:``. ``accept``
    is a caller's predicate, a column or a function of the whole table.
    """
    rows = candidates if existing is None else candidates.join(existing.select("parent_key"), "parent_key", "left_anti")
    rows = rows if accept is None else rows.where(accept) if isinstance(accept, Column) else accept(rows)
    by = stable_hash(seed, F.concat(F.lit(f"{layer}:macro:" if label is None else label), F.col("macro_id")))
    chosen = rows.select("macro_id").distinct().withColumn("_h", by).orderBy("_h", "macro_id").limit(count)
    placed = chosen.withColumn("ordinal", F.row_number().over(Window.orderBy("_h", "macro_id")) - 1 + first).drop("_h")  # count rows at most
    return cell_of_each(rows, placed, F.lit(seed) + F.col("ordinal"))


def complete(chosen: DataFrame, count: int, what: str) -> DataFrame:
    """``chosen`` itself; an error if it has not ``count`` rows."""
    if (n := chosen.count()) != count:
        raise ValueError(f"{n} {what} of {count}")
    return chosen


#: Status texts of coastal cells, fixed values.
COAST_STATUS = ("verified_boundary_crossing_ocean", "near_coast_pending")


#: Reasons of coastal cells by their status, and what the other layers say; fixed values.
COAST_REASONS = {
    "verified_boundary_crossing_ocean": ("verified_boundary_crossing_and_ocean", ("country_inside_and_outside_each_at_least_0.1pct", "intersects_independent_ocean")),
    "near_coast_pending": ("near_coast_requires_detailed_review", ("center_within_0.035_degree_of_boundary_and_ocean", "strict_boundary_crossing_not_satisfied")),
}
SEMANTIC = "semantic_and_difficult_supplement"
PROVISIONAL, RERANKED = "provisional_quota:", "requires_semantic_atlas_reranking"
#: Behind the layer's name, the reason of a cell that fills it up.
REPLENISHED = "_overlap_replenishment"


def reasons_of(layer: str, reason: Column, status: Column) -> tuple[Column, Column]:
    """(primary reason, all reasons) of a drawn cell: a coastal one with a status names its tests, others the reason of their slot."""
    if layer == SEMANTIC:
        return reason, F.array(F.concat(F.lit(PROVISIONAL), reason), F.lit(RERANKED))
    primary, every = reason, F.array(reason)
    for name, (first, more) in COAST_REASONS.items():
        primary = F.when(status == name, F.lit(first)).otherwise(primary)
        every = F.when(status == name, F.array(*map(F.lit, more))).otherwise(every)
    return primary, every


def with_fallback(strict: DataFrame, near: DataFrame, seed: int, count: int, existing: DataFrame | None = None) -> DataFrame:
    """Strict coastal cells, the shortfall from near ones in other macrocells, with a status text; fewer than ``count`` are an error."""
    first = settled(replacements(strict, seed, "coastal", count, existing).withColumn("status", F.lit(COAST_STATUS[0])))
    have = first.count()
    if have == count:
        return first
    rest = near.join(first.select("macro_id"), "macro_id", "left_anti")
    more = replacements(rest, seed, "coastal", count - have, existing, "near-coast-fallback:", have)
    return complete(settled(first.unionByName(more.withColumn("status", F.lit(COAST_STATUS[1])))), count, "coastal cells")


#: The layer of spatially balanced cells, fixed value.
BALANCED = "utm_spatial_balance_supplement"


def spatially_balanced(candidates: DataFrame, seed: int, total: int, existing: DataFrame | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """Square-root quotas per grid, then replacements per grid in parallel: (grid_id, macro_id, ordinal, parent_key).

    Quotas count all candidates of a grid; ``existing`` cells and ``forbidden`` macrocells are not chosen. A
    grid's seed is ``seed`` plus its zone.
    """
    per_grid = candidates.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))
    quotas = sqrt_allocation(per_grid, "grid_id", "n", total).select("grid_id", "quota")
    rows = candidates if existing is None else candidates.join(existing.select("parent_key"), "parent_key", "left_anti")
    rows = rows if forbidden is None else rows.join(forbidden.select("macro_id"), "macro_id", "left_anti")
    own = F.lit(seed) + F.regexp_extract("grid_id", "([0-9]+)", 1).cast("int")
    macros = rows.select("grid_id", "macro_id").distinct().withColumn("seed", own)
    macros = macros.withColumn("_h", stable_hash(F.col("seed").cast("string"), F.concat(F.lit(f"{BALANCED}:macro:"), F.col("macro_id"))))
    place = F.row_number().over(Window.partitionBy("grid_id").orderBy("_h", "macro_id"))
    # No grid has more than ``total``: the group limit drops the rest before the shuffle.
    first = macros.withColumn("_place", place).where(F.col("_place") <= total)
    chosen = first.withColumn("ordinal", F.col("_place") - 1).join(quotas, "grid_id").where("ordinal < quota").select("grid_id", "macro_id", "ordinal", "seed")
    cells = cell_of_each(rows, chosen.select("macro_id", "ordinal", "seed"), F.col("seed") + F.col("ordinal"))
    return cells.join(chosen.select("grid_id", "macro_id"), "macro_id").select("grid_id", "macro_id", "ordinal", "parent_key")


#: Layer of a sampling tier, and which layer's cell goes first when two overlap (the highest number); fixed values.
LAYERS = {
    "base_spatial": "base_expected_1pct",
    "spatial_stratified_supplement": "utm_spatial_balance_supplement",
    "spatial_stratified_supplement_fallback": "utm_spatial_balance_supplement",
    "coastal_ocean_adjacent_supplement": "coastal_supplement",
    "semantic_audit_reserve": "semantic_and_difficult_supplement",
}
PRIORITY = {"base_expected_1pct": 0, "utm_spatial_balance_supplement": 1, "coastal_supplement": 2, "semantic_and_difficult_supplement": 3}
NO_PRIORITY = 99
#: What a normalised record has where it says nothing itself; fixed values.
DEFAULTS = {
    "sampling_design_type": "fixed_size_design_candidate",
    "ecoregion": "pending",
    "semantic_verification_status": "not_applicable",
}
STATES = {
    "registry_status": "design_candidate_not_quality_eligible",
    "source_coverage_by_quarter": "pending",
    "quality_summary_by_quarter": "pending",
    "split": "unassigned",
}


def layer_of(tier: Column) -> Column:
    tiers = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    return F.coalesce(F.try_element_at(tiers, tier), F.lit("unknown"))


def normalised_registry(records: DataFrame, version: str = "1") -> DataFrame:
    """Records with a layer, the base layer's inclusion probability, hashes, rounded bounds and defaults.

    ``records``: grid_epsg, grid_col, grid_row, sampling_tier and any of the defaulted columns. Bounds are rounded
    to 3 decimals in metres and 8 in degrees.
    """
    from gridloom.functions.cells import canonical_bounds, identity_hash
    from gridloom.functions.geometry import footprint, footprint_hash, ring_bounds

    have = set(records.columns)
    tier = F.col("sampling_tier")
    layer = F.coalesce(F.col("layer"), layer_of(tier)) if "layer" in have else layer_of(tier)
    own = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    named = F.coalesce(tier, F.lit("unknown"))
    bounds = canonical_bounds(F.col("grid_col"), F.col("grid_row"))
    ring = footprint(F.col("grid_epsg"), bounds)
    return records.withColumn("_ring", ring).withColumns({
        "layer": layer,
        "registry_version": F.lit(version),
        "sampling_primary_reason": own("sampling_primary_reason", named),
        "sampling_reasons": own("sampling_reasons", F.array(named)),
        "inclusion_probability": F.when(layer == LAYERS["base_spatial"], F.lit(0.01)),
        "identity_hash": identity_hash(F.col("grid_epsg"), F.col("grid_col"), F.col("grid_row"), "registry"),
        "footprint_hash": footprint_hash(F.col("_ring")),
        "utm_bounds": F.transform(bounds, lambda x: F.bround(x.cast("double"), 3)),
        "wgs84_bounds": F.transform(ring_bounds(F.col("_ring")), lambda x: F.bround(x, 8)),
        **{k: own(k, F.lit(v)) for k, v in DEFAULTS.items()},
        **{k: F.lit(v) for k, v in STATES.items()},
    }).drop("_ring")


def layered(layers: dict[str, DataFrame]) -> DataFrame:
    """Union of layers, one cell once: the layer of the lowest priority number keeps it."""
    rows = None
    for i, (name, df) in enumerate(layers.items()):
        one = df.withColumn("layer", F.lit(name)).withColumn("priority", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    first = Window.partitionBy("parent_key").orderBy("priority")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def quota_slots(policy: DataFrame) -> DataFrame:
    """(place, reason, slot): one row per slot, reasons in policy order."""
    return policy.select("place", "reason", F.explode(F.sequence(F.lit(1), "quota")).alias("slot"), "quota").where("quota > 0").drop("quota")


def merged_policy(policy: DataFrame, overrides: dict[str, int]) -> DataFrame:
    """Quota overrides by name; names the policy lacks are added behind it."""
    spark = policy.sparkSession
    extra = spark.createDataFrame([(k, int(v)) for k, v in overrides.items()], "reason string, override int")
    joined = policy.join(F.broadcast(extra), "reason", "full_outer")
    return joined.select(F.coalesce("place", F.lit(1_000_000)).alias("place"), "reason", F.coalesce("override", "quota").cast("int").alias("quota"))


def every_nth(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows 1, n + 1, 2n + 1, ... of each group; a group of any size is ranked by ranges, not in one task."""
    return exact_rank(df, order, group, "_i").where(F.col("_i") % n == 0).drop("_i")


def few_shot(patches: DataFrame, fold: int, seed: int, shots: int) -> DataFrame:
    """``shots`` positive and as many negative patches by the hash of ``seed:fold:label:id``."""
    label = F.when(F.col("positive"), "positive").otherwise("negative")
    order = stable_hash(seed, F.concat(F.lit(f"{fold}:"), label, F.lit(":"), F.col("patch_id").cast("string")))
    ranked = patches.withColumn("place", F.row_number().over(Window.partitionBy("positive").orderBy(order, "patch_id")))
    return ranked.where(F.col("place") <= shots)


#: Regions that are broadcast for a range join; more are an error, since a range join cannot be shuffled.
MOST_REGIONS = 100_000


def weighted_draw(regions: DataFrame, steps: DataFrame, seed: int) -> DataFrame:
    """(step, region, index): a region per step by cumulative weight, then a row of it, both from hashes.

    ``regions`` (region, weight, size) is a dimension table of at most ``MOST_REGIONS`` rows, which is checked.
    """
    if regions.limit(MOST_REGIONS + 1).count() > MOST_REGIONS:
        raise ValueError("too many regions to draw from")
    upto = F.sum("weight").over(Window.orderBy("region").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("weight").over(Window.partitionBy())
    ranges = regions.select("region", "size", ((upto - F.col("weight")) / total).alias("low"), (upto / total).alias("high"))
    drawn = steps.withColumn("u", stable_unit_hash(seed, F.concat(F.lit("region:"), F.col("step").cast("string"))))
    hit = (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))
    index = F.floor(stable_unit_hash(seed, F.concat(F.lit("row:"), F.col("step").cast("string"))) * F.col("size")).cast("long")
    return drawn.join(F.broadcast(ranges), hit).select("step", "region", index.alias("index"))


def region_batches(rows: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """Adds ``batch``: runs of ``size`` rows of one region; a region of any size is ranked by ranges."""
    return exact_rank(rows, order, ["region"], "_i").withColumn("batch", F.floor(F.col("_i") / size).cast("long")).drop("_i")
