"""Scene-catalog compaction and cache status, map-feature tag audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties and asset fields that a compact item keeps; fixed values.
KEPT_PROPERTIES = ["datetime", "eo:cloud_cover", "platform", "constellation", "instruments", "gsd", "sat:orbit_state", "sat:relative_orbit"]
KEPT_ASSET_FIELDS = ["href", "type", "roles", "title"]


def compacted(properties: Column, assets: Column, wanted: list[str]) -> tuple[Column, Column]:
    """(properties, assets) with only the kept properties and the requested assets that exist."""
    keep = F.array(*map(F.lit, KEPT_PROPERTIES))
    ask = F.array(*map(F.lit, wanted))
    return F.map_filter(properties, lambda k, v: F.array_contains(keep, k)), F.map_filter(assets, lambda k, v: F.array_contains(ask, k))


def renamed_strict(items: DataFrame, names: dict[str, str], prefix: str) -> DataFrame:
    """Items with provider asset names turned into canonical ones; ``complete`` is false where a
    required asset is absent or its address lacks the prefix."""
    assets = F.create_map(*[x for theirs, ours in names.items() for x in (F.lit(ours), F.try_element_at("assets", F.lit(theirs)))])
    ok = F.forall(F.map_values(assets), lambda href: F.coalesce(href.startswith(prefix), F.lit(False)))
    return items.withColumns({"assets": assets, "complete": ok})


def cache_status(items: DataFrame, query: Column) -> DataFrame:
    """(source, month, query_hash, n_items, skipped, complete) per source and month."""
    return items.groupBy("source", "month").agg(
        F.sha2(F.to_json(F.first(query)), 256).alias("query_hash"), F.sum(F.col("complete").cast("long")).alias("n_items"), F.sum((~F.col("complete")).cast("long")).alias("skipped"), F.bool_and("complete").alias("complete")
    )


def stale(wanted: DataFrame, status: DataFrame) -> DataFrame:
    """Source months whose query hash differs from the finished one, or that were never done."""
    return wanted.join(status.where("complete").select("source", "month", "query_hash"), ["source", "month", "query_hash"], "left_anti")


def tag_counts(features: DataFrame) -> DataFrame:
    """(kind, key, value, n): value frequencies of each tag key, greatest first within a key."""
    return features.select("kind", F.explode("tags").alias("key", "value")).groupBy("kind", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def category_counts(features: DataFrame, categories: Column) -> DataFrame:
    """(kind, category, n) over features; ``categories`` is an array."""
    return features.select("kind", F.explode(categories).alias("category")).groupBy("kind", "category").agg(F.count(F.lit(1)).alias("n"))
