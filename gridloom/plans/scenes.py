"""Queries over pixels, scenes, composites, frames, catalogs and map features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import contracts, pixels
from gridloom.operators import catalog, composite, frames
from gridloom.operators.ranking import shared_folder
from gridloom.plans.bindings import FEATURES, ITEMS, OBS, PATCHES, features, items, observations, patches, query, table, unit
from gridloom.sources.publish import read_published
from gridloom.sources.sinks import write_tiles


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m') AS INT) AS month, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS idx, strftime(last_day(o_orderdate), '%Y-%m-%dT23:59:59Z') AS last FROM orders")
def fn26_months(spark, sf):
    m = pixels.month_number(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", m.alias("month"), pixels.month_index(m, 199501).cast("long").alias("idx"), pixels.month_interval(m)["last"].alias("last"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 202405 ELSE 0 END AS month FROM part")
def fn26_month_of_name(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, "s2_20240517_1234567890.tif").otherwise("s2_202405171.tif")
    return table(spark, sf, "part").select("p_partkey", pixels.month_of_name(name).alias("month"))


@query(f"SELECT source, count(*) FILTER (value <> 0 AND CASE source WHEN 's2' THEN qa IN (4, 5, 6, 7, 11) WHEN 'landsat' THEN bits & 31 = 0 ELSE true END) AS n FROM {OBS} GROUP BY 1")
def fn27_valid_pixels(spark, sf):
    qa = F.when(F.col("source") == "s2", F.col("qa")).otherwise(F.col("bits"))
    ok = pixels.valid_pixel(F.col("source"), F.col("value"), qa)
    return observations(spark, sf).groupBy("source").agg(F.sum(ok.cast("long")).alias("n"))


@query(f"SELECT source, band, round(sum(CASE WHEN band <> 7 AND valid THEN value * 0.0000275 - 0.2 ELSE value END), 4) AS total FROM {OBS} GROUP BY 1, 2")
def fn28_landsat_scaling(spark, sf):
    v = pixels.landsat_scaled(F.col("value"), F.col("band") == 7, F.col("valid"))
    return observations(spark, sf).groupBy("source", "band").agg(F.round(F.sum(v), 4).alias("total"))


@query("SELECT c_custkey, 1 / (1 + exp(-least(greatest(c_acctbal, -80), 80))) AS p FROM customer")
def fn30_clipped_sigmoid(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", pixels.clipped_sigmoid(F.col("c_acctbal")).alias("p"))


STATS = f"(SELECT source, band, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM {OBS} WHERE qa <> 0 GROUP BY 1, 2)"


def statistics(spark, sf):
    return frames.band_statistics(observations(spark, sf).withColumn("value", F.when(F.col("qa") == 0, -9999.0).otherwise(F.col("value"))), -9999.0)


@query(f"SELECT source, band, round(mean, 6) AS mean, round(std, 6) AS std, n FROM {STATS}")
def agg12_band_statistics(spark, sf):
    return statistics(spark, sf).select("source", "band", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"SELECT o.source, o.band, CASE WHEN o.band = 7 THEN 'no_statistics' END AS problem, count(*) AS n, round(sum(CASE WHEN valid THEN coalesce((value - mean) / std, 0) ELSE 0 END), 3) AS z FROM {OBS} o LEFT JOIN {STATS} s ON o.source = s.source AND o.band = s.band AND o.band <> 7 GROUP BY 1, 2, 3")
def fn29_join14_with_statistics(spark, sf):
    rows = frames.with_statistics(observations(spark, sf), statistics(spark, sf).where("band <> 7"))
    return rows.groupBy("source", "band", "problem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("z", F.lit(0.0))), 3).alias("z"))


MATCHES = f"(SELECT patch_id, item_id FROM {PATCHES} JOIN {ITEMS} ON px < x0 + 1.5 AND px + 0.5 > x0 AND py < y0 + 1.5 AND py + 0.5 > y0)"


@query(f"SELECT patch_id, count(*) AS n, min(item_id) AS first_item FROM {MATCHES} GROUP BY 1")
def join09_match_items(spark, sf):
    return composite.match_items(patches(spark, sf), items(spark, sf)).groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"))


@query(f"""SELECT patch_id, item_id, CAST(place AS INT) AS place FROM (SELECT m.patch_id, i.item_id, row_number() OVER (PARTITION BY m.patch_id ORDER BY coalesce(cloud, 1000), datetime, i.item_id) AS place
  FROM {MATCHES} m JOIN {ITEMS} i USING (item_id)) WHERE place <= 3""")
def fn24_join10_candidates(spark, sf):
    return composite.first_candidates(patches(spark, sf), items(spark, sf), 3)


@query(f"SELECT item_id, other = '1-URGENT' AS has_both FROM {ITEMS}")
def fn25_required_assets(spark, sf):
    return items(spark, sf).select("item_id", composite.has_assets(F.col("assets"), ["red", "1-URGENT"]).alias("has_both"))


@query(f"SELECT item_id, 1 AS n_properties, CASE WHEN other = '2-HIGH' THEN 2 ELSE 1 END AS n_assets FROM {ITEMS}")
def src10_compacted(spark, sf):
    props, assets = catalog.compacted(F.col("properties"), F.col("assets"), ["red", "2-HIGH", "absent"])
    return items(spark, sf).select("item_id", F.size(props).alias("n_properties"), F.size(assets).alias("n_assets"))


@query(f"SELECT item_id, item_id % 7 <> 0 AS complete FROM {ITEMS}")
def src11_renamed_strict(spark, sf):
    return catalog.renamed_strict(items(spark, sf), {"red": "B04"}, "s3:").select("item_id", "complete")


@query(f"""SELECT 's2' AS source, month, sha256('{{"month":' || month || ',"source":"s2"}}') AS query_hash, count(*) FILTER (item_id % 7 <> 0) AS n_items, count(*) FILTER (item_id % 7 = 0) AS skipped, count(*) FILTER (item_id % 7 = 0) = 0 AS complete FROM {ITEMS} GROUP BY month""")
def src12_cache_status(spark, sf):
    rows = catalog.renamed_strict(items(spark, sf), {"red": "B04"}, "s3:")
    return catalog.cache_status(rows, F.struct("month", "source"))


@query(f"SELECT kind, highway, count(*) AS n FROM {FEATURES} WHERE kind <> 'node' GROUP BY 1, 2")
def src21_map_features(spark, sf):
    from gridloom.sources.records import map_features

    return map_features(features(spark, sf)).groupBy("kind", F.try_element_at("tags", F.lit("highway")).alias("highway")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, CASE WHEN k2 = 'landuse' AND v2 = 'construction' THEN 'construction,road' WHEN k2 = 'natural' AND v2 = 'water' THEN 'road,water' ELSE 'road' END AS categories FROM {FEATURES}""")
def fn32_tag_categories(spark, sf):
    return features(spark, sf).select("event_id", F.array_join(contracts.tag_categories(F.col("tags"), contracts.OSM_RULES), ",").alias("categories"))


@query(f"SELECT kind, key, value, count(*) AS n FROM (SELECT kind, 'highway' AS key, highway AS value FROM {FEATURES} UNION ALL SELECT kind, k2, v2 FROM {FEATURES}) GROUP BY 1, 2, 3")
def agg27_tag_counts(spark, sf):
    return catalog.tag_counts(features(spark, sf))


GATE = f"(SELECT patch_id, source, scene_id, min(scene_order) AS scene_order, avg(CAST(valid AS DOUBLE)) AS clear FROM {OBS} GROUP BY 1, 2, 3)"
ENOUGH = "NOT clear < CASE source WHEN 's1' THEN 0.95 ELSE 0.90 END"


@query(f"""SELECT patch_id, source, status, count(*) AS n FROM (SELECT patch_id, source, CASE WHEN NOT ok THEN 'too_cloudy' WHEN row_number() OVER (PARTITION BY patch_id, source, ok ORDER BY scene_order, scene_id) > 5 THEN 'over_cap' ELSE 'accepted' END AS status
  FROM (SELECT *, {ENOUGH} AS ok FROM {GATE})) GROUP BY 1, 2, 3""")
def agg15_win19_quality_gate(spark, sf):
    return composite.gated(observations(spark, sf), 5).groupBy("patch_id", "source", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT patch_id, source, month, band, pixel, round(CASE WHEN source = 's1' THEN avg(value) FILTER (valid) ELSE median(value) FILTER (valid) END, 6) AS value, bool_or(valid) AS valid FROM {OBS} GROUP BY 1, 2, 3, 4, 5")
def agg13_patch_composite(spark, sf):
    return composite.composite(observations(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"SELECT patch_id, source, month, band, pixel, round(avg(value) FILTER (valid), 6) AS value, bool_or(valid) AS valid FROM {OBS} GROUP BY 1, 2, 3, 4, 5")
def agg14_scene_composite(spark, sf):
    return composite.composite(observations(spark, sf), "scene").withColumn("value", F.round("value", 6))


@query(f"SELECT patch_id, source, month, band, pixel, round(CASE source WHEN 's2' THEN max(value) FILTER (valid) WHEN 's1' THEN avg(value) FILTER (valid) ELSE median(value) FILTER (valid) END, 6) AS value FROM {OBS} GROUP BY 1, 2, 3, 4, 5")
def udf03_chosen_reducer(spark, sf):
    return composite.composite(observations(spark, sf), reducers={"s2": "max"}).drop("valid").withColumn("value", F.round("value", 6))


@query(f"SELECT patch_id, source, month, pixel, arg_min(qa, {{'o': scene_order, 's': scene_id, 'q': qa}}) AS qa FROM {OBS} WHERE valid GROUP BY 1, 2, 3, 4")
def win20_first_valid(spark, sf):
    rows = observations(spark, sf).withColumn("scene_id", F.struct("scene_id", "qa"))
    return composite.first_valid(rows)


@query(f"""SELECT patch_id, source, CASE WHEN ok > 0 THEN 'ok' WHEN patch_id % 4 = 1 THEN 'retryable_error' WHEN n < 60 THEN 'no_candidate' ELSE 'no_valid_pixels' END AS status
  FROM (SELECT patch_id, source, count(*) AS n, count(*) FILTER (valid AND patch_id % 2 = 0) AS ok FROM {OBS} GROUP BY 1, 2)""")
def agg16_scene_status(spark, sf):
    ok = F.sum((F.col("valid") & (F.col("patch_id") % 2 == 0)).cast("long")).alias("ok")
    rows = observations(spark, sf).groupBy("patch_id", "source").agg(F.count(F.lit(1)).alias("n"), ok)
    errors = F.array(F.when(F.col("patch_id") % 4 == 1, "timed out").otherwise("empty intersection"))
    few = F.when(F.col("n") < 60, 0).otherwise(F.col("n"))
    return rows.select("patch_id", "source", composite.scene_status(few, F.col("ok"), errors).alias("status"))


@query(f"""WITH m AS (SELECT patch_id, source, date, band, pixel, avg(value) FILTER (valid) AS value, bool_or(valid) AS valid FROM {OBS} GROUP BY 1, 2, 3, 4, 5),
  s AS (SELECT patch_id, source, date, avg(CAST(valid AS DOUBLE)) AS share FROM m GROUP BY 1, 2, 3 HAVING avg(CAST(valid AS DOUBLE)) >= 0.3) SELECT m.patch_id, m.source, count(*) AS n, round(sum(value), 4) AS total FROM m JOIN s USING (patch_id, source, date) GROUP BY 1, 2""")
def agg17_daily_mosaic(spark, sf):
    return composite.daily_mosaic(observations(spark, sf)).groupBy("patch_id", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT source, strftime(date, '%Y%m%d') AS day, count(*) AS n FROM {OBS} GROUP BY 1, 2")
def agg18_observation_counts(spark, sf):
    return frames.observation_counts(observations(spark, sf))


@query(f"""SELECT k.patch_id, k.source, k.band, k.pixel, CAST(m.month AS INT) AS month, round(coalesce(total, 0) / greatest(coalesce(n, 0), 1), 6) AS value, CAST(coalesce(n, 0) > 0 AS INT) AS mask
  FROM (SELECT DISTINCT patch_id, source, band, pixel FROM {OBS}) k, (VALUES (199601), (199602), (199603)) m(month)
  LEFT JOIN (SELECT patch_id, source, band, pixel, month, sum(CASE WHEN valid THEN value ELSE 0 END) AS total, sum(valid::INT) AS n FROM {OBS} GROUP BY 1, 2, 3, 4, 5) s
  ON s.patch_id = k.patch_id AND s.source = k.source AND s.band = k.band AND s.pixel = k.pixel AND s.month = m.month""")
def agg19_monthly_frames(spark, sf):
    return frames.monthly_frames(observations(spark, sf), [199601, 199602, 199603]).withColumn("value", F.round("value", 6))


@query(f"SELECT patch_id, source, band, pixel, round(sum(CASE WHEN valid THEN value ELSE 0 END) / greatest(count(*) FILTER (valid), 1), 6) AS value FROM {OBS} GROUP BY 1, 2, 3, 4")
def agg20_all_date_mean(spark, sf):
    return frames.all_date_mean(observations(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"SELECT patch_id, pixel, arg_max(value, {{'d': date, 'v': value}}) AS value, CAST(m.month AS INT) AS month FROM {OBS} o, (VALUES (199601), (199602)) m(month) GROUP BY 1, 2, 4")
def agg20_latest_category(spark, sf):
    return frames.latest_category(observations(spark, sf), [199601, 199602])


@query(f"SELECT sample_id, bin, coalesce(v, -1.0) AS value, CAST(v IS NOT NULL AS INT) AS mask FROM (SELECT s.sample_id, CAST(b.bin AS INT) AS bin, round(avg(o.value), 6) AS v FROM (SELECT DISTINCT patch_id AS sample_id FROM {OBS}) s CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS bin) b LEFT JOIN {OBS} o ON o.patch_id = s.sample_id AND (o.month // 100 - 1995) * 12 + o.month % 100 - 11 = b.bin GROUP BY 1, 2)")
def agg34_month_bins(spark, sf):
    rows = observations(spark, sf).withColumnRenamed("patch_id", "sample_id")
    return frames.month_bins(rows, 199511, 6, -1.0).withColumn("value", F.round("value", 6))


@query("SELECT c_mktsegment AS region, slot, round(avg(CASE slot WHEN 'optical' THEN CAST(c_acctbal > 0 AS DOUBLE) ELSE CAST(c_custkey % 3 = 0 AS DOUBLE) END), 6) AS share FROM customer, (VALUES ('optical'), ('radar')) s(slot) GROUP BY 1, 2")
def agg36_availability(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("region"), F.create_map(F.lit("optical"), F.col("c_acctbal") > 0, F.lit("radar"), F.col("c_custkey") % 3 == 0).alias("available"))
    return frames.availability(rows).withColumn("share", F.round("share", 6))


@query(f"SELECT patch_id, month, round(CASE WHEN sum(CASE WHEN valid THEN exp(bits / 32.0) ELSE 0 END) > 0 THEN sum(CASE WHEN valid THEN exp(bits / 32.0) * value ELSE 0 END) / sum(CASE WHEN valid THEN exp(bits / 32.0) ELSE 0 END) ELSE 0 END, 5) AS value FROM {OBS} GROUP BY 1, 2")
def agg38_fused(spark, sf):
    rows = observations(spark, sf).select("patch_id", "month", "value", F.col("valid").alias("available"), (F.col("bits") / 32.0).alias("score"))
    return frames.fused(rows).withColumn("value", F.round("value", 5))


@query(f"""SELECT source, count(*) AS n, count(*) FILTER ({unit("'6:source:' || patch_id || ':' || source")} >= 0.3) AS kept, count(*) FILTER ({unit("'6:block:' || patch_id || ':' || (pixel // 2) || ':' || (band // 2)")} >= 0.25) AS kept_blocks FROM {OBS} GROUP BY 1""")
def fn43_dropout(spark, sf):
    rows = observations(spark, sf).withColumnsRenamed({"patch_id": "sample_id", "pixel": "row", "band": "col"})
    by_source = frames.source_dropout(rows, 6, 0.3).withColumnRenamed("kept", "by_source")
    both = frames.block_dropout(by_source, 6, 2, 0.25)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("by_source").cast("long")).alias("kept"), F.sum(F.col("kept").cast("long")).alias("kept_blocks"))


@query(f"""SELECT patch_id AS sample_id, count(DISTINCT month) AS months, CAST(least(floor({unit("'6:months:' || patch_id")} * 3) + 1, count(DISTINCT month)) AS BIGINT) AS dropped FROM {OBS} GROUP BY 1""")
def fn43_month_dropout(spark, sf):
    rows = observations(spark, sf).select(F.col("patch_id").alias("sample_id"), "month").distinct()
    return frames.month_dropout(rows, 6, 3).groupBy("sample_id").agg(F.count(F.lit(1)).alias("months"), F.sum((~F.col("kept")).cast("long")).alias("dropped"))


TILES = f"(SELECT patch_id, source, month, band, pixel, max(value) AS value FROM {OBS} GROUP BY 1, 2, 3, 4, 5)"


def tiles(spark, sf):
    best = observations(spark, sf).groupBy("patch_id", "source", "month", "band", "pixel").agg(F.max("value").alias("value"))
    return composite.tile_rows(best, 7)


@query(f"SELECT * FROM {TILES}")
def src14_src15_tile_rows(spark, sf):
    """Tiles written by source and month, verified before they are published, and read again as pixels."""
    rows = tiles(spark, sf)
    path = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    # The observations say how many tiles there must be.
    write_tiles(rows, path, observations(spark, sf).select("patch_id", "source", "month", "band").distinct().count(), 7)
    return composite.pixel_rows(read_published(spark, path, digests=True).select(*rows.columns)).where("value is not null").select("patch_id", "source", "month", "band", F.col("pixel").cast("long").alias("pixel"), "value")


@query("SELECT c_custkey, c_acctbal AS a, round(0.75::DOUBLE * c_acctbal + 0.25::DOUBLE * c_custkey, 4) AS b, round(0.25::DOUBLE * c_acctbal + 0.75::DOUBLE * c_custkey, 4) AS c, c_custkey::DOUBLE AS d FROM customer")
def fn44_resized(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.array("c_acctbal", F.col("c_custkey").cast("double")).alias("values"))
    out = composite.resized(rows, 1, 2, 1, 4)
    return out.select("c_custkey", *[F.round(F.get("values", F.lit(i)), 4).alias(n) for i, n in enumerate("abcd")])
