"""Monthly frames, band statistics, fusion and availability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import stable_unit_hash
from gridloom.functions.pixels import finite, month_index, z_score
from gridloom.operators.ranking import small


def band_statistics(values: DataFrame, nodata: float | None = None) -> DataFrame:
    """(source, band, mean, std, n): population deviation over finite values that are not nodata."""
    ok = finite(F.col("value"))
    if nodata is not None and nodata == nodata:
        ok = ok & (F.col("value") != nodata)
    return values.where(ok).groupBy("source", "band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))


def band_count_conflicts(files: DataFrame) -> DataFrame:
    """Sources whose files do not agree on their number of bands."""
    return files.groupBy("source").agg(F.min("bands").alias("least"), F.max("bands").alias("most")).where("least <> most")


def with_statistics(observations: DataFrame, statistics: DataFrame) -> DataFrame:
    """Observations with their band's mean and std (a small dimension) and their z-score; ``problem`` names gaps."""
    stats = small(statistics.select("source", "band", "mean", "std"))
    rows = observations.join(stats, ["source", "band"], "left")
    usable = finite(F.col("mean")) & finite(F.col("std")) & (F.col("std") > 0)
    problem = F.when(F.col("mean").isNull() & F.col("std").isNull(), "no_statistics").when(~F.coalesce(usable, F.lit(False)), "bad_statistics")
    return rows.withColumn("problem", problem).withColumn("z", z_score(F.col("value"), F.col("mean"), F.col("std"), F.col("valid")))


def monthly_frames(observations: DataFrame, months: list[int]) -> DataFrame:
    """Masked means per (patch, source, month, band, pixel); months without data give zero and mask 0.

    Every tile that appears at all gets all ``months``, a list of the product's length.
    """
    keys = ["patch_id", "source", "band", "pixel"]
    seen = observations.where(F.col("month").isin(months))
    sums = seen.groupBy(*keys, "month").agg(F.sum(F.when(F.col("valid"), F.col("value")).otherwise(0.0)).alias("total"), F.sum(F.col("valid").cast("long")).alias("n"))
    grid = observations.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, months))).alias("month"))
    rows = grid.join(sums, [*keys, "month"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(*keys, "month", (F.coalesce("total", F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("value"), (n > 0).cast("int").alias("mask"))


def all_date_mean(observations: DataFrame) -> DataFrame:
    """Masked mean over all dates."""
    return observations.groupBy("patch_id", "source", "band", "pixel").agg((F.sum(F.when(F.col("valid"), F.col("value")).otherwise(0.0)) / F.greatest(F.sum(F.col("valid").cast("long")), F.lit(1))).alias("value"))


def latest_category(observations: DataFrame, months: list[int]) -> DataFrame:
    """The latest observation's value per pixel, repeated for every month."""
    last = observations.groupBy("patch_id", "pixel").agg(F.max_by("value", F.struct("date", "value")).alias("value"))
    return last.select("patch_id", "pixel", "value", F.explode(F.array(*map(F.lit, months))).alias("month"))


def observation_counts(observations: DataFrame) -> DataFrame:
    """(source, date text, n): observations grouped by their day."""
    return observations.groupBy("source", F.date_format("date", "yyyyMMdd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def month_bins(features: DataFrame, first: int, bins: int, fill: float) -> DataFrame:
    """(sample_id, bin, value, mask): means of a sample's features per month bin, ``fill`` where there is none."""
    at = month_index(F.col("month"), first)
    means = features.withColumn("bin", at).where((at >= 0) & (at < bins)).groupBy("sample_id", "bin").agg(F.avg("value").alias("value"))
    grid = features.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rows = grid.join(means, ["sample_id", "bin"], "left")
    return rows.select("sample_id", "bin", F.coalesce("value", F.lit(fill)).alias("value"), F.col("value").isNotNull().cast("int").alias("mask"))


def availability(records: DataFrame) -> DataFrame:
    """(region, slot, share) from a map slot -> available."""
    return records.select("region", F.explode("available").alias("slot", "there")).groupBy("region", "slot").agg(F.avg(F.col("there").cast("double")).alias("share"))


def fused(rows: DataFrame) -> DataFrame:
    """(patch_id, month, value): softmax of ``score`` over available sources; none available gives zero."""
    there = rows.where("available").groupBy("patch_id", "month").agg(F.max("score").alias("_top"))
    both = rows.join(there, ["patch_id", "month"], "left")
    weight = F.when(F.col("available"), F.exp(F.col("score") - F.col("_top"))).otherwise(0.0)  # at most 1, so no score overflows
    total = F.sum(weight)
    return both.groupBy("patch_id", "month").agg(F.when(total > 0, F.sum(weight * F.coalesce("value", F.lit(0.0))) / total).otherwise(0.0).alias("value"))


def source_dropout(samples: DataFrame, seed: int, rate: float) -> DataFrame:
    """Adds ``kept`` from a hash of sample and source."""
    u = stable_unit_hash(seed, F.concat_ws(":", F.lit("source"), F.col("sample_id").cast("string"), F.col("source")))
    return samples.withColumn("kept", u >= rate)


def month_dropout(samples: DataFrame, seed: int, most: int) -> DataFrame:
    """Adds ``kept``: of each sample 1..``most`` months go, those of least hash."""
    from pyspark.sql import Window

    u = stable_unit_hash(seed, F.concat_ws(":", F.lit("month"), F.col("sample_id").cast("string"), F.col("month").cast("string")))
    count = F.floor(stable_unit_hash(seed, F.concat(F.lit("months:"), F.col("sample_id").cast("string"))) * most) + 1
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(u, "month"))
    return samples.withColumn("kept", place > count)


def block_dropout(pixels: DataFrame, seed: int, size: int, rate: float) -> DataFrame:
    """Adds ``kept``: blocks of size x size pixels go together."""
    block = F.concat_ws(":", F.lit("block"), F.col("sample_id").cast("string"), F.floor(F.col("row") / size).cast("string"), F.floor(F.col("col") / size).cast("string"))
    return pixels.withColumn("kept", stable_unit_hash(seed, block) >= rate)
