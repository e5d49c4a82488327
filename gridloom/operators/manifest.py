"""Manifests: validated records with a digest and a count beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.membership import content_digest, duplicate_keys

RECORD = "patch_id string, region string, sources map<string,array<string>>, source_patch_id string"
META = "schema_version int, months array<int>, record_count long, digest string"
VERSION = 1
#: Columns of a flat manifest that are no sources; fixed values.
METADATA_FIELDS = ["patch_id", "region", "source_patch_id"]


def write_manifest(records: DataFrame, path: str, months: list[int]) -> None:
    """Records as JSON lines under ``path``/records and one meta row under ``path``/meta; both must be new."""
    problems = duplicate_keys(records, ["region", "patch_id"], 1)
    if not problems.isEmpty():
        raise ValueError(f"repeated record: {problems.first()}")
    records.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/records")
    written = records.sparkSession.read.schema(RECORD).json(f"{path}/records")
    meta = content_digest(written, written.columns)
    meta.select(F.lit(VERSION).alias("schema_version"), F.array(*map(F.lit, months)).cast("array<int>").alias("months"), F.col("n").alias("record_count"), "digest").coalesce(1).write.mode("errorifexists").json(f"{path}/meta")


def manifest_report(spark: SparkSession, path: str) -> DataFrame:
    """One row: version, digest, count and uniqueness of what is there against the meta row."""
    records = spark.read.schema(RECORD).json(f"{path}/records")
    meta = spark.read.schema(META).json(f"{path}/meta")
    found = content_digest(records, records.columns).select(F.col("digest").alias("found_digest"), F.col("n").alias("found"))
    repeats = duplicate_keys(records, ["region", "patch_id"], None).agg(F.count(F.lit(1)).alias("repeated"))
    rows = meta.crossJoin(found).crossJoin(repeats)  # one-row reports
    passed = (F.col("schema_version") == VERSION) & (F.col("digest") == F.col("found_digest")) & (F.col("record_count") == F.col("found")) & (F.col("repeated") == 0)
    return rows.withColumn("passed", passed)


def load_manifest(spark: SparkSession, path: str, region: str | None = None, months: list[int] | None = None) -> DataFrame:
    """Verified records, of one region if named; the meta row's months must be the expected ones."""
    report = manifest_report(spark, path).first()
    if report is None or not report["passed"]:
        raise ValueError(f"manifest does not verify: {report}")
    if months is not None and report["months"] != months:
        raise ValueError(f"months {report['months']}, expected {months}")
    records = spark.read.schema(RECORD).json(f"{path}/records")
    return records if region is None else records.where(F.col("region") == region)


def legacy_sources(record: Column, root: str) -> Column:
    """Sources of a flat record (JSON text): every other field, as lists of paths relative to ``root``."""
    fields = F.from_json(record, "map<string,string>")
    others = F.map_filter(fields, lambda k, v: ~F.array_contains(F.array(*map(F.lit, METADATA_FIELDS)), k) & v.isNotNull())
    return F.transform_values(others, lambda k, v: F.array(F.regexp_replace(v, "^" + root.rstrip("/") + "/", "")))


def escapes(path: Column) -> Column:
    """A path that leaves its root: absolute, or with ``..`` among its parts."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
