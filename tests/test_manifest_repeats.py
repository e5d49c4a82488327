from pyspark.sql import functions as F

from gridloom.operators import manifest


def test_report_counts_all_repeated_identities(spark, tmp_path):
    sources = F.create_map(F.lit("s2"), F.array(F.lit("a")))
    rows = spark.range(300).select((F.col("id") % 150).cast("string").alias("patch_id"), F.lit("r").alias("region"), sources.alias("sources"), F.lit(None).cast("string").alias("source_patch_id"))
    rows.write.json(f"{tmp_path}/records")
    spark.sql("select 1 as schema_version, array(1) as months, 300L as record_count, 'x' as digest").write.json(f"{tmp_path}/meta")
    found = manifest.manifest_report(spark, str(tmp_path)).first()
    assert found.repeated == 150 and not found.passed
