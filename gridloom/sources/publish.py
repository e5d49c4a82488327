"""Tables that are visible only once they are verified.

Rows are written to a folder of their own under the target. They are read back file by file: rows and whatever the caller
counts as broken, the bytes' digests and lengths. Before publishing all that is taken again and compared, so a file that was
removed, damaged or added meanwhile stops it. Then one manifest is written, which names the folder and its files; a reader goes by the
manifest, so the table appears at once or not at all, and what failed leaves a folder that nobody reads.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.ranking import settled
from gridloom.sources.inventory import inventory

MANIFEST = "file string, rows long, size long, digest string, folder string"


@dataclass
class Staged:
    """A written folder and what was found in it: (file, rows, broken, size, digest), a row for each file."""

    root: str
    folder: str
    files: DataFrame
    broken: Column


def _found(spark: SparkSession, path: str, broken: Column) -> DataFrame:
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), F.coalesce(broken, F.lit(True)).cast("long").alias("b"))
    counted = rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.sum("b").alias("broken"))
    name = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "file:/"), "%3D", "=")
    listed = inventory(spark, path).where(F.col("path").endswith(".parquet")).withColumn("path", name(F.col("path")))
    both = listed.join(counted.withColumn("path", name(F.col("path"))), "path", "full_outer")
    file = F.regexp_extract("path", path.rsplit("/", 1)[1] + "/(.*)$", 1)
    return both.select(file.alias("file"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("broken", F.lit(0)).alias("broken"), "size", "digest")


def stage(rows: DataFrame, root: str, by: list[str], broken: Column) -> Staged:
    """Writes ``rows`` beside what is published under ``root`` (nothing may be) and takes stock; ``broken`` is true for rows that must not be there."""
    spark = rows.sparkSession
    if visible(spark, root):
        raise ValueError(f"{root} is published already")
    folder = f"part-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").partitionBy(*by).parquet(f"{root}/{folder}")
    return Staged(root, folder, settled(_found(spark, f"{root}/{folder}", broken)), broken)


def problems(staged: Staged) -> DataFrame:
    """(file, problem) of files that are not what they were when they were written."""
    spark = staged.files.sparkSession
    now = inventory(spark, f"{staged.root}/{staged.folder}").where(F.col("path").endswith(".parquet"))
    now = now.select(F.regexp_extract("path", staged.folder + "/(.*)$", 1).alias("file"), F.col("size").alias("now_size"), F.col("digest").alias("now_digest"))
    both = staged.files.join(now, "file", "full_outer")
    problem = F.when(F.col("now_digest").isNull(), "missing").when(F.col("digest").isNull(), "added").when((F.col("digest") != F.col("now_digest")) | (F.col("size") != F.col("now_size")), "damaged")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def publish(staged: Staged, expected: int) -> None:
    """Makes a staged table visible if it has ``expected`` rows, none of them broken, and its files are as they were written."""
    total = staged.files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken")).first()
    if total["rows"] != expected or total["broken"]:
        raise ValueError(f"{total['rows']} rows of {expected}, {total['broken']} of a wrong size")
    if (bad := problems(staged).orderBy("file").limit(5).collect()):
        raise ValueError(f"files are not as they were written: {[tuple(r) for r in bad]}")
    listed = staged.files.select("file", "rows", "size", "digest", F.lit(staged.folder).alias("folder"))
    listed.coalesce(1).write.mode("errorifexists").json(f"{staged.root}/manifest")


def visible(spark: SparkSession, root: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_published(spark: SparkSession, root: str, digests: bool = False) -> DataFrame:
    """The published rows; files must be there with the length (``digests``: and the bytes) that the manifest states."""
    if not visible(spark, root):
        raise ValueError(f"nothing is published under {root}")
    files = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    folder = files.select("folder").first()["folder"]
    path = f"{root}/{folder}"
    if digests:
        found = inventory(spark, path).select("path", "size", "digest")
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("digest"))
    found = found.where(F.col("path").endswith(".parquet")).select(F.regexp_extract("path", folder + "/(.*)$", 1).alias("file"), F.col("size").alias("now_size"), F.col("digest").alias("now_digest"))
    wrong = files.join(found, "file", "full_outer").where(~F.col("size").eqNullSafe(F.col("now_size")) | (F.lit(digests) & ~F.col("digest").eqNullSafe(F.col("now_digest"))))
    if (bad := wrong.select("file").orderBy("file").limit(5).collect()):
        raise ValueError(f"files do not match the manifest: {[r['file'] for r in bad]}")
    return spark.read.parquet(path)
