"""Strict readers: explicit schemas, bad input as rows of a violations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.sources.inventory import inventory


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of JSON lines; blank lines are skipped, a bad line is named with its text and file."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    kept = StructType([*kind.fields, StructField("_bad", StringType())])
    parsed = lines.select("value", "file", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.trim("value").startswith("{")
    return parsed.where(~bad).select(*[F.col(f"r.{c}").alias(c) for c in kind.names]), parsed.where(bad).select("file", F.col("value").alias("line"))


def scan_cells(spark: SparkSession, root: str, columns: list[str], partition: str | None = None) -> DataFrame:
    """Named columns of a partitioned cell table; missing ones are an error before any row is read."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(root)
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return (df if partition is None else df.where(F.col("partition") == partition)).select(*columns)


def read_patch_grid(spark: SparkSession, path: str) -> DataFrame:
    """Patches of a JSON file that is a list or an object with ``patches``."""
    fields = "patch_id string, bounds array<double>"
    text = spark.read.option("wholetext", True).text(path)
    listed = F.from_json("value", f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    nested = F.from_json("value", f"struct<patches:array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>>")["patches"]
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(nested)).alias("p")).select("p.*")


def grid_extent(patches: DataFrame, step: float = 10.0) -> DataFrame:
    """One row: origin and shape of the master grid that holds all patches."""
    low = lambda i: F.floor(F.min(F.get("bounds", F.lit(i))) / step) * step
    high = lambda i: F.ceil(F.max(F.get("bounds", F.lit(i))) / step) * step
    box = patches.agg(low(0).alias("left"), low(1).alias("bottom"), high(2).alias("right"), high(3).alias("top"))
    return box.withColumn("width", ((F.col("right") - F.col("left")) / step).cast("long")).withColumn("height", ((F.col("top") - F.col("bottom")) / step).cast("long"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest, size) of every file under ``path``; see ``inventory``."""
    return inventory(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "digest", "size")


def checksum_problems(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem): missing, unexpected, differing and repeated members."""
    n = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest"), F.min("size").alias("size"))
    e = expected.select("name", F.col("digest").alias("want_digest"), F.col("size").alias("want_size"))
    both = n.join(e, "name", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("want_digest").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when((F.col("digest") != F.col("want_digest")) | (F.col("size") != F.col("want_size")), "differs")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def load_fold(folds: DataFrame, fold: int) -> DataFrame:
    """(fold, split, patch_id) of one fold, which must be there once. ``folds``: fold, train, val, test."""
    rows = folds.where(F.col("fold") == fold)
    if (n := rows.count()) != 1:
        raise ValueError(f"fold {fold} occurs {n} times")
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("ids")) for s in ("train", "val", "test")])
    return rows.select("fold", F.explode(parts).alias("p")).select("fold", "p.split", F.explode("p.ids").alias("patch_id"))


def map_features(features: DataFrame) -> DataFrame:
    """Ways and relations of (kind, tags); nodes are skipped."""
    return features.where(F.col("kind") != "node")


def embedding_dataset(embeddings: DataFrame, labels: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of aligned embeddings and labels: size, finiteness, unique ids, alignment."""
    from gridloom.functions.contracts import violations
    from gridloom.functions.pixels import finite

    ids = embeddings.groupBy("patch_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = embeddings.join(labels, "patch_id", "left").join(ids, "patch_id")
    rules = {"size": F.size("embedding") == dims, "finite": F.forall("embedding", lambda x: finite(x)), "unique": F.col("_n") == 1, "label": F.col("label").isNotNull()}
    checked = rows.withColumn("violations", violations(rules)).drop("_n")
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0).select("patch_id", "violations")
