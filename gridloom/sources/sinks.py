"""Writers: new targets only, bounded files, counts returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.publish import publish, stage

MAX_ROWS_PER_FILE = 100_000


def row_blocks(cells: DataFrame, rows_per_block: int = 1000) -> DataFrame:
    """Cells with the bucket of their row, dealt by range so that each file is a spatial run."""
    blocks = cells.withColumn("row_block", F.floor(F.col("grid_row") / rows_per_block).cast("long"))
    return blocks.repartitionByRange("grid_id", "row_block", "grid_row").sortWithinPartitions("grid_id", "grid_row", "grid_col", "parent_key")


def write_cells(cells: DataFrame, registry: DataFrame, root: str) -> DataFrame:
    """All cells, and the sampled and unsampled ones by the registry, by partition and grid; returns counts."""
    marked = cells.join(registry.select("parent_key").distinct().withColumn("in_registry", F.lit(True)), "parent_key", "left")
    side = F.when(F.col("in_registry"), "sampled").otherwise("unsampled")
    rows = marked.withColumn("partition", F.explode(F.array(F.lit("all"), side))).drop("in_registry")
    rows.write.mode("errorifexists").partitionBy("partition", "grid_id").option("compression", "zstd").option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(root)
    return cells.sparkSession.read.parquet(root).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


def write_shards(rows: DataFrame, sizes: list[int], root: str) -> None:
    """Rows by shard and grid; each shard must have its declared size before anything is written."""
    found = {r["shard_id"]: r["n"] for r in rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    if found != {i: n for i, n in enumerate(sizes) if n}:
        raise ValueError(f"shard sizes {found} are not {sizes}")
    out = rows.withColumn("shard_id", F.col("shard_id").cast("tinyint"))
    out.write.mode("errorifexists").partitionBy("shard_id", "grid_id").option("compression", "zstd").option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(root)


def registry_csv(registry: DataFrame, columns: list[str], path: str) -> None:
    """CSV with a header; quotes within a value are doubled, as readers of plain CSV expect."""
    registry.select(*columns).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_tiles(tiles: DataFrame, root: str, expected: int, width: int) -> None:
    """Tile rows by source and month, read back and verified before they are published: ``expected`` rows of ``width`` values, files as written."""
    publish(stage(tiles, root, ["source", "month"], F.size("values") != width), expected)


def write_embeddings(rows: DataFrame, root: str) -> None:
    """Embeddings of non-empty ids; anything not finite stops the export."""
    bad = rows.where(F.col("problem").isNotNull() | (F.coalesce(F.col("patch_id").cast("string"), F.lit("")) == ""))
    if not bad.isEmpty():
        raise ValueError(f"bad embedding: {bad.first()}")
    rows.drop("problem").write.mode("errorifexists").parquet(root)


def feature_collection(features: DataFrame, text: str = "feature") -> DataFrame:
    """One GeoJSON FeatureCollection of a shard index (a feature per shard)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard_id", text))), lambda s: s[text]), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("value"))
