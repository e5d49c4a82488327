"""Exact distributed ranks: positions in a global order without one task that sorts everything."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a table that is broadcast by request.
MOST_BROADCAST = 100_000


def small(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, so that the join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that was set.

    A session within one process may go without and gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder, so that all that reads it sees the same rows in the same ranges."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def exact_rank(df: DataFrame, order: list[Column], partition: list[str] = (), name: str = "rank", buckets: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row in ``order`` within ``partition`` groups.

    Rows are range-partitioned by (partition, order), numbered within each range, and the counts of
    the ranges before are added. There are as many ranges as the session has shuffle partitions, or
    ``buckets``. ``order`` must end in something unique for a fixed result.
    """
    keys = [F.col(c) for c in partition]
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges come from a sample: both uses below must see one and the same partitioning.
    placed = settled(df.repartitionByRange(buckets, *keys, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *partition).orderBy(*order)
    numbered = placed.withColumn("_local", F.row_number().over(local) - 1)
    before = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part", *partition).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", *partition, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(offsets, ["_part", *partition]).withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")
