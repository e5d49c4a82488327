"""Helpers that the corpus operators share: tables, shared storage, words, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch may hold; texts can be long, so batches stay small.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; also bounds the Arrow batches of the Python stages that will read it."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int("".join(c for c in spark.conf.get(key) if c in "-0123456789"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``, or the checkpoint folder that was set).

    Only a session within one process may go without: a temporary folder is made there. On a cluster
    that is an error, since executors could not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; all that is written between stages lies there."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage (a lost executor costs a reread, not a recomputation) and gives the next
    shuffle a plain scan below it, so that adaptive execution can split skewed partitions. What no
    later step reads is deleted with ``release``; what a returned DataFrame reads stays until
    ``clear`` or the end of whoever owns the shared folder.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` once everything that was derived from them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t._written)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written between stages; results not yet read become unreadable."""
    _delete(spark, work_dir(spark))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column of the user's has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_memories: list[dict] = []


def memory(held: dict) -> dict:
    """Registers what a worker remembers between tasks (ids of pieces, hashes of words)."""
    _memories.append(held)
    return held


def forget(*kept: dict) -> None:
    """Empties every other operator's memory: workers are reused, and stages follow one another."""
    for held in _memories:
        if all(held is not k for k in kept):
            held.clear()


class Hashes(dict):
    """word -> its 64-bit hash, computed once while remembered."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


word_hashes = memory(Hashes())


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes methods know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_or_empty(col) -> F.Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def id_fold(doc_id, parts: int):
    """crc32 of the id as text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sums_before(df: DataFrame, bucket: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each, by (bucket, order), as column ``name``.

    Sums within buckets and sums of whole buckets are taken apart, so one task sees a row per bucket only.
    """
    inside = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(bucket).agg(F.sum(value).alias("_n"))
    whole = whole.select(F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    rows = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = rows.join(whole, rows[bucket] == whole["_bucket"])
    return joined.withColumn(name, (F.col("_inside") + F.col("_ahead")).cast("long")).drop("_inside", "_bucket", "_ahead")


#: Nodes that a task holds while it reduces edges; what it has so far is passed on then.
FOREST_NODES = 1_000_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition -> star edges (node, smallest node of its local component)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if root(x) != x]
        for i in range(0, len(nodes), 100_000):
            part = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST_NODES:
            yield from stars()
            parent.clear()
    yield from stars()


def connected(edges: DataFrame) -> DataFrame:
    """Components of (a long, b long) edges -> (node, root), root the smallest node; roots are left out.

    The result is a written table, for ``release``. Each partition first reduces its edges to stars (union-find), then large-star and small-star
    rounds run as joins on written tables until nothing changes. The minima are written
    before they are joined, so that a hub with very many edges is split, never one task.
    """
    cur = materialise(edges.where("a <> b").select("a", "b").mapInArrow(_local_forest, "a long, b long").distinct(), "edges")
    stamp = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = stamp(cur)
    while now[0]:
        before = now
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "large")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        spread = materialise(large.where("a <> b").distinct(), "edges")
        release(cur, least)
        least = materialise(spread.groupBy("a").agg(F.min("b").alias("m")), "small")
        moved = spread.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b")))
        cur = materialise(small.where("a <> b").distinct(), "edges")
        release(spread, least)
        now = stamp(cur)
        if now == before:
            break
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._written = cur._written
    return out
