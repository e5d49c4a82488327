"""Digests of files, whatever their length: each is streamed in chunks within one task."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task holds.
CHUNK = 8 << 20


def opened(path: str):
    """An input stream of a file; tasks open it themselves, so the file may be of any length."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    system, name = pyarrow.fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_stream(name)


def streamed_digest(stream, chunk: int = CHUNK) -> tuple[str, int]:
    """SHA-256 and length of what a stream gives."""
    digest, size = hashlib.sha256(), 0
    while part := stream.read(chunk):
        digest.update(part)
        size += len(part)
    return digest.hexdigest(), size


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            with opened(path) as stream:
                digest, size = streamed_digest(stream)
            yield pa.RecordBatch.from_pydict({"path": [path], "digest": [digest], "size": pa.array([size], pa.int64())})


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, digest, size) of every file under ``root``, empty ones too, hidden ones left out; SHA-256 of the bytes.

    Files are listed without reading them (Spark's own index, which the driver holds), dealt to tasks by path and streamed there. A
    store that Arrow's file systems do not reach is read by Spark instead, a file in one row, which Spark limits to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    paths = [re.sub("^file:/+", "file:/", unquote(p)) for p in files.inputFiles()]
    listed = spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string())}))
    if paths:
        try:
            opened(paths[0]).close()
        except (OSError, ValueError, NotImplementedError):
            read = files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))
            nothing = F.lit(hashlib.sha256(b"").hexdigest())  # Spark reads no row of an empty file
            return listed.join(read, "path", "left").select("path", F.coalesce("digest", nothing).alias("digest"), F.coalesce("size", F.lit(0)).alias("size"))
    return listed.repartition("path").mapInArrow(_digests, "path string, digest string, size long")
