"""Token-id shards in patched frame-of-reference blocks.

A shard is a sequence of ids and the documents they belong to, in ascending document order:

    magic "PFR1" | u32 ids | u32 block size | u32 blocks | u32 start[blocks + 1] | blocks

``start`` indexes the blocks, so any id range is read without decoding what precedes it. A block:

    u32 minimum | u8 width | u16 exceptions | packed low bits | u16 position[] | u32 high bits[]

The last block repeats its last id up to the block size. The minimum is subtracted, differences are packed at the width that holds ``percentile`` of them,
and an outlier's bits above that width go to the exception list that patches the block.
Shards are rows of a Parquet table (columns below), since Spark's writers reach any store.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import default_tokenizer, encoder, regrouped
from gridloom.llm.common import bound_batches, sums_before, text_or_empty, work_dir

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 95.0
#: A shard is closed once it holds this many ids.
SHARD_IDS = 1 << 20
#: Id appended to each document.
END_ID = 0
SHARD_SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Low ``width`` bits of each value, least significant first: (k, n) values -> (k, bytes).

    n is a multiple of 64, so each 64 values fill ``width`` whole words and all rows go at once. At the width
    of a machine integer these are the bytes of such integers.
    """
    k, n = rows.shape
    if width in (8, 16, 32):
        return rows.astype(f"<u{width // 8}").view(np.uint8)
    out = np.zeros((k, n // 64, width), "<u8")
    values = (rows.astype(np.uint64) & np.uint64((1 << width) - 1)).reshape(k, n // 64, 64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= values[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= values[:, :, i] >> np.uint64(64 - shift)
    return out.reshape(k, -1).view(np.uint8)


def _unpack(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    """(k, bytes) -> (k, n) values."""
    k = len(raw)
    if width in (8, 16, 32):
        return np.ascontiguousarray(raw).view(f"<u{width // 8}")
    words = np.ascontiguousarray(raw).view("<u8").reshape(k, n // 64, width)
    out = np.empty((k, n // 64, 64), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = value
    return out.reshape(k, n) & np.uint64((1 << width) - 1)


def encode_shard(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """``block``: a multiple of 64, 65,536 at most (positions have 16 bits). The last block is filled up."""
    n_blocks = -(-len(ids) // block)
    rows = np.full((n_blocks, block), ids[-1] if len(ids) else 0, np.uint32)
    rows.ravel()[: len(ids)] = ids
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    at = min(block - 1, int(block * percentile / 100))
    widths = np.array([int(x).bit_length() for x in np.partition(diff, at, axis=1)[:, at]])
    parts: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        packed = _pack(diff[which], width) if width else np.empty((len(which), 0), np.uint8)
        high = diff[which] >> np.uint32(width) if width < 32 else np.zeros((len(which), block), np.uint32)
        k = np.count_nonzero(high, axis=1)
        ends = np.cumsum(k).tolist()
        where, rest = np.nonzero(high)[1].astype("<u2").tobytes(), high[high > 0].astype("<u4").tobytes()
        for i, least, low_bits, n, e in zip(which.tolist(), low[which].tolist(), packed, k.tolist(), ends):
            parts[i] = struct.pack("<IBH", least, width, n) + low_bits.tobytes() + where[2 * (e - n) : 2 * e] + rest[4 * (e - n) : 4 * e]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype("<u4")
    return MAGIC + struct.pack("<III", len(ids), block, n_blocks) + starts.tobytes() + b"".join(parts)


def decode_shard(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a shard; only the blocks that hold them are read."""
    view = memoryview(payload)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a token shard")
    n, block, n_blocks = struct.unpack_from("<III", view, 4)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    starts = (np.frombuffer(view, "<u4", n_blocks + 1, 16) + np.uint32(16 + 4 * (n_blocks + 1))).tolist()
    first, last = start // block, (stop - 1) // block
    heads = [struct.unpack_from("<IBH", view, starts[i]) for i in range(first, last + 1)]
    widths = np.array([h[1] for h in heads])
    out = np.zeros((len(heads), block), np.uint32)
    raw = np.frombuffer(view, np.uint8)
    for width in np.unique(widths[widths > 0]).tolist():
        which = np.flatnonzero(widths == width)
        size = block // 8 * width
        out[which] = _unpack(np.stack([raw[starts[first + i] + 7 : starts[first + i] + 7 + size] for i in which.tolist()]), block, width)
    for i, (_, width, k) in enumerate(heads):
        if k:
            at = starts[first + i] + 7 + block // 8 * width
            out[i, np.frombuffer(view, "<u2", k, at)] |= np.frombuffer(view, "<u4", k, at + 2 * k) << np.uint32(width)
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    return out.ravel()[start - first * block : stop - first * block]


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> None:
    """Encode whole texts, append ``end_id`` to each and write shards in ascending doc_id order.

    One shuffle: texts are dealt into ranges of (doc_id, row number), so rows that share an id are
    split too; each range is encoded and written by its task. Null text is empty; null ids come first.
    """
    bound_batches(docs.sparkSession)
    vocabulary = tokenizer or default_tokenizer()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys, ids, held = [], [], 0
        end = np.array([end_id], "<u4")

        def shard() -> pa.RecordBatch:
            row = [[part], [seq], [held], [keys], [[len(x) for x in ids]], [encode_shard(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["part", "seq", "n_ids", "doc_ids", "doc_tokens", "payload"])

        for b in regrouped(batches):
            for key, text_ids in zip(b.column("doc_id").to_pylist(), enc.encode_texts(b.column("text"))):
                keys.append(key)
                ids.append(np.concatenate([text_ids, end]))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield shard()
                    keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    ranged.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def documents_of(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, decoded from the payloads.

    A shard knows its documents' places within itself; the ids before it are added from the shards'
    sizes afterwards, so payloads are decoded where they are read.
    """
    firsts = sums_before(shards.select("part", "seq", "n_ids"), "part", "seq", "n_ids", "first").select("part", "seq", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, keys, sizes, payload in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "doc_tokens", "payload"))):
                ids, n = decode_shard(payload).astype("<u4"), len(keys)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), sizes)]
                cols = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(ends - np.array(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "place", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "doc_ids", "doc_tokens", "payload").mapInArrow(run, "part int, seq int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(firsts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared storage and read the documents back.

    Null text is the end id only; null ids come first, rows that repeat an id or are equal follow in the
    order of the scan, each a document; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer)
    return documents_of(read_shards(spark, path))
