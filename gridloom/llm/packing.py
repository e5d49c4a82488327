"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document is cut at multiples of the capacity. Full pieces are windows of their own; each
document's rest is cut into fragments, the items. Items are dealt by a hash into groups of a
bounded size, and each group is differenced: two partial partitions with the largest imbalances are merged again
and again, one's heaviest windows with the other's lightest, which gives near-equal windows. The
number of windows starts at the least that could hold the group and rises whenever one is overfull.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import default_tokenizer, encoder, regrouped
from gridloom.llm.common import bound_batches, materialise, sums_before, text_or_empty

CAPACITY = 1024
#: A document's rest is cut into items of this size and one smaller, so that windows come out even.
FRAGMENT = 512
#: Items that are differenced together, on average.
GROUP_ITEMS = 512
END_ID = 0


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of each of ``windows`` windows with near-equal sums.

    A partial partition keeps its occupied windows only, as (-sum, items) with the heaviest first.
    """
    heap = [(-n, i, [(-n, (i,))]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        clash = len(a) + len(b) - windows
        if clash > 0:  # the lightest of a meet the lightest of b, in opposite order
            met = [(x + y, p + q) for (x, p), (y, q) in zip(a[len(a) - clash :], b[: len(b) - clash - 1 : -1] if clash < len(b) else b[::-1])]
            merged = a[: len(a) - clash] + b[: len(b) - clash] + met
        else:
            merged = a + b
        merged.sort()
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (merged[0][0] - least, tie, merged))
        tie += 1
    return [list(items) for _, items in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of item numbers, none over ``capacity``; each size is between 1 and the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, windows)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in out)
        if not over:
            return out
        windows += max(1, over // capacity)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, fragment: int = FRAGMENT, end_id: int = END_ID) -> DataFrame:
    """One row per document: row, doc_id, doc_tokens, crcs (one per piece), part, full_before.

    ``full_before`` counts the full pieces of earlier rows of the same task, for numbering windows.
    """
    bound_batches(docs.sparkSession)
    vocabulary = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, row, full = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4")
        for b in regrouped(batches):
            out: list[tuple] = []
            for key, text_ids in zip(b.column("doc_id").to_pylist(), enc.encode_texts(b.column("text"))):
                ids = np.concatenate([text_ids, end]).astype("<u4")
                whole = len(ids) // capacity
                cuts = [*range(0, whole * capacity, capacity), *range(whole * capacity, len(ids), fragment), len(ids)]
                crcs = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
                out.append(((part << 33) + row, key, len(ids), crcs, part, full))
                row, full = row + 1, full + whole
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["row", "doc_id", "doc_tokens", "crcs", "part", "full_before"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    return src.mapInArrow(run, "row long, doc_id long, doc_tokens long, crcs array<long>, part int, full_before long")


def windows(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, fragment: int = FRAGMENT, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is an empty document (its end id only). Rows that repeat an id are packed apart; an empty table
    gives no pieces; other columns are not read.
    Full pieces take the sequence ids from 0 on, the groups' windows follow, group by group.
    """
    docs_of = materialise(pieces(docs, tokenizer, capacity, fragment), "pieces")
    full, rest = F.floor(F.col("doc_tokens") / capacity), F.col("doc_tokens") % capacity
    cut = docs_of.where(rest > 0).select("*", F.explode(F.sequence(F.lit(0), F.ceil(rest / fragment).cast("int") - 1)).alias("k"))
    items = cut.select(
        "row", "k", "doc_id", "doc_tokens", (full * capacity + F.col("k") * fragment).alias("start"), F.least(F.lit(fragment), rest - F.col("k") * fragment).alias("length"), F.get("crcs", full.cast("int") + F.col("k")).alias("ids_crc32")
    )
    groups = max(1, -(-items.count() // group_items))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "k"]).reset_index(drop=True)  # the same windows whatever the order of arrival
        sizes = pdf["length"].tolist()
        placed = [(i, w, at) for w, chosen in enumerate(pack(sizes, capacity)) for i, at in zip(chosen, np.cumsum([0] + [sizes[j] for j in chosen]).tolist())]
        out = pdf.loc[[i for i, _, _ in placed], ["grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["window"], out["offset"] = [w for _, w, _ in placed], [at for _, _, at in placed]
        return out

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("row", "k"), F.lit(groups)))
    placed = materialise(dealt.groupBy("grp").applyInPandas(solve, "grp long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long"), "windows")

    run_of = lambda c: F.floor(F.col(c) / 4096).alias("run")
    of_parts = docs_of.groupBy("part").agg(F.sum(full).alias("n")).select("part", run_of("part"), "n")
    of_groups = placed.groupBy("grp").agg((F.max("window") + 1).alias("n")).select("grp", run_of("grp"), "n")
    first_of_part = sums_before(of_parts, "run", "part", "n", "ahead").select("part", "ahead")
    first_of_group = sums_before(of_groups, "run", "grp", "n", "ahead").select("grp", "ahead")
    n_full = docs_of.agg(F.coalesce(F.sum(full), F.lit(0)).cast("long").alias("n_full"))

    whole = docs_of.where(F.col("doc_tokens") >= capacity).join(first_of_part, "part")
    whole = whole.select("doc_id", "doc_tokens", "crcs", (F.col("ahead") + F.col("full_before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("k"))
    whole = whole.select(
        "doc_id", (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.get("crcs", F.col("k").cast("int")).alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    base = n_full.first()["n_full"]
    rest = placed.join(first_of_group, "grp")
    rest = rest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(base) + F.col("ahead") + F.col("window")).alias("sequence_id"), "offset")
    return whole.unionByName(rest)
