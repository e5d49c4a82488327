"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t are at most eps = sqrt(2 - 2t) apart, in any orthogonal projection too.
Vectors are projected on their leading principal directions, put into grid cells of width eps and
ordered by cell; runs of that order are blocks of a bounded size, which may hold many small cells or a part
of a large one. Two blocks are joined only if some of their cells touch and their bounding boxes in more
directions are within eps; only those pairs become rows, so a vector travels once for each block that its
own may link with. A pair of blocks is joined recursively: both intervals are halved while their bounding
boxes may touch, and what is provably distant is skipped. What is left is compared in full dimension;
cosines next to the threshold are settled exactly.

Equal vectors are one entry with a multiplicity, so copies make no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import FloatType

from gridloom.llm.common import bound_batches, connected, materialise, release

THRESHOLD = 0.9
#: Principal directions of the grid: at most 6 ** GRID_DIMS cells of unit vectors at eps 0.447.
GRID_DIMS = 4
#: Principal directions of the boxes of blocks, and of those that the recursion compares.
BOX_DIMS = 16
#: Vectors of a block: a pair of blocks is a row of about 10 MB at 64 single-precision components.
BLOCK = 16_384
LEAF = 512
#: Cosines this close to the threshold are recomputed exactly.
MARGIN = 1e-9


def usable(kind: str):
    """(vec_id, embedding) -> (vec_id, key): the components as ``kind``, -0 as 0; no key for what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for v in b.column("embedding").to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, kind) + np.zeros(1, kind)
                keys.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary())], ["vec_id", "key"])

    return run


def unit(keys: list[bytes], dims: int, kind: str) -> np.ndarray:
    """Rows of unit length in double precision; shorter vectors count as ending in zeros."""
    out = np.zeros((len(keys), dims))
    for i, k in enumerate(keys):
        v = np.frombuffer(k, kind).astype(np.float64)
        out[i, : len(v)] = v / np.abs(v).max()
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def principal(classes: DataFrame, dims: int, kind: str) -> np.ndarray:
    """Columns: the principal directions of all vectors, largest variance first.

    Each task adds up its part of the second moments; the dims x dims sums are all that is gathered.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for b in batches:
            x = unit(b.column("key").to_pylist(), dims, kind)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "value"])

    sums = classes.select("key").mapInArrow(moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros((dims + 1) ** 2)
    total[sums["at"].to_numpy(int)] = sums["value"].to_numpy()
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    return np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1]


def exact_link(a: bytes, b: bytes, threshold: float, kind: str = "<f8") -> bool:
    """cosine >= threshold in rational arithmetic (threshold > 0), on the vectors as given."""
    x, y = ([Fraction(float(c)) for c in np.frombuffer(k, kind)] for k in (a, b))
    dot = sum((p * q for p, q in zip(x, y)), Fraction(0))
    return dot > 0 and dot * dot >= Fraction(str(threshold)) ** 2 * sum(p * p for p in x) * sum(q * q for q in y)


class Side:
    """One block in grid order: unit vectors, box coordinates and what identifies them."""

    def __init__(self, ids: np.ndarray, keys: list[bytes], times: np.ndarray, basis: np.ndarray, eps: float, kind: str) -> None:
        x = unit(keys, len(basis), kind)
        box = x @ basis[:, :BOX_DIMS]
        order = np.lexsort((*np.floor(box[:, : min(8, box.shape[1])] / eps).T[::-1],)) if len(x) else np.empty(0, int)
        self.x, self.box, self.keys, self.kind = x[order], box[order], [keys[i] for i in order], kind
        self.ids, self.times = ids[order], times[order]
        self.links = np.zeros(len(ids), np.int64)


def join_blocks(a: Side, b: Side, threshold: float, eps: float) -> list[tuple[int, int]]:
    """Adds up each vector's linked multiplicities and returns links that span the components."""
    same = a is b
    parent = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    spanning: list[tuple[int, int]] = []
    work = [(0, len(a.x), 0, len(b.x))]
    while work:
        i, j, k, m = work.pop()
        if i >= j or k >= m or same and m <= i:
            continue
        gap = np.maximum(0, np.maximum(a.box[i:j].min(0) - b.box[k:m].max(0), b.box[k:m].min(0) - a.box[i:j].max(0)))
        if float(gap @ gap) > eps * eps + MARGIN:
            continue
        if j - i > LEAF or m - k > LEAF:
            h, g = (i + j) // 2, (k + m) // 2
            work += [(i, h, k, g), (i, h, g, m), (h, j, k, g), (h, j, g, m)]
            continue
        cos = a.x[i:j] @ b.x[k:m].T
        p, q = np.nonzero(cos >= threshold - MARGIN)
        for s, t in zip(p.tolist(), q.tolist()):
            u, v = i + s, k + t
            if same and v <= u or cos[s, t] < threshold + MARGIN and not exact_link(a.keys[u], b.keys[v], threshold, a.kind):
                continue
            a.links[u] += b.times[v]
            b.links[v] += a.times[u]
            x, y = root(int(a.ids[u])), root(int(b.ids[v]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                spanning.append((int(a.ids[u]), int(b.ids[v])))
    return spanning


def linked(classes: DataFrame, dims: int, threshold: float, block: int, kind: str) -> DataFrame:
    """classes (id, key, n) -> rows (a, b, n): with b null, n more vectors link with class a; else a link."""
    spark = classes.sparkSession
    basis, eps = principal(classes, dims, kind), math.sqrt(2 - 2 * threshold)
    shared = spark.sparkContext.broadcast(basis)
    depth, wide = min(GRID_DIMS, dims), min(BOX_DIMS, dims)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            box = unit(b.column("key").to_pylist(), dims, kind) @ shared.value[:, :wide]
            cells = np.floor(box[:, :depth] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.tolist(), pa.list_(pa.int32())), pa.array(box.tolist(), pa.list_(pa.float64()))], ["id", "key", "n", "cell", "box"])

    placed = materialise(classes.select("id", "key", "n").mapInArrow(to_cells, "id long, key binary, n long, cell array<int>, box array<double>"), "cells")
    # At most (2 / eps + 2) ** depth cells: a small table whatever the number of vectors.
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    cells = materialise(sizes.withColumn("before", F.sum("size").over(Window.orderBy("cell")) - F.col("size")), "sizes")
    at = lambda place: F.floor(place / block).cast("int")
    own = placed.join(cells, "cell").withColumn("block", at(F.col("before") + F.pmod(F.xxhash64("id"), F.col("size"))))

    runs = cells.select("cell", F.explode(F.sequence(at(F.col("before")), at(F.col("before") + F.col("size") - 1))).alias("block"))
    moves = runs.select("cell", "block", F.array().cast("array<int>").alias("to"))
    for d in range(depth):
        moves = moves.withColumn("step", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("to", F.concat("to", F.array(F.get("cell", F.lit(d)) + F.col("step")))).drop("step")
    touching = moves.join(runs.select(F.col("cell").alias("to"), F.col("block").alias("y")), "to").where("block <= y").select(F.col("block").alias("x"), "y").distinct()

    edge = lambda f, i: f(F.get("box", F.lit(i)))
    boxes = own.groupBy("block").agg(F.array(*[edge(F.min, i) for i in range(wide)]).alias("low"), F.array(*[edge(F.max, i) for i in range(wide)]).alias("high"))
    boxes = materialise(boxes, "boxes")
    side = lambda c: boxes.select(F.col("block").alias(c), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
    gap = lambda p, q: F.greatest(p - q, F.lit(0.0))
    apart = F.zip_with(F.arrays_zip("x_low", "x_high"), F.arrays_zip("y_low", "y_high"), lambda a, b: F.pow(F.greatest(gap(a["x_low"], b["y_high"]), gap(b["y_low"], a["x_high"])), F.lit(2)))
    near = F.aggregate(apart, F.lit(0.0), lambda a, d: a + d) <= eps * eps + MARGIN
    pairs = materialise(touching.join(side("x"), "x").join(side("y"), "y").where(near).select("x", "y"), "touching")

    roles = pairs.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("late"))
    roles = roles.withColumn("block", F.when(F.col("late"), F.col("y")).otherwise(F.col("x")))
    rows = own.select("block", "id", "key", "n").join(roles, "block").groupBy("x", "y").agg(F.collect_list(F.struct("late", "id", "key", "n")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for both, found in zip(b.column("both").to_pylist(), b.column("entries")):
                late, ids, keys, times = found.values.flatten()
                late, ids, times = (x.to_numpy(zero_copy_only=False) for x in (late, ids, times))
                part = lambda which: Side(ids[which], [keys[i].as_py() for i in which.tolist()], times[which], shared.value, eps, kind)
                first = part(np.flatnonzero(~late))
                second = part(np.flatnonzero(late)) if both else first
                spanning = join_blocks(first, second, threshold, eps)
                counts = [(int(i), None, int(n)) for s in ((first, second) if both else (first,)) for i, n in zip(s.ids, s.links) if n]
                out = counts + [(i, j, 0) for i, j in spanning]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["a", "b", "n"])

    found = materialise(rows.select((F.col("x") != F.col("y")).alias("both"), "entries").mapInArrow(run, "a long, b long, n long"), "links")
    release(placed, cells, boxes, pairs)
    return found


def neighbours(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as
    does a row without an id; vectors of unequal length are compared as if ended by zeros. Equal
    vectors link with each other; rows that repeat a vec_id count as vectors of their own. Other
    columns are not read, an empty table gives none.
    """
    bound_batches(vectors.sparkSession)
    # Single precision travels as such: it is exact, and half as long.
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    rows = materialise(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(usable(kind), "vec_id long, key binary"), "vectors")
    classes = materialise(rows.where("vec_id is not null and key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    size = np.dtype(kind).itemsize
    dims = (classes.agg(F.max(F.octet_length("key"))).first()[0] or size) // size
    found = linked(classes, dims, threshold, block, kind)
    roots = connected(found.where("b is not null").select("a", "b"))
    degrees = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    by_class = classes.join(roots, classes["id"] == roots["node"], "left").join(degrees, classes["id"] == degrees["a"], "left")
    by_key = materialise(by_class.select("key", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "by_key")
    release(classes, found)
    keyed = rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key"))).join(by_key, "key", "left")
    component = F.coalesce("root", "vec_id")
    return keyed.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
