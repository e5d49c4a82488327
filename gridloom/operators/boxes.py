"""Boxes that meet boxes, by a partitioning of the plane that is learnt from both sides.

A patch is dealt once, by its lower left corner. A scene goes to every part where the corner of a patch that meets it
may lie: its box, grown to the left and downwards by the extent of the patches. So a pair meets in one part only, and
there is no distinct and no owner test. Patches of very different extents are classes of their own, lest one large patch
should grow all scenes.

The parts are the leaves of a k-d tree over the corners. A node is cut where that saves more comparisons than it costs
copies of scenes, as counted on a bounded sample of both sides; cells so follow the density of patches and the extent of
scenes. What is crowded beyond a bound all the same (many patches at one place, many scenes above it) is dealt by
hashes of its larger side, the smaller one is copied; numbers of rows are counted over all rows for that, not estimated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Comparisons of patches with scenes that one partition of the join makes.
MOST_COMPARED = 20_000_000
#: Rows of either side on which the tree is learnt, its leaves at most, and how many comparisons a copied scene is worth.
SAMPLE = 20_000
MOST_LEAVES = 4096
COPY_COST = 40.0
#: Scenes that pass the patches of a part at first, and comparisons of a step later on, in ``first_items``.
FIRST_STEP, STEP_COMPARED = 64, 1 << 20
#: Extents within a factor of 4 are one class; from 2^-20 up.
CLASS_BITS, LEAST_EXTENT = 2, 2.0**-20


class Tree:
    """A k-d tree in arrays: ``axis`` (-1: a leaf), ``value``, ``left`` and ``right``; leaves are numbered by their nodes."""

    def __init__(self, corners: np.ndarray, boxes: np.ndarray, weight: float, most_leaves: int = MOST_LEAVES) -> None:
        """``corners`` (n, 2) of sampled patches, ``boxes`` (m, 4) of sampled scenes, grown; ``weight``: comparisons that a sampled pair
        stands for, by the copies that a sampled scene stands for."""
        self.axis, self.value, self.left, self.right = [-1], [0.0], [0], [0]
        open_, leaves = [(0, np.arange(len(corners)), np.arange(len(boxes)))], 1
        while open_ and leaves < most_leaves:
            node, p, b = open_.pop(0)
            best = None
            for axis in (0, 1):
                x = np.sort(corners[p, axis])
                value = float(x[len(x) // 2]) if len(x) else 0.0
                if not len(x) or x[0] == value:
                    continue
                left, right = boxes[b, axis] < value, boxes[b, axis + 2] >= value
                n = int((corners[p, axis] < value).sum())
                cost = weight * (n * left.sum() + (len(p) - n) * right.sum()) + COPY_COST * (left.sum() + right.sum())
                if best is None or cost < best[0]:
                    best = (cost, axis, value, left, right)
            if best is None or best[0] >= weight * len(p) * len(b) + COPY_COST * len(b):
                continue
            _, axis, value, left, right = best
            here = corners[p, axis] < value
            for side, q, c in ((self.left, p[here], b[left]), (self.right, p[~here], b[right])):
                side[node] = len(self.axis)
                open_.append((len(self.axis), q, c))
                for column, start in ((self.axis, -1), (self.value, 0.0), (self.left, 0), (self.right, 0)):
                    column.append(start)
            self.axis[node], self.value[node] = axis, value
            leaves += 1

    def leaves_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that the boxes from ``low`` to ``high`` (n, 2) touch, by row."""
        rows, leaves, open_ = [], [], [(0, np.arange(len(low)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            axis = self.axis[node]
            if axis < 0:
                rows.append(at)
                leaves.append(np.full(len(at), node, np.int32))
                continue
            value = self.value[node]
            open_ += [(self.left[node], at[low[at, axis] < value]), (self.right[node], at[high[at, axis] >= value])]
        row, leaf = (np.concatenate([np.zeros(0, k), *v]) for k, v in ((np.int64, rows), (np.int32, leaves)))
        order = np.argsort(row, kind="stable")
        return row[order], leaf[order]


def _leaves(tree: Tree):
    @F.arrow_udf(ArrayType(IntegerType()))
    def leaves(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        low, high = (np.stack([v.to_numpy(zero_copy_only=False) for v in side], 1) for side in ((x0, y0), (x1, y1)))
        row, leaf = tree.leaves_of(low, high)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(low) + 1)).astype(np.int32)), pa.array(leaf))

    return leaves


def _flat(rows: DataFrame, name: str, prefix: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """The id, four sides of whole boxes and the ``carried`` columns; other boxes meet nothing."""
    sides = [F.get("bbox", F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(4)]
    known = F.lit(True)
    for i in range(4):
        known = known & F.col(f"{prefix}{i}").isNotNull() & ~F.isnan(f"{prefix}{i}")
    return rows.where(F.size("bbox") == 4).select(name, *sides, *carried).where(known)


def _class(width: Column, height: Column) -> Column:
    return F.ceil(F.log2(F.greatest(width, height, F.lit(LEAST_EXTENT))) / CLASS_BITS).cast("int")


class Matching:
    """Both sides dealt to the leaves, and how: ``parts`` has a row per leaf and class with the scenes and patches that meet there and
    how many partitions share them. ``carried``: columns of the scenes that go with them."""

    def __init__(self, patches: DataFrame, items: DataFrame, most: int, carried: tuple[str, ...] = ()) -> None:
        p, i = _flat(patches, "patch_id", "p"), _flat(items, "item_id", "i", carried)
        p = p.withColumn("class", _class(F.col("p2") - F.col("p0"), F.col("p3") - F.col("p1")))
        # A row per class of extents, about 20 at most.
        reach = [f(c).alias(n) for n, f, c in (("x0", F.min, "p0"), ("y0", F.min, "p1"), ("x1", F.max, "p0"), ("y1", F.max, "p1"))]
        extents = p.groupBy("class").agg(F.max(F.col("p2") - F.col("p0")).alias("w"), F.max(F.col("p3") - F.col("p1")).alias("h"), *reach, F.count(F.lit(1)).alias("n")).collect()
        named = ("class", "w", "h", "x0", "y0", "x1", "y1")
        classes = [F.struct(*[F.lit(r[c]).alias(c) for c in named]) for r in extents]
        kind = f"array<struct<class: int, {', '.join(f'{c}: double' for c in named[1:])}>>"
        i = i.withColumn("c", F.explode(F.array(*classes).cast(kind))).withColumns({"x": F.col("i0") - F.col("c.w"), "y": F.col("i1") - F.col("c.h")})
        # A scene beyond the corners of a class meets none of its patches.
        i = i.where((F.col("x") <= F.col("c.x1")) & (F.col("i2") >= F.col("c.x0")) & (F.col("y") <= F.col("c.y1")) & (F.col("i3") >= F.col("c.y0")))
        i = i.select("item_id", "c.class", *carried, *[f"i{k}" for k in range(4)], "x", "y")
        sample = lambda df, key, names: df.orderBy(F.xxhash64(key)).limit(SAMPLE).select(*names).toPandas().to_numpy(float)
        corners, boxes = sample(p, "patch_id", ["p0", "p1"]), sample(i, "item_id", ["x", "y", "i2", "i3"])
        self.tree = Tree(corners, boxes, sum(r["n"] for r in extents) / max(1, len(corners)))
        leaves = _leaves(self.tree)
        self.p = p.withColumn("leaf", F.explode(leaves("p0", "p1", "p0", "p1")))
        self.i = i.withColumn("leaf", F.explode(leaves("x", "y", "i2", "i3")))
        counted = lambda df, name: df.groupBy("leaf", "class").agg(F.count(F.lit(1)).alias(name))
        both = counted(self.p, "patches").join(counted(self.i, "items"), ["leaf", "class"])
        self.parts = both.withColumn("shares", F.ceil(F.col("patches") * F.col("items") / most).cast("int"))
        self.most = most

    def pairs(self) -> DataFrame:
        return self._met(*self.dealt())

    def dealt(self) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides and the columns in which those that meet agree."""
        if self.parts.where("shares > 1").isEmpty():
            return self.p, self.i, ["leaf", "class"]
        crowded = F.broadcast(self.parts.where("shares > 1").select("leaf", "class", "shares", (F.col("items") >= F.col("patches")).alias("deal_items")))

        def dealt(df: DataFrame, name: str, own: Column) -> DataFrame:
            """Rows of crowded leaves with the share that their hash says, or once for each share."""
            part = F.when(F.col("shares").isNull(), F.array(F.lit(0))).when(own, F.array(F.pmod(F.xxhash64(name), F.col("shares")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("shares") - 1))
            return df.join(crowded, ["leaf", "class"], "left").withColumn("part", F.explode(part)).drop("shares", "deal_items")

        left, right = dealt(self.p, "patch_id", ~F.col("deal_items")), dealt(self.i, "item_id", F.col("deal_items"))
        return left, right, ["leaf", "class", "part"]

    def _met(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        meets = (F.col("p0") < F.col("i2")) & (F.col("p2") > F.col("i0")) & (F.col("p1") < F.col("i3")) & (F.col("p3") > F.col("i1"))
        return left.join(right, keys).where(meets).select("patch_id", "item_id")


def match_items(patches: DataFrame, items: DataFrame, dense: int = MOST_COMPARED) -> DataFrame:
    """(patch_id, item_id): boxes [west, south, east, north] that intersect strictly, each pair of rows once.

    ``dense``: comparisons that a partition makes at most. Boxes that are null, not of four numbers or hold a null or NaN meet nothing.
    """
    return Matching(patches, items, dense).pairs()


def first_items(patches: DataFrame, items: DataFrame, order: list[str], limit: int, dense: int = MOST_COMPARED) -> DataFrame:
    """(patch_id, item_id, order...): of the scenes that each patch meets, the first ``limit`` by the columns ``order`` and the id.

    The pairs are not made. The scenes of a part of the plane pass its patches in that order, and a patch that has met
    ``limit`` of them leaves; a task holds the patches of one part and a batch of scenes. Where a part is shared out by its
    scenes, each share has its own first ones.
    """
    matching = Matching(patches, items, dense, tuple(order))
    left, right, keys = matching.dealt()
    sides, none = [f"s{k}" for k in range(4)], lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    p = left.select(*keys, F.lit(False).alias("scene"), *[F.col(f"p{k}").alias(f"s{k}") for k in range(4)], "patch_id", none(right, "item_id"), *[none(right, c) for c in order])
    i = right.select(*keys, F.lit(True).alias("scene"), *[F.col(f"i{k}").alias(f"s{k}") for k in range(4)], none(left, "patch_id"), "item_id", *order)
    # A given number of partitions: few bytes are much work here, which is not to end up in one task.
    parts = int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = p.unionByName(i).repartition(parts, *keys).sortWithinPartitions(*keys, "scene", *order, "item_id")
    out = rows.select("patch_id", "item_id", *order)
    return rows.mapInArrow(_scan(keys, sides, order, limit), out.schema)


def _scan(keys: list[str], sides: list[str], order: list[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, need = None, [], None, np.zeros(0, int)
        box = np.zeros((0, 4))
        for b in batches:
            if not b.num_rows:
                continue
            places = np.stack([b.column(k).to_numpy() for k in keys] + [b.column("scene").to_numpy(zero_copy_only=False)], 1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1).tolist(), len(places)]
            for start, stop in zip(cuts, cuts[1:]):
                here, part = tuple(places[start, :-1]), b.slice(start, stop - start)
                if here != at:
                    at, held, ids = here, [], None
                if not places[start, -1]:
                    held.append(part.select(["patch_id", *sides]))
                    continue
                if ids is None:
                    known = pa.Table.from_batches(held).combine_chunks() if held else None
                    ids, held = (known.column("patch_id").combine_chunks() if known else []), []
                    box = np.stack([known.column(s).to_numpy() for s in sides], 1) if known else np.zeros((0, 4))
                    left, need = np.arange(len(box)), np.full(len(box), limit)
                scenes, step, done = np.stack([part.column(s).to_numpy() for s in sides], 1), FIRST_STEP, 0
                while done < len(scenes) and len(left):
                    s, p = scenes[done : done + step].T, box[left].T[:, :, None]
                    meets = (p[0] < s[2]) & (p[2] > s[0]) & (p[1] < s[3]) & (p[3] > s[1])
                    row, col = np.nonzero(meets & (np.cumsum(meets, 1) <= need[left][:, None]))
                    if len(row):
                        need -= np.bincount(left[row], minlength=len(need))
                        found = part.take(pa.array(done + col))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(left[row])), *[found.column(c) for c in ("item_id", *order)]], ["patch_id", "item_id", *order])
                        left = left[need[left] > 0]
                    done += step
                    # As many scenes next as keep the comparisons of a step at one size.
                    step = max(FIRST_STEP, STEP_COMPARED // max(1, len(left)))

    return run


def match_report(patches: DataFrame, items: DataFrame, dense: int = MOST_COMPARED) -> DataFrame:
    """(leaf, class, patches, items, shares): what meets in each part of the plane, and in how many shares."""
    return Matching(patches, items, dense).parts
