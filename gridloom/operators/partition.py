"""Equal-capacity spatial shards by recursive cuts at exact ranks."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranking import exact_rank, settled


def capacities(n: int, shards: int) -> list[int]:
    """n dealt evenly; the remainder goes to the last shards."""
    low, rest = divmod(n, shards)
    return [low + (i >= shards - rest) for i in range(shards)]


#: Bins of all nodes that one pass counts, and rows that are put in order on the driver at the end of a search.
MOST_BINS = 1 << 16
MOST_LISTED = 20_000


@dataclass
class Node:
    """Shards ``first`` to ``last`` (exclusive) of the cut, the box left for them, and which axes the cuts above went along."""

    first: int
    last: int
    box: tuple[float, float, float, float]
    above: frozenset[str] = frozenset()
    #: Once cut: the first row that goes right (axis value, other axis value or null, key), and the children.
    axis: str = ""
    at: tuple = ()
    children: tuple[Node, Node] | None = None

    def order(self) -> list[str]:
        """Rows are cut in order of the longer side's axis; equal ones as a cut above has put them, which is by the other axis if one went along it, then by the key."""
        x0, x1, y0, y1 = self.box
        axis = "x" if x1 - x0 >= y1 - y0 else "y"
        other = "y" if axis == "x" else "x"
        return [axis, other] if other in self.above else [axis]


def _leaf_of(node: Node, key: str, value) -> Column:
    """``value(leaf)`` of the leaf that a row comes to, as one expression of x, y and the key."""
    if node.children is None:
        return value(node)
    named = [*node.order(), key]
    ahead = F.lit(False)
    for c, limit in reversed(list(zip(named, node.at))):
        ahead = (F.col(c) < F.lit(limit)) | ((F.col(c) == F.lit(limit)) & ahead)
    return F.when(ahead, _leaf_of(node.children[0], key, value)).otherwise(_leaf_of(node.children[1], key, value))


@dataclass
class Search:
    """The row of a ``rank`` among the rows of a node: values found so far, and the range that the next one lies in."""

    node: int
    order: list[str]
    rank: int
    found: list[float]
    low: float
    high: float


def _within(rows: DataFrame, searches: dict[int, Search]) -> DataFrame:
    """Rows in the range of each search, with ``search`` and the value ``v`` that it looks for."""
    table = [(i, s.node, s.order[len(s.found)] == "x", s.found[0] if s.found else None, s.low, s.high) for i, s in searches.items()]
    names = {"search": pa.int32(), "node": pa.int32(), "of_x": pa.bool_(), "fixed": pa.float64(), "low": pa.float64(), "high": pa.float64()}
    plan = rows.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*table), names.values())], list(names)))
    v, w = (F.when(F.col("of_x") == t, F.col("x")).otherwise(F.col("y")) for t in (True, False))
    near = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")) & (F.col("fixed").isNull() | (w == F.col("fixed")))
    return rows.join(F.broadcast(plan), "node").withColumn("v", v).where(near)


def _refined(rows: DataFrame, searches: list[Search]) -> list[int]:
    """One pass over the rows counts bins for all searches; each goes on into the bin that has its rank. Returns how many rows are left for each."""
    bins = max(2, MOST_BINS // len(searches))
    here = _within(rows, dict(enumerate(searches)))
    span = F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    counted = here.groupBy("search", F.least(F.floor(span * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    got: dict[int, list] = {}
    for r in counted.orderBy("search", "bin").collect():  # MOST_BINS at most
        got.setdefault(r["search"], []).append(r)
    left = []
    for i, s in enumerate(searches):
        for r in got[i]:
            if s.rank < r["n"]:
                s.low, s.high = r["a"], r["b"]
                left.append(r["n"])
                break
            s.rank -= r["n"]
    return left


def _selected(rows: DataFrame, key: str, searches: list[Search], whole: tuple[float, float, float, float]) -> list[tuple]:
    """(values in order..., key) of each search's row. Rows are not moved: passes count bins until few rows are left, and these are listed;
    only where very many rows share all values are just those ranked by their key."""
    out: dict[int, tuple] = {}
    open_ = list(range(len(searches)))
    while open_:
        left = _refined(rows, [searches[i] for i in open_])
        few = [i for i, n in zip(open_, left) if n <= MOST_LISTED // len(searches)]
        if few:
            listed: dict[int, list[tuple]] = {}
            for r in _within(rows, {i: searches[i] for i in few}).select("search", "x", "y", key).collect():
                s = searches[r["search"]]
                listed.setdefault(r["search"], []).append((*[r[c] for c in s.order], r[key]))
            for i in few:
                out[i] = sorted(listed[i])[searches[i].rank]
        for i in open_:
            s = searches[i]
            if i in out or s.low < s.high:
                continue
            s.found.append(s.low)
            if len(s.found) < len(s.order):
                axis = 0 if s.order[1] == "x" else 2
                s.low, s.high = whole[axis], whole[axis + 1]
                continue
            same = rows.where(F.col("node") == s.node)
            for c, value in zip(s.order, s.found):
                same = same.where(F.col(c) == value)
            out[i] = (*s.found, exact_rank(same.select(key), [F.col(key)]).where(F.col("rank") == s.rank).first()[key])
        open_ = [i for i in open_ if i not in out]
    return [out[i] for i in range(len(searches))]


def equal_capacity(points: DataFrame, sizes: list[int], key: str = "parent_key", buckets: int | None = None) -> DataFrame:
    """Adds ``shard_id``: each shard gets exactly its size, shards are numbered from 1, depth first.

    A node with several shards is cut across the longer side of its bounds at the rank that fills
    its left half of shards; bounds follow the cuts (half-way between the neighbours), only the root
    uses the data's. Equal rows stay in the order of the cut above, first in that of the key, which must be unique.

    The rows are written once and never moved: each round finds the rows at the ranks of all its cuts by counting bins
    (``_selected``), and a row's shard is an expression of its x, y and key. A node's table is a row for each shard at most.
    """
    rows = settled(points)
    box = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if sum(sizes) != box[4]:
        raise ValueError("capacities do not add up to the number of points")
    whole = tuple(box)[:4]
    root = Node(0, len(sizes), whole)
    leaves = [root]
    while cut := [n for n in leaves if n.last - n.first > 1 and sum(sizes[n.first : n.last])]:
        place = {id(n): i for i, n in enumerate(cut)}
        narrow = rows.select("x", "y", key, _leaf_of(root, key, lambda n: F.lit(place.get(id(n), -1))).alias("node")).where("node >= 0")
        searches = []
        for i, n in enumerate(cut):
            left, order = sum(sizes[n.first : n.first + (n.last - n.first) // 2]), n.order()
            low, high = whole[:2] if order[0] == "x" else whole[2:]
            total = sum(sizes[n.first : n.last])
            searches += [Search(i, order, min(max(rank, 0), total - 1), [], low, high) for rank in (left - 1, left)]
        found = _selected(narrow, key, searches, whole)
        leaves = [n for n in leaves if id(n) not in place]
        for i, n in enumerate(cut):
            half, (last, first) = n.first + (n.last - n.first) // 2, found[2 * i : 2 * i + 2]
            left, total = sum(sizes[n.first : half]), sum(sizes[n.first : n.last])
            order, (x0, x1, y0, y1) = n.order(), n.box
            at = (last[0] + first[0]) / 2 if 0 < left < total else (x0 if order[0] == "x" else y0)
            low, high = ((x0, at, y0, y1), (at, x1, y0, y1)) if order[0] == "x" else ((x0, x1, y0, at), (x0, x1, at, y1))
            above = n.above | {order[0]}
            n.axis, n.at, n.children = order[0], first, (Node(n.first, half, low, above), Node(half, n.last, high, above))
            if left == total:  # nothing goes right
                n.children = (n.children[0], n.children[0])
                leaves.append(n.children[0])
            elif left == 0:
                n.children = (n.children[1], n.children[1])
                leaves.append(n.children[1])
            else:
                leaves += n.children
    return rows.withColumn("shard_id", _leaf_of(root, key, lambda n: F.lit(next((i + 1 for i in range(n.first, n.last) if sizes[i]), n.first + 1))).cast("int"))


def relabelled(rows: DataFrame, new_ids: dict[int, int]) -> DataFrame:
    """shard_id replaced by a permutation of the ids; the old one stays as source_shard_id."""
    if sorted(new_ids) != sorted(new_ids.values()):
        raise ValueError("not a permutation")
    ids = F.create_map(*[F.lit(x) for kv in new_ids.items() for x in kv])
    return rows.withColumn("source_shard_id", F.col("shard_id")).withColumn("shard_id", ids[F.col("shard_id")].cast("int"))


def shard_summary(rows: DataFrame) -> DataFrame:
    """Per shard: count, mean and range of longitude and latitude, and counts by grid as a map."""
    by_grid = rows.groupBy("shard_id", "grid_id").agg(F.count(F.lit(1)).alias("n"))
    maps = by_grid.groupBy("shard_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grid_id", "n")))).alias("counts_by_grid_id"))
    stats = rows.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("shape_count"), F.avg("longitude").alias("mean_longitude"), F.avg("latitude").alias("mean_latitude"), *[f(c).alias(f"{n}_{c}") for c in ("longitude", "latitude") for n, f in (("min", F.min), ("max", F.max))]
    )
    return stats.join(maps, "shard_id")


def bbox_feature(west: Column, south: Column, east: Column, north: Column, properties: Column) -> Column:
    """GeoJSON text of a closed box."""
    ring = F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))


def outline_edges(cells: DataFrame, by: list[str]) -> DataFrame:
    """Edges (x1, y1, x2, y2) of the outline of each group of lattice cells: those of one cell only."""
    c, r = F.col("col").cast("long"), F.col("row").cast("long")
    edge = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    edges = F.array(edge(c, r, c + 1, r), edge(c, r + 1, c + 1, r + 1), edge(c, r, c, r + 1), edge(c + 1, r, c + 1, r + 1))
    rows = cells.select(*by, F.explode(edges).alias("e")).select(*by, "e.*")
    return rows.groupBy(*by, "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def dissolved(cells: DataFrame, by: list[str], side: int = 1280) -> DataFrame:
    """(by..., cells, area, perimeter) of each group's exact outline, concave shapes and holes kept."""
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"))
    lines = outline_edges(cells, by).groupBy(*by).agg((F.count(F.lit(1)) * side).alias("perimeter"))
    area = (F.col("cells") * side * side).alias("area")
    return (sizes.join(lines, by) if by else sizes.crossJoin(lines)).select(*by, "cells", area, "perimeter")


def self_touching(cells: DataFrame, by: list[str]) -> DataFrame:
    """Corners where an outline meets itself: four outline edges end there."""
    ends = outline_edges(cells, by).select(*by, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v"))
    return ends.groupBy(*by, F.col("v.x").alias("x"), F.col("v.y").alias("y")).agg(F.count(F.lit(1)).alias("degree")).where("degree = 4")
