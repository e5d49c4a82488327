"""Exact top-k search by inner product in an M-tree that lies in pages of a table.

Vectors are quantised to integers. One more coordinate, sqrt(M^2 - |x|^2) with M the greatest length, puts all on
one sphere: for a query q (0 there) the distance is sqrt(|q|^2 + M^2 - 2 q.x), a metric in which nearest means
greatest product. Scores themselves are integer products, never distances.

The tree has four levels. Routing objects of the two upper ones are fitted on a bounded sample and their number has
a bound; every vector descends to the nearest of either. What meets at a lower one is cut into pages, rows of a
written table, however many there are; a page holds nodes, a node up to NODE vectors. Nodes and pages store their
routing object, covering radius and the distance to their parent, vectors the distance to their node's object.

Queries first search the page that they lie in; the k-th score found there bounds the search for the rest. Then they
are sent to all tasks in waves of bounded size, and each task goes through the nodes of its pages best first:
a node's bound is how near its vectors may be, and nodes, then vectors, are left out by the distances to the
parents that are stored before any new distance is computed, so the triangle inequality saves the work. A task
gives at most k rows a query, and only such as reach the bound; the best k of these are the answer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches, materialise, release

SCALE = 256
K = 5
EVERY = 50
#: Vectors of a node, and bytes of a page (at most 4,096 vectors).
NODE = 64
PAGE_BYTES = 1 << 20
#: Rows of the sample on which routing objects are fitted (by hash), and the bytes that sample, objects and a wave of queries may hold.
SAMPLE = 16_384
SENT_BYTES = 16 << 20
#: Queries that go through the nodes together.
TOGETHER = 256
#: Products below this are exact in double precision, in any order of summation.
EXACT = 2.0**52
#: What rounding may add to a distance, relative to the radius of the sphere.
SLACK = 1e-6
LONG = (-(2**63), 2**63 - 1)


def quantised(kind: str):
    """(vec_id, asks, embedding) -> (vec_id, asks, key, norm2): floor(SCALE * x) as ``kind``; no row for what takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, keys, norms = [], [], []
            for i, v in enumerate(b.column("embedding").to_pylist()):
                if v is None or any(c is None for c in v):
                    continue
                x = np.floor(SCALE * np.array(v, np.float64))
                if math.isfinite(norm2 := float(x @ x)):
                    kept.append(i)
                    keys.append(x.astype(kind).tobytes())
                    norms.append(norm2)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("asks").take(at), pa.array(keys, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "asks", "key", "norm2"])

    return run


class Space:
    """What all tasks know: element kind, dimensions, radius of the sphere."""

    def __init__(self, kind: str, dims: int, norm2: float) -> None:
        self.kind, self.dims, self.norm2 = kind, dims, norm2
        self.slack = SLACK * math.sqrt(norm2) + 1e-9

    def vectors(self, keys: list[bytes]) -> np.ndarray:
        """Rows of integers in double precision; shorter vectors end in zeros."""
        width = self.dims * np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), self.kind).reshape(len(keys), self.dims).astype(np.float64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.norm2 - np.einsum("ij,ij->i", x, x)))[:, None]])

    def far(self, score: np.ndarray, q2: np.ndarray) -> np.ndarray:
        """Distance beyond which no vector has ``score``; infinite for no score yet."""
        return np.sqrt(np.maximum(0.0, q2 + self.norm2 - 2 * score)) + self.slack


def at_most(score: int) -> float:
    """The greatest double that is not above ``score``."""
    near = float(score)
    return near if int(near) <= score else math.nextafter(near, -math.inf)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def nearest(x: np.ndarray, objects: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest object and the distance, which is computed from differences so that equal vectors are at 0."""
    at = np.argmin(distances(x, objects), axis=1)
    return at, np.sqrt(((x - objects[at]) ** 2).sum(1))


def _centres(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """``n`` routing objects for ``x`` by a few rounds of means from evenly drawn rows."""
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds if n > 1 else 1):
        at, _ = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.bincount(at, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


class Routes:
    """Routing objects of the two upper levels: ``top``, and ``low[i]`` below top i, numbered from ``first[i]``."""

    def __init__(self, sample: np.ndarray, pages: int) -> None:
        self.top = _centres(sample, max(1, round(math.sqrt(pages))))
        at, _ = nearest(sample, self.top)
        share = np.bincount(at, minlength=len(self.top)) / max(1, len(sample))
        self.low = [_centres(sample[at == i], max(1, round(pages * share[i]))) if share[i] else self.top[i : i + 1] for i in range(len(self.top))]
        self.first = np.cumsum([0, *map(len, self.low)])
        self.all = np.vstack(self.low)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Number of the lower routing object that each row comes to."""
        at, _ = nearest(x, self.top)
        out = np.zeros(len(x), np.int64)
        for i in np.unique(at):
            rows = np.flatnonzero(at == i)
            out[rows] = nearest(x[rows], self.low[i])[0] + self.first[i]
        return out


#: One page as a row: vectors by node and, within, by distance to its object; ``ends`` of the nodes.
PAGE = "route long, ids binary, keys binary, apart binary, ends binary, objects binary, radii binary, parents binary"


def to_page(space: Space, objects: np.ndarray, route: int, ids: np.ndarray, keys: list[bytes]) -> tuple:
    """A page's row: nodes by one more descent among some of its own vectors."""
    x = space.vectors(keys)
    lifted = space.lifted(x)
    centres = _centres(lifted, -(-len(x) // NODE), rounds=2)
    at, apart = nearest(lifted, centres)
    # A node that many equal vectors share is cut as any other.
    order = np.lexsort((ids, apart, at))
    at, apart = at[order], apart[order]
    cuts = [0]
    for node in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
        cuts += [min(int(node[0]) + i + NODE, int(node[-1]) + 1) for i in range(0, len(node), NODE)]
    ends = np.array(cuts, np.int64)
    own = centres[at[ends[:-1]]]
    radii = np.array([apart[i:j].max() for i, j in zip(ends[:-1], ends[1:])])
    parents = np.sqrt(((own - objects[route]) ** 2).sum(1))
    raw = b"".join(x[order].astype(space.kind))
    return (route, ids[order].astype("<i8").tobytes(), raw, apart.astype("<f8").tobytes(), ends.astype("<i8").tobytes(), own.astype("<f8").tobytes(), radii.astype("<f8").tobytes(), parents.astype("<f8").tobytes())


NAMES = [f.split()[0] for f in PAGE.split(", ")]


class Pages:
    """The nodes of some pages, ready to be searched."""

    def __init__(self, space: Space, rows: list[dict]) -> None:
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        self.ids, self.apart = read("ids", "<i8"), read("apart", "<f8")
        self.x = read("keys", space.kind).reshape(-1, space.dims).astype(np.float64)
        self.objects = read("objects", "<f8").reshape(-1, space.dims + 1)
        self.radii, self.parents = read("radii", "<f8"), read("parents", "<f8")
        ends = [np.frombuffer(r["ends"], "<i8") for r in rows]
        base = np.cumsum([0, *[e[-1] for e in ends]])
        self.first = np.concatenate([e[:-1] + b for e, b in zip(ends, base)])
        self.last = np.concatenate([e[1:] + b for e, b in zip(ends, base)])
        self.route = np.repeat([r["route"] for r in rows], [len(e) - 1 for e in ends])


class Search:
    """Queries and the best that each has found so far: heaps of (score, -id), worst first."""

    def __init__(self, space: Space, ids: np.ndarray, keys: list[bytes], bounds: list[int | None], k: int) -> None:
        self.space, self.ids, self.k = space, ids, k
        self.x = space.vectors(keys)
        self.q2 = np.einsum("ij,ij->i", self.x, self.x)
        self.lifted = np.hstack([self.x, np.zeros((len(keys), 1))])
        #: Scores below a query's bound are not wanted; -inf until k are known.
        self.bound = np.array([-math.inf if b is None else at_most(b) for b in bounds])
        self.best: list[list[tuple[int, int]]] = [[] for _ in keys]
        self.computed = 0

    def _scores(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        self.computed += len(rows) * len(x)
        if self.space.norm2 < EXACT:
            return self.x[rows] @ x.T
        whole = np.frompyfunc(int, 1, 1)
        return np.clip(whole(self.x[rows]).dot(whole(x).T), *LONG)

    def _offer(self, q: int, score: int, i: int) -> None:
        best = self.best[q]
        if len(best) < self.k:
            heapq.heappush(best, (score, -i))
        elif (score, -i) > best[0]:
            heapq.heapreplace(best, (score, -i))
        if len(best) == self.k:
            self.bound[q] = max(self.bound[q], at_most(best[0][0]))

    def visit(self, pages: Pages, objects: np.ndarray, part: np.ndarray) -> None:
        """Goes through the nodes for queries ``part``, those that may hold the nearest vectors first."""
        space = self.space
        far = space.far(self.bound[part], self.q2[part])
        used, at = np.unique(pages.route, return_inverse=True)
        self.computed += len(part) * len(used)
        to_parent = distances(self.lifted[part], objects[used])[:, at]
        # What the stored distances say without a new one.
        near = np.abs(to_parent - pages.parents) - pages.radii
        open_ = np.flatnonzero((near <= far[:, None]).any(0))
        if not len(open_):
            return
        self.computed += len(part) * len(open_)
        to_node = distances(self.lifted[part], pages.objects[open_])
        near = np.maximum(near[:, open_], to_node - pages.radii[open_])
        heap = [(float(d), n) for n, d in enumerate(near.min(0))]
        heapq.heapify(heap)
        while heap:
            least, n = heapq.heappop(heap)
            far = space.far(self.bound[part], self.q2[part])
            if least > far.max():
                break
            rows = np.flatnonzero(near[:, n] <= far)
            if not len(rows):
                continue
            node, d = open_[n], to_node[rows, n]
            i, j = pages.first[node], pages.last[node]
            low, high = np.searchsorted(pages.apart[i:j], [(d - far[rows]).min() - space.slack, (d + far[rows]).max() + space.slack])
            i, j = i + low, i + high
            if i >= j:
                continue
            found = self._scores(part[rows], pages.x[i:j])
            # Of equal scores the smaller id is wanted: a tie with the k-th counts only below its id.
            hits = found >= self.bound[part[rows], None]
            for r, c in zip(*np.nonzero(hits)):
                q, one = int(part[rows[r]]), int(pages.ids[i + c])
                if one != self.ids[q] and found[r, c] >= self.bound[q]:
                    self._offer(q, int(found[r, c]), one)


def _search_order(space: Space, routes: Routes, keys: list[bytes]) -> np.ndarray:
    """Queries by the routing object that they come to, so that those searched together are near each other."""
    if not keys:
        return np.zeros(0, int)
    return np.argsort(routes.descend(space.lifted(space.vectors(keys))), kind="stable")


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest products of each row that ``is_query`` picks, over all rows but those of its id.

    Ties go to the smaller vec_id; fewer than ``k`` other rows give fewer answers. Rows without an id, null
    vectors and those with null or non-finite components (or a square beyond double precision) take no part; shorter vectors end in
    zeros, empty and zero vectors score 0. Rows that repeat an id are candidates of their own, and each asks as a query
    of its own. Scores beyond a long are the nearest long. Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    sized = F.greatest(F.array_max("embedding"), -F.array_min("embedding")).cast("double")
    stats = vectors.agg(F.max(F.when(sized < math.inf, sized)).alias("most"), F.max(F.size("embedding")).alias("dims")).first()
    kind = "<i2" if (stats["most"] or 0) * SCALE < 32_000 else "<f8"
    dims = max(1, stats["dims"] or 0)
    named = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), "embedding")
    # Rows get a number when they are written, the same for all that reads them.
    rows = materialise(named.mapInArrow(quantised(kind), "vec_id long, asks boolean, key binary, norm2 double").withColumn("row", F.monotonically_increasing_id()), "vectors")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).first()
    space = Space(kind, dims, float(whole["norm2"] or 0.0))
    wide = 8 * (dims + 1)
    sample = rows.orderBy(F.xxhash64("key", "vec_id", "row")).limit(max(1, min(SAMPLE, SENT_BYTES // wide))).select("key").toPandas()["key"].tolist()
    entries = max(NODE, min(4096, PAGE_BYTES // (dims * np.dtype(kind).itemsize)))
    most = max(1, min(len(sample) // 4, SENT_BYTES // wide))
    routes = Routes(space.lifted(space.vectors([bytes(s) for s in sample] or [b""])), max(1, min(most, -(-2 * whole["n"] // entries))))
    shared = spark.sparkContext.broadcast((space, routes))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, routes = shared.value
        for b in batches:
            keys = b.column("key").to_pylist()
            at = routes.descend(space.lifted(space.vectors(keys))) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "route"])

    placed = materialise(rows.select("vec_id", "row", "asks", "key").mapInArrow(descend, "vec_id long, row long, asks boolean, key binary, route long"), "placed")
    # A row for each routing object, whose number is bounded; crowded ones are cut by a hash.
    cuts = placed.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / entries).cast("int").alias("cuts"))
    dealt = placed.join(F.broadcast(cuts), "route").withColumn("cut", F.pmod(F.xxhash64("row"), F.col("cuts")))
    gathered = dealt.groupBy("route", "cut").agg(F.collect_list(F.struct("vec_id", "key", "asks", "row")).alias("entries"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages; behind them the answers of the queries that lie in each page, from that page alone."""
        space, routes = shared.value
        for b in batches:
            for route, found in zip(b.column("route").to_pylist(), b.column("entries")):
                ids, keys, asks, number = found.values.flatten()
                ids, asks, keys = ids.to_numpy(), asks.to_numpy(zero_copy_only=False), keys.to_pylist()
                page = to_page(space, routes.all, route, ids, keys)
                where = np.flatnonzero(asks)
                bounds: list[int | None] = []
                if len(where):
                    one = Search(space, ids[where], [keys[i] for i in where], [None] * len(where), k)
                    held = Pages(space, [dict(zip(NAMES, page))])
                    for i in range(0, len(where), TOGETHER):
                        one.visit(held, routes.all, np.arange(i, min(i + TOGETHER, len(where))))
                    bounds = [best[0][0] if len(best) == k else None for best in one.best]
                numbers = number.to_numpy()[where].tolist()
                queries = [{"row": r, "id": int(ids[i]), "key": keys[i], "bound": s} for r, i, s in zip(numbers, where, bounds)]
                cells = [pa.array([v], pa.int64() if n == "route" else pa.binary()) for n, v in zip(NAMES, page)]
                asked = pa.array([queries], pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64()), ("key", pa.binary()), ("bound", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*cells, asked], [*NAMES, "queries"])

    pages = materialise(gathered.mapInArrow(build, PAGE + ", queries array<struct<row:long, id:long, key:binary, bound:long>>"), "pages")
    queries = materialise(pages.select(F.explode("queries").alias("q")).select("q.*"), "queries")
    per_wave = max(1, SENT_BYTES // (wide + 64))
    waves = -(-queries.count() // per_wave)
    parts = []
    for w in range(waves):
        mine = queries.where(F.pmod(F.xxhash64("row"), F.lit(waves)) == w).collect()  # about SENT_BYTES
        mine = [mine[i] for i in _search_order(space, routes, [bytes(q["key"]) for q in mine])]
        wave = spark.sparkContext.broadcast(([q["row"] for q in mine], np.array([q["id"] for q in mine], np.int64), [bytes(q["key"]) for q in mine], [q["bound"] for q in mine]))
        parts.append(materialise(pages.drop("queries").mapInArrow(_visits(shared, wave, k), "row long, query_id long, vec_id long, score long"), "found"))
        wave.unpersist()
    release(rows, placed, queries)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    answers = parts[0]
    for p in parts[1:]:
        answers = answers.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visits(shared, wave, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, routes = shared.value
        numbers, ids, keys, bounds = wave.value
        search = Search(space, ids, keys, bounds, k)
        for b in batches:
            rows = b.to_pylist()
            if not rows:
                continue
            pages = Pages(space, rows)
            for i in range(0, len(ids), TOGETHER):
                search.visit(pages, routes.all, np.arange(i, min(i + TOGETHER, len(ids))))
        out = [(numbers[q], int(ids[q]), -i, s) for q, best in enumerate(search.best) for s, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["row", "query_id", "vec_id", "score"])

    return run


def report(vectors: DataFrame) -> DataFrame:
    """``top_k`` for the rows whose id is divisible by EVERY."""
    return top_k(vectors, F.col("vec_id") % EVERY == 0)
