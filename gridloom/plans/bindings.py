"""The driver's tables seen as the engine's inputs, in Spark and as DuckDB subqueries.

Coordinates come from integer arithmetic only, so both sides agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.cells import grid_id, parent_key
from gridloom.functions.projection import ALPHA, BETA, DELTA, K0, RECTIFYING, E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    base = o.select(
        key.alias("id"),
        (32643 + F.col("o_custkey") % 11).cast("int").alias("grid_epsg"),
        (300 + key % 180).cast("int").alias("grid_col"),
        (2500 + F.floor(key / 180)).cast("int").alias("grid_row"),
        "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey", "o_orderdate",
    )
    return base.withColumn("parent_key", parent_key(F.col("grid_epsg"), F.col("grid_col"), F.col("grid_row")))


CELLS = """(SELECT *, grid_epsg || ':' || grid_col || ':' || grid_row AS parent_key FROM (
  SELECT o_orderkey AS id, CAST(32643 + o_custkey % 11 AS INT) AS grid_epsg, CAST(300 + o_orderkey % 180 AS INT) AS grid_col,
         CAST(2500 + o_orderkey // 180 AS INT) AS grid_row, o_orderstatus, o_orderpriority, o_totalprice, o_custkey, o_orderdate FROM orders))"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).where("o_orderstatus = 'F'")


REGISTRY = f"(SELECT * FROM {CELLS} WHERE o_orderstatus = 'F')"


def atlas(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a stratum, its score, a region and the observed count of their macrocell as declared one."""
    from pyspark.sql import Window

    c = cells(spark, sf)
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("region"))
    rows = c.join(nation, "o_custkey", "left").withColumn("grid_id", grid_id(F.col("grid_epsg")))
    macro = Window.partitionBy("grid_id", F.floor(F.col("grid_row") / 10), F.floor(F.col("grid_col") / 10))
    return rows.select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("patch_id"), "grid_id", "grid_epsg", "grid_col", "grid_row", "region", "parent_key",
        F.count(F.lit(1)).over(macro).alias("macro_candidate_count"),
        (F.col("o_orderstatus") != "P").alias("eligible"),
        F.array("o_orderpriority").alias("strata"),
        F.create_map(F.col("o_orderpriority"), F.col("o_totalprice")).alias("stratum_scores"),
    )


ATLAS = f"""(SELECT 'p' || id AS patch_id, 'utm' || lpad(CAST(grid_epsg % 100 AS VARCHAR), 2, '0') || 'n' AS grid_id, grid_epsg, grid_col, grid_row, 'n' || c_nationkey AS region, parent_key,
  CAST(grid_row // 10 AS BIGINT) AS macro_row, CAST(grid_col // 10 AS BIGINT) AS macro_col, o_orderstatus <> 'P' AS eligible, o_orderpriority AS stratum, o_totalprice AS score
  FROM {CELLS} c LEFT JOIN customer ON c_custkey = o_custkey)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("point_id"), (73 + (k * 37 % 6200) / 100.0).alias("x"), (18 + (k * 53 % 3500) / 100.0).alias("y"))


POINTS = "(SELECT c_custkey AS point_id, 73 + (c_custkey * 37 % 6200) / 100.0::DOUBLE AS x, 18 + (c_custkey * 53 % 3500) / 100.0::DOUBLE AS y FROM customer)"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """25 boxes of 12 x 6.5 degrees, with gaps between them."""
    k = F.col("n_nationkey")
    x, y = 73 + (k % 5) * 12.0, 18 + F.floor(k / 5) * 7.0
    ring = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (x + 11.5, y), (x + 11.5, y + 6.5), (x, y + 6.5))])
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), ring.alias("ring"))


BOXES = "(SELECT n_name AS name, 73 + (n_nationkey % 5) * 12.0::DOUBLE AS x0, 18 + (n_nationkey // 5) * 7.0::DOUBLE AS y0 FROM nation)"


def shores(spark: SparkSession, sf: str, sea: bool = False) -> DataFrame:
    """Five strips of land, or of sea east of each, six degrees wide; their edges are central meridians."""
    k = F.col("n_nationkey")
    west = 75.0 + k * 12.0 + (6.0 if sea else 0.0)
    ring = F.array(*[F.struct(x.cast("double").alias("x"), F.lit(y).alias("y")) for x, y in ((west, 18.0), (west + 6, 18.0), (west + 6, 53.0), (west, 53.0))])
    rows = table(spark, sf, "nation").where(k < 5)
    return rows.select(F.concat(F.lit("sea" if sea else "land"), k.cast("string")).alias("name"), k.cast("int").alias("place"), ring.alias("ring"))


def degrees_sql(source: str, x: str, y: str, epsg: str) -> str:
    """DuckDB subquery of ``source`` with ``lon`` and ``lat`` of metres in a northern UTM zone (Krueger's series)."""
    terms = lambda c, f, g: " + ".join(f"{v!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, v in enumerate(c, 1))
    scale = repr(K0 * RECTIFYING)
    a = f"SELECT *, ({y}) / {scale}::DOUBLE AS xi, (({x}) - 500000.0::DOUBLE) / {scale}::DOUBLE AS eta FROM {source}"
    b = f"SELECT * EXCLUDE (xi, eta), xi - ({terms(BETA, 'sin', 'cosh')}) AS p, eta - ({terms(BETA, 'cos', 'sinh')}) AS q FROM ({a})"
    c = f"SELECT * EXCLUDE (p, q), (({epsg}) % 100) * 6.0::DOUBLE - 183 + degrees(atan2(sinh(q), cos(p))) AS lon, asin(sin(p) / cosh(q)) AS chi FROM ({b})"
    lat = " + ".join(f"{v!r} * sin({2 * j} * chi)" for j, v in enumerate(DELTA, 1))
    return f"(SELECT * EXCLUDE (chi), degrees(chi + {lat}) AS lat FROM ({c}))"


def metres_sql(source: str, lon: str, lat: str, epsg: str) -> str:
    """DuckDB subquery of ``source`` with ``mx`` and ``my``, metres in a northern UTM zone."""
    e = repr(E)
    a = f"SELECT *, radians(({lon}) - ((({epsg}) % 100) * 6 - 183)) AS lam, tan(radians({lat})) AS t FROM {source}"
    b = f"SELECT * EXCLUDE (t), t * sqrt(1 + s * s) - s * sqrt(1 + t * t) AS t FROM (SELECT *, sinh({e} * atanh({e} * t / sqrt(1 + t * t))) AS s FROM ({a}))"
    c = f"SELECT * EXCLUDE (lam, t, s), atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM ({b})"
    terms = lambda f, g: " + ".join(f"{v!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, v in enumerate(ALPHA, 1))
    scale = repr(K0 * RECTIFYING)
    return f"(SELECT * EXCLUDE (xi, eta), 500000 + {scale} * (eta + {terms('cos', 'sinh')}) AS mx, {scale} * (xi + {terms('sin', 'cosh')}) AS my FROM ({c}))"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as pixel observations: 40 patches, monthly, seven bands, scenes in a fixed order."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    order = F.struct("l_shipdate", "l_orderkey", "l_suppkey", "l_extendedprice")
    qa = (F.col("l_quantity").cast("int") % 12).alias("qa")
    return l.select(
        (F.col("l_partkey") % 40).alias("patch_id"), F.when(F.col("l_suppkey") % 3 == 0, "s1").when(F.col("l_suppkey") % 3 == 1, "s2").otherwise("landsat").alias("source"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int").alias("month"), F.col("l_shipdate").alias("date"), F.col("l_orderkey").alias("scene_id"), order.alias("scene_order"),
        F.col("l_linenumber").alias("band"), (F.col("l_partkey") % 7).alias("pixel"), F.col("l_extendedprice").alias("value"), qa, (F.col("l_suppkey") % 32).alias("bits"),
        ((F.col("l_quantity").cast("int") % 12).isin(4, 5, 6, 7, 11)).alias("valid"),
    )


OBS = """(SELECT l_partkey % 40 AS patch_id, CASE WHEN l_suppkey % 3 = 0 THEN 's1' WHEN l_suppkey % 3 = 1 THEN 's2' ELSE 'landsat' END AS source,
  CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS month, l_shipdate AS date, l_orderkey AS scene_id,
  {'a': l_shipdate, 'b': l_orderkey, 'c': l_suppkey, 'd': l_extendedprice} AS scene_order,
  l_linenumber AS band, l_partkey % 7 AS pixel, l_extendedprice AS value, CAST(l_quantity AS INT) % 12 AS qa, l_suppkey % 32 AS bits,
  CAST(l_quantity AS INT) % 12 IN (4, 5, 6, 7, 11) AS valid FROM lineitem)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as scenes with boxes of 1.5 degrees, a cloud cover and an asset map."""
    c = cells(spark, sf)
    x, y = F.col("grid_col") / 10.0, F.col("grid_row") / 100.0
    return c.select(
        F.col("id").alias("item_id"), F.array(x, y, x + 1.5, y + 1.5).alias("bbox"), F.when(F.col("id") % 10 != 0, F.col("o_totalprice") % 100).alias("cloud"), F.col("o_orderdate").alias("datetime"),
        F.create_map(F.lit("red"), F.concat(F.when(F.col("id") % 7 == 0, "http:").otherwise("s3:"), F.col("parent_key")), F.col("o_orderpriority"), F.lit("s3:x")).alias("assets"),
        F.create_map(F.lit("datetime"), F.col("o_orderdate").cast("string"), F.lit("secret"), F.lit("x")).alias("properties"),
        F.lit("s2").alias("source"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias("month"),
    )


ITEMS = f"""(SELECT id AS item_id, grid_col / 10.0::DOUBLE AS x0, grid_row / 100.0::DOUBLE AS y0, CASE WHEN id % 10 <> 0 THEN o_totalprice % 100 END AS cloud, o_orderdate AS datetime,
  (CASE WHEN id % 7 = 0 THEN 'http:' ELSE 's3:' END) || parent_key AS red, o_orderpriority AS other, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS month FROM {CELLS})"""


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as patches of half a degree."""
    k = F.col("p_partkey")
    x, y = 30 + (k % 180) / 10.0, 25 + (k % 97) / 10.0
    return table(spark, sf, "part").select(k.alias("patch_id"), F.array(x, y, x + 0.5, y + 0.5).alias("bbox"))


PATCHES = "(SELECT p_partkey AS patch_id, 30 + (p_partkey % 180) / 10.0::DOUBLE AS px, 25 + (p_partkey % 97) / 10.0::DOUBLE AS py FROM part)"


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Events as map features: a kind and a tag map."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "way").when(F.col("event_id") % 3 == 1, "relation").otherwise("node")
    value = F.when(F.col("value") > 50, "water").otherwise("construction")
    return e.select("event_id", kind.alias("kind"), F.create_map(F.lit("highway"), F.col("event_type"), F.when(F.col("user_id") % 2 == 0, "natural").otherwise("landuse"), value).alias("tags"))


FEATURES = """(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'way' WHEN event_id % 3 = 1 THEN 'relation' ELSE 'node' END AS kind, event_type AS highway,
  CASE WHEN user_id % 2 = 0 THEN 'natural' ELSE 'landuse' END AS k2, CASE WHEN value > 50 THEN 'water' ELSE 'construction' END AS v2 FROM events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with a patch, a month, a label, a fold and a score."""
    v = table(spark, sf, "embeddings")
    first = F.get("embedding", F.lit(0)).cast("double")
    fold = F.col("vec_id") % 5
    split = F.when(fold < 3, "train").when(fold == 3, "val").otherwise("test")
    return v.select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"), fold.alias("fold"), split.alias("split"), first.alias("logit"), F.round(first, 2).alias("score"), (F.col("vec_id") % 50).alias("patch_id"), (202401 + F.col("vec_id") % 3).cast("int").alias("month"))


VECTORS = """(SELECT vec_id, embedding, CAST(label >= 5 AS INT) AS label, vec_id % 5 AS fold, CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS split,
  CAST(embedding[1] AS DOUBLE) AS logit, round(CAST(embedding[1] AS DOUBLE), 2) AS score, vec_id % 50 AS patch_id, CAST(202401 + vec_id % 3 AS INT) AS month FROM embeddings)"""


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("col"), F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_size") % 4).cast("int").alias("shard_id"))


LATTICE = "(SELECT p_partkey % 40 AS col, p_partkey // 40 AS row, CAST(p_size % 4 AS INT) AS shard_id FROM part)"


def unit(text: str) -> str:
    """DuckDB text of the unit hash of an SQL text expression."""
    return f"(CAST('0x' || substr(sha256({text}), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0)"
