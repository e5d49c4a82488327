"""Records that are joined with each other are shuffled, never broadcast: their statistics are those of the files they were made of."""

from pyspark.sql import functions as F

from gridloom.operators import overlaps, spatial
from gridloom.plans.bindings import cells
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_no_side_of_an_overlap_join_is_broadcast(spark):
    c = cells(spark, SMALL).select(F.col("parent_key").alias("id"), "grid_epsg", "grid_col", "grid_row", F.lit("other").alias("layer"))
    placed = overlaps.settled(spatial.placed_footprints(c))
    pairs = spatial.footprint_pairs(placed, placed, F.col("l.id") < F.col("r.id"))
    assert "SortMergeJoin" in plan(pairs) and "Broadcast" not in plan(pairs)
    twice = c.select(F.col("id").alias("left_id"), F.col("id").alias("right_id"))
    assert plan(overlaps.losing(twice, c)).count("SortMergeJoin") == 2 and "Broadcast" not in plan(overlaps.losing(twice, c))
