"""Queries over cells so far north that zones narrow, the pole is passed and northings start again, against their SQL."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

from tests.conftest import SMALL
from tests.test_queries import ORACLES, TABLES, __spark_entry__, rows

#: Cell rows at the pole, at the far equator, half a circle on, and so forth.
SPECIAL = (7811, 15621, 23432, 31242)


def folder_with(tmp_path_factory, keys, table="orders", key="o_orderkey"):
    """The smallest tables with other keys, as larger tables have them."""
    folder = tmp_path_factory.mktemp("far")
    for t in TABLES:
        if t != table:
            os.symlink(f"{SMALL}/{t}.parquet", folder / f"{t}.parquet")
    orders = pq.read_table(f"{SMALL}/{table}.parquet").slice(0, len(keys))
    place = orders.schema.get_field_index(key)
    pq.write_table(orders.set_column(place, orders.schema.field(place), [keys]), folder / f"{table}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def north(tmp_path_factory):
    """Rows 2,500 to 7,500: tables six times sf0.1."""
    return folder_with(tmp_path_factory, [i * 601 + i % 7 for i in range(1500)])


@pytest.fixture(scope="module")
def beyond(tmp_path_factory):
    """Rows around the places where degrees or metres start again."""
    return folder_with(tmp_path_factory, [(row + d - 2500) * 180 + c for row in SPECIAL for d in (-2, -1, 0, 1) for c in range(70, 110)])


def differences(spark, name, folder):
    found = __spark_entry__.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    a, b = rows(found.columns, found.collect()), rows(names, want.fetchall())
    return sorted(set(a) ^ set(b)), len(a) - len(b)


@pytest.mark.parametrize("name", ["agg05_grid_audit", "agg09_registry_audit"])
def test_audits_far_north(name, spark, north):
    assert differences(spark, name, north) == ([], 0)


@pytest.mark.parametrize("name", ["fn23_cell_validity", "agg05_grid_audit", "agg09_registry_audit"])
def test_audits_beyond_the_pole(name, spark, beyond):
    assert differences(spark, name, beyond) == ([], 0)


@pytest.mark.parametrize("name", ["join11_coastal_crossing", "join12_near_coast", "win10_coastal_fallback"])
def test_coasts_far_north(name, spark, north):
    assert differences(spark, name, north) == ([], 0)


def test_cells_of_one_zone_a_circle_apart(spark, tmp_path_factory):
    """Rows 2,500 on and those a whole meridian circle north of them, in the same zones."""
    first = [k * 9 for k in range(500)]
    folder = folder_with(tmp_path_factory, first + [k + 31_242 * 180 for k in first])
    orders = pq.read_table(f"{folder}/orders.parquet").to_pandas().assign(o_custkey=3)
    orders.to_parquet(f"{folder}/orders.parquet")
    assert differences(spark, "join08_same_zone_overlaps", folder) == ([], 0)


def test_points_at_just_the_distance_of_a_shore_s_end(spark, tmp_path_factory):
    keys = [13_340, 41_340, 69_340, *range(97)]
    assert differences(spark, "join11_join12_coast", folder_with(tmp_path_factory, keys, "customer", "c_custkey")) == ([], 0)


def test_registry_plan_far_north(spark, north):
    assert differences(spark, "win14_fn47_registry_plan", north) == ([], 0)
