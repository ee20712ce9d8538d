import pytest

from arbor.operators import groups
from arbor.queries import QUERIES, SQL

from .oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_all_orders_are_shifted(spark):
    big = "/root/testdata/sf0.1"
    keys = spark.read.parquet(f"{big}/orders.parquet").select("o_orderkey")
    assert keys.where("o_orderkey >= 65536").count() > 0
    assert QUERIES["fn_bit_shifts_all"](spark, big).join(keys, "o_orderkey").count() == keys.count()
    check(spark, QUERIES["fn_bit_shifts_all"], SQL["fn_bit_shifts_all"], big)


def test_closure_follows_long_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(150)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    got = {tuple(r) for r in groups.reachable(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {(i, j) for i in range(151) for j in range(i + 1, 151)} | {(i, j) for i in range(1000, 1003) for j in range(1000, 1003)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
