"""Findings of round 3: what failed before, and closures of any links against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from arbor.llm import filters
from arbor.operators import groups


def _by_force(links):
    """All pairs that are joined by paths; a null ends a path."""
    found = set(links)
    while True:
        more = found | {(a, d) for a, b in found for c, d in links if b is not None and b == c}
        if more == found:
            return found
        found = more


def _graphs():
    chance = random.Random(3)
    yield "empty", []
    yield "loops", [(1, 1), (2, 3), (3, 2), (14, 11), (11, 13), (13, 12), (12, 14), (20, 21), (20, 21)]
    yield "fork", [(i, i + 1) for i in range(9)] + [(20 + i, 21 + i) for i in range(7)] + [(9, 20), (9, 40), (40, 41), (41, 40), (27, 50), (30, 50)]
    yield "ring with tails", [(i, (i + 1) % 11) for i in range(11)] + [(i, i + 1) for i in range(30, 38)] + [(38, 4), (7, 60), (60, 61), (61, 62)]
    yield "nulls", [(None, 1), (1, 2), (2, 3), (3, None), (None, None), (9, None), (None, 7), (3, 4), (4, 5)]
    for n, m in ((12, 9), (20, 24), (30, 30), (40, 26)):
        yield f"random {n} {m}", [(chance.randrange(n), chance.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("name, links", list(_graphs()), ids=[x[0] for x in _graphs()])
def test_closure_by_force(spark, monkeypatch, name, links):
    monkeypatch.setattr(groups, "BLOCK", 3)
    monkeypatch.setattr(groups, "DEALT", 300)  # some graphs on either side
    got = [tuple(r) for r in groups.reachable(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == _by_force(links)


def test_closure_of_names(spark):
    links = [("b", "a"), ("a", "d"), ("d", "c"), ("c", "c")]
    got = sorted(tuple(r) for r in groups.reachable(spark.createDataFrame(links, "x string, y string"), "x", "y").collect())
    assert got == sorted(_by_force(links))


def test_closure_does_not_shuffle_its_pairs(spark):
    """pairs (here 249,500 of two chains) were shuffled and stored before they were whole."""
    n = 500
    links = spark.range(2 * n).where(f"id % {n} < {n - 1}").selectExpr("id AS a", "id + 1 AS b")
    before = max(_shuffled(spark))
    assert groups.reachable(links, "a", "b").count() == n * (n - 1)
    assert sum(rows for stage, rows in _shuffled(spark).items() if stage > before) < n * (n - 1) / 2


def _shuffled(spark):
    """Rows that each of the latest stages has written to shuffles."""
    spark.range(10).count()
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return {(x := stages.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(stages.size())}


def test_filter_join_makes_only_rows_that_pass(spark):
    """op5_line_dedup: every line was a row of the join to the filter's blocks, in each of its passes."""
    hashes = spark.range(3000).select("id", F.xxhash64("id").alias("_h"))
    hit = filters.cells_hit(hashes.where("id % 50 = 0"), 3).cache()
    passed = filters.passing(hashes, hit, 3)
    found = {r.id for r in passed.collect()}
    assert found == {r.id for r in filters.probe(hashes, hit, 3).where("_maybe").collect()} and {i for i in range(0, 3000, 50)} <= found
    assert "Join LeftSemi" in passed._jdf.queryExecution().optimizedPlan().toString()
