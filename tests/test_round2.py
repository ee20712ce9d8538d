"""Findings of round 2: each of these failed before."""

import base64

import pytest
from pyspark.sql import functions as F

from arbor.functions import dates, strings
from arbor.operators import groups
from arbor.plans import nodes, rules, trees
from arbor.queries import QUERIES, SQL
from arbor.shared import stored

from .oracle import check


def test_base64_is_one_line(spark):
    long = "https://blog.cheap-pills.example.net/en/25137?page=2&ref=x" * 3
    df = spark.createDataFrame([(long,), ("a" * 57,), ("a" * 58,), ("",)], "x string")
    for r in df.select("x", strings.base64_encode("x").alias("e"), strings.base64_decode(strings.base64_encode("x")).alias("d")).collect():
        assert r.e == base64.b64encode(r.x.encode()).decode() and r.d == r.x


def test_largest_suffix(spark):
    n = F.col("n")
    df = spark.createDataFrame([(1048575,), (1048576,), (9000000,)], "n long").orderBy("n")
    got = [tuple(r) for r in df.select(strings.human_size(n * 1024, largest="M"), strings.human_size(n * 1024)).collect()]
    assert got == [("1024.0M", "1024.0M"), ("1024.0M", "1.0G"), ("8789.1M", "8.6G")]


def test_humanize_of_large_keys_against_sql(spark, tmp_path):
    keys = [0, 1, 1023, 1024, 1075, 1331, 999999, 1048575, 1048576, 2097152, 8999999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/w")
    _one_file(tmp_path, "orders")
    check(spark, QUERIES["fn_humanize"], SQL["fn_humanize"], str(tmp_path))


PAGES = [
    "<html><title>of.&amp;&amp;&amp</title><p>x</html>", "<title>a&</title><a href='/x?a=1&b=2'>t</a>", "<title>t = &quot;x&quot; &am</title><p >", "<title>plain</title><script>if (a<b) x('<p>')</script>",
    "no title",
]


def test_titles_against_sql(spark, tmp_path):
    _pages(spark, tmp_path)
    check(spark, QUERIES["html_titles"], SQL["html_titles"], str(tmp_path))


def test_written_pages_against_sql(spark, tmp_path):
    _pages(spark, tmp_path)
    check(spark, QUERIES["tree_to_html"], SQL["tree_to_html"], str(tmp_path))


def test_references_stay_as_written(spark):
    html = '<a href="/x?a=1&b=2&amp;c">1 &lt 2 &amp; &#38;</a><script>a<b && c</script>'
    made = nodes.encode(spark.createDataFrame([(1, html)], "id long, t string"), "id", "t", nodes.parse_written_html)
    assert trees.markup(made, "html", escaped=True).first().text == html


def _pages(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/w")
    _one_file(tmp_path, "pages")


def _one_file(tmp_path, table):
    """The one part written to w as a file, which both Spark and DuckDB read by the table's name."""
    (part,) = tmp_path.glob("w/*.parquet")
    (tmp_path / f"{table}.parquet").write_bytes(part.read_bytes())


@pytest.mark.parametrize("name, rules_at_most", [("json_to_tree", 0), ("tree_to_json", 0), ("rulebook_filter", 1)])
def test_stored_tables_are_not_broadcast(spark, monkeypatch, name, rules_at_most):
    """Their files are small however many rows they have: sizes of files are no reason to send rows to the driver."""
    made = []
    kept = lambda df, name, *a, **b: (made.append(df) if name != "rulebook-nodes" else None, stored(df, name, *a, **b))[1]
    monkeypatch.setattr(rules, "stored", kept)
    made.append(QUERIES[name](spark, "/root/testdata/sf0.001"))
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in made]
    assert any("SortMergeJoin" in p for p in plans)
    assert all(p.count("BroadcastHashJoin") <= rules_at_most for p in plans[:-1]) and (name == "rulebook_filter" or "BroadcastHashJoin" not in plans[-1])


def test_pairs_of_a_chain_are_found_once(spark, monkeypatch):
    """A round makes as many pairs as are new, not one for each node between."""
    made = []
    monkeypatch.setattr(groups, "stored", lambda df, *a: (made.append(df), stored(df, *a))[1])
    assert groups.reachable(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long"), "a", "b").count() == 5050
    assert len(made) == 8
    links = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (5, 0), (3, 3), (3, 9)]
    got = {tuple(r) for r in groups.reachable(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {(a, b) for a in (0, 1, 2, 3, 5) for b in (0, 1, 2, 3, 9)}


def test_durations(spark):
    secs = [0, 1, 59, 60, 3600, 86400, 90061, -90061, -60, None]
    df = spark.createDataFrame([(x,) for x in secs], "x long").select("x", dates.duration("x").alias("d"))
    got = [tuple(r) for r in df.select("d", dates.duration_seconds("d")).collect()]
    assert [d for d, _ in got] == ["PT0S", "PT1S", "PT59S", "PT1M", "PT1H", "P1D", "P1DT1H1M1S", "-P1DT1H1M1S", "-PT1M", "PT0S"]
    assert [n for _, n in got] == [x or 0 for x in secs]
    odd = spark.createDataFrame([("P",), ("P1",), (",1,2,3,4",), ("PT",), (None,), ("1D",), ("-P2DT3S",)], "d string")
    assert [r[0] for r in odd.select(dates.duration_seconds("d")).collect()] == [0, None, None, 0, None, None, -172803]


def test_a_duration_is_parsed_once(spark):
    """Neither the text nor its parse is repeated for each part of it."""
    df = spark.range(1).select(dates.duration_seconds(F.upper(F.concat(F.lit("pt"), "id", F.lit("s")))).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and plan.count("regexp_replace") == 1
