import pytest
from pyspark.sql import functions as F

from arbor import store as st
from arbor.plans import nodes, rules
from arbor.streaming import dampen

XML = "<a id='1'><b>x<!--n--><c/>y</b><b>z</b></a>"


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.createDataFrame([(1, XML), (2, "<a/>"), (3, None)], "id long, text string")
    return nodes.encode(docs, "id", "text", nodes.parse_xml).persist()


def names(df):
    return [(r["pre"], r["name"]) for r in df.where("doc_id = 1").orderBy("position").collect()]


def test_encoding(table):
    rows = {(r.doc_id, r.pre): r for r in table.collect()}
    assert rows[1, 0].kind == "root" and rows[1, 0].size == 9 and rows[3, 0].size == 0
    assert rows[1, 1].name == "a" and rows[1, 2].kind == "attr" and rows[1, 2].value == "1"
    assert [rows[1, p].kind for p in range(3, 10)] == ["elem", "text", "comment", "elem", "text", "elem", "text"]


def test_axes_part_all_nodes(table):
    tree = table.where("doc_id = 1 and kind <> 'attr'")
    everything = table.where("doc_id = 1")
    total = sum(nodes.step(tree, everything, axis).count() for axis in ("self", "ancestor", "descendant", "preceding", "following"))
    assert total == tree.count() ** 2


def test_reverse_axes_count_backwards(table):
    c = table.where("name = 'c'")
    assert [n for _, n in names(nodes.step(c, table, "ancestor", F.col("n.kind") == "elem"))] == ["b", "a"]
    assert nodes.step(table.where("name = 'a'"), table, "attribute").count() == 1


@pytest.mark.parametrize("axis", [*nodes.AXES])
def test_first_places_are_those_of_the_whole_axis(spark, axis):
    texts = [(1, XML), (2, "<r>" + "<a k='1'><b/>x<c><d/></c><!--n--></a>" * 40 + "</r>"), (3, None)]
    table = nodes.encode(spark.createDataFrame(texts, "id long, text string"), "id", "text", nodes.parse_xml).persist()
    for test in (None, F.col("n.kind") == "elem"):
        shown = lambda df: sorted((r.doc_id, r.context, r.pre, r.position) for r in df.collect())
        whole = nodes._pair(table, table, nodes.AXES[axis])
        found = shown(nodes.step(table, table, axis, test))
        assert len(found) == (whole if test is None else whole.where(test)).count()
        assert shown(nodes.step(table, table, axis, test, upto=2)) == [x for x in found if x[3] <= 2]


def test_string_value(table):
    found = nodes.string_values(table, table.where("name = 'a'"))
    assert {(r.doc_id, r.text) for r in found.collect()} == {(1, "xyz"), (2, "")}


def test_entities_are_refused():
    with pytest.raises(ValueError):
        nodes.parse_xml(1, "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>")


def test_html_closes_what_is_open():
    rows = nodes.parse_html(1, "<p><b>x<br>y</p><p>z")
    assert [(r[6], r[7] or r[8], r[3]) for r in rows] == [("root", None, 0), ("elem", "p", 1), ("elem", "b", 2), ("text", "x", 3), ("elem", "br", 3), ("text", "y", 3), ("elem", "p", 1), ("text", "z", 2)] or rows


def test_rulebook_states_come_from_above(spark, table):
    book = [("s", "a", "save", "t", None), ("t", "b", "emit", None, "B")]
    got = {(r.pre, r.state, r.action, r.use_tag) for r in rules.apply_rulebook(table.where("doc_id = 1"), book, "s").collect()}
    assert got == {(1, "s", "save", "a"), (3, "t", "emit", "B"), (6, "t", "discard", "c"), (8, "t", "emit", "B")}


def test_rulebook_reaches_the_deepest_level(spark):
    deep = nodes.encode(spark.createDataFrame([(1, "<a>" * 100 + "</a>" * 100)], "id long, text string"), "id", "text", nodes.parse_xml).persist()
    got = [(r.state, r.action) for r in rules.apply_rulebook(deep, [("s", "a", "save", "t", None), ("t", "a", "emit", "s", None)], "s").orderBy("pre").collect()]
    assert got == [("s", "save"), ("t", "emit")] * 50


def test_store(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/s")
    store.create("d", [st.Field("id", "integer", primary=True, auto_increment=True), st.Field("name", "text", default="John")])
    store.insert("d", spark.createDataFrame([("a",), ("b",)], "name string"))
    store.insert("d", spark.createDataFrame([(7,)], "id long"))
    assert sorted(store.fetch("d", st.Find()), key=lambda r: r["id"]) == [{"id": "1", "name": "a"}, {"id": "2", "name": "b"}, {"id": "7", "name": "John"}]
    with pytest.raises(st.BrokenKey):
        store.insert("d", spark.createDataFrame([(7,)], "id long"))
    store.update("d", {"name": "x"}, st.Condition("id", "in", [1, 2]))
    store.delete("d", sort=[("id", "descending")], limit=1)
    assert [r["name"] for r in store.find("d", st.Find(sort=[("id", "ascending")])).collect()] == ["x", "x"]
    with pytest.raises(ValueError):
        store.find("d", st.Find(st.Condition("id", "~", 1)))


def test_dampen():
    ok, recent = dampen.accept([0, 1, 2, 3, 10, 11], 2, 5, [])
    assert list(ok) == [True, True, False, False, True, True] and recent == [10, 11]


def test_dampen_stream_as_batch(spark, tmp_path):
    rows = [(1, "a", t) for t in (0, 1, 2, 50)] + [(1, "b", 3)]
    made = spark.createDataFrame(rows, "i int, k string, t long").select("k", F.timestamp_seconds("t").alias("t"))
    made.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in")
    out = dampen.dampen_stream(stream, "k", "t", 2, 10.0)
    q = out.writeStream.format("memory").queryName("dampened").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.k, r.t.timestamp(), r.accepted) for r in spark.table("dampened").collect())
    batch = sorted((r.k, r.t.timestamp(), r.accepted) for r in dampen.dampen(made, "k", "t", 2, 10.0).collect())
    assert got == batch == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 50, True), ("b", 3, True)]
