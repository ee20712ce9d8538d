import json

import pytest
from pyspark.sql import functions as F

from arbor import store as st
from arbor.functions import formats
from arbor.plans import nodes, trees

XML = "<a xmlns='u' xmlns:p='v' id='1&amp;\"'><b>x &lt; y<!--n--><c/></b><p:b xmlns:p=''>z<?do it?></p:b></a>"


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.createDataFrame([(1, XML), (2, "<a/>"), (3, None)], "id long, text string")
    return nodes.encode(docs, "id", "text", nodes.parse_xml).persist()


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_markup_reads_back_as_the_same_tree(spark, table):
    made = trees.markup(table)
    assert texts(made)[2] == "<a/>" and texts(made)[3] == ""
    again = nodes.encode(made.where("text <> ''").withColumnRenamed("doc_id", "id"), "id", "text", nodes.parse_xml)
    assert sorted(map(str, again.collect())) == sorted(map(str, table.where("doc_id < 3").collect()))
    assert texts(trees.markup(table, "text"))[1] == "x < yz"
    html = nodes.encode(spark.createDataFrame([(1, "<p>a<br>b<i></i></p>")], "id long, text string"), "id", "text")
    assert texts(trees.markup(html, "html")) == {1: "<p>a<br>b<i></i></p>"}


@pytest.mark.parametrize("text, tree", [
    ('{ a: 1, b: [ 2, "3", [true], {"c": null} ] }', '<json><a type="number">1</a><b type="array"><member type="number">2</member><member type="member">3</member><member type="array"><member type="true">true</member></member><member type="member"><c type="null">null</c></member></b></json>'),
    ('{"": {"<>": "<>"}}', '<json><element name=""><element name="&lt;&gt;">&lt;&gt;</element></element></json>'),
    ('[]', '<json type="array"/>'), ('"a\\n\\u00e9\\"b"', '<json>a\né"b</json>'), ("{", ""), ("[1 2]", ""), ("{a}", ""), ("", ""),
])
def test_json_as_a_tree_and_back(spark, text, tree):
    made = nodes.encode(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", trees.json_parser()).persist()
    assert texts(trees.markup(made)) == {1: tree}
    back = texts(trees.json_text(made))[1]
    if tree:
        want = text.replace("a:", '"a":').replace(" b:", ' "b":')
        assert json.loads(back) == json.loads(want)
    else:
        assert back == ""


def test_json_options(spark):
    df = spark.createDataFrame([(1, '{"a b": 1, "2": true}')], "id long, text string")
    made = nodes.encode(df, "id", "text", trees.json_parser("top", types=False, clean_names=True))
    assert texts(trees.markup(made)) == {1: "<top><a_b>1</a_b><_2>true</_2></top>"}


def test_copies_have_places_of_their_own(table):
    made = trees.copied(table, table.where("kind = 'elem' and name = 'b' or name = 'c' and kind = 'elem'"))
    assert texts(trees.markup(made)) == {1: "<b>x &lt; y<!--n--><c/></b><c/>"}
    rows = made.orderBy("pre").collect()
    assert [r.pre for r in rows] == list(range(len(rows))) and rows[0].size == len(rows) - 1 and [r.ord for r in rows if r.parent == 0] == [1, 2]
    assert texts(trees.markup(trees.copied(table, table.where("name = 'b'"), deep=False))) == {1: "<b/>"}


def test_names_and_namespaces(table):
    of = table.where("kind = 'elem' and doc_id = 1").select("name", trees.local_name().alias("l"), trees.generated_id().alias("i")).collect()
    assert [r.l for r in of] == ["a", "b", "c", "b"] and len({r.i for r in of}) == 4
    scope = {(r.pre, r.prefix): r.uri for r in trees.namespaces(table).collect()}
    own = {r.name: r.pre for r in table.where("kind = 'elem' and doc_id = 1").collect()}
    assert scope[own["c"], "p"] == "v" and scope[own["p:b"], ""] == "u" and (own["p:b"], "p") not in scope


def test_templates_go_on_below_by_built_in_rules(table):
    assert texts(trees.apply_templates(table, []))[1] == "x < yz"
    name = F.col("name")
    made = [trees.Rule(name == "b", F.lit("("), F.lit(")"), below="deep"), trees.Rule(F.col("kind") == "text", F.lit("T"), mode="deep"), trees.Rule(name == "p:b", below=None)]
    assert texts(trees.apply_templates(table, made)) == {1: "(T)", 2: "", 3: ""}


def test_numbers_of_nodes(spark):
    df = spark.createDataFrame([(1, "<d><s><p/><p/></s><s><p/><x/><p/></s></d>")], "id long, text string")
    table = nodes.encode(df, "id", "text", nodes.parse_xml).persist()
    shown = lambda found, form: [r[0] for r in found.orderBy("pre").select(formats.numbers_as("numbers", form)).collect()]
    p, s = F.col("name") == "p", F.col("name") == "s"
    assert shown(trees.numbered(table, p), "1") == ["1", "2", "1", "2"]
    assert shown(trees.numbered(table, p, "any"), "a)") == ["a)", "b)", "c)", "d)"]
    assert shown(trees.numbered(table, p, "any", s), "I") == ["I", "II", "I", "II"]
    assert shown(trees.numbered(table, p | s, "multiple"), "(1.a)") == ["(1)", "(1.a)", "(1.b)", "(2)", "(2.a)", "(2.b)"]


def test_number_patterns(spark):
    one = spark.range(1)
    shown = lambda x, pattern, *form: one.select(formats.format_number(F.lit(x), pattern, *form)).first()[0]
    assert shown(3.14159, "prefix#,#,###.##suffix") == "prefix3.14suffix" and shown(-3.14159, "_#,#,000.000##_") == "-_003.14159_"
    assert shown(1234567.0, "#,##0.00") == "1,234,567.00" and shown(0.5, "#.##") == ".5" and shown(0.0, "#") == "0" and shown(-5.0, "0;(0)") == "(5)"
    assert shown(0.256, "0%") == "26%" and shown(float("nan"), "0") == "NaN" and shown(float("-inf"), "0") == "-Infinity" and shown(12345.0, "#,####") == "1,2345"
    assert shown(1.5, "#*##", formats.DecimalFormat(point="*")) == "1*5"
    forms = [one.select(formats.number_as(F.lit(n), f)).first()[0] for n, f in ((27, "a"), (702, "A"), (703, "a"), (1994, "i"), (0, "I"), (7, "001"), (4000, "i"))]
    assert forms == ["aa", "ZZ", "aaa", "mcmxciv", "0", "007", "4000"]


def test_printed_forms(spark):
    df = spark.createDataFrame([(1, "ab", 1536), (2, "ab", 0), (3, "c", 5)], "i long, t string, n long")
    got = df.select(formats.printed("%-*s|%.2s|%jcs|%jt{x=}s|%jh{}s|%j1s|%%", F.lit(4), "t", "t", "t", "t", "n", "t", within=([], ["i"])).alias("p")).collect()
    assert [r.p for r in got] == ["ab  |ab|Ab|x=ab|1.5K|ab|%", "ab  |ab|Ab|x=ab|0||%", "c   |c|C|x=c|5|c|%"]


def test_store_counts_binds_and_deletes_without_a_key(spark, tmp_path):
    made = st.Store(spark, f"file://{tmp_path}")
    made.create("c", [st.Field("id", "integer", auto_increment=True), st.Field("name")])
    made.insert("c", spark.range(100).repartition(7).select(F.col("id").cast("string").alias("name")))
    made.insert("c", spark.createDataFrame([("x",), ("x",)], "name string"))
    assert sorted(r.id for r in made.table("c").collect()) == list(range(1, 103))
    request = st.Find(st.Every((st.Condition("id", ">", 5), st.Condition("name", "=", "y"))))
    assert sorted(r["id"] for r in made.fetch("c", request, bind=[0, "x"])) == ["101", "102"] and not list(made.fetch("c", request))
    plain = st.Store(spark, f"file://{tmp_path}/p")
    plain.load("t", spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, n long"), [st.Field("k"), st.Field("n", "integer")])
    plain.delete("t", st.Condition("k", "=", "a"), [("k", "ascending")], limit=1)
    assert sorted(tuple(r) for r in plain.table("t").collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(KeyError):
        plain.table("none")
