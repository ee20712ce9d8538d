import base64

from pyspark.sql import functions as F

from arbor.sources import readers


def test_xml_is_written_and_read(spark, tmp_path):
    made = spark.createDataFrame([(1, "a & b"), (2, "<c>")], "_id long, name string")
    readers.write_xml(made, f"{tmp_path}/x", "row", "rows")
    back = readers.xml(spark, f"{tmp_path}/x", "row", "_id long, name string")
    assert sorted(map(tuple, back.collect())) == [(1, "a & b"), (2, "<c>")]
    assert readers.xml(spark, f"{tmp_path}/x", "row", back.schema, stream=True).isStreaming


def test_documents_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\né".encode("latin-1"))
    (tmp_path / "b.txt").write_bytes(base64.b64encode(b"1\r\n2"))
    one = lambda name, **how: readers.documents(spark, f"{tmp_path}/{name}", **how).first().text
    assert one("a.txt", encoding="ISO-8859-1") == "x\né" and one("a.txt", keep_returns=True, encoding="ISO-8859-1") == "x\r\né"
    assert one("b.txt", base64=True) == "1\n2"
    assert sorted((r.path[-5:], r.size) for r in readers.files(spark, f"{tmp_path}/*.txt").collect()) == [("a.txt", 4), ("b.txt", 8)]


def test_yaml_and_elements(spark):
    df = spark.createDataFrame([("a\"b", None)], "x string, y long")
    assert df.select(readers.yaml(["x", "y"])).first()[0] == 'x: "a\\"b"\ny: null'
    assert df.select(readers.element("e", {"k": "x"}), readers.element("e", {}, F.lit("t"))).first() == ('<e k="a&quot;b"/>', "<e>t</e>")
