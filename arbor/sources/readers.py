"""Where tables and trees come from, and what they are written as."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import text


def xml(spark: SparkSession, path: str, row: str, schema=None, stream: bool = False, **options: str) -> DataFrame:
    """One row for each element ``row``; attributes are columns with a leading underscore."""
    reader = (spark.readStream if stream else spark.read).format("xml").option("rowTag", row).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_xml(df: DataFrame, path: str, row: str, root: str, **options: str) -> None:
    df.write.format("xml").option("rowTag", row).option("rootTag", root).options(**options).save(path)


def documents(spark: SparkSession, path: str, keep_returns: bool = False, encoding: str | None = None, base64: bool = False) -> DataFrame:
    """(path, text) of whole files; carriage returns are dropped unless they are to be kept."""
    files = spark.read.format("binaryFile").load(path)
    body = F.decode(F.unbase64(F.col("content").cast("string")) if base64 else F.col("content"), encoding or "UTF-8")
    if not keep_returns:
        body = F.replace(body, F.lit("\r"), F.lit(""))
    return files.select("path", body.alias("text"))


def files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size, modified) of files, from their listing alone."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def json_field(value: Column | str, *path: str) -> Column:
    """A field's text; empty if there is none."""
    c = value if isinstance(value, Column) else F.col(value)
    return F.coalesce(F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path)), F.lit(""))


def json_members(df: DataFrame, column: str) -> DataFrame:
    """Each row once for each member of a JSON object: adds name, type and value."""
    kind = F.lower(F.regexp_replace(F.schema_of_variant(F.col("_m.value")), "<.*", ""))
    # The rows' own view, so that queries that run beside each other don't take each other's.
    view = f"_arbor_members_{uuid.uuid4().hex}"
    df.withColumn("_v", F.try_parse_json(F.col(column))).createOrReplaceTempView(view)
    found = df.sparkSession.sql(f"SELECT t.*, struct(m.key, m.value) AS _m FROM {view} t, LATERAL variant_explode(t._v) m")
    df.sparkSession.catalog.dropTempView(view)
    return found.withColumns({"name": F.col("_m.key"), "type": kind, "value": F.to_json(F.col("_m.value"))}).drop("_v", "_m")


def form_fields(value: Column | str) -> Column:
    """A url-encoded form or query string as a map; of a name that comes again, the last value."""
    c = text(value)
    pairs = F.filter(F.split(c, "&"), lambda p: p != "")
    decode = lambda x: F.try_url_decode(F.coalesce(x, F.lit("")))
    value_of = lambda p: decode(F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.char_length(p))))
    entries = F.transform(pairs, lambda p: F.struct(F.coalesce(decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("k"), value_of(p).alias("v")))
    names = F.transform(entries, lambda e: e["k"])
    last = lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["k"])
    return F.map_from_entries(F.filter(entries, last))


def query_of(url: Column | str) -> Column:
    """What stands after the first question mark of a URL and before its fragment."""
    return F.regexp_extract(text(url), r"^[^?#]*\?([^#]*)", 1)


def escaped(value: Column | str) -> Column:
    """Text with the five characters that markup reserves as entities."""
    out = text(value)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def unescaped(value: Column | str) -> Column:
    out = text(value)
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def element(name: str, attributes: dict[str, Column | str], *content: Column) -> Column:
    """An element as markup; empty ones are closed at once."""
    opened = F.concat(F.lit(f"<{name}"), *[F.concat(F.lit(f' {k}="'), escaped(v), F.lit('"')) for k, v in attributes.items()])
    body = F.concat(*content) if content else F.lit("")
    return F.when(body == "", F.concat(opened, F.lit("/>"))).otherwise(F.concat(opened, F.lit(">"), body, F.lit(f"</{name}>")))


def yaml(columns: list[str]) -> Column:
    """A row as a YAML mapping of quoted texts; missing values are null."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.to_json(F.array(F.col(c).cast("string"))).substr(F.lit(2), F.char_length(F.to_json(F.array(F.col(c).cast("string")))) - 2), F.lit("null"))) for c in columns])


def from_xml_text(value: Column | str, schema: str) -> Column:
    return F.from_xml(text(value), schema)
