"""Trees made and written: JSON as trees, node tables as markup or JSON, copies, templates that go on below.

A text that is written from a tree is a list of tokens: what each node has before what is
below it, at its own place, and what it has after that, at the place of its last descendant.
So writing is one sort of tokens within each document, and needs no recursion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import dealt, spread, stored
from .nodes import VOID, _Builder, _contained

_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|([\[\]{}:,])|([^\s\[\]{}:,"]+))', re.DOTALL)
_NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
_NAME = re.compile(r"[A-Za-z_][\w.-]*$")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.DOTALL)
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _string(token: str) -> str:
    made = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _PLAIN.get(m[1], m[1]), token[1:-1])
    return made.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_parser(root: str = "json", types: bool = True, clean_names: bool = False):
    """A parser for :func:`nodes.encode` of JSON texts, whose names need no quotes.

    An object's members are elements; a name that no element can have is an attribute of an
    ``element``, or is cleaned. Types other than text are attributes; what is in an array is a
    ``member``. A text that is no JSON is a document without content.
    """

    def parse(doc_id: int, text: str) -> list[list]:
        try:
            return _parsed(doc_id, text, root, types, clean_names)
        except ValueError:
            return _Builder(doc_id).done()

    return parse


def _parsed(doc_id: int, text: str, root: str, types: bool, clean_names: bool) -> list[list]:
    b, at, opened = _Builder(doc_id), 0, []  # opened: (element, closing sign)
    label: tuple[str, list] | None = (root, [])

    def start(kind: str) -> str:
        name, attributes = label
        member = bool(opened) and opened[-1][1] == "]"
        kind = kind or ("member" if member else "")
        b.start(name, attributes + ([("type", kind)] if kind and (types or kind in ("array", "member")) else []))
        return name

    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("no token")
        at = m.end()
        quoted, sign, bare = m.groups()
        if sign in ("}", "]"):
            if not opened or opened[-1][1] != sign:
                raise ValueError(sign)
            b.end(opened.pop()[0])
            label = None
        elif sign == ",":
            label = ("member", []) if opened and opened[-1][1] == "]" else None
        elif label is None and not sign and opened and opened[-1][1] == "}":
            name = _string(quoted) if quoted else bare
            if not re.compile(r"\s*:").match(text, at):
                raise ValueError("a name without a value")
            at = text.index(":", at) + 1
            cleaned = re.sub(r"[^\w.-]|^(?=[^A-Za-z_])", "_", name) or "_" if clean_names else name
            label = (cleaned, []) if _NAME.match(cleaned) else ("element", [("name", name)])
        elif label is None:
            raise ValueError("no place for a value")
        elif sign in ("{", "["):
            opened.append((start("array" if sign == "[" else ""), "}" if sign == "{" else "]"))
            label = ("member", []) if sign == "[" else None
        else:
            value = _string(quoted) if quoted else bare
            kind = "" if quoted else value if value in ("true", "false", "null") else "number" if _NUMBER.match(value) else ""
            name = start(kind)
            b.leaf("text", "", value)
            b.end(name)
            label = None
    if opened:
        raise ValueError("not closed")
    return b.done()


# -- writing ------------------------------------------------------------------------------


def written(tokens: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text) of tokens: (doc_id, pre, size, level, before, after), of about so many ``rows``."""
    parts = F.array(
        F.struct(F.col("pre").alias("at"), F.lit(0).alias("end"), F.lit(0).alias("up"), F.col("before").alias("t")),
        F.struct((F.col("pre") + F.col("size")).alias("at"), F.lit(1).alias("end"), (-F.col("level")).alias("up"), F.col("after").alias("t")),
    )
    some = F.filter(parts, lambda x: F.coalesce(x["t"], F.lit("")) != "")
    signs = dealt(tokens.select("doc_id", F.explode_outer(some).alias("x")), 2 * rows, "doc_id")  # a document without tokens keeps a row
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "")
    return signs.groupBy("doc_id").agg(text.alias("text"))


def _with_attributes(nodes: DataFrame, count: int) -> DataFrame:
    """Nodes but for attributes, each with _attributes in order, and _below, how many nodes that are none it has as children."""
    own = F.struct("pre", "name", "value")
    by = dealt(nodes.where("parent is not null").select("doc_id", "parent", "pre", "kind", "name", "value"), count, "doc_id", "parent").groupBy("doc_id", F.col("parent").alias("_of")).agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "attr", own))).alias("_attributes"), F.count(F.when(F.col("kind") != "attr", 1)).alias("_below")
    )
    rows = spread(dealt(nodes.where("kind <> 'attr'"), count, "doc_id", "pre")).alias("n").join(spread(by).alias("b"), (F.col("n.doc_id") == F.col("b.doc_id")) & (F.col("n.pre") == F.col("b._of")), "left")
    return rows.select("n.*", "b._attributes", F.coalesce("b._below", F.lit(0)).alias("_below"))


def markup(nodes: DataFrame, method: str = "xml", escaped: bool = False) -> DataFrame:
    """(doc_id, text): a node table written as ``xml``, ``html`` (void elements have no end) or ``text`` (text nodes only).

    ``escaped`` values have their references in them already, as those of ``parse_written_html``, and are written as they are.
    The nodes are counted first, so they should be a stored table.
    """
    count = nodes.count()
    if method == "text":
        return written(nodes.withColumns({"before": F.when(F.col("kind") == "text", F.col("value")), "after": F.lit(None).cast("string")}), count)
    name, value, own = F.col("name"), F.coalesce("value", F.lit("")), _with_attributes(nodes, count)
    plain = (lambda x: x) if escaped else lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    attributes = F.array_join(F.transform(F.coalesce("_attributes", F.array().cast("array<struct<pre:bigint,name:string,value:string>>")), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), F.replace(plain(a["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    empty = F.col("_below") == 0
    void = name.isin(*sorted(VOID)) if method == "html" else F.lit(False)
    closed = F.lit(False) if method == "html" else empty
    before = (
        F.when(F.col("kind") == "elem", F.concat(F.lit("<"), name, attributes, F.when(closed, "/>").otherwise(">")))
        .when(F.col("kind") == "text", plain(value))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), value, F.lit("-->")))
        .when(F.col("kind") == "pi", F.concat(F.lit("<?"), name, F.lit(" "), value, F.lit("?>")))
    )
    after = F.when((F.col("kind") == "elem") & ~closed & ~void, F.concat(F.lit("</"), name, F.lit(">")))
    return written(own.withColumns({"before": before, "after": after}), count)


def json_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): trees in the form of :func:`json_parser` as JSON; the topmost element has no name."""
    attribute = lambda k: F.get(F.transform(F.filter("_attributes", lambda a: a["name"] == k), lambda a: a["value"]), 0)
    count = nodes.count()
    own = _with_attributes(nodes.where("kind in ('root', 'elem', 'attr', 'text')"), count)
    texts = own.where("kind = 'text'").groupBy("doc_id", F.col("parent").alias("_of")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("_text"))
    elements = own.where("kind = 'elem'").withColumns({"_kind": attribute("type"), "_label": F.coalesce(attribute("name"), F.col("name"))})
    inner = elements.groupBy("doc_id", F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("_elements"))
    e = elements.alias("e")
    for side, columns in ((texts, ["_text"]), (inner, ["_elements"])):
        e = spread(e).join(spread(side).alias("s"), (F.col("e.doc_id") == F.col("s.doc_id")) & (F.col("e.pre") == F.col("s._of")), "left").select("e.*", *[f"s.{c}" for c in columns]).alias("e")
    above = elements.select("doc_id", F.col("pre").alias("_of"), F.col("_kind").alias("_above"), F.lit(True).alias("_inside"))
    e = spread(e).join(spread(above).alias("s"), (F.col("e.doc_id") == F.col("s.doc_id")) & (F.col("e.parent") == F.col("s._of")), "left").select("e.*", "s._above", "s._inside")
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("pre"))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    kind, text = F.coalesce("_kind", F.lit("")), F.coalesce("_text", F.lit(""))
    named = F.col("_inside").isNotNull() & (F.coalesce("_above", F.lit("")) != "array")
    lead = F.concat(F.when(place > 1, ",").otherwise(""), F.when(named, F.concat(quoted(F.col("_label")), F.lit(":"))).otherwise(""))
    scalar = F.when(kind.isin("true", "false", "null"), kind).when(kind == "number", text).otherwise(quoted(text))
    opened = F.when(kind == "array", "[").when(F.col("_elements").isNotNull() | ((F.col("_below") == 0) & ~kind.isin("member", "true", "false", "null", "number")), "{")
    tokens = e.withColumns({"before": F.concat(lead, F.coalesce(opened, scalar)), "after": F.when(opened == "[", "]").when(opened == "{", "}")})
    documents = nodes.where("parent is null").select("doc_id", "pre", "size", "level", F.lit("").alias("before"), F.lit("").alias("after"))
    return written(tokens.select("doc_id", "pre", "size", "level", "before", "after").unionByName(documents), count)


# -- making -------------------------------------------------------------------------------


def copied(nodes: DataFrame, chosen: DataFrame, deep: bool = True) -> DataFrame:
    """A node table of copies of the ``chosen`` nodes (doc_id, pre), in order, below a new root for each document.

    With ``deep`` all that is below comes along; a node below another chosen one comes with each.
    """
    tops = nodes.join(chosen.select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_semi")
    inner = _contained(tops, nodes, "c", "n") if deep else tops.alias("c").join(nodes.alias("n"), (F.col("c.doc_id") == F.col("n.doc_id")) & (F.col("c.pre") == F.col("n.pre")))
    rows = inner.select("n.doc_id", F.col("c.pre").alias("_top"), F.col("c.level").alias("_level"), F.col("n.pre").alias("_pre"), *[f"n.{c}" for c in ("size", "level", "parent", "ord", "kind", "name", "value")])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_top", "_pre")).cast("long")
    rows = rows.withColumn("pre", place).withColumn("_shift", F.col("pre") - F.col("_pre"))
    is_top = F.col("_pre") == F.col("_top")
    rows = rows.withColumns({
        "parent": F.when(is_top, F.lit(0).cast("long")).otherwise(F.col("parent") + F.col("_shift")),
        "ord": F.when(is_top, F.sum(is_top.cast("int")).over(Window.partitionBy("doc_id").orderBy("pre"))).otherwise(F.col("ord")).cast("int"),
        "level": F.col("level") - F.col("_level") + 1, "size": F.col("size") if deep else F.lit(0).cast("long"),
    })
    own = ["doc_id", "pre", "size", "level", "parent", "ord", "kind", "name", "value"]
    roots = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size")).select(
        "doc_id", F.lit(0).cast("long").alias("pre"), "size", F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("ord"), F.lit("root").alias("kind"), F.lit("").alias("name"), F.lit(None).cast("string").alias("value")
    )
    return rows.select(own).unionByName(roots.select(own))


def local_name(name: Column | str = "name") -> Column:
    """A name without its prefix."""
    return F.substring_index(F.col(name) if isinstance(name, str) else name, ":", -1)


def generated_id() -> Column:
    """A text that is the same for the same node only."""
    return F.concat(F.lit("id"), F.col("doc_id").cast("string"), F.lit("."), F.col("pre").cast("string"))


def namespaces(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, prefix, uri): what is in scope at each element; the innermost declaration holds, an empty one ends it."""
    declared = nodes.where("kind = 'attr' and (name = 'xmlns' or name like 'xmlns:%')")
    prefix = F.when(F.col("d.name") == "xmlns", "").otherwise(F.substring_index("d.name", ":", -1))
    at = nodes.where("kind = 'elem'")
    scope = at.alias("e").join(declared.alias("d"), (F.col("e.doc_id") == F.col("d.doc_id")) & (F.col("e.pre") == F.col("d.parent"))).select("e.*", prefix.alias("prefix"), F.col("d.value").alias("uri"))
    below = _contained(scope, at, "c", "n").select("n.doc_id", "n.pre", "c.prefix", "c.uri", F.col("c.level").alias("_level"))
    inner = below.groupBy("doc_id", "pre", "prefix").agg(F.max(F.struct("_level", "uri"))["uri"].alias("uri"))
    return inner.where("uri <> ''")


# -- templates that go on below -----------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """What a template writes before and after what is below, and the mode in which it goes on there (None: it doesn't).

    Of the rules of a mode that match a node, the one of higher precedence holds, then of
    higher priority, then the later one. ``imports`` lets the next lower precedence that
    matches write between ``before`` and what is below, and decide how it goes on.
    """

    match: Column
    before: Column | None = None
    after: Column | None = None
    below: str | None = ""
    mode: str = ""
    priority: float = 0.0
    precedence: int = 0
    imports: bool = False


def _decided(rules: list[Rule], mode: Column) -> tuple[Column, Column, Column]:
    """(before, after, below) of the rule that holds; built-in rules go on below elements in the same mode and write text."""
    text = F.when(F.col("kind") == "text", F.col("value"))
    before, after, below = text, F.lit(None).cast("string"), mode
    nothing = F.lit(None).cast("string")
    for _, r in sorted(enumerate(rules), key=lambda x: (x[1].precedence, x[1].priority, x[0])):  # the last one put on top holds
        hit = (mode == r.mode) & F.coalesce(r.match, F.lit(False))
        own_before, own_after = (nothing if c is None else c.cast("string") for c in (r.before, r.after))
        if r.imports:
            lower = _decided([x for x in rules if x.precedence < r.precedence], mode)
            joined = lambda *c: F.concat(*[F.coalesce(x, F.lit("")) for x in c])
            made = (joined(own_before, lower[0]), joined(lower[1], own_after), lower[2])
        else:
            made = (own_before, own_after, nothing if r.below is None else F.lit(r.below))
        before, after, below = (F.when(hit, m).otherwise(x) for m, x in zip(made, (before, after, below)))
    return before, after, below


def apply_templates(nodes: DataFrame, rules: list[Rule], mode: str = "") -> DataFrame:
    """(doc_id, text): what the rules write from the root of each document on.

    Which nodes are reached, and in which mode, is found from the top down, a level of all
    documents at a time; the levels are stored, so every node is read once. What they write is
    tokens, sorted once.
    """
    columns = [c for c in nodes.columns if c != "_mode"]
    all_ = stored(nodes.where("kind <> 'attr'"), "templates", by=["level"])
    levels = sorted(r[0] for r in all_.select("level").distinct().collect())
    reached = all_.where(F.col("level") == (levels[0] if levels else 0)).withColumn("_mode", F.lit(mode))
    tokens = None
    for d in levels:
        if d != levels[0]:
            above = level.where("_below is not null").select("doc_id", F.col("pre").alias("parent"), F.col("_below").alias("_mode"))  # noqa: F821
            reached = spread(all_.where(F.col("level") == d)).join(spread(above), ["doc_id", "parent"])
        before, after, below = _decided(rules, F.col("_mode"))
        level = stored(reached.select(*columns, "_mode").select("doc_id", "pre", "size", "level", before.alias("before"), after.alias("after"), below.alias("_below")), "templates-level")
        tokens = level if tokens is None else tokens.unionByName(level)
    if tokens is None:
        tokens = reached.select("doc_id", "pre", "size", "level", F.lit("").alias("before"), F.lit("").alias("after"))
    return written(tokens, all_.count())


# -- numbers of nodes ---------------------------------------------------------------------


def numbered(nodes: DataFrame, count: Column, level: str = "single", start: Column | None = None) -> DataFrame:
    """(doc_id, pre, numbers): the numbers of the nodes that ``count`` holds for, as an array.

    ``single``: the place among the siblings that count. ``multiple``: that of each ancestor
    that counts, from the top, and its own. ``any``: how many that count come up to it in the
    document, since the last node for which ``start`` holds.
    """
    counts = F.coalesce(count, F.lit(False))
    if level == "any":
        begins = F.coalesce(start, F.lit(False)).cast("int") if start is not None else F.lit(0)
        rows = nodes.withColumns({"_counts": counts, "_part": F.sum(begins).over(Window.partitionBy("doc_id").orderBy("pre"))})
        n = F.sum(F.col("_counts").cast("long")).over(Window.partitionBy("doc_id", "_part").orderBy("pre"))
        return rows.withColumn("_n", n).where("_counts").select("doc_id", "pre", F.array("_n").alias("numbers"))
    rows = nodes.where(counts).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("pre")).cast("long"))
    if level == "single":
        return rows.select("doc_id", "pre", F.array("_n").alias("numbers"))
    around = _contained(rows, rows, "c", "n").select("n.doc_id", "n.pre", F.struct(F.col("c.pre").alias("p"), F.col("c._n").alias("n")).alias("x"))
    return around.groupBy("doc_id", "pre").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["n"]).alias("numbers"))
