"""Documents as tables of nodes: (doc_id, pre, size, level, parent, ord, kind, name, value).

``pre`` is a node's place in document order, ``size`` how many rows are below it (attributes
have places too); with them every axis is a comparison of two rows, and so a join. Texts are parsed
where they lie, a batch of documents at a time, by the parsers of Python's library; whatever
follows is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import dealt, spread

SCHEMA = "doc_id long, pre long, size long, level int, parent long, ord int, kind string, name string, value string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: HTML elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Builder:
    """Rows of one document, from a parser's events."""

    def __init__(self, doc_id: int):
        self.doc_id, self.rows, self.open = doc_id, [], []
        self._add("root", "", None)
        self.open.append(0)
        self.children = [0]

    def _add(self, kind: str, name: str, value: str | None) -> int:
        parent = self.open[-1] if self.open else None
        if self.open:
            self.children[-1] += 1
        place = self.children[-1] if self.open else 1
        self.rows.append([self.doc_id, len(self.rows), 0, len(self.open), parent, place, kind, name, value])
        return len(self.rows) - 1

    def start(self, name: str, attributes: list[tuple[str, str | None]]) -> None:
        self.open.append(self._add("elem", name, None))
        self.children.append(0)
        for k, v in attributes:
            place = len(self.rows)
            self.rows.append([self.doc_id, place, 0, len(self.open), self.open[-1], 0, "attr", k, v or ""])

    def end(self, name: str) -> None:
        names = [self.rows[i][7] for i in self.open]
        if name in names[1:]:  # an end tag closes what is still open within
            while True:
                i = self.open.pop()
                self.children.pop()
                if self.rows[i][7] == name:
                    break

    def leaf(self, kind: str, name: str, value: str) -> None:
        last = self.rows[-1]
        if kind == "text" and last[6] == "text" and last[4] == self.open[-1]:
            last[8] += value
        elif value or kind != "text":
            self._add(kind, name, value)

    def done(self) -> list[list]:
        for row in reversed(self.rows):
            if row[4] is not None:
                self.rows[row[4]][2] += row[2] + 1
        return self.rows


def parse_xml(doc_id: int, text: str, comments: bool = True) -> list[list]:
    """The nodes of an XML text; entities from outside and declared ones aren't expanded."""
    b, p = _Builder(doc_id), expat.ParserCreate()
    p.ordered_attributes, p.buffer_text = True, True
    p.StartElementHandler = lambda n, a: b.start(n, list(zip(a[::2], a[1::2])))
    p.EndElementHandler = b.end
    p.CharacterDataHandler = lambda t: b.leaf("text", "", t)
    if comments:
        p.CommentHandler = lambda t: b.leaf("comment", "", t)
    p.ProcessingInstructionHandler = lambda n, t: b.leaf("pi", n, t)

    def refuse(*_: object) -> None:
        raise ValueError("entity declarations are refused")

    p.EntityDeclHandler = refuse
    p.Parse(text, True)
    return b.done()


class _Html(HTMLParser):
    """Events for a builder; a ``mark`` stands for the signs & that begin no reference."""

    def __init__(self, builder: _Builder, mark: str | None):
        super().__init__(convert_charrefs=True)
        self.b, self.mark = builder, mark

    def _plain(self, text: str | None) -> str | None:
        return text.replace(self.mark, "&") if self.mark and text else text

    def handle_starttag(self, tag, attrs):
        tag = self._plain(tag)
        self.b.start(tag, [(self._plain(k), self._plain(v)) for k, v in attrs])
        if tag in VOID:
            self.b.end(tag)

    def handle_startendtag(self, tag, attrs):
        tag = self._plain(tag)
        self.b.start(tag, [(self._plain(k), self._plain(v)) for k, v in attrs])
        self.b.end(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.b.end(self._plain(tag))

    def handle_data(self, data):
        self.b.leaf("text", "", self._plain(data))

    def handle_comment(self, data):
        self.b.leaf("comment", "", self._plain(data))


def parse_html(doc_id: int, text: str, references: bool = True) -> list[list]:
    """The nodes of an HTML text. Without ``references`` no &amp; and the like is resolved: values are as they were written."""
    b = _Builder(doc_id)
    mark = None if references else next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in text)  # first those that no text has
    parser = _Html(b, mark)
    parser.feed(text.replace("&", mark) if mark else text)
    parser.close()
    return b.done()


#: HTML as it was written, for what goes back to HTML.
parse_written_html = partial(parse_html, references=False)


def encode(df: DataFrame, id_col: str, text_col: str, parser=parse_html) -> DataFrame:
    """The node table of the documents in ``text_col``; a null text is a document without content."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += parser(doc_id, text or "") if text else _Builder(doc_id).done()
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(parsed, SCHEMA)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=NAMES)


def from_levels(levels: list[tuple[DataFrame, str]], doc: str, keys: list[str], rows: int | None = None) -> DataFrame:
    """A node table of nested tables: each (rows, name) is one level further down.

    A row at depth d has the document id ``doc`` and the first d of ``keys``, in which the
    levels nest; its deeper keys are null. Documents are windows of their own, and all windows
    are over one order, so a task sorts its rows once. ``rows``, about how many there are in
    all, says into how many tasks they are dealt.
    """
    parts = []
    for depth, (own_rows, name) in enumerate(levels):
        own = [F.col(k).cast("long").alias(k) if i < depth else F.lit(None).cast("long").alias(k) for i, k in enumerate(keys)]
        parts.append(own_rows.select(F.col(doc).cast("long").alias("doc_id"), *own, F.lit(depth).alias("level"), F.lit(name).alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if rows is not None:
        out = dealt(out, rows, "doc_id")
    in_order = Window.partitionBy("doc_id").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("level")
    out = out.withColumn("pre", F.row_number().over(in_order) - 1)
    above = {f"_above{d}": F.last(F.when(level == d, F.col("pre")), ignorenulls=True).over(upto) for d in range(len(levels) - 1)}
    so_far = {f"_far{d}": F.sum((level == d).cast("int")).over(upto) for d in range(len(levels))}
    out = out.withColumns(above | so_far)
    parent, place, size = F.lit(None).cast("long"), F.lit(1), F.lit(0).cast("long")
    for d in range(1, len(levels)):
        parent = F.when(level == d, F.col(f"_above{d - 1}")).otherwise(parent)
        # how many of the level came before the node above
        before = F.last(F.when(level == d - 1, F.col(f"_far{d}")), ignorenulls=True).over(upto)
        place = F.when(level == d, F.col(f"_far{d}") - F.coalesce(before, F.lit(0))).otherwise(place)
    place = F.when(level == 0, F.col("_far0")).otherwise(place)
    for d in range(len(levels)):
        below = F.count(F.lit(1)).over(Window.partitionBy("doc_id", *keys[:d])) - 1
        size = F.when(level == d, below).otherwise(size)
    out = out.withColumns({"_parent": parent, "_place": place, "size": size})
    return out.select("doc_id", F.col("pre").cast("long").alias("pre"), "size", "level", F.col("_parent").cast("long").alias("parent"), F.col("_place").cast("int").alias("ord"), F.lit("elem").alias("kind"), "name", *keys)


#: Places of a bucket in which containing and contained nodes meet.
BUCKET = 64


def _pair(context: DataFrame, nodes: DataFrame, on) -> DataFrame:
    return spread(context).alias("c").join(spread(nodes).alias("n"), (F.col("c.doc_id") == F.col("n.doc_id")) & on(F.col))


def _contained(outer: DataFrame, inner: DataFrame, o: str, i: str) -> DataFrame:
    """Pairs of nodes where ``outer``'s span of places holds ``inner``'s place; aliases o and i.

    A span is posted in each bucket of places that it touches, so that an inner node meets
    those around it only, and one large document is as many keys as it has buckets.
    """
    last = F.floor((F.col("pre") + F.col("size")) / BUCKET)
    posted = outer.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("pre") / BUCKET), last)))
    placed = inner.withColumn("_bucket", F.floor(F.col("pre") / BUCKET))
    holds = (F.col(f"{o}.pre") <= F.col(f"{i}.pre")) & (F.col(f"{i}.pre") <= F.col(f"{o}.pre") + F.col(f"{o}.size"))
    return spread(posted).alias(o).join(spread(placed).alias(i), (F.col(f"{o}.doc_id") == F.col(f"{i}.doc_id")) & (F.col(f"{o}._bucket") == F.col(f"{i}._bucket")) & holds)


def _no_attribute(c) -> Column:
    return c("n.kind") != "attr"


#: The axes: when a node n is on the axis of a context node c of the same document.
AXES = {
    "self": lambda c: c("n.pre") == c("c.pre"),
    "child": lambda c: (c("n.parent") == c("c.pre")) & _no_attribute(c),
    "attribute": lambda c: (c("n.parent") == c("c.pre")) & (c("n.kind") == "attr"),
    "parent": lambda c: c("n.pre") == c("c.parent"),
    "descendant": lambda c: (c("n.pre") > c("c.pre")) & (c("n.pre") <= c("c.pre") + c("c.size")) & _no_attribute(c),
    "descendant-or-self": lambda c: (c("n.pre") >= c("c.pre")) & (c("n.pre") <= c("c.pre") + c("c.size")) & (_no_attribute(c) | (c("n.pre") == c("c.pre"))),
    "ancestor": lambda c: (c("n.pre") < c("c.pre")) & (c("c.pre") <= c("n.pre") + c("n.size")),
    "ancestor-or-self": lambda c: (c("n.pre") <= c("c.pre")) & (c("c.pre") <= c("n.pre") + c("n.size")),
    "following": lambda c: (c("n.pre") > c("c.pre") + c("c.size")) & _no_attribute(c),
    "preceding": lambda c: (c("n.pre") + c("n.size") < c("c.pre")) & _no_attribute(c),
    "following-sibling": lambda c: (c("n.parent") == c("c.parent")) & (c("n.pre") > c("c.pre")) & _no_attribute(c) & (c("c.kind") != "attr"),
    "preceding-sibling": lambda c: (c("n.parent") == c("c.parent")) & (c("n.pre") < c("c.pre")) & _no_attribute(c) & (c("c.kind") != "attr"),
}
REVERSE = {"parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}


def _found(context: DataFrame, nodes: DataFrame, axis: str) -> DataFrame:
    """All pairs (c, n) of an axis: as many rows as the axis has nodes."""
    if axis.startswith("descendant"):
        return _contained(context, nodes, "c", "n").where(AXES[axis](F.col))
    if axis.startswith("ancestor"):
        return _contained(nodes, context, "n", "c").where(AXES[axis](F.col))
    return _pair(context, nodes, AXES[axis])


def _nearest(context: DataFrame, nodes: DataFrame, axis: str, test: Column | None, upto: int) -> DataFrame:
    """(doc_id, context, pre, name, position): the first ``upto`` nodes of an axis, without making the others.

    Nodes and contexts of a document pass in one order, in which the nodes on the axis of a
    context come before it: for ``preceding`` nodes by their ends, for the others nodes
    backwards by their places. Of those that have passed the nearest are kept: a running maximum;
    what loses against it is a stream whose running maximum is the second, and so on. Each node
    and each context is one narrow row of one shuffle and one sort, however many pairs there are.
    """
    back = axis == "preceding"
    end = F.col("pre") + F.col("size")
    counts = _no_attribute(F.col) if test is None else _no_attribute(F.col) & F.coalesce(test, F.lit(False))
    near = F.struct(F.when(F.lit(back), F.col("n.pre")).otherwise(-F.col("n.pre")).alias("near"), F.col("n.pre").alias("pre"), F.col("n.name").alias("name"))
    passing = nodes.alias("n").where(counts).select("n.doc_id", (F.col("n.pre") + F.col("n.size") if back else F.col("n.pre")).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("long").alias("pre"), F.lit(None).cast("long").alias("end"), near.alias("x"))
    asking = context.select("doc_id", (end if axis == "following" else F.col("pre")).alias("at"), F.lit(0).alias("turn"), "pre", end.alias("end"), F.lit(None).cast(passing.schema["x"].dataType).alias("x"))
    rows = dealt(passing.unionByName(asking), 2 * nodes.count(), "doc_id")
    # a node at a context's own place passes after it
    before = Window.partitionBy("doc_id").orderBy(F.asc("at") if back else F.desc("at"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(upto):
        rows = rows.withColumn(f"_most{k}", F.max("x").over(before))
        most = F.col(f"_most{k}")
        rows = rows.withColumn("x", F.when(most.isNotNull() & F.col("x").isNotNull(), F.least("x", most)))
    found = rows.where("turn = 0").select("doc_id", F.col("pre").alias("context"), "end", F.posexplode(F.array(*[f"_most{k}" for k in range(upto)])).alias("_at", "x"))
    found = found.where(F.col("x").isNotNull() if axis != "descendant" else F.col("x.pre") <= F.col("end"))
    return found.select("doc_id", "context", F.col("x.pre").alias("pre"), F.col("x.name").alias("name"), (F.col("_at") + 1).cast("int").alias("position"))


def step(context: DataFrame, nodes: DataFrame, axis: str, test: Column | None = None, upto: int | None = None) -> DataFrame:
    """(doc_id, context, pre, position...) of the nodes on an axis, with their place, which reverse axes count backwards.

    With ``upto`` only the first so many for each context, which take no more work than there are.
    """
    if upto is not None and axis in ("descendant", "following", "preceding"):
        return _nearest(context, nodes, axis, test, upto)
    if upto is not None and axis.endswith("-sibling") and test is None:
        sign = 1 if axis == "following-sibling" else -1
        moved = context.withColumn("_wanted", F.explode(F.array(*[F.col("ord") + sign * k for k in range(1, upto + 1)])))
        found = _pair(moved, nodes, lambda c: AXES[axis](c) & (c("c._wanted") == c("n.ord")))
    else:
        found = _found(context, nodes, axis)
    if test is not None:
        found = found.where(test)
    order = F.desc("n.pre") if axis in REVERSE else F.asc("n.pre")
    place = F.row_number().over(Window.partitionBy("c.doc_id", "c.pre").orderBy(order))
    out = found.select(F.col("c.doc_id").alias("doc_id"), F.col("c.pre").alias("context"), F.col("n.pre").alias("pre"), F.col("n.name").alias("name"), place.alias("position"))
    return out if upto is None else out.where(F.col("position") <= upto)


def string_values(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, pre, text): each element's descendant text in document order."""
    found = _contained(elements, nodes.where("kind = 'text'"), "c", "n")
    parts = F.array_sort(F.collect_list(F.struct(F.col("n.pre").alias("p"), F.col("n.value").alias("v"))))
    joined = found.groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.pre").alias("pre")).agg(F.array_join(F.transform(parts, lambda x: x["v"]), "").alias("text"))
    return spread(elements.select("doc_id", "pre")).join(spread(joined), ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("text", F.lit("")).alias("text"))


def stripped(nodes: DataFrame) -> DataFrame:
    """Without text that is only white space."""
    return nodes.where(~((F.col("kind") == "text") & (F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", "")) == "")))
