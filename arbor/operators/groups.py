"""Grouping: totals with grand totals, first of each group, joined strings, group extremes, moving events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import total
from ..shared import dealt, discard, spread, stored


def first_of_group(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Each key's first row in document order."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_at = 1").drop("_at")


def totals(df: DataFrame, keys: list[str], value: str, grand: bool = True) -> DataFrame:
    """Sum and count for each combination of keys, and with ``grand`` for each level above."""
    grouped = df.rollup(*keys) if grand else df.groupBy(*keys)
    return grouped.agg(total(value).alias("total"), F.count(F.lit(1)).alias("n"))


def joined_text(df: DataFrame, key: list[str], value: str, mark: str, order: list[str]) -> DataFrame:
    """Each key's values that aren't empty, in order, with ``mark`` between."""
    items = F.array_sort(F.collect_list(F.when(F.col(value) != "", F.struct(*order, F.col(value).alias("_v")))))
    return df.groupBy(*key).agg(F.array_join(F.transform(items, lambda x: x["_v"]), mark).alias("joined"))


def extremes(df: DataFrame, key: list[str], value: str, largest: bool = True) -> DataFrame:
    """All rows of each key that have its largest (or smallest) value."""
    order = F.desc(value) if largest else F.asc(value)
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*key).orderBy(order))).where("_rank = 1").drop("_rank")


#: Nodes of a strand that meet those of another under one key, and the pairs from which joins are dealt out by pairs, as few rows make many.
BLOCK, DEALT = 1024, 20_000_000


def reachable(links: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target) of all paths along the links, whatever their length; cycles end too.

    Links that are the only one out of their source and into their target string nodes to strands,
    in which a node reaches all that follow. Other links go from the end of a strand to the start
    of one, and only which strands these reach is found as pairs. Pairs of nodes are made last, each
    once, by joins that send a node once for each ``BLOCK`` nodes that it may reach; so chains,
    however many pairs they have, are never shuffled or stored as pairs. A null is no node: links
    end there, and those from there have no link before them. Lineage ends in stored tables.
    """
    links = stored(links.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct(), "reachable")
    out = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    into = links.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).where("n = 1").select("a", "b")
    only = stored(spread(out).join(spread(into), ["a", "b"], "left_semi"), "reachable-only")
    nodes = _strands(links, only)
    named = spread(nodes.select(F.col("v").alias("b"), F.col("strand").alias("t")))
    between = spread(links).join(spread(only), ["a", "b"], "left_anti").join(named, "b", "left").select(F.col("a").alias("s"), "t")  # a strand has the name of its end
    return _expanded(nodes, _reached(between.distinct())).select(F.col("a").alias(source), F.col("b").alias(target))


def _strands(links: DataFrame, only: DataFrame) -> DataFrame:
    """(v, strand, at, block, loop) of each node: its strand's name (a node's), and how many of it follow; in loops all do.

    A round doubles how far a node sees. It ends when all see their strand's end, or those that
    don't see nothing new: they are in loops, and the least node that each has seen is its loop's.
    """
    after = only.select(F.col("a").alias("b"), F.lit(True).alias("goes_on"))
    known = spread(only).join(spread(after), "b", "left")
    known = stored(known.select(F.col("a").alias("v"), F.col("b").alias("to"), F.lit(1).cast("long").alias("n"), F.col("a").alias("low"), F.col("goes_on").isNull().alias("done"), F.lit(True).alias("new")), "reachable-seen")
    left, more = -1, known.where("NOT done").count()
    while more:
        then = known.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        new = spread(known.where("NOT done").select("v", "to", "n", "low")).join(spread(then), "to")
        new = new.select("v", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"), (F.col("low2") < F.col("low")).alias("new"))
        last, known = known, stored(known.where("done").unionByName(new), "reachable-seen")
        discard(last)
        left, (more, changed) = more, known.where("NOT done").agg(F.count(F.lit(1)), F.coalesce(F.max("new"), F.lit(False))).first()
        if more == left and not changed:
            break
    size = known.where("NOT done").groupBy("low").agg(F.count(F.lit(1)).alias("size"))
    loops = spread(known.where("NOT done")).join(spread(size), "low").select("v", F.col("low").alias("strand"), F.pmod(F.xxhash64("v"), F.col("size")).alias("at"), F.lit(True).alias("loop"))
    strung = known.where("done").select("v", F.col("to").alias("strand"), F.col("n").alias("at"), F.lit(False).alias("loop")).unionByName(loops)
    every = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).where("v IS NOT NULL").distinct()
    at = F.coalesce("at", F.lit(0).cast("long"))
    nodes = spread(every).join(spread(strung), "v", "left")
    return stored(nodes.select("v", F.coalesce("strand", "v").alias("strand"), at.alias("at"), F.floor(at / BLOCK).alias("block"), F.coalesce("loop", F.lit(False)).alias("loop")), "reachable-nodes")


def _reached(links: DataFrame) -> DataFrame:
    """(s, t) of all paths along distinct links.

    Pairs are known with the length of the shortest path. After k rounds all of at most n = 2 ** k
    are; a round joins those of exactly n, which are few, with all that are known, and so finds
    those up to 2 n. A shortest path has one node at n, so along chains every pair is found once,
    and the work is about as much as there are pairs. It goes on until none has the length n.
    """
    found = stored(links.select("s", "t", F.lit(1).cast("long").alias("n")), "reachable-strands")
    far, new = 1, found
    while not (longest := new.where(F.col("n") == far)).isEmpty():
        step = found.select(F.col("s").alias("t"), F.col("t").alias("u"), F.col("n").alias("m"))
        new = spread(longest.select("s", "t")).join(spread(step), "t").groupBy("s", F.col("u").alias("t")).agg(F.min(F.col("m") + far).alias("n"))
        same = F.col("new.s").eqNullSafe(F.col("found.s")) & F.col("new.t").eqNullSafe(F.col("found.t"))
        new = stored(spread(new).alias("new").join(spread(found).alias("found"), same, "left_anti"), "reachable-strands")
        found, far = found.unionByName(new), 2 * far
    return found.select("s", "t")


def _expanded(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(a, b) of all nodes of strands that reach each other, and of those that follow within a strand."""
    strands = stored(nodes.groupBy("strand").agg(F.count(F.lit(1)).alias("size"), F.max("block").alias("last"), F.max("loop").alias("loop")), "reachable-sizes")
    around = reached.where("s = t").select(F.col("s").alias("strand"))
    own = spread(strands.where("loop OR size > 1")).join(spread(around), "strand", "left_anti")
    ways = own.select(F.col("strand").alias("s"), F.col("strand").alias("t"), (~F.col("loop")).alias("ordered")).unionByName(reached.withColumn("ordered", F.lit(False)))
    for end, block in (("s", "x"), ("t", "y")):  # few strands have more than one block
        long = strands.where("last > 0").select(F.col("strand").alias(end), "last")
        ways = ways.join(long, end, "left").withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long"))))).drop("last")
    ways = ways.where("NOT ordered OR x >= y")
    pairs = (strands.agg(F.sum(F.col("size") * F.col("size"))).first()[0] or 0) + reached.count()
    deal = lambda df, *keys: spread(dealt(df, pairs, *keys) if pairs > DEALT else df)
    ends = lambda *names: nodes.select(*[F.col(c).alias(n) for c, n in zip(("strand", "block", "v", "at"), names)])
    # Left joins keep what has a null end, which is no node.
    met = deal(ways, "s", "x").join(deal(ends("s1", "x1", "a", "at"), "s1", "x1"), F.expr("s = s1 AND x = x1"), "left").where("s IS NULL OR s1 IS NOT NULL")
    met = met.select("a", "at", "t", "y", "ordered")
    on = F.expr("t = t1 AND y = y1 AND (NOT ordered OR at > at1)")
    return deal(met, "t", "y").join(deal(ends("t1", "y1", "b", "at1"), "t1", "y1"), on, "left").where("t IS NULL OR t1 IS NOT NULL").select("a", "b")
