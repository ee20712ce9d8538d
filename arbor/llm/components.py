"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every end of ``links`` (a, b): comp is the smallest end that can be reached.

    Each round every end takes the smallest label among its neighbours' (partial minima are
    taken before the shuffle, so a hub's links need not meet in one task) and then its label's
    label; the rounds needed grow with the logarithm of a component's width, not its size.
    Nothing is collected but one count a round.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("low"))
        lower = labels.join(near, "v").select("v", F.col("comp").alias("was"), F.least("comp", "low").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("comp").alias("further"))
        moved = stored(lower.join(jump, "to", "left").select("v", F.least("to", "further").alias("comp"), "was"), "cc-labels")
        labels = moved.select("v", "comp")
        if not moved.where("comp <> was").limit(1).count():
            return labels
