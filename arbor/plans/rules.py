"""Rules over nodes: the rule that a row matches, and rulebooks whose states depend on what is above."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import spread, stored


@dataclass(frozen=True)
class Template:
    """A pattern and what it makes; of several that match, the higher precedence, then priority, then the later wins."""

    name: str
    match: Column
    make: Column
    priority: float = 0.0
    precedence: int = 0


def apply_templates(df: DataFrame, templates: list[Template], otherwise: Column, rule: str = "rule", result: str = "result") -> DataFrame:
    """Adds the name of each row's winning template and what it makes: one CASE over all rows."""
    ranked = sorted(enumerate(templates), key=lambda t: (t[1].precedence, t[1].priority, t[0]), reverse=True)
    name, made = None, None
    for _, t in ranked:
        hit = F.coalesce(t.match, F.lit(False))
        name = F.when(hit, t.name) if name is None else name.when(hit, t.name)
        made = F.when(hit, t.make) if made is None else made.when(hit, t.make)
    if name is None:
        return df.withColumns({rule: F.lit("built-in"), result: otherwise})
    return df.withColumns({rule: name.otherwise("built-in"), result: made.otherwise(otherwise)})


def rule_table(spark, rules: list[tuple[str, str, str, str | None, str | None]]) -> DataFrame:
    """(state, tag, action, new_state, use_tag) of a rulebook."""
    return spark.createDataFrame(rules, "state string, tag string, action string, new_state string, use_tag string")


def apply_rulebook(nodes: DataFrame, rules: list[tuple[str, str, str, str | None, str | None]], start: str, default: str = "discard") -> DataFrame:
    """Adds to each element its state, action and tag; ``nodes`` has doc_id, pre, parent, level, name.

    Of rules with the same state and tag the first holds. The state of an element's children is
    its rule's new state, or its own; so states are found from the top down, a level of all
    documents at a time. The elements are stored by level and each level's states are stored,
    so that the work is linear: every element is read once, and joined to its parent's level.
    Rules are a few rows and broadcast; levels never are.
    """
    first = rule_table(nodes.sparkSession, list({r[:2]: r for r in reversed(rules)}.values()))

    def ruled(df: DataFrame) -> DataFrame:
        hit = df.join(F.broadcast(first.withColumnRenamed("tag", "name")), ["state", "name"], "left")
        return hit.select("doc_id", "pre", "level", "name", "state", F.coalesce("action", F.lit(default)).alias("action"), F.coalesce("use_tag", "name").alias("use_tag"), F.coalesce("new_state", "state").alias("below"))

    elements = stored(nodes.where("kind = 'elem'").select("doc_id", "pre", "parent", "level", "name"), "rulebook-nodes", by=["level"])
    levels = sorted(r[0] for r in elements.select("level").distinct().collect())
    level = ruled(elements.where(F.col("level") == (levels[0] if levels else 0)).withColumn("state", F.lit(start)))
    out = level = stored(level, "rulebook")
    for d in levels[1:]:
        above = level.select("doc_id", F.col("pre").alias("parent"), F.col("below").alias("state"))
        level = stored(ruled(spread(elements.where(F.col("level") == d)).join(spread(above), ["doc_id", "parent"])), "rulebook")
        out = out.unionByName(level)
    return out.drop("below")
