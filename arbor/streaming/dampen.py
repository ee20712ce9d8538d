"""A rate limiter: at most so many accepted events of a name within a period.

Whether an event is accepted depends on which were accepted before it, so it is a state of
each name: the times of the last accepted events, at most the limit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def accept(times, most: int, period: float, recent) -> tuple[list[bool], list]:
    """Which of the times, in order, are accepted after the ``recent`` ones, and the new recent ones."""
    out, recent = [], deque(recent)
    for t in times:
        while recent and t - recent[0] >= period:
            recent.popleft()
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out, list(recent)


def _stretches(events: DataFrame, key: str, period: int) -> DataFrame:
    """``events`` with _stretch: between two of them nothing happens for a whole period, so no state is carried on.

    A stretch ends where a period-long slot of time has no event: found by counts of slots, not by a pass over a name's events.
    """
    placed = events.withColumn("_slot", F.floor(F.col("_micros") / period))
    slots = placed.groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_at")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("_key").orderBy("_at")
    slots = slots.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(by) > 1).cast("int"), F.lit(1)))
    slots = slots.select("_key", "_at", F.sum("_new").over(by).alias("_stretch"))
    return placed.join(slots, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at"))).drop("_slot", "_key", "_at")


def dampen(events: DataFrame, key: str, time: str, most: int, period: float, order: list[str] | None = None) -> DataFrame:
    """``events`` with ``accepted``.

    Each stretch of a name's events, between silences of a period, is a key of its own. Spark
    sorts its events, which pass through in batches; only the times of the last accepted ones are held.
    """
    order, micros = order or [], round(period * 1e6)
    dealt = _stretches(events.withColumn("_micros", F.expr(f"unix_micros(cast({time} as timestamp))")), key, micros)
    dealt = dealt.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "_micros", *order)
    schema = T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType())])

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, []
        for pdf in batches:
            accepted = []
            names = list(zip(pdf[key].astype(object).where(pdf[key].notna(), None), pdf["_stretch"]))
            for name, run in groupby(zip(names, pdf["_micros"].tolist()), key=itemgetter(0)):
                if name != last:
                    last, recent = name, []
                some, recent = accept((t for _, t in run), most, micros, recent)
                accepted += some
            yield pdf.drop(columns=["_micros", "_stretch"]).assign(accepted=accepted)

    return dealt.select(*events.columns, "_micros", "_stretch").mapInPandas(passed, schema)


def dampen_stream(events: DataFrame, key: str, time: str, most: int, period: float) -> DataFrame:
    """The same for a stream: (key, time, accepted), with the accepted times of each name as state."""
    kind = events.schema[key].dataType.simpleString()

    def step(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(time)
        accepted, recent = accept([t.timestamp() for t in rows[time]], most, period, recent)
        state.update((recent,))
        yield pd.DataFrame({key: rows[key], time: rows[time], "accepted": accepted})

    schema = f"`{key}` {kind}, `{time}` timestamp, accepted boolean"
    typed = events.select(key, F.col(time).cast("timestamp").alias(time))
    return typed.groupBy(key).applyInPandasWithState(step, schema, "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str, late: str, size: str, slide: str | None, keys: list[str], value: str) -> DataFrame:
    """Counts and sums in event-time windows; with a stream, ``late`` is how long windows wait."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return marked.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    """Counts in sessions that end after ``gap`` without an event."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
