"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is the number of copies that each of its documents should
have on average: all get the whole part, and one more with the fractional part as inclusion
probability. The flight phase walks those probabilities through the null space of two
balancing constraints (documents and words) until each is 0 or 1, so the sample's totals stay
at their expected values. It runs in blocks of a source's documents in parallel (a hot source
has many blocks); the at most two documents that a block leaves open go on to blocks of the
next level, until a source has one block; there the last two or so are landed: of
the possible outcomes the one whose totals are nearest to the targets.

Defined results: a null text has size 0; documents of size 0 are sampled alike and take 0
words; a null source is a source of its own, last in order; ties between ids are broken by a
hash of the row, fully repeated rows by chance of order (they are interchangeable); an empty
table gives an empty result. Reruns agree, as every choice is drawn from hashes of the ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, stored, text_of

#: Documents of a block, about.
BLOCK = 1024
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_id, _source, _size, _hash): the words of each text, and its hash, which tells rows with equal ids apart."""
    n = F.regexp_count(text_of(text_col), F.lit(f"[^{SPACE}]+")).cast("long")
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n.alias("_size"), F.xxhash64(text_of(text_col)).alias("_hash"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_source, _source_size, _docs, _target): one row for each source.

    A source stops at ``cap`` times its size, and what it can't take goes to the others by
    weight: with sources in order of size over weight, a source stops if even with all before
    it stopped its share of the rest passes its cap. Windows over sources, not documents.
    """
    per = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count(F.lit(1)).alias("_docs"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("_source_size") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    stopped = F.coalesce(F.sum("_source_size").over(before), F.lit(0)) * cap
    rest_w = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("_source_size").over(everything) * share
    fair = (total - stopped) / rest_w
    goes_on = fair * F.col("_w") <= F.col("_source_size") * cap
    per = per.withColumn("_level", F.when(goes_on, F.struct(F.row_number().over(order).alias("place"), fair.alias("fair"))))
    level = F.min("_level").over(everything)["fair"]  # of the first source that doesn't stop
    limit = F.col("_source_size") * cap
    return per.select("_source", "_source_size", "_docs", F.coalesce(F.least(limit, level * F.col("_w")), limit).alias("_target"))


def _draws(ids: list, seed: int, level: int) -> np.ndarray:
    """A number in [0, 1) from each id's hash."""
    return np.array([xxhash.xxh64_intdigest(str(i), seed + level) for i in ids], np.float64) / 2.0**64


def flight(p: np.ndarray, words: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Walk inclusion probabilities until at most two are neither 0 nor 1; sum(p) and sum(p * words) stay.

    Three open units have a direction that changes neither total: the cross product of (1, 1, 1)
    and their words. Along it one of two moves, chosen so that each p keeps its mean, settles a unit.
    """
    p = p.astype(float).tolist()
    words = words.astype(float).tolist()
    todo = iter([i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9])
    held: list[int] = []
    while True:
        while len(held) < 3:
            i = next(todo, None)
            if i is None:
                return np.array(p)
            held.append(i)
        a, b, c = held
        u = (words[c] - words[b], words[a] - words[c], words[b] - words[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) if x > 0 else p[i]) / abs(x) for i, x in zip(held, u) if x)
        down = min((p[i] if x > 0 else 1 - p[i]) / abs(x) for i, x in zip(held, u) if x)
        step = up if draws[a] * (up + down) < down else -down
        # the draw is used up; the other units that stay have their own
        for i, x in zip(held, u):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
        still = [i for i in held if 0 < p[i] < 1]
        if len(still) == 3:  # rounding kept all three open: settle the nearest
            near = min(still, key=lambda i: min(p[i], 1 - p[i]))
            p[near] = round(p[near])
            still.remove(near)
        for i in still:
            draws[i] = (draws[i] * 977.0 + draws[a] * 131.0) % 1.0
        held = still


def land(p: np.ndarray, words: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Settle the few open units: the outcome nearest to the expected totals, ties by draw."""
    still = [i for i, x in enumerate(p) if 0 < x < 1]
    best, want = None, (sum(p[i] for i in still), sum(p[i] * words[i] for i in still))
    scale = 1.0 + sum(words[i] for i in still)
    for k in range(2 ** len(still)):
        bits = [k >> j & 1 for j in range(len(still))]
        off = abs(sum(bits) - want[0]) / (len(still) + 1) + abs(sum(b * words[i] for b, i in zip(bits, still)) - want[1]) / scale * 4
        off += 1e-9 * sum(b * draws[i] for b, i in zip(bits, still))
        if best is None or off < best[0]:
            best = (off, bits)
    out = np.array(p)
    out[still] = best[1]
    return out


def _flown(seed: int, level: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.array([xxhash.xxh64_intdigest(str(i), seed) for i in pdf["_id"]], np.uint64)
        pdf = pdf.iloc[np.lexsort((pdf["_hash"].to_numpy(), order))]
        draws, words = _draws(pdf["_id"].tolist(), seed + 1, level), pdf["_size"].to_numpy()
        p = flight(pdf["_p"].to_numpy(), words, draws)
        if pdf["_blocks"].iloc[0] == 1:
            p = land(p, words, draws)
        return pdf.assign(_p=p, _open=(p > 0) & (p < 1))

    return f


def cube_sample(sized: DataFrame, goals: DataFrame, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """``sized`` with its source's size and target and _copies, the number of times that each document is taken.

    ``goals`` should be a stored table: its known size lets Spark broadcast it if it is small,
    and else split a hot source's rows.
    """
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    rows = sized.alias("s").join(goals.alias("g"), F.col("s._source").eqNullSafe(F.col("g._source")))
    rows = rows.withColumn("_whole", F.floor(rate + 1e-12)).withColumn("_p", F.greatest(F.lit(0.0), rate - F.col("_whole")))
    rows = rows.select(
        "_id", "_hash", F.col("s._source").alias("_source"), "_size", "_source_size", "_target", "_whole", "_p",
        (F.col("_p") > 0).alias("_open"), F.ceil(F.col("_docs") / block).alias("_blocks"),
    )
    # Each block leaves two documents open at most, so the sizes of all levels follow from the first.
    blocks = -(-(goals.agg(F.max("_docs")).first()[0] or 0) // block) or 1
    done, level = [], 0
    while True:
        place = F.pmod(F.xxhash64(F.col("_id").cast("string"), "_hash", F.lit(seed + level)), F.col("_blocks")).alias("_block")
        flew = stored(rows.groupBy("_source", place).applyInPandas(_flown(seed, level), rows.schema), "mix-flight")
        done.append(flew.where(~F.col("_open")))
        if blocks == 1:
            break
        rows, level, blocks = flew.where("_open").withColumn("_blocks", F.ceil(F.col("_blocks") * 2 / block)), level + 1, -(-blocks * 2 // block)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("_copies", (F.col("_whole") + F.round("_p")).cast("long")).drop("_whole", "_p", "_open", "_blocks")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(_id, _source, _size, _source_size, _target, _copies): one row for each document."""
    sized = stored(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    return cube_sample(sized, stored(targets(sized, weights, share, cap), "mix-goals"), block, seed)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, as many times as the mix takes each."""
    same = ["_id", "_source", "_hash"]  # rows equal in these are interchangeable, and are counted through
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("_hash")).alias("_nth")
    copies = mix(docs, id_col, text_col, source_col, **how).select(*same, "_copies", nth).where("_copies > 0")
    own = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.xxhash64(text_of(text_col)).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    ).select("*", nth)
    on = F.lit(True)
    for c in (*same, "_nth"):
        on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}"))
    taken = own.alias("o").join(copies.alias("c"), on)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_time")).select("_row.*")
