"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base detectors find e-mail addresses, IPv4 addresses, card and phone numbers of strict form.
High-recall generators propose further spans (which overlap each other and the base spans)
as candidates of a kind, each with yes/no features of its format and its context. A candidate
is right if a base span of its kind overlaps it, and wrong if only one of another kind does or
its format or context is contrary to the kind (``CONTRARY``). The others, look-alikes that no
base rule covers, are not counted as wrong: boosted trees of depth two, one set for each kind,
learn from the right and the wrong ones of all documents and judge the look-alikes. The marks
of a kind's base form (``MARKS``, as the + of a phone number) are no features of that kind.
What is gathered is one count for each combination of features (at most 2**13 times kind,
label and fold, whatever the input's size), and what is used is a column of nested conditions.
Each round leaves out every third feature in turn, so that none decides alone. A kind's
threshold is the lowest score at which the labelled candidates above it are right to
``PRECISION``, by scores of trees that learned without the document's fold (crc32 of the id);
look-alikes that reach it and overlap no base span are added.

Defined results: null and empty texts have no spans; starts and ends count code points, ends
are exclusive; rows with the same id are searched one by one; without any base span of a kind
nothing of that kind is added, nor with base spans in the documents of one fold only; an empty table gives an empty result; only the id and text
columns are read, so others can't clash.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no text makes them slow: runs are taken whole (++) and
#: begin only where a run begins or the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What proposes candidates: the pattern, and the kinds proposed.
GENERATORS = {
    "address": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| \. | ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)*+", ("email",)),
    "number": (r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().+-]{0,2}[0-9])++", ("ip", "card", "phone")),
}
#: Features of a candidate, of its value v, digits d, and what stands before (b) and after (a) it.
FEATURES = {
    "plus": "startswith(v, '+') or startswith(v, '(+')",
    "parens": "v rlike '[(].*[)]'",
    "separated": "v rlike '[0-9][ -]'",
    "dotted": "v rlike '[.]'",
    "at": "contains(v, '@')",
    "few": "length(d) < 10",
    "many": "length(d) > 12",
    "too_many": "length(d) > 19",
    "checks": "luhn",
    "octets": "v rlike '^(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[.](?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$'",
    "glued": "b rlike '[A-Za-z0-9_=\"/]$' or a rlike '^[A-Za-z0-9_\"/]'",
    "named": "lower(b) rlike '(?:tel|phone|call|mobile|fax|mail|card|visa|credit|addr|contact|host|ip)[a-z]{0,8}[ :=.]{0,3}$'",
    "shaped": r"v rlike r'(?:[^ ]\.| \. | ?(?:\(dot\)|\[dot\]) ?)[A-Za-z]{2,}$' or v rlike r'^[+(]{0,2}(?:[0-9]{1,3}[)]?[ .-]{1,2})?[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$'",
}
#: The features of a kind that are marks of its base form: all base spans have them, or none.
MARKS = {"email": ("at", "dotted", "parens", "separated"), "ip": ("octets", "separated"), "card": ("separated", "dotted"), "phone": ("plus",)}
_TOLD = {
    "ip": r"lower(b) rlike r'(?:^|[^a-z])(?:ip|host|addr)[a-z]{0,8}[ :=.]{0,3}$'",
    "phone": r"lower(b) rlike r'(?:^|[^a-z])(?:tel|phone|call|mobile|fax|contact)[a-z]{0,8}[ :=.#]{0,4}(?:(?:me|us|at|on|number)[ :]{1,2}){0,2}$'",
}
_DATE = "v rlike '^(?:[0-9]{4}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ][0-9]{4})(?:[^0-9].*)?$'"
#: Phone numbers without +: a trunk or exit code, an area code in brackets, or groups of 3, 3 and 4.
_DIALLED = f"v rlike '^[(]?(?:00|0[1-9])[0-9]*[)]?[ .-]' or v rlike '[(](?!19|20)[0-9]{{2,5}}[)][ .-]?[0-9]' or {FEATURES['shaped']}"
#: Format or context that speaks against a kind; all else that no base span covers may be of it.
CONTRARY = {
    "email": f"not ({FEATURES['shaped']})",
    "ip": f"not ({_TOLD['ip']}) or not ({FEATURES['octets'].replace('v rlike', "replace(v, ' ') rlike")})",
    "card": f"not luhn or {FEATURES['glued']} or v rlike '^[0-9]+[.][0-9]+$'",
    "phone": f"{FEATURES['glued']} or {FEATURES['octets']} or {_DATE} or length(d) > 15 or (not ({_TOLD['phone']}) and (length(d) < 9 or not ({_DIALLED})))",
}
CONTEXT = 24
ROUNDS, SHRINK, RIDGE, PRECISION, FOLDS = 24, 0.3, 1.0, 0.98, 3


def _found(pattern: str) -> str:
    """SQL for all matches in _text, in order: array of (s, e, v); positions from the pieces between them."""
    p = pattern.replace("'", "\\'")
    pieces, matches = f"split(_text, r'{p}', -1)", f"regexp_extract_all(_text, r'{p}', 0)"
    return f"""aggregate(zip_with(slice({pieces}, 1, size({matches})), {matches}, (p, v) -> named_struct('p', p, 'v', v)),
      named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,v:string>>)),
      (x, m) -> named_struct('at', x.at + char_length(m.p) + char_length(m.v), 'out', array_append(x.out,
        named_struct('s', x.at + char_length(m.p), 'e', x.at + char_length(m.p) + char_length(m.v), 'v', m.v))), x -> x.out)"""


_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
#: The Luhn sum of up to 19 digits d, from the right.
_LUHN = """(length({d}) between 13 and 19 and aggregate(sequence(1, least(19, greatest(1, length({d})))), 0, (t, i) ->
  t + case when i % 2 = 1 then coalesce(try_cast(substring({d}, -i, 1) as int), 0)
           else coalesce(try_cast(substring({d}, -i, 1) as int), 0) * 2 - if(try_cast(substring({d}, -i, 1) as int) > 4, 9, 0) end) % 10 = 0)"""
_VALID = {
    "email": "true",
    "ip": "forall(split(m.v, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255)",
    "card": _LUHN.format(d=_DIGITS.format(v="m.v")),
    "phone": f"length({_DIGITS.format(v='m.v')}) between 9 and 15",
}
#: What a text must have for a pattern to be worth a try, as SQL.
_WORTH = {
    "email": "contains(_text, '@')",
    "ip": "_text rlike '[0-9][.][0-9]'",
    "card": "_text rlike '[0-9]'",
    "phone": "_text rlike '[+][0-9]'",
    "address": r"_text rlike r'@|\(at\)|\[at\]'",
    "number": "_text rlike '[0-9]'",
}
_SPANS = "array<struct<s:int,e:int,v:string>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with _text) and the valid base spans of each kind, as arrays of (s, e, v)."""
    found = {k: F.when(F.expr(_WORTH[k]), F.expr(_found(p))).otherwise(F.expr(f"cast(array() as {_SPANS})")) for k, p in BASE.items()}
    return docs.withColumns(found).withColumns({k: F.expr(f"filter({k}, m -> {_VALID[k]})") for k in KINDS})


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (with _text and base spans) and _cands: (k, s, e, y, known, no, f...): whether a base span of kind k overlaps, one of any kind, and whether it is contrary to k."""
    out = docs
    for name, (pattern, _) in GENERATORS.items():
        out = out.withColumn(f"_{name}", F.when(F.expr(_WORTH[name]), F.expr(_found(pattern))).otherwise(F.expr(f"cast(array() as {_SPANS})")))
    tell = {k: {"email": "true", "ip": "m.v like '%.%.%.%'", "card": f"length({_DIGITS.format(v='m.v')}) >= 12", "phone": f"length({_DIGITS.format(v='m.v')}) between 7 and 15"}[k] for k in KINDS}
    lists = []
    for name, (_, kinds) in GENERATORS.items():
        for k in kinds:
            known = " or ".join(f"exists({b}, x -> x.s < m.e and x.e > m.s)" for b in KINDS)
            seen = f"transform(filter(_{name}, m -> {tell[k]}), m -> named_struct('v', m.v, 'd', {_DIGITS.format(v='m.v')}, 'b', substring(_text, greatest(1, m.s + 1 - {CONTEXT}), least({CONTEXT}, m.s)), 'a', substring(_text, m.e + 1, {CONTEXT}), 's', m.s, 'e', m.e, 'y', exists({k}, x -> x.s < m.e and x.e > m.s), 'known', {known}))"
            flags = ", ".join(f"'{f}', coalesce({_bound(sql)}, false)" for f, sql in FEATURES.items())
            lists.append(f"transform({seen}, c -> named_struct('k', '{k}', 's', c.s, 'e', c.e, 'y', c.y, 'known', c.known, 'no', coalesce({_bound(CONTRARY[k])}, false), {flags}))")
    return out.withColumn("_cands", F.expr(f"concat({', '.join(lists)})")).drop(*[f"_{g}" for g in GENERATORS])


def _bound(sql: str) -> str:
    """A feature's SQL with v, d, b, a and luhn of the candidate c."""
    import re

    out = re.sub(r"\b([vdba])\b(?=[, )]| rlike)", r"c.\1", sql)
    return out.replace("luhn", _LUHN.format(d="c.d"))


class Tree(NamedTuple):
    """A split, and on either side a further split (or none) with the values of its leaves: (no, yes)."""

    split: str
    no: tuple[str | None, float, float]
    yes: tuple[str | None, float, float]

    def value(self, flags: dict[str, bool]) -> float:
        f, a, b = self.yes if flags[self.split] else self.no
        return b if f is not None and flags[f] else a

    def column(self, c: Column) -> Column:
        side = lambda s: F.lit(s[1]) if s[0] is None else F.when(c[s[0]], s[2]).otherwise(s[1])
        return F.when(c[self.split], side(self.yes)).otherwise(side(self.no))


class Cell(NamedTuple):
    """A combination of features with its numbers of wrong and right candidates."""

    flags: dict[str, bool]
    wrong: int
    right: int


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _best_split(rows: list[tuple[dict[str, bool], float, float]], features: list[str]) -> tuple[float, str | None, float, float]:
    """(gain, feature, value if no, value if yes) of gradients and curvatures."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    whole = g * g / (h + RIDGE)
    best = (0.0, None, g / (h + RIDGE), g / (h + RIDGE))
    for f in features:
        gy, hy = sum(r[1] for r in rows if r[0][f]), sum(r[2] for r in rows if r[0][f])
        gain = gy * gy / (hy + RIDGE) + (g - gy) ** 2 / (h - hy + RIDGE) - whole
        if gain > best[0] + 1e-9:
            best = (gain, f, (g - gy) / (h - hy + RIDGE), gy / (hy + RIDGE))
    return best


def boost(cells: list[Cell], rounds: int = ROUNDS, marks: tuple[str, ...] = ()) -> list[Tree]:
    """Gradient boosting with the logistic loss on counted combinations, without the marks: its cost doesn't depend on the documents."""
    scores, trees = [0.0] * len(cells), []
    for t in range(rounds):
        features = [f for i, f in enumerate(FEATURES) if i % 3 != t % 3 and f not in marks]
        rows = []
        for c, s in zip(cells, scores):
            p, n = _sigmoid(s), c.wrong + c.right
            rows.append((c.flags, c.right - n * p, n * p * (1 - p)))
        _, f, *_ = _best_split(rows, features)
        if f is None:
            continue
        sides = []
        for yes in (False, True):
            _, g, a, b = _best_split([r for r in rows if r[0][f] == yes], features)
            sides.append((g, SHRINK * a, SHRINK * b))
        tree = Tree(f, *sides)
        trees.append(tree)
        scores = [s + tree.value(c.flags) for c, s in zip(cells, scores)]
    return trees


def threshold(cells: list[Cell], trees: list[Tree]) -> float | None:
    """The lowest score from which on the candidates are right to PRECISION; None if there is none."""
    return _lowest([(sum(t.value(c.flags) for t in trees), c.wrong, c.right) for c in cells])


def _lowest(scored: list[tuple[float, int, int]]) -> float | None:
    scored = sorted(scored, reverse=True)
    wrong = right = 0
    best = None
    for i, (s, w, r) in enumerate(scored):
        wrong, right = wrong + w, right + r
        ends = i + 1 == len(scored) or scored[i + 1][0] < s
        if ends and right >= PRECISION * (wrong + right) and s > 0:
            best = s
    return best


def learn(found: DataFrame) -> dict[str, tuple[list[Tree], float]]:
    """For each kind that can be told: its trees, from the labelled _cands of all rows, and its threshold, from scores out of their folds."""
    fold = F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    flat = found.select(fold.alias("fold"), F.explode("_cands").alias("c")).where("c.y or c.known or c.no").select("fold", "c.k", "c.y", *[f"c.{f}" for f in FEATURES])
    counts = flat.groupBy("k", "fold", "y", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()  # 2**13 rows at most for each kind, fold and label
    kinds: dict[str, list[dict[tuple, list[int]]]] = {}
    for row in counts:
        folds = kinds.setdefault(row["k"], [{} for _ in range(FOLDS)])
        folds[row["fold"]].setdefault(tuple(row[f] for f in FEATURES), [0, 0])[int(row["y"])] += row["n"]
    out = {}
    for k, folds in sorted(kinds.items()):
        scored = []
        for held in folds:
            trees = boost(_cells([x for x in folds if x is not held]), marks=MARKS[k])
            scored += [(sum(t.value(c.flags) for t in trees), c.wrong, c.right) for c in _cells([held])]
        at = _lowest(scored)
        if at is not None:
            out[k] = (boost(_cells(folds), marks=MARKS[k]), at)
    return out


def _cells(folds: list[dict[tuple, list[int]]]) -> list[Cell]:
    """The combinations of some folds together."""
    sums: dict[tuple, list[int]] = {}
    for flags, (w, r) in (x for f in folds for x in f.items()):
        n = sums.setdefault(flags, [0, 0])
        n[0], n[1] = n[0] + w, n[1] + r
    return [Cell(dict(zip(FEATURES, flags)), w, r) for flags, (w, r) in sorted(sums.items())]


def with_spans(found: DataFrame, models: dict[str, tuple[list[Tree], float]]) -> DataFrame:
    """``found`` and _spans: base and added spans as (k, s, e), by kind and start.

    Of added spans that overlap, the one that passes its threshold by more stays, then the earlier kind.
    """
    if models:
        margin = lambda c: F.coalesce(*[F.when(c["k"] == k, sum((t.column(c) for t in trees), F.lit(-at))) for k, (trees, at) in models.items()], F.lit(-1.0))
        scored = F.transform(F.filter("_cands", lambda c: ~c["known"] & ~c["no"]), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), margin(c).alias("m")))
        found = found.withColumn("_new", F.filter(scored, lambda c: c["m"] >= -1e-9))
        rank = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
        better = f"x.s < c.e and x.e > c.s and (x.m > c.m or (x.m = c.m and (case x.k {rank} end) < (case c.k {rank} end)))"
        found = found.withColumn("_new", F.expr(f"filter(_new, c -> not exists(_new, x -> {better}))"))
    else:
        found = found.withColumn("_new", F.expr("cast(array() as array<struct<k:string,s:int,e:int,m:double>>)"))
    parts = [
        f"array_sort(concat(transform({k}, m -> named_struct('s', m.s, 'e', m.e, 'k', '{k}')), transform(filter(_new, m -> m.k = '{k}'), m -> named_struct('s', m.s, 'e', m.e, 'k', m.k))))"
        for k in KINDS
    ]
    return found.withColumn("_spans", F.expr(f"transform(concat({', '.join(parts)}), m -> named_struct('k', m.k, 's', m.s, 'e', m.e))"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, the base spans of each kind (s, e, v), and _spans: all spans that the trained model selects."""
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    found = stored(candidates(base_spans(texts)).drop("_text"), "pii-spans")
    return with_spans(found, learn(found)).drop("_cands", "_new")


def joined(spans: str) -> Column:
    """An array of (k, s, e) as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["k"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span's kind in brackets instead; of overlapping spans the first counts."""
    cut = F.aggregate(
        F.array_sort(F.transform(spans, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["k"].alias("k")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda x, m: F.when(m["s"] < x["at"], x).otherwise(
            F.struct(m["e"].alias("at"), F.concat(x["out"], F.substring(text, x["at"] + 1, m["s"] - x["at"]), F.lit("["), m["k"], F.lit("]")).alias("out"))
        ),
    )
    return F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.char_length(text)))
