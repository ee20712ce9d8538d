"""A small store of collections: create, insert, update, delete, find. Each change writes a new version.

A collection is a folder of Parquet versions and of numbered pointers, of which the last one
names the current version. A new version is written and checked beside the old one, and then
has the next pointer: readers see either, and of two writers at once one fails. Conditions are data (nested and/or of (field, operator, value)), made into columns
and never pasted into text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import stored

TYPES = {"text": "string", "integer": "bigint", "real": "double"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "text"
    primary: bool = False
    unique: bool = False
    notnull: bool = False
    auto_increment: bool = False
    default: object = None

    @property
    def spark_type(self) -> str:
        return TYPES.get(self.type, self.type)


@dataclass(frozen=True)
class Condition:
    """``operator`` is one of < > <= >= = != like not-like in not-in match regexp is-null."""

    field: str
    operator: str
    value: object = None

    def column(self) -> Column:
        c, v = F.col(self.field), self.value
        simple = {"<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v, "=": c == v, "!=": c != v} if not isinstance(v, (list, tuple)) and v is not None else {}
        if self.operator in simple:
            return simple[self.operator]
        made = {
            "like": lambda: c.ilike(v), "not-like": lambda: ~c.ilike(v), "in": lambda: c.isin(*v), "not-in": lambda: ~c.isin(*v),
            "match": lambda: F.contains(F.lower(c), F.lit(str(v).lower())), "regexp": lambda: c.rlike(v), "is-null": lambda: c.isNull(),
        }
        if self.operator not in made:
            raise ValueError(f"no such operator: {self.operator}")
        return made[self.operator]()


@dataclass(frozen=True)
class Every:
    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts))


@dataclass(frozen=True)
class Some:
    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts))


def _bound(where, values: Iterator):
    """The conditions with other values; those that take none (is-null) keep theirs."""
    if isinstance(where, Condition):
        return where if where.operator == "is-null" else replace(where, value=next(values))
    return type(where)(tuple(_bound(p, values) for p in where.parts))


def flat(parts: list, words: list[str]) -> Column:
    """Conditions joined by "and"/"or" without parentheses: "and" binds closer."""
    groups, group = [], [parts[0]]
    for p, w in zip(parts[1:], words):
        if w == "and":
            group.append(p)
        else:
            groups.append(group)
            group = [p]
    return Some(tuple(Every(tuple(g)) for g in [*groups, group])).column()


@dataclass
class Find:
    """What to find. Sorting is by all keys; a limit counts after what is skipped."""

    where: Condition | Every | Some | None = None
    retrieve: list[str] = field(default_factory=list)
    sort: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None
    skip: int = 0

    def on(self, df: DataFrame) -> DataFrame:
        if self.where is not None:
            df = df.where(F.coalesce(self.where.column(), F.lit(False)))
        if self.sort:
            df = df.orderBy(*[F.desc(k) if o.startswith("desc") else F.asc(k) for k, o in self.sort])
        if self.skip:
            df = df.offset(self.skip)
        if self.limit is not None:
            df = df.limit(self.limit)
        return df.select(*self.retrieve) if self.retrieve else df


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with _number from 1 on, without gaps: counted by partition, and on from the partitions before."""
    rows = stored(rows.withColumn("_part", F.spark_partition_id()), "store-rows")
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):  # a row for each partition
        before.append((part, total))
        total += n
    first = rows.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _first long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.monotonically_increasing_id()))
    return rows.join(F.broadcast(first), "_part").withColumn("_number", place + F.col("_first")).drop("_part", "_first")


class BrokenKey(ValueError):
    """An insert or update that breaks a key."""


class Store:
    """Collections below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files -------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, name: str) -> list[int]:
        fs, folder = self._fs(f"{self.root}/{name}/pointers")
        if not fs.exists(folder):
            return []
        found = (str(x.getPath().getName()) for x in fs.listStatus(folder))
        return sorted(int(x.removesuffix(".json")) for x in found if x.removesuffix(".json").isdigit())

    def _read(self, name: str) -> dict:
        pointers = self._pointers(name)
        if not pointers:
            raise KeyError(f"no collection {name}")
        rows = self.spark.read.text(f"{self.root}/{name}/pointers/{pointers[-1]:012}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _point(self, name: str, state: dict) -> None:
        at = (self._pointers(name) or [0])[-1] + 1
        fs, new = self._fs(f"{self.root}/{name}/pointers/{uuid.uuid4().hex}.new")
        out = fs.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, place = self._fs(f"{self.root}/{name}/pointers/{at:012}.json")
        if fs.exists(place) or not fs.rename(new, place):
            raise RuntimeError(f"{name} was changed meanwhile")

    def _commit(self, name: str, df: DataFrame, fields: list[Field], check: bool = False) -> None:
        version = uuid.uuid4().hex
        path = f"{self.root}/{name}/{version}"
        df.write.parquet(path)
        if check:
            try:
                self._check(self.spark.read.schema(df.schema).parquet(path), fields)
            except BrokenKey:
                fs, made = self._fs(path)
                fs.delete(made, True)
                raise
        self._point(name, {"version": version, "fields": [vars(f) for f in fields]})

    # -- operations --------------------------------------------------------------------

    def create(self, name: str, fields: list[Field]) -> None:
        """An empty collection; nothing happens if there is one."""
        if self._pointers(name):
            return
        schema = T.StructType([T.StructField(f.name, T._parse_datatype_string(f.spark_type)) for f in fields])
        self._commit(name, self.spark.createDataFrame([], schema), fields)

    def load(self, name: str, df: DataFrame, fields: list[Field]) -> None:
        """A collection made of a table."""
        self.create(name, fields)
        self.insert(name, df)

    def fields(self, name: str) -> list[Field]:
        return [Field(**f) for f in self._read(name)["fields"]]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self._read(name)['version']}")

    def insert(self, name: str, rows: DataFrame) -> None:
        """All rows or none: missing columns take their defaults; a broken key raises BrokenKey."""
        fields, old = self.fields(name), self.table(name)
        counted = [f for f in fields if f.auto_increment and f.name not in rows.columns]
        if counted:
            rows = _numbered(rows)
        made = []
        for f in fields:
            if f in counted:
                c = F.col("_number") + (old.agg(F.max(f.name)).first()[0] or 0)
            elif f.name in rows.columns:
                c = F.coalesce(F.col(f.name), F.lit(f.default)) if f.notnull and f.default is not None else F.col(f.name)
            else:
                c = F.lit(f.default)
            made.append(c.cast(f.spark_type).alias(f.name))
        self._commit(name, old.unionByName(rows.select(*made)), fields, check=True)

    @staticmethod
    def _check(new: DataFrame, fields: list[Field]) -> None:
        for f in fields:
            if (f.primary or f.notnull) and not new.where(F.col(f.name).isNull()).isEmpty():
                raise BrokenKey(f"{f.name} is null")
            if f.primary or f.unique:
                if not new.where(F.col(f.name).isNotNull()).groupBy(f.name).count().where("count > 1").isEmpty():
                    raise BrokenKey(f"{f.name} isn't unique")

    def update(self, name: str, values: dict[str, object], where: Condition | Every | Some | None = None) -> None:
        old, fields = self.table(name), self.fields(name)
        hit = F.coalesce(where.column(), F.lit(False)) if where else F.lit(True)
        kinds = {f.name: f.spark_type for f in fields}
        new = old.withColumns({k: F.when(hit, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in values.items()})
        self._commit(name, new, fields, check=True)

    def delete(self, name: str, where: Condition | Every | Some | None = None, sort: list[tuple[str, str]] | None = None, limit: int | None = None, skip: int = 0) -> None:
        """With a limit, only the first rows of the order that meet the conditions."""
        old, fields = self.table(name), self.fields(name)
        hit = F.coalesce(where.column(), F.lit(False)) if where else F.lit(True)
        if limit is None:
            self._commit(name, old.where(~hit), fields)
            return
        key = next((f.name for f in fields if f.primary), None)
        if key is None:  # rows are told apart by their places in a stored copy
            key, old = "_row", stored(old.withColumn("_row", F.monotonically_increasing_id()), "store-rows")
        doomed = Find(where, [key], sort or [(key, "ascending")], limit, skip).on(old)
        self._commit(name, old.join(doomed, key, "left_anti").select(*[f.name for f in fields]), fields)

    def find(self, name: str, request: Find) -> DataFrame:
        return request.on(self.table(name))

    def fetch(self, name: str, request: Find, bind: list | None = None) -> Iterator[dict]:
        """Instances one by one, their values as text; ``bind`` gives the conditions' values anew, in order.

        Each call begins at the first instance.
        """
        if bind is not None:
            values = iter(bind)
            request = replace(request, where=_bound(request.where, values))
        found = self.find(name, request)
        for row in found.select([F.col(c).cast("string") for c in found.columns]).toLocalIterator():
            yield row.asDict()

    def query(self, sql: str, args: dict | None = None, **tables: str) -> DataFrame:
        """A read-only query over collections (view=collection), with named parameters."""
        for view, name in tables.items():
            self.table(name).createOrReplaceTempView(view)
        return self.spark.sql(sql, args={k.lstrip(":$@"): v for k, v in (args or {}).items()})
