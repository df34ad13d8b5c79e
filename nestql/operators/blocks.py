"""Relations by a condition: the children's lists are made once for each value of its equalities, and filtered at each parent.

Pairs of parents and children never pass a shuffle or a sort. The lists are one value that every task has; parents carry the
columns of the condition to the end of the plan, however deep they are, and get their lists where the result is dealt.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that the children may have by Spark's own estimate; larger tables are joined pair by pair.
LISTED = 16 << 20
#: Lists are found by the hash of their equalities.
BUCKETS = 1024
#: Bytes of parents, by the same estimate, for which a task is added, and how many are.
DEALT, TASKS = 16 << 10, 4096


#: Bytes of tables, as they are stored, for which a task makes lists; fewer tasks than FEW are left to Spark.
SHARE, FEW = 4 << 20, 8


class Fields:
    """Stands for a Table: columns are fields of a struct; notes which are asked for."""

    def __init__(self, table: Any, value: Callable[[str], Column]):
        self._table, self._value, self._used = table, value, {}

    def __getitem__(self, column: str) -> Column:
        self._table.name(column)
        self._used[column] = True
        return self._value(column)

    def __getattr__(self, column: str) -> Column:
        if column.startswith("_"):
            raise AttributeError(column)
        return self[column]


def size(df: DataFrame) -> int:
    """Bytes by the optimizer's estimate; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def conjuncts(c: Column) -> list[Any]:
    """What a condition joins by AND, as nodes."""

    def split(node: Any) -> list[Any]:
        if node.getClass().getSimpleName() == "UnresolvedFunction" and node.functionName() == "and":
            return [x for i in range(node.arguments().size()) for x in split(node.arguments().apply(i))]
        return [node]

    return split(c._jc.node())


def equality(node: Any, left: dict[str, str], right: dict[str, str]) -> tuple[str, str] | None:
    """Columns of the parent and the child that a node compares; names to columns on either side."""
    if node.getClass().getSimpleName() != "UnresolvedFunction" or node.functionName() not in ("=", "=="):
        return None
    sides = [node.arguments().apply(i) for i in range(2)]
    if any(s.getClass().getSimpleName() != "UnresolvedAttribute" or s.nameParts().size() != 1 for s in sides):
        return None
    a, b = (s.nameParts().apply(0) for s in sides)
    a, b = (a, b) if a in left else (b, a)
    return (left[a], right[b]) if a in left and b in right else None


def joined(nodes: list[Any]) -> Column:
    """The nodes' conjunction."""
    jvm = SparkContext._active_spark_context._jvm
    out = None
    for n in nodes:
        c = type(F.lit(True))(jvm.org.apache.spark.sql.Column(n))
        out = c if out is None else out & c
    return F.lit(True) if out is None else out


@dataclass
class Blocks:
    """A relation whose lists are attached at the end. on: the condition's callable of parent and child; path: the fields that lead to it, each with whether it is a list."""

    path: list[tuple[str, bool]]
    lists: DataFrame
    equal: list[tuple[str, str]]
    skip: list[int]
    on: Callable[[Any, Any], Column]
    tables: tuple[Any, Any]
    held: list[str] = field(default_factory=list)

    def of(self, lists: Column, parent: Column) -> Column:
        """The list of one parent, from the struct of its columns."""

        def holds(c: Column) -> Column:
            left, right = self.tables
            cond = self.on(Fields(left, lambda n: parent[n]), Fields(right, lambda n: c[n]))
            return joined([n for i, n in enumerate(conjuncts(cond)) if i not in self.skip])

        def same(b: Column) -> Column:
            out = F.lit(True)
            for i, (p, _) in enumerate(self.equal):
                out = out & (b[f"k{i}"] == parent[p])
            return out

        near = F.get(lists, bucket([parent[p] for p, _ in self.equal]))
        found = F.get(F.filter(near, same), F.lit(0))["l"]
        return F.coalesce(F.transform(F.filter(found, holds), lambda c: c["_v"]), F.array())

    def fill(self, lists: Column, value: Column, many: bool, path: list[tuple[str, bool]]) -> Column:
        """value, a list or not, with the lists in place of what stood for them, below a path of fields."""
        if not path:
            return self.of(lists, value)
        (name, below), *rest = path
        put = self.putting(lists, name, below, rest)
        return F.transform(value, put) if many else put(value)

    def putting(self, lists: Column, name: str, many: bool, rest: list[tuple[str, bool]]) -> Callable[[Column], Column]:
        return lambda x: x.withField(f"`{name}`", self.fill(lists, x[name], many, rest))


def bucket(keys: list[Column]) -> Column:
    return F.pmod(F.hash(*keys), F.lit(BUCKETS)) if keys else F.lit(0)


def listed(rows: DataFrame, keys: list[Column], sorts: list[Column], item: list[Column], ordered: Callable[[Column], Column]) -> DataFrame:
    """One row with one array: at each bucket its keys, each with the list of items in order."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = rows.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*sorts, F.struct(*item).alias("item")).alias("_s"))
    for n in names:
        rows = rows.filter(F.col(n).isNotNull())
    each = rows.groupBy(*names).agg(F.collect_list("_s").alias("_a"))
    each = each.select(*names, F.transform(ordered(F.col("_a")), lambda x: x["item"]).alias("l"))
    near = each.groupBy(bucket([F.col(n) for n in names]).alias("b")).agg(F.collect_list(F.struct(*names, "l")).alias("x"))
    one = near.agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m"))
    return one.select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.col("m")[i]).alias("lists"))


def deal(df: DataFrame, order: list[Column], keys: list[Column], own: int) -> DataFrame:
    """In order if there is one, over as many tasks as own bytes of parents ask for: small rows with long lists to come are not merged into a few."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, own // DEALT))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order) if order else df.repartition(n, *keys)


def tasks(df: DataFrame) -> int:
    """How many tasks the lists made of rows need for what a task holds not to grow with the tables; 0 leaves it to Spark, as an unknown size does."""
    if not hasattr(df, "_jdf"):
        return 0
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    n = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) // SHARE
    return n if FEW <= n < 1 << 31 else 0


def dealt(df: DataFrame, names: list[str]) -> DataFrame:
    n = tasks(df)
    return df.repartition(n, *names) if n else df.repartition(*names)
