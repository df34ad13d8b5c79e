"""The declared schema: entities over tables, their fields, and the relations between them.

Callables get accessors for the tables in question and return Columns (or SQL text, see Table.sql). They run while
planning, never per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError

TableLike = Any  # a name, SQL in brackets, a path ending in .parquet, a DataFrame, or a callable (args, ctx) -> one of them


class Table:
    """Access to the columns of one table in a plan: t["column"] or t.column."""

    def __init__(self, alias: str, columns: Sequence[str]):
        self._alias, self._columns = alias, list(columns)

    def name(self, column: str) -> str:
        if column not in self._columns:
            raise SchemaError(f"no column {column} among {self._columns}")
        return f"{self._alias}__{column}"

    def __getitem__(self, column: str) -> Column:
        return F.col(f"`{self.name(column)}`")

    def __getattr__(self, column: str) -> Column:
        if column.startswith("_"):
            raise AttributeError(column)
        return self[column]

    def sql(self, text: str, **others: Table) -> Column:
        """SQL text, with {t} for this table's columns as in {t}.name, and other names for other tables."""
        for key, t in {"t": self, **others}.items():
            text = text.replace("{" + key + "}.", f"{t._alias}__")
        return F.expr(text)


def load(spark: SparkSession, table: TableLike, args: Mapping, ctx: Any) -> DataFrame:
    """Resolve whatever a schema names as a table, once for each plan."""
    if callable(table) and not isinstance(table, DataFrame):
        table = table(args, ctx)
    if isinstance(table, DataFrame):
        return table
    if not isinstance(table, str):
        raise SchemaError(f"not a table: {table!r}")
    if table.lstrip().startswith("("):
        return spark.sql(f"SELECT * FROM {table} AS derived")
    if table.endswith(".parquet"):
        return spark.read.parquet(table)
    return spark.table(table)


def tagged(parts: Mapping[str, DataFrame], tag: str = "$type", distinct: bool = False) -> DataFrame:
    """One polymorphic table of several: missing columns are null, the tag tells the type of each row."""
    out: DataFrame | None = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise SchemaError("a polymorphic table needs a part")
    return out.distinct() if distinct else out


# --- fields ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Col:
    """A column; the field's own name if none is given."""

    column: str | None = None


@dataclass(frozen=True)
class Deps:
    """Columns that are fetched, and a resolver of their Columns."""

    columns: tuple[str, ...]
    resolve: Callable[..., Column]


@dataclass(frozen=True)
class Expr:
    """An expression over the row: (table, args, ctx, node) -> Column or SQL text."""

    expr: Callable[..., Column | str] | str


@dataclass(frozen=True)
class Constant:
    """A field that needs no table: (args, ctx) -> value or Column."""

    value: Callable[[Mapping, Any], Any]


@dataclass(frozen=True)
class Plain:
    """A column whose objects are there already, in structs or arrays of structs: its selection picks their fields."""

    column: str | None = None


class _Ignored:
    """A field that is left out of the plan and of the result."""


IGNORED = _Ignored()


@dataclass(frozen=True)
class Arg:
    """type: Int, Float, String, Boolean or ID, [x] for a list of them; other names, and none, take any value."""

    default: Any = None
    enum: Mapping[str, Any] | None = None
    required: bool = False
    type: Any = None


@dataclass(frozen=True)
class Junction:
    """A table in between. parent: (parent column, junction column) pairs or a condition; child: (junction column, child
    column) pairs or a condition."""

    table: TableLike
    parent: Any
    child: Any
    key: Sequence[str] | None = None
    where: Callable | str | None = None
    order_by: Any = None
    sort_key: Any = None
    include: Mapping[str, Any] = field(default_factory=dict)
    always_fetch: Sequence[str] = ()


@dataclass(frozen=True)
class Edge:
    """A relation to another type. on: (parent column, child column) pairs, or a condition (parent, child, args, ctx)."""

    target: str
    many: bool = True
    on: Any = None
    junction: Junction | None = None
    where: Callable | str | None = None
    order_by: Any = None
    sort_key: Any = None
    limit: Any = None
    offset: Any = None
    connection: bool = False
    paginate: bool = False
    page_limit: int | None = None
    default_page_size: int | None = None
    strategy: str = "join"
    inner: bool = False  # drop parents without a child, as a root list does with a to-one batch
    where_uses_parent: bool = False
    args: Mapping[str, Arg] = field(default_factory=dict)


# --- types ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Entity:
    """An object type whose instances are the rows of a table. unique: whether the key is known to be so."""

    name: str
    table: TableLike
    key: Sequence[str]
    fields: Mapping[str, Any]
    interfaces: Sequence[str] = ()
    always_fetch: Sequence[str] = ()
    unique: bool = True


@dataclass(frozen=True)
class Polymorphic:
    """A union or interface: one tagged table whose rows are of several types."""

    name: str
    table: TableLike
    key: Sequence[str]
    types: Mapping[str, Mapping[str, Any]]  # the fields of each type
    fields: Mapping[str, Any] = field(default_factory=dict)  # common ones
    tag: str = "$type"
    always_fetch: Sequence[str] = ()
    unique: bool = False
    interfaces: Sequence[str] = ()


@dataclass(frozen=True)
class ScalarTable:
    """A scalar that is kept in a table: a list of one column's values."""

    name: str
    table: TableLike
    key: Sequence[str]
    column: str
    unique: bool = True


@dataclass(frozen=True)
class Schema:
    types: Mapping[str, Entity | Polymorphic | ScalarTable]
    roots: Mapping[str, Edge]

    def type(self, name: str) -> Entity | Polymorphic | ScalarTable:
        if name not in self.types:
            raise SchemaError(f"no type {name} in the schema")
        t = self.types[name]
        if not t.key:
            raise SchemaError(f"type {name} needs a key")
        return t


def schema(types: Sequence[Entity | Polymorphic | ScalarTable], roots: Mapping[str, Edge]) -> Schema:
    return Schema({t.name: t for t in types}, dict(roots))
