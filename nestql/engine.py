"""The public API: queries and node lookups over a schema."""

from __future__ import annotations

import base64
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from .errors import QueryError, SchemaError
from .functions.names import Namespace
from .operators.compiler import Compiler
from .plans.parser import Field, parse
from .plans.planner import Planner
from .sources.schema import Edge, Schema, Table


def global_id(type_name: str, key: Any) -> str:
    return base64.b64encode(f"{type_name}:{key}".encode()).decode()


def from_global_id(text: str) -> tuple[str, str]:
    name, _, key = base64.b64decode(text).decode().partition(":")
    return name, key


class Engine:
    """Queries over a schema.

    hidden: whether objects also carry the columns that their type, or the junction that leads to them, always fetches.
    strategy: decides between join and batch from a field's name in the result and its edge; else each edge's own holds.
    """

    def __init__(self, spark: SparkSession, schema: Schema, hidden: bool = False, strategy: Callable[[str, Edge], str] | None = None):
        self.spark, self.schema, self.hidden, self.strategy = spark, schema, hidden, strategy

    def planner(self, text: str, variables: Mapping[str, Any] | None, ctx: Any, schema: Schema | None = None) -> Planner:
        return Planner(schema or self.schema, parse(text), variables or {}, ctx, self.strategy)

    def compiler(self, ctx: Any) -> Compiler:
        return Compiler(self.spark, ctx, self.hidden)

    def frames(self, text: str, variables: Mapping[str, Any] | None = None, ctx: Any = None, operation: str | None = None) -> dict[str, DataFrame]:
        """A lazy DataFrame for each root field."""
        nodes = self.planner(text, variables, ctx).roots(operation)
        return {n.key: self.compiler(ctx).root(n) for n in nodes}

    def query(self, text: str, variables: Mapping[str, Any] | None = None, ctx: Any = None, operation: str | None = None) -> DataFrame:
        """The DataFrame of a query with one root field."""
        frames = self.frames(text, variables, ctx, operation)
        if len(frames) != 1:
            raise QueryError("the query has several root fields, or none; use frames()")
        return next(iter(frames.values()))

    def flat(self, text: str, variables: Mapping[str, Any] | None = None, ctx: Any = None, minify: bool = False, prefix: str = "", longest: int = 63) -> DataFrame:
        """The rows before nesting, with names like posts__comments__id; minify makes them short, prefix goes before each.

        Names of more than longest characters, which many databases would cut, give a warning.
        """
        nodes = self.planner(text, variables, ctx).roots()
        if len(nodes) != 1:
            raise QueryError("flat() takes one root field")
        df = self.compiler(ctx).flat(nodes[0])
        if minify or prefix:
            space = Namespace(minify, prefix)
            df = df.toDF(*[space.name(c) for c in df.columns])
        if long := [c for c in df.columns if len(c) > longest]:
            warnings.warn(f"names of over {longest} characters: {', '.join(long)}; minify makes them short", stacklevel=2)
        return df

    def data(self, text: str, variables: Mapping[str, Any] | None = None, ctx: Any = None, operation: str | None = None) -> dict[str, Any]:
        """Collect the result as nested dictionaries; for results that fit the driver."""
        planner = self.planner(text, variables, ctx)
        out: dict[str, Any] = {}
        for n in planner.roots(operation):
            rows = [r.asDict(recursive=True) for r in self.compiler(ctx).root(n).collect()]
            out[n.key] = rows if n.edge.many and not n.edge.connection else (rows[0] if rows else None)
        return out

    def json(self, text: str, variables: Mapping[str, Any] | None = None, ctx: Any = None) -> DataFrame:
        """A JSON document for each row, nulls included."""
        from pyspark.sql import functions as F

        df = self.query(text, variables, ctx)
        return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def node(self, type_name: str, condition: Any, selection: str, variables: Mapping[str, Any] | None = None, ctx: Any = None) -> DataFrame:
        """One object of a type by its key, a list for a composite key, or a callable (table, args, ctx) -> Column.

        The DataFrame has one row or none, and a column __type__ besides what selection asks for.
        """
        from pyspark.sql import functions as F

        if type_name not in self.schema.types:
            raise SchemaError(f"no type {type_name} in the schema")
        t = self.schema.type(type_name)
        edge = Edge(type_name, many=False)
        root = replace(self.schema, roots={"node": edge})
        planner = self.planner("{ node " + selection + " }", variables, ctx, root)
        (node,) = planner.roots()

        def where(table: Table) -> Column:
            if callable(condition):
                return condition(table, {}, ctx)
            values = list(condition) if isinstance(condition, Sequence) and not isinstance(condition, str) else [condition]
            if len(values) != len(t.key):
                raise QueryError(f"{type_name} has a key of {len(t.key)} columns")
            out = F.lit(True)
            for k, v in zip(t.key, values, strict=True):
                out = out & (table[k] == F.lit(v))
            return out

        return self.compiler(ctx).root(node, where).withColumn("__type__", F.lit(type_name))


__all__ = ["Engine", "Field", "from_global_id", "global_id"]
