"""From plan nodes to one lazy DataFrame: each list is nested bottom-up before it meets its parents.

Every table's columns are renamed once, to alias__column, so nothing is ambiguous however often a table occurs. A child is
compiled to rows with a value struct, reduced to one row for each parent key (list, page or single object), and joined to
its parents on that key; siblings never multiply each other.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, SchemaError
from ..functions import cursors, order
from ..plans.planner import Output, PlanNode
from ..sources.schema import Col, Constant, Deps, Expr, Polymorphic, ScalarTable, Table, load
from . import blocks

#: Rows up to which a root page is a top-k; deep offsets are sorted instead. Keyset pages never get deep.
DEEP = 10_000


class Compiler:
    def __init__(self, spark: SparkSession, ctx: Any, hidden: bool = False):
        self.spark, self.ctx, self.hidden = spark, ctx, hidden
        self.kinds: dict[str, T.DataType] = {}
        #: fields from the root to where attach() is, each with whether it is a list; None where lists can't be left to the end
        self.path: list[tuple[str, bool]] | None = None
        self.late: list[blocks.Blocks] = []

    # tables ------------------------------------------------------------------------------------------------------

    def scan(self, table: Any, alias: str, args: dict) -> tuple[DataFrame, Table]:
        df = load(self.spark, table, args, self.ctx)
        t = Table(alias, df.columns)
        self.kinds |= {t.name(f.name): f.dataType for f in df.schema.fields}
        return df.select(*[F.col(f"`{c}`").alias(f"{alias}__{c}") for c in df.columns]), t

    def key(self, node: PlanNode) -> Column:
        """The identity of a row: a struct of its key columns, null if all are."""
        cols = [node.t[k] for k in node.type.key]
        none = cols[0].isNull()
        for c in cols[1:]:
            none = none & c.isNull()
        return F.when(~none, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)]))

    def column(self, got: Any, t: Table, **others: Table) -> Column:
        return t.sql(got, **others) if isinstance(got, str) else got

    def condition(self, where: Any, t: Table, node: PlanNode, **others: Table) -> Column | None:
        if callable(where):
            where = where(t, node.args, self.ctx, node)
        if where is None or (isinstance(where, str) and not where.strip()):
            return None
        return self.column(where, t, **others)

    # values ------------------------------------------------------------------------------------------------------

    def leaf(self, node: PlanNode, o: Output) -> Column:
        t, f = node.t, o.what
        if node.j is not None and o.name in node.edge.junction.include:
            t = node.j
        args = {**node.args, **o.args}
        if isinstance(f, Col):
            return t[f.column or o.name]
        if isinstance(f, Deps):
            return f.resolve(*[t[c] for c in f.columns])
        if isinstance(f, Expr):
            return self.column(f.expr(t, args, self.ctx, node) if callable(f.expr) else f.expr, t)
        if isinstance(f, Constant):
            v = f.value(args, self.ctx)
            return v if isinstance(v, Column) else F.lit(v)
        raise SchemaError(f"{o.name} is no field")

    def child_name(self, node: PlanNode, o: Output) -> str:
        return f"{node.alias}___{o.key}" + (f"@{o.on}" if o.on else "")

    def values(self, node: PlanNode) -> list[Column]:
        """The result columns of a row, in the order of the query; fields of one type are null on other types."""
        out: dict[str, Column] = {}
        for o in node.outputs.values():
            if o.kind == "typename":
                v = node.t[node.type.tag] if isinstance(node.type, Polymorphic) else F.lit(node.type.name)
            elif o.kind == "child":
                v = F.col(f"`{self.child_name(node, o)}`")
            elif o.kind == "plain":
                column = o.what.column or o.name
                v = self.pick(node.t[column], o.args, self.kinds[node.t.name(column)])
            else:
                v = self.leaf(node, o)
            if o.on is not None:
                v = F.when(node.t[node.type.tag] == o.on, v)
            if o.key in out:
                v = F.when(node.t[node.type.tag] == o.on, v).otherwise(out[o.key]) if o.on is not None else F.coalesce(out[o.key], v)
            out[o.key] = v
        for k, v in self.fetched(node) if self.hidden else []:
            out.setdefault(k, v)
        return [v.alias(k) for k, v in out.items()]

    def fetched(self, node: PlanNode) -> list[tuple[str, Column]]:
        """Columns that the schema always wants, of the type's table and of the junction."""
        out = [(c, node.t[c]) for c in node.type.always_fetch]
        return out + [(c, node.j[c]) for c in (node.edge.junction.always_fetch if node.j is not None else ())]

    def pick(self, c: Column, wanted: dict, kind: T.DataType) -> Column:
        """The fields of a struct, or of each struct of an array, that are wanted."""
        if not wanted:
            return c
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: self.pick(x, wanted, kind.elementType))
        if not isinstance(kind, T.StructType) or any(n not in kind.names for n, _ in wanted.values()):
            raise QueryError(f"no fields {', '.join(n for n, _ in wanted.values())} in {kind.simpleString()}")
        return F.when(c.isNotNull(), F.struct(*[self.pick(c[n], sub, kind[n].dataType).alias(k) for k, (n, sub) in wanted.items()]))

    def value(self, node: PlanNode) -> Column:
        if isinstance(node.type, ScalarTable):
            return node.t[node.type.column]
        cols = self.values(node)
        return F.struct(*cols) if cols else F.create_map()

    # rows --------------------------------------------------------------------------------------------------------

    def rows(self, node: PlanNode, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, bool]:
        """The node's rows with its children attached, its own filter not yet applied; whether joins below drop rows.

        keep: what restricts the rows early, before the children are made.
        """
        df, node.t = self.scan(node.type.table, node.alias, node.args)
        strict = False
        if node.edge.junction:
            j, node.j = self.scan(node.edge.junction.table, f"{node.alias}j", node.args)
            where = self.condition(node.edge.junction.where, node.j, node)
            # a junction's filter belongs to its scan; T1 of joined lists is decided by attach()
            strict = where is not None
            if strict:
                j = j.filter(where)
            df = j.join(df, self.pairs(node.edge.junction.child, node.j, node.t, node))
        if keep is not None:
            df = keep(df)
        for o in list(node.outputs.values()):
            if o.child is not None:
                df, s = self.attach(df, node, o)
                strict |= s
        return df, strict

    def pairs(self, on: Any, left: Table, right: Table, node: PlanNode) -> Column:
        """A join condition from column pairs, a callable or text with {parent} and {child}."""
        if callable(on):
            on = on(left, right, node.args, self.ctx)
        if isinstance(on, str):
            return left.sql(on, parent=left, child=right)
        if isinstance(on, Column):
            return on
        out: Column | None = None
        for a, b in self.listed(on):
            c = left[a] == right[b]
            out = c if out is None else out & c
        if out is None:
            raise SchemaError("a relation needs columns")
        return out

    @staticmethod
    def listed(on: Any) -> list[tuple[str, str]]:
        return [tuple(on)] if len(on) == 2 and isinstance(on[0], str) else [tuple(x) for x in on]

    @staticmethod
    def equal(on: Any) -> bool:
        return not callable(on) and not isinstance(on, (str, Column))

    # order and pages -----------------------------------------------------------------------------------------------

    def sort(self, node: PlanNode) -> tuple[order.Spec, Callable[[str], Column]]:
        """All sort columns, the junction's first, each named for its table; the key makes the order total."""
        s: order.Spec = []
        if node.edge.paginate and node.keyset:
            main, junction = node.sort_key, node.junction_sort
        else:
            main, junction = node.order_by or (node.sort_key if not node.junction_order else []), node.junction_order or node.junction_sort
        if node.edge.paginate and node.keyset and node.args.get("last") is not None:
            main, junction = order.flipped(main), order.flipped(junction)
        s = [(f"j:{c}", d) for c, d in junction] + [(f"t:{c}", d) for c, d in main]
        last = s[-1][1] if s else False
        s += [(f"t:{k}", last) for k in node.type.key if (f"t:{k}", True) not in s and (f"t:{k}", False) not in s]
        return s, lambda name: (node.j if name[0] == "j" else node.t)[name[2:]]

    def precedence(self, rows: DataFrame, node: PlanNode) -> list[Column]:
        """Which of the rows of one object stands for it: the first in the order, then by the junction's key, then by the values asked for."""
        s, of = self.sort(node)
        if node.edge.paginate and node.keyset and node.args.get("last") is not None:  # backward pages have the objects of forward ones
            s = order.flipped(s)
        key = (node.edge.junction.key or ()) if node.j is not None else ()
        out = order.columns(s + [(f"j:{k}", False) for k in key], of)
        leaves = [] if isinstance(node.type, ScalarTable) else [self.leaf(node, o) for o in node.outputs.values() if o.kind == "leaf" and not isinstance(o.what, Constant)]
        kinds = rows.select(*[c.alias(f"v{i}") for i, c in enumerate(leaves)]).schema.fields
        return out + [c.asc_nulls_first() for c, f in zip(leaves, kinds, strict=True) if isinstance(f.dataType, T.AtomicType)]

    def page(self, node: PlanNode, df: DataFrame) -> tuple[DataFrame, int | None, int]:
        """Apply the cursor; returns what is left, the page size and the offset."""
        a = node.args
        if node.edge.paginate and node.keyset:
            size = a.get("first") if a.get("first") is not None else a.get("last")
            cursor = a.get("before") if a.get("last") is not None else a.get("after")
            if size is None:
                size = node.edge.default_page_size
            if cursor is not None:
                s = node.sort_key or node.junction_sort
                t = node.t if node.sort_key else node.j
                s = order.flipped(s) if a.get("last") is not None else s
                kinds = {f.name: f.dataType for f in df.schema.fields}
                got = cursors.read_key(cursor, [c for c, _ in s])
                df = df.filter(cursors.after(got, s, lambda c: t[c], lambda c: kinds[t.name(c)]))
            return df, size, 0
        if node.edge.paginate:
            size = a.get("first") if a.get("first") is not None else node.edge.default_page_size
            offset = cursors.read_offset(a["after"]) + 1 if a.get("after") is not None else node.offset
            return df, size, offset
        return df, node.limit, node.offset

    def wants(self, node: PlanNode, name: str) -> bool:
        return any(n == name for _, n, _ in node.shape)

    def connection(self, node: PlanNode, items: Column, total: Column, size: int | None, offset: int, kinds: dict[str, T.DataType]) -> Column:
        """The connection struct from an array of {value, cursor} in order, one longer than the page if more follow."""
        a = node.args
        backward = node.edge.paginate and node.keyset and a.get("last") is not None
        if not node.edge.paginate:  # the application layer's paging: all rows are there
            start = cursors.read_offset(a["after"]) + 1 if a.get("after") is not None else 0
            count = F.size(items)
            items = F.slice(items, start + 1, a["first"]) if a.get("first") is not None else F.slice(items, start + 1, 2147483647)
            more, total, offset = F.lit(start) + F.size(items) < count if a.get("first") is not None else F.lit(False), count, start
        elif size is None:
            more = F.lit(False)
        else:
            more = F.size(items) > size
            items = F.slice(items, 1, size) if size else F.slice(items, 1, 0)
        if backward:
            items = F.reverse(items)
        if not (node.edge.paginate and node.keyset):
            items = F.transform(items, lambda x, i: F.struct(x["value"].alias("value"), cursors.offset_cursor(i + offset).alias("cursor")))
        first = F.when(F.size(items) > 0, F.element_at(items, 1)["cursor"])
        last = F.when(F.size(items) > 0, F.element_at(items, -1)["cursor"])
        # a total rides on rows: past the end there is none
        known = {"hasNextPage": more if not backward else F.lit(False), "hasPreviousPage": more if backward else F.lit(False), "startCursor": first, "endCursor": last}
        if node.edge.paginate:
            total = F.when(F.size(items) > 0, total).otherwise(F.lit(0)).cast("long")
        out = []
        for key, name, sub in node.shape:
            if name == "total":
                out.append(total.cast("long").alias(key))
            elif name == "pageInfo":
                out.append(F.struct(*[known[n].alias(k) for k, n, _ in sub]).alias(key))
            else:
                picked = [("value" if n == "node" else "cursor", k) for k, n, _ in sub]
                out.append(F.transform(items, self.picker(picked)).alias(key))
        return F.struct(*out)

    @staticmethod
    def picker(picked: list[tuple[str, str]]) -> Callable[[Column], Column]:
        return lambda x: F.struct(*[x[name].alias(key) for name, key in picked])

    def item(self, node: PlanNode, kinds: dict[str, T.DataType]) -> list[Column]:
        """value, and for keyset pages the cursor."""
        out = [self.value(node).alias("value")]
        if node.edge.connection and node.edge.paginate and node.keyset:
            t = node.t if node.sort_key else node.j
            out.append(cursors.key_cursor([(c, t[c], kinds[t.name(c)]) for c, _ in node.sort_key or node.junction_sort]).alias("cursor"))
        elif node.edge.connection:
            out.append(F.lit("").alias("cursor"))
        return out

    # edges -------------------------------------------------------------------------------------------------------

    def attach(self, df: DataFrame, parent: PlanNode, o: Output) -> tuple[DataFrame, bool]:
        """Join what the child has for each parent key to the parents."""
        node, edge = o.child, o.child.edge
        assert node is not None
        name = self.child_name(parent, o)
        on = edge.junction.parent if edge.junction else edge.on
        by_key = self.equal(on) and not edge.where_uses_parent
        left = df
        if o.on is not None:
            left = df.filter(parent.t[parent.type.tag] == o.on)

        def keep(rows: DataFrame) -> DataFrame:
            if node.strategy == "batch" and by_key:  # only what belongs to a parent that is there
                near = node.j or node.t
                keys = left.select(*[parent.t[a].alias(f"_b{i}") for i, (a, _) in enumerate(self.listed(on))]).distinct()
                return rows.join(keys, [near[b] == F.col(f"_b{i}") for i, (_, b) in enumerate(self.listed(on))], "left_semi")
            return rows

        above = self.path
        plain = o.on is None and not edge.connection and sum(x.key == o.key for x in parent.outputs.values()) == 1
        self.path = [*above, (o.key, edge.many)] if above is not None and plain else None
        rows, strict = self.rows(node, keep)
        if not by_key and not strict and self.path is not None and (held := self.block(rows, parent, node)) is not None:
            self.path = above
            return df.withColumn(name, held), False
        self.path = above
        near = node.j or node.t
        batch = node.strategy == "batch"
        free = not (batch or edge.paginate)  # its filter also decides about the parents
        if by_key:
            links = [near[b] for _, b in self.listed(on)]
            link = [c.alias(f"_l{i}") for i, c in enumerate(links)]
            match = [parent.t[a] == F.col(f"_l{i}") for i, (a, _) in enumerate(self.listed(on))]
        else:
            held = left.select(*[c for c in df.columns if c.startswith(f"{parent.alias}__") and not c.startswith(f"{parent.alias}___")])
            if parent.j is not None or not parent.type.unique:  # the parent is there once for each of its links
                held = held.dropDuplicates([parent.t.name(k) for k in parent.type.key])
            rows = held.join(rows, self.pairs(on, parent.t, near, node))
            link = [self.key(parent).alias("_l0")]
            match = [self.key(parent) == F.col("_l0")]
        where = self.condition(edge.where, node.t, node, **({"j": node.j} if node.j else {}), **({"parent": parent.t} if not by_key else {}))
        drops = free and (where is not None or strict)
        total_rows = None
        if where is not None:
            if drops and (not by_key or self.passes_null(where, node)):
                # as an outer join would have it, a parent without any partner stays if the filter holds for nulls
                total_rows = rows.select(*link).distinct().withColumn("_any", F.lit(True))
                df = self.lax(df, where, node) if not by_key else df.withColumn("_lax", F.lit(True))
            rows = rows.filter(where)
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        if not edge.many:
            agg = self.single(rows, node, link)
            found = F.col("_v")
        else:
            agg, found = self.listing(rows, node, link, kinds)
        inner = drops and total_rows is None or edge.inner
        n = len(link)
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        out = df.join(agg, cond, "inner" if inner else "left")
        if total_rows is not None:  # parents without any partner pass if the filter holds for nulls
            marks = total_rows.select(*[F.col(f"_l{i}").alias(f"_m{i}") for i in range(n)], "_any")
            again = [parent.t[a] == F.col(f"_m{i}") for i, (a, _) in enumerate(self.listed(on))] if by_key else [self.key(parent) == F.col("_m0")]
            out = out.join(marks, again, "left").filter(F.col("_l0").isNotNull() | (F.col("_any").isNull() & F.col("_lax"))).drop("_any", "_lax", *[f"_m{i}" for i in range(n)])
        if edge.many and not edge.connection:
            found = F.coalesce(F.col("_v"), F.array())
        elif edge.connection:
            empty = F.slice(F.array(F.struct(*self.item_nulls(agg))), 1, 0)
            found = self.connection(node, F.coalesce(F.col("_v"), empty), F.coalesce(F.col("_t"), F.lit(0)), *self.page(node, rows)[1:], kinds)
        out = out.withColumn(name, found)
        return out.drop(*[f"_l{i}" for i in range(n)], "_v", "_t"), drops

    def block(self, rows: DataFrame, parent: PlanNode, node: PlanNode) -> Column | None:
        """For a list by a condition that small children can be filtered by at the end: what stands for it in each parent."""
        edge, on = node.edge, node.edge.on
        if not edge.many or edge.junction or edge.paginate or not node.type.unique or not callable(on) or isinstance(on, Column) or node.limit is not None or node.offset:
            return None
        if self.condition(edge.where, node.t, node, parent=parent.t) is not None or not hasattr(rows, "_jdf"):
            return None
        left, right = blocks.Fields(parent.t, lambda c: parent.t[c]), blocks.Fields(node.t, lambda c: node.t[c])
        cond = on(left, right, node.args, self.ctx)
        if not isinstance(cond, Column):
            return None
        names = [{t.name(c): c for c in f._used} for t, f in ((parent.t, left), (node.t, right))]
        equal, skip = [], []
        for i, x in enumerate(blocks.conjuncts(cond)):
            pair = blocks.equality(x, *names)
            if pair is not None and self.kinds[parent.t.name(pair[0])] == self.kinds[node.t.name(pair[1])]:
                equal.append(pair)
                skip.append(i)
        s, of = self.sort(node)
        sorts = [of(c).alias(f"s{i}") for i, (c, _) in enumerate(s)]
        item = [*[node.t[c].alias(c) for c in right._used], self.value(node).alias("_v")]
        if blocks.size(rows.select(*sorts, *item)) > blocks.LISTED:
            return None
        lists = blocks.listed(rows, [node.t[c] for _, c in equal], sorts, item, lambda a: order.sorted_array(a, [d for _, d in s]))
        self.late.append(blocks.Blocks(list(self.path), lists, equal, skip, lambda p, c: on(p, c, node.args, self.ctx), (parent.t, node.t)))
        return F.struct(F.lit(True).alias("_"), *[parent.t[c].alias(c) for c in left._used])

    def filled(self, rows: DataFrame, node: PlanNode) -> DataFrame:
        """The root's rows with the lists that were left to the end, those further up first."""
        for b in sorted(self.late, key=lambda b: len(b.path)):
            (key, many), *rest = b.path
            (o,) = [x for x in node.outputs.values() if x.key == key]
            column = self.child_name(node, o)
            # a subquery has no place in the functions of lists; the optimizer puts it there from its column
            rows = rows.withColumn("_lists", b.lists.scalar())
            rows = rows.withColumn(column, b.fill(F.col("_lists"), F.col(f"`{column}`"), many, rest)).drop("_lists")
        return rows

    @staticmethod
    def item_nulls(agg: DataFrame) -> list[Column]:
        kind = agg.schema["_v"].dataType.elementType
        return [F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields]

    def passes_null(self, where: Column, node: PlanNode) -> bool:
        """Whether a filter holds for a row of nulls, as an outer join would make it."""
        one = self.lax(self.spark.sql("VALUES (1)"), where, node)  # a local relation: the optimizer folds it, no job runs
        return bool(one.first()["_lax"])

    def lax(self, df: DataFrame, where: Column, node: PlanNode) -> DataFrame:
        """df with _lax: whether a filter of the child holds where the child's columns are null."""
        own = df.columns
        for t in [node.t] + ([node.j] if node.j else []):
            source = load(self.spark, node.type.table if t is node.t else node.edge.junction.table, node.args, self.ctx)
            df = df.select("*", *[F.lit(None).cast(f.dataType).alias(t.name(f.name)) for f in source.schema.fields])
        return df.select(*[F.col(f"`{c}`") for c in own], F.coalesce(where, F.lit(False)).alias("_lax"))

    def single(self, rows: DataFrame, node: PlanNode, link: list[Column]) -> DataFrame:
        """A row for each link: the first object by key, without a grouping if the link is the key."""
        names = [f"_l{i}" for i in range(len(link))]
        on = node.edge.on
        if node.j is None and self.equal(on) and node.type.unique and not node.edge.where_uses_parent and {b for _, b in self.listed(on)} == set(node.type.key):
            return rows.select(*link, self.value(node).alias("_v"))
        s, of = self.sort(node)
        cols = rows.select(*link, F.struct(*[of(c).alias(f"s{i}") for i, (c, _) in enumerate(s)]).alias("_s"), self.value(node).alias("_v"))
        if any(d for _, d in s):
            w = Window.partitionBy(*names).orderBy(*[F.col(f"_s.s{i}").desc_nulls_last() if d else F.col(f"_s.s{i}").asc_nulls_first() for i, (_, d) in enumerate(s)])
            return cols.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_s")
        return cols.groupBy(*names).agg(F.min_by("_v", "_s").alias("_v"))

    def listing(self, rows: DataFrame, node: PlanNode, link: list[Column], kinds: dict) -> tuple[DataFrame, Column]:
        """A row for each link: the array of values in order, of the page only if there is one."""
        names, edge = [f"_l{i}" for i in range(len(link))], node.edge
        if not node.type.unique or node.j is not None:  # what joins bring twice is one object
            # dealt by link once: duplicates, windows and lists all find it so
            rows = blocks.dealt(rows.withColumn("_k", self.key(node)).select(*link, "*"), names)
            if node.j is not None or any(c[2:] not in node.type.key for c, _ in self.sort(node)[0]):
                w = Window.partitionBy(*names, "_k").orderBy(*self.precedence(rows, node))
                rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_k")
            else:  # the order can't tell the rows of an object apart
                rows = rows.dropDuplicates([*names, "_k"]).drop("_k")
            link = [F.col(n) for n in names]
        elif blocks.tasks(rows):
            rows = blocks.dealt(rows.select(*link, "*"), names)
            link = [F.col(n) for n in names]
        total = None
        if edge.connection and edge.paginate and self.wants(node, "total"):
            total = rows.select(*link).groupBy(*names).agg(F.count("*").alias("_t"))
        rows, size, offset = self.page(node, rows)
        s, of = self.sort(node)
        sorts = [of(c).alias(f"s{i}") for i, (c, _) in enumerate(s)]
        if size is not None or offset:
            w = Window.partitionBy(*names).orderBy(*order.columns(s, of))
            rows = rows.select(*link, "*") if not set(names) <= set(rows.columns) else rows
            link = [F.col(n) for n in names]
            rows = rows.withColumn("_n", F.row_number().over(w))
            if size is not None:
                rows = rows.filter(F.col("_n") <= offset + size + (1 if edge.paginate else 0))
            rows = rows.filter(F.col("_n") > offset) if offset else rows
        item = self.item(node, kinds)
        flat = rows.select(*link, F.struct(*sorts, F.struct(*item).alias("item")).alias("_s"))
        agg = flat.groupBy(*names).agg(F.collect_list("_s").alias("_a"))
        ordered = order.sorted_array(F.col("_a"), [d for _, d in s])
        pick = (lambda x: x["item"]) if edge.connection else (lambda x: x["item"]["value"])
        agg = agg.select(*names, F.transform(ordered, pick).alias("_v"))
        if edge.connection:
            if total is not None:
                agg = agg.join(total, names)
            else:
                agg = agg.withColumn("_t", F.lit(0).cast("long"))
        return agg, F.col("_v")

    # roots -------------------------------------------------------------------------------------------------------

    def root(self, node: PlanNode, extra: Callable[[Table], Column] | None = None) -> DataFrame:
        """A row for each root object; for a connection, its one row."""
        state: dict[str, Any] = {}

        def keep(df: DataFrame) -> DataFrame:
            where = self.condition(node.edge.where, node.t, node)
            if where is not None:
                df = df.filter(where)
            if extra is not None:
                df = df.filter(extra(node.t))
            if not node.type.unique:
                df = df.dropDuplicates([node.t.name(k) for k in node.type.key])
            if node.edge.connection and node.edge.paginate and self.wants(node, "total"):
                state["total"] = df.agg(F.count("*").alias("_t"))
            df, size, offset = self.page(node, df)
            state.update(size=size, offset=offset)
            if size is not None or offset:
                s, of = self.sort(node)
                sort, top = order.columns(s, of), None if size is None else size + (1 if node.edge.paginate else 0)
                if offset + (top or 0) > DEEP:  # a top-k heap of this size would have to fit in memory; sorting spills
                    n = F.row_number().over(Window.orderBy(*sort))
                    past = F.col("_n") > offset
                    df = df.withColumn("_n", n).filter(past if top is None else past & (F.col("_n") <= offset + top)).drop("_n")
                else:
                    df = df.orderBy(*sort)
                    df = df.offset(offset) if offset else df
                    df = df.limit(top) if top is not None else df
            elif not node.edge.many:
                df = df.limit(1)
            state["own"] = df
            return df

        self.path = None if node.edge.connection else []
        rows, _ = self.rows(node, keep)
        s, of = self.sort(node)
        if not node.edge.connection:
            asked = order.columns(s, of) if node.order_by or node.sort_key else []
            if self.late and node.edge.many:
                rows = blocks.deal(rows, asked, [node.t[k] for k in node.type.key], blocks.size(state["own"]))
            elif asked:
                n = blocks.tasks(rows) if node.edge.many and not state["size"] else 0
                rows = rows.repartitionByRange(n, *asked).sortWithinPartitions(*asked) if n else rows.orderBy(*asked)
            return self.filled(rows, node).select(*self.values(node))
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        sorts = [of(c).alias(f"s{i}") for i, (c, _) in enumerate(s)]
        one = rows.select(F.struct(*sorts, F.struct(*self.item(node, kinds)).alias("item")).alias("_s")).agg(F.collect_list("_s").alias("_a"))
        items = F.transform(order.sorted_array(F.col("_a"), [d for _, d in s]), lambda x: x["item"])
        total = state["total"].scalar() if "total" in state else F.lit(0)
        one = one.select(items.alias("_v"), total.alias("_t"))
        shaped = one.select(self.connection(node, F.col("_v"), F.col("_t"), state["size"], state["offset"], kinds).alias("c"))
        return shaped.select("c.*")

    # flat rows ---------------------------------------------------------------------------------------------------

    def flat(self, node: PlanNode) -> DataFrame:
        """Unnested rows with path-prefixed names, as one chain of outer joins; every filter is in one place at the end."""
        wheres: list[Column] = []
        orders: list[Column] = []

        def walk(df: DataFrame | None, n: PlanNode, parent: PlanNode | None) -> DataFrame:
            rows, n.t = self.scan(n.type.table, n.alias, n.args)
            if n.edge.junction:
                j, n.j = self.scan(n.edge.junction.table, f"{n.alias}j", n.args)
                df = df.join(j, self.pairs(n.edge.junction.parent, parent.t, n.j, n), "left")
                df = df.join(rows, self.pairs(n.edge.junction.child, n.j, n.t, n), "left")
                where = self.condition(n.edge.junction.where, n.j, n)
                if where is not None:
                    wheres.append(where)
            elif df is not None:
                df = df.join(rows, self.pairs(n.edge.on, parent.t, n.t, n), "left")
            else:
                df = rows
            if n.limit is not None or n.edge.paginate or isinstance(n.type, Polymorphic):
                raise SchemaError(f"{n.key} has no flat form")
            where = self.condition(n.edge.where, n.t, n, **({"parent": parent.t} if parent else {}))
            if where is not None:
                wheres.append(where)
            if n.order_by or n.junction_order:
                s, of = self.sort(n)
                orders.extend(order.columns(s, of))
            for c in n.children:
                df = walk(df, c, n)
            return df

        def names(n: PlanNode, path: str) -> list[tuple[str, Column]]:
            hidden = [n.type.column] if isinstance(n.type, ScalarTable) else n.type.always_fetch
            out = [(f"{path}{k}", n.t[k]) for k in (*n.type.key, *hidden)]
            if n.edge.junction:
                out += [(f"{path}{k}", n.j[k]) for k in n.edge.junction.always_fetch]
            for o in n.outputs.values():
                if o.kind == "leaf":
                    out.append((f"{path}{o.key}", self.leaf(n, o)))
                elif o.child is not None:
                    out += names(o.child, f"{path}{o.key}__")
            return out

        df = walk(None, node, None)
        for w in wheres:
            df = df.filter(w)
        if orders:
            df = df.orderBy(*orders)
        first: dict[str, Column] = {}
        for k, c in names(node, ""):
            first.setdefault(k, c)
        return df.select(*[c.alias(k) for k, c in first.items()])
