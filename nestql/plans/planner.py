"""From a parsed query and a schema to a tree of plan nodes; all validation happens here."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import QueryError, SchemaError
from ..functions import order
from ..sources.schema import IGNORED, Arg, Col, Deps, Edge, Entity, Plain, Polymorphic, ScalarTable, Schema
from .parser import Document, EnumValue, Field, Spread, Variable


@dataclass
class Output:
    """One entry of a result object: a leaf field, a child, or the type's name."""

    key: str
    kind: str  # leaf, child, typename
    what: Any = None
    name: str = ""
    child: PlanNode | None = None
    args: dict = field(default_factory=dict)
    on: str | None = None  # of this type only


@dataclass
class PlanNode:
    key: str
    edge: Edge
    type: Entity | Polymorphic | ScalarTable
    args: dict
    parent: PlanNode | None
    outputs: dict[tuple[str, str | None], Output] = field(default_factory=dict)
    shape: list = field(default_factory=list)  # of a connection: (key, name, sub-selection)
    order_by: order.Spec = field(default_factory=list)
    junction_order: order.Spec = field(default_factory=list)
    sort_key: order.Spec = field(default_factory=list)
    junction_sort: order.Spec = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    alias: str = ""
    strategy: str = "join"
    t: Any = None  # accessors, set by the compiler
    j: Any = None

    @property
    def children(self) -> list[PlanNode]:
        return [o.child for o in self.outputs.values() if o.child is not None]

    @property
    def keyset(self) -> bool:
        return bool(self.sort_key or self.junction_sort)


_KINDS: dict[str, tuple[type, ...]] = {"Int": (int,), "Float": (float, int), "String": (str,), "Boolean": (bool,), "ID": (str, int)}
_PAGING = ("first", "last", "before", "after")


def coerced(v: Any, kind: Any, where: str) -> Any:
    """v as the type wants it: a name, a list of one type, or (type, whether null is excluded)."""
    if isinstance(kind, tuple):
        if v is None and kind[1]:
            raise QueryError(f"{where} can't be null")
        return coerced(v, kind[0], where)
    if v is None:
        return None
    if isinstance(kind, list):
        return [coerced(x, kind[0], where) for x in (v if isinstance(v, list | tuple) else [v])]
    if kind in _KINDS:
        if not isinstance(v, _KINDS[kind]) or isinstance(v, bool) and kind != "Boolean":
            raise QueryError(f"{where} isn't of type {kind}")
        return float(v) if kind == "Float" else str(v) if kind == "ID" else v
    return v


class Planner:
    def __init__(self, schema: Schema, document: Document, variables: Mapping[str, Any], ctx: Any, strategy: Callable[[str, Edge], str] | None = None):
        self.schema, self.document, self.variables, self.ctx = schema, document, variables, ctx
        self.strategy = strategy or (lambda key, edge: edge.strategy)
        self.count = 0
        self.open: list[str] = []  # fragments that are being opened
        self.declared: set[str] = set(variables)

    def roots(self, operation: str | None = None) -> list[PlanNode]:
        ops = [o for o in self.document.operations if operation in (None, o.name)]
        if len(ops) != 1:
            raise QueryError("name one operation of the document" if ops else "there is no such operation")
        op = ops[0]
        if missing := op.required - set(self.variables):
            raise QueryError(f"variables are missing: {', '.join(sorted(missing))}")
        given = {k: coerced(v, op.types[k], f"${k}") if k in op.types else v for k, v in self.variables.items()}
        if op.types or op.name:
            self.declared = set(op.types)
        self.variables = {**{k: coerced(self.value(v, {}), op.types[k], f"${k}") for k, v in op.variables.items()}, **given}
        out: dict[str, PlanNode] = {}
        for f, _ in self.fields(op.selections, None):
            if f.name.startswith("__"):
                continue
            if f.name not in self.schema.roots:
                raise QueryError(f"no field {f.name} at the root")
            edge = self.schema.roots[f.name]
            if edge.on is not None or edge.junction is not None:
                raise SchemaError(f"root field {f.name} can't join a parent")
            self.merge(out, f, edge, None)
        return list(out.values())

    # values ------------------------------------------------------------------------------------------------------

    def value(self, v: Any, enum: Mapping[str, Any] | None) -> Any:
        if isinstance(v, Variable):
            if v.name not in self.declared:
                raise QueryError(f"no variable ${v.name}")
            v = self.variables.get(v.name)
            return enum[v] if enum and isinstance(v, str) and v in enum else v
        if isinstance(v, EnumValue):
            if enum and v.name not in enum:
                raise QueryError(f"no enum value {v.name}")
            return enum[v.name] if enum else v.name
        if isinstance(v, list):
            return [self.value(x, enum) for x in v]
        if isinstance(v, dict):
            return {k: self.value(x, None) for k, x in v.items()}
        return v

    def arguments(self, f: Field, declared: Mapping[str, Arg], others: tuple[str, ...] | None = ()) -> dict:
        """others: names that needn't be declared, None for any."""
        for k in f.args:
            if others is not None and k not in declared and k not in others:
                raise QueryError(f"{f.name} has no argument {k}")
        out = {k: a.default for k, a in declared.items() if a.default is not None}
        for k, v in f.args.items():
            got = self.value(v, declared[k].enum if k in declared else None)
            if isinstance(v, Variable) and v.name not in self.variables:
                continue
            kind = declared[k].type if k in declared else "Int" if k in ("first", "last") else None
            out[k] = coerced(got, kind, f"{f.name}({k})") if kind else got
        for k, a in declared.items():
            if a.required and out.get(k) is None:
                raise QueryError(f"{f.name} needs the argument {k}")
        return out

    def wanted(self, directives: Mapping[str, dict]) -> bool:
        if "skip" in directives and self.value(directives["skip"].get("if"), None):
            return False
        return not ("include" in directives and not self.value(directives["include"].get("if"), None))

    # selections --------------------------------------------------------------------------------------------------

    def fields(self, selections: list, on: str | None) -> Iterator[tuple[Field, str | None]]:
        """All fields with the type that each is for, fragments opened."""
        for s in selections:
            if not self.wanted(s.directives):
                continue
            if isinstance(s, Field):
                yield s, on
                continue
            spread: Spread = s
            if s.name is not None:
                if s.name not in self.document.fragments:
                    raise QueryError(f"no fragment {s.name}")
                if s.name in self.open:
                    raise QueryError(f"fragment {s.name} holds itself")
                spread = self.document.fragments[s.name]
            self.open.append(spread.name or "")
            yield from self.fields(spread.selections, spread.on or on)
            self.open.pop()

    def merge(self, nodes: dict[str, PlanNode], f: Field, edge: Edge, parent: PlanNode | None) -> PlanNode:
        args = self.arguments(f, edge.args, _PAGING if edge.connection else ())
        if f.alias in nodes:
            node = nodes[f.alias]
            if node.edge is not edge or node.args != args:
                raise QueryError(f"fields named {f.alias} differ; give one an alias")
        else:
            node = nodes[f.alias] = self.node(f.alias, edge, args, parent)
        self.select(node, f)
        return node

    def node(self, key: str, edge: Edge, args: dict, parent: PlanNode | None) -> PlanNode:
        t = self.schema.type(edge.target)
        node = PlanNode(key, edge, t, args, parent, alias=f"n{self.count}")
        self.count += 1
        j = edge.junction
        node.order_by, node.sort_key = (order.spec(x, args, self.ctx) for x in (edge.order_by, edge.sort_key))
        if j:
            if j.parent is None or j.child is None:
                raise SchemaError(f"the junction of {key} needs both joins")
            node.junction_order, node.junction_sort = (order.spec(x, args, self.ctx) for x in (j.order_by, j.sort_key))
        elif parent is not None and edge.on is None:
            raise SchemaError(f"{key} lacks a relation to its parent")
        node.strategy = self.strategy(key, edge)
        if node.strategy not in ("join", "batch"):
            raise SchemaError(f"no strategy {node.strategy}")
        plain = lambda v: v(args, self.ctx) if callable(v) else v
        node.limit, node.offset = plain(edge.limit), plain(edge.offset) or 0
        if edge.paginate:
            if not edge.connection:
                raise SchemaError(f"{key} is paginated but no connection")
            if node.sort_key and node.junction_sort or node.order_by and node.junction_order:
                raise SchemaError(f"{key}: sort on the junction or on the main table, not both")
            if not (node.keyset or node.order_by or node.junction_order):
                raise SchemaError(f"{key}: paging needs sort_key or order_by")
            first, last = args.get("first"), args.get("last")
            for size in (first, last):
                if size is not None and edge.page_limit is not None and size > edge.page_limit:
                    raise QueryError(f"{key}: at most {edge.page_limit} items a page")
                if size is not None and size < 0:
                    raise QueryError(f"{key}: a page size can't be negative")
            if node.keyset:
                if first is not None and args.get("before") is not None:
                    raise QueryError('"before" with "first" makes no sense')
                if last is not None and args.get("after") is not None:
                    raise QueryError('"after" with "last" makes no sense')
            elif last is not None or args.get("before") is not None:
                raise QueryError("paging by offsets goes forward only")
        elif node.limit is not None and not (node.order_by or node.junction_order or node.keyset):
            raise SchemaError(f"{key}: a limit needs an order")
        return node

    def select(self, node: PlanNode, f: Field) -> None:
        if isinstance(node.type, ScalarTable):
            if f.selections:
                raise QueryError(f"{f.name} is scalar")
            return
        if not f.selections:
            raise QueryError(f"{f.name} needs a selection")
        if not node.edge.connection:
            self.entries(node, f.selections)
            return
        node.shape = self.connection(node, f.selections, ("total", "pageInfo", "edges"), node.shape)

    def connection(self, node: PlanNode, selections: list, names: tuple[str, ...], shape: list) -> list:
        """The layers around the nodes of a connection."""
        inner = {"pageInfo": ("hasNextPage", "hasPreviousPage", "startCursor", "endCursor"), "edges": ("cursor", "node")}
        shape = list(shape)
        for f, _ in self.fields(selections, None):
            if f.name.startswith("__"):
                continue
            if f.name not in names:
                raise QueryError(f"no field {f.name} in a connection")
            known = next((s for s in shape if s[0] == f.alias), None)
            if f.name == "node":
                self.entries(node, f.selections)
                sub: list = []
            else:
                sub = self.connection(node, f.selections, inner[f.name], known[2] if known else []) if f.name in inner else []
            if known:
                shape[shape.index(known)] = (f.alias, f.name, sub)
            else:
                shape.append((f.alias, f.name, sub))
        return shape

    def picked(self, selections: list, known: dict) -> dict:
        """Of a column of objects: alias -> (name, the same of its own selection)."""
        out = dict(known)
        for f, _ in self.fields(selections, None):
            if not f.name.startswith("__"):
                out[f.alias] = (f.name, self.picked(f.selections, out[f.alias][1] if f.alias in out else {}))
        return out

    def entries(self, node: PlanNode, selections: list) -> None:
        t = node.type
        many = isinstance(t, Polymorphic)
        for f, on in self.fields(selections, None):
            if on is not None and on != t.name and on not in t.interfaces:
                if not (many and on in t.types):
                    continue  # a fragment on another type
            else:
                on = None
            key = (f.alias, on)
            if f.name == "__typename":
                node.outputs.setdefault(key, Output(f.alias, "typename", on=on))
                continue
            if f.name.startswith("__"):
                continue
            what = t.fields.get(f.name)
            if on is not None:
                what = t.types[on].get(f.name, what)
            if what is None and node.edge.junction:
                what = node.edge.junction.include.get(f.name)
            elif node.edge.junction and f.name in node.edge.junction.include:
                what = node.edge.junction.include[f.name]
            if what is None:
                raise QueryError(f"no field {f.name} in {t.name}")
            if what is IGNORED:
                continue
            if isinstance(what, Edge):
                nodes = {o.key: o.child for o in node.outputs.values() if o.child is not None and o.on == on}
                child = self.merge(nodes, f, what, node)
                node.outputs.setdefault(key, Output(f.alias, "child", what, f.name, child, on=on))
                continue
            if isinstance(what, Plain):
                if not f.selections:
                    raise QueryError(f"{f.name} needs a selection")
                known = node.outputs.setdefault(key, Output(f.alias, "plain", what, f.name, args={}, on=on))
                known.args = self.picked(f.selections, known.args)
                continue
            if f.selections:
                raise QueryError(f"{f.name} is scalar")
            args = self.arguments(f, {}, () if isinstance(what, Col | Deps) else None)
            if key in node.outputs and (node.outputs[key].name, node.outputs[key].args) != (f.name, args):
                raise QueryError(f"fields named {f.alias} differ; give one an alias")
            node.outputs.setdefault(key, Output(f.alias, "leaf", Col(f.name) if isinstance(what, Col) and what.column is None else what, f.name, args=args, on=on))
