"""Sort specifications and what is built from them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaError

Spec = list[tuple[str, bool]]  # column, descending


def spec(value: Any, args: Mapping, ctx: Any) -> Spec:
    """From "col", {"col": "desc"}, [{"column", "direction"}], {"order", "key"}, pairs, or a callable of (args, ctx)."""
    if callable(value):
        value = value(args, ctx)
    if value is None:
        return []
    if isinstance(value, str):
        return [(value, False)]
    if isinstance(value, Mapping):
        if set(value) == {"order", "key"}:
            keys = [value["key"]] if isinstance(value["key"], str) else list(value["key"])
            return [(k, direction(value["order"])) for k in keys]
        return [(c, direction(d)) for c, d in value.items()]
    if isinstance(value, Sequence):
        out = []
        for x in value:
            if isinstance(x, Mapping) and "column" in x:
                out.append((x["column"], direction(x.get("direction", "asc"))))
            elif isinstance(x, Sequence) and not isinstance(x, str) and len(x) == 2:
                out.append((x[0], direction(x[1])))
            else:
                raise SchemaError(f"not a sort column: {x!r}")
        return out
    raise SchemaError(f"not a sort specification: {value!r}")


def direction(value: str) -> bool:
    text = str(value).lower()
    if text not in ("asc", "desc"):
        raise SchemaError(f"not a direction: {value!r}")
    return text == "desc"


def flipped(s: Spec) -> Spec:
    return [(c, not d) for c, d in s]


def columns(s: Spec, of: Callable[[str], Column]) -> list[Column]:
    """Ascending puts nulls first and descending last, so that flipping an order reverses it."""
    return [of(c).desc_nulls_last() if d else of(c).asc_nulls_first() for c, d in s]


def sorted_array(array: Column, directions: Sequence[bool]) -> Column:
    """Sort an array of structs by their first fields s0, s1, ... in the directions given."""
    if not any(directions):
        return F.sort_array(array, True)
    if all(directions):
        return F.sort_array(array, False)

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, desc in reversed(list(enumerate(directions))):
            x, y, one = a[f"s{i}"], b[f"s{i}"], F.lit(-1 if desc else 1)
            less = (x < y) | (x.isNull() & y.isNotNull())
            more = (x > y) | (x.isNotNull() & y.isNull())
            out = F.when(less, -one).when(more, one).otherwise(out)
        return out

    return F.array_sort(array, before)
