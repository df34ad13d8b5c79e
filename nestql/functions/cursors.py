"""Opaque cursors: an offset, or the sort columns of a row as JSON, in base 64."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .order import Spec

PREFIX = "arrayconnection:"  # fixed by the cursor format


def encode(text: Column) -> Column:
    """Base 64 in one line: Spark breaks long ones."""
    return F.translate(F.base64(text.cast("binary")), "\r\n", "")


def offset_cursor(position: Column) -> Column:
    return encode(F.concat(F.lit(PREFIX), position.cast("string")))


def key_cursor(values: list[tuple[str, Column, T.DataType]]) -> Column:
    """JSON of the columns in order; nulls stay, timestamps have milliseconds."""
    out = []
    for name, value, kind in values:
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        out.append(value.alias(name))
    return encode(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}))


def make(value: dict | int) -> str:
    text = f"{PREFIX}{value}" if isinstance(value, int) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return base64.b64encode(text.encode()).decode()


def read_offset(cursor: str) -> int:
    try:
        text = base64.b64decode(cursor, validate=True).decode()
        if not text.startswith(PREFIX):
            raise ValueError
        return int(text[len(PREFIX) :])
    except ValueError as e:
        raise QueryError(f"not an offset cursor: {cursor!r}") from e


def read_key(cursor: str, wanted: list[str]) -> dict:
    try:
        value = json.loads(base64.b64decode(cursor, validate=True))
        if not isinstance(value, dict):
            raise ValueError
    except ValueError as e:
        raise QueryError(f"not a cursor: {cursor!r}") from e
    if extra := [k for k in value if k not in wanted]:
        raise QueryError(f"the cursor has columns that aren't sorted by: {', '.join(extra)}")
    if missing := [k for k in wanted if k not in value]:
        raise QueryError(f"the cursor lacks columns: {', '.join(missing)}")
    return value


def after(cursor: dict, s: Spec, of: Callable[[str], Column], kind: Callable[[str], T.DataType]) -> Column:
    """Rows past the cursor in the order s, nulls placed as the order places them."""
    out, equal = F.lit(False), F.lit(True)
    for name, desc in s:
        col, t, value = of(name), kind(name), cursor[name]
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_trunc("millisecond", col)
            lit = F.lit(value).cast("timestamp") if value is not None else F.lit(None).cast("timestamp")
        else:
            lit = F.lit(value).cast(t)
        if value is None:
            past = F.lit(False) if desc else col.isNotNull()
            same = col.isNull()
        else:
            past = ((col < lit) | col.isNull()) if desc else (col > lit)
            same = col == lit
        out = out | (equal & F.coalesce(past, F.lit(False)))
        equal = equal & F.coalesce(same, F.lit(False))
    return out
