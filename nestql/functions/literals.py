"""Values as Columns and as SQL text, for filters that are written as text."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value: Any) -> str:
    """SQL text that stands for a value, whatever characters it holds."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, dt.datetime):
        utc = value.astimezone(dt.UTC) if value.tzinfo else value
        return f"TIMESTAMP '{utc:%Y-%m-%d %H:%M:%S.%f} UTC'"
    if isinstance(value, dt.date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, (list, tuple)):
        return "(" + ", ".join(map(sql_literal, value)) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(value: Any) -> Column:
    """A Column of a value; Columns pass."""
    return value if isinstance(value, Column) else F.lit(value)
