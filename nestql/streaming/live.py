"""An entity fed by Structured Streaming: a query runs over each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.schema import Schema


def each_batch(stream: DataFrame, build: Callable[[DataFrame], Schema], text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, variables: Mapping[str, Any] | None = None, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """build: the schema whose entity has the batch as its table. sink gets each result and the batch's number.

    A batch may be repeated after a failure, with the same number; the sink decides what that means.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(Engine(batch.sparkSession, build(batch)).query(text, variables), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
