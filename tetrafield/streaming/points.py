"""Streams of points against fixed models: the same hash join, without state; the fold runs within each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import locate
from ..schema import ALL, ModelRange


def hits(stream: DataFrame, index: locate.Index, models: ModelRange = ALL) -> DataFrame:
    """A stream of hits: a stream-static join, which keeps no state."""
    return locate.hits(stream, index, models)


def composite(stream: DataFrame, index: locate.Index, sink: Callable[[DataFrame, int], None], checkpoint: str, models: ModelRange = ALL, **trigger) -> StreamingQuery:
    """Samples every micro-batch and hands it to `sink(rows, batch_id)`, which should be idempotent by batch."""

    def each(batch: DataFrame, n: int) -> None:
        sink(locate.composite(batch, index, models), n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
