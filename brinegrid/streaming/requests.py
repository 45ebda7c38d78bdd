"""A stream of route requests: each micro-batch is answered by the batch route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.grid import Grid
from ..plans.route import Settings, route

REQUEST = "route_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, draft double"


def answered(requests: DataFrame, layers: DataFrame, grid: Grid, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Start a query over a streaming DataFrame of requests; `sink` gets each batch's paths and its number."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(route(batch, layers, grid, settings), number)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
