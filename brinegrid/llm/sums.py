"""Sums of arrays of fixed size over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = 16


def summed(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over tasks of an array of fixed size; tasks' arrays meet in groups of at most 64 a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array_split(work(batches).astype("<f4"), PIECES)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], ["part", "piece", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) for x in table.column("data"))
        return pa.table({"part": table.column("part")[:1], "piece": table.column("piece")[:1], "data": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    level = 1
    while level * 64 < rows.rdd.getNumPartitions():
        level *= 64
    kind = "part int, piece int, data binary"
    parts = rows.mapInArrow(run, kind)
    while level:
        parts = parts.withColumn("part", F.col("part") % level).groupBy("part", "piece").applyInArrow(add, kind)
        level //= 64
    got = {r["piece"]: np.frombuffer(r["data"], "<f4") for r in parts.collect()}
    return np.concatenate([got[k] for k in range(PIECES)]).astype(np.float64) if got else np.zeros(size)
