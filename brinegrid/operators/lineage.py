"""Cuts of lineage between the rounds of an iteration, and the size check before a broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of cells is broadcast; larger ones are met in a shuffle.
BROADCAST_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset and the session is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='brinegrid-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def unsized(df: DataFrame) -> DataFrame:
    """`df` marked so that no join broadcasts it unasked, for rows that Spark takes for far fewer than they are.

    Its estimate is the size of the files that rows come from, through generators, Arrow functions and checkpoints that multiply
    them; by it a raster or a walk of millions of rows goes to the driver. The mark of `bounded`, which counts, is the stronger one.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder; joins do not broadcast it unasked."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return unsized(df.checkpoint())


def few(df: DataFrame) -> bool:
    """Whether `df` has at most BROADCAST_ROWS rows; counts no further than that bound."""
    return df.select(df.columns[0]).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def bounded(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it has at most BROADCAST_ROWS rows, else for a shuffle.

    Spark cannot see the size of a checkpoint, so without the mark a small table would cost a shuffle of the large side.
    """
    return F.broadcast(df) if few(df) else unsized(df)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over a fixed number of partitions, for rows that multiply in the tasks that follow.

    Adaptive execution sizes partitions by the bytes that come in; it would put a small table that grows a thousandfold into one
    task. An aggregation over `keys` afterwards needs no further shuffle.
    """
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), *keys)
