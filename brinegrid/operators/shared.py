"""Answers that rows share: what depends on some columns alone is computed once for all rows that are alike in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, few, spread_out

#: The columns of a line between two cells.
ENDS = ("x0", "y0", "x1", "y1")


def members(asked: DataFrame, by: tuple[str, ...], key: str = "route_id", repeats: bool = False) -> DataFrame:
    """(key, by, like): `like` is the smallest key among the rows that are alike in `by` (nulls are alike), which stands for all.

    Rows that repeat in key and `by` count once, or as often as they come with `repeats`.
    """
    dealt = spread_out(asked.select(key, *by), *by)
    dealt = dealt if repeats else dealt.distinct()
    return cut(dealt.withColumn("like", F.min(key).over(Window.partitionBy(*by))))


def unlike(found: DataFrame, by: tuple[str, ...], key: str = "route_id") -> DataFrame:
    """(key, by): one row for each `like` of members."""
    return found.filter(F.col(key) == F.col("like")).select(key, *by).distinct()


def given_out(answers: DataFrame, found: DataFrame, key: str = "route_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of answers (key, ...) for every row of members that they stand for, with the members' columns `keep`.

    Members are broadcast while they are few; else both sides meet by `like`, and a task holds its share of the members while answers
    pass by. What they multiply to is never shuffled, nor are answers that are dealt by their key already.
    """
    names, answered, given = [*answers.columns, *keep], answers.withColumnRenamed(key, "like"), found.select(key, "like", *keep)
    # of two sides with this hint Spark holds the one whose rows it takes for fewer or narrower, which are the members
    given, answered = (F.broadcast(given), answered) if few(given) else (given.hint("shuffle_hash"), answered.hint("shuffle_hash"))
    return answered.join(given, "like").select(*names)


def once(asked: DataFrame, by: tuple[str, ...], answer: Callable[[DataFrame], DataFrame], key: str = "route_id", repeats: bool = False) -> DataFrame:
    """`answer` of rows (key, by), which must depend on `by` alone: computed once for the rows that are alike, given to each key."""
    found = members(asked, by, key, repeats)
    return given_out(answer(unlike(found, by, key)), found, key)
