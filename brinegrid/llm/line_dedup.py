"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every run of three consecutive lines of a document is hashed; the first occurrence of a window in the order
(doc_id, line number) stays, and the lines covered by any later occurrence are removed, overlaps merged.

Defined cases: null or empty text has no lines and loses none; texts of fewer than three lines lose none; windows of
three empty lines never count; rows that share id and text are one document and get one decision; a null id sorts
first; extra columns, whatever their names, are carried through untouched, but for columns named as those added, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, met, row_key

WINDOW = 3


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once a row (a lambda variable is never inlined)."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def _windows(text: Column, width: int) -> Column:
    def of(lines: Column) -> Column:
        at = lambda i: [F.get(lines, i + k) for k in range(width)]
        every = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(F.array().cast("array<int>"))
        some = F.filter(every, lambda i: F.greatest(*[F.length(x) for x in at(i)]) > 0)
        return F.transform(some, lambda i: F.struct(F.xxhash64(*at(i)).alias("h"), F.hash(*at(i)).alias("g"), i.alias("line")))

    return bind(_lines(text), of)


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, rid, starts): for each document the first lines of its windows that occurred before."""
    rows = docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rid"), F.explode(_windows(F.col(text_col), width)).alias("w")
    ).select("id", "rid", "w.h", "w.g", "w.line")
    place = F.struct("id", "rid", "line")
    # counted and reduced before the shuffle, so a window that many documents share arrives as a row for each task
    first = rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    first = materialise(first.filter("n > 1 and first != last").select("h", "g", "first", "n"), "windows")
    later = met(rows, first, ["h", "g"], "n").filter(place != F.col("first"))
    return later.groupBy("id", "rid").agg(F.collect_set("line").alias("starts"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, out: str = "kept_text", counts: bool = True
) -> DataFrame:
    """`docs` with the column `out`: the text without the lines of repeated windows; `counts` adds n_lines, n_removed."""
    names = docs.columns
    # the other columns travel as one struct, so that no names can clash
    others = [c for c in names if c not in (id_col, text_col)]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row"), row_key(id_col, text_col).alias("rid"))
    later = later_windows(docs, id_col, text_col, width).select(F.col("id").alias("late_id"), F.col("rid").alias("late"), "starts")
    # the key of id and text, and the id itself, so that no two ids meet by a collision
    joined = rows.join(later, (F.col("rid") == F.col("late")) & F.col("id").eqNullSafe(F.col("late_id")), "left")

    def keep(lines: Column) -> Column:
        covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1))))
        return F.when(F.col("starts").isNull(), _upto(lines)).otherwise(F.array_except(_upto(lines), covered))

    done = joined.withColumn(
        "done",
        bind(_lines(F.col("text")), lambda x: bind(keep(x), lambda k: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(k)).alias("gone"), F.array_join(F.transform(k, lambda i: F.get(x, i)), "\n").alias("text")))),
    )
    text = F.when(F.col("done.gone") > 0, F.col("done.text")).otherwise(F.col("text"))
    made = {"n_lines": F.col("done.n").cast("long"), "n_removed": F.col("done.gone").cast("long")} if counts else {}
    made[out] = text
    carried = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col("row").getField(c) for c in others}
    kept = [made.pop(c, carried[c]).alias(c) for c in names]
    return done.select(*kept, *[v.alias(c) for c, v in made.items()])


def _upto(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
