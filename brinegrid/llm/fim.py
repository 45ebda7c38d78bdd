"""Fill-in-middle transformation of whole texts by two passes of a lazy matcher.

A text is cut into units (white space with the word behind it, or white space alone). The first pass of the matcher only
counts them; two hashes of the row's id then fix two ranks, and the second pass steps a fresh match iterator as far as the
second rank and notes two offsets. Units are never stored, so beside the text itself a row needs constant memory. The
offsets go back to Spark, whose expressions build the output and rebuild the text from it.

Defined cases: null text is empty, and an empty text is plain; a text that holds a marker is plain, so every output can be
taken apart again; a null id hashes as an empty one; rows are independent, so ties and repeated rows need no rule and equal
ids get equal ranks; a text of any length is one row; an empty table gives an empty result. Columns of the input other than
id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of prefix, suffix and middle; white space parts words.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile("[\x20\x09-\x0d]*+[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def count_units(text: str) -> int:
    """First pass: the number of units."""
    return sum(1 for _ in UNIT.finditer(text))


def offsets(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: the code points before which `first` and `second` units (first <= second) have ended."""
    matches = UNIT.finditer(text)

    def advance(steps: int, at: int) -> int:
        last = deque(islice(matches, steps), maxlen=1)
        return last[0].end() if last else at

    start = advance(first, 0)
    return start, advance(second - first, start)


def _places(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, plain, one, two in batches:
        rows = []
        for text, whole, a, b in zip(texts, plain, one, two, strict=True):
            n = count_units(text)
            rows.append((n, 0, 0) if whole else (n, *offsets(text, *sorted((a % (n + 1), b % (n + 1))))))
        yield pd.DataFrame(rows, columns=["n", "start", "stop"], dtype="int64")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output); `percent` of the texts are transformed, `spm_percent` of these suffix first.

    The four hashes of a row are the first four groups of eight hexadecimal digits of the sha256 of seed:id.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    part = lambda k: F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (part(2) % 100 >= percent), "plain").when(part(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "one": part(0), "two": part(1)})
    places = F.pandas_udf(_places, "n long, start long, stop long")
    cut = rows.withColumn("at", places("text", F.col("form") == "plain", "one", "two"))
    piece = lambda start, size: F.substring(F.col("text"), start + 1, size)
    start, stop = F.col("at.start").cast("int"), F.col("at.stop").cast("int")
    prefix, middle, suffix = piece(F.lit(0), start), piece(start, stop - start), piece(stop, F.length("text"))
    cut = cut.withColumn(
        "output",
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text")),
    )
    kept = lambda c: F.when(F.col("form") != "plain", c)
    return cut.select("doc_id", "text", F.col("at.n").alias("n"), "form", kept(F.col("at.start")).alias("prefix_chars"), kept(F.col("at.stop") - F.col("at.start")).alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of `transform` was made from.

    No piece holds a marker, and a marker begins with its only "<" and ends with its only ">", so markers cannot arise where
    pieces meet: the three found are the three put in.
    """
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(2)))
    spm = F.concat(F.get(pieces, F.lit(2)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
