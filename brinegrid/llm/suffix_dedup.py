"""Suffix-array dedup: remove the bytes of 400-byte strings that occur elsewhere in the corpus, by prefix doubling.

The suffixes that are ranked are those that start at an anchor of a stretch that the sieve left (sieve.py): places that the
bytes around them decide, at most 100 bytes apart, so that equal strings hold them at equal offsets (a sparse suffix array).
A suffix's first rank is the name of the 101 bytes at its anchor. In each round Spark pairs the rank of every place with
the rank at the place as many anchors on as the rank covers, sorts the pairs (rank, offset in bytes, rank there) and ranks them
anew by their order. Places whose rank is unique are dropped, for a longer prefix is unique as well; so are those whose
prefix passes the threshold of 400 bytes. With the ranks of 1, 2, 4, ... anchors any run of anchors is named by two ranks that
overlap. A 400-byte string is named by the run from its first to its last anchor; the few bytes on either side are compared
last, from blocks of 16 strings down to single ones, so the cut is exact to the byte (up to collisions of 128 bits).

Defined cases: null or empty text, and text shorter than 400 bytes, loses nothing; strings never cross documents; strings
that overlap in one document count; rows that share id and text are copies of each other; an empty table gives none; null ids are
carried through; extra columns are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SECOND_BASE, Spans, Texts, slices
from .scratch import materialise, met
from .sieve import NAMES, SLICE, Units, anchors, cores, cut_repeats, lists, named, salted, settled

BYTES = 400


def _places(units: Units) -> Callable:
    """Anchor number j of each carrier: its place s, the end e of its gram and the gram's name as first rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "content", SLICE):
                codes, offsets = units.sequence(Texts(part.column("content")))
                a = anchors(codes, offsets, units.part, units.gram)
                s = a.s - offsets[a.text]
                of = pa.array(a.text)
                columns = [part.column("cid").take(of), part.column("weight").take(of), *(pa.array(x.astype(np.int32)) for x in (a.nth(), s, s + units.gram)), pa.array(a.h.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "w", "j", "s", "e", "rank"])

    return run


def doubled(held: DataFrame, units: Units) -> list[DataFrame]:
    """(cid, j, rank) of the places whose prefix of 1, 2, 4, ... anchors occurs again, a table for each."""
    rows = materialise(held.mapInArrow(_places(units), "cid bigint, w bigint, j int, s int, e int, rank bigint"), "places")
    seen = rows.groupBy("rank").agg(F.count("*").alias("c"), F.sum("w").alias("weight")).filter("weight > 1").select("rank", "c")
    level = materialise(met(rows, materialise(seen, "grams"), ["rank"]).drop("c"), "ranks")
    levels, reach = [], 1
    while not level.isEmpty():
        levels.append(level.select("cid", "j", "rank"))
        ahead = level.select("cid", (F.col("j") - reach).alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("rank").alias("there"))
        pairs = level.join(ahead, ["cid", "j"]).filter(F.col("e2") - F.col("s") <= units.window)
        pairs = materialise(pairs.select("cid", "w", "j", "s", F.col("e2").alias("e"), "rank", (F.col("s2") - F.col("s")).alias("offset"), "there"), "pairs")
        key = ["rank", "offset", "there"]
        again = pairs.groupBy(key).agg(F.count("*").alias("c"), F.sum("w").alias("weight")).filter("weight > 1").drop("weight")
        # the place in the sorted order is the new rank; the order of partitions is that of the sort
        ranked = materialise(again.orderBy(key).withColumn("next", F.monotonically_increasing_id()), "sorted")
        level = materialise(met(pairs, ranked, key).select("cid", "w", "j", "s", "e", F.col("next").alias("rank")), "ranks")
        reach *= 2
    return levels


def _named(units: Units) -> Callable:
    """Runs of windows, named by the two ranks that cover their anchors; windows with a unique part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "content", SLICE):
                codes, offsets = units.sequence(Texts(part.column("content")))
                a = anchors(codes, offsets, units.part, units.gram)
                first = np.searchsorted(a.text, np.arange(part.num_rows))
                got, row = lists(part, "ranks")
                c = cores(a, offsets, units)
                m = c.l - c.f + 1
                t = np.frexp(m.astype(np.float64))[1] - 1
                ranks = np.full((int(max(t.max(initial=0), got["t"].max(initial=0))) + 1, len(a.text)), -1, np.int64)
                known = np.zeros(ranks.shape, bool)
                ranks[got["t"], first[row] + got["j"]] = got["rank"]
                known[got["t"], first[row] + got["j"]] = True
                back = c.l - (1 << t) + 1
                fit = known[t, c.f] & known[t, back]
                text, i, n, f, last, t, back = (x[fit] for x in (c.text, c.i, c.n, c.f, c.l, t, back))
                g = salted(ranks[t, f].view(np.uint64), ranks[t, back], a.s[last] - a.s[f], t)
                r = salted(Spans(codes, SECOND_BASE).at(i, i + n - 1 + units.window), a.s[f] - i, n)
                cid, weight = part.column("cid").to_numpy()[text], part.column("weight").to_numpy()[text]
                yield named(g, r, cid, i - offsets[text], n, a.s[f] - i, weight, np.ones(len(i), bool))

    return run


def repeated(held: DataFrame, units: Units) -> DataFrame:
    """(cid, i, n): the runs of windows of carriers that occur again."""
    levels = doubled(held, units)
    spark = held.sparkSession
    if not levels:
        return spark.createDataFrame([], "cid bigint, i int, n int")
    every = None
    for t, level in enumerate(levels):
        one = level.select("cid", F.struct(F.lit(t).alias("t"), "j", "rank").alias("x"))
        every = one if every is None else every.unionByName(one)
    put = held.join(every.groupBy("cid").agg(F.collect_list("x").alias("ranks")), "cid")
    return settled(held, materialise(put.mapInArrow(_named(units), NAMES), "cores"), units, (16, 1))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = BYTES) -> DataFrame:
    """(id, units, removed, spans, kept): spans of removed bytes, kept bytes as binary (a cut may split a letter)."""
    units = Units("bytes", length, length // 2)
    return cut_repeats(docs, units, id_col, text_col, lambda held: repeated(held, units))
