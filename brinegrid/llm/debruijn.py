"""Substring dedup: remove the words of 35-word windows that occur elsewhere in the corpus, by a compacted de Bruijn graph.

The graph is that of the stretches that the sieve left (sieve.py), in minimizer space: nodes are twelve-word grams at anchors,
places that the words around them decide, at most eleven words apart; an edge is a node, the distance to the next anchor, and that
anchor's node, so it stands for the 13 to 23 words from one gram's start to the other's end. Every window holds an edge.

1. Edges are counted; those seen once are dropped.
2. A node with one edge in and one out does not branch. Spark joins link each edge to the one before it over such a node, and
   pointer doubling compacts the links: every edge gets its path (the path's first edge) and its place on it.
3. The coordinates (carrier, anchor) of the edges are joined with the paths. A window's core, from its first to its last anchor,
   is a stretch of one path, or a walk over several where nodes branch. Cores that coordinates show twice are verified: the few
   words on either side are compared window by window.

Defined cases: null text has no words; texts of fewer than 35 words lose none; windows never cross documents; windows that
overlap in one document count; rows that share id and text are copies of each other; edges on a ring without a branch are
paths of their own; an empty table gives none; null ids are carried through; extra columns are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SECOND_BASE, Spans, Texts, mix, slices
from .scratch import materialise, met
from .sieve import NAMES, Units, anchors, cores, cut_repeats, lists, named, salted, settled

WORDS = 35


def _edges(units: Units) -> Callable:
    """Edge number j of each carrier, from anchor j to the next: nodes src and dst, and the step between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "content"):
                codes, offsets = units.sequence(Texts(part.column("content")))
                a = anchors(codes, offsets, units.part, units.gram)
                at = np.flatnonzero(a.text[1:] == a.text[:-1])
                of = pa.array(a.text[at])
                columns = [part.column("cid").take(of), part.column("weight").take(of), pa.array(a.nth()[at].astype(np.int32))]
                columns += [pa.array(a.h[at].view(np.int64)), pa.array((a.s[at + 1] - a.s[at]).astype(np.int32)), pa.array(a.h[at + 1].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "w", "j", "src", "step", "dst"])

    return run


def compacted(edges: DataFrame) -> DataFrame:
    """(e, path, place) of every edge (e, src, dst): the first edge of its unbranched path, and the steps from there."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("e").alias("back")).filter("n = 1").drop("n")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("e").alias("e")).filter("n = 1").drop("n")
    inner = into.join(out, "node").filter("e != back").select("e", "back")
    at = edges.select("e").join(inner, "e", "left").select("e", F.coalesce("back", "e").alias("path"), F.col("back").isNotNull().cast("long").alias("place"))
    at = materialise(at.withColumn("done", F.col("place") == 0), "paths")
    done, open_, left = [at.filter("done")], at.filter("not done"), None
    while (now := open_.count()) and now != left:
        left = now
        ahead = at.select(F.col("e").alias("path"), F.col("path").alias("p"), F.col("place").alias("more"), F.col("done").alias("end"))
        moved = open_.drop("done").join(ahead, "path").select("e", F.col("p").alias("path"), (F.col("place") + F.col("more")).alias("place"), F.col("end").alias("done"))
        moved = materialise(moved, "paths")
        done.append(moved.filter("done"))
        open_ = moved.filter("not done")
        at = at.filter("done").unionByName(moved) if len(done) < 8 else materialise(_all(done).unionByName(open_), "paths")
    rings = open_.select("e", F.col("e").alias("path"), F.lit(0).cast("long").alias("place"))
    return materialise(_all(done).select("e", "path", "place").unionByName(rings), "compacted")


def _all(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def graph(held: DataFrame, units: Units) -> DataFrame:
    """(cid, j, path, place) of the edges of carriers that occur again."""
    rows = materialise(held.mapInArrow(_edges(units), "cid bigint, w bigint, j int, src bigint, step int, dst bigint"), "edges")
    key = ["src", "step", "dst"]
    again = rows.groupBy(key).agg(F.count("*").alias("c"), F.sum("w").alias("weight")).filter("weight > 1").drop("weight")
    again = materialise(again.withColumn("e", F.monotonically_increasing_id()), "graph")
    paths = again.join(compacted(again.select("e", "src", "dst")), "e").select(*key, "c", "path", "place")
    return met(rows, materialise(paths, "placed"), key).select("cid", "j", "path", "place")


def _named(units: Units) -> Callable:
    """Runs of windows, named by the stretch of a path, or the walk, that their edges take; windows with a unique edge are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "content"):
                codes, offsets = units.sequence(Texts(part.column("content")))
                a = anchors(codes, offsets, units.part, units.gram)
                first = np.searchsorted(a.text, np.arange(part.num_rows))
                got, row = lists(part, "edges")
                path, place, known = np.zeros(len(a.text), np.int64), np.zeros(len(a.text), np.int64), np.zeros(len(a.text), bool)
                at = first[row] + got["j"]
                path[at], place[at], known[at] = got["path"], got["place"], True
                held = np.append(0, np.cumsum(known))
                c = cores(a, offsets, units)
                fit = held[c.l] - held[c.f] == c.l - c.f
                text, i, n, f, last = (x[fit] for x in (c.text, c.i, c.n, c.f, c.l))
                many = last - f
                straight = (path[f] == path[last - 1]) & (place[last - 1] - place[f] == many - 1)
                walk = Spans(mix(path.view(np.uint64)) + place.view(np.uint64)).at(f, last)
                g = salted(np.where(straight, mix(path[f].view(np.uint64)) + place[f].view(np.uint64), walk), many, straight)
                r = salted(Spans(codes, SECOND_BASE).at(i, i + n - 1 + units.window), a.s[f] - i, n)
                cid, weight = part.column("cid").to_numpy()[text], part.column("weight").to_numpy()[text]
                yield named(g, r, cid, i - offsets[text], n, a.s[f] - i, weight, np.ones(len(i), bool))

    return run


def repeated(held: DataFrame, units: Units) -> DataFrame:
    """(cid, i, n): the runs of windows of carriers that occur again."""
    edges = graph(held, units).groupBy("cid").agg(F.collect_list(F.struct("j", "path", "place")).alias("edges"))
    put = held.join(edges, "cid")
    return settled(held, materialise(put.mapInArrow(_named(units), NAMES), "cores"), units, (1,))


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WORDS) -> DataFrame:
    """(id, units, removed, spans, kept): spans of removed words, kept words joined by one space as UTF-8."""
    units = Units("words", length, 2 * length // 3 - 1)
    return cut_repeats(docs, units, id_col, text_col, lambda held: repeated(held, units))
