"""Stretches of a corpus that may hold repeated windows, and the removal of the windows that were found repeated.

A sequence is a text's bytes or its words. The smallest hash among the grams inside a window names the window's anchor,
which its content alone decides, so a repeated window has a repeated anchor gram: windows whose anchor gram occurs once
are dropped, and no repeated window is lost. What is left of a text are stretches. Equal stretches are copies, held by one
carrier with their number as its weight, so a group of copies of any size costs a row for each task.

How carriers are searched is the callers' matter (suffix_dedup: ranks by prefix doubling; debruijn: paths of a graph). Both
name a window by its core, the part from its first to its last anchor, and end in `settled`, which compares what a window
holds outside its core, from coarse blocks of windows down to single windows. Names are pairs of 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_CODE, SECOND_BASE, Spans, Texts, Words, mix, slices
from .scratch import bucketed, materialise, met

NONE = np.zeros(0, np.int64)
#: Bytes of text taken at a time: eight bytes of codes for each of them still fit a core's cache.
SLICE = 1 << 17


@dataclass(frozen=True)
class Units:
    """kind: bytes or words; window: units of a window; part: units of the smaller windows that sample a carrier's anchors."""

    kind: str
    window: int
    part: int

    @property
    def gram(self) -> int:
        """Units of a sampled anchor: successive anchors are at most as far apart, so their grams leave no gap."""
        return self.part // 2 + 1

    def sequence(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(codes, offsets) of the units of some texts end to end."""
        if self.kind == "bytes":
            return BYTE_CODE[texts.bytes], texts.offsets
        words = Words(texts)
        return words.hashes, words.offsets


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` successive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def salted(name: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for x in more:
        name = mix(name) + x.astype(np.uint64)
    return mix(name)


@dataclass
class Anchors:
    """Anchors of some texts end to end: text, place s, first window b and number n of the windows of that anchor, gram name h."""

    text: np.ndarray
    s: np.ndarray
    b: np.ndarray
    n: np.ndarray
    h: np.ndarray

    def nth(self) -> np.ndarray:
        """The number of each anchor in its text."""
        at = np.arange(len(self.text))
        return at - np.searchsorted(self.text, self.text)


def anchors(codes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Anchors:
    """Places are counted from the start of `codes`. Among equal hashes the first is the anchor."""
    if len(codes) < window:
        return Anchors(NONE, NONE, NONE, NONE, np.zeros(0, np.uint64))
    at = np.arange(len(codes) - gram + 1)
    names = mix(Spans(codes).at(at, at + gram))
    bits = np.uint64(24 if len(codes) < 1 << 24 else 40)
    key = sliding_min((names >> bits << bits) | at.astype(np.uint64), window - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(key)]
    whole = np.flatnonzero(np.arange(len(key)) + window <= offsets[1:][text])
    place = (key[whole] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.ones(len(whole), bool)
    new[1:] = (np.diff(whole) != 1) | (np.diff(place) != 0) | (np.diff(text[whole]) != 0)
    first = np.flatnonzero(new)
    return Anchors(text[whole[first]], place[first], whole[first], np.diff(np.append(first, len(whole))), names[place[first]])


def lists(part: pa.RecordBatch, column: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of a column of arrays of structs, flat, and the row of each."""
    col = part.column(column)
    ends = col.offsets.to_numpy()
    flat = col.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    return {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}, np.repeat(np.arange(len(col)), np.diff(ends))


def _anchored(units: Units) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                codes, offsets = units.sequence(Texts(part.column("text")))
                a = anchors(codes, offsets, units.window, (units.window + 1) // 2)
                num = part.column("num").to_numpy()[a.text]
                narrow = [pa.array((x).astype(np.int32)) for x in (a.b - offsets[a.text], a.n)]
                yield pa.RecordBatch.from_arrays([pa.array(a.h.view(np.int64)), pa.array(num), *narrow], ["h", "num", "i", "n"])

    return run


def _stretched(units: Units) -> Callable:
    """The stretches that the windows left of each text cover, with two fingerprints and the content of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                texts = Texts(part.column("text"))
                codes, offsets = units.sequence(texts)
                got, text = lists(part, "left")
                begin = got["i"] + offsets[text]
                order = np.argsort(begin, kind="stable")
                begin, text, end = begin[order], text[order], (begin + got["n"] - 1 + units.window)[order]
                reach = np.maximum.accumulate(end)
                new = np.ones(len(begin), bool)
                new[1:] = (begin[1:] > reach[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(begin)) - 1
                start, stop, text = begin[first], reach[last], text[first]
                k1 = salted(Spans(codes).at(start, stop), stop - start)
                k2 = salted(Spans(codes, SECOND_BASE).at(start, stop), stop - start)
                lo, hi = start, stop
                if units.kind == "words":
                    words = Words(texts)
                    lo, hi = words.starts[start], words.ends[stop - 1]
                data = texts.bytes.tobytes()
                content = [data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                columns = [part.column("num").take(pa.array(text)), pa.array((start - offsets[text]).astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["num", "start", "k1", "k2", "content"])

    return run


def carriers(texts: DataFrame, units: Units) -> tuple[DataFrame, DataFrame]:
    """(members, carriers): (num, start, cid) of every stretch, and (cid, weight, content) of every different one."""
    rows = materialise(texts.select("num", "text").mapInArrow(_anchored(units), "h bigint, num bigint, i int, n int"), "anchors")
    again = materialise(rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "repeated")
    left = met(rows, again, ["h"]).groupBy("num").agg(F.collect_list(F.struct("i", "n")).alias("left"))
    shape = "num bigint, start int, k1 bigint, k2 bigint, content binary"
    stretches = materialise(texts.select("num", "text").join(left, "num").mapInArrow(_stretched(units), shape), "stretches")
    kinds = stretches.groupBy("k1", "k2").agg(F.count("*").alias("weight"), F.first("content").alias("content"))
    held = bucketed(kinds.withColumn("cid", F.monotonically_increasing_id()), "cid", f"carriers_{units.kind}")
    members = met(stretches.select("num", "start", "k1", "k2"), held.select("k1", "k2", "cid", F.col("weight").alias("c")), ["k1", "k2"])
    return members.select("num", "start", "cid"), held.select("cid", "weight", "content")


@dataclass
class Cores:
    """The windows of some texts by their first and last sampled anchor: text, first window i, number n, anchors f and l."""

    text: np.ndarray
    i: np.ndarray
    n: np.ndarray
    f: np.ndarray
    l: np.ndarray  # noqa: E741


def cores(a: Anchors, offsets: np.ndarray, units: Units) -> Cores:
    """Runs of windows that share both anchors, which a window's content alone decides."""
    shift = units.window - units.part
    at, text = np.concatenate([a.b, a.b - shift]), np.tile(a.text, 2)
    fit = (at >= offsets[text]) & (at + units.window <= offsets[text + 1])
    at, one = np.unique(at[fit], return_index=True)
    text = text[fit][one]
    end = offsets[text + 1] - units.window + 1
    n = np.minimum(np.append(at[1:], np.iinfo(np.int64).max), end) - at
    return Cores(text, at, n, np.searchsorted(a.b, at, "right") - 1, np.searchsorted(a.b, at + shift, "right") - 1)


NAMES = "g bigint, r bigint, cid bigint, i int, n int, o int, w bigint, need boolean"


def named(g: np.ndarray, r: np.ndarray, cid: np.ndarray, i: np.ndarray, n: np.ndarray, o: np.ndarray, w: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    """Rows of NAMES: runs of n windows from i on; o: how far the first starts before what g names; r: the whole run's name."""
    narrow = [pa.array(x.astype(np.int32)) for x in (i, n, o)]
    return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), pa.array(cid), *narrow, pa.array(w), pa.array(need)], ["g", "r", "cid", "i", "n", "o", "w", "need"])


def _blocks(units: Units, step: int) -> Callable:
    """The runs asked for, cut at offsets that are multiples of `step`; g: the part that all windows of such a block share."""
    size = units.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "content", SLICE):
                codes, offsets = units.sequence(Texts(part.column("content")))
                spans, second = Spans(codes), Spans(codes, SECOND_BASE)
                got, row = lists(part, "asked")
                o, n0, i0 = (got[k].astype(np.int64) for k in ("o", "n", "i"))
                top, low = o // step, (o - n0 + 1) // step
                many = top - low + 1
                of = np.repeat(np.arange(len(many)), many)
                b = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                last, first = np.minimum(o[of], b * step + step - 1), np.maximum((o - n0 + 1)[of], b * step)
                anchor = (i0 + offsets[row] + o)[of]
                i, n = anchor - last, last - first + 1
                begin = anchor - b * step
                g = salted(spans.at(begin, begin - step + 1 + size), b)
                r = salted(second.at(i, i + n - 1 + size), last, n)
                cid, weight = part.column("cid").to_numpy()[row[of]], got["w"][of]
                yield named(g, r, cid, i - offsets[row[of]], n, last, weight, got["need"][of])

    return run


def _decide(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of named rows: those that occur again throughout, and a row for each different one of the groups still open."""
    groups = rows.groupBy("g").agg(F.count("*").alias("c"), F.sum("w").alias("weight"), F.max("need").alias("wanted"), F.min("r").alias("low"), F.max("r").alias("high"))
    groups = materialise(groups.filter("weight > 1 and wanted").select("g", "c", (F.col("low") != F.col("high")).alias("mixed")), "groups")
    hit = materialise(met(rows, groups, ["g"]), "shared")
    plain = hit.filter("need and not mixed").select("cid", "i", "n")
    mixed = hit.filter("mixed").drop("c")
    kinds = mixed.groupBy("g", "r").agg(F.count("*").alias("c"), F.sum("w").alias("weight"), F.max("need").alias("need"), F.min(F.struct("cid", "i", "n", "o")).alias("one"))
    kinds = materialise(kinds, "kinds")
    again = met(mixed.filter("need"), kinds.filter("weight > 1 and need").select("g", "r", "c"), ["g", "r"]).select("cid", "i", "n")
    still = kinds.groupBy("g").agg(F.count("*").alias("all"), F.max(F.expr("weight = 1 and need")).alias("open")).filter("open").select("g", F.col("all").alias("c"))
    rest = met(kinds.drop("c"), materialise(still, "open"), ["g"]).select("one.*", F.col("weight").alias("w"), F.expr("weight = 1 and need").alias("need"))
    return plain.unionByName(again), rest


def settled(held: DataFrame, rows: DataFrame, units: Units, steps: tuple[int, ...]) -> DataFrame:
    """(cid, i, n): the runs of windows of carriers that occur again, from rows named by their cores.

    Runs whose whole stretch occurs again are repeated throughout. The rest are cut into blocks of `steps` windows, the last
    of 1, and decided in the same way, with one of several equal runs as witness for the others.
    """
    found, rest = _decide(rows)
    every = [found]
    for step in steps:
        asked = rest.groupBy("cid").agg(F.collect_list(F.struct("i", "n", "o", "w", "need")).alias("asked"))
        put = held.select("cid", "content").join(asked, "cid")
        found, rest = _decide(materialise(put.mapInArrow(_blocks(units, step), NAMES), f"blocks{step}"))
        every.append(found)
    return reduce(DataFrame.unionByName, every)


def _cut(units: Units) -> Callable:
    """Texts without the units of their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                texts = Texts(part.column("text"))
                words = Words(texts) if units.kind == "words" else None
                offsets = words.offsets if words else texts.offsets
                total, n = int(offsets[-1]), len(texts)
                got, row = lists(part, "windows")
                begin = got["i"].astype(np.int64) + offsets[row]
                steps = np.bincount(begin, minlength=total + 1) - np.bincount(begin + got["n"] - 1 + units.window, minlength=total + 1)
                gone = np.cumsum(steps[:total]) > 0
                text = np.repeat(np.arange(n), np.diff(offsets))
                first, last = gone.copy(), gone.copy()
                first[1:] &= ~(gone[:-1] & (text[1:] == text[:-1]))
                last[:-1] &= ~(gone[1:] & (text[1:] == text[:-1]))
                starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
                of = text[starts] if len(starts) else NONE
                per = np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)
                fields = [pa.array(starts - offsets[of]), pa.array(ends - offsets[of])]
                spans = pa.ListArray.from_arrays(per, pa.StructArray.from_arrays(fields, ["start", "end"]))
                kept = _kept_words(texts, words, ~gone) if words else _kept_bytes(texts, ~gone)
                columns = [part.column("id"), pa.array(np.diff(offsets)), pa.array(np.bincount(text[gone], minlength=n)), spans, pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "units", "removed", "spans", "kept"])

    return run


def _kept_bytes(texts: Texts, keep: np.ndarray) -> list[bytes]:
    at = np.append(0, np.cumsum(keep))[texts.offsets]
    data = texts.bytes[keep].tobytes()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _kept_words(texts: Texts, words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text joined by one space."""
    starts, sizes = words.starts[keep], (words.ends - words.starts)[keep] + 1
    ends = np.cumsum(sizes)
    take = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    data = np.append(texts.bytes, np.uint8(32))[take]
    data[ends - 1] = 32
    at = np.append(0, ends)[np.append(0, np.cumsum(keep))[words.offsets]]
    data = data.tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]


def cut_repeats(docs: DataFrame, units: Units, id_col: str, text_col: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, units, removed, spans, kept) of every document; `search` gives the repeated runs (cid, i, n) of carriers."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = bucketed(rows.withColumn("num", F.monotonically_increasing_id()), "num", f"texts_{units.kind}")
    members, held = carriers(texts, units)
    runs = search(held).groupBy("cid").agg(F.collect_list(F.struct("i", "n")).alias("runs"))
    runs = materialise(runs.join(held.select("cid", F.col("weight").alias("c")), "cid"), "runs")
    moved = F.transform("runs", lambda x: F.struct((x["i"] + F.col("start")).alias("i"), x["n"].alias("n")))
    windows = met(members, runs, ["cid"]).select("num", moved.alias("w")).groupBy("num").agg(F.flatten(F.collect_list("w")).alias("windows"))
    none = F.array().cast("array<struct<i: int, n: int>>")
    put = texts.join(windows, "num", "left").select("id", "text", F.coalesce("windows", none).alias("windows"))
    return put.mapInArrow(_cut(units), f"id {kind}, units bigint, removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
