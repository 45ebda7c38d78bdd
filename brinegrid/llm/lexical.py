"""Ranked lexical search of whole texts: windowed bucket scoring of postings.

Texts become postings of the items' terms: a row for each document with its length and the counts of those terms. A job sums
lengths and document frequencies over all documents. The postings are then ranged by id, and each task traverses its range
in windows of WINDOW documents: the window's postings are laid out by term, every item adds its terms' contributions into an
array with one bucket for each document of the window (32 KB, which stays in the cache) and marks occupied buckets in a
bitset; the occupied buckets are harvested into the item's heap of the k best. Heaps of all tasks meet in two rounds.

Scores are integers, as the contract of op11 states; the terms' weights come from one double logarithm each. Terms are
compared by 64-bit hashes.

Memory: a task holds one window's postings and k entries an item. Items are taken in blocks of about TERMS terms, one pass
over the documents a block, so what is broadcast (the block's terms) has a fixed bound whatever the number of items.

Defined cases: null texts have no terms and are never found, an item without terms finds nothing; a row is a document, so
repeated ids are listed as often as they occur; a row of `items` is an item, repeated ids included; equal scores go by
ascending id, null ids last; ids keep their type; empty tables give an empty result; a text of any length is one row; other
columns of both inputs are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import Texts, Words, slices
from .scratch import materialise

#: Documents of a window; a bucket has 8 bytes.
WINDOW = 4096
#: Terms of a block of items.
TERMS = 1 << 20
#: Groups in which the heaps of tasks meet first.
MEETINGS = 64

#: A term's bytes are digits, letters and all bytes beyond ASCII.
PARTS = np.ones(256, bool)
PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(Texts(batch.column("text")), lower=True, parts=PARTS)
            each = [np.unique(words.hashes[a:b]) for a, b in zip(words.offsets, words.offsets[1:])]
            offsets = np.append(0, np.cumsum([len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([batch.column("item"), _lists(np.concatenate(each).view(np.int64), offsets, pa.int64())], ["item", "terms"])


def _counter(vocabulary):
    """(id, n, terms, counts): a text's number of terms, and those of the sorted `vocabulary` (a broadcast) by place, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(Texts(batch.column("text")), lower=True, parts=PARTS)
                place = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
                hit = known[place] == words.hashes
                pair, count = np.unique(words.doc[hit] * len(known) + place[hit], return_counts=True)
                offsets = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(known))
                n = np.diff(words.offsets).astype(np.int64)
                columns = [batch.column("id"), pa.array(n), _lists(pair % len(known), offsets, pa.int32()), _lists(count, offsets, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "counts"])

    return run


class Postings:
    """The postings of some documents by term, each with its contribution to a score."""

    def __init__(self, size: int, terms: np.ndarray, slots: np.ndarray, gains: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.slots, self.gains, sorted_terms = slots[order], gains[order], terms[order]
        self.terms, first = np.unique(sorted_terms, return_index=True)
        self.bounds = np.append(first, len(order))
        self.buckets, self.occupied = np.zeros(size, np.int64), np.zeros(-(-size // 8), np.uint8)

    def scored(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, scores) of the documents that hold any of the sorted terms `wanted`; leaves the buckets empty."""
        place = np.searchsorted(self.terms, wanted)
        place = place[(place < len(self.terms)) & (self.terms[np.minimum(place, len(self.terms) - 1)] == wanted)]
        for a, b in zip(self.bounds[place].tolist(), self.bounds[place + 1].tolist()):
            slots = self.slots[a:b]
            self.buckets[slots] += self.gains[a:b]  # a document occurs once in a term's postings
            np.bitwise_or.at(self.occupied, slots >> 3, np.uint8(128) >> (slots & 7).astype(np.uint8))
        found = np.flatnonzero(np.unpackbits(self.occupied))
        scores = self.buckets[found]
        self.buckets[found], self.occupied[:] = 0, 0
        return found, scores


def _scorer(items, k: int, saturation: int, flat: int, kind: pa.DataType):
    """(item, id, score) of each item's k best documents of a task; documents come in the order of their ids.

    items: a broadcast of (weights of terms, terms of all items end to end, their bounds, N, L).
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, WINDOW - rows)
                held, rows, batch = [*held, part], rows + part.num_rows, batch.slice(part.num_rows)
                if rows == WINDOW:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, terms, bounds, documents, length = items.value
        heaps: list[list[tuple]] = [[] for _ in bounds[1:]]
        before = 0
        for window in windows(batches):
            window = window.combine_chunks()
            lists, counts = window.column("terms").chunk(0), window.column("counts").chunk(0)
            slots = np.repeat(np.arange(window.num_rows), np.diff(lists.offsets.to_numpy()))
            own, count = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            m = 100 - flat + flat * window.column("n").to_numpy() * documents // length
            postings = Postings(window.num_rows, own, slots, weights[own] * (1_000_000_000 * count // (1000 * count + saturation * m[slots])))
            ids = window.column("id")
            for heap, a, b in zip(heaps, bounds.tolist(), bounds[1:].tolist()):
                found, scores = postings.scored(terms[a:b])
                good = scores > (heap[0][0] if len(heap) == k else 0)  # equal scores go to the smaller id, which came before
                found, scores = found[good], scores[good]
                if len(found) > k:
                    best = np.lexsort((found, -scores))[:k]
                    found, scores = found[best], scores[best]
                for slot, score in zip(found.tolist(), scores.tolist()):
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -before - slot, ids[slot]))
            before += window.num_rows
        part = TaskContext.get().partitionId() % MEETINGS
        for lo in range(0, len(heaps), 1024):
            rows = [(item, row[2].as_py(), row[0]) for item, heap in enumerate(heaps[lo : lo + 1024], lo) for row in heap]
            columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], kind), pa.array([x[2] for x in rows], pa.int64()), pa.array([part] * len(rows), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["no", "doc_id", "score", "part"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", *, saturation: int = 20, flat: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each row of `items`.

    saturation: the count at which a term gains half, in hundredths of 1000 (20: two occurrences in a text of mean length);
    flat: the percentage of a text's relative length that counts.
    """
    spark, id_type, item_type = docs.sparkSession, docs.schema[id_col].dataType, items.schema[item_col].dataType
    asked = items.select(F.col(item_col).alias("item"), F.col(query_col).alias("text")).mapInArrow(_item_terms, f"item {item_type.simpleString()}, terms array<bigint>")
    asked = materialise(asked.filter(F.size("terms") > 0).withColumn("no", F.monotonically_increasing_id()), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for block in range(blocks):
        # rows of a partition are numbered one by one, so blocks hold about equally many
        rows = asked.filter(F.pmod("no", F.lit(blocks)) == block).select("no", "terms").toArrow().combine_chunks()
        flat_terms = rows.column("terms").combine_chunks().flatten().to_numpy().view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
        if not len(flat_terms):
            continue
        vocabulary, places = np.unique(flat_terms, return_inverse=True)
        bounds = np.append(0, np.cumsum(rows.column("terms").combine_chunks().value_lengths().to_numpy()))
        shared = spark.sparkContext.broadcast(vocabulary)
        postings = materialise(texts.mapInArrow(_counter(shared), f"id {id_type.simpleString()}, n bigint, terms array<int>, counts array<int>").filter("n > 0"), "postings")
        documents, length = postings.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        df = postings.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row for each term of the block at most
        often = np.zeros(len(vocabulary), np.int64)
        often[df.column("term").to_numpy()] = df.column("count").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in often.tolist()], np.int64)
        # an item's terms ascend, as its hashes do
        given = spark.sparkContext.broadcast((weights, places.astype(np.int32), bounds, documents, length))
        by = [F.col("id").asc_nulls_last(), F.xxhash64("n", "terms", "counts")]  # the hash parts rows of one id
        ranged = postings.filter(F.size("terms") > 0).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(by[0])
        best = ranged.mapInArrow(_scorer(given, k, saturation, flat, to_arrow_type(id_type)), f"no bigint, doc_id {id_type.simpleString()}, score bigint, part int")
        numbers = spark.createDataFrame(pa.table({"no": pa.array(range(rows.num_rows), pa.int64()), "key": rows.column("no")}))
        best = best.join(F.broadcast(numbers), "no").drop("no")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score bigint")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for keys in (["key", "part"], ["key"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    named = asked.select(F.col("no").alias("key"), F.col("item").alias("item_id"))
    return found.join(named, "key").select("item_id", "rank", "doc_id", "score")
