"""Near-duplicates by b-bit MinHash: packed low bits of 256 minima, candidates from bands, links confirmed on full sets.

A document's set holds its distinct runs of three words (A-Z lowered). The words of a run, `words`, and the
threshold `percent` are parameters. Documents of one set form a class, kept by one
representative. Bands of four minima name buckets, as many as leave a pair at the threshold unmet once in 100,000; in each bucket
one member, the pivot, is paired with the others. Pairs whose packed bits, corrected for chance agreement, may reach the threshold
(and whose parity bits do not rule it out) are compared on their full sets, and components are formed.

Where a bucket still holds several components, the members of these buckets are searched for links between components by an exact
prefix filter: two sets at the threshold share one of the rarest (100 - percent) % of their runs, rare by the count among these members.
Frequent runs (licences, menus) are no rare ones, so texts that share only them are never paired; members of one
component are not either. Pairs inside a component need no proof.

The bit estimate is held against the threshold less four of its standard deviations, which a pair at the threshold fails
with probability 3e-5.

Defined cases: null text and text without words have empty sets and are linked with nothing; a text of fewer words than a run has
its whole sequence as one run; repeated rows are copies of each other; a null id names no component, its document's is
that of the others; a text of any length is taken whole; an empty table gives none; extra columns, whatever their names, are neither read nor
carried, but by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import Texts, Words, mix, runs_of, slices
from .scratch import CHUNK, bucketed, materialise, met, numbered, spread, unpacked

WORDS = 3
HASHES = 256
ROWS = 4
MISSED = 1e-5
B = 2
PER_WORD = 64 // B
PERCENT = 85
ODD_BITS = 512

_rng = np.random.default_rng(90125)
_turn = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_shift = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text (its hashes from starts[i] on) the smallest value of each hash function."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), np.uint32)
    for j in range(HASHES):
        y = x * _turn[j] + _shift[j]
        out[:, j] = np.minimum.reduceat(y, starts)
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """The B low bits of each minimum, 64 // B of them to a word."""
    # the lowest bits of a product carry little; those that are kept come from a mixed value
    low = (mix(mins.astype(np.uint64)) & np.uint64((1 << B) - 1)).reshape(len(mins), -1, PER_WORD)
    return np.bitwise_or.reduce(low << (np.arange(PER_WORD, dtype=np.uint64) * np.uint64(B)), axis=2)


def bands_for(percent: int) -> int:
    """The number of bands of ROWS minima that a pair at the threshold misses altogether with probability MISSED."""
    return min(HASHES // ROWS, math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS)))


def least_estimate(percent: int) -> float:
    """The threshold less four standard deviations of the corrected estimate."""
    chance = 2.0**-B
    agree = percent / 100 * (1 - chance) + chance
    return percent / 100 - 4 * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


def band_keys(mins: np.ndarray, bands: int) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(mins), bands)).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, k : bands * ROWS : ROWS])
    return key


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.reshape(-1).view(np.int64)))


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def odd_bits(doc: np.ndarray, h: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text ODD_BITS bits: whether an odd number of its set's hashes fall on a bit."""
    place = doc * ODD_BITS + (h & np.uint64(ODD_BITS - 1)).astype(np.int64)
    bits = (np.bincount(place, minlength=n_texts * ODD_BITS) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(n_texts, ODD_BITS), axis=1).view(np.uint64)


def _sketch(words: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                n_texts = part.num_rows
                doc, h = distinct(*runs_of(Words(Texts(part.column("text")), lower=True), words))
                n = np.bincount(doc, minlength=n_texts)
                starts = np.searchsorted(doc, np.flatnonzero(n))
                sums = np.zeros((2, n_texts), np.uint64)
                bits, bands = np.zeros((n_texts, HASHES // PER_WORD), np.uint64), np.zeros((n_texts, n_bands), np.uint64)
                odd = odd_bits(doc, h, n_texts)
                if len(starts):
                    full = n > 0
                    sums[0][full], sums[1][full] = np.add.reduceat(h, starts), np.add.reduceat(mix(h), starts)
                    mins = minima(h, starts)
                    bits[full], bands[full] = pack(mins), band_keys(mins, n_bands)
                columns = [part.column("id"), part.column("num"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _lists(bits), _lists(odd), _lists(bands)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "num", "n", "s1", "s2", "bits", "odd", "bands"])

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text_a"):
                both = pa.concat_arrays([part.column("text_a"), part.column("text_b")])
                m = part.num_rows
                doc, h = distinct(*runs_of(Words(Texts(both), lower=True), words))
                at = np.searchsorted(doc, np.arange(2 * m + 1))
                keep = np.zeros(m, bool)
                for i in range(m):
                    x, y = h[at[i] : at[i + 1]], h[at[m + i] : at[m + i + 1]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _estimate(a: Column, b: Column) -> Column:
    """Similarity from packed bits: the share of agreeing symbols by bit counts, corrected for chance."""
    odd = F.lit(0x5555555555555555).cast("bigint")
    apart = None
    for w in range(HASHES // PER_WORD):
        x = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        apart = n if apart is None else apart + n
    chance = 2.0**-B
    return (1 - apart / HASHES - chance) / (1 - chance)


def _likely(percent: int) -> Column:
    """Whether a pair (n, bits and odd of a and b) can reach the threshold by size and odd bits, and does by its estimate.

    The bits that differ are at most as many as the members that only one of two sets holds, so no link is lost by them.
    """
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    apart = reduce(Column.__add__, [F.bit_count(F.get("odd_a", F.lit(w)).bitwiseXOR(F.get("odd_b", F.lit(w)))) for w in range(ODD_BITS // 64)])
    fits = fits & ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    return fits & (_estimate(F.col("bits_a"), F.col("bits_b")) >= least_estimate(percent))


def _runs(words: int):
    """(num, h) for every member of a text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                doc, h = distinct(*runs_of(Words(Texts(part.column("text")), lower=True), words))
                yield pa.RecordBatch.from_arrays([part.column("num").take(pa.array(doc)), pa.array(h.view(np.int64))], ["num", "h"])

    return run


def _named(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias({"num": side, "key": "key"}.get(c, f"{c}_{side}")) for c in columns])


LIGHT = ["num", "n", "bits", "odd"]


def _of_pivots(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(buckets, pairs): the shared buckets (num, key, size), and the likely pairs (a, b) of their pivots with the others."""
    entries = classes.select("num", F.explode("bands").alias("key"))
    sizes = materialise(entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    shared = materialise(met(entries, sizes, ["key"], "size"), "buckets")
    # the pivot of a bucket is the member whose buckets are the fullest: of near copies, the one nearest to their origin
    central = shared.groupBy("num").agg(F.sum(F.log2("size")).alias("at"))
    pivots = shared.join(central, "num").groupBy("key").agg(F.max(F.struct("at", "num")).alias("p"), F.first("size").alias("size"))
    light = classes.select(*LIGHT)
    pivots = materialise(pivots.select("key", "size", F.col("p.num").alias("a")).join(_named(light, "a", LIGHT), "a"), "pivots")
    pairs = met(shared.select("num", "key"), pivots, ["key"], "size").filter("a != num").drop("key", "size").dropDuplicates(["a", "num"])
    pairs = pairs.withColumnRenamed("num", "b").join(_named(light, "b", LIGHT), "b").filter(_likely(percent))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return shared, materialise(pairs, "pairs")


def _across(shared: DataFrame, first: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Likely pairs (a, b) of different components among the members of buckets that hold several, by the prefix filter."""
    member = shared.join(first.withColumnRenamed("id", "num"), "num", "left").select("num", "key", "size", F.coalesce("component", "num").alias("c"))
    member = materialise(member, "members")
    mixed = member.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.first("size").alias("size")).filter("low < high")
    mixed = materialise(mixed.select("key", "size"), "mixed")
    if mixed.isEmpty():
        return classes.sparkSession.createDataFrame([], "a bigint, b bigint")
    left = met(member.drop("size"), mixed, ["key"], "size").select("num", "c").distinct()
    left = materialise(left.join(classes.select(*LIGHT), "num"), "left")
    runs = materialise(texts.select("num", "text").join(left.select("num"), "num", "left_semi").mapInArrow(_runs(words), "num bigint, h bigint"), "runs")
    # a run that one member holds joins nothing, but takes its place among the rarest
    often = materialise(runs.groupBy("h").agg(F.count("*").alias("often")), "often")
    ranked = met(runs, often, ["h"], "often").join(left.select("num", "n", "c"), "num")
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("num").orderBy("often", "h")))
    # of two sets at the threshold, the larger shows a common run among its first n - t n + 1, the smaller among n - 2t / (1 + t) n + 1
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    index = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    prefix = ranked.filter((F.col("nth") <= probe) & (F.col("often") > 1)).select("num", "h", "c", "nth", (F.col("nth") <= index).alias("index"))
    prefix = materialise(prefix, "prefixes")
    # of each run, its members outside the component that holds most of them are paired with all
    kinds = prefix.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("size"), F.max(F.struct("k", "c")).alias("most"))
    kinds = materialise(kinds.filter("most.k < size").select("h", "size", F.col("most.c").alias("most")), "mostly")
    every = met(prefix, kinds, ["h"], "size").withColumn("few", F.expr("c != most")).drop("most", "size").join(left.select(*LIGHT), "num")
    every = materialise(every, "postings")
    columns = [c for c in every.columns if c != "h"]
    side = lambda rows, x: rows.select("h", *[F.col(c).alias(x if c == "num" else f"{c}_{x}") for c in columns])
    counts = materialise(every.groupBy("h").agg(F.count("*").alias("__c")), "counts")
    parts = F.ceil(F.col("__c") / CHUNK)
    other = met(side(every, "b"), counts, ["h"], "__c").withColumn("__part", F.pmod(F.xxhash64("b"), parts))
    minor = side(every.filter("few"), "a").join(counts, "h").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    ends = (F.col("c_a") != F.col("c_b")) & (~F.col("few_b") | (F.col("a") < F.col("b"))) & F.expr("index_a and n_a <= n_b or index_b and n_b <= n_a")
    # the runs that two sets share: at most so many up to this one and after it
    most = F.least("nth_a", "nth_b") + F.least(F.col("n_a") - F.col("nth_a"), F.col("n_b") - F.col("nth_b"))
    fits = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = other.drop("__c").join(minor.drop("__c"), ["h", "__part"]).filter(ends & fits & _likely(percent))
    return materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, num_col: str | None = None) -> DataFrame:
    """(id, num, n_shingles, component_id, chosen) for every row of `docs`.

    num numbers the rows, or is the column `num_col` of distinct numbers; chosen: the num of one row of the component, of the smallest id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    num = F.col(num_col).cast("bigint") if num_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), num.alias("num"), F.col(text_col).alias("text"))
    texts = bucketed(rows, "num", "texts_near")
    sketches = materialise(texts.mapInArrow(_sketch(words, bands_for(percent)), f"id {kind}, num bigint, n bigint, s1 bigint, s2 bigint, bits array<bigint>, odd array<bigint>, bands array<bigint>"), "sketches")
    sets = ["n", "s1", "s2"]
    # exact copies are reduced before the shuffle, so a group of copies arrives as a row for each task
    own = F.struct(F.col("id").isNull().alias("none"), "id", "num").alias("own")
    classes = sketches.filter("n > 0").groupBy(sets).agg(F.min(F.struct("num", "bits", "odd", "bands")).alias("r"), F.min(own).alias("own"), F.count("*").alias("copies"))
    classes = materialise(classes.select(*sets, "own", "copies", "r.*"), "classes")

    shared, pairs = _of_pivots(classes, percent)
    first = materialise(components(_links(pairs, texts, words, percent)), "components")
    more = _links(_across(shared, first, classes, texts, words, percent), texts, words, percent)
    joined = components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    of = materialise(classes.join(joined.withColumnRenamed("id", "num"), "num", "left").select(*sets, "copies", "own", F.coalesce("component", "num").alias("component")), "of")
    least = of.groupBy("component").agg(F.min("own").alias("least"), F.count("*").alias("c"))
    of = materialise(met(of.drop("own"), materialise(least, "least"), ["component"]).select(*sets, "copies", F.col("least.id").alias("component_id"), F.col("least.num").alias("chosen")), "named")
    named = met(sketches.filter("n > 0").select("id", "num", *sets), of, sets, "copies").select("id", "num", "n", "component_id", "chosen")
    empty = sketches.filter("n = 0").select("id", "num", "n", F.col("id").alias("component_id"), F.col("num").alias("chosen"))
    return named.unionByName(empty).withColumnRenamed("n", "n_shingles")


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("num")).unionByName(pairs.select(F.col("b").alias("num"))).distinct()
    texts = materialise(texts.join(ends, "num", "left_semi").select("num", "text"), "texts")
    side = lambda x: texts.select(F.col("num").alias(x), F.col("text").alias(f"text_{x}"))
    # a pivot's text goes to as many tasks as its pairs fill
    put = spread(pairs, (side("a"), ["a"], "b"), (side("b"), ["b"], "a"))
    return materialise(put.mapInArrow(_confirm(words, percent), "a bigint, b bigint"), "confirmed")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group, of its smallest id (rows without ids come last); rows without words all stay; ties are one row's."""
    whole = numbered(docs)
    texts = whole.select("num", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"))
    kept = near_duplicates(texts, "id", "text", words, percent, "num").filter("num = chosen").select("num")
    return unpacked(whole.join(kept, "num", "left_semi"), docs.columns)
