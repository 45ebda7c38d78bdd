"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of 16 words; one to several adjacent blocks are a passage, as long as the item that it is held
against and a block more. The benchmark's passages, weighted by TF-IDF with the frequencies of all blocks of the corpus, are
the collection: a distributed randomised decomposition (subspace iteration, POWER passes) gives its RANK leading singular
directions. Every passage of the corpus is folded in and compared with every item by the cosine in that space, both vectors
at their latent lengths; those at COSINE or more are candidates. A candidate is a leak if the longest common subsequence of
words covers VERBATIM of the item, or PARAPHRASE of it together with the item's answer, its last words. Words outside the
benchmark have no place in the space, so the cosine does not fall as the corpus grows.

Words are runs of letters and digits, A-Z and accented Latin letters lowered, so case and marks do not matter. Items are
taken in blocks of at most ITEMS, a model each, so what goes to the tasks is bounded. All documents are searched whole.

Defined cases: null or empty texts leak nothing; null or empty items are skipped; items that share an id are separate
items of that id; each row is searched on its own, so repeated rows and ties give rows of their own; at most one row, the
best match (the first among equals), for a row and item; a text of any length is cut into blocks like others; extra columns are
dropped by `leaks` and carried through by `without_leaks`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import Texts, Words, slices
from .scratch import materialise, numbered, unpacked
from .sums import summed

BLOCK = 16
#: Items that are searched for at once, with one model; more items take one more search for each such block of them.
ITEMS = 1 << 14
VERBATIM, PARAPHRASE = 0.8, 0.6
ANSWER = 5
#: Share of blocks above which a word is a stop word.
COMMON = 0.05
#: Directions of the latent space, those that the randomised decomposition carries beyond them, and its passes.
RANK, EXTRA, POWER = 256, 32, 3
COLUMNS = 1 << 14
#: A passage this near to an item in the latent space is a candidate. test_models measures the recall (at least 0.9).
COSINE = 0.35
#: The ASCII bytes that are neither letters nor digits part words here.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def plain_words(column: pa.Array) -> Words:
    texts = Texts(column)
    accented = np.zeros(len(texts.bytes), bool)
    # the second byte of a capital of U+00C0..U+00DE, but the sign U+00D7
    accented[1:] = (texts.bytes[:-1] == 0xC3) & (texts.bytes[1:] >= 0x80) & (texts.bytes[1:] <= 0x9E) & (texts.bytes[1:] != 0x97)
    texts.bytes = np.where(accented, texts.bytes + np.uint8(32), texts.bytes)
    return Words(texts, lower=True, parts=MARKS)


class Items:
    """A block of the benchmark: the vocabulary of all its items, and each item's words as places in it."""

    def __init__(self, ids: list, texts: list[str], kind: pa.DataType = pa.int64()):
        """kind: the ids' type."""
        self.kind = kind
        words = plain_words(pa.array(texts, pa.string()))
        ends = words.offsets
        rows = [(i, words.hashes[a:b]) for i, a, b in zip(ids, ends, ends[1:], strict=False) if b > a]
        self.ids = [i for i, _ in rows]
        self.vocabulary = np.unique(words.hashes)
        self.places = [np.searchsorted(self.vocabulary, w) for _, w in rows]
        self.blocks = np.array([-(-len(w) // BLOCK) + 1 for w in self.places], np.int64)

    def masks(self, k: int, start: int = 0) -> dict[int, int]:
        """For each word of item k from `start` on, by its place in the vocabulary, the bits of its positions."""
        out: dict[int, int] = {}
        for position, w in enumerate(self.places[k][start:].tolist()):
            out[w] = out.get(w, 0) | 1 << position
        return out


def _coded(vocabulary: np.ndarray) -> Callable:
    """Each text as the places of its words in the vocabulary, -1 for other words: words are cut and looked up once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words = plain_words(part.column("text"))
                at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
                data = np.where(vocabulary[at] == words.hashes, at, -1).astype("<i4").tobytes()
                packed = [data[4 * a : 4 * b] for a, b in zip(words.offsets, words.offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("num"), pa.array(packed, pa.binary())], ["id", "num", "places"])

    return run


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each place of the first sequence."""
    full = (1 << size) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return size - v.bit_count()


class Blocks:
    """The blocks of some coded texts, and the places of the words that are in the vocabulary."""

    def __init__(self, part: pa.RecordBatch, used: np.ndarray | None = None):
        """used: for each place whether its word counts at all."""
        column = part.column("places")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        self.offsets = (ends - ends[0]) // 4
        self.places = np.frombuffer(data, "<i4")[ends[0] // 4 : ends[-1] // 4] if data else np.zeros(0, "<i4")
        sizes = np.diff(self.offsets)
        many = -(-sizes // BLOCK)
        self.first = np.append(0, np.cumsum(many))
        self.text = np.repeat(np.arange(part.num_rows), many)
        # a word's block: its text's first block and its place in the text, in blocks
        shift = np.repeat(self.first[:-1] * BLOCK - self.offsets[:-1], sizes)
        self.of_word = (np.arange(len(self.places)) + shift) // BLOCK
        self.known = self.places >= 0
        if used is not None:
            self.known &= used[self.places]
        self.place, self.block = self.places[self.known], self.of_word[self.known]

    def added(self, latent: "Latent") -> np.ndarray:
        """The sum of the words' latent rows over the known words of each block."""
        out = np.zeros((len(self.text), latent.directions.shape[1]), np.float32)
        n = len(self.block)
        if n:
            first = np.flatnonzero(np.append(True, self.block[1:] != self.block[:-1]))
            nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            for k in range(int(nth.max()) + 1):  # the k-th known word of every block that has as many
                own = nth == k
                out[self.block[own]] += latent.rows(self.place[own])
        return out


def _frequencies(size: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size + 1)
        for whole in batches:
            for part in slices(whole, "places"):
                b = Blocks(part)
                once = np.unique(b.block * size + b.place) % size
                total[:-1] += np.bincount(once, minlength=size)
                total[-1] += len(b.text)
        return total

    return work


def weights_of(items: Items, counts: np.ndarray) -> np.ndarray:
    """Inverse block frequencies; words of more than COMMON of all blocks count 0, unless an item lives on them."""
    idf = np.log((counts[-1] + 2) / (counts[:-1] + 1))
    common = counts[:-1] > COMMON * counts[-1]
    for places in items.places:
        if (idf[places][~common[places]] ** 2).sum() < 0.8 * (idf[places] ** 2).sum():
            common[places] = False
    return np.where(common, 0.0, idf)


def dims_of(items: Items) -> np.ndarray:
    """The column of each word of the vocabulary: its place while there are at most COLUMNS words, else a hash of it."""
    if len(items.vocabulary) <= COLUMNS:
        return np.arange(len(items.vocabulary))
    return (items.vocabulary % np.uint64(COLUMNS)).astype(np.int64)


def _applied(basis: np.ndarray) -> Callable:
    """A'A times `basis`, A being the rows of TF-IDF passages (columns cols, weights vals)."""

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(basis.shape)
        for batch in batches:
            for cols, vals in zip(batch.column("cols").to_pylist(), batch.column("vals").to_pylist(), strict=True):
                at, x = np.frombuffer(cols, "<i4"), np.frombuffer(vals, "<f4")
                # one row's share of A'(A basis); its columns are distinct
                total[at] += np.outer(x, x @ basis[at])
        return total.reshape(-1)

    return work


def passage_vectors(items: Items, idf: np.ndarray, dims: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns and TF-IDF values of each item's passage, of length one."""
    out = []
    for places in items.places:
        cols, back = np.unique(dims[places], return_inverse=True)
        vals = np.bincount(back, idf[places])
        out.append((cols, vals / max(float(np.sqrt((vals**2).sum())), 1e-9)))
    return out


def latent_space(spark: SparkSession, vectors: list[tuple[np.ndarray, np.ndarray]], columns: int) -> np.ndarray:
    """The RANK leading right singular directions of the passages, by randomised subspace iteration.

    The passages are dealt over the tasks; each step multiplies by A'A in one distributed pass and makes the columns
    orthonormal again. The driver holds arrays of COLUMNS by RANK + EXTRA at most.
    """
    width = min(RANK + EXTRA, columns, len(vectors))
    basis = np.linalg.qr(np.random.default_rng(17).standard_normal((columns, width)))[0]
    rows = pd.DataFrame({"cols": [c.astype("<i4").tobytes() for c, _ in vectors], "vals": [v.astype("<f4").tobytes() for _, v in vectors]})
    table = spark.createDataFrame(rows, "cols binary, vals binary").repartition(min(64, -(-len(vectors) // 256)))
    image = basis
    for _ in range(POWER):
        shared = spark.sparkContext.broadcast(basis)
        image = summed(table, lambda batches, b=shared: _applied(b.value)(batches), basis.size).reshape(basis.shape)
        before, basis = basis, np.linalg.qr(image)[0]
    # Rayleigh-Ritz: the directions inside the last subspace by their energy
    energy, turn = np.linalg.eigh((before.T @ image + image.T @ before) / 2)
    lead = np.argsort(-energy)[:RANK]
    lead = lead[energy[lead] > 1e-9 * max(float(energy.max(initial=0.0)), 1e-9)]
    return np.linalg.qr(image @ turn[:, lead])[0].astype(np.float32) if len(lead) else np.zeros((columns, 0), np.float32)


class Latent:
    """The latent row of each word of a vocabulary, as its column's directions and its weight: the rows of all words are never held."""

    def __init__(self, directions: np.ndarray, dims: np.ndarray, idf: np.ndarray):
        self.directions, self.dims, self.idf = directions, dims, idf.astype(np.float32)

    def rows(self, places: np.ndarray) -> np.ndarray:
        out = self.directions.take(self.dims[places], axis=0, mode="clip")  # all places lie inside; this mode spares the test of each
        out *= self.idf[places, None]
        return out


def latent_items(vectors: list[tuple[np.ndarray, np.ndarray]], directions: np.ndarray) -> np.ndarray:
    """The items' passages in the latent space, of length one each."""
    q = np.array([v @ directions[c] for c, v in vectors], np.float32).reshape(len(vectors), directions.shape[1])
    return q / np.maximum(np.sqrt((q**2).sum(axis=1, keepdims=True)), 1e-9)


#: Bits of the address in the table of the items' words.
MEMBERS = 24
#: A place of that table that stands for more than one word, or for a word beyond the first 254 of its item.
SHARED = 255


class Members:
    """The different words of all items in one table: how many of an item's words a window holds, at most.

    A place of the table has the number of a word within its item, so a window's numbers are gathered as bits. Words that share
    a place count as often as they are met, and a stranger at a word's place counts as that word: never too few.
    """

    def __init__(self, words: list[list[int]]):
        """words: the different words of each item, as places in the vocabulary."""
        sizes = np.array([len(w) for w in words])
        nth = np.concatenate([np.arange(1, s + 1) for s in sizes])
        slots = self._slots(np.repeat(np.arange(len(words)), sizes), np.concatenate([np.array(w, np.int64) for w in words]))
        self.table = np.zeros(1 << MEMBERS, np.uint8)
        self.table[slots] = np.minimum(nth, SHARED)
        once, times = np.unique(slots, return_counts=True)
        self.table[once[times > 1]] = SHARED
        number = np.arange(1, SHARED)
        self.bits = np.zeros((-(-min(int(sizes.max()), SHARED - 1) // 64), 256), np.uint64)
        for w, row in enumerate(self.bits):
            here = number[(number - 1) // 64 == w]
            row[here] = np.uint64(1) << ((here - 1) % 64).astype(np.uint64)

    @staticmethod
    def _slots(item: np.ndarray, place: np.ndarray) -> np.ndarray:
        x = item * np.int64(0x9E3779B1) + place * np.int64(0x85EBCA6B)
        return (x ^ x >> 15) & ((1 << MEMBERS) - 1)

    def most(self, places: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For windows places[start:end], none of them empty, the number of different words of their item, or more."""
        size = end - start
        ends = np.cumsum(size)
        first = ends - size
        word = places[np.arange(ends[-1]) - np.repeat(first - start, size)].astype(np.int64)
        number = self.table[self._slots(np.repeat(item, size), word)]
        out = np.add.reduceat(number == SHARED, first, dtype=np.int64)
        for row in self.bits:
            out += np.bitwise_count(np.bitwise_or.reduceat(row[number], first))
        return out


def windows(b: Blocks, i: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place, in words, of the passages of `blocks` blocks from i on, with a block on either side, inside their texts."""
    text = b.text[i]
    lo, hi, first = b.offsets[text], b.offsets[text + 1], b.first[text]
    return np.maximum(lo, lo + (i - first - 1) * BLOCK), np.minimum(hi, lo + (i - first + blocks + 1) * BLOCK)


def candidates(b: Blocks, n_blocks: np.ndarray, latent: Latent, q: np.ndarray, counted: np.ndarray, least: np.ndarray, members: "Members", different: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(block, item, cosine, start, end) of the passages near an item; latent: the words' rows; least: the counted words that an item's leak holds.

    A passage that holds fewer counted words, with a block on either side, than any item needs is no candidate of any.
    """
    n = len(b.text)
    z = b.added(latent)
    known = b.places >= 0
    has = np.bincount(b.of_word[known], counted[b.places[known]], n).astype(np.int32)
    joined = lambda d: b.text[d:] == b.text[:-d]
    # a passage and a block on either side of it; longer ones add their blocks to what shorter ones have
    passage, total, before = z.copy(), has.copy(), 1
    total[1:] += has[:-1] * joined(1)
    total[:-1] += has[1:] * joined(1)
    for m in np.unique(n_blocks):
        own = np.flatnonzero(n_blocks == m)
        for d in range(before, min(m, n)):
            passage[:-d] += z[d:] * joined(d)[:, None]
        for d in range(before + 1, min(m + 1, n)):
            total[:-d] += has[d:] * joined(d)
        before = m
        length = np.sqrt(np.einsum("ij,ij->i", passage, passage))
        rows = np.flatnonzero((total >= least[own].min()) & (length > 1e-9))
        for lo in range(0, len(rows), step := max(1, (1 << 20) // len(own))):
            some = rows[lo : lo + step]
            dots = passage[some] @ q[own].T
            at, which = np.divmod(np.flatnonzero(dots >= COSINE * length[some][:, None]), len(own))
            enough = total[some[at]] >= least[own[which]]
            at, which = at[enough], which[enough]
            i, k, near = some[at], own[which], dots[at, which] / length[some[at]]
            start, end = windows(b, i, n_blocks[k])
            for a in range(0, len(i), 1 << 14):
                part = slice(a, a + (1 << 14))
                fit = a + np.flatnonzero(members.most(b.places, start[part], end[part], k[part]) >= different[k[part]])
                yield from zip(i[fit].tolist(), k[fit].tolist(), near[fit].tolist(), start[fit].tolist(), end[fit].tolist(), strict=True)


def _search(items: Items, latent: Latent, q: np.ndarray, idf: np.ndarray) -> Callable:
    every = [items.masks(k) for k in range(len(items.ids))]
    answers = [items.masks(k, max(0, len(w) - ANSWER)) for k, w in enumerate(items.places)]
    # the words that a subsequence of PARAPHRASE takes; those of them that count; those of them that differ
    least = np.array([next(c for c in range(len(w) + 1) if c / len(w) >= PARAPHRASE) for w in items.places])
    least_counted = least - np.array([(idf[w] == 0).sum() for w in items.places])
    least_different = (least - np.array([len(w) - len(own) for w, own in zip(items.places, every, strict=True)])).tolist()
    counted = (idf > 0).astype(np.float64)

    own_words = [x.keys() for x in every]
    members = Members([list(x) for x in own_words])
    different = np.array(least_different)

    def matched(words: list[int], k: int) -> tuple[float, bool]:
        size = len(items.places[k])
        share = common_subsequence(every[k], size, words) / size
        n = min(ANSWER, size)
        return share, share >= PARAPHRASE and common_subsequence(answers[k], n, words) >= n - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "places"):
                b = Blocks(part, idf > 0)
                text_of, offsets = b.text.tolist(), b.offsets.tolist()
                found: dict[tuple[int, int], tuple] = {}
                for i, k, c, start, end in candidates(b, items.blocks, latent, q, counted, least_counted, members, different):
                    text = text_of[i]
                    lo, words = offsets[text], b.places[start:end].tolist()
                    if len(own_words[k] & set(words)) < least_different[k]:
                        continue  # too few of the item's words for a subsequence of that length
                    share, answer = matched(words, k)
                    if share >= VERBATIM or share >= PARAPHRASE and answer:
                        row = (share, c, lo - start, end - lo, answer)
                        found[text, k] = max(found.get((text, k), row), row)
                keys = sorted(found)
                rows = [found[x] for x in keys]
                own = pa.array([t for t, _ in keys], pa.int64())
                columns = [part.column("id").take(own), part.column("num").take(own), pa.array([items.ids[k] for _, k in keys], items.kind), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[0] for r in rows], pa.float64())]
                columns += [pa.array([r[4] for r in rows], pa.bool_()), pa.array([-r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "num", "item_id", "cosine", "subsequence", "answer", "start", "end"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", num_col: str | None = None) -> DataFrame:
    """(id, num, item_id, cosine, subsequence, answer, start, end): documents that hold an item, words start to end.

    num numbers the rows, or is the column `num_col` of distinct numbers. Ids of documents and items keep their types.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    num = F.col(num_col).cast("bigint") if num_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), num.alias("num"), F.col(text_col).alias("text"))
    shape = f"id {kind}, num bigint, item_id {benchmark.schema[item_col].dataType.simpleString()}, cosine double, subsequence double, answer boolean, start bigint, end bigint"
    kind_of_item = to_arrow_type(benchmark.schema[item_col].dataType)
    parts = [spark.createDataFrame([], shape)]
    block: list = []
    asked = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).dropna().orderBy("i", "t")
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == ITEMS:
            parts.append(_one_block(rows, Items([r["i"] for r in block], [r["t"] for r in block], kind_of_item), shape))
            block = []
    if block:
        parts.append(_one_block(rows, Items([r["i"] for r in block], [r["t"] for r in block], kind_of_item), shape))
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def model(spark: SparkSession, items: Items, idf: np.ndarray) -> tuple[Items, Latent, np.ndarray, np.ndarray]:
    """What the search needs: the items, the latent rows of the words of their vocabulary, the items' places there, the words' weights."""
    dims = dims_of(items)
    vectors = passage_vectors(items, idf, dims)
    directions = latent_space(spark, vectors, int(dims.max()) + 1)
    return items, Latent(directions, dims, idf), latent_items(vectors, directions), idf


def _one_block(rows: DataFrame, items: Items, shape: str) -> DataFrame | None:
    if not items.ids:
        return None
    shared = rows.sparkSession.sparkContext.broadcast
    size = len(items.vocabulary)
    coded = rows.mapInArrow(_coded(items.vocabulary), f"id {rows.schema['id'].dataType.simpleString()}, num bigint, places binary")
    coded = materialise(coded, "places")
    idf = weights_of(items, summed(coded.select("places"), _frequencies(size), size + 1))
    made = shared(model(rows.sparkSession, items, idf))
    return coded.mapInArrow(lambda batches: _search(*made.value)(batches), shape)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    whole = numbered(docs)
    texts = whole.select("num", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"))
    found = leaks(texts, benchmark, "id", "text", num_col="num").select("num").distinct()
    return unpacked(whole.join(found, "num", "left_anti"), docs.columns)
