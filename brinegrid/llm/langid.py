"""Language identification by bit-sliced Bloom filters of byte n-grams.

A slot of the filter holds a bit for each language; the AND of an n-gram's slots is the set of languages that contain it.
A text's n-grams are counted for each language, the count expected from false positives is taken off, and the language
with the greatest share decides. N-grams are four bytes of the text with A-Z lowered. Languages are learned from a sample
of at most `sample` documents each, chosen by a hash of the id; an n-gram is a language's if a share of at least `RARE` of
the language's sampled documents hold it.

Defined cases: null text, or text without a letter, is `und` with score 0; so is every text if no language could be
learned; rows with null language teach nothing; equal shares go to the language first in alphabetical order; a text with a
letter but shorter than an n-gram is padded with spaces; rows are told one by one, so repeated rows get equal answers, and a text
of any length is taken whole; an empty table gives none; other columns are carried, but for those named lang_pred and score, which
these replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, Texts, slices

SAMPLE = 3000
SLOT_BITS = 20
TURNS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
RARE = 0.004
LETTER = regex.compile(r"\p{L}")


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of every position, in order."""
    lens = np.diff(texts.offsets)
    data, offsets = texts.bytes, texts.offsets
    if len(lens) and lens.min() < 4:
        pad = np.maximum(0, 4 - lens)
        data = np.insert(data, np.repeat(offsets[1:], pad), 32)
        offsets = offsets + np.append(0, np.cumsum(pad))
    b = LOWER[data].astype(np.uint32)
    doc = np.repeat(np.arange(len(lens)), np.diff(offsets))
    gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    inside = doc[:-3] == doc[3:]
    return doc[:-3][inside], gram[inside]


def slots(gram: np.ndarray) -> Iterator[np.ndarray]:
    for turn in TURNS:
        x = gram * np.uint32(turn)
        yield (x ^ x >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - SLOT_BITS)


class Filters:
    """Filters of several languages in one table of bit sets."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        kind = next((k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= 8 * np.dtype(k).itemsize), None)
        # beyond 64 languages the bit sets take several words each
        self.tables = [np.zeros(1 << SLOT_BITS, kind or np.uint64) for _ in range(-(-len(languages) // 64))]
        self.chance = np.zeros(len(languages))
        for k, gram in enumerate(members):
            table = self.tables[k // 64]
            bit = table.dtype.type(1 << k % 64)
            for slot in slots(gram):
                table[slot] |= bit
            self.chance[k] = ((table & bit) != 0).mean() ** len(TURNS)

    def shares(self, doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """For each text and language the share of n-grams in the language, corrected for false positives."""
        total = np.maximum(np.bincount(doc, minlength=n), 1)
        out = np.empty((n, len(self.languages)))
        at = list(slots(gram))
        for t, table in enumerate(self.tables):
            sets = table[at[0]]
            for slot in at[1:]:
                sets &= table[slot]
            for k in range(64 * t, min(64 * t + 64, len(self.languages))):
                hits = np.bincount(doc[(sets & table.dtype.type(1 << k % 64)) != 0], minlength=n)
                out[:, k] = (hits / total - self.chance[k]) / (1 - self.chance[k])
        return out


def fit(docs: DataFrame, train: Column, text_col: str, lang_col: str, sample: int = SAMPLE) -> Filters:
    """docs: needs the column id, over which `train` is defined."""
    rows = docs.filter(train & F.col(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], [])
    span = 1 << 20
    table = docs.sparkSession.createDataFrame([(x, i, max(1, min(span, sample * span // sizes[x]))) for i, x in enumerate(languages)], "lang string, k int, least int")
    lang = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64("id", F.lit(11)), F.lit(span)).alias("draw"))
    drawn = lang.join(F.broadcast(table), "lang").filter("draw < least").select("k", "text")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                texts = Texts(part.column("text"))
                doc, gram = grams(texts)
                key = np.unique(doc.astype(np.uint64) << np.uint64(32) | gram)
                k = part.column("k").to_numpy()[(key >> np.uint64(32)).astype(np.int64)].astype(np.int64)
                both, n = np.unique(k << 32 | (key & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], ["gram", "n"])

    counts = drawn.mapInArrow(held, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    seen = {r["k"]: r["n"] for r in drawn.groupBy("k").agg(F.count("*").alias("n")).collect()}
    least = F.lit([float(max(2, RARE * seen.get(i, 0))) for i in range(len(languages))])
    kept = counts.filter(F.col("n") >= F.get(least, F.shiftright("gram", 32).cast("int"))).select("gram").toArrow().column("gram").to_numpy()
    return Filters(languages, [(kept[kept >> 32 == i] & 0xFFFFFFFF).astype(np.uint32) for i in range(len(languages))])


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for part in slices(whole, text_col):
                texts = Texts(part.column(text_col))
                lettered = np.array([bool(t and LETTER.search(t)) for t in part.column(text_col).to_pylist()]) & bool(known.languages)
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if known.languages:
                    share = known.shares(*grams(texts), len(texts))
                    best = share.argmax(axis=1)
                    pred[lettered] = np.array(known.languages, object)[best[lettered]]
                    score[lettered] = np.clip(share.max(axis=1), 0, 1)[lettered]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{kinds}, lang_pred string, score double")
