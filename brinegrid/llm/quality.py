"""Quality classifier: naive Bayes support vectors (indicators scaled by class log-count ratios, then a linear hinge-loss model).

Indicators are the distinct byte four-grams, words and word pairs of a text and tenths of its shares of repeated words,
distinct words, capitals and marks, hashed into 2**18 features. On a sample of
at most `sample` labelled rows (those whose ids hash lowest) the log ratio of each feature's smoothed class counts scales
its indicator, rows are brought to length one, and dual coordinate descent fits the hinge loss. Features that fewer than RARE
sampled rows hold are dropped inside the tasks, and rows are taken, in the order of the ids' hashes, while they hold no more
than FEATURES together, so what one task fits is bounded whatever the texts' lengths; every text is scored.

Defined cases: null text is empty and has only the indicators of its shape; a text of any length is scored whole; a document with several labels counts once,
with label 1 if their mean is at least 0.5; null labels or ids teach nothing; with labels of one class only, or none,
every score is that class's share (0.5 without labels); texts are scored row by row, so ties and repeated rows keep their
own rows and equal texts equal scores; an empty table gives none; other columns are carried, but for one named as the score is, which this replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, Words, slices
from .scratch import materialise
from .sums import summed

BITS = 18
SAMPLE = 8000
COST = 1.0
EPOCHS = 20
SMOOTH = 1.0
#: A feature that fewer sampled rows hold says nothing.
RARE = 5
#: Features of all sampled rows together that the fitting task holds (four bytes each).
FEATURES = 1 << 25


def indicators(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every distinct indicator, sorted by text."""
    b = texts.bytes.astype(np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(texts.offsets))
    found = []
    if len(b) > 3:
        gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        inside = doc[:-3] == doc[3:]
        found.append((doc[:-3] << BITS | (gram * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)))[inside])
    words = Words(texts)
    h = words.hashes
    found.append(words.doc << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
    if len(h) > 1:
        pair = (h[:-1] * np.uint64(3) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)
        found.append((words.doc[1:] << BITS | (pair >> np.uint64(64 - BITS)).astype(np.int64))[words.doc[:-1] == words.doc[1:]])
    found.append(_shape(texts, words))
    keys = np.unique(np.concatenate(found))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _shape(texts: Texts, words: Words) -> np.ndarray:
    """Indicators of a text as a whole: its shares of repeated adjacent words, distinct words, capitals and marks, in tenths."""
    n, h = len(texts), words.hashes
    count = np.maximum(np.bincount(words.doc, minlength=n), 1)
    again = np.bincount(words.doc[1:][(words.doc[1:] == words.doc[:-1]) & (h[1:] == h[:-1])], minlength=n) / count
    order = np.lexsort((h, words.doc))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(words.doc[order]) != 0) | (h[order][1:] != h[order][:-1])
    distinct = np.bincount(words.doc[order][new], minlength=n) / count
    doc, size = np.repeat(np.arange(n), np.diff(texts.offsets)), np.maximum(np.diff(texts.offsets), 1)
    b = texts.bytes
    capitals = np.bincount(doc[(b >= 65) & (b <= 90)], minlength=n) / size
    marks = np.bincount(doc[(b > 32) & (b < 48)], minlength=n) / size
    out = [np.arange(n) << BITS | (64 * k + np.minimum(10 * share, 10).astype(np.int64)) for k, share in enumerate((again, distinct, capitals, marks))]
    out.append(np.arange(n) << BITS | (256 + np.floor(np.log2(count)).astype(np.int64)))
    return np.concatenate(out)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each feature: log of its smoothed share among rows of label 1 over that among rows of label 0; 0 where no row holds it."""
    held = np.full((2, 1 << BITS), SMOOTH)
    for f, y in zip(rows, labels.tolist(), strict=True):
        held[y][f] += 1.0  # a row's features are distinct
    q, p = held
    return np.where(p + q > 2 * SMOOTH, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def descend(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Hinge-loss weights times the ratios, the intercept last, by dual coordinate descent (a dual variable a row, clipped to [0, COST]).

    A row's values are ratio[f] over the row's length. Kept times the ratios, the weights need no values but the squares.
    """
    w, alpha, rng = np.zeros((1 << BITS) + 1, np.float64), np.zeros(len(labels)), np.random.default_rng(7)
    square = ratio**2
    length = np.array([np.sqrt(max(square[f].sum(), 1e-12)) for f in rows])
    y = np.where(labels == 1, 1.0, -1.0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(labels)):
            f = rows[i]
            slope = y[i] * (w[f].sum() / length[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), COST)  # a row and its intercept have length one each
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step / length[i] * square[f]
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> tuple[np.ndarray, float] | float:
    """(weights, intercept), or the one label's share; of labelled rows for which `train`, over the column id, holds."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna().filter(train)
    chosen = chosen.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = chosen.withColumn("draw", F.xxhash64("id")).orderBy("draw", "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("draw", "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                texts = Texts(part.column("text"))
                doc, feature = indicators(texts)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                packed = [feature[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("draw"), part.column("y"), pa.array(packed, pa.binary())], ["draw", "y", "features"])

    def counted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << BITS)
        for batch in batches:
            for x in batch.column("features").to_pylist():
                total[np.frombuffer(x, "<u4")] += 1
        return total

    held = materialise(rows.mapInArrow(extract, "draw bigint, y int, features binary"), "features")
    common = docs.sparkSession.sparkContext.broadcast(summed(held.select("features"), counted, 1 << BITS) >= RARE)

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, "<u4") for x in batch.column("features").to_pylist()]
            packed = [f[common.value[f]].tobytes() for f in rows]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("y"), pa.array(packed, pa.binary())], ["draw", "y", "features"])

    held = materialise(held.mapInArrow(pruned, "draw bigint, y int, features binary"), "pruned")
    sizes = held.groupBy("draw").agg(F.sum(F.octet_length("features") / 4).alias("n")).orderBy("draw").collect()
    fits = np.cumsum([r["n"] for r in sizes]) <= FEATURES
    last = sizes[max(int(fits.sum()) - 1, 0)]["draw"] if sizes else 0
    chosen = held.filter(F.col("draw") <= last).select("y", "features")
    # the sample, of bounded size, is fitted by a task: the driver gets the weights alone
    got = chosen.groupBy().applyInArrow(_fitted, "share double, weights binary, squares binary, intercept double").first()
    if got is None or got["weights"] is None:
        return got["share"] if got else 0.5
    return np.stack([np.frombuffer(got[k], "<f4") for k in ("weights", "squares")]), got["intercept"]


def _fitted(sample: pa.Table) -> pa.Table:
    """The weights, or the one label's share, of rows (y, features)."""
    y, packed = sample.column("y").to_numpy(), sample.column("features").to_pylist()
    weights = squares = intercept = None
    if len(set(y.tolist())) > 1:
        # rows in an order of their own, so that the fit does not depend on how Spark dealt them
        order = sorted(range(len(y)), key=lambda i: (packed[i], y[i]))
        y = y[order]
        held = [np.frombuffer(packed[i], "<u4") for i in order]
        ratio = log_ratios(held, y)
        w = descend(held, ratio, y)
        weights, squares, intercept = w[:-1].astype("<f4").tobytes(), (ratio**2).astype("<f4").tobytes(), float(w[-1])
    kinds = {"share": pa.float64(), "weights": pa.binary(), "squares": pa.binary(), "intercept": pa.float64()}
    return pa.table({k: pa.array([x], kind) for (k, kind), x in zip(kinds.items(), (float(y[0]), weights, squares, intercept), strict=True)})


def score(docs: DataFrame, model: tuple[np.ndarray, float] | float, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the column `out`, from 0 to 1, at least 0.5 where label 1 is likelier."""
    if isinstance(model, float):
        return docs.withColumn(out, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weight, square), bias = shared.value
        for whole in batches:
            for part in slices(whole, text_col):
                texts = Texts(part.column(text_col))
                doc, feature = indicators(texts)
                n = len(texts)
                margin = np.bincount(doc, weight[feature], n) / np.sqrt(np.maximum(np.bincount(doc, square[feature], n), 1e-12)) + bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-2 * margin)))], [*part.schema.names, out])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{kinds}, `{out}` double")


def train_fold() -> Column:
    """Rows to learn from: crc32 of the id as text modulo 3 is not 1."""
    return F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, out: str = "score") -> DataFrame:
    return score(docs, fit(docs, labels, train_fold(), id_col, text_col, label_col, sample), text_col, out)
