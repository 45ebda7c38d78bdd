"""Language model: hashed maximum entropy with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Classes are found from the corpus: the most frequent words are
grouped by the company they keep, every word of the model's vocabulary joins the group it is seen with, and each group is cut
into bands of equal mass. Inside a class a word's weight is its smoothed count. Words outside the vocabulary form
the last class, shared with all unseen words.

The class of a word is scored by features of the history, in two parts:

* short ones, hashed into a table of fixed size: the word before, the words two and three before (skips), the pair before. Their
  weights start at zero and move by gradient updates over all training tokens: each task sums observed minus expected counts,
  the sums meet in Spark, and a step scales each weight's gradient by its expected count;
* long ones: the pair before, whatever its words, by 44 bits of its hash. Each that training tokens show twice or more has weights of
  its own for the classes seen after it, moved by one such update. Blocks of texts count their own pairs, the counts meet in parts by
  ranges of the hash, whose number grows with the corpus, and each part gives each block the weights of the pairs that it holds.
  On their way probabilities are rounded to 1 part in 256, weights to steps of 1/341.

Counts of words, whatever their number, stay in Spark too: the most frequent, at most TOP, go to the tasks, and the
other words of a text meet their counts in a join.

Defined cases: null text has the end token alone; rows are scored one by one, so equal texts have equal scores; without training
rows every count is 0 and the model is the base model; ties of counts are broken by the word's hash; an empty table gives none; a text of any length is taken whole; other columns
are neither read nor carried, whatever their names.
Gradients travel as 32-bit floats, so scores of another partitioning may differ in the sixth digit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, Words, mix, slices
from .scratch import materialise, met
from .sums import summed

TOP = 1 << 19
VOCABULARY = 1 << 16
SEEDS = 256
GROUPS, BANDS = 8, 8
CLASSES = GROUPS * BANDS + 1
HASHED = 1 << 14
SMOOTH = 0.1
PRIOR = 20.0
UPDATES = 2
RATE = 0.4
#: Tokens whose scores are held at once (they fit the cache), and tokens whose expected counts are summed at once.
CHUNK, LONGEST = 1024, 1 << 16
#: Tokens of the texts that ask for their long histories together, and of those whose long histories meet in one part.
BLOCK, PART = 1 << 22, 1 << 21
#: Bits of a long history's hash, and of the class that follows it in the name of both.
KEY_BITS, CLASS_BITS = 44, np.uint64(7)
#: Steps of a rounded weight, and of the rounded logarithm of a probability sum, from LOG_TOP down.
WEIGHT_STEPS, LOG_STEPS, LOG_TOP = 341, 128, 23.0
#: What a long history's expected count is raised by, and its largest weight.
LONG_PRIOR, LONG_MOST = 0.5, 3.0
NO_KEY = np.uint64(1 << 63)
#: Log mass of a class without words.
EMPTY = -30.0
END = np.uint64(0x5E5E5E5E5E5E5E5F)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the tokens of some texts, the end token included."""
    words = Words(Texts(part.column("text")), lower=True)
    n = np.arange(part.num_rows + 1)
    return np.insert(words.hashes, words.offsets[1:], END), words.offsets + n


def _merge(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, summed over as much of a task as a table of a million words takes."""
    h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + (1 << 16)].view(np.int64)), pa.array(c[lo : lo + (1 << 16)])], ["h", "c"])

    for whole in batches:
        for part in slices(whole, "text"):
            new, n = np.unique(tokens(part)[0], return_counts=True)
            h, c = _merge(np.append(h, new), np.append(c, n))
            if len(h) > 1 << 20:
                yield from out()
                h, c = h[:0], c[:0]
    yield from out()


def long_histories(batch: pa.RecordBatch, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of the pair before) of the tokens that a pair goes before in their text; a rare word is its own hash."""
    ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<i4")
    code = mix(ids.astype(np.uint64))
    code[ids == TOP] = batch.column("rare").flatten().to_numpy().view(np.uint64)
    fit = np.ones(len(ids), bool)
    for d in (0, 1):
        near = heads + d
        fit[near[near < len(fit)]] = False
    at = np.flatnonzero(fit)
    return at, mix(code[at - 1] * np.uint64(3) + mix(code[at - 2])) >> np.uint64(64 - KEY_BITS)


def _encode(top_hash: np.ndarray, top_rank: np.ndarray, top_log: np.ndarray) -> Callable:
    """top_*: sorted by hash: rank by count, and log10 of the smoothed count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before = TaskContext.get().partitionId() << 33, 0
        for whole in batches:
            for part in slices(whole, "text"):
                hashes, offsets = tokens(part)
                kinds, back = np.unique(hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(top_hash, kinds), max(len(top_hash) - 1, 0))
                known = top_hash[at] == kinds if len(top_hash) else np.zeros(len(kinds), bool)
                rank = np.where(known, top_rank[at] if len(top_hash) else 0, TOP)
                logs = np.where(known, top_log[at] if len(top_hash) else 0.0, 0.0)
                ids = rank[back].astype("<i4")
                rare = ~known[back]
                heads = offsets[:-1]
                n_rare = np.append(0, np.cumsum(rare))[offsets].astype(np.int32)
                rest = pa.ListArray.from_arrays(n_rare, pa.array(hashes[rare].view(np.int64)))
                data = ids.tobytes()
                packed = [data[4 * a : 4 * b] for a, b in zip(offsets, offsets[1:], strict=False)]
                blocks = block + (before + heads) // BLOCK
                before += int(offsets[-1])
                columns = [part.column("id"), part.column("num"), part.column("train"), pa.array(np.diff(offsets)), pa.array(packed, pa.binary()), rest, pa.array(np.add.reduceat(logs[back], heads)), pa.array(blocks)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "num", "train", "n", "ids", "rare", "logs", "block"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, starts) of documents' tokens end to end, about `limit` at a time; words outside the vocabulary have one id."""
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for x in batch.column("ids").to_pylist():
            held.append(x)
            size += len(x) // 4
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(np.frombuffer(b"".join(held), "<i4"), VOCABULARY).astype(np.int64), np.cumsum([0, *(len(x) // 4 for x in held)])[:-1]


def _near(ids: np.ndarray, starts: np.ndarray, reach: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(here, there): ids of tokens and of those up to `reach` before in the same text."""
    text = np.zeros(len(ids), np.int64)
    text[starts[1:]] = 1
    text = np.cumsum(text)
    for d in range(1, reach + 1):
        same = text[d:] == text[:-d]
        yield ids[d:][same], ids[:-d][same]


def _company(seeds: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(seeds * seeds)
        for ids, starts in _chunks(batches):
            for x, y in _near(ids, starts):
                both = (x < seeds) & (y < seeds)
                total += np.bincount(x[both] * seeds + y[both], minlength=seeds * seeds)
        return total

    return work


def _membership(group: np.ndarray) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seeds, total = len(group), np.zeros(VOCABULARY * GROUPS)
        for ids, starts in _chunks(batches):
            for x, y in _near(ids, starts):
                for here, there in ((x, y), (y, x)):
                    fit = (here < VOCABULARY) & (there < seeds)
                    total += np.bincount(here[fit] * GROUPS + group[there[fit]], minlength=len(total))
        return total

    return work


def seed_groups(counts: np.ndarray) -> np.ndarray:
    """Groups of the seeds from their table of company, by k-means on its leading directions."""
    both = counts + counts.T
    mass = both.sum(axis=1)
    lift = np.log((both + 0.5) * max(mass.sum(), 1.0) / (np.outer(mass + 0.5, mass + 0.5)))
    values, vectors = np.linalg.eigh(lift)
    lead = np.argsort(-np.abs(values))[:GROUPS]
    x = vectors[:, lead] * np.sqrt(np.abs(values[lead]))
    centres = [x[int(np.argmax(mass))]]
    for _ in range(GROUPS - 1):  # farthest first: the same start whatever the machine
        centres.append(x[int(np.argmax(np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)))])
    centres = np.array(centres)
    for _ in range(25):
        group = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[group == k].mean(axis=0) if (group == k).any() else centres[k] for k in range(GROUPS)])
    return group


def classes_of(company: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class of each word of the vocabulary (ranked by count): its group, cut into bands of equal mass."""
    table = company.reshape(VOCABULARY, GROUPS)[: len(counts)]
    share = table.sum(axis=0) + 1
    group = ((table + 0.5 * share / share.sum()) / share).argmax(axis=1)
    out = np.zeros(VOCABULARY + 1, np.int64)
    for k in range(GROUPS):
        own = np.flatnonzero(group == k)
        mass = np.cumsum(counts[own])
        if len(own):
            out[own] = k * BANDS + np.minimum(BANDS * (mass - counts[own]) // mass[-1], BANDS - 1)
    out[VOCABULARY] = CLASSES - 1
    return out


def features(ids: np.ndarray, starts: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Hashed features of the histories of the tokens at `at` (all by default), one row for each kind of feature."""
    position = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    at = np.arange(len(ids)) if at is None else at
    position = position[at]
    before = [np.where(position >= d, ids[np.maximum(at - d, 0)], VOCABULARY + 1) for d in (1, 2, 3)]
    keys = [before[0], before[1], before[2], before[0] * (VOCABULARY + 2) + before[1]]
    return np.stack([(mix(k.astype(np.uint64) * np.uint64(4) + np.uint64(s)) >> np.uint64(64 - 14)).astype(np.int64) for s, k in enumerate(keys)])


def _observed(classes: np.ndarray) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(HASHED * CLASSES)
        for ids, starts in _chunks(batches):
            y = classes[ids]
            for f in features(ids, starts):
                total += np.bincount(f * CLASSES + y, minlength=len(total))
        return total

    return work


def class_scores(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    """exp of each class's score, not yet divided by their sum, a row for each token; weights: a row for each slot.

    Scores are bounded (clipped steps, PRIOR), so they need no shift before exp.
    """
    z = weights.take(f[0], axis=0, mode="clip")  # slots lie inside the table; this mode spares the test of each
    for row in f[1:]:
        z += weights.take(row, axis=0, mode="clip")
    z += bias
    return np.exp(z, out=z)


def class_logs(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log of P(y | history) for each token; more: (token, class, weight) of long features, each token and class once."""
    out = np.empty(len(y), np.float32)
    for lo in range(0, len(y), CHUNK):
        z = class_scores(weights, bias, f[:, lo : lo + CHUNK])
        if more is not None:
            own = slice(*np.searchsorted(more[0], (lo, lo + CHUNK)))
            z[more[0][own] - lo, more[1][own]] *= np.exp(more[2][own])
        out[lo : lo + CHUNK] = z[np.arange(len(z)), y[lo : lo + CHUNK]] / z.dot(np.ones(CLASSES, np.float32))
    return np.log(out)


def _expected(weights: np.ndarray, bias: np.ndarray) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, p = np.zeros((CLASSES, HASHED)), np.empty((CLASSES, LONGEST))
        for ids, starts in _chunks(batches):
            every = features(ids, starts)
            for a in range(0, len(ids), LONGEST):
                f = every[:, a : a + LONGEST]
                n = f.shape[1]
                for lo in range(0, n, CHUNK):
                    z = class_scores(weights, bias, f[:, lo : lo + CHUNK])
                    z *= (1 / z.dot(np.ones(CLASSES, np.float32)))[:, None]
                    p[:, lo : min(n, lo + CHUNK)] = z.T
                for k in range(CLASSES):
                    for row in f:
                        total[k] += np.bincount(row, p[k, :n], HASHED)
        return total.T.reshape(-1)

    return work


ASKED = "part int, block bigint, size int, data binary"
ANSWERS = "block bigint, part int, named boolean, size int, more int, data binary"


def _heads(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _bounds(keys: np.ndarray, parts: int) -> list[int]:
    """Where the keys of each part begin among sorted ones, and the end."""
    return np.searchsorted((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64)).tolist()


def packed(ordered: np.ndarray, *more: np.ndarray) -> bytes:
    """Arrays, the first one sorted and taken as differences, byte by byte of all values, compressed."""
    arrays = [np.diff(ordered, prepend=np.uint64(0)), *more]
    return pa.compress(b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in arrays), "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: tuple[int, str]) -> list[np.ndarray]:
    """The arrays of `packed`, given the length and type of each."""
    widths = [n * np.dtype(k).itemsize for n, k in kinds]
    raw, ends = np.frombuffer(pa.decompress(data, sum(widths), "zstd"), np.uint8), np.cumsum(widths).tolist()
    out = [np.ascontiguousarray(raw[end - w : end].reshape(-1, n).T).view(k).reshape(-1) if n else np.zeros(0, k) for (n, k), w, end in zip(kinds, widths, ends, strict=True)]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _asked(weights: np.ndarray, bias: np.ndarray, classes: np.ndarray, parts: int) -> Callable:
    """Rows of ASKED: for each block and part, packed, the long histories with the class y after each (kinds), the number n of
    training tokens where they stand, and their summed probability p of y by the short features."""

    def out(block: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        kinds, n, p = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(kinds)
        kinds, n, p = kinds[order], n[order], p[order]
        first = _heads(kinds)
        kinds = kinds[first]
        n, p = np.add.reduceat(n, first).astype("<u4"), np.add.reduceat(p, first)
        p = np.clip(np.rint((LOG_TOP - np.log(np.maximum(p, 1e-30))) * LOG_STEPS), 0, 65535).astype("<u2")
        low = _bounds(kinds >> CLASS_BITS, parts)
        held = [(k, b - a, packed(kinds[a:b], n[a:b], p[a:b])) for k, (a, b) in enumerate(zip(low, low[1:], strict=False)) if b > a]
        part, size, data = zip(*held, strict=True)
        columns = [pa.array(part, pa.int32()), pa.array([block] * len(part), pa.int64()), pa.array(size, pa.int32()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "block", "size", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = -1, []
        for whole in batches:
            ends = np.append(_heads(whole.column("block").to_numpy()), whole.num_rows).tolist()
            for begin, end in zip(ends, ends[1:], strict=False):
                new = whole.column("block")[begin].as_py()
                if held and new != block:
                    yield out(block, held)
                    held = []
                block = new
                for lo in range(begin, end, 256):
                    batch = whole.slice(lo, min(256, end - lo))
                    ids, starts = _joined(batch.column("ids").to_pylist())
                    place, key = long_histories(batch, starts)
                    if not len(place):
                        continue
                    y = classes[ids[place]]
                    train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), np.diff(np.append(starts, len(ids))))[place]
                    p = np.zeros(len(place), np.float32)
                    p[train] = np.exp(class_logs(weights, bias, features(ids, starts, place[train]), y[train]))
                    held.append((key << CLASS_BITS | y.astype(np.uint64), train.astype(np.int32), p))
        if held:
            yield out(block, held)

    return run


def long_weights(kinds: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, weights) of the long histories that training tokens show twice or more, sorted, those of weight 0 left out."""
    order = np.argsort(kinds)
    kinds = kinds[order]
    first = _heads(kinds)
    kinds, n, p = kinds[first], np.add.reduceat(n[order].astype(np.int64), first), np.add.reduceat(p[order].astype(np.float64), first)
    heads = _heads(kinds >> CLASS_BITS)
    c = np.repeat(np.add.reduceat(n, heads), np.diff(np.append(heads, len(n))))
    # p is summed over the places of class y; at all c places of the history it is about the same
    expected = c * p / np.maximum(n, 1)
    weight = np.clip((n - expected) / (expected + LONG_PRIOR), 0.0, LONG_MOST)
    fit = (n > 0) & (c > 1) & (weight > 0)
    return kinds[fit], weight[fit]


def _taken(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, `many` of each."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _answered(table: pa.Table) -> pa.Table:
    """Rows of ANSWERS: to each block that asks in a part, packed, the weights of those of its long histories that have some: their
    numbers among those asked for, or themselves (named) if two tasks have read the block."""
    sizes = table.column("size").to_pylist()
    held = [unpacked(x, (n, "<u8"), (n, "<u4"), (n, "<u2")) for n, x in zip(sizes, table.column("data").to_pylist(), strict=True)]
    kinds, n, p = (np.concatenate(x) for x in zip(*held, strict=True))
    known, weight = long_weights(kinds, n, np.exp(LOG_TOP - p / LOG_STEPS))
    weight = np.rint(weight * WEIGHT_STEPS).astype("<u2")
    known, weight = known[weight > 0], weight[weight > 0]
    first = _heads(known >> CLASS_BITS)
    names, many = known[first] >> CLASS_BITS, np.diff(np.append(first, len(known)))
    blocks, out = table.column("block").to_pylist(), []
    times = Counter(blocks)
    for block, part, (asked, _, _) in zip(blocks, table.column("part").to_pylist(), held, strict=True):
        keys = asked >> CLASS_BITS
        keys = keys[_heads(keys)]
        at = np.searchsorted(names, keys)
        hit = np.append(names, NO_KEY)[at] == keys
        if hit.any():
            at = at[hit]
            take = _taken(first[at], many[at])
            classes = (known[take] & np.uint64((1 << int(CLASS_BITS)) - 1)).astype(np.uint8)
            named = times[block] > 1
            out.append((block, part, named, len(at), len(take), packed(keys[hit] if named else np.flatnonzero(hit).astype(np.uint64), many[at].astype(np.uint8), classes, weight[take])))
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["block", "part", "named", "size", "more", "data"])


class Answers:
    """The long histories of a block that have weights, sorted, and the classes and weights of each."""

    def __init__(self, table: pa.Table, asked: np.ndarray, parts: int):
        """asked: the block's long histories, sorted, each once."""
        self.keys, low = np.zeros(0, np.uint64), _bounds(asked, parts)
        got = []
        for part, named, n, m, x in zip(*(table.column(c).to_pylist() for c in ("part", "named", "size", "more", "data")), strict=True) if table.num_rows else ():
            keys, many, classes, weights = unpacked(x, (n, "<u8"), (n, "u1"), (m, "u1"), (m, "<u2"))
            got.append((keys if named else asked[low[part] + keys.astype(np.int64)], many, classes, weights))
        if got:
            keys, many, self.classes, weights = (np.concatenate(x) for x in zip(*got, strict=True))
            self.weights = (weights / WEIGHT_STEPS).astype(np.float32)
            many = many.astype(np.int64)
            self.keys, one = np.unique(keys, return_index=True)
            self.first, self.many = (np.cumsum(many) - many)[one], many[one]

    def of(self, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(place, class, weight), by place, of the places whose pair before is `key`."""
        if not len(self.keys):
            return None
        at = np.searchsorted(self.keys, key)
        hit = np.append(self.keys, NO_KEY)[at] == key
        at = at[hit]
        take = _taken(self.first[at], self.many[at])
        return np.repeat(place[hit], self.many[at]), self.classes[take].astype(np.int64), self.weights[take]


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, texts): 256 texts of a block or fewer as one value, compressed, which a shuffle moves at half the size."""
    for whole in batches:
        ends = np.append(_heads(whole.column("block").to_numpy()), whole.num_rows).tolist()
        for begin, end in zip(ends, ends[1:], strict=False):
            for lo in range(begin, end, 256):
                part = whole.slice(lo, min(256, end - lo))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([part.column("block")[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "texts"])


def _score(weights: np.ndarray, bias: np.ndarray, classes: np.ndarray, inside: np.ndarray, parts: int) -> Callable:
    """Adds `model`: the sum over tokens of log10 P(class | history), less log10 of the class's total smoothed count."""

    def run(boxes: pa.Table, answers: pa.Table) -> pa.Table:
        held, done = [], []
        for box in boxes.column("texts").to_pylist():
            for batch in pa.ipc.open_stream(box):
                ids, starts = _joined(batch.column("ids").to_pylist())
                held.append((batch, *long_histories(batch, starts)))
        known = Answers(answers, np.unique(np.concatenate([key for _, _, key in held])), parts)
        for batch, place, key in held:
            ids, starts = _joined(batch.column("ids").to_pylist())
            y = classes[ids]
            logs = class_logs(weights, bias, features(ids, starts), y, known.of(place, key)).astype(np.float64)
            rest = batch.select(["id", "num", "n", "rare", "logs"])
            done.append(pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.add.reduceat(logs / np.log(10) - inside[y], starts))], [*rest.schema.names, "model"]))
        return pa.Table.from_batches(done)

    return run


def most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), by falling count, of the words above the least count that no more than TOP words exceed.

    The count is found in a histogram of fixed size, 64 bins to a doubling, so the words need no sort.
    """
    bin_of = F.floor(F.log2("c") * 64)
    sizes = {r["b"]: r["n"] for r in counts.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()}
    held, least = 0, 0
    for b in sorted(sizes, reverse=True):
        if held + sizes[b] > TOP:
            least = b + 1
            break
        held += sizes[b]
    top = counts.filter(bin_of >= least).toArrow()
    h, c = top.column("h").to_numpy(), top.column("c").to_numpy()
    order = np.lexsort((h, -c))
    return h[order].view(np.uint64), c[order]


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score); `train` is defined over the column id."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("train", F.coalesce(train, F.lit(True)))
    counts = rows.filter("train").select("text").mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    counts = materialise(counts, "words")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top_hash, top_count = most_frequent(counts)
    order = np.argsort(top_hash)
    table = spark.sparkContext.broadcast((top_hash[order], order.astype(np.int64), np.log10(top_count[order] + SMOOTH)))
    shape = f"id {kind}, num bigint, train boolean, n bigint, ids binary, rare array<bigint>, logs double, block bigint"
    coded = rows.withColumn("num", F.monotonically_increasing_id()).mapInArrow(lambda batches: _encode(*table.value)(batches), shape)
    coded = materialise(coded, "coded")

    own = top_count[:VOCABULARY].astype(np.float64)
    learn = coded.filter("train").select("ids")
    seeds = min(SEEDS, len(own))
    weights, bias = np.zeros((HASHED, CLASSES), np.float32), np.zeros(CLASSES, np.float32)
    classes = np.full(VOCABULARY + 1, CLASSES - 1, np.int64)
    if seeds >= GROUPS:
        group = seed_groups(summed(learn, _company(seeds), seeds * seeds).reshape(seeds, seeds))
        classes = classes_of(summed(learn, _membership(group), VOCABULARY * GROUPS), own)
    else:
        own = own[:0]
    mass = np.bincount(classes[: len(own)], own, CLASSES).astype(np.float64)
    mass[-1] = total - own.sum() + SMOOTH
    bias = np.where(mass > 0, np.log(np.maximum(mass, SMOOTH) / mass.sum()), EMPTY).astype(np.float32)
    if len(own):
        shared = spark.sparkContext.broadcast(classes)
        observed = summed(learn, lambda batches: _observed(shared.value)(batches), HASHED * CLASSES).reshape(HASHED, CLASSES)
        # with all weights at zero the expected counts follow from the sums alone
        expected = observed.sum(axis=1, keepdims=True) * np.exp(bias)
        for k in range(UPDATES):
            if k:
                state = spark.sparkContext.broadcast((weights, bias))
                expected = summed(learn, lambda batches, s=state: _expected(*s.value)(batches), HASHED * CLASSES).reshape(HASHED, CLASSES)
            step = np.clip((observed - expected) / (expected + PRIOR), -1.5, 1.5)
            weights = (weights + RATE * step).astype(np.float32)
    kept = classes[: len(own)]
    size = np.bincount(kept, own, CLASSES) + SMOOTH * np.bincount(kept, minlength=CLASSES)
    size[-1] = total - own.sum() + SMOOTH * (kinds - len(own) + 1)
    inside = np.log10(np.maximum(size, SMOOTH))
    made = spark.sparkContext.broadcast((weights, bias, classes, inside))
    parts = max(1, -(-int(total) // PART))
    seen = coded.select("block", "train", "ids", "rare").mapInArrow(lambda batches: _asked(*made.value[:3], parts)(batches), ASKED)
    answers = seen.groupBy("part").applyInArrow(_answered, ANSWERS)
    boxes = coded.select("block", "id", "num", "n", "ids", "rare", "logs").mapInArrow(_boxed, "block bigint, texts binary")
    scored = boxes.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda texts, more: _score(*made.value, parts)(texts, more), f"id {kind}, num bigint, n bigint, rare array<bigint>, logs double, model double"
    )
    scored = materialise(scored, "scored")

    asked = materialise(scored.select("num", F.explode("rare").alias("h")), "asked")
    words = materialise(asked.groupBy("h").agg(F.count("*").alias("times")).join(counts, "h", "left"), "met")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    more = met(asked, words, ["h"], "times").groupBy("num").agg(F.sum(log).alias("more"), F.sum(F.col("c").isNull().cast("long")).alias("unseen"))
    full = scored.drop("rare").join(more, "num", "left").fillna({"more": 0.0, "unseen": 0})
    logs = F.col("logs") + F.col("more")
    return full.select(
        "id", F.col("n").alias("n_tokens"), (F.col("n") - F.col("unseen")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n") * float(np.log10(total + SMOOTH * (kinds + 1)))).alias("base_score"), (logs + F.col("model")).alias("score"),
    )
