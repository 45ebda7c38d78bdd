"""Small numpy helpers that run inside Spark tasks over Arrow batches of texts.

A batch is taken in slices of a few MB, so that a task's memory is bounded by the slice, or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240501)
BYTE_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
SECOND_BASE = 0xD1342543DE82EF95

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """The UTF-8 bytes of some texts end to end; text d is bytes[offsets[d]:offsets[d + 1]]."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words:
    """The words of some texts: first byte, end, text and a 64-bit hash of each; `offsets` as in Texts, in words."""

    def __init__(self, texts: Texts, lower: bool = False, parts: np.ndarray = IS_SPACE):
        """parts: for each byte, whether it parts words."""
        data = LOWER[texts.bytes] if lower else texts.bytes
        solid = ~parts[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        heads = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        first[heads] = solid[heads]
        self.starts = np.flatnonzero(first)
        n = len(self.starts)
        if n:
            gaps = np.diff(np.append(self.starts, len(data)))
            place = np.arange(self.starts[0], len(data)) - np.repeat(self.starts, gaps)
            code = np.where(parts, np.uint64(0), BYTE_CODE)[data[self.starts[0] :]] * powers(BASE, int(gaps.max()))[place]
            self.hashes = mix(np.add.reduceat(code, self.starts - self.starts[0]))
        else:
            self.hashes = np.zeros(0, np.uint64)
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        tails = texts.offsets[1:][np.diff(texts.offsets) > 0] - 1
        last[tails] = solid[tails]
        self.ends = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, texts.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))


class Spans:
    """Fingerprints of any stretch of a sequence of 64-bit codes, from one running sum modulo 2**64."""

    def __init__(self, codes: np.ndarray, base: int = BASE):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def runs_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of `width` words; a text of fewer words, but some, is one run."""
    counts = np.diff(words.offsets)
    short = np.flatnonzero((counts > 0) & (counts < width))
    spans = Spans(words.hashes)
    starts = np.flatnonzero(np.arange(len(words.hashes)) + width <= words.offsets[1:][words.doc]) if len(words.doc) else np.zeros(0, np.int64)
    doc = np.append(words.doc[starts], short)
    begin, end = np.append(starts, words.offsets[short]), np.append(starts + width, words.offsets[short + 1])
    hashes = mix(spans.at(begin, end) + (end - begin).astype(np.uint64))
    order = np.argsort(doc, kind="stable") if len(short) else slice(None)
    return doc[order], hashes[order]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each, at least one row."""
    texts = batch.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + 1 : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else []
    start = 0
    base = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]) if len(texts) else 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop
