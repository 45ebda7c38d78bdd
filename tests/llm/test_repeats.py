import re

import numpy as np
import pyarrow as pa
import pytest

from brinegrid.llm import debruijn, sieve, suffix_dedup
from brinegrid.llm.sieve import sliding_min

from .conftest import table


def brute(rows, units, size, join):
    """units: list of units of each text. Per text: units, removed, spans, kept."""
    seen = {}
    for u in units:
        for i in range(len(u) - size + 1):
            w = join(u[i : i + size])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - size + 1):
            if seen[join(u[i : i + size])] > 1:
                gone[i : i + size] = True
        edges = np.diff(np.concatenate([[False], gone, [False]]).astype(int))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        out.append((len(u), int(gone.sum()), spans, join([x for x, g in zip(u, gone, strict=True) if not g])))
    return dict(zip(rows, out, strict=True))


def result(found):
    return {r.id: (r.units, r.removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found.collect()}


@pytest.mark.parametrize("size", [400, 60])
def test_bytes_equal_brute_force(docs, texts, size):
    short = [t[:6000] if t else t for t in texts]
    found = suffix_dedup.dedup_bytes(table(docs.sparkSession, short), length=size)
    units = [list((t or "").encode()) for t in short]
    assert result(found) == brute([3 * k for k in range(len(short))], units, size, bytes)


@pytest.mark.parametrize("size", [35, 9])
def test_words_equal_brute_force(docs, texts, size):
    units = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in texts]
    assert result(debruijn.dedup_words(docs, length=size)) == brute([3 * k for k in range(len(texts))], units, size, b" ".join)


def test_twin_rows_and_empty_tables(spark, docs, none):
    twice = table(spark, ["word " + " ".join(map(str, range(50)))])
    assert [r.removed for r in debruijn.dedup_words(twice.unionAll(twice)).collect()] == [51, 51]
    assert [r.removed for r in debruijn.dedup_words(twice).collect()] == [0]
    assert suffix_dedup.dedup_bytes(none).count() == 0
    assert debruijn.dedup_words(none).count() == 0


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 57).astype(np.uint64)
    for width in (1, 2, 7, 57):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_anchors_do_not_depend_on_slices(texts, monkeypatch):
    """Texts are taken in slices that fit the cache, and come out as from one slice."""
    part = pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts]), pa.array(range(len(texts)))], ["text", "num"])
    found = []
    for size in (sieve.SLICE, 1 << 12, 1 << 20):
        monkeypatch.setattr(sieve, "SLICE", size)
        found.append(pa.Table.from_batches(sieve._anchored(sieve.Units("bytes", 400, 200))([part])))
    assert found[0].num_rows and all(x.equals(found[0]) for x in found)
    monkeypatch.undo()
    assert sieve.SLICE * 8 <= 1 << 20


def test_passages_of_many_words_are_judged_by_bytes(spark):
    """A passage of over 50 words that repeats is removed from 400 bytes on, and stays below, as the contract has it."""
    own = lambda k: " ".join(f"{k}x{i * 7919 + k * 104729:x}" for i in range(40))
    for size, gone in ((400, 400), (399, 0)):
        passage = (" ".join(f"w{i:04}" for i in range(70)))[: size - 2]
        rows = [f"{own(k)}{k}<{passage}>{k + 5}{own(k + 9)}" for k in range(2)]
        assert len(passage.split()) > 50
        assert [r.removed for r in suffix_dedup.dedup_bytes(table(spark, rows)).collect()] == [gone, gone]
