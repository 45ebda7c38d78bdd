import random
import re

import pytest

from brinegrid.llm import components, minhash

from .conftest import table, words


def brute(texts, run=3, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + run]) for i in range(max(1, len(w) - run + 1))} if w else set())
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {3 * k: (len(sets[k]), 3 * find(k)) for k in range(len(texts))}


def group(rng, n):
    """Near copies of one text with edits of many sizes, so that some link and some do not."""
    base = words(rng, 150).split(" ")
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("run", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, texts, run, percent):
    every = texts + group(random.Random(2), 120)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, every).repartition(5), words=run, percent=percent).collect()}
    assert got == brute(every, run, percent)


def test_keep_one_keeps_columns_and_clean_rows(spark, docs, texts):
    kept = minhash.keep_one(docs)
    want = {i for i, (n, c) in brute(texts).items() if n == 0 or i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_empty_and_twins(spark, none):
    assert minhash.near_duplicates(none).count() == 0
    twins = table(spark, ["a b c d"])
    assert [r.component_id for r in minhash.near_duplicates(twins.unionAll(twins)).collect()] == [0, 0]


def test_boilerplate_makes_no_pairs(spark, monkeypatch):
    """Texts that share half of their runs, and so many buckets, but are no near copies: few pairs come to be compared."""
    rng = random.Random(6)
    common = words(rng, 60)
    texts = [common + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) for _ in range(3000)]
    texts += [texts[5] + " end", texts[77].replace("u", "v", 1)]
    seen, links = [], minhash._links
    monkeypatch.setattr(minhash, "_links", lambda pairs, *rest: (seen.append(pairs.count()), links(pairs, *rest))[1])
    got = {r.id: r.component_id for r in minhash.near_duplicates(table(spark, texts).repartition(4)).collect()}
    assert {i for i, c in got.items() if i != c} == {9000, 9003} and got[9000] == 15 and got[9003] == 231
    assert sum(seen) < 3000


def test_recall_at_the_threshold(spark):
    """800 pairs of sets that share 86 to 90 % of their runs: all are linked."""
    rng = random.Random(11)
    texts = []
    for _ in range(800):
        w = [f"w{rng.randrange(10**9)}" for _ in range(162)]
        texts += [" ".join(w), " ".join(w[: rng.randrange(140, 146)] + [f"x{rng.randrange(10**9)}" for _ in range(2)])]
    got = {r.id: r.component_id for r in minhash.near_duplicates(table(spark, texts).repartition(4)).collect()}
    want = brute_pairs = 0
    for k in range(0, len(texts), 2):
        a, b = (set(zip(w, w[1:], w[2:], strict=False)) for w in (texts[k].split(" "), texts[k + 1].split(" ")))
        if 100 * len(a & b) >= 85 * len(a | b):
            want, brute_pairs = want + 1, brute_pairs + (got[3 * k + 3] == 3 * k)
    assert want > 300 and brute_pairs >= 0.999 * want


def test_rows_without_ids_keep_one(spark):
    rows = spark.createDataFrame([(None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "q r s t"), (7, "x y z"), (7, "x y z"), (None, None), (None, "")], "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep_one(rows).collect()), key=str)
    assert kept == sorted([(None, "a b c d e f g h"), (None, "q r s t"), (7, "x y z"), (None, None), (None, "")], key=str)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40) if k % 10] + [(100, 3), (100, 35)], "a bigint, b bigint")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got[10] == 1 and got[35] == 1 and got[100] == 1 and got[12] == 11 and got[30] == 21


def test_estimate_is_unbiased(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    h = np.concatenate([shared, own[:200], shared, own[200:]])
    bits = minhash.pack(minhash.minima(h, np.array([0, 1000])))
    row = spark.createDataFrame([([int(x) for x in bits[0].view(np.int64)], [int(x) for x in bits[1].view(np.int64)])], "a array<bigint>, b array<bigint>")
    assert abs(row.select(minhash._estimate(row.a, row.b).alias("e")).first().e - 800 / 1200) < 0.12
