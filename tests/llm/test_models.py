import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brinegrid.llm import bpe, decontam, langid, maxent, quality
from brinegrid.llm.scratch import fold

from .conftest import table, words


def test_bpe_equals_the_library(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in bpe.encode(docs, open(path).read()).collect()}
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[3 * k].ids, "<u4").tolist() == want
        assert got[3 * k].decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_of_every_character():
    """Each code point between letters, digits and marks, as the library cuts and lowers it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Bpe(open(path).read())
    library.no_truncation()
    library.no_padding()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(every), 4096):
        text = " ".join(f"a{c}b 1{c}2 !{c}" for c in every[lo : lo + 4096])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(lo)
    for text in ("<|endoftext|><|endoftext|>x", "a<|startoftext|", "< |endoftext|>", "ΑΣ ΑΣΑ"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.Bpe(open(path).read().replace('"lstrip": false', '"lstrip": true').replace('"lstrip":false', '"lstrip":true'))


def test_bpe_cuts_words_alike_by_both_modules():
    own = bpe.Bpe(open(public_tokenizers.path("word_bpe_49k.json")).read())
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    for text in (every, "a".join(every), "1".join(every), "don't we'll 12 !!? \x1c\x85\u3000é"):
        assert own.plain.findall(text) == own.word.findall(text)
    beyond = "a\U00010400b \U0001F600\U0001D7CE"
    assert own.words(beyond) == own.word.findall(beyond)


def test_bpe_of_no_rows(none):
    assert bpe.encode(none, open(public_tokenizers.path("word_bpe_49k.json")).read()).count() == 0


def corpus(spark, n=400):
    """Clean texts, and junk of repeated words and marks, labelled but for some."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.3
        text = words(rng, 60) if not bad else rng.choice([f"w{k} " * 50, " ".join(f"{w}***" for w in words(rng, 40).split(" "))])
        rows.append(text)
        labels.append((3 * k, None if k % 11 == 0 else 0 if bad else 1))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_quality_on_held_out_rows(spark, docs):
    rows, labels = corpus(spark)
    scored = quality.classify(rows, labels, out="__s").join(labels, "doc_id").filter("quality is not null")
    held = [r for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([(r["__s"] >= 0.5) == (r.quality == 1) for r in held]) > 0.95
    assert all(0 <= r["__s"] <= 1 for r in scored.collect())


def test_indicators_and_fit_equal_plain_ones(texts):
    """Features of the whole text by sets, and the dual descent's weights by a plain loop over dense rows."""
    short = [t or "" for t in texts if len(t or "") < 3000]
    doc, feature = quality.indicators(quality.Texts(pa.array(short)))
    for k, t in enumerate(short):
        own, b = set(feature[doc == k].tolist()), t.encode()
        grams = {int(np.uint32(int.from_bytes(b[i : i + 4], "little")) * np.uint32(0x9E3779B1) >> np.uint32(32 - quality.BITS)) for i in range(len(b) - 3)}
        assert grams <= own and len(own) <= len(grams) + 2 * len(t.split()) + 5 and len(own) == (doc == k).sum()
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    labels = np.array([int(r.sum() % 3 == 0) for r in rows])
    ratio = quality.log_ratios(rows, labels)
    p, q = (np.array([1 + sum(f in r for r, y in zip(rows, labels, strict=True) if y == c) for f in range(40)]) for c in (1, 0))
    full = lambda x, rows_: x.sum() + (1 << quality.BITS) - 40
    assert np.allclose(ratio[:40], np.log(p / full(p, rows)) - np.log(q / full(q, rows)))
    dense = np.array([np.where(np.isin(np.arange(40), r), ratio[:40], 0) for r in rows])
    dense = np.c_[dense / np.linalg.norm(dense, axis=1, keepdims=True), np.ones(60)]
    w, alpha, y, turn = np.zeros(41), np.zeros(60), 2 * labels - 1, np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for i in turn.permutation(60):
            new = np.clip(alpha[i] - (y[i] * w @ dense[i] - 1) / (dense[i] @ dense[i]), 0, quality.COST)
            w, moved, alpha[i] = w + (new - alpha[i]) * y[i] * dense[i], max(moved, abs(new - alpha[i])), new
        if moved < 1e-3:
            break
    got = quality.descend(rows, ratio, labels)
    for i in range(60):
        assert got[rows[i]].sum() / np.sqrt((ratio[rows[i]] ** 2).sum()) + got[-1] == pytest.approx(w @ dense[i], abs=1e-6)


def test_quality_of_equal_texts_and_small_bounds(spark, monkeypatch):
    rows, labels = corpus(spark, 120)
    twice = rows.unionAll(rows.withColumn("doc_id", F.col("doc_id") + 10000))
    scores = {}
    for r in quality.classify(twice, labels, out="__s").collect():
        scores.setdefault(r.text, set()).add(r["__s"])
    assert all(len(s) == 1 for s in scores.values())
    monkeypatch.setattr(quality, "FEATURES", 2000)
    assert quality.classify(rows, labels).count() == 120


def test_quality_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "doc_id bigint, quality int")
    out = quality.classify(docs, labels, out="__s")
    assert out.columns == [*docs.columns, "__s"] and {r["__s"] for r in out.collect()} == {1.0}
    assert {r["__s"] for r in quality.classify(docs, labels.limit(0), out="__s").collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["sch", "ung", "ein", "keit", "ü"], "es": ["ción", "ñ", "mente", "ado", "ll"]}
    rows = [(k, " ".join("".join(rng.choices(parts[x], k=2)) for _ in range(40)), x) for k in range(300) for x in [rng.choice(sorted(parts))]]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !?", "en"), (902, "", None), (903, "ñ", None)], "id bigint, text string, lang string")
    got = {r.id: r for r in langid.identify(df, langid.fit(df, fold("id", 3) != 1, "text", "lang")).collect()}
    held = [(k, x) for k, _, x in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([got[k].lang_pred == x for k, x in held]) > 0.97
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in parts
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_training(spark, docs, none):
    got = langid.identify(docs, langid.fit(docs.withColumn("id", F.col("doc_id")), F.lit(False), "text", "lang"))
    assert {r.lang_pred for r in got.collect()} == {"und"}
    assert langid.identify(none, langid.fit(none, F.lit(True), "text", "lang")).count() == 0


def test_filters_know_their_members():
    grams = np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint32)
    many = [f"l{k:02}" for k in range(70)]
    f = langid.Filters(many, [grams[k * 70 : k * 70 + 70] for k in range(70)])
    share = f.shares(np.zeros(70, np.int64), grams[66 * 70 : 67 * 70], 1)[0]
    assert share.argmax() == 66 and share[66] == pytest.approx(1.0)


def test_language_model_counts(spark, docs, texts):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    learn = [k for k in range(len(texts)) if zlib.crc32(str(3 * k).encode()) % 10]
    c = Counter(w for k in learn for w in tokens(texts[k]))
    n, v = sum(c.values()), len(c)
    got = {r.id: r for r in maxent.score(docs, fold("id", 10) != 0).collect()}
    for k, t in enumerate(texts):
        w, r = tokens(t), got[3 * k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0


def ids_of(rng, n, kinds=300):
    """A batch of coded texts, and the same as lists."""
    texts = [[rng.randrange(kinds) for _ in range(rng.randrange(1, 40))] for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([np.array(t, "<i4").tobytes() for t in texts], pa.binary())], ["ids"]), texts


def plain_logs(weights, bias, ids, k):
    """log P(class | history) of token k of a text, feature by feature."""
    none = maxent.VOCABULARY + 1
    before = [ids[k - d] if k >= d else none for d in (1, 2, 3)]
    keys = [*before, before[0] * (maxent.VOCABULARY + 2) + before[1]]
    slots = [int(maxent.mix(np.array([4 * key + s], np.uint64))[0] >> np.uint64(50)) for s, key in enumerate(keys)]
    z = bias.astype(float) + sum(weights[s].astype(float) for s in slots)
    return slots, z - math.log(sum(math.exp(x) for x in z))


def test_gradient_sums_equal_plain_ones():
    rng, draw = random.Random(2), np.random.default_rng(2)
    batch, texts = ids_of(rng, 60)
    weights = draw.normal(0, 0.3, (maxent.HASHED, maxent.CLASSES)).astype(np.float32)
    bias = draw.normal(0, 1, maxent.CLASSES).astype(np.float32)
    classes = draw.integers(0, maxent.CLASSES, maxent.VOCABULARY + 1)
    seen, due = np.zeros((2, maxent.HASHED, maxent.CLASSES))
    for t in texts:
        for k in range(len(t)):
            slots, logs = plain_logs(weights, bias, t, k)
            assert math.isclose(sum(math.exp(x) for x in logs), 1.0)
            for s in slots:
                seen[s, classes[t[k]]] += 1
                due[s] += np.exp(logs)
    assert np.array_equal(maxent._observed(classes)([batch]).reshape(seen.shape), seen)
    assert np.allclose(maxent._expected(weights, bias)([batch]).reshape(due.shape), due, rtol=1e-4, atol=1e-4)


def test_probabilities_sum_to_one(spark):
    """Over all words and the end after one history, P(token | history) sums to 1."""
    rng = random.Random(7)
    names = [f"w{k}" for k in range(40)]
    learn = [(k, " ".join(rng.choices(names, weights=range(1, 41), k=50))) for k in range(200)]
    stem = learn[0][1].split(" ")[:20]
    made = {}
    broadcast = spark.sparkContext.broadcast

    # the model as it goes to the tasks
    def keep(value):
        if isinstance(value, tuple) and len(value) == 4:
            made["model"] = value
        return broadcast(value)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: keep(value))
        maxent.score(spark.createDataFrame(learn, "doc_id bigint, text string"), F.lit(True)).count()
    weights, bias, classes, inside = made["model"]
    counts = Counter(w for _, t in learn for w in [*t.split(" "), "\n"])
    ranked = sorted(counts, key=lambda w: -counts[w])
    ids = [ranked.index(w) for w in stem]
    if len(set(counts.values())) < len(counts):
        pytest.skip("ranks of equal counts follow hashes")
    logs = plain_logs(weights, bias, [*ids, 0], len(ids))[1]
    word = lambda k, c: math.exp(logs[classes[k]]) * (c + maxent.SMOOTH) / 10 ** inside[classes[k]]
    assert math.isclose(sum(word(k, counts[w]) for k, w in enumerate(ranked)) + word(maxent.VOCABULARY, 0), 1.0, rel_tol=1e-6)


def test_scores_equal_plain_ones_of_all_pairs(spark, monkeypatch):
    """Every pair before a token that training texts show twice has weights, whatever its hash and the number of parts."""
    rng = random.Random(9)
    names = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choices(names, weights=range(1, 31), k=rng.choice((0, 1, 2, 40))))) for k in range(80)]
    train = {k: k % 10 != 0 for k, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = {}
    broadcast = spark.sparkContext.broadcast

    def keep(value):
        if isinstance(value, tuple) and len(value) == 4:
            made["model"] = value
        return broadcast(value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: keep(value))
    got = {r.id: r.score for r in maxent.score(docs, F.col("id") % 10 != 0).collect()}
    weights, bias, classes, inside = made["model"]
    texts = {k: [*t.split(), "\n"] for k, t in rows}
    counts = Counter(w for k in texts if train[k] for w in texts[k])
    order = lambda w: (-counts[w], int(maxent.tokens(pa.RecordBatch.from_arrays([pa.array([w.strip()])], ["text"]))[0][:1].view(np.int64)[0]))
    rank = {w: k for k, w in enumerate(sorted(counts, key=order))}
    ids = {k: [rank[w] for w in t] for k, t in texts.items()}
    after, logs = defaultdict(lambda: defaultdict(list)), {}
    for k, t in ids.items():
        for i, w in enumerate(t):
            logs[k, i] = plain_logs(weights, bias, t, i)[1]
            if train[k] and i > 1:
                after[t[i - 2], t[i - 1]][classes[w]].append(math.exp(logs[k, i][classes[w]]))
    weighed = 0
    for k, t in ids.items():
        total = 0.0
        for i, w in enumerate(t):
            z, seen = logs[k, i].copy(), after.get((t[i - 2], t[i - 1]), {}) if i > 1 else {}
            c = sum(map(len, seen.values()))
            for y, ps in seen.items() if c > 1 else ():
                expected = c * sum(ps) / len(ps)
                z[y] += min(max((len(ps) - expected) / (expected + maxent.LONG_PRIOR), 0), maxent.LONG_MOST)
                weighed += 1
            y = classes[w]
            total += math.log10(counts[texts[k][i]] + maxent.SMOOTH) + (z[y] - math.log(sum(math.exp(x) for x in z))) / math.log(10) - inside[y]
        assert got[k] == pytest.approx(total, abs=0.03)  # weights are rounded
    assert weighed > 1000
    monkeypatch.setattr(maxent, "PART", 100)
    assert {r.id: r.score for r in maxent.score(docs, F.col("id") % 10 != 0).collect()} == pytest.approx(got, rel=1e-5)


def test_texts_that_occur_twice_score_higher(spark):
    """The long histories know what the corpus holds: copies of trained texts gain on texts of the same words."""
    rng = random.Random(15)
    rows = [(k, words(rng, 150, 150)) for k in range(600)]
    rows += [(1000 + k, rows[k][1]) for k in range(100)]
    got = {r.id: r.score - r.base_score for r in maxent.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(True)).collect()}
    assert np.mean([got[1000 + k] for k in range(100)]) > np.mean([got[k] for k in range(100, 600)]) + 3
    assert all(got[k] == pytest.approx(got[1000 + k]) for k in range(100))


def test_most_frequent_words(spark, monkeypatch):
    counts = spark.createDataFrame([(k, 1 + 1000 // (k + 1)) for k in range(200)], "h bigint, c bigint")
    h, c = maxent.most_frequent(counts)
    assert len(h) == 200 and c.tolist() == sorted(c.tolist(), reverse=True)
    monkeypatch.setattr(maxent, "TOP", 20)
    h, c = maxent.most_frequent(counts)
    assert 15 <= len(h) <= 20 and h.tolist() == list(range(len(h)))


def test_language_model_edge_cases(spark, docs, none):
    assert maxent.score(none, F.lit(True)).count() == 0
    untrained = maxent.score(docs, F.lit(False)).collect()
    assert {r.n_known for r in untrained} == {0} and all(math.isfinite(r.score) for r in untrained)
    twice = maxent.score(docs.unionAll(docs), fold("id", 10) != 0).collect()
    assert len(twice) == 2 * docs.count()


def test_leaks_found_and_clean_left(spark, docs, none):
    rng = random.Random(8)
    items = [" ".join(rng.sample([f"term{k}" for k in range(500)], n)) for n in (15, 25, 40, 55)]
    other = lambda n: " ".join(f"other{rng.randrange(3000)}" for _ in range(n))
    changed = items[2].split(" ")
    for k in (3, 9, 17, 25, 31, 33):
        changed[k] = "else"
    rows = [other(200) + " " + items[0] + " " + other(30), other(5) + ". " + items[1].upper().replace(" ", ", ") + "!", " ".join(changed) + " " + other(80), items[3], other(300), None, "", " ".join(items[3].split(" ")[:12])]
    benchmark = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id bigint, text string")
    got = {(r.id, r.item_id) for r in decontam.leaks(table(spark, rows), benchmark).collect()}
    assert got == {(0, 0), (3, 1), (6, 2), (9, 3)}
    kept = decontam.without_leaks(table(spark, rows), benchmark)
    assert {r.doc_id for r in kept.collect()} == {12, 15, 18, 21} and kept.columns == docs.columns
    assert decontam.leaks(none, benchmark).count() == 0
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0


def coded(items, texts):
    batch = [pa.array(range(len(texts)), pa.int64())] * 2 + [pa.array([np.array(t, "<i4").tobytes() for t in texts], pa.binary())]
    return pa.RecordBatch.from_arrays(batch, ["id", "num", "places"])


def test_paraphrases_found_at_any_corpus_size(spark):
    """Items with 20 and 38 % of their words replaced and the answer kept, amid host text of which half the words are the items'."""
    rng = random.Random(3)
    items = decontam.Items(list(range(400)), [" ".join(f"t{rng.randrange(4000)}" for _ in range(rng.randrange(15, 60))) for _ in range(400)])
    size = len(items.vocabulary)
    other = lambda: rng.randrange(size) if rng.random() < 0.5 else -1
    for blocks in (2.5e5, 3e8):
        made = decontam.model(spark, items, decontam.weights_of(items, np.append(np.full(size, 0.001 * blocks), blocks)))
        assert made[2].shape[1] == decontam.RANK < len(items.ids)
        for share in (0.0, 0.2, 0.38):
            texts = []
            for own in items.places:
                changed = set(rng.sample(range(len(own) - decontam.ANSWER), int(share * len(own))))
                texts.append([other() for _ in range(37)] + [-1 if j in changed else int(w) for j, w in enumerate(own)] + [other() for _ in range(50)])
            out = pa.Table.from_batches(decontam._search(*made)([coded(items, texts)])).to_pydict()
            found = set(zip(out["id"], out["item_id"], strict=True))
            assert len(found & {(k, k) for k in range(400)}) >= (400 if share < 0.3 else 360), (blocks, share)
            assert len(found) <= 404


def test_latent_space_equals_a_plain_decomposition(spark):
    rng = np.random.default_rng(5)
    dense = rng.random((90, 300)) * (rng.random((90, 300)) < 0.1) @ np.diag(0.97 ** np.arange(300))
    vectors = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense]
    got = decontam.latent_space(spark, vectors, 300)
    assert got.shape == (300, 90) and np.allclose(got.T @ got, np.eye(90), atol=1e-4)
    assert np.allclose(dense @ got @ got.T, dense, atol=1e-4)  # rank 90 is held whole


def brute_leaks(texts, items):
    """Every stretch of whole blocks of every text against every item, without a model."""

    def cut(t):
        return decontam.plain_words(pa.array([t or ""])).hashes.tolist()

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    out = set()
    for d, w in enumerate(map(cut, texts)):
        for k, v in enumerate(map(cut, items)):
            m = -(-len(v) // decontam.BLOCK) + 1
            for i in range(-(-len(w) // decontam.BLOCK)):
                part = w[max(0, (i - 1) * decontam.BLOCK) : (i + m + 1) * decontam.BLOCK]
                share, n = lcs(v, part) / len(v), min(decontam.ANSWER, len(v))
                if share >= decontam.VERBATIM or share >= decontam.PARAPHRASE and lcs(v[-n:], part) >= n - 1:
                    out.add((3 * d, k))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    items = [" ".join(rng.choices([f"w{k}" for k in range(90)], k=rng.randrange(12, 40))) for _ in range(6)]
    host = lambda n: rng.choices([f"w{k}" for k in range(90)] + [f"o{k}" for k in range(400)], k=n)
    texts = []
    for k in range(24):
        own = items[k % 6].split(" ")
        for j in rng.sample(range(len(own)), int(len(own) * rng.choice([0, 0.1, 0.25, 0.35, 0.5]))):
            own[j] = "else"
        texts.append(" ".join(host(rng.randrange(40)) + own + host(rng.randrange(40))))
    texts += [" ".join(host(60)) for _ in range(6)] + [texts[0], texts[0], items[0] + " " + " ".join(host(20000)), None]
    table_ = table(spark, texts)
    got = {(r.id, r.item_id) for r in decontam.leaks(table_.unionAll(table_.limit(0)), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    assert got == brute_leaks([t if t is None or len(t) < 9000 else t[:3000] for t in texts], items)


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontam.common_subsequence(masks, len(a), b) == slow(a, b)


def test_quality_is_fitted_by_a_task(spark, monkeypatch):
    """The driver asks for the weights, not for the sample's features, and gets what a plain fit gives."""
    texts = [f"{'good plain words' if i % 2 else '$$$ buy now'} number {i % 7}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    fit = lambda of: quality.fit(docs, of, F.lit(True), "doc_id", "text", "quality")
    monkeypatch.setattr(type(docs), "toArrow", lambda self: pytest.fail("the sample went to the driver"))
    weights, intercept = fit(labels)
    found = [quality.indicators(quality.Texts(pa.array([t])))[1].astype("<u4") for t in texts]
    common = np.bincount(np.concatenate(found), minlength=1 << quality.BITS) >= quality.RARE
    rows = sorted(((f[common[f]].tobytes(), i % 2) for i, f in enumerate(found)))
    held, y = [np.frombuffer(f, "<u4") for f, _ in rows], np.array([y for _, y in rows])
    ratio = quality.log_ratios(held, y)
    w = quality.descend(held, ratio, y)
    assert np.array_equal(weights, np.stack([w[:-1], ratio**2]).astype(np.float32)) and intercept == w[-1]
    assert fit(labels.filter("quality = 1")) == 1.0 and fit(labels.filter("false")) == 0.5
