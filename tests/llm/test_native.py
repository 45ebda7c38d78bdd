import hashlib
import re

from pyspark.sql import functions as F

from brinegrid.llm import fingerprints, line_dedup

from .conftest import table


def brute_lines(rows, width=3):
    seen, gone = set(), {i: set() for i, _ in rows}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n") if text else []
        for k in range(len(lines) - width + 1):
            window = tuple(lines[k : k + width])
            if any(window):
                gone[i] |= set(range(k, k + width)) if window in seen else set()
                seen.add(window)
    return {i: (len(t.split("\n")) if t else 0, len(gone[i]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t else t) for i, t in rows}


def test_line_dedup_equals_brute_force(docs, texts):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines([(3 * k, t) for k, t in enumerate(texts)])


def test_line_dedup_carries_columns_and_twin_rows(spark, docs, none):
    out = line_dedup.dedup_lines(docs.unionAll(docs), out="text", counts=False)
    assert out.columns == docs.columns and out.count() == 2 * docs.count()
    once, twice = (sorted((r.doc_id, r.text or "") for r in d.collect()) for d in (line_dedup.dedup_lines(docs, out="text", counts=False), out))
    assert sorted(once * 2) == twice
    assert line_dedup.dedup_lines(none).count() == 0


def edited(texts):
    n = len(texts)
    out = {}
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k - 1) % n] or ""
        out[3 * k] = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
    return out


def test_fingerprints_edit_by_the_next_document(docs, texts):
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert {i: r.edited for i, r in rows.items()} == edited(texts)
    assert all(rows[3 * k].n_chars == len(t or "") for k, t in enumerate(texts))
    assert rows[18].fingerprint == rows[21].fingerprint and len(rows[18].fingerprint) == 256
    assert rows[0].fingerprint == rows[3].fingerprint == ""


def shingles(text):
    w = text.replace("\t", " ").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_likeness_is_near_the_true_similarity(docs, texts):
    rows, after = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}, edited(texts)
    for k, t in enumerate(texts):
        if k == 19:
            continue  # its spaces differ between Python and the contract
        a, b = shingles(t or ""), shingles(after[3 * k])
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(rows[3 * k].near_edited - want) < 0.2, (k, want, rows[3 * k].near_edited)


def test_fingerprints_equal_plain_ones(spark, docs, texts):
    """Bins, probes and low bits by loops, from the same hashes of words and of runs."""
    split = {3 * k: [w for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", t or "") if w] for k, t in enumerate(texts)}
    names = sorted({w for ws in split.values() for w in ws})
    of = {r.w: r.h for r in spark.createDataFrame([(w,) for w in names], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    runs = {tuple(ws[i : i + 5]) for ws in split.values() if ws for i in range(max(1, len(ws) - 4))}
    hashed = spark.createDataFrame([(list(r), [of[w] for w in r]) for r in runs], "r array<string>, hs array<bigint>")
    five = F.xxhash64(*[F.get("hs", F.lit(k)) for k in range(5)])
    run_of = {tuple(r.r): r.h for r in hashed.select("r", F.when(F.size("hs") == 5, five).otherwise(F.xxhash64("hs")).alias("h")).collect()}
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    bins = fingerprints.BINS
    for i, ws in split.items():
        least = {}
        for j in range(max(1, len(ws) - 4) if ws else 0):
            h = run_of[tuple(ws[j : j + 5])]
            b = (h % 2**64) >> 57
            least[b] = min(least.get(b, h), h)
        want = ""
        for b in range(bins) if least else ():
            t, at = 0, b
            while at not in least:  # the probe order of bin b
                at, t = (fingerprints._steps[b] * t - (b * 73 + 29) % bins) % bins, t + 1
            want += f"{least[at] % 256:02x}"
        assert rows[i].fingerprint == want, i


def test_next_document_of_a_heavy_id(spark):
    """Two thirds of the rows without an id: all rows still form one ring in order."""
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = fingerprints.with_next(many, "doc_id", ["doc_id", "text"]).collect()
    after = {r.text: r.next.text for r in rows}
    assert len(rows) == len(after) == len(set(after.values())) == 3000
    text, seen = "text 2997", []
    for _ in range(3000):
        seen.append(text)
        text = after[text]
    assert text == "text 2997" and seen[:1000] == [f"text {k}" for k in range(2997, -1, -3)]


def test_next_document_over_many_ranges(spark):
    many = spark.range(3000).select((F.col("id") * 7 % 3001).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    ids = sorted((r.doc_id for r in many.collect()), reverse=True)
    got = {r.doc_id: r.next.doc_id for r in fingerprints.with_next(many, "doc_id", ["doc_id"]).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_fingerprints_of_few_rows(spark, none):
    assert fingerprints.fingerprints(none).count() == 0
    one = fingerprints.fingerprints(table(spark, ["abcdef"])).first()
    assert one.edited == "abcabc" and one.near_next == 1.0
    assert hashlib.sha256(one.edited.encode()).hexdigest() == hashlib.sha256(b"abcabc").hexdigest()
    null = table(spark, ["x y", "z"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert fingerprints.fingerprints(null).count() == 2
