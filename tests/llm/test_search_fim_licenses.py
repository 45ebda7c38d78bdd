"""Ranked search, fill-in-middle and license scans against plain loops, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brinegrid.llm import fim, lexical, licenses

from .conftest import table, words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k):
    """docs, items: (id, text); every document against every item by loops."""
    terms = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    terms = [(i, ts) for i, ts in terms if ts]
    count, total = len(terms), sum(ts.total() for _, ts in terms)
    df = Counter(t for _, ts in terms for t in ts)
    out = []
    for item, text in items:
        found = []
        for i, ts in terms:
            m = 50 + 50 * ts.total() * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * ts[t] // (1000 * ts[t] + 20 * m)) for t in set(TERM.findall(low(text))) if t in ts)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [2, 4096])
def test_search_equals_loops(spark, texts, window, monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", window)
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    items = [(n, " ".join((texts[n] or "none").split(" ")[:9])) for n in (3, 5, 6, 10, 13, 19, 24)] + [(7, None), (8, "zzz unknown"), (9, texts[13])]
    got = lexical.search(table(spark, texts), spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash")), k=7)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, items, 7)


def test_search_of_ties_nulls_and_repeats(spark):
    """Equal scores go by id, null ids last; a repeated row is listed as often as it occurs."""
    rows = [(5, "a b"), (3, "a b"), (None, "a b"), (3, "a b"), (9, "A,B"), (1, None), (2, ""), (4, "c " * 50)]
    items = [(0, "a"), (0, "b zz"), (None, "c")]
    got = sorted(map(tuple, lexical.search(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), k=4).collect()), key=repr)
    want = ranked(rows, items, 4)
    assert [(i, r, d) for i, r, d, _ in got] == [(i, r, d) for i, r, d, _ in want] and got == want


def test_search_in_blocks_and_of_nothing(spark, texts, none, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 12)
    items = [(str(n), " ".join(texts[n].split(" ")[:9])) for n in (5, 6, 10, 13)]
    asked = spark.createDataFrame(items, "item_id string, text string").repartition(2)
    assert sorted(map(tuple, lexical.search(table(spark, texts), asked, k=5).collect()), key=repr) == ranked([(3 * k, t) for k, t in enumerate(texts)], items, 5)
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(table(spark, texts), asked.limit(0)).count() == 0
    assert lexical.search(table(spark, [None, " , "]), asked).columns == ["item_id", "rank", "doc_id", "score"]
    named = table(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert lexical.search(named, asked, k=1).schema["doc_id"].dataType.simpleString() == "string"


def cut_plainly(text, doc_id):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(b"42:" + str(doc_id).encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_cuts(spark, texts):
    rng = random.Random(2)
    more = [*texts, "a <P> b", "<S", "ends in <S", "> <M", "\x00 \x1f x", " lead", "trail \n", "\n", "<P" * 9, *("x <P y> <S " * k for k in range(1, 9)), *(words(rng, 9) for _ in range(40))]
    rows = {r.doc_id: r for r in fim.transform(table(spark, more)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    for k, t in enumerate(more):
        r = rows[3 * k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut_plainly(t, 3 * k), k
        assert r.back == (t or "") and "".join(c for c in r.back) == r.text
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_odd_rows(spark, docs, none):
    assert fim.transform(none).count() == 0
    twice = fim.transform(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * docs.count() and len({tuple(r) for r in twice}) == docs.count()
    null = fim.transform(spark.createDataFrame([(None, "a b c")], "doc_id bigint, text string"), percent=100, spm_percent=0).first()
    assert null.form == "psm" and null.n == 3


def test_the_matcher_keeps_no_units():
    """Both passes of a text of many units take no memory that grows with it."""
    import tracemalloc

    text = "ab " * 200_000
    tracemalloc.start()
    assert fim.count_units(text) == 200_001
    assert fim.offsets(text, 100_000, 150_000) == (299_999, 449_999)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def as_original(markup):
    text = markup.replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    return re.sub(r'<<var;.*?original="(.*?)".*?>>', r"\1", text, flags=re.S)


def base(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
    return len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None, sorted({x for _, x in at})


NEAR_MISSES = [
    "Released under the MIT\nLicense.", "licensed under apache", "GENERAL PUBLIC LICENSE general public license", "mit licenses", "the mit-license, the Apache License", "MIT LICENSE MIT LICENSE apache",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 5.0.", "we licensed under water", "MİT License",
]


def test_places_of_phrases_equal_loops(spark, texts):
    more = [*texts, *NEAR_MISSES, *(as_original(m) for _, m in licenses.templates())]
    rows = {r.doc_id: r for r in licenses.scan(table(spark, more)).collect()}
    for k, t in enumerate(more):
        r = rows[3 * k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), k
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
        assert r.score >= 0.5 or not r.labels


def test_every_template_accepts_its_own_wording(spark):
    given = licenses.templates()
    own = [f"some words before {as_original(m)}, and after" for _, m in given]
    rows = {r.doc_id: r for r in licenses.scan(table(spark, own)).collect()}
    for k, (label, _) in enumerate(given):
        assert label in rows[3 * k].labels and rows[3 * k].score == 1.0, label


def plainly(markup):
    """A template as a regular expression over words joined by one space each."""
    out = ""
    for piece in re.split("(<<.*?>>)", markup, flags=re.S):
        if piece == "<<beginOptional>>":
            out += "(?:"
        elif piece == "<<endOptional>>":
            out += ")?"
        elif piece.startswith("<<var"):
            match = re.search('match="(.*?)"', piece, re.S)[1]
            many = re.fullmatch(r"\.(\{\d+,\d+\})", match)
            out += f"(?:[^ ]+ ){many[1]}" if many else "(?:" + "|".join(re.escape(" ".join(licenses.words_of(x)) + " ") for x in match[1:-1].split("|")) + ")"
        else:
            out += "".join(re.escape(w + " ") for w in licenses.words_of(piece))
    return re.compile(rf"(?<![^ ]){out}")


def test_acceptance_equals_regular_expressions(spark):
    """Random texts made of a template's pieces, some left out, replaced or broken."""
    rng = random.Random(8)
    given = [
        ("one", 'a b <<beginOptional>>c <<beginOptional>>d<<endOptional>> e<<endOptional>> f <<var;name="x";original="g";match=".{0,2}">> h'),
        ("two", 'b <<var;name="y";original="c d";match="(c d|c|e e e)">> <<beginOptional>>f<<endOptional>>'),
        ("three", '<<beginOptional>>a<<endOptional>> c f <<var;name="z";original="a";match=".{1,3}">> b'),
    ]
    many = [" ".join(rng.choice("aabbccdeefffgh") for _ in range(rng.randrange(1, 40))) for _ in range(600)] + ["a b c d e f x y h", "a b f h", "a b c e f h", "b e e e f", "b e e f", "c f x y z b"]
    rows = {r.doc_id: r for r in licenses.scan(table(spark, many), given=given).collect()}
    patterns = {label: plainly(m) for label, m in given}
    for k, t in enumerate(many):
        want = sorted(label for label, p in patterns.items() if p.search(t + " "))
        assert rows[3 * k].labels == want, (t, want)
        for m in rows[3 * k].matches:
            assert patterns[m.label].fullmatch(" ".join(t.split(" ")[m.start : m.end]) + " ")
    assert {tuple(r.labels) for r in rows.values()} >= {(), ("one", "two"), ("three",), ("two",)}


def test_one_mandatory_word_changed_is_not_accepted(spark):
    text = as_original(licenses.MIT)
    broken = text.replace("substantial", "considerable")
    r = {r.doc_id: r for r in licenses.scan(table(spark, [text, broken, text.replace("the authors or copyright holders", "ACME Ltd and friends")])).collect()}
    assert "text:mit" in r[0].labels and "text:mit" in r[6].labels
    assert r[3].labels == [] and 0.25 <= r[3].score < 0.5


def test_license_scans_of_odd_rows(spark, docs, none):
    assert licenses.scan(none).count() == 0
    assert licenses.scan(docs.unionAll(docs)).count() == 2 * docs.count()
    row = licenses.scan(spark.createDataFrame([(None, None)], "doc_id string, text string")).first()
    assert (row.n_words, row.n_base, row.first_word, row.labels, row.matches, row.score) == (0, 0, None, [], [], 0.0)
    for wrong in ("<<beginOptional>>a", "<<other>> a", '<<var;name="x";match="a+">> b', '<<var;name="x";match=".{0,2}">> b', "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.scan(docs, given=[("x", wrong)])
