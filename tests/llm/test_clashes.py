"""Every operator and stage on tables whose extra columns are named as the operators' own, and on ids of other types."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from brinegrid.llm import bpe, debruijn, decontam, fim, langid, lexical, licenses, line_dedup, maxent, minhash, quality, queries, suffix_dedup
from brinegrid.llm import fingerprints as fp
from brinegrid.llm.scratch import fold

from .conftest import words

INTERNAL = """num row rid id late late_id starts done n h g line w first last key size c component component_id chosen bits odd bands s1 s2 own copies a b few nth often
__id __late __starts __rid __done __num __score __c __part __key __tie __under __to __way __p __extra score score_ text_a text_b places item_id answer cosine terms counts no part rank
digest form at one two output start stop ids decoded fp edited next spans kept units removed train long logs rare draw y label features n_chars_ n_words labels matches x r t seen""".split()


@pytest.fixture(scope="module")
def tables(spark):
    import random

    rng = random.Random(11)
    lines, passage = "\n".join(words(rng, 6) for _ in range(4)), words(rng, 90)
    texts = [None, "", "one", lines, words(rng, 5) + "\n" + lines, passage, passage, words(rng, 20) + " " + passage, "Released under the MIT License. <P>"]
    texts += [words(rng, 60) for _ in range(25)]
    plain = spark.createDataFrame([(5 * k % 37, t, ("en", "de")[k % 2], "s", len(t or "")) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    full = plain.withColumns({c: F.lit(5) for c in INTERNAL if c not in plain.columns})
    labels = spark.createDataFrame([(k, k % 2) for k in range(37)], "doc_id bigint, quality int")
    items = spark.createDataFrame([(0, texts[20]), (1, texts[21])], "item_id bigint, text string")
    return plain.cache(), full.cache(), labels, items


def identified(docs):
    d = docs.withColumn("id", F.col("doc_id"))
    return langid.identify(d.select("id", "text"), langid.fit(d, fold("id", 3) != 1, "text", "lang"))


OPERATORS = {
    "1": lambda d, labels, items: fp.fingerprints(d),
    "2": lambda d, labels, items: suffix_dedup.dedup_bytes(d),
    "3": lambda d, labels, items: decontam.leaks(d, items).drop("num"),
    "3 all": lambda d, labels, items: decontam.without_leaks(d, items).select("doc_id", "text"),
    "4": lambda d, labels, items: bpe.encode(d, queries.vocabulary_text()),
    "5": lambda d, labels, items: debruijn.dedup_words(d),
    "6": lambda d, labels, items: quality.classify(d, labels, out="made").select("doc_id", F.round("made", 5)),
    "7": lambda d, labels, items: identified(d),
    "8": lambda d, labels, items: minhash.near_duplicates(d).select("id", "n_shingles", "component_id"),
    "8 one": lambda d, labels, items: minhash.keep_one(d).select("doc_id", "text"),
    "9": lambda d, labels, items: line_dedup.dedup_lines(d).select("doc_id", "n_lines", "n_removed", "kept_text"),
    "10": lambda d, labels, items: maxent.score(d, fold("id", 10) != 0).select("id", "n_tokens", "n_known", F.round("score", 2)),
    "11": lambda d, labels, items: lexical.search(d, items, k=5),
    "12": lambda d, labels, items: fim.transform(d),
    "13": lambda d, labels, items: licenses.scan(d),
}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_do_not_read_columns_of_their_own_names(tables, name):
    plain, full, labels, items = tables
    assert rows(OPERATORS[name](full, labels, items)) == rows(OPERATORS[name](plain, labels, items))


@pytest.mark.parametrize("name", ["3 all", "6", "8 one", "9"])
def test_carried_columns_come_back_unchanged(tables, name):
    plain, full, labels, items = tables
    whole = {"3 all": lambda: decontam.without_leaks(full, items), "6": lambda: quality.classify(full, labels, out="made").drop("made"), "8 one": lambda: minhash.keep_one(full), "9": lambda: line_dedup.dedup_lines(full, out="text", counts=False)}[name]()
    assert whole.columns == full.columns
    assert whole.filter(" or ".join(f"`{c}` is distinct from 5" for c in INTERNAL if c not in plain.columns)).count() == 0


def test_stages_carry_clashing_columns(spark, tables, tmp_path):
    plain, full, labels, items = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, full, str(tmp_path))
        assert made.columns == full.columns, name
        assert rows(made.select(*plain.columns)) == rows(stage(spark, plain, str(tmp_path))), name
    last = corpus_pipeline.STAGES[-1][1]
    assert rows(last(spark, full, str(tmp_path))) == rows(last(spark, plain, str(tmp_path)))


def test_ids_of_other_types(tables):
    """String ids stay strings; ids that are no whole numbers count as none in the ring of next documents."""
    plain, _, _, items = tables
    named = plain.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    asked = items.withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    assert {r.item_id for r in decontam.leaks(named, asked).collect()} == {"i0", "i1"}
    assert fp.fingerprints(named).count() == plain.count() == minhash.near_duplicates(named).count()
    assert rows(fp.fingerprints(plain.withColumn("doc_id", F.col("doc_id").cast("string")))) == rows(fp.fingerprints(plain).withColumn("doc_id", F.col("doc_id").cast("string")))
    assert {r.component_id for r in minhash.near_duplicates(named).collect()} <= {r.doc_id for r in named.collect()}
