import random

import corpus_pipeline
from pyspark.sql import functions as F

from .conftest import table, words


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(3)
    item = " ".join(f"term{k}" for k in range(30))
    texts = [words(rng, 60) for _ in range(150)] + ["bad " * 60 + str(k) for k in range(60)]
    texts += [texts[0], texts[1] + " and more", words(rng, 20) + " " + item, None, ""]
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.filter("doc_id < 630").select("doc_id", (~F.startswith("text", F.lit("bad "))).cast("int").alias("quality"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        counts.append(now.count())
    ids = {r.doc_id for r in now.collect()}
    assert not ids & set(range(450, 630, 3)), "junk goes"
    assert 0 in ids and 630 not in ids and 633 not in ids, "one of each group stays"
    assert 636 not in ids, "the leak goes"
    assert len(ids & set(range(0, 450, 3))) == 150, "clean documents stay"
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_stages_of_empty_null_and_clashing_tables(spark, tmp_path, docs, none):
    """Each stage on no rows, on rows without texts or ids, and on columns named as the operators' own."""
    spark.createDataFrame([(0, 1), (3, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "some words of an item"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (5, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bare = docs.drop("n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        assert stage(spark, nulls, str(tmp_path)).count() == 3, name
        for table_ in (docs, bare):
            made = stage(spark, table_, str(tmp_path))
            assert made.columns == table_.columns and made.count() <= table_.count(), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, none, str(tmp_path)).count() == 0
    assert [r.n_tokens for r in last(spark, nulls, str(tmp_path)).collect()] == [0, 0, 0]
