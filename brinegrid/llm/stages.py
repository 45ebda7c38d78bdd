"""The stages of corpus_pipeline.py, each over the documents that its predecessor kept.

Defined cases: empty tables give empty ones; null texts pass every filter but the classifier's, which scores them as empty; rows
with equal scores, ids or texts follow their operator's rule; columns beyond the documents' are carried through by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, minhash
from . import line_dedup as ld
from . import quality as nbsvm
from .queries import vocabulary_text
from .scratch import unused

#: Near-duplicates of the corpus: runs of five words, similarity 0.8.
RUN, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject; it is fitted on labelled documents of its own input."""
    out = unused(docs.columns, "score")
    scored = nbsvm.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), out=out)
    return scored.filter(F.col(out) >= 0.5).drop(out)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines of windows that occurred before; n_chars, where there is one, follows the text."""
    names = docs.columns
    cut = ld.dedup_lines(docs, out="text", counts=False)
    if "n_chars" not in names:
        return cut.select(*names)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id (rows without ids come last, ties are one row's)."""
    return minhash.keep_one(docs, words=RUN, percent=PERCENT)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null texts and null items leak nothing."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, and digests of its ids and of the text that they decode to."""
    made = bpe.encode(docs, vocabulary_text())
    count = (F.octet_length("ids") / 4).cast("long")
    return made.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
