"""The numbered queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, debruijn, decontam, fim
from . import fingerprints as fp
from . import langid, lexical, licenses
from . import line_dedup as ld
from . import maxent, minhash, quality, suffix_dedup
from .scratch import fold


def vocabulary_text(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, read by the driver; it is of fixed size."""
    return Path(public_tokenizers.path(name)).read_text()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fp.fingerprints(_documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.dedup_bytes(_documents(spark, sf_dir))
    return made.select(
        F.col("id").alias("doc_id"), F.col("units").alias("n_bytes"), F.col("removed").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontam.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return made.select(F.col("id").alias("doc_id"), "item_id", "cosine", "subsequence", "answer", "start", "end")


def op4_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    made = bpe.encode(_documents(spark, sf_dir), vocabulary or vocabulary_text())
    return made.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = debruijn.dedup_words(_documents(spark, sf_dir))
    return made.select(F.col("id").alias("doc_id"), F.col("units").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    made = quality.classify(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return made.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang")
    filters = langid.fit(docs, fold("id", 3) != 1, "text", "lang")
    made = langid.identify(docs.select("id", "text"), filters)
    return made.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = minhash.near_duplicates(_documents(spark, sf_dir))
    return made.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ld.dedup_lines(_documents(spark, sf_dir))
    return made.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = maxent.score(_documents(spark, sf_dir), fold("id", 10) != 0)
    return made.select(F.col("id").alias("doc_id"), (fold("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_documents(spark, sf_dir))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licenses.scan(_documents(spark, sf_dir))
    return made.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_suffix_dedup, op3_decontamination, op4_bpe, op5_substring_dedup, op6_quality, op7_language, op8_near_duplicates, op9_line_dedup, op10_lm_score,
        op11_lexical_search, op12_fill_in_middle, op13_licenses,
    )
}

SQL = {
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 399)) AS i FROM d WHERE length(x) >= 800)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m) GROUP BY doc_id, run),
g AS (SELECT doc_id, b AS first, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, x, string_agg(substr(x, 2 * first + 1, 2 * (coalesce(last, length(x) // 2) - first)), '' ORDER BY first) AS kept, count(*) - 1 AS n FROM g JOIN d USING (doc_id) GROUP BY doc_id, x)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST((length(x) - length(kept)) // 2 AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM kept""",
    "op5_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws) - 34)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 35], ' ') AS win FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(35)) AS k)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op8_near_duplicates": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] END AS sh
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM w UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT c.id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.id""",
    "op9_line_dedup": """
WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT doc_id, i, line AS a, lead(line) OVER p AS b, lead(line, 2) OVER p AS c FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM w WHERE c IS NOT NULL AND (a <> '' OR b <> '' OR c <> '')),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(3)) AS k) WHERE nth > 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS kept, count(*) AS n FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op11_lexical_search": """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS d, CAST(sum(n) AS BIGINT) AS total FROM l),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * d + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, d),
g AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * d) // total))) AS gain FROM f JOIN w USING (term) JOIN l USING (doc_id), s),
r AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS us, sha256('42:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, us, len(us) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS hs FROM d),
r AS (SELECT doc_id, t, n, us, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM c""",
}
