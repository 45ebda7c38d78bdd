"""Document fingerprints: one-permutation MinHash with DataFrame functions only.

A text's distinct runs of five words are hashed once; the top bits of a hash name one of 128 bins and each bin keeps its
smallest hash. An empty bin takes the value of the first full bin on a probe order of its own (a permutation of the bins for
each bin, so the choice is made by the bin alone: optimal densification). The low eight bits of each value are packed
into a hexadecimal string; likeness corrects the share of equal positions for chance agreement (2**-8).

Defined cases: null text is empty; a text of one to four words is one run; a text without words has the fingerprint
"", like only to another of these (1.0, else 0.0). Rows that share an id follow each other in the order of their texts'
hashes; a null id comes last in descending order. With one row its next document is itself; an empty table gives none; extra
columns are not carried; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import bind

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
#: An empty bin tries so many bins one by one; the first full one on the rest of its order is found by rank.
PROBES = 8
_steps = [(i * 37 + 11) % 64 * 2 + 1 for i in range(BINS)]


def _shingles(text: Column, words: int = WORDS) -> Column:
    # a single plain space is split on without a regular expression
    split = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) >= words, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(split, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column) -> Column:
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS)
    low = (1 << LOW_BITS) - 1
    steps, turns, shifts = F.lit(_steps), F.lit([pow(s, -1, BINS) for s in _steps]), F.lit([(i * 73 + 29) % BINS for i in range(BINS)])

    def minima(hashes: Column) -> Column:
        return F.filter(hashes, lambda x, i: F.coalesce(bin_of(x) != bin_of(F.get(hashes, i - 1)), F.lit(True)))

    def packed(full: Column, table: Column) -> Column:
        """full: the smallest hash of each bin that has one; table: the same by bin."""

        def value(i: Column) -> Column:
            # bin i probes (t * step - shift) mod BINS for t = 0, 1, ...; `turn` undoes `step`
            step, turn, shift = F.get(steps, i), F.get(turns, i), F.get(shifts, i)
            tried = [F.get(table, (step * t - shift).bitwiseAND(BINS - 1)) for t in range(PROBES)]
            rank = lambda x: ((bin_of(x) + shift) * turn).bitwiseAND(F.lit(BINS - 1).cast("bigint"))
            rest = F.array_min(F.transform(full, lambda x: rank(x) * (low + 1) + x.bitwiseAND(F.lit(low).cast("bigint"))))
            return F.coalesce(F.get(table, i), *tried, rest).bitwiseAND(F.lit(low).cast("bigint"))

        every = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.lpad(F.lower(F.hex(value(i))), LOW_BITS // 4, "0"))
        return F.when(F.size(full) > 0, F.array_join(every, "")).otherwise(F.lit(""))

    def tabled(full: Column) -> Column:
        at = lambda bins: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(full, (F.array_position(bins, i.cast("bigint")) - 1).cast("int")))
        return bind(bind(F.transform(full, bin_of), at), lambda table: packed(full, table))

    return bind(bind(F.sort_array(_shingles(F.coalesce(text, F.lit("")))), minima), tabled)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for agreement by chance of the low bits."""
    wide, chance = LOW_BITS // 4, 2.0**-LOW_BITS
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, i * wide + 1, F.lit(wide)) == F.substr(b, i * wide + 1, F.lit(wide))))
    raw = (same / BINS - chance) / (1 - chance)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def with_next(docs: DataFrame, order: str, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """`docs` with the column `next`: `columns` of the row that follows in descending `order` (after the last: the first).

    The order is cut into ranges at quantiles, at most 8192 numbers on the driver whatever the input, and each range is
    a window partition. A number that fills several ranges (rows without ids, say) has a range of its own, cut by its rows'
    hashes. The first row of a range is dealt to the range before as well, where it ends the window. Rows of one number go by the
    hash of the columns `tie` (all of `columns` by default); an `order` that is no whole number counts as none.
    """
    spark = docs.sparkSession
    n = min(8192, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(order).try_cast("bigint"), F.lit(-(1 << 63)))
    found = docs.select(F.percentile_approx(key, [(i + 1) / n for i in range(n - 1)], 10 * n).alias("q")).first()["q"] or []
    times = {q: found.count(q) for q in set(found)}
    heavy = {q for q, k in times.items() if k > 1}
    bounds = sorted(set(found) | {q - 1 for q in heavy if q > -(1 << 63)}) or [0]
    pieces = [times[q] + 1 if q in heavy else 1 for q in bounds] + [1]
    base = [sum(pieces[p + 1 :]) for p in range(len(pieces))]
    # the number of bounds under the key, by binary search
    steps = F.lit([1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)])
    under = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(F.lit(bounds), at + s - 1) < F.col("__key"), at + s).otherwise(at))
    share = (F.shiftright("__tie", 32) + (1 << 31)) * F.get(F.lit(pieces), F.col("__under"))
    dealt = docs.withColumns({"__key": key, "__tie": F.xxhash64(*(tie or columns))}).withColumn("__under", under)
    dealt = dealt.withColumn("__part", (F.get(F.lit(base), F.col("__under")) + F.shiftright(share, 32)).cast("int"))
    firsts = {r["p"]: (~r["f"]["k"], r["f"]["t"]) for r in dealt.groupBy(F.col("__part").alias("p")).agg(F.min(F.struct(F.bitwise_not("__key").alias("k"), F.col("__tie").alias("t"))).alias("f")).collect()}
    parts = sorted(firsts)
    edges = [(*firsts[q], p) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)]
    edge = spark.createDataFrame(edges, "`__key` bigint, `__tie` bigint, `__to` int")
    dealt = dealt.join(F.broadcast(edge), ["__key", "__tie"], "left")
    ways = F.array_compact(F.array(F.struct(F.lit(False).alias("extra"), F.col("__part").alias("p")), F.when(F.col("__to").isNotNull(), F.struct(F.lit(True).alias("extra"), F.col("__to").alias("p")))))
    dealt = dealt.withColumn("__way", F.explode(ways)).withColumns({"__p": F.col("__way.p"), "__extra": F.col("__way.extra")})
    over = Window.partitionBy("__p").orderBy("__extra", F.desc("__key"), "__tie")
    dealt = dealt.withColumn("next", F.lead(F.struct(*columns)).over(over))
    return dealt.filter("not __extra").drop("__key", "__tie", "__under", "__part", "__to", "__way", "__p", "__extra")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: its last half, rounded down, replaced by the start of the next."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    pairs = with_next(own, "doc_id", ["text", "fp"], ["text"]).withColumn("n", F.length("text").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), F.col("n").cast("int") - half), F.substr(F.col("next.text"), F.lit(1), half))
    made = pairs.select("doc_id", "n", edited.alias("edited"), "fp", F.col("next.fp").alias("next_fp")).withColumn("edited_fp", fingerprint(F.col("edited")))
    return made.select(
        "doc_id", F.col("n").alias("n_chars"), "edited", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
