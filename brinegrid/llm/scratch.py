"""Tables that cut lineage, in the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key that holds more than one in HEAVY of all rows is met by broadcast; there are fewer than HEAVY of these.
HEAVY = 4096


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset and the session is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='brinegrid-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write `df` hashed by `key` into a bucketed table, so that later joins on `key` need not shuffle it again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (
        df.repartition(n, key)
        .write.option("compression", "zstd")
        .option("path", f"{shared_dir(spark)}/{table}")
        .bucketBy(n, key)
        .saveAsTable(table)
    )
    return spark.table(table)


def met(rows: DataFrame, groups: DataFrame, on: list[str], count: str = "c") -> DataFrame:
    """`rows` joined with `groups`, a row for each key with `count`, the number of `rows` of that key.

    No task gets a great share of the rows: the keys that hold more than one in HEAVY of them, fewer than HEAVY whatever the
    input, go to all tasks, so their rows are not shuffled; all other keys are met in a shuffle. `groups` is read several times.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * HEAVY > total
    few = F.broadcast(groups.filter(heavy))
    rest = rows.join(few.select(*on), on, "left_anti").join(groups.filter(~heavy), on)
    return rows.join(few, on).unionByName(rest)


#: Rows of one key that `spread` puts into one task.
CHUNK = 256


def spread(rows: DataFrame, *sides: tuple[DataFrame, list[str], str]) -> DataFrame:
    """`rows` joined with each (side, on, by), whose side may hold several and large rows for a key: a key's rows are dealt, by the
    column `by`, over as many parts as they fill CHUNK times, and each part gets the key's rows of the side. `rows` is narrow."""
    copied = []
    for k, (side, on, by) in enumerate(sides):
        counts = materialise(rows.groupBy(on).agg(F.count("*").alias("__c")), "counts")
        parts = F.ceil(F.col("__c") / CHUNK)
        rows = materialise(met(rows, counts, on, "__c").withColumn(f"__part{k}", F.pmod(F.xxhash64(by), parts)).drop("__c"), "dealt")
        copied.append(side.join(counts, on).withColumn(f"__part{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("__c"))
    for k, (_, on, _) in enumerate(sides):
        rows = rows.join(copied[k], [*on, f"__part{k}"]).drop(f"__part{k}")
    return rows


def numbered(docs: DataFrame) -> DataFrame:
    """(num, row), written: a number of its own for each row of `docs`, and the row as one struct, so no names can clash."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("num"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "numbered")


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` of the structs `row`."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])


def unused(names: list[str], name: str) -> str:
    """`name`, lengthened until no column of `names` is called so."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str):
    """A key of a document: rows that share both id and text are one document and get one decision."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
