"""Shared plumbing: table paths, the cluster's shared folder, materialised tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder and runs in one process (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share."""
    conf = spark.sparkContext.getConf()
    if not (folder := conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_CHECKPOINTS
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, packed: bool = False, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, so that a
    lost executor costs no more than the stage that it was running. ``packed``: its bytes would not
    compress any further."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.option("compression", "uncompressed" if packed else "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables that an operator writes on its way, and deletes when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str, packed: bool = False) -> DataFrame:
        self.paths.append(fresh_path(self.spark, label))
        return written(df, label, packed, self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


#: Keys that may be called hot at once. A key is hot if it has more than 1 / HOT_KEYS of the rows, so there
#: are fewer than that: a bound on what ``even_join`` broadcasts (two numbers each).
HOT_KEYS = 10_000
#: Rows that a key may have in any case.
FEW_ROWS = 256


def hot_keys(rows: DataFrame, key: str) -> list[tuple]:
    """(key, copies) of the keys of ``rows`` (a written table: it is read twice) with more than their share."""
    most = max(FEW_ROWS, rows.count() // HOT_KEYS)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNotNull() & (F.col("n") > most)).collect()
    return [(r[key], -(-r["n"] // most)) for r in hot]


def even_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """``left`` joined to ``right``, whose ``key`` is unique, so that no key's rows make a task large.

    Rows of a hot key are dealt by a hash of their column ``by``, and the one row of ``right`` is copied as
    often. Which keys are hot is counted over all of ``left``, a written table, or was before (``hot``)."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    salt, copies = (free_name([*left.columns, *right.columns], n) for n in ("salt", "copies"))
    table_ = F.broadcast(left.sparkSession.createDataFrame(hot, T.StructType([left.schema[key], T.StructField(copies, T.IntegerType())])))
    dealt = left.join(table_, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(by), copies).cast("int"), F.lit(0))).drop(copies)
    spread = right.join(table_, key, "left").withColumn(salt, F.explode(F.expr(f"sequence(0, coalesce({copies}, 1) - 1)"))).drop(copies)
    return dealt.join(spread, [key, salt], how).drop(salt)


#: Words of 64 bits in a sieve: a bound on what it broadcasts (two numbers each), whatever the tables.
SIEVE_WORDS = 1 << 19


def sieved(df: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false only where ``key`` (a long) is not in ``ids``' column of that name.

    Ids set bits of a table of bounded size, by their hashes. What meets no bit needs no join with ``ids``, so
    that large rows need not be shuffled for it; where ids are so many that most bits are set, most rows do."""
    word, bit, bits = (free_name([*df.columns, flag], n) for n in ("word", "bit", "bits"))
    place = F.xxhash64(F.col(key).cast("long"))
    spots = {word: F.pmod(F.shiftrightunsigned(place, 6), F.lit(SIEVE_WORDS)), bit: F.expr("shiftleft(1L, cast({p} & 63L AS INT))".format(p=f"xxhash64(cast(`{key}` AS BIGINT))"))}
    table_ = ids.select(key).withColumns(spots).groupBy(word).agg(F.bit_or(bit).alias(bits))
    met = df.withColumns(spots).join(F.broadcast(table_), word, "left")
    return met.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(F.col(bit)) != 0, F.lit(False))).drop(word, bit, bits)


def sent_once(df: DataFrame, text_col: str, columns: list[str], taken: list[str]) -> tuple[DataFrame, int]:
    """``columns`` of ``df`` for a batch function that also reads ``text_col``, and the text's place in them.
    A text that is no column of these comes last, under a name not ``taken``; one that is does not travel twice."""
    named = [F.col("`{}`".format(c.replace("`", "``"))) for c in columns]
    if text_col in columns:
        return df if columns == df.columns else df.select(*named), columns.index(text_col)
    return df.select(*named, F.col(text_col).alias(free_name([*columns, *taken], "text_"))), len(columns)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or with underscores before it where a column has that name (names are compared
    without regard to case, as Spark does)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted
