"""Splits, samples and mixes. All randomness is the order of ``md5(seed | key)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import shuffle_key


#: Digits of the seeded order (hexadecimal) that number a stratum's cells: 4096 of them.
CELL_DIGITS = 3


@dataclass(frozen=True)
class Ratios:
    train: float = 0.7
    val: float = 0.1
    test: float = 0.2

    def __post_init__(self):
        if abs(self.train + self.val + self.test - 1) > 1e-6:
            raise ValueError("the ratios must sum to 1")


def sizes(n: Column, ratios: Ratios = Ratios()) -> tuple[Column, Column]:
    """Train and validation sizes of n rows, rounded half to even; what is left is the test part. A part
    that rounding would overfill gives way to train, which has one row at least."""
    train = F.greatest(F.lit(1), F.bround(n * ratios.train)).cast("int")
    val = F.least(F.bround(n * ratios.val).cast("int"), n - train)
    return train, val


def stratified(df: DataFrame, key: str, strata: list[str], seed: object = 1337, ratios: Ratios = Ratios()) -> DataFrame:
    """``df`` with the column ``split``: within each stratum the distinct keys, in seeded order, are train,
    then val, then test. All rows of a key are in one split; a key in several strata counts in the least.

    A stratum may hold a third of all rows, so no window spans one. Keys fall into cells by the first digits
    of their seeded order; cells are counted and summed up in order, and a key's rank is its
    cell's first rank plus its place in the cell.
    """
    names = [f"__s{i}" for i in range(len(strata))]
    one = df.groupBy(key).agg(F.min(F.struct(*(F.col(s).alias(n) for s, n in zip(strata, names, strict=True)))).alias("__s"))
    keys = one.select(F.col(key).alias("__key"), "__s.*").withColumn("__order", shuffle_key(seed, F.col("__key")))
    keys = keys.withColumn("__cell", F.substring("__order", 1, CELL_DIGITS))
    counts = keys.groupBy(*names, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*names).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*names))).drop("__n")
    same = [F.col(f"k.{n}").eqNullSafe(F.col(f"f.{n}")) for n in [*names, "__cell"]]
    placed = keys.alias("k").join(firsts.alias("f"), same).select("k.*", "f.__first", "f.__all")
    rank = F.col("__first") + F.row_number().over(Window.partitionBy(*names, "__cell").orderBy("__order", "__key"))
    train, val = sizes(F.col("__all"), ratios)
    split = F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")
    splits = placed.select("__key", split.alias("split"))
    return df.join(splits, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def fingerprint(df: DataFrame, key: str, *by: str) -> DataFrame:
    """SHA-256 of the sorted keys, each ended by a line feed, per group."""
    lines = F.concat(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n"), F.lit("\n"))
    return df.groupBy(*by).agg(F.sha2(lines, 256).alias("sha256"), F.count(F.lit(1)).alias("n"))


def shared_between(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split: none, if the split is one."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def assigned(df: DataFrame, ids: DataFrame, key: str, order: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Rows with their split from an id table (key, split); an id in several takes the first of ``order``,
    rows without one go, repeated rows stay."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("split"))
    one = ids.groupBy(key).agg(F.min(place).alias("__place"))
    return df.join(one, key).withColumn("split", F.element_at(F.array(*map(F.lit, order)), F.col("__place").cast("int"))).drop("__place")


def take(df: DataFrame, n: int, key: str, seed: object) -> DataFrame:
    """n rows in seeded order (0: all)."""
    return df.orderBy(shuffle_key(seed, F.col(key)), key).limit(n) if n else df


def held_out(key: str, percent: int, seed: object) -> Column:
    """True for about ``percent`` of the keys."""
    return F.conv(F.substring(shuffle_key(seed, F.col(key)), 1, 8), 16, 10).cast("long") % 100 < percent


def mix_sizes(synthetic: int, real: int, percent: int) -> tuple[int, int]:
    """Rows (synthetic, real) at a target percentage of synthetic ones: all of the limiting pool, and as
    many of the other as the ratio asks for, rounded half to even on the total."""
    if percent in (0, 100):
        return (0, real) if percent == 0 else (synthetic, 0)
    if real * percent <= synthetic * (100 - percent):
        return round(real * 100 / (100 - percent)) - real, real
    return synthetic, round(synthetic * 100 / percent) - synthetic


def mix(synthetic: DataFrame, real: DataFrame, percent: int, key: str, seed: object) -> DataFrame:
    n, m = mix_sizes(synthetic.count(), real.count(), percent)
    some = lambda df, k: take(df, k, key, seed) if k else df.limit(0)
    return some(synthetic, n).withColumn("pool", F.lit("synthetic")).unionByName(some(real, m).withColumn("pool", F.lit("real")), allowMissingColumns=True)


def mix_many(pools: dict[str, DataFrame], shares: dict[str, int], key: str, seed: object) -> DataFrame:
    """Any number of pools at percentages: the pool that runs out first sets the total."""
    counts = {name: df.count() for name, df in pools.items()}
    total = min(counts[name] * 100 // share for name, share in shares.items() if share)
    out = None
    for name, share in shares.items():
        some = pools[name].orderBy(shuffle_key(seed, F.col(key)), key).limit(total * share // 100).withColumn("pool", F.lit(name))
        out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    return out


def replicated(df: DataFrame, times: int, key: str, seed: object) -> DataFrame:
    """Each row ``times`` times; replica 0 has no augmentation seed, the others one of 32 bits."""
    each = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    bits = F.conv(F.substring(shuffle_key(seed, F.col(key), F.col("replica")), 1, 8), 16, 10).cast("long")
    return each.withColumn("augment_seed", F.when(F.col("replica") > 0, bits))


def id_lists(spark: SparkSession, folder: str, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(doc_id, split) from one text file of ids per split."""
    out = None
    for name in names:
        ids = spark.read.text(f"{folder}/{name}_ids.txt").select(F.trim("value").alias("doc_id")).where("doc_id <> ''").distinct().withColumn("split", F.lit(name))
        out = ids if out is None else out.unionByName(ids)
    return out
