"""Exact quantiles of few large groups, without a task that sees all values of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

#: Bits of a value's place that a pass settles, of 64: a pass counts at most 2^BITS buckets per group and rank.
BITS = 16


@arrow_udf(LongType())
def place(values: pa.Array) -> pa.Array:
    """Longs in the order of the doubles; both zeros are one value, NaN comes last. Null stays null."""
    x = values.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    keys = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
    return pa.array(keys, pa.int64(), mask=values.is_null().to_numpy(zero_copy_only=False))


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column per share: the quantile of non-null values, interpolated as ``percentile`` does.

    Wanted ranks are found by radix: each pass counts the buckets of ``BITS`` more bits in the buckets that hold
    a wanted rank. So what is shuffled and sent to all tasks depends on the groups, not on the rows.
    """
    rows = df.select(F.col(by).alias("__by"), F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL").withColumn("__place", place("__v"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__n"))
    at = [(F.col("__n") - 1) * F.lit(share) for share in shares.values()]
    ranks = F.array_distinct(F.array(*(f(x) for x in at for f in (F.floor, F.ceil))))
    wanted = counts.select("__by", F.explode(ranks).alias("__rank")).select("*", F.col("__rank").alias("__left"), F.lit(0).cast("long").alias("__bucket"))
    for shift in range(64 - BITS, -1, -BITS):
        inside = wanted.select(F.col("__by").alias("__g"), F.col("__bucket").alias("__in")).distinct()
        above = F.lit(0).cast("long") if shift + BITS == 64 else F.shiftright("__place", shift + BITS)
        met = rows.withColumn("__in", above).join(F.broadcast(inside.withColumnRenamed("__in", "__i")), F.col("__by").eqNullSafe(F.col("__g")) & (F.col("__in") == F.col("__i")))
        found = met.groupBy("__g", "__in", F.shiftright("__place", shift).alias("__next")).agg(F.count(F.lit(1)).alias("__k"), F.max("__v").alias("__value"))
        before = F.sum("__k").over(Window.partitionBy("__g", "__in").orderBy("__next").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__k")
        found = found.withColumn("__before", before)
        meets = F.col("__by").eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__in")) & (F.col("__left") >= F.col("__before")) & (F.col("__left") < F.col("__before") + F.col("__k"))
        wanted = found.join(F.broadcast(wanted.drop("__value")), meets).select("__by", "__rank", (F.col("__left") - F.col("__before")).alias("__left"), F.col("__next").alias("__bucket"), "__value")
    known = wanted.groupBy("__by").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__values"))
    sized = counts.join(F.broadcast(known.withColumnRenamed("__by", "__g")), F.col("__by").eqNullSafe(F.col("__g")))
    out = []
    for name, x in zip(shares, at, strict=True):
        low, high = (F.element_at("__values", f(x)) for f in (F.floor, F.ceil))
        out.append(F.when((F.floor(x) == F.ceil(x)) | (low == high), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name))
    return sized.select(F.col("__by").alias(by), *out)
