"""Operators over ordered rows of a group: chunks, gaps, smoothing, peaks, early stopping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rank", F.row_number().over(ordered(keys, order))).where("__rank = 1").drop("__rank")


def running_mean(value: str, by: list[str], order: list[str]) -> Column:
    return F.avg(value).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))


def chunks(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``df`` with ``chunk``: runs of ``size`` rows without overlap; what is left at the end goes."""
    place = F.row_number().over(ordered(by, order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("chunk", F.floor(place / size)).withColumn("__n", n).where((F.col("chunk") + 1) * size <= F.col("__n")).drop("__n")


def smoothed(value: str, by: list[str], order: list[str], k: int) -> Column:
    """Centred mean over an odd number of rows; beyond the ends the end values repeat."""
    k = max(1, k | 1)
    pad = k // 2
    frame = ordered(by, order)
    around = frame.rowsBetween(-pad, pad)
    before = F.greatest(F.lit(0), F.lit(pad + 1) - F.row_number().over(frame))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    after = F.greatest(F.lit(0), F.row_number().over(frame) + pad - n)
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (F.sum(value).over(around) + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / k


def is_minimum(value: str, by: list[str], order: list[str]) -> Column:
    """Below the row before, not above the row after; never at the ends."""
    w = ordered(by, order)
    return F.coalesce((F.col(value) < F.lag(value).over(w)) & (F.col(value) <= F.lead(value).over(w)), F.lit(False))


def is_peak(value: str, by: list[str], order: list[str], around: int = 5) -> Column:
    return F.col(value) == F.max(value).over(ordered(by, order).rowsBetween(-around, around))


def spaced_peaks(df: DataFrame, by: list[str], place: str, score: str, distance: int, n: int) -> DataFrame:
    """Greedy: from the highest score down (ties by place), those at least ``distance`` from all taken, n at most."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, place], ascending=[False, True])
        taken: list = []
        for i, p in enumerate(rows[place]):
            if len(taken) == n:
                break
            if all(abs(p - rows[place].iat[j]) >= distance for j in taken):
                taken.append(i)
        return rows.iloc[taken].sort_values(place)

    return df.groupBy(*by).applyInPandas(run, df.schema)


def merged_cuts(cuts: Column, least: int) -> Column:
    """Sorted whole numbers; one too near to the last moves it to their middle instead."""
    return F.aggregate(
        F.array_sort(cuts),
        F.array().cast("array<int>"),
        lambda a, c: F.when((F.size(a) == 0) | (c - F.element_at(F.concat(F.array(F.lit(-1 << 30)), a), -1) >= least), F.concat(a, F.array(c))).otherwise(
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.floor((F.element_at(F.concat(F.array(F.lit(0)), a), -1) + c) / 2).cast("int")))
        ),
    )


def early_stop(df: DataFrame, by: list[str], order: list[str], metric: str, patience: int) -> DataFrame:
    """``df`` with the best value so far, evaluations since it fell, and whether to stop there."""
    w = ordered(by, order)
    best = F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("best", best).withColumn("__at", F.row_number().over(w)).withColumn("__better", F.when(before.isNull() | (F.col(metric) < before), F.col("__at")))
    since = F.col("__at") - F.max("__better").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("since", since.cast("long")).withColumn("stop", F.col("since") >= patience).drop("__at", "__better")


def best_row(df: DataFrame, by: list[str], metric: str, order: str, *columns: str) -> DataFrame:
    """The row of the least metric per group, the earliest of equals."""
    one = F.min_by(F.struct(*columns), F.struct(metric, order)).alias("one")
    return df.where(F.col(metric).isNotNull()).groupBy(*by).agg(one).select(*by, *(F.col(f"one.{c}").alias(c) for c in columns))


def integral(image: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading row and column of zeros."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    out[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)
    return out


def rectangle_sum(sums: np.ndarray, top: int, left: int, bottom: int, right: int) -> float:
    return float(sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left])
