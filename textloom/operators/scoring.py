"""Predictions against references: rows, summaries, confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import metrics as M
from textloom.functions import text as T
from textloom.functions.udf import pair_counts

# Historic letters that confusion tables always show.
HISTORIC = tuple("ѣѧѫѳѵѡѥѩѭѯѱ҂")
GAP = "<gap>"
#: Tasks that align rows, whatever the files they come from; twice as many rank what leaves them.
PARTS = 64


def scored(df: DataFrame, pred: str, gold: str, edits: M.Edits = M.distance) -> DataFrame:
    """``df`` with all row metrics; ``edits`` is the distance, by default Spark's, which is slow on long texts."""
    p, g = F.col(pred), F.col(gold)
    return df.withColumns({"cer_raw": M.cer(p, g, edits), "cer_stripped": M.cer_stripped(p, g, edits), "nls": M.nls(p, g, edits), "exact": M.exact(p, g)})


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Macro means per group; without rows, NaN."""
    means = {"mean_cer_raw": "cer_raw", "mean_cer_stripped": "cer_stripped", "mean_nls": "nls"}
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(M.mean_or_nan(F.col(c)).alias(name) for name, c in means.items()), M.mean_or_nan(F.col("exact").cast("double")).alias("exact_rate"))


def eval_summary(df: DataFrame, pred: str, gold: str, image: str) -> DataFrame:
    """Counts of what was left out, by the first reason, and means over the rest (0 without rows)."""
    reason = F.when(~T.is_meaningful(F.col(gold)), "meaningless").when(F.col(image).isNull(), "no_image").otherwise("scored")
    rows = scored(df.withColumn("reason", reason), pred, gold)
    kept = lambda c: F.when(F.col("reason") == "scored", F.col(c))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("scored", "no_image", "meaningless")),
        *(M.mean_or_zero(kept(c)).alias(f"mean_{c}") for c in ("cer_raw", "cer_stripped", "nls")),
    )


def paired(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with their references; a key on one side only is an error when the rows are used."""
    both = pred.withColumn("__p", F.lit(1)).join(gold.withColumn("__g", F.lit(1)), keys, "full_outer")
    ok = F.assert_true(F.col("__p").isNotNull() & F.col("__g").isNotNull(), "predictions and references differ in their keys")
    return both.where(ok.isNull()).drop("__p", "__g")


def confusion(df: DataFrame, pred: str, gold: str, by: list[str], top: int = 30, extra: tuple[str, ...] = HISTORIC) -> DataFrame:
    """(by, g, p, n): aligned character pairs with gaps; a pair stays if either side is among the row's
    most common reference characters (spaces aside, ties by place) or the extra ones.

    Rows are dealt to tasks before they are aligned, however few files they come from, and leave Python as
    counts. A reference character is in one pair each time, so pairs also tell the most common ones.
    """
    norm = df.select(*by, T.collapse(F.col(gold)).alias("__g"), T.collapse(F.col(pred)).alias("__p")).repartition(PARTS, *by, "__g", "__p")
    pairs = norm.select(*by, F.explode(pair_counts("__g", "__p")).alias("x")).select(*by, F.coalesce("x.g", F.lit(GAP)).alias("g"), F.coalesce("x.p", F.lit(GAP)).alias("p"), "x.n", "x.at")
    counted = pairs.groupBy(*by, "g", "p").agg(F.sum("n").alias("n"), F.min("at").alias("__at")).repartition(2 * PARTS, *by)
    same, group = Window.partitionBy(*by, "g"), Window.partitionBy(*by)
    ranked = counted.select(*by, "g", "p", "n", F.col("g").isin(" ", GAP).alias("__aside"), F.sum("n").over(same).alias("__k"), F.min("__at").over(same).alias("__first"))
    ranked = ranked.withColumn("__place", F.dense_rank().over(group.orderBy("__aside", F.desc("__k"), "__first", "g")))
    common = F.collect_set(F.when(~F.col("__aside") & (F.col("__place") <= top), F.col("g"))).over(group)
    shown = ranked.withColumn("__shown", F.concat(common, F.array(*map(F.lit, extra)).cast("array<string>")))
    return shown.where(F.array_contains("__shown", F.col("g")) | F.array_contains("__shown", F.col("p"))).select(*by, "g", "p", "n")


def merged_confusion(counts: DataFrame) -> DataFrame:
    return counts.groupBy("g", "p").agg(F.sum("n").alias("n"))


def merged_metrics(core: DataFrame, other: DataFrame, key: str, values: list[str], order: tuple[str, ...]) -> DataFrame:
    """All keys; the core's values win; ``order`` first, then the rest by name."""
    both = core.select(key, F.struct(*values).alias("__a")).join(other.select(key, F.struct(*values).alias("__b")), key, "full_outer")
    one = both.select(key, F.coalesce("__a", "__b").alias("__v")).select(key, "__v.*")
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    return one.withColumn("place", F.when(place > 0, place).otherwise(999)).orderBy("place", key)
