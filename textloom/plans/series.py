"""Queries of windows, orders, limits, chunks and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import grids, series
from textloom.plans._registry import query
from textloom.sources import files


@query("running_mean", "SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING), 9) AS mean FROM lineitem")
def running_mean(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(series.running_mean("l_quantity", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]), 9).alias("mean"))


EVERY = "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events"


@query("progress_rows", f"SELECT user_id, event_id, round(m, 9) AS mean, h AS highest FROM (SELECT *, avg(value) OVER w AS m, max(value) OVER w AS h FROM ({EVERY}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE i % 10 = 0 OR i = n")
def progress_rows(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = t("events").select("user_id", "event_id", F.round(F.avg("value").over(so_far), 9).alias("mean"), F.max("value").over(so_far).alias("highest"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    return rows.where("i % 10 = 0 OR i = n").drop("i", "n")


@query("gaps", "SELECT user_id, event_id, value - lag(value) OVER w AS gap, (value + lag(value) OVER w) / 2 AS middle FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def gaps(t):
    before = F.lag("value").over(series.ordered(["user_id"], ["event_id"]))
    return t("events").select("user_id", "event_id", (F.col("value") - before).alias("gap"), ((F.col("value") + before) / 2).alias("middle"))


@query(
    "smooth_minima",
    f"""WITH e AS ({EVERY}), s AS (SELECT a.user_id, a.event_id, a.i, round(sum(b.value) / 5, 6) AS smooth FROM e a JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS o) ON true JOIN e b ON a.user_id = b.user_id AND b.i = greatest(1, least(a.n, a.i + o)) GROUP BY ALL)
  SELECT user_id, event_id, smooth, coalesce(smooth < lag(smooth) OVER w AND smooth <= lead(smooth) OVER w, false) AS low FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def smooth_minima(t):
    keys = (["user_id"], ["event_id"])
    s = t("events").select("user_id", "event_id", F.round(series.smoothed("value", *keys, 5), 6).alias("smooth"))
    return s.withColumn("low", series.is_minimum("smooth", *keys))


@query("local_peaks", "SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM events) WHERE value = m AND value >= 20")
def local_peaks(t):
    rows = t("events").select("user_id", "event_id", "value", series.is_peak("value", ["user_id"], ["event_id"]).alias("peak"))
    return rows.where("peak AND value >= 20").drop("peak")


@query("spaced_peaks")
def spaced_peaks(t):
    """Greedy non-maximum suppression per user: sequential, so no SQL."""
    return series.spaced_peaks(t("events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 50, 5)


@query("merged_cuts")
def merged_cuts(t):
    """Cuts that come too near move to the middle: sequential, so no SQL."""
    cuts = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int")).alias("c"))
    return cuts.select("l_orderkey", F.to_json(series.merged_cuts(F.col("c"), 5)).alias("cuts"))


@query(
    "early_stop",
    """SELECT user_id, event_id, best, CAST(i - max(CASE WHEN p IS NULL OR value < p THEN i END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS since FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best,
  min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)""",
)
def early_stop(t):
    return series.early_stop(t("events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 4).select("user_id", "event_id", "best", "since")


@query("chunk_lines", "SELECT conv_id, turn, chunk FROM (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS chunk, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE (chunk + 1) * 2 <= n")
def chunk_lines(t):
    return series.chunks(t("conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 2)


@query("spans", "SELECT conv_id, start, array_to_string(l[start + 1 : start + 2], ' ') AS text FROM (SELECT *, CAST(concat('0x', substr(md5(concat('2|', conv_id)), 1, 8)) AS BIGINT) % (len(l) - 1) AS start FROM (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY ALL) WHERE len(l) >= 2)")
def spans(t):
    """A seeded run of two turns from each conversation that has two."""
    lines = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("l")).where("size(l) >= 2")
    start = F.conv(F.substring(T.shuffle_key(2, F.col("conv_id")), 1, 8), 16, 10).cast("long") % (F.size("l") - 1)
    return lines.withColumn("start", start).select("conv_id", "start", F.array_join(F.slice("l", (F.col("start") + 1).cast("int"), F.lit(2)), " ").alias("text"))


@query(
    "hyphen_join",
    r"SELECT conv_id, replace(replace(string_agg(x, chr(1) ORDER BY turn), concat('-', chr(1)), ''), chr(1), ' ') AS text FROM (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN concat(text, '-') ELSE text END, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g') AS x FROM conversations) WHERE x <> '' GROUP BY ALL",
)
def hyphen_join(t):
    text = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x")))), lambda r: r.x)
    return t("conversations").groupBy("conv_id").agg(lines.alias("l")).select("conv_id", T.glued(F.col("l")).alias("text"))


@query("chat_messages", """SELECT conv_id, count(*) AS n, string_agg(concat(role, ':', text), chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY ALL""")
def chat_messages(t):
    m = grids.messages(t("conversations"), "conv_id", "turn", "role", "text")
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda x: F.concat(x.role, F.lit(":"), x.content)), "\n").alias("chat"))


@query("exploded_items", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS at, CAST(e[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def exploded_items(t):
    return t("embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))


@query("min_group_size", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) >= 3")
def min_group_size(t):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("worst_50", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def worst_50(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


@query("limited_rows", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 64")
def limited_rows(t):
    return files.limited(t("lineitem").select("l_orderkey", "l_linenumber"), 64, "l_orderkey", "l_linenumber")


@query(
    "bucket_best_median_worst",
    """SELECT s_suppkey, CASE WHEN r <= 4 THEN 'BEST' WHEN n - r < 4 THEN 'WORST' ELSE 'MEDIAN' END AS bucket FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER () AS n FROM supplier) WHERE r <= 4 OR n - r < 4 OR (r > n // 2 - 2 AND r <= n // 2 + 2)""",
)
def bucket_best_median_worst(t):
    """Four rows at either end and in the middle. The order of the whole table is a sort; its places come
    from counts per range, so no task ranks it all."""
    rows = t("supplier").select("s_suppkey", "s_acctbal")
    ranged = rows.repartitionByRange(8, "s_acctbal", "s_suppkey").withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("part", before.alias("before"), F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    ranked = ranged.withColumn("in_part", F.row_number().over(Window.partitionBy("part").orderBy("s_acctbal", "s_suppkey"))).join(F.broadcast(places), "part")
    r, n = F.col("before") + F.col("in_part"), F.col("n")
    half = F.floor(n / 2)
    bucket = F.when(r <= 4, "BEST").when(n - r < 4, "WORST").when((r > half - 2) & (r <= half + 2), "MEDIAN")
    return ranked.select("s_suppkey", bucket.alias("bucket")).where("bucket IS NOT NULL")


@query("categorical_order_whole", "SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 999 END AS place FROM orders")
def categorical_order_whole(t):
    """All rows in that order; unknown categories last."""
    at = F.array_position(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.col("o_orderpriority")).cast("int")
    return t("orders").select("o_orderkey", "o_orderpriority", F.when(at > 0, at).otherwise(999).alias("place")).orderBy("place", "o_orderkey")


@query("string_order_whole", "SELECT name, row_number() OVER (ORDER BY name) AS place FROM (SELECT concat('checkpoint-', p_partkey * 100) AS name FROM part)")
def string_order_whole(t):
    """All names with their places in string order, counted per range."""
    names = t("part").select(F.concat(F.lit("checkpoint-"), F.col("p_partkey") * 100).alias("name"))
    ranged = names.repartitionByRange(8, "name").withColumn("part", F.spark_partition_id())
    before = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k")).select("part", before.alias("before"))
    in_part = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return ranged.withColumn("in_part", in_part).join(F.broadcast(places), "part").select("name", (F.col("before") + F.col("in_part")).alias("place")).orderBy("place")


@query("median_gap", "SELECT l_orderkey, CAST(floor(median(g)) AS INTEGER) AS gap FROM (SELECT l_orderkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS g FROM lineitem) WHERE g IS NOT NULL GROUP BY ALL")
def median_gap(t):
    gap = F.col("l_quantity") - F.lag("l_quantity").over(series.ordered(["l_orderkey"], ["l_quantity", "l_linenumber"]))
    return t("lineitem").select("l_orderkey", gap.alias("g")).where("g IS NOT NULL").groupBy("l_orderkey").agg(F.floor(F.median("g")).cast("int").alias("gap"))
