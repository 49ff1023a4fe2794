"""Queries of nested values, checkpoints, maps and seeded transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import udf as U
from textloom.plans._registry import query


@query(
    "json_harvest",
    """SELECT event_id, CASE WHEN props IS NULL THEN '' ELSE coalesce(array_to_string(regexp_extract_all(props, '"k" *: *"?([^",}]*)', 1), ' '), '') END AS texts FROM events""",
)
def json_harvest(t):
    """All values under a key name, at any depth."""
    return t("events").select("event_id", F.array_join(U.harvest(F.col("props"), ("k",), (), scalars=True), " ").alias("texts"))


def _nested(quoted: str) -> str:
    """SQL of both engines: nested JSON around a quoted JSON string."""
    return f"""concat('{{"page": {{"Text": ', {quoted}, ', "rec_texts": [', {quoted}, ', "", "b,c"], "n": 1}}, "parts": [{{"content": {{"rec_text": "inner"}}}}, {{"ocr_text": 5}}], "text": "last"}}')"""


@query(
    "json_harvest_nested",
    f"""WITH d AS (SELECT p_partkey, {_nested("to_json(concat(p_name, ' \"x\", ', p_brand))")} AS doc FROM part)
  SELECT p_partkey, string_agg(t.atom ->> '$', ' | ' ORDER BY t.id) AS texts FROM d, json_tree(d.doc) AS t
  WHERE t.type = 'VARCHAR' AND (lower(t.key) IN ('markdown', 'text', 'ocr_text', 'content', 'transcription', 'rec_text') OR t.path LIKE '%.rec_texts') AND t.atom ->> '$' <> '' GROUP BY p_partkey""",
)
def json_harvest_nested(t):
    """Texts of nested documents: quotes and commas inside values, lists, objects under a text's name."""
    row = t("part").select("p_partkey", F.expr("concat(p_name, ' \"x\", ', p_brand)").alias("v"))
    doc = row.select("p_partkey", F.regexp_replace(F.to_json(F.struct("v")), r'^\{"v":|\}$', "").alias("q")).select("p_partkey", F.expr(_nested("q")).alias("doc"))
    return doc.select("p_partkey", F.array_join(U.harvest(F.col("doc")), " | ").alias("texts"))


@query("restructured_rows", "SELECT doc_id, text AS transcription, 'corpus' AS source, 'train' AS split, source AS origin FROM documents")
def restructured_rows(t):
    return t("documents").select("doc_id", F.col("text").alias("transcription"), F.lit("corpus").alias("source"), F.lit("train").alias("split"), F.col("source").alias("origin"))


@query("conditional_transform_whole")
def conditional_transform_whole(t):
    """The same over whole texts. Engines differ in the case of some letters (ß), so no SQL checks it."""
    seed, text = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")), F.col("text")
    return t("documents").select("doc_id", F.when(seed.isNull(), text).when(F.col("lang") == "en", F.upper(text)).otherwise(F.lower(text)).alias("out"))


@query(
    "best_existing_checkpoint",
    "WITH c AS (SELECT DISTINCT user_id, event_id FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, arg_min(event_id, [value, event_id]) AS step, arg_min(event_id, [value, event_id]) FILTER (event_id % 2 = 0) AS there FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT user_id, step, coalesce(there, step) AS checkpoint FROM b",
)
def best_existing_checkpoint(t):
    """The best step of each run, and the best that has a checkpoint (the best itself if none has)."""
    kept = t("events").where("event_id % 2 = 0").select("user_id", "event_id").distinct().withColumn("there", F.lit(True))
    rows = t("events").where("value IS NOT NULL").join(kept, ["user_id", "event_id"], "left")
    order = F.struct("value", "event_id")
    best = rows.groupBy("user_id").agg(F.min_by("event_id", order).alias("step"), F.min_by("event_id", F.when(F.col("there"), order)).alias("found"))
    return best.select("user_id", "step", F.coalesce("found", "step").alias("checkpoint"))


@query("constant_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE -1 END AS slot FROM orders")
def constant_map(t):
    slots = F.create_map(F.lit("1-URGENT"), F.lit(0), F.lit("2-HIGH"), F.lit(1))
    return t("orders").select("o_orderkey", F.coalesce(F.try_element_at(slots, F.col("o_orderpriority")), F.lit(-1)).alias("slot"))


@query("map_precedence", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'default' END AS name, 'x' AS kind FROM nation")
def map_precedence(t):
    """Own values before defaults."""
    own = F.map_filter(F.create_map(F.lit("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))), lambda k, v: v.isNotNull())
    default = F.create_map(F.lit("name"), F.lit("default"), F.lit("kind"), F.lit("x"))
    merged = F.map_concat(F.map_filter(default, lambda k, v: ~F.map_contains_key(own, k)), own)
    return t("nation").select("n_nationkey", merged.alias("m")).select("n_nationkey", F.col("m")["name"].alias("name"), F.col("m")["kind"].alias("kind"))


@query("nested_history", "SELECT user_id, list_sum(list_transform(list_filter(h, lambda x: x > 10), lambda x: 1))::BIGINT AS n, list_min(h) AS best FROM (SELECT user_id, list(value ORDER BY event_id) AS h FROM events WHERE value IS NOT NULL GROUP BY ALL) WHERE len(list_filter(h, lambda x: x > 10)) > 0")
def nested_history(t):
    """Series as JSON documents, read back by path."""
    series = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.struct(x.value.alias("metric")))
    docs = t("events").where("value IS NOT NULL").groupBy("user_id").agg(F.to_json(F.struct(series.alias("log"))).alias("doc"))
    log = docs.select("user_id", F.inline(F.from_json("doc", "log ARRAY<STRUCT<metric: DOUBLE>>")["log"]))
    return log.groupBy("user_id").agg(F.count_if(F.col("metric") > 10).alias("n"), F.min("metric").alias("best")).where("n > 0")


@query("file_order", "SELECT page_id, regexp_replace(url, '/?[^/]*$', '') AS folder, row_number() OVER (PARTITION BY regexp_replace(url, '/?[^/]*$', '') ORDER BY url, page_id)::INTEGER AS place FROM pages")
def file_order(t):
    from pyspark.sql.window import Window

    rows = t("pages").select("page_id", "url", T.dirname(F.col("url")).alias("folder"))
    return rows.select("page_id", "folder", F.row_number().over(Window.partitionBy("folder").orderBy("url", "page_id")).alias("place"))
