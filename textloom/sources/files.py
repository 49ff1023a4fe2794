"""Readers and writers. Schemas are always declared; records end at a line feed and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

SCHEMAS = {
    "list_entry": "url STRING, doc_id STRING, title STRING, date_raw STRING, city STRING, summary STRING",
    "document": "doc_id STRING, url STRING, transcription_diplomatic STRING, transcription_spaced STRING, metadata MAP<STRING, STRING>, image_paths_relative ARRAY<STRING>",
    "manifest": "doc_id STRING, url STRING, transcription_diplomatic STRING, transcription_spaced STRING, images ARRAY<STRING>, date_raw STRING, list_date_raw STRING, city STRING, list_city STRING",
    "shard": "doc_id STRING, split STRING, text STRING, text_spaced STRING, image_paths ARRAY<STRING>, primary_image STRING, url STRING, date_raw STRING, city STRING",
    "folio": "folio_id STRING, page_url STRING, image_url STRING, image_path STRING, html_path STRING, n_lines INT, lines ARRAY<STRING>, error STRING",
    "crop": "folio_id STRING, line_start INT, line_end INT, n_lines INT, gold STRING, image_path STRING, bbox_xyxy ARRAY<INT>, source_image STRING",
    "sample": "image STRING, text STRING, source STRING, doc_id STRING, split STRING, original_image STRING",
    "mix_row": "sample_id STRING, image_path STRING, text STRING, source STRING, augment_seed INT, augment_replica_index INT",
    "prediction": "doc_id STRING, model STRING, prediction STRING, gold STRING, primary_image STRING",
    "evaluated": "row_index INT, doc_id STRING, image_path STRING, gold_raw STRING, gold_norm STRING, pred STRING, cer_raw DOUBLE, cer_brackets_stripped DOUBLE, nls DOUBLE",
    "trainer_state": "global_step INT, best_metric DOUBLE, best_model_checkpoint STRING, log_history ARRAY<STRUCT<step: INT, eval_gen_cer: DOUBLE, eval_gen_nls: DOUBLE>>",
}


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped. ``schema``: DDL or a name from SCHEMAS."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("lineSep", "\n").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Id, date and place of each record, from the list where the record has none."""
    rows = jsonl(spark, path, "manifest")
    filled = lambda *names: T.first_filled(*map(F.col, names))
    return rows.select("doc_id", filled("date_raw", "list_date_raw").alias("date_raw"), filled("city", "list_city").alias("city"))


def index(spark: SparkSession, path: str) -> DataFrame:
    rows = jsonl(spark, path, "list_entry")
    return rows.select("doc_id", *(T.first_filled(F.col(c)).alias(c) for c in ("date_raw", "city")))


def folios(spark: SparkSession, path: str) -> DataFrame:
    """Folios without an error and with lines."""
    return jsonl(spark, path, "folio").where("error IS NULL AND n_lines > 0 AND size(lines) > 0")


def ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("doc_id")).where("doc_id <> ''").distinct()


def documents(spark: SparkSession, pattern: str, schema: str = "document") -> DataFrame:
    """Many small JSON files, in the order of their ids."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).json(pattern, multiLine=True).orderBy(T.first_filled(F.col("doc_id")))


def report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document as one row."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def history(states: DataFrame) -> DataFrame:
    """The evaluations in trainer states, a row each: those that have the metric."""
    return states.select("*", F.inline("log_history")).drop("log_history").where("eval_gen_cer IS NOT NULL")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; bytes that are no UTF-8 become replacement characters."""
    content = F.make_valid_utf8(F.col("content").cast("string"))
    return spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(content, "\r?\n")).alias("line_no", "line"))


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths, sorted as strings (so checkpoint-1000 stands before checkpoint-900)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path").orderBy("path")


def not_yet(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job has still to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def links(html: Column, pattern: str) -> Column:
    """Distinct group-1 matches, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))))


def limited(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order (0: all)."""
    return df.orderBy(*order).limit(n) if n else df


# --- writers ------------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, one_file: bool = False, compression: str = "none") -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("compression", compression).json(path)


def write_by_split(df: DataFrame, path: str, key: str = "doc_id", split: str = "split") -> None:
    """A folder per split, each file in the order of the key."""
    df.repartition(F.col(split)).sortWithinPartitions(split, key).write.mode("overwrite").partitionBy(split).json(path)


def write_plain_and_gzip(df: DataFrame, path: str) -> None:
    write_jsonl(df, path)
    write_jsonl(df, f"{path}_gz", compression="gzip")


def write_report(df: DataFrame, path: str) -> None:
    """A small result as JSON text."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_with_errors(df: DataFrame, path: str, error: str = "error") -> None:
    """Good rows and, apart, the rows with an error and why."""
    write_jsonl(df.where(F.col(error).isNull()).drop(error), path)
    write_jsonl(df.where(F.col(error).isNotNull()), f"{path}_errors")


def parameters(spark: SparkSession, config: dict) -> DataFrame:
    """A resolved configuration as (key, value) rows, nested keys joined by dots."""

    def flat(node: dict, before: str = ""):
        for k, v in node.items():
            yield from flat(v, f"{before}{k}.") if isinstance(v, dict) else [(f"{before}{k}", str(v))]

    return spark.createDataFrame(list(flat(config)), "key string, value string")
