"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``.
A row whose column is null, or a repeated row, is treated as the stage's operator defines it; each stage says
what it does with them. Columns that the tables have beyond these stay until the last stage, whatever their
names; very long texts pass like any other; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from textloom.llm import _common as C
from textloom.llm import byte_bpe, decontaminate, language_id, near_dedup, pii


#: Times an even share of the languages' corrected counts that the predicted language must have, where there
#: are several: text that is in none of the learned languages spreads evenly, or has no known n-gram.
LIFT = 1.1
#: Of repeated texts, five words make a shingle here.
SHINGLE = 5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: tuple[str, ...] | None = None, lift: float = LIFT) -> DataFrame:
    """Language ID: a document stays if its predicted language is one of ``wanted`` (any learned one), with a
    score that tells it from the others. Null or empty texts, texts without a letter, and texts of languages
    that were not learned go. Repeated rows are decided alike; rows without an id like any others."""
    filters = language_id.learn(docs)
    out, lang, score = language_id.predict(docs, filters)
    several = len(filters.languages) > 1
    known = (F.col(lang) != language_id.UNKNOWN) & (F.col(score) > (lift / len(filters.languages) if several else 0.0))
    return out.where(known & F.col(lang).isin(*wanted) if wanted else known).select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: of each group the document with the least id stays, and of its repeated rows one.
    Different texts of one id are documents of their own. Texts without words, and rows without an id, stay."""
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        gone = near_dedup.near_duplicates(docs, size=SHINGLE).where("NOT kept").select("doc_id")
        met = C.free_name(docs.columns, "met")
        marked = C.sieved(docs, "doc_id", gone, met)
        return marked.where(~F.col(met)).unionByName(marked.where(met).join(gone, "doc_id", "left_anti").select(marked.columns)).select(docs.columns)
    row = C.free_name(docs.columns, "row")
    ordered = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text")
    rows = C.written(ordered.withColumn(row, F.monotonically_increasing_id()), "rows")
    kept = near_dedup.near_duplicates(rows, size=SHINGLE, id_col=row).where("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns).union(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go. Null and empty texts hold none."""
    out, items = decontaminate.find_items(docs, C.table(spark, sf_dir, "benchmark"))
    return out.where(F.size(items) == 0).select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans give way to their kind in brackets; the length follows. A null text stays null."""
    spans = C.free_name(docs.columns, "spans")
    candidates = pii.candidates(docs, "text", spans)
    # Training reads small rows; the texts stay where they are and are searched again with the weights.
    small = C.written(candidates.where(F.size(spans) > 0).select(spans), "pii")
    weights = pii.train(small, spans)
    marked = candidates.withColumn(spans, pii.chosen(weights, spans))
    text = pii.redacted("text", spans)
    out = marked.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: each document's ids, and the digest of what they decode to. A null text has no ids."""
    out, names = byte_bpe.encode_decode(docs, ("ids", "n_tokens", "decoded_sha256"), keep=("doc_id",))
    ids, n, digest = names
    return out.select("doc_id", F.col(n).alias("n_tokens"), F.col(ids).alias("ids"), F.col(digest).alias("decoded_sha256"))


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontaminate", decontaminated),
    ("pii", redacted),
    ("byte_bpe", tokenised),
]

#: Stages that SQL cannot express; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
