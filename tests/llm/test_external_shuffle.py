"""The two-pass shuffle against its law and a plain version of its columns."""

import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from textloom.llm import _common as C
from textloom.llm import external_shuffle as X


def placed(df, **options):
    """(shard, slot) -> row, of any run."""
    out, shard, slot = X.external_shuffle(df, **options)
    rows = out.collect()
    got = {(r[shard], r[slot]): tuple(r[c] for c in df.columns) for r in rows}
    assert len(got) == len(rows)
    return got


def lawful(got, n, shards=8):
    """Counts at most one apart, slots gapless from 0."""
    counts = Counter(s for s, _ in got)
    assert sum(counts.values()) == n
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(k for t, k in got if t == s) == list(range(sizes[s])) for s in range(shards))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_law_and_reproducibility(spark):
    rows = [(i, f"text {i % 50}") for i in range(1003)]
    one = placed(table(spark, rows).repartition(7), bucket_bytes=500)
    two = placed(table(spark, list(reversed(rows))).repartition(3), bucket_bytes=500)
    lawful(one, 1003)
    assert one == two  # the order is of the rows and the seed, whatever the partitions
    assert sorted(one.values()) == sorted(rows)
    other = placed(table(spark, rows), bucket_bytes=500, seed=1)
    lawful(other, 1003)
    assert sum(one[k] == other[k] for k in one) < 20
    lawful(placed(table(spark, rows), n_shards=3), 1003, 3)


def test_uniform(spark):
    """Where rows with the least ids go: shards and halves of shards are equally likely (chi-squared)."""
    got = placed(table(spark, [(i, "x") for i in range(4000)]), bucket_bytes=100)
    cells = Counter((s, k >= 250) for (s, k), row in got.items() if row[0] < 1600)
    assert sum((cells.get((s, h), 0) - 100) ** 2 / 100 for s in range(8) for h in (False, True)) < 37.7  # 15 degrees, 0.1 %
    follow = sum(got[s, k][0] < got[s, k + 1][0] for s in range(8) for k in range(499)) / (8 * 499)
    assert abs(follow - 0.5) < 0.04


def test_equal_rows_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "FEW_ROWS", 10)
    rows = [(7, "same")] * 3000 + [(7, f"other {i}") for i in range(500)] + [(i, "z") for i in range(500)] + [(None, None)] * 400
    df = table(spark, rows)
    dealt, counts = X.scattered(df, 20, 1, "bucket")
    assert dealt.count() == len(rows) and max(r.n for r in counts.collect()) < 400
    got = placed(df, bucket_bytes=1000)
    lawful(got, len(rows))
    assert Counter(got.values()) == Counter(rows)


def test_buckets_are_partitions(spark):
    df = table(spark, [(i, "word " * 20) for i in range(2000)])
    dealt, counts = X.scattered(df, 40, 1, "bucket")
    used = dealt.repartitionById(40, F.col("bucket")).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("bucket").alias("n")).collect()
    assert len(used) == counts.count() == 40 and all(r.n == 1 for r in used)


def test_odd_tables(spark):
    assert X.external_shuffle(table(spark, []))[0].count() == 0
    lawful(placed(table(spark, [(1, None)])), 1)
    rows = [(None, None, 1, "a", 0, "b"), (1, "", 2, "a", 0, "b"), (1, "x" * 300_000, 3, None, 0, "b")]
    df = table(spark, rows, "doc_id long, text string, rank int, shard string, bucket int, slot string")
    out, shard, slot = X.external_shuffle(df)
    assert (shard, slot) == ("_shard", "_slot") and sorted(map(str, out.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_memory_for_bucket(spark):
    assert X.LEAST_BUCKET <= X.memory_for_bucket(spark) <= X.LARGEST_BUCKET


def test_query_against_sql_and_law(spark, sf_dir):
    """What SQL can give of the query's columns, and the law for the rest."""
    rows = X.op5_external_shuffle(spark, sf_dir).collect()
    db = duckdb.connect()
    want = dict((d, (n, t)) for d, n, t in db.execute(f"SELECT doc_id, strlen(coalesce(text, '')) + 1, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall())
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (n, zlib.crc32(t.encode())) for d, (n, t) in want.items()}
    lawful({(r.shard, r.slot): r for r in rows}, len(want))
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_no_python_in_the_plan(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    dealt, counts = X.scattered(docs, 8, 1, "bucket")
    plan = dealt.join(X.offsets(counts), "bucket")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)
