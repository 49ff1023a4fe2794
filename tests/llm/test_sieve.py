"""The sieve before joins: no id that is there is missed, odd rows and clashing names are no matter."""

from textloom.llm import _common as C


def test_sieve_misses_nothing(spark):
    df = spark.createDataFrame([(i, i * 3) for i in range(3000)] + [(None, 1), (7, 2)], "doc_id long, word long")
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 7)] + [(None,), (7,), (-5,)], "doc_id long")
    out = C.sieved(df, "doc_id", ids, "bit").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.word) for r in out) == sorted((r.doc_id is None, r.doc_id or 0, r.word) for r in df.collect())
    assert all(r.bit for r in out if r.doc_id is not None and r.doc_id % 7 == 0)
    assert sum(r.bit for r in out) < 450


def test_empty_sides(spark):
    ids = spark.createDataFrame([], "doc_id long")
    assert not any(r.met for r in C.sieved(spark.createDataFrame([(1,), (None,)], "doc_id long"), "doc_id", ids, "met").collect())
    assert C.sieved(ids, "doc_id", ids, "met").count() == 0
