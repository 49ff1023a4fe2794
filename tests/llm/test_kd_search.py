import math

import duckdb
import numpy as np

from textloom.llm import kd_search as K


def brute(rows, every, k=5):
    v = {}
    for i, x in rows:
        w = K.whole(x)
        if i is not None and w is not None:
            w = w.tolist()
            v[i] = w if i not in v else min(v[i], w, key=lambda z: np.array(z, "<i4").tobytes())
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], w)), i) for i, w in v.items() if i != q and len(w) == len(v[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_odd_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAF", 4)
    monkeypatch.setattr(K, "BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(i, [0.5] * 6) for i in range(60, 100)]  # one very common vector
    rows += [(100, None), (101, []), (102, [1.0, None] * 3), (103, [math.nan] * 6), (104, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (105, [1.0, 2.0]), (110, [3.0, 4.0])]
    rows += [(106, [1e30] * 6), (107, [500000.0] * 6), (0, rows[0][1]), (1, [0.0] * 6)]
    df = spark.createDataFrame([(i, x, "s") for i, x in rows], "vec_id long, embedding array<double>, shard string")
    got = K.top_k(K.index(df, shard_size=16), every=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)



def test_wide_components(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAF", 4)
    monkeypatch.setattr(K, "BLOCK", 3)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(90)]
    rows += [(100, [1e7, 0.25, -3.0]), (101, [600000.0] * 3), (102, [-1e7, 5.0, 600000.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, K.top_k(K.index(df, shard_size=16), every=5).collect()))
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(db.execute(K.ORACLES["op10_kd_search"].replace("% 50", "% 5")).fetchall())
    assert any(x[2] in (100, 101, 102) for x in got)


def test_products_beyond_longs():
    """Exact where products cancel; an error only for a score that is no long."""
    big = 1 << 62
    vectors = np.array([[big, -big + 1, 1], [big, -big, 2], [1, 1, 1], [-big, big, 0]], np.int64)
    tree = K.Tree.build(np.arange(4), vectors, 1)
    (_, best), = tree.search(np.array([9]), np.array([[big, big, 3]], np.int64), [None])
    want = sorted((-sum(a * b for a, b in zip(v, [big, big, 3])), i) for i, v in enumerate(vectors.tolist()))
    assert best == want


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.top_k(K.index(df), 50).collect()] == [(0, 1, 7, 256 * 512)]
    assert K.top_k(K.index(df.limit(0)), 50).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    v, q = rng.integers(-99, 99, (500, 8)), rng.integers(-99, 99, (20, 8))
    t = K.Tree.build(np.arange(500), v, 16)
    for n, (first, end, *_rest) in enumerate(t.nodes.tolist()):
        bound = np.maximum(q, 0) @ t.high[n] + np.minimum(q, 0) @ t.low[n]
        assert (bound >= (q @ t.vectors[first:end].T).max(1)).all()


def test_query_and_oracle(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, K.op10_kd_search(spark, sf).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(db.execute(K.ORACLES["op10_kd_search"]).fetchall())
