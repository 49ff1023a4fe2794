import numpy as np

from textloom.llm import toxicity as T


def test_isotonic_is_monotone_and_best():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=200), rng.uniform(0.5, 2, 200)
    y = (rng.uniform(size=200) < 1 / (1 + np.exp(-2 * x))).astype(float)
    kx, ky = T.isotonic(x, y, w)
    assert (np.diff(ky) >= 0).all() and (np.diff(kx) >= 0).all()
    fitted = np.interp(x, kx, ky)
    assert abs(np.average(fitted, weights=w) - np.average(y, weights=w)) < 1e-9  # pooled means
    flat = [np.average((y - np.full(200, c)) ** 2, weights=w) for c in (0.3, 0.5)]
    assert np.average((y - fitted) ** 2, weights=w) < min(flat)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    t = T.Trees().fit(x[:1500], y[:1500], np.ones(1500))
    assert ((t.sums(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_features():
    f = T.Features(frozenset({"idiot", "lowei-"}))
    got = dict(zip(T.FEATURES, f.of("You IDIOT!! a loweitum id1ot fine sooo st*ff"), strict=True))
    assert got["lexicon"] == 1 / 8 and got["stems"] == 1 / 8 and got["undone"] == 1 / 8 and got["second"] == 1 / 8
    assert got["shouted"] == 1 / 8 and got["marks"] == 2 / 8 and got["stretched"] == 1 / 8 and got["obfuscated"] == 2 / 8
    assert got["near"] == 1.0
    assert f.of("") == f.of(" \n") == [0.0] * len(T.FEATURES)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "word " * 50000, 9.0), (3, "word " * 50000, 9.0), (None, "x", None)], "doc_id long, text string, Score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out, name = T.score(docs, T.learn(docs, none))
    assert name == "_score" and [r[name] for r in out.collect()] == [0.0] * 5
    one = spark.createDataFrame([(2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert T.learn(docs, one).scores(np.zeros((1, 12)))[0] == 1.0
    assert T.score(docs.limit(0), T.Model(0.5))[0].count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in T.op9_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    y, p, s = (np.array(v) for v in ([truth[r.doc_id] for r in rows], [r.predicted for r in rows], [r.score for r in rows]))
    assert ((s >= 0) & (s <= 1)).all()
    assert (p[y == 1]).mean() > 0.75 and (p[y == 0]).mean() < 0.01
    assert abs(s.mean() - y.mean()) < 0.02
