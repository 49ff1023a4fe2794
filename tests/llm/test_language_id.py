import numpy as np

from textloom.llm import language_id as L


def plain_grams(text):
    """All n-grams of the marked words, one by one."""
    out = []
    for n in L.SIZES:
        marked = "^" + "".join(c if c.isalpha() else "^" for c in text.lower()) + "^"
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if "^" not in g[1:-1] and g.strip("^"):
                out.append(g)
    return out


def test_grams_like_plain_ones():
    for text in ("", "a", "é1b", "one two,three", "x" * 50, "漢字 ab", "a-b c"):
        got = [h for _, hs in L.grams(text.lower()) for h in hs.tolist()]
        names = plain_grams(text)
        assert len(got) == len(names)
        assert len(set(got)) == len(set(names)) == len(set(zip(names, got)))


def test_filters_have_no_false_negatives_and_corrected_counts_are_near():
    rng = np.random.default_rng(1)
    f = L.Filters(["a", "b"])
    own = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    f.add(own, 0)
    f.add(own[:1000], 1)
    masks = f.containing(own)
    assert (masks & 1).all() and (masks[:1000] & 2).all()
    other = f.containing(rng.integers(0, 2**63, 200000, dtype=np.uint64))
    assert abs((other & 1).mean() - f.wrong[0]) < 5e-4


def test_batches_do_not_change_decisions():
    f = L.Filters(["x", "y"])
    f.add(np.concatenate([h for _, h in L.grams("the and of")]), 0)
    f.add(np.concatenate([h for _, h in L.grams("der und die")]), 1)
    texts = ["The end of", "und der", "", "12 3", "of", "die", "zzz"]
    together = f.decide(texts)
    alone = [f.decide([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone])
    assert together[0][:4] == ["x", "y", "und", "und"]


def test_odd_rows(spark):
    rows = [(i, t, lang, 0.5) for i, (t, lang) in enumerate([("the cat and the dog", "en")] * 6 + [("der hund und die katze", "de")] * 6 + [(None, "en"), ("", "de"), ("12 %", None), ("the and " * 30000, None), ("ωω", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out, lang, score = L.predict(df, L.learn(df))
    assert score == "_score"
    got = {r.doc_id: (r[lang], r[score]) for r in out.collect()}
    assert [got[i][0] for i in (0, 6, 12, 13, 14, 15)] == ["en", "de", "und", "und", "und", "en"]
    assert got[16][0] in ("en", "de") and got[16][1] == 0
    assert all(0 <= s <= 1 for _, s in got.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    filters = L.learn(df)
    assert filters.languages == [] and L.predict(df, filters)[0].count() == 0
    assert filters.decide(["abc"]) == (["und"], [0.0])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in L.op4_language_id(spark, sf).collect() if r.held_out]
    assert len(held) > 100
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
