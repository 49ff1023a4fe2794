"""Columns in the way, rows that repeat, and other odd tables, for all operators alike."""

import hashlib

import pytest

from textloom.llm import _common as C
from textloom.llm import byte_bpe, decontaminate, external_shuffle, html_extract, kd_search, language_id, pii, toxicity

NAMES = ["__text", "text_", "__t", "__digit", "__m_email", "__rank", "__html", "__url", "__anything", "item", "row", "bucket", "score", "lang_pred", "spans", "shard", "slot", "items"]


def table(spark):
    schema = "doc_id long, text string, url string, html string, " + ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(i, t, "http://a.example/x", f"<article><p>{t}</p></article>", *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(["mail a@b.cc now", "", None, "mail a@b.cc now"])]
    return spark.createDataFrame(rows, schema)


def applied(df, name):
    """The operator's result and the names of its new columns."""
    if name == "bpe":
        out, new = byte_bpe.encode_decode(df, ("n_tokens",))
        return out, list(new)
    if name == "decontaminate":
        items = df.sparkSession.createDataFrame([(1, "mail a b cc now")], "item_id long, text string")
        out, new = decontaminate.find_items(df, items, block_chars=4)
        return out, [new]
    if name == "language":
        out, *new = language_id.predict(df, language_id.Filters([]))
        return out, new
    if name == "toxicity":
        out, new = toxicity.score(df, toxicity.Model(0.25))
        return out, [new]
    if name == "html":
        out, new = html_extract.extract(df)
        return out, [new]
    if name == "pii":
        out, new = pii.find(df)
        return out, [new]
    out, *new = external_shuffle.external_shuffle(df)
    return out, new


@pytest.mark.parametrize("name", ["bpe", "decontaminate", "language", "toxicity", "html", "pii", "shuffle"])
def test_no_column_is_lost_or_changed(spark, name):
    df = table(spark)
    out, new = applied(df, name)
    assert not set(new) & set(df.columns) and set(out.columns) == {*df.columns, *new}
    assert sorted(map(str, out.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert applied(df.limit(0), name)[0].count() == 0


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://there:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        C.shared_dir(Session())


def test_even_join_like_a_join(spark, monkeypatch):
    monkeypatch.setattr(C, "FEW_ROWS", 3)
    left = spark.createDataFrame([(i % 5 if i % 4 else 0, i, i) for i in range(200)] + [(None, 999, 0)], "k long, v long, salt long")
    right = spark.createDataFrame([(i, f"r{i}") for i in (0, 1, 2, 7)], "k long, name string")
    for how in ("inner", "left"):
        assert sorted(map(str, C.even_join(left, right, "k", "v", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_every_row_of_a_repeated_vector_id(spark, monkeypatch):
    monkeypatch.setattr(kd_search, "LEAF", 3)
    monkeypatch.setattr(kd_search, "BLOCK", 2)
    rows = [(i % 7, [float((i * 37) % 11) - 4, float((i * 53) % 13) - 5, float(2**20 if i % 9 == 0 else i)]) for i in range(60)]
    rows += [(0, rows[0][1]), (3, None), (3, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, kd_search.top_k(kd_search.index(df, shard_size=8, repeated="every"), every=3).collect()))
    own = [(i, kd_search.whole(v).tolist()) for i, v in rows if kd_search.whole(v) is not None]
    want = []
    for at, (q, v) in enumerate(own):
        if q % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(own) if n != at)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_any_number_of_languages(spark):
    import numpy as np

    names = [f"l{i:03}" for i in range(150)]
    words = [hashlib.md5(n.encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for n in names]
    filters = language_id.Filters(names)
    assert len(filters.planes) == 3
    for i, w in enumerate(words):
        filters.add(np.concatenate([h for _, h in language_id.grams(w)]), i)
    found, scores = filters.decide(words)
    assert found == names and all(0 <= s <= 1 for s in scores)
    rows = [(i * 4 + k, f"{w} {w[::-1]}", n) for i, (n, w) in enumerate(zip(names[:70], words)) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out, lang, _ = language_id.predict(df, language_id.learn(df))
    assert all(r.lang == r[lang] for r in out.collect())
