"""Queries over whole tables and texts, against plain Python."""

import random

from textloom.functions import udf as U
from textloom.plans import registry


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def run(spark, folder, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein():
    rng = random.Random(5)
    for n in range(600):
        a = "".join(rng.choices("abé𐍈", k=rng.randrange(90)))
        b = "".join(rng.choices("abé𐍈", k=rng.randrange(90))) if n % 2 else "".join(c for c in a if rng.random() < 0.9) + "b" * (n % 3)
        assert U.levenshtein(a, b) == edits(a, b)


DOCS = [
    (1, "x" * 400 + " the other thing", "en"),
    (2, "é " * 200 + "ä th [th] ß", "de"),
    (3, "th", "de"),
    (4, "", "de"),
    (5, "короткий текст", None),
    (7, None, "en"),
    (8, "Straße " * 30, "de"),
]


def test_cer_nls_of_whole_texts(spark, tmp_path):
    table(spark, tmp_path, "documents", DOCS, "doc_id long, text string, lang string")
    want = {}
    for _, text, lang in DOCS:
        g, p = (" ".join(x.split()) for x in (text or "", (text or "").replace("th", "t")))
        d = edits(p, g)
        want.setdefault(lang, []).append((d / len(g) if g else 0.0, 1 - d / len(g) if g else 1.0, float(p == g)))
    got = {r[0]: r[1:] for r in run(spark, tmp_path, "cer_nls_by_group_whole")}
    assert set(got) == set(want)
    for lang, rows in want.items():
        n, cer, stripped, nls, exact = got[lang]
        assert n == len(rows)
        assert [round(sum(x) / n, 9) for x in zip(*rows)] == [cer, nls, exact]
        assert stripped < cer if lang == "de" else stripped == cer  # "[th]" is gone


def test_decontamination_of_documents(spark, tmp_path):
    rng = random.Random(8)
    items = ["".join(rng.choices("abcd é", k=rng.randrange(3, 60))) for _ in range(12)] + ["two\nlines of one item", ""]
    docs = [None, "", "two  lines of one item", "two lin of one item", "a\nlines of one itme\nb", "nothing near"]
    for n in range(60):
        x = list(rng.choice(items))
        for _ in range(rng.randrange(9)):
            x.insert(rng.randrange(len(x) + 1), "x")
        docs.append("".join(x) if n % 2 else "z" * 70 + "\n" + "".join(x) + "\nlast")
    table(spark, tmp_path, "documents", list(enumerate(docs)), "doc_id long, text string")
    table(spark, tmp_path, "benchmark", list(enumerate(items)), "item_id long, text string")
    units = lambda x: {y for u in [*x.split("\n"), x] if (y := " ".join(u.split()))}
    held = set().union(*map(units, items))
    want = [(i,) for i, x in enumerate(docs) if not any(edits(u, h) <= 4 for u in units(x or "") for h in held)]
    assert sorted(run(spark, tmp_path, "decontam_edit_distance_whole")) == want
    assert 10 < len(want) < 60


def test_whole_orders(spark, tmp_path):
    table(spark, tmp_path, "orders", [(i, ["3-LOW", "1-URGENT", "2-HIGH", None][i % 4]) for i in range(900)], "o_orderkey long, o_orderpriority string")
    place = {"1-URGENT": 1, "2-HIGH": 2}
    want = sorted((place.get(p, 999), i, p) for i, p in ((i, ["3-LOW", "1-URGENT", "2-HIGH", None][i % 4]) for i in range(900)))
    assert run(spark, tmp_path, "categorical_order_whole") == [(i, p, n) for n, i, p in want]
    table(spark, tmp_path, "part", [(i,) for i in range(1, 700)], "p_partkey long")
    names = sorted(f"checkpoint-{i * 100}" for i in range(1, 700))
    assert run(spark, tmp_path, "string_order_whole") == [(x, n) for n, x in enumerate(names, 1)]


def test_sample_is_of_joined_orders(spark, tmp_path):
    table(spark, tmp_path, "orders", [(i, i % 10) for i in range(50)], "o_orderkey long, o_custkey long")
    table(spark, tmp_path, "customer", [(1, "c", 1)], "c_custkey long, c_name string, c_nationkey long")
    table(spark, tmp_path, "nation", [(1, "n")], "n_nationkey long, n_name string")
    assert len(run(spark, tmp_path, "three_way_join")) == 3


def test_conditional_transform_of_whole_texts(spark, tmp_path):
    table(spark, tmp_path, "documents", DOCS, "doc_id long, text string, lang string")
    want = {(i, x if x is None or i % 3 == 0 else x.upper() if lang == "en" else x.lower()) for i, x, lang in DOCS}
    assert set(run(spark, tmp_path, "conditional_transform_whole")) == want
