import random

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import decontaminate as D


def plain_distance(item, text):
    """Sellers' algorithm, cell by cell."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def brute(docs, items):
    out = set()
    for i, item in items:
        item = D.plain(item)
        for d, text in docs if len(item) >= D.LEAST else ():
            if text and (n := plain_distance(item, D.plain(text))) <= int(len(item) * D.ERRORS):
                out.add((d, i, n))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abcd", max_size=120))
def test_myers_like_sellers(item, text):
    assert D.Pattern(item).distance(text) == plain_distance(item, text)


def edited(rng, text, n):
    chars = list(text or "none")
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at : at + rng.randrange(2)] = rng.choice("xyz ")
    return "".join(chars)


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "thion", "er", "and", "ingre"]) + rng.choice(["", "ed", "on"])
    some = lambda n: " ".join(word() for _ in range(n))
    items = [(i, some(rng.randrange(8, 30))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (3, some(12)), (0, None)]
    docs = [(0, None), (1, ""), (2, "!!! ...")]
    for d in range(3, 60):
        text = some(rng.randrange(5, 80))
        if d % 2:
            text += "\n" + edited(rng, rng.choice(items)[1] or "", rng.randrange(9)).upper().replace(" ", " -\t") + ". " + some(5) if items else ""
        docs.append((d, text))
    docs += [(70, "the of " * 9000), (71, docs[5][1]), (71, docs[5][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):
        out, name = D.find_items(df, bench, block_chars=block)
        assert name == "_items"
        got = [(r.doc_id, x["item_id"], x["distance"]) for r in out.collect() for x in r[name]]
        assert set(got) == brute(docs, items) and len(got) > 10
        assert all(r["items"] == "x" for r in out.collect())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find_items(docs, items)[0].count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert D.find_items(one, items)[0].first()["items"] == []


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {tuple(r) for r in D.op6_decontaminate(spark, sf_dir).collect()}
    exact = {(d, i) for d, t in docs for i, x in items if len(D.plain(x)) >= D.LEAST and D.plain(x) in D.plain(t)}
    assert exact and exact == {(d, i) for d, i, n in got if n == 0}


def test_short_items_match_exactly(spark):
    docs = [(0, "Who wrote Hamlet?"), (1, "So: WHO wrote -- Hamlet, then"), (2, "who wrote hamlets"), (3, "xwho wrote hamlet"), (4, "who wrote hamlex"), (5, "问。谁写了哈姆雷特？答")]
    items = [(1, "who wrote Hamlet?"), (2, "谁写了哈姆雷特"), (3, ""), (4, "?!")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out, name = D.find_items(df, bench)
    assert {(r.doc_id, x.item_id, x.distance) for r in out.collect() for x in r[name]} == {(0, 1, 0), (1, 1, 0), (5, 2, 0)}
