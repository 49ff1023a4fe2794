import hashlib



import corpus_pipeline as P
from tests.llm import test_decontaminate, test_near_dedup, test_pii


def brute(docs, items):
    """The stages one after another, in plain Python (language ID: only rejects texts without a letter)."""
    docs = {d: t for d, t in docs.items() if t and any(map(str.isalpha, t))}
    groups = test_near_dedup.brute(list(docs.items()))
    docs = {d: t for d, t in docs.items() if groups[d][1] == d}
    leaks = {d for d, _, _ in test_decontaminate.brute(list(docs.items()), items)}
    docs = {d: t for d, t in docs.items() if d not in leaks}
    out = {}
    for d, t in docs.items():
        done, text = 0, ""
        for start, _, kind, end in test_pii.base_of(t):
            if end > done:
                if start >= done:
                    text += t[done:start] + f"[{kind.upper()}]"
                done = end
        out[d] = text + t[done:]
    return out


def check(spark, rows, items, sf):
    got = {r.doc_id: r for r in P.run(spark, sf).collect()}
    want = brute(rows, items)
    assert set(got) == set(want)
    for d, t in want.items():
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[d].n_tokens == len(got[d].ids)


def test_small_tables(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog and then it runs through all of the green fields to the river "
    rows = {1: base * 3, 2: base * 3 + "end", 3: None, 4: "", 5: "12 %", 6: "mail a.b@mail.com or +1 (269) 555-3296 now", 7: base + "Secret: a benchmark passage that nobody should have trained on, really.", 8: "mail a.b@mail.com or +1 (269) 555-3296 now", 9: "word " * 20000}
    items = [(1, "a benchmark passage that nobody should have trained on")]
    spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    check(spark, rows, items, str(tmp_path))


def test_repeated_rows_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one text here"), (1, "one text here"), (2, "one text here")], "doc_id long, text string")
    assert [tuple(r) for r in P.deduplicated(spark, docs, "").collect()] == [(1, "one text here")]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_different_texts_of_one_id(spark):
    """An id's texts are kept or go one by one."""
    rows = [(1, "one text here"), (1, "another thing of the same id"), (2, "one text here"), (2, "what only two has"), (2, "what only two has"), (None, "one text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in P.deduplicated(spark, docs, "").collect()), key=repr)
    assert got == sorted({*rows} - {(2, "one text here")}, key=repr)


def test_stages():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "byte_bpe"]

