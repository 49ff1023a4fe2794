import random
import re

import numpy as np

from textloom.llm import near_dedup as N


def word_set(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or {tuple(words)}


def brute(rows):
    """doc_id -> (size, component), comparing all pairs of different sets."""
    sets = {d: word_set(t) for d, t in rows}
    same = {}
    for d, s in sets.items():
        same.setdefault(frozenset(s), []).append(d)
    groups = [(s, min(ds)) for s, ds in same.items() if s]
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for s, ds in same.items():
        for d in ds if s else ():
            join(ds[0], d)
    groups.sort(key=lambda x: len(x[0]))
    for i, (a, x) in enumerate(groups):
        for b, y in groups[i + 1 :]:
            if 100 * len(a) < 80 * len(b):
                break
            if 100 * len(a & b) >= 80 * len(a | b):
                join(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(rng, n, edits, length=80, vocab=5000):
    base = [f"w{rng.randrange(vocab)}" for _ in range(length)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        yield " ".join(words)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 16)
    rng = random.Random(7)
    texts = [None, "", " \t\n", "One two", "one TWO", "one two three four", "a b c d e", "é À b c", "É à b c", "x" * 50000, "long " * 20000]
    for edits in (1, 3, 6, 9):
        texts += family(rng, 60, edits)
    texts += [t for t in family(rng, 5, 2, length=9) for _ in range(3)]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, cls string")
    assert got(N.near_duplicates(df)) == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (5, "a b c d e"), (5, "q r s t")]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (5, 1, False), (5, 5, True)]
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(N.op3_near_dedup(spark, sf_dir)) == brute(rows)


def test_estimates():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        all_ = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
        a, b = all_[:450], all_[50:]
        ra, rb = (N.compressed(N.least_values(x)) for x in (a, b))
        errors.append(N.estimate(np.array([(ra == rb).mean()]), np.array([450]))[0] - 400 / 500)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04


def test_chance_of_equal_registers():
    rng = np.random.default_rng(5)
    hits = [(N.compressed(N.least_values(rng.integers(0, 2**63, 64, dtype=np.uint64))) == N.compressed(N.least_values(rng.integers(0, 2**63, 64, dtype=np.uint64)))).mean() for _ in range(400)]
    assert abs(np.mean(hits) - N.chance_table()[6]) < 4e-4
