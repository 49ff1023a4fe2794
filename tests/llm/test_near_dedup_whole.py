"""Near-duplicates where joins are dealt, tables are not broadcast, and against all pairs of a larger table."""

import os
import random

import pytest

from tests.llm.test_near_dedup import brute, family, got
from textloom.llm import _common as C
from textloom.llm import near_dedup as N


@pytest.mark.parametrize("few,bound", [(3, 0), (3, 1 << 25)])
def test_hot_leaders_classes_and_centres(spark, monkeypatch, few, bound):
    monkeypatch.setattr(C, "FEW_ROWS", few)
    monkeypatch.setattr(N, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(N, "CHUNK", 8)
    rng = random.Random(3)
    texts = [None, "", "one"] + ["the same text of several words again"] * 40
    texts += list(family(rng, 60, 2)) + list(family(rng, 40, 9, length=60)) + [f"alone {i} of its own kind here" for i in range(30)]
    rng.shuffle(texts)
    rows = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    assert got(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_links_of_a_whole_table(spark):
    """Every link of all pairs is found at a scale with large groups."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert got(N.op3_near_dedup(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_nothing_is_left_behind(spark):
    folder = f"{C.shared_dir(spark)}/textloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = N.near_duplicates(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f")], "doc_id long, text string"))
    left = [x for x in set(os.listdir(folder)) - before]
    assert out.count() == 2 and len(left) == 1


def test_sets_of_equal_size_are_told_apart():
    assert N.set_name(b"12345678") != N.set_name(b"12345679") and len(N.set_name(b"")) == 16
