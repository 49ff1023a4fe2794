"""The walk of a trie against all pairs."""

import random

import pytest

from textloom.functions import trie
from textloom.functions.udf import levenshtein


@pytest.mark.parametrize("step", [4, 1 << 17])
def test_walk_like_all_pairs(monkeypatch, step):
    monkeypatch.setattr(trie, "STEP", step)
    rng = random.Random(3)
    for _ in range(60):
        m, limit = rng.randrange(9), rng.randrange(5)
        texts = list({"".join(rng.choices("ab𐍈", k=m)) for _ in range(30)})
        queries = ["".join(rng.choices("ab𐍈\0", k=rng.randrange(13))) for _ in range(20)]
        tree = trie.Trie(texts)
        got = sorted((i, tree.texts[j], d) for part in tree.within(queries, limit) for i, j, d in zip(*(x.tolist() for x in part), strict=True))
        assert got == sorted((i, y, d) for i, x in enumerate(queries) for y in texts if (d := levenshtein(x, y)) <= limit)
