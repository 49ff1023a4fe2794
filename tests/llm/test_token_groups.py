"""Words looked up once for a group of texts, and ids packed run by run."""

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import token_files as T

_kept = []


def _made():
    if not _kept:
        with open(P.path(T.TOKENIZER), encoding="utf-8") as f:
            lib = T._library(f.read())
        _kept.extend([lib, T.Lines(lib, "<u2")])
    return _kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abB'.,1éªœ漢\r\n \t"), max_size=30), max_size=8), st.sampled_from([1, 20, 1 << 20]))
def test_groups_like_whole_texts(texts, group):
    lib, lines = _made()
    plain, old = [t for t in texts if lines.plain(t)], T.GROUP_CHARS
    T.GROUP_CHARS = group
    try:
        got = lines.many(plain)
    finally:
        T.GROUP_CHARS = old
    assert got == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in plain]


def test_a_word_is_looked_up_once_a_group(monkeypatch):
    lib, _ = _made()
    lines, seen = T.Lines(lib, "<u2"), []

    class Counted(T.Words):
        def __getitem__(self, word):
            seen.append(word)
            return super().__getitem__(word)

    lines.memo = Counted(lib, "<u2")
    assert len(set(lines.many(["the same words here", "the same words here"] * 20))) == 1
    assert len(seen) == 4


def test_runs_are_one_bit_string(monkeypatch):
    ids = np.random.default_rng(1).zipf(1.3, 20 * T.BLOCK + 77) % 5_000
    symbols, counts = np.unique(ids, return_counts=True)
    book = T.Codebook(symbols, T.code_lengths(counts))
    want = "".join(format(int(book.code[i]), f"0{book.bits[i]}b") for i in ids)
    for run in (T.BLOCK, 3 * T.BLOCK, 64 * T.BLOCK):
        monkeypatch.setattr(T, "RUN", run)
        payload, checkpoints = book.encode(ids)
        assert "".join(format(b, "08b") for b in payload)[: len(want)] == want and len(payload) == (len(want) + 31) // 32 * 4
        assert (book.decode(payload, checkpoints, len(ids)) == ids).all()
