import heapq
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import token_files as T


def huffman_bits(counts):
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60))
def test_lengths_are_a_best_code(counts):
    counts = np.array(counts)
    free, tight = T.code_lengths(counts, 60), T.code_lengths(counts, 7)
    assert (counts * free).sum() == huffman_bits(counts)
    assert tight.max() <= 7
    for lengths in (free, tight):
        assert sum(2.0**-x for x in lengths.tolist()) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=3_000))
def test_round_trip(ids):
    ids = np.array(ids)
    symbols, counts = np.unique(ids, return_counts=True)
    book = T.Codebook(symbols, T.code_lengths(counts))
    payload, checkpoints = book.encode(ids)
    assert (book.decode(payload, checkpoints, len(ids)) == ids).all()
    block = slice(T.BLOCK, 2 * T.BLOCK)  # a block alone
    if len(ids) > T.BLOCK:
        assert (book.decode(payload, checkpoints[1:2], len(ids[block])) == ids[block]).all()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abB'.,1éªœ漢\n \t"), max_size=40))
def test_words_between_spaces_like_whole_texts(text):
    lib, encode, lines = _made()
    ids = lines(text)
    whole = np.array(lib.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert ids is None or ids == whole
    assert b"".join(map(encode, T._chunks.cuts(text))) == whole


_kept = []


def _made():
    if not _kept:
        with open(P.path(T.TOKENIZER), encoding="utf-8") as f:
            lib = T._library(f.read())
        encode = T.encoder(lib, "<u2")
        _kept.extend([lib, encode, T.Lines(lib, "<u2")])
    return _kept


def expected(rows):
    lib = Tokenizer.from_file(P.path(T.TOKENIZER))
    start, out = 0, []
    for doc, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, T.END_ID], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_IDS", 50)
    rows = [(9, None), (3, ""), (5, "a <|endoftext|> b"), (4, "long " * 3000), (7, "tie"), (8, "tie"), (1, "né 漢\n\n x")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    got = T.read_files(spark, T.write_files(df), ("ids_crc32", "ids"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(expected(sorted(rows)))


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_files(spark, T.write_files(empty)).count() == 0
    df = spark.createDataFrame([(None, "x"), (None, "x"), (1, "y")], "doc_id long, text string")
    got = sorted(T.read_files(spark, T.write_files(df)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1] and [r.start for r in got] == [0, 2, 4]


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(map(tuple, T.op8_token_files(spark, sf_dir).collect())) == expected(docs)
