import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import byte_bpe


@pytest.fixture(scope="module")
def ranks():
    with open(P.path(byte_bpe.RANKS), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(ranks)


@pytest.fixture(scope="module")
def theirs(ranks):
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs, special_tokens={})


def test_every_token_is_reached(codec):
    assert codec.whole == {}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_and_round_trip(text):
    own, lib = _pair()
    ids = own.encode_many([text])[0]
    assert ids == lib.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


_made = []


def _pair():
    if not _made:
        with open(P.path(byte_bpe.RANKS), "rb") as f:
            data = f.read()
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _made.extend([byte_bpe.Codec(data), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs, special_tokens={})])
    return _made


def test_operator_on_odd_rows(spark, theirs):
    texts = [None, "", " ", "a  b\n\n c\t", "x" * 5000, "it's 12,5 %　né 漢字 \x1c\x1d end", "it's"] + ["same row"] * 3
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, N_tokens int")
    out, names = byte_bpe.encode_decode(df, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    assert names[1] == "_n_tokens"
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode_ordinary(t or "")
        r = rows[i]
        assert r.ids == ids and r._n_tokens == len(ids) and r.N_tokens == -1
        assert bytes(r.decoded) == (t or "").encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_decode(df)[0].count() == 0


def test_query_against_library(spark, theirs, sf_dir):
    rows = {r.doc_id: r for r in byte_bpe.op2_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = theirs.encode_ordinary(d.text or "")
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
