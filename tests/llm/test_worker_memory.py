"""What batch functions send and keep: texts travel once, and a worker gives back what a task no longer needs."""

import re
from array import array

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from textloom.llm import _chunks, byte_bpe, decontaminate, language_id


@pytest.mark.parametrize("name", ["bpe", "language", "decontaminate"])
def test_texts_travel_once(spark, name):
    df = spark.createDataFrame([(1, "one two", "x"), (2, None, "y")], "doc_id long, text string, extra string")
    if name == "bpe":
        out = byte_bpe.encode_decode(df, ("n_tokens",))[0]
    elif name == "language":
        out = language_id.predict(df, language_id.Filters([]))[0]
    else:
        out = decontaminate.find_items(df, spark.createDataFrame([(1, "one two")], "item_id long, text string"))[0]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("text_") == 0
    assert sorted((r.doc_id, r.text, r.extra) for r in out.collect()) == [(1, "one two", "x"), (2, None, "y")]


def test_only_kept_columns_come_back(spark):
    df = spark.createDataFrame([(1, "one two", 5), (2, None, 6)], "doc_id long, text string, n_tokens int")
    out, names = byte_bpe.encode_decode(df, ("n_tokens", "ids", "decoded_sha256"), keep=("doc_id",))
    assert out.columns == ["doc_id", *names] and names[0] == "n_tokens"
    whole, old = byte_bpe.encode_decode(df, ("n_tokens", "ids", "decoded_sha256"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.select("doc_id", *old).collect()))


def _own() -> float:
    """MB of this process without mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_memory_goes_back():
    @_chunks.collector_off
    def run(batches):
        held = [pa.array(np.arange(5_000) + i).cast(pa.string()) for i in range(2_000)]  # some 100 MB
        peak.append(_own())
        yield from batches
        del held

    peak, before = [], _own()
    assert list(run(iter([1, 2]))) == [1, 2]
    assert peak[0] > before + 60 and _own() < before + 20


def test_memo_of_packed_ids():
    """A memo's value is one string of bytes, two for each id of a vocabulary of up to 65,536 tokens."""
    with open(P.path(byte_bpe.RANKS), "rb") as f:
        codec = byte_bpe.Codec(f.read())
    assert codec.kind == "H"
    words = ["one", " two\n", "", "漢字"]
    packed = codec.packed(words)
    assert [len(x) for x in packed] == [2 * len(ids) for ids in codec.encode_many(words)]
    assert [codec.decode(array(codec.kind, x)).decode() for x in packed] == words
