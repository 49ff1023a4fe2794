"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Nothing is trained. Each token's bytes become a string of one character per byte; the pieces of the
model are these strings, scored by their negative rank, with identity normalisation. sentencepiece
then merges the pair of best score first, leftmost on ties, which is the rank rule. A text is cut into
pre-tokens, their bytes mapped to characters, and each encoded by itself. Decoding maps ids back to
the tokens' bytes and joins them.

Tokens that the merges do not reach from their own bytes (none in the public files) would be looked up
whole, as the rank rule's users do.

Defined results: a null text is an empty one; an empty text has no ids; every other column stays, and a
new column whose name is taken gets an underscore in front (no other name is in the way). Repeated rows
and rows without an id are encoded one by one; very long texts are cut between pre-tokens and joined; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import _chunks
from textloom.llm import _common as C

RANKS = "byte_bpe_50k.tiktoken"

#: Rows handled at a time, so that a worker holds little beside its memo.
ROWS = 256

#: What ``encode_decode`` can return, with its Arrow and Spark types.
KINDS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "n_tokens": (pa.int64(), "bigint"),
    "ids_sha256": (pa.string(), "string"),
    "decoded": (pa.binary(), "binary"),
    "decoded_sha256": (pa.string(), "string"),
}


def byte_alphabet() -> str:
    """256 characters, one for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank. ``data``: lines of base64 token and rank."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()) if token)
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose id N is the token of rank N; the unknown piece, which
    no text can need, comes last."""
    alphabet = byte_alphabet()
    normal, unknown, bpe = 1, 2, 2
    pieces = b"".join(_field(1, _field(1, t.decode("latin-1").translate(alphabet).encode()) + _field(2, float(-rank)) + _field(3, normal)) for rank, t in enumerate(tokens))
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, rank_data: bytes, pattern: str = public_tokenizers.PATTERN):
        self.tokens = read_ranks(rank_data)
        self.kind = "H" if len(self.tokens) <= 1 << 16 else "I"
        self.alphabet = byte_alphabet()
        self.space = self.alphabet[32]
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        w = _chunks.WHITE  # the regex module's own \s has four characters more
        for old, new in ((r"[^\s\p{L}\p{N}]", rf"[^{w}\p{{L}}\p{{N}}]"), (r"\S", f"[^{w}]"), (r"\s", f"[{w}]")):
            pattern = pattern.replace(old, new)
        self.pre_tokens = regex.compile(pattern).findall
        own = [self.mapped(t) for t in self.tokens]
        self.whole = {t: [rank] for rank, (t, ids) in enumerate(zip(own, self.pieces.encode(own, num_threads=1), strict=True)) if ids != [rank]}

    def mapped(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.alphabet)

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        space, mapped = self.space, self.mapped
        # Printable ASCII stands for itself but for the space.
        parts = [[p.replace(" ", space) if p.isascii() and p.isprintable() else mapped(p.encode()) for p in found] for found in map(self.pre_tokens, texts)]
        ids = self.pieces.encode([p for ps in parts for p in ps], num_threads=1)
        if self.whole:
            ids = [self.whole.get(p, own) for p, own in zip((p for ps in parts for p in ps), ids, strict=True)]
        each = iter(ids)
        return [next(each) if len(ps) == 1 else [i for _ in ps for i in next(each)] for ps in parts]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the bytes of an array of type ``kind``."""
        return [array(self.kind, ids).tobytes() for ids in self.encode_many(texts)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _lists(each: list[array]) -> pa.Array:
    """Arrow lists of 32-bit ids."""
    ends = np.cumsum([0, *map(len, each)])
    flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, x.typecode).astype(np.int32) for x in each)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode_decode(df: DataFrame, want: tuple[str, ...] = ("ids",), text_col: str = "text", rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] | None = None) -> tuple[DataFrame, list[str]]:
    """Adds the columns ``want`` (see KINDS) to ``df``, or to its columns ``keep``; returns it and the names
    that they got.

    The ids are encoded from the whole text and decoded again; the rank file (under a MB) goes to the
    executors by broadcast. Rows stream in Arrow batches; a worker keeps one batch and a bounded memo of
    packed ids. Columns that do not stay, the text among them, are not sent back.
    """
    spark = df.sparkSession
    with open(rank_file or public_tokenizers.path(RANKS), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    columns = df.columns if keep is None else list(keep)
    names = [C.free_name(columns, w) for w in want]
    fields = list(zip(names, want, strict=True))
    sent, place = C.sent_once(df, text_col, columns, names)

    @_chunks.collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        kind = codec.kind
        decimals = [str(i) for i in range(len(codec.tokens))] if "ids_sha256" in want else []
        counted, hashed, restored = "n_tokens" in want, "ids_sha256" in want, "decoded" in want or "decoded_sha256" in want

        memo = _chunks.Memo(codec.packed)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                got: dict[str, list] = {w: [] for w in want}
                for found in memo.values(t.as_py() or "" for t in some.column(place)):
                    ids = array(kind, b"".join(found))
                    if "ids" in got:
                        got["ids"].append(ids)
                    if hashed:
                        got["ids_sha256"].append(hashlib.sha256(" ".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                    if counted:
                        got["n_tokens"].append(len(ids))
                    if restored:
                        data = codec.decode(ids)
                        if "decoded" in got:
                            got["decoded"].append(data)
                        if "decoded_sha256" in got:
                            got["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
                made = [_lists(got[w]) if w == "ids" else pa.array(got[w], KINDS[w][0]) for w in want]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(columns)], *made], names=[*some.schema.names[: len(columns)], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema[: len(columns)]), *(f"`{n}` {KINDS[w][1]}" for n, w in fields)])
    return sent.mapInArrow(run, schema), names


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    want = ("n_tokens", "ids_sha256", "decoded_sha256")
    out, names = encode_decode(docs, want, keep=("doc_id",))
    return out.select("doc_id", *(F.col(n).alias(w) for n, w in zip(names, want, strict=True)))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
