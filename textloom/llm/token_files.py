"""Token ids as canonical length-limited Huffman codes, with random access by block.

Writing: every text is encoded, an end id is appended, and the ids are counted over all documents. The
counts give the best code whose lengths stay within a limit (package-merge), in canonical form, so that
the lengths alone describe it. Documents are put in ascending id order by ranges; each task writes
segments, and reading needs nothing but these files.

File format. A folder with two Parquet tables, whose rows are committed with their task:

* ``codebook``: (symbol long, length int), the code length of every id that occurs.
* ``segments``: (part int, seg int, n_ids long, doc_ids array<long>, doc_tokens array<long>,
  checkpoints binary, payload binary). Segments are ordered by (part, seg). The payload is one bit
  string, high bit first; ``checkpoints`` holds, as little-endian unsigned 64-bit integers, the bit offset
  of each block of BLOCK ids, so any block decodes by itself.

Decoding looks up as many bits as the longest code has in one table, for all blocks of a segment at once.

Defined results: a null text is an empty one and has only the end id; a row without an id comes first;
rows of equal id follow in the order of a hash of their ids, and of those equal rows are interchangeable; a
very long text is one document of one segment; other columns are not read, whatever their names; an empty
table gives no segments.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import _chunks, byte_bpe
from textloom.llm import _common as C

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Ids in a block: one checkpoint of 8 bytes for each.
BLOCK = 1_024
#: Ids packed at a time, whole blocks, so that what is in hand stays in a core's cache.
RUN = 32 * BLOCK
#: A segment is closed by the document that brings it to so many ids.
SEGMENT_IDS = 1 << 20
#: Ids that a task orders and writes at most (about; a document stays whole).
TASK_IDS = 1 << 26
#: The index of segments is broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
#: Longest code, in bits; more only where the number of different ids asks for it. The table has 2^this rows.
MAX_LENGTH = 18

ENCODED = "doc_id bigint, n_tokens bigint, ids binary, counts boolean"
SEGMENTS = "part int, seg int, n_ids bigint, doc_ids array<bigint>, doc_tokens array<bigint>, checkpoints binary, payload binary"


# --- the code ---------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal prefix code lengths of at most ``limit`` bits for positive ``counts`` (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    row, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(row) // 2 * 2
        both = np.concatenate([leaves, row[0:even:2] + row[1:even:2]])
        by = np.argsort(both, kind="stable")
        row = both[by]
        marks.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for mark in reversed(marks):
        own = int(mark[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical code from symbols and lengths: by length, then symbol, codes count up."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = np.asarray(symbols, np.int64)[by], np.asarray(lengths, np.int64)[by]
        self.longest = int(self.lengths[-1]) if len(by) else 1
        if self.longest > 25:
            raise ValueError("codes of over 25 bits don't fit the decoder's window")
        step = np.left_shift(1, self.longest - self.lengths)
        first = np.cumsum(step) - step
        top = int(self.symbols.max()) + 1 if len(by) else 1
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.symbols] = (first >> (self.longest - self.lengths)).astype(np.uint64)
        self.bits[self.symbols] = self.lengths
        self.table_symbol = np.zeros(1 << self.longest, np.uint32)
        self.table_bits = np.ones(1 << self.longest, np.uint8)
        filled = int(step.sum())
        self.table_symbol[:filled] = np.repeat(self.symbols, step)
        self.table_bits[:filled] = np.repeat(self.lengths, step)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string, and the bit offset of every block."""
        joined, blocks, done = np.zeros(len(ids) * self.longest // 32 + 2, np.uint64), [np.zeros(0, np.int64)], 0
        for start in range(0, len(ids), RUN):
            some = ids[start : start + RUN]
            bits = self.bits[some]
            ends = np.cumsum(bits) + done
            at = ends - bits
            # Each code lies within 64 bits from the 32-bit word it starts in. Those that start in one word are
            # joined, and the low half of each goes to the next word.
            window = self.code[some] << (64 - (at & 31) - bits).astype(np.uint64)
            word = at >> 5
            first = np.flatnonzero(np.diff(word, prepend=-1))
            joined[word[first]] |= np.bitwise_or.reduceat(window, first)
            blocks.append(at[::BLOCK])
            done = int(ends[-1])
        words = (done + 31) // 32
        out = joined[: words + 1] >> np.uint64(32)
        out[1:] |= joined[:words] & np.uint64(0xFFFFFFFF)
        return out[:words].astype(">u4").tobytes(), np.concatenate(blocks).astype("<u8")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n_ids: int) -> np.ndarray:
        """All ids of a segment: step by step through its blocks, all blocks in each step."""
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        view = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((min(BLOCK, n_ids), len(at)), np.uint32)
        last, mask = len(view) - 1, np.uint32((1 << self.longest) - 1)
        for step in range(len(out)):
            bits = view[np.minimum(at >> 3, last)] >> (32 - self.longest - (at & 7)).astype(np.uint32) & mask
            out[step] = self.table_symbol[bits]
            at += self.table_bits[bits]
        return out.T.ravel()[:n_ids] if len(at) < 2 or n_ids % BLOCK == 0 else np.concatenate([out.T[:-1].ravel(), out.T[-1][: n_ids % BLOCK]])


# --- encoding documents -----------------------------------------------------------------------------

#: Cuts that are a word of Latin letters and then ASCII punctuation without apostrophes: the two
#: pre-tokens are plain to see, so they go straight to the library's BPE model.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Rows handled at a time, so that a worker holds little beside its memo.
ROWS = 2_048
#: Characters of plain texts whose words are looked up together; a longer text is a group of its own.
GROUP_CHARS = 1 << 23


def encoder(lib, kind: str) -> Callable[[str], bytes]:
    """Packed ids of one cut with the ``tokenizers`` library."""
    tokenize, alphabet = lib.model.tokenize, byte_bpe.byte_alphabet()
    space, code = alphabet[32], "H" if kind == "<u2" else "I"
    swap = sys.byteorder == "big"

    def packed(ids: list[int]) -> bytes:
        out = array(code, ids)
        if swap:
            out.byteswap()
        return out.tobytes()

    def ids(pre_token: str) -> list[int]:
        mapped = pre_token.replace(" ", space) if pre_token.isascii() else pre_token.encode().decode("latin-1").translate(alphabet)
        return [t.id for t in tokenize(mapped)]

    marks: dict[str, bytes] = {}  # packed ids of short runs of punctuation

    def encode(cut: str) -> bytes:
        if not (m := _PLAIN(cut)):
            return packed(lib.encode(cut, add_special_tokens=False).ids)
        if not (mark := m[2]):
            return packed(ids(m[1]))
        if (after := marks.get(mark)) is None:
            after = packed(ids(mark))
            if len(mark) < 3:
                marks[mark] = after
        return packed(ids(m[1])) + after

    return encode


#: What a text must not hold to be split at its spaces and line ends alone: every other white space
#: character, and two of these two in a row.
_ODD = ("  ", " \n", "\n ", "\n\n", *map(chr, (0x09, 0x0B, 0x0C, 0x0D)))
_ODD_BEYOND = tuple(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: Stands before a text's first word, which has no space before it: in no plain text.
_FIRST = "\r"


class Words(dict):
    """word -> packed ids, of the space or line end before it too; see ``Lines``.

    Most words are letters with a comma or full stop at most, so these go to the BPE model without a
    detour. Two generations, as in ``_chunks.Lookup``.
    """

    def __init__(self, lib, kind: str, older: dict | None = None):
        super().__init__()
        self.lib, self.kind, self.older = lib, kind, older or {}
        self.tokenize, self.encode = lib.model.tokenize, encoder(lib, kind)
        self.alphabet, self.code = byte_bpe.byte_alphabet(), ("H" if kind == "<u2" else "I") if sys.byteorder == "little" else None
        self.space, self.newline = self.alphabet[32], self.encode("\n")
        self.marks = {m: self.encode(m) for m in ".,"}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            if word.isascii() and word.isalpha() and self.code:  # as below: two in three new words
                value = array(self.code, [t.id for t in self.tokenize(self.space + word)]).tobytes()
            else:
                value = self._ids(word)
        if len(word) <= _chunks.MEMO_CHARS:
            self[word] = value
        return value

    def _ids(self, word: str) -> bytes:
        after = self.marks.get(word[-1:])
        bare = word if after is None else word[:-1]
        if not (self.code and bare.isalpha()):
            if word[:1] == _FIRST:
                return self.encode(word[1:])
            return self.newline + self.encode(word[1:]) if word[:1] == "\n" else self.encode(" " + word)
        if after is not None and (known := self.get(bare) or self.older.get(bare)):
            return known + after
        if bare.isascii():
            mapped = self.space + bare
        elif max(bare) < "\u0250":
            mapped = self.space + bare.encode().decode("latin-1").translate(self.alphabet)
        else:
            return self.encode(" " + word)
        ids = array(self.code, [t.id for t in self.tokenize(mapped)]).tobytes()
        return ids if after is None else ids + after

    def successor(self) -> Words:
        self.older = {}
        return Words(self.lib, self.kind, self)


class Lines:
    """Packed ids of texts of words between single spaces and line ends, word by word.

    Each space begins a pre-token with the word after it, and each line end is one. So the ids of a text
    are those of its words, where a word after a line end stands for both. Arrow cuts the texts of a group
    and finds their different words; only these are looked up here, and Arrow lays their ids in a row.
    """

    def __init__(self, lib, kind: str):
        self.memo = Words(lib, kind)

    def __call__(self, text: str) -> bytes | None:
        """None for any other text."""
        return self.many([text])[0] if self.plain(text) else None

    @staticmethod
    def plain(text: str) -> bool:
        if not text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, _ODD)):
            return False
        return text.isascii() or not any(map(text.__contains__, _ODD_BEYOND))

    def many(self, texts: list[str]) -> list[bytes]:
        """Of plain texts, group by group."""
        out: list[bytes] = []
        first = size = 0
        for i, text in enumerate(texts):
            if i > first and size + len(text) > GROUP_CHARS:
                out += self._group(texts[first:i])
                first, size = i, 0
            size += len(text)
        return out + self._group(texts[first:])

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > _chunks.LOOKUP_ENTRIES:
            self.memo = self.memo.successor()
        if len(texts) == 1:
            return [b"".join(map(self.memo.__getitem__, (_FIRST + texts[0].replace("\n", " \n")).split(" ")))]
        cut = pc.split_pattern(pa.array([_FIRST + t.replace("\n", " \n") for t in texts], pa.string()), " ")
        words = cut.values.dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(list(map(self.memo.__getitem__, different)), pa.binary()).take(words.indices)
        _, ends, data = ids.buffers()
        places = np.frombuffer(ends, np.int32)[cut.offsets.to_numpy()].tolist()
        data = data.to_pybytes()
        return [data[a:b] for a, b in zip(places, places[1:])]


def _library(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


class State:
    """What a worker keeps from task to task: the library and the memos."""

    now: State | None = None

    def __init__(self, model: str, kind: str):
        self.of = (model, kind)
        self.lib = _library(model)
        self.memo, self.lines = _chunks.Lookup(encoder(self.lib, kind)), Lines(self.lib, kind)

    @classmethod
    def get(cls, model: str, kind: str) -> State:
        if cls.now is None or cls.now.of != (model, kind):
            cls.now = cls(model, kind)
        return cls.now


def encoded(df: DataFrame, tokenizer_file: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, n_tokens, ids, counts) and the type of the packed ids, the end id included.

    Each task ends with one more row, marked by ``counts``: how often each id occurred in it, as packed
    64-bit pairs. So counting needs no second look at the ids.
    """
    spark = df.sparkSession
    with open(tokenizer_file or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        text = f.read()
    model = spark.sparkContext.broadcast(text)
    kind = "<u2" if max(end_id, *_library(text).get_vocab(True).values()) < 1 << 16 else "<u4"

    @_chunks.collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State.get(model.value, kind)
        lib, lines = state.lib, state.lines
        # The cuts are those of the plain byte-level pre-tokenizer; any other file is used text by text.
        parts = json.loads(model.value)
        by_cut = parts["normalizer"] is None and parts["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        # Strings that the library takes out of a text before it cuts it: such a text is encoded as one.
        whole = [t["content"] for t in parts["added_tokens"]]
        end, total, width = np.array([end_id], kind).tobytes(), np.zeros(0, np.int64), np.dtype(kind).itemsize

        def rows(ids: list, docs: pa.Array, counts: bool) -> pa.RecordBatch:
            columns = [docs, pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([counts] * len(ids))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "counts"])

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                texts = [t.as_py() or "" for t in some.column(1)]
                out = [b""] * len(texts)
                plain = []
                for i, t in enumerate(texts):
                    if not by_cut or any(w in t for w in whole):
                        out[i] = np.array(lib.encode(t, add_special_tokens=False).ids, kind).tobytes() + end
                    elif lines.plain(t):
                        plain.append(i)
                    else:
                        out[i] = b"".join(map(state.memo.__getitem__, _chunks.cuts(t))) + end
                if plain:
                    for i, ids in zip(plain, lines.many([texts[i] for i in plain]), strict=True):
                        out[i] = ids + end
                if state.memo.full():
                    state.memo = state.memo.successor()
                got = np.bincount(np.frombuffer(b"".join(out), kind), minlength=len(total))
                got[: len(total)] += total
                total = got
                yield rows(out, some.column(0), False)
        used = np.flatnonzero(total)
        yield rows([np.stack([used, total[used]], 1).astype("<i8").tobytes()], pa.array([None], pa.int64()), True)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED), kind


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            pairs = np.frombuffer(data.as_py(), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["symbol", "n"])


def write_files(df: DataFrame, path: str | None = None, tokenizer_file: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LENGTH) -> str:
    """Encode and write; returns the folder. Only the counts by id, as many as the vocabulary has, reach the driver."""
    spark = df.sparkSession
    path = path or C.fresh_path(spark, "tokens")
    rows, kind = encoded(df, tokenizer_file, end_id, id_col, text_col)
    between = C.fresh_path(spark, "ids")
    rows = C.written(rows, "ids", path=between)
    counts = rows.where("counts").select("ids").mapInArrow(_counted, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    symbols, n = counts.symbol.to_numpy(np.int64), counts.n.to_numpy(np.int64)
    lengths = code_lengths(n, limit)
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist(), strict=True)), "symbol bigint, length int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((symbols.tolist(), lengths.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seg = Codebook(*map(np.array, book.value)), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            payload, checkpoints = code.encode(np.concatenate(held))
            row = {"part": part, "seg": seg, "n_ids": size, "doc_ids": list(docs), "doc_tokens": [len(x) for x in held], "checkpoints": checkpoints.tobytes(), "payload": payload}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            for doc, data in zip(*batch.columns[:2], strict=True):
                docs.append(doc.as_py())
                held.append(np.frombuffer(data.as_py(), kind).astype(np.int64))
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    yield segment()
                    docs, held, size, seg = [], [], 0, seg + 1
        if docs:
            yield segment()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n.sum()) // TASK_IDS))
    ordered = rows.where("NOT counts").withColumn("tie", F.xxhash64("ids")).repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "ids").mapInArrow(run, SEGMENTS).write.parquet(f"{path}/segments")
    C.delete(spark, between)
    return path


def read_files(spark: SparkSession, path: str, want: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(doc_id, start, n_tokens, and of ``want``: ids array<long>, ids_crc32 long), from the files alone.

    ``start`` is the number of ids in all documents before the row's: sums over the tasks' totals, then
    over the segments of one task, neither in a single task per id.
    """
    book = spark.sparkContext.broadcast([tuple(r) for r in spark.read.parquet(f"{path}/codebook").collect()])
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    sizes = segments.select("part", "seg", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "seg", (F.col("part_start") + F.col("in_part")).alias("start"))
    kinds = {"ids": (pa.list_(pa.int64()), "array<bigint>"), "ids_crc32": (pa.int64(), "bigint")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codebook(*(np.array([r[i] for r in book.value], np.int64) for i in (0, 1)))
        for batch in batches:
            for row in batch.to_pylist():
                ids = code.decode(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), row["n_ids"]).astype("<u4")
                tokens = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(tokens)
                each = np.split(ids, ends[:-1])
                got = {"ids": lambda each=each: each, "ids_crc32": lambda each=each: [zlib.crc32(x.tobytes()) for x in each]}
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - tokens, pa.int64()), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(got[w](), kinds[w][0]) for w in want)], names=["doc_id", "start", "n_tokens", *want])

    schema = ", ".join(["doc_id bigint, start bigint, n_tokens bigint", *(f"{w} {kinds[w][1]}" for w in want)])
    # A row of the index is some 30 bytes for a segment of a MB; beyond the bound the segments are shuffled.
    if sizes.count() * 32 <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    return segments.join(starts, ["part", "seg"]).mapInArrow(run, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(spark, write_files(C.table(spark, sf_dir, "documents")), ("ids_crc32",))


QUERIES = {"op8_token_files": op8_token_files}
