"""Benchmark passages inside documents, allowing for a few edits: pigeonhole filter, Myers verification.

Documents and test items are compared after lower-casing and turning every run of other characters than
letters and digits into one space. An item of n characters may be off by floor(ERRORS n) edits. It is cut
into one piece more than that, so at least one piece survives unchanged in every occurrence within the
budget (pigeonhole). One Aho-Corasick pass over a document finds all pieces of all items; around each
hit, where the item would have to lie, Myers' bit-parallel algorithm computes the least edit distance
between the item and any stretch. Windows of one item that overlap are merged first, so a phrase that
repeats ten thousand times is looked at once.

Items are held in blocks of at most BLOCK_CHARS characters, one pass over the documents for each; that is
what is collected and broadcast at a time, however many items there are. Nothing is shuffled.

An item of fewer than LEAST characters matches where it stands unchanged between word bounds.

Defined results: a null or empty item matches nothing; a null or empty
text holds nothing; of items with one id each counts, items of equal text each report their own id, and
equal distances stay as they are (nothing is ranked); repeated rows are searched one by one; very long
texts are searched whole, in time near linear; an empty table gives an empty result; columns of the input
stay, and the new one gets an underscore in front where its name is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import _common as C

#: Edits per character of an item.
ERRORS = 0.06
#: Characters an item must have to be off by edits; shorter ones match exactly.
LEAST = 24
#: Characters of items in one pass.
BLOCK_CHARS = 4 << 20

FOUND = "array<struct<item_id:bigint,distance:int>>"
_OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


class Pattern:
    """One item: its bit masks by character."""

    def __init__(self, text: str):
        self.size = len(text)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """Least edit distance between the item and any stretch of ``text`` (Myers 1999, with free ends)."""
        every, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score, best = every, 0, self.size, self.size
        get = self.masks.get
        for c in text:
            same = get(c, 0)
            vertical = same | down
            across = ((same & up) + up ^ up) | same
            more, less = down | every & ~(across | up), up & across
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score < best:
                    best = score
            more, less = more << 1 & every, less << 1 & every
            up, down = less | every & ~(vertical | more), more & vertical
        return best


class Items:
    """The pieces of a block of items in one automaton."""

    def __init__(self, rows: list[tuple[int, str]], errors: float = ERRORS, least: int = LEAST):
        self.items = []  # (id, pattern, budget)
        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            short = len(text) < least
            budget = 0 if short else int(len(text) * errors)
            for p in range(budget + 1):
                first, end = p * len(text) // (budget + 1), (p + 1) * len(text) // (budget + 1)
                places.setdefault(text[first:end], []).append((len(self.items), first))
            self.items.append((item, Pattern(text), budget, short))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item id, least distance) of the items that occur in a plain text within their budgets."""
        if not self.items or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                _, pattern, budget, short = self.items[number]
                first = last + 1 - size - offset
                if short and (first and text[first - 1] != " " or text[last + 1 : last + 2] not in ("", " ")):
                    continue
                first, end = max(0, first - budget), first + pattern.size + budget
                own = windows.setdefault(number, [])
                # Hits come in the order of their ends, and an item's windows nearly in the order of their starts.
                if own and first <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(first, own[-1][0]), max(end, own[-1][1])
                else:
                    own.append([first, end])
        out = []
        for number, own in sorted(windows.items()):
            item, pattern, budget, _ = self.items[number]
            best = min(pattern.distance(text[first:end]) for first, end in own)
            if best <= budget:
                out.append((item, best))
        return out


def find_items(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", errors: float = ERRORS, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, str]:
    """``df`` with the items found in each text, as an array by item; returns it and the column's name."""
    spark = df.sparkSession

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain(t.as_py()) for t in batch.column(1)], pa.string())], names=["item_id", "item"])

    clean = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item")).mapInArrow(normalised, "item_id bigint, item string")
    clean = C.written(clean.where("item <> ''"), "items")
    name = C.free_name(df.columns, "items")
    blocks = max(1, -(-(clean.agg(F.sum(F.length("item"))).first()[0] or 0) // block_chars))
    out = df.withColumn(name, F.expr(f"CAST(array() AS {FOUND})"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    for k in range(blocks):
        rows = [(r["item_id"], r["item"]) for r in clean.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()]
        sent = spark.sparkContext.broadcast(rows)
        docs, place = C.sent_once(out, text_col, out.columns, [])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, place=place) -> Iterator[pa.RecordBatch]:
            block = Items(sent.value, errors, least)
            for batch in batches:
                found = [block.find(plain(t.as_py())) for t in batch.column(place)]
                old = batch.column(batch.schema.get_field_index(name)).to_pylist()
                new = [o + [{"item_id": i, "distance": d} for i, d in f] for o, f in zip(old, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(new, kind)], names=[*batch.schema.names[: len(kept)], name])

        out = docs.mapInArrow(run, ", ".join([*kept, f"`{name}` {FOUND}"]))
    return out, name


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that it holds."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = find_items(docs, C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode(name).alias("hit")).select("doc_id", "hit.item_id", "hit.distance")


QUERIES = {"op6_decontaminate": op6_decontaminate}
