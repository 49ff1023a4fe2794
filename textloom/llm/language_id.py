"""Language identification with bit-sliced Bloom filters over character n-grams.

Learning. From a bounded sample of labelled texts (about SAMPLE per language, taken by a hash of the id;
counts per language cover all labelled rows), count in how many texts of each language an n-gram occurs.
A language contains an n-gram if at least RATE of its texts have it, and at least SHARE of the rate in
the language where it is most common. One filter per language would be asked with the same positions,
so they are sliced by bit: a slot holds a mask with one bit per language, and the AND of an n-gram's
slots gives all languages that contain it, in one look.

Deciding. Over all n-grams of the whole text, count the set bits of each language. Of N n-grams, a filter
with false-positive rate f returns about f N without containing them; the corrected count is
(hits - f N) / (1 - f). The largest decides; ties go to the language with more labelled rows, then by
name. The score is the winner's share of all corrected counts.

N-grams of 2 to 4 characters are taken within lower-cased words (runs of letters), with their ends marked.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing was
learned; a text whose n-grams are all unknown gets the most common language with score 0. Repeated rows
count each when learning and are decided alike; a row without an id is decided like any other, and is drawn
for the sample with all rows without one; an empty table gives filters of no language and an empty result;
the new columns get underscores in front where the names are taken, whatever columns there are. Texts are
decided whole, GROUP_CHARS or one text at a time. There may be any number of languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import _common as C

#: Labelled texts per language to learn from.
SAMPLE = 1_000
SIZES = (2, 3, 4)
RATE, SHARE = 0.01, 0.3
#: Slots of the filter (a power of two) and positions per n-gram.
SLOT_BITS, HASHES = 20, 3
#: Languages in one word of a mask.
WORD = 64
UNKNOWN = "und"
#: Characters handled at a time.
GROUP_CHARS = 1 << 18
#: The sample is spread over so many tasks.
LEARN_TASKS = 8

_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x33480)])


def grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: where the n-grams start in ``text`` (lower-cased), and their 64-bit hashes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[np.minimum(codes, len(_LETTER) - 1)]
    # A mark before the first character and after the last; whatever is no letter is a mark too.
    marked = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    inside = marked > 0
    rolled = marked.copy()
    for n in range(2, max(SIZES) + 1):
        if len(marked) < n:
            return
        rolled = rolled[: len(marked) - n + 1] * np.uint64(0x100000001B3) + marked[n - 1 :]
        # All between the ends are letters; of two characters one at least is.
        fits = inside[: len(rolled)] | inside[1:] if n == 2 else inside[1 : 1 + len(rolled)]
        for i in range(2, n - 1):
            fits = fits & inside[i : i + len(rolled)]
        at = np.flatnonzero(fits)
        if n in SIZES:
            h = (rolled[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield at, h ^ (h >> np.uint64(29))


class Filters:
    """Bit-sliced Bloom filters of any number of languages, and their decision.

    A slot's mask is one word of the least width that holds all languages, or several words of WORD bits,
    kept in planes: plane p has the languages from p * WORD on.
    """

    def __init__(self, languages: list[str]):
        self.languages = languages
        first = min(len(languages), WORD)
        self.kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if first <= np.dtype(k).itemsize * 8)
        self.planes = [np.zeros(1 << SLOT_BITS, self.kind) for _ in range(max(1, -(-len(languages) // WORD)))]
        self.wrong = np.zeros(len(languages))

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [(hashes >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1) for i in range(HASHES)]

    def add(self, hashes: np.ndarray, language: int) -> None:
        slots, at = self.planes[language // WORD], self.kind(language % WORD)
        for place in self.places(hashes):
            slots[place] |= self.kind(1) << at  # duplicates in place do no harm: OR is idempotent
        bit = (slots >> at) & self.kind(1)
        self.wrong[language] = (int(bit.sum()) / len(slots)) ** HASHES

    def containing(self, hashes: np.ndarray, plane: int = 0) -> np.ndarray:
        """Masks of the plane's languages that contain each n-gram."""
        out = np.full(len(hashes), np.iinfo(self.kind).max, self.kind)
        for place in self.places(hashes):
            out &= self.planes[plane][place]
        return out

    def corrected(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected counts, and whether each text has a letter."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        lower = [t.lower() for t in texts]
        starts = np.cumsum([0, *(len(t) + 1 for t in lower)])
        for at, hashes in grams("\n".join(lower)):
            text = np.searchsorted(starts, at, "right") - 1  # an end mark before a text counts as its own
            text = np.minimum(text, len(texts) - 1)
            total += np.bincount(text, minlength=len(texts))
            for p in range(len(self.planes)):
                masks = self.containing(hashes, p)
                for i in range(p * WORD, min(len(self.languages), (p + 1) * WORD)):
                    hits[:, i] += np.bincount(text, (masks >> self.kind(i - p * WORD)) & self.kind(1), len(texts))
        return np.maximum(0, (hits - self.wrong * total[:, None]) / (1 - self.wrong)), total > 0

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        counts, lettered = self.corrected(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        best, whole = counts.argmax(1), counts.sum(1)
        share = np.divide(counts.max(1), whole, out=np.zeros(len(texts)), where=whole > 0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0).tolist()


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters from the labelled rows. To the driver come the counts per language and the n-grams above RATE."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    filters = Filters(languages)
    if not languages:
        return filters
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(sample / counts[lang]))))
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        docs = np.zeros(len(languages), np.int64)
        for batch in batches:
            for text, lang in zip(*batch.columns, strict=True):
                i = number[lang.as_py()]
                docs[i] += 1
                all_ = [h for _, h in grams(text.as_py().lower())]
                found.setdefault(i, []).append(np.unique(np.concatenate(all_)) if all_ else np.zeros(0, np.uint64))
        for i, each in found.items():
            gram, n = np.unique(np.concatenate(each), return_counts=True)
            # The row with no n-gram holds the number of texts.
            yield pa.RecordBatch.from_arrays([pa.array([i] * (len(gram) + 1), pa.int32()), pa.array([None, *gram.view(np.int64).tolist()], pa.int64()), pa.array([int(docs[i]), *n.tolist()], pa.int64())], names=["lang", "gram", "n"])

    drawn = rows.where(draw < share[F.col("lang")]).select("text", "lang").repartition(LEARN_TASKS)
    table = drawn.mapInArrow(run, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = C.written(table, "grams")
    docs = {r["lang"]: r["n"] for r in table.where("gram IS NULL").collect()}
    least = F.create_map(*(x for i, n in docs.items() for x in (F.lit(i), F.lit(max(2.0, RATE * n))))) if docs else F.lit(None)
    common = table.where(F.col("gram").isNotNull() & (F.col("n") >= least[F.col("lang")])).toPandas() if docs else None
    if common is None or not len(common):
        return filters
    common["rate"] = common.n / common.lang.map(docs)
    kept = common[common.rate >= SHARE * common.groupby("gram").rate.transform("max")]
    for i, part in kept.groupby("lang"):
        filters.add(np.sort(part.gram.to_numpy(np.int64)).view(np.uint64), int(i))
    return filters


def predict(df: DataFrame, filters: Filters, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``df`` with the predicted language and its score; returns it and the names of both columns."""
    lang, score = C.free_name(df.columns, "lang_pred"), C.free_name(df.columns, "score")
    sent = df.sparkSession.sparkContext.broadcast(filters)  # 2^SLOT_BITS masks
    rows, place = C.sent_once(df, text_col, df.columns, [lang, score])
    kept = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            held: list[str] = []
            size = 0
            for text in batch.column(place):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= GROUP_CHARS:
                    for out, got in zip((names, scores), sent.value.decide(held), strict=True):
                        out.extend(got)
                    held, size = [], 0
            if held:
                for out, got in zip((names, scores), sent.value.decide(held), strict=True):
                    out.extend(got)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:kept], lang, score])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{lang}` string", f"`{score}` double"])
    return rows.mapInArrow(run, schema), lang, score


def remainder(id_col: str, by: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    filters = learn(docs.where(remainder("doc_id", 5) != 0))
    out, lang, score = predict(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


QUERIES = {"op4_language_id": op4_language_id}
