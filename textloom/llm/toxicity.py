"""Toxicity by gradient-boosted trees over a few dense features, with isotonic calibration.

Learning uses about SAMPLE labelled texts of each class (drawn by a hash of the id; class counts, which
weigh the draws, cover all labelled rows). Words and word beginnings that toxic texts of the sample have
far more often than others become the lexicon. The features: densities of lexicon words and beginnings
(as written, and after undoing common letter replacements), nearness of hits to a second-person word,
shares of capitals, shouted words, punctuation, obfuscated and stretched words, and length. Trees are
fitted to four fifths of the sample; the rest maps their sums to probabilities (isotonic regression).

A text's features are sums over its words, whatever its length; a worker keeps what it found for a word.

Defined results: null and empty texts have all features 0 and get the score the model gives those; with
no label of one class, or none at all, every text gets the share of toxic labels (0 without any). An id
with contradicting labels counts as toxic; labels or rows without an id teach nothing, but such rows are
scored; repeated rows are scored alike; an empty table gives an empty result; columns of the input stay,
and the score gets an underscore in front where its name is taken. Texts are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import _chunks
from textloom.llm import _common as C
from textloom.llm.language_id import remainder
from textloom.llm.near_dedup import shingles

#: Labelled texts of each class to learn from.
SAMPLE = 5_000
#: Toxic texts of the sample that must have a term, its least log-odds, and its least likelihood ratio
#: (2 log) against being spread as all texts are.
TERM_TEXTS, TERM_ODDS, TERM_RATIO = 5, 2.5, 24.0
#: Lengths of word beginnings.
STEMS = (4, 5, 6, 7, 8, 9)
#: Words between a hit and a second-person word that count as near.
NEAR = 5
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, RIDGE = 60, 3, 0.2, 32, 1.0
LEARN_TASKS = 8

# Second-person words, and characters written for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi", "*#%&.-_+~^")

FEATURES = ("words", "lexicon", "stems", "undone", "near", "second", "capitals", "shouted", "punctuation", "marks", "obfuscated", "stretched")
_LANES = ("lexicon", "stems", "undone", "second", "upper", "letters", "shouted", "punctuation", "marks", "obfuscated", "stretched")
_LANE = 40  # bits: sums over a text of any length that fits in memory
_PIECES = re.compile(r"[^\W\d_]+").findall
_OBFUSCATED = re.compile(r"[^\W\d_](?:[^\w\s'’.,;:/()-]+|[0-9]+)[^\W\d_]").search
_STRETCHED = re.compile(r"([^\W\d_])\1\1").search


def terms(text: str) -> set[str]:
    """Words and word beginnings (marked) of a text."""
    words = set(_PIECES(text.lower()))
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) >= n}


class Features:
    """Feature vectors of texts under a lexicon."""

    def __init__(self, lexicon: frozenset[str]):
        self.words = frozenset(t for t in lexicon if not t.endswith("-"))
        self.stems = frozenset(t[:-1] for t in lexicon if t.endswith("-"))
        self.memo = _chunks.Lookup(self._word)
        self.hit = sum(((1 << _LANE) - 1) << _LANES.index(x) * _LANE for x in ("lexicon", "stems", "undone"))
        self.second = ((1 << _LANE) - 1) << _LANES.index("second") * _LANE

    def _toxic(self, piece: str) -> tuple[bool, bool]:
        return piece in self.words, any(piece[:n] in self.stems for n in STEMS if len(piece) >= n)

    def _word(self, word: str) -> int:
        """What a word adds to each lane."""
        lower = word.lower()
        pieces = _PIECES(lower)
        found = [self._toxic(p) for p in pieces]
        lexicon, stems = sum(a for a, _ in found), sum(b for _, b in found)
        obfuscated = _OBFUSCATED(word) is not None
        undone = obfuscated and not (lexicon or stems) and any(map(any, map(self._toxic, _PIECES(lower.translate(LEET)))))
        letters = sum(map(len, pieces))
        values = {
            "lexicon": lexicon,
            "stems": stems,
            "undone": undone,
            "second": sum(p in SECOND_PERSON for p in pieces),
            "upper": sum(map(str.isupper, word)),
            "letters": letters,
            "shouted": letters > 1 and word.isupper(),
            "punctuation": len(word) - sum(map(str.isalnum, word)),
            "marks": word.count("!") + word.count("?"),
            "obfuscated": obfuscated,
            "stretched": _STRETCHED(lower) is not None,
        }
        return sum(int(values[x]) << i * _LANE for i, x in enumerate(_LANES))

    def of(self, text: str) -> list[float]:
        words = text.split()
        if not words:
            return [0.0] * len(FEATURES)
        values = list(map(self.memo.__getitem__, words))
        total = sum(values)
        lanes = {x: total >> i * _LANE & (1 << _LANE) - 1 for i, x in enumerate(_LANES)}
        near = 0
        if total & self.hit and total & self.second:
            hits = np.array([i for i, v in enumerate(values) if v & self.hit])
            second = np.array([i for i, v in enumerate(values) if v & self.second])
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(hits - second[np.minimum(at, len(second) - 1)]), np.abs(hits - second[np.maximum(at - 1, 0)]))
            near = float((gap <= NEAR).mean())
        if self.memo.full():
            self.memo = self.memo.successor()
        n, letters, chars = len(words), max(1, lanes["letters"]), max(1, lanes["letters"] + lanes["punctuation"])
        per = lambda x: lanes[x] / n
        return [np.log1p(n), per("lexicon"), per("stems"), per("undone"), near, per("second"), lanes["upper"] / letters, per("shouted"), lanes["punctuation"] / chars, per("marks"), per("obfuscated"), per("stretched")]


class Trees:
    """Boosted trees for a logistic loss: histogram splits, DEPTH levels each, Newton leaves."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.base = float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight))))
        # Cuts lie between values that occur; values that many rows share get their own bin.
        self.cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(self.cuts, x.T, strict=True)], 1)
        inner = (1 << DEPTH) - 1
        self.feature = np.zeros((TREES, inner), np.int64)
        self.cut = np.full((TREES, inner), np.inf)
        self.leaf = np.zeros((TREES, 1 << DEPTH))
        score = np.full(len(y), self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                width, offset = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-9)
                choice = [(0, None)] * width
                for f, cut in enumerate(self.cuts):
                    size = len(cut) + 1
                    key = node * size + bins[:, f]
                    g = np.bincount(key, grad, width * size).reshape(width, size).cumsum(1)
                    h = np.bincount(key, hess, width * size).reshape(width, size).cumsum(1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                    for k in range(width):
                        if len(cut) and (top := int(gain[k, :-1].argmax())) >= 0 and gain[k, top] > best[k]:
                            best[k], choice[k] = gain[k, top], (f, top)
                for k, (f, top) in enumerate(choice):
                    if top is not None:
                        self.feature[t, offset + k], self.cut[t, offset + k] = f, self.cuts[f][top]
                node = 2 * node + (x[np.arange(len(x)), self.feature[t, offset + node]] > self.cut[t, offset + node])
            self.leaf[t] = RATE * np.bincount(node, grad, 1 << DEPTH) / (np.bincount(node, hess, 1 << DEPTH) + RIDGE)
            score += self.leaf[t, node]
        return self

    def sums(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t, node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing fit of y to x (pool adjacent violators)."""
    by = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for i in by:
        blocks.append([float(y[i]), float(weight[i]), float(x[i]), float(x[i])])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return np.array([v for b in blocks for v in b[2:]]), np.array([v for b in blocks for v in (b[0], b[0])])


class Model:
    def __init__(self, share: float, lexicon: frozenset[str] = frozenset(), trees: Trees | None = None, knots: tuple | None = None):
        self.share, self.lexicon, self.trees, self.knots = share, lexicon, trees, knots

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.sums(x), *self.knots), 0, 1)


def _vectors(column: pa.Array, features: Features) -> np.ndarray:
    return np.array([features.of(t.as_py() or "") for t in column]).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """To the driver come class counts, terms that pass TERM_TEXTS (each text has a bounded share of them), and the sample's feature vectors."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(float(1 in counts))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, sample / counts[1]).otherwise(sample / counts[0])
    drawn = F.broadcast(C.written(marked.where(draw < share), "drawn"))  # about twice SAMPLE rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(drawn, "id")
    # Copies would make chance words look telling: of texts with one least shingle hash, one stays.
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(x.min() >> np.uint64(1)) if len(x := shingles(t.as_py())) else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "least"])

    texts = texts.mapInArrow(signed, "id bigint, text string, y int, least bigint")
    texts = texts.groupBy("least", "y").agg(F.min_by(F.struct("id", "text"), "id").alias("one")).select("one.id", "one.text", "y")
    texts = C.written(texts.repartition(LEARN_TASKS), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                for t in terms(text.as_py() or ""):
                    found.setdefault(t, [0, 0])[y.as_py()] += 1
        # Terms of a single text add nothing that could pass unless other tasks have them too, so all go on.
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[y] for v in found.values()], pa.int64()) for y in (0, 1))], names=["term", "clean", "toxic"])

    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model(counts[1] / sum(counts.values()))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    toxic, clean, share_toxic = F.col("toxic"), F.col("clean"), n[1] / (n[0] + n[1])
    part = lambda k, share: k * F.log((k + 1e-9) / ((toxic + clean) * share))
    ratio = 2 * (part(toxic, share_toxic) + part(clean, 1 - share_toxic))
    counted = texts.select("text", "y").mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lexicon = frozenset(r["term"] for r in counted.where((toxic >= TERM_TEXTS) & (odds >= TERM_ODDS) & (ratio >= TERM_RATIO)).select("term").collect())
    sent = spark.sparkContext.broadcast(lexicon)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(sent.value)
        for batch in batches:
            x = _vectors(batch.column(1), features)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = texts.mapInArrow(vectors, "id bigint, y int, x array<double>").orderBy("id").toPandas()
    x, y = np.array(rows.x.tolist()), rows.y.to_numpy(np.float64)
    weight = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])
    weight /= weight.mean()
    last = (np.arange(len(y)) % 5) == 4
    if len(np.unique(y[~last])) < 2 or not last.any():
        last[:] = False
    trees = Trees().fit(x[~last], y[~last], weight[~last])
    held = last if len(np.unique(y[last])) > 1 else np.ones(len(y), bool)
    return Model(counts[1] / sum(counts.values()), lexicon, trees, isotonic(trees.sums(x[held]), y[held], weight[held]))


def score(df: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with the probability that a label would say toxic; returns it and the column's name."""
    name = C.free_name(df.columns, "score")
    sent = df.sparkSession.sparkContext.broadcast(model)

    @_chunks.collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(sent.value.lexicon)
        for batch in batches:
            x = _vectors(batch.column(len(batch.schema) - 1), features)
            kept = list(zip(batch.schema.names, batch.columns, strict=True))[:-1]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(sent.value.scores(x), pa.float64())], names=[*(n for n, _ in kept), name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` double"])
    return df.withColumn(C.free_name([*df.columns, name], "text_"), F.col(text_col)).mapInArrow(run, schema), name


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, C.table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    out, name = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
