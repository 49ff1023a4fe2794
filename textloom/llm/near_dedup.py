"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

1. Sketch. A text's distinct word shingles are hashed to 64 bits. Each of BUCKETS buckets has its own
   hash of them and keeps the least value, compressed to its leading-zero count and MANTISSA bits after
   the leading one: 16 bits instead of 32 or 64.
2. Classes. Texts with equal sets (by 128 bits of them) are one class from here on, with a number of its
   own; what follows costs nothing per copy.
3. Banding. ROWS consecutive registers make a key. Classes that share no key are not compared: for a pair
   at the threshold of 0.8 that happens once in 10^9.
4. Stars. In each group of a shared key, all are compared with one leader, the class that meets most
   others, so a group of n makes n - 1 pairs. Sizes, then the Jaccard similarity estimated from the
   registers (corrected for chance collisions, MARGIN below the threshold, 5.6 standard deviations) sort
   out most pairs; the rest is confirmed on the full sets.
5. The rest of a group. Only where a group still falls into several components can another link matter.
   These groups are dealt in blocks of at most CHUNK by CHUNK members, and all pairs of different
   components in a block are compared in place; a pair is taken in the first group that it shares.
   Only links leave a block. No pair is dropped or capped. Such a group of n costs n^2 / 2 estimates.
6. Components of the links, by least labels with pointer jumping over written tables.

Leaders, centres of components and large classes have many rows to join with: these joins deal a hot key's
rows over many tasks (``even_join``). Tables written on the way are deleted when the result is written.

Defined results: texts without words (null, empty, white space) have no shingles and link with nothing;
fewer than SHINGLE words are one shingle; a row without an id gets no component and is kept; repeated
rows are copies of each other, and each of them is returned; texts of one id are told apart by their sets;
equal similarities need no order, as all links count; very long texts are whole sets; other columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import _common as C

SHINGLE = 4
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bands of ROWS registers.
ROWS, BANDS = 5, 53
BUCKETS = ROWS * BANDS
MANTISSA = 10
#: Estimates have a standard deviation of 0.025 at the threshold.
MARGIN = 0.14
#: Members on either side of a block.
CHUNK = 384
#: Ids and keys are broadcast up to so many bytes, and joined by shuffling beyond.
BROADCAST_BYTES = 32 << 20

SKETCH = "doc_id bigint, n_shingles bigint, set binary, regs binary"


# --- sketches ---------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20_260))
_FACTORS = (_rng.integers(0, 1 << 31, BUCKETS, np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, BUCKETS, np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are split at ASCII white space and A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=size)], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, out = len(words) - size + 1, np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):  # order matters: each word is mixed into what stands before it
        out = _mixed(out + hashes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out)


def set_name(found: bytes) -> bytes:
    """128 bits of a set: texts with equal names have equal sets (10^10 sets: a false pair in 10^18)."""
    return xxhash.xxh3_128_digest(found)


def least_values(found: np.ndarray) -> np.ndarray:
    """The least hash of each bucket."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BUCKETS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return least


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros of 32 bits above the MANTISSA bits that follow the leading one."""
    fraction, bits = np.frexp(least.astype(np.float64))
    mantissa = np.where(least > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0)
    return ((32 - bits).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def sketches(df: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                sets = [shingles(t.as_py(), size) for t in some.column(1)]
                regs = [compressed(least_values(s)).tobytes() if len(s) else None for s in sets]
                named = [set_name(s.tobytes()) if len(s) else None for s in sets]
                columns = [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(named, pa.binary()), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set", "regs"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SKETCH)


# --- similarity -------------------------------------------------------------------------------------


def chance_table() -> np.ndarray:
    """P(two registers are equal though their least values differ), by the log2 of the set size."""
    edges = np.concatenate([[0.0], *((2.0 ** -(z + 1)) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for z in range(31, -1, -1)), [1.0]])
    out = []
    for log in range(33):
        beyond = np.exp(2.0**log * np.log1p(-np.minimum(edges, 1 - 1e-16)))
        out.append(float((np.diff(-beyond) ** 2).sum()))
    return np.array(out)


_CHANCE = chance_table()


def estimate(equal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without chance collisions."""
    chance = _CHANCE[np.minimum(32, np.log2(np.maximum(sizes, 1)).astype(int))]
    return (equal - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _maybe(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b, regs_a, regs_b) whose sizes and registers allow a link, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BUCKETS) for c in (3, 4)]
            keep = estimate((regs[0] == regs[1]).mean(1), batch.column(2).to_numpy()) >= percent / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    sized = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.select("a", "b", F.greatest("n_a", "n_b"), "regs_a", "regs_b").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose full sets are linked, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, right = None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                if (b := b.as_py()) != before:  # the join leaves rows of one b together
                    before, right = b, shingles(y.as_py(), size)
                keep.append(linked(shingles(x.as_py(), size), right, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


# --- blocks -----------------------------------------------------------------------------------------


def _band_keys(regs: np.ndarray) -> np.ndarray:
    """(members, BANDS) numbers, equal where the bands are."""
    bands = np.ascontiguousarray(regs.reshape(-1, BANDS, ROWS)).view(f"V{2 * ROWS}")[:, :, 0]
    return np.stack([np.unique(bands[:, i], return_inverse=True)[1] for i in range(BANDS)], 1).astype(np.int32)


class Sets:
    """The sets of texts, each made when it is first asked for."""

    def __init__(self, texts: pa.ChunkedArray, size: int):
        self.texts, self.size, self.made = texts, size, {}

    def __getitem__(self, i: int) -> np.ndarray:
        if (found := self.made.get(i)) is None:
            found = self.made[i] = shingles(self.texts[int(i)].as_py(), self.size)
        return found


def block_links(cls: np.ndarray, label: np.ndarray, n: np.ndarray, regs: np.ndarray, sets: Sets | list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int, percent: int) -> list[tuple[int, int]]:
    """Links between members ``left`` and ``right`` (indices) of different components; pairs that share an
    earlier band are left to that one."""
    keys, out, parent = _band_keys(regs), [], {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    same = np.array_equal(left, right)
    for k, i in enumerate(left):
        js = right[k + 1 :] if same else right
        js = js[(label[js] != label[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
        if band:
            js = js[~(keys[js, :band] == keys[i, :band]).any(1)]
        if not len(js):
            continue
        js = js[estimate((regs[js] == regs[i]).mean(1), np.maximum(n[js], n[i])) >= percent / 100 - MARGIN]
        for j in js:
            if (a := root(label[i])) != (b := root(label[j])) and linked(sets[i], sets[j], percent):
                parent[a] = b
                out.append((int(cls[i]), int(cls[j])))
    return out


def _block(table: pa.Table, size: int, percent: int) -> pa.Table:
    cls, label, n, chunk = (table[c].to_numpy() for c in ("cls", "label", "n_shingles", "chunk"))
    regs = np.frombuffer(b"".join(table["regs"].to_pylist()), "<u2").reshape(-1, BUCKETS)
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    links = block_links(cls, label, n, regs, Sets(table["text"], size), left, right, table["band"][0].as_py(), percent)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


# --- components -------------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: C.Scratch | None = None) -> DataFrame:
    """(node, label) with the least node of each component, for the nodes of the edges (a, b)."""
    scratch = scratch or C.Scratch(edges.sparkSession)
    both = scratch.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    centres = C.hot_keys(both, "b")
    labels = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    total = lambda: labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    now = total()
    while True:
        met = C.even_join(both, labels.withColumnRenamed("node", "b"), "b", "a", hot=centres)
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        less = scratch.written(labels.join(near, "node").select("node", F.least("label", "other").alias("label")), "labels")
        up = less.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = scratch.written(C.even_join(less, up, "label", "node").select("node", F.col("top").alias("label")), "labels")
        before, now = now, total()  # labels only ever fall
        if now == before:
            return labels


def _small(df: DataFrame) -> DataFrame:
    """For a join: broadcast if its rows, counted, stay below the bound (with what a hash table adds to them)."""
    return F.broadcast(df) if df.count() * 96 <= BROADCAST_BYTES else df


def near_duplicates(df: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (the least doc_id that links reach), kept."""
    scratch = C.Scratch(df.sparkSession)
    docs = scratch.written(sketches(df, size, id_col, text_col), "sketches", packed=True)
    sets_ = docs.where("`set` IS NOT NULL AND doc_id IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = scratch.written(sets_.withColumn("cls", F.monotonically_increasing_id()), "classes", packed=True)

    # A key's last six bits are its band's number.
    keys = F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {2 * ROWS} + 1, {2 * ROWS})) & -64L | i)"))
    bands = classes.select("cls", keys.alias("key"))
    shared = scratch.written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "keys")

    def large(rows: int) -> list[tuple]:
        """Keys with more than their share of so many rows."""
        most = max(C.FEW_ROWS, rows // C.HOT_KEYS)
        return [(r["key"], -(-r["size"] // most)) for r in shared.where(F.col("size") > most).collect()]

    members = scratch.written(C.even_join(bands, shared, "key", "cls", hot=large(classes.count() * BANDS)), "members")
    known = scratch.written(classes.join(_small(members.select("cls").distinct()), "cls", "left_semi"), "candidates", packed=True)

    # Leaders: the member that meets most others, in all its groups.
    ranks = members.groupBy("cls").agg(F.sum("size").alias("met"))
    ranked = members.join(ranks, "cls")
    leaders = scratch.written(ranked.groupBy("key").agg(F.max(F.struct("met", "cls")).alias("top")).select("key", F.col("top.cls").alias("leader")), "leaders")
    led = C.even_join(members, leaders, "key", "cls", hot=large(members.count())).where("cls <> leader")
    stars = scratch.written(led.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct(), "stars")
    side = lambda s: known.select(F.col("cls").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))

    def sided(pairs: DataFrame, of) -> DataFrame:
        """Pairs with what belongs to their a and b; either may be the leader of many."""
        hot = {s: C.hot_keys(pairs, s) for s in "ab"}
        return C.even_join(C.even_join(pairs, of("a"), "a", "b", hot=hot["a"]), of("b"), "b", "a", hot=hot["b"])

    maybe = scratch.written(_maybe(sided(stars, side), percent), "maybe")

    # Texts of the classes in question, for their full sets: a text is half its set's hashes, and less when
    # compressed. The ids are unique, or the set's name tells.
    wanted = known.select("doc_id", "cls", "set")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = C.sieved(rows, "doc_id", wanted, "met").where("met").join(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [set_name(shingles(t.as_py(), size).tobytes()) == c.as_py() for t, c in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["cls", "text"]).filter(pa.array(right, pa.bool_()))

    full = scratch.written(texts.select("cls", "text", "set").mapInArrow(run, "cls bigint, text string"), "texts")
    if full.count() != known.count():  # repeated ids
        full = scratch.written(full.groupBy("cls").agg(F.first("text").alias("text")), "texts")
    text_of = lambda s: full.select(F.col("cls").alias(s), F.col("text").alias(f"text_{s}"))
    links = scratch.written(_confirmed(sided(maybe, text_of), size, percent), "links")
    labels = components(links, scratch)

    # What is left: groups of several components, in blocks. A group's leader has met all others; groups of
    # the same members are one, that of the least band.
    others = C.even_join(members.where("size > 2"), leaders, "key", "cls", hot=large(members.count())).where("cls <> leader").drop("leader")
    labelled = scratch.written(others.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    numbers = [F.sum(F.xxhash64(F.lit(i), "cls").cast("decimal(38,0)")).alias(f"sum_{i}") for i in range(2)]
    groups = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("others"), *numbers).where("low <> high")
    split = groups.groupBy("others", "sum_0", "sum_1").agg(F.min(F.struct((F.col("key").bitwiseAND(63)).alias("band"), "key")).alias("first")).select(F.col("first.key").alias("key"))
    n_chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    open_members = C.even_join(labelled, split, "key", "cls").withColumn("chunks", n_chunks).withColumn("chunk", F.pmod(F.xxhash64("key", "cls"), "chunks").cast("int"))
    dealt = open_members.select("*", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other")).select("*", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    dealt = scratch.written(dealt.select("key", F.expr("CAST(key & 63 AS INT)").alias("band"), "cls", "label", "chunk", "low", "high"), "blocks")
    many = C.hot_keys(dealt, "cls")  # a member of large groups is in many blocks
    whole = C.even_join(C.even_join(dealt, known.select("cls", "n_shingles", "regs"), "cls", "key", hot=many), full, "cls", "key", hot=many)
    more = whole.groupBy("key", "low", "high").applyInArrow(lambda t: _block(t, size, percent), "a bigint, b bigint")
    more = scratch.written(more, "links")
    if more.limit(1).count():
        labels = components(links.union(more), scratch)

    # Back to documents: a component's id is its least doc_id.
    linked = scratch.written(labels.withColumnRenamed("node", "cls").join(classes.select("cls", "doc_id"), "cls"), "linked")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("least"))
    reached = C.even_join(linked, least, "label", "cls").select("cls", "least")
    place = classes.select("cls", "set", "doc_id").join(reached, "cls", "left").select("set", F.coalesce("least", "doc_id").alias("component"))
    rows = docs.select("doc_id", "n_shingles", "set")
    with_words = C.even_join(rows.where("`set` IS NOT NULL"), place, "set", "doc_id", "left", hot=C.hot_keys(rows, "set"))
    placed = with_words.select("doc_id", "n_shingles", "component").union(rows.where("`set` IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))
    out = C.written(out, "components")
    scratch.clear()
    return out


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), size=4)


QUERIES = {"op3_near_dedup": op3_near_dedup}
