"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the rows uniformly, by a seeded hash of the whole row, into buckets that fit in a task's
memory. A bucket's number is its partition's, so each task has one bucket and none is empty by chance.
Pass two puts each bucket into an order that depends on the seed and the rows alone, shuffles it with
Spark's own Fisher-Yates ``shuffle`` and writes it. The buckets, one after another, are the shuffled stream;
it is cut into shards whose row counts differ by one at most (law ``rows``).

The number of buckets follows the bytes of text, so that a bucket stays near ``bucket_bytes`` at any size
of the input; by default that is what an executor's memory holds for each of its cores (64 MB in 3 GB for
two cores; some 300 000 buckets for 100 TB at 16 GB for four). Rows are scattered by all their columns, so
that groups of equal texts, one hot source or one repeated id spread like any other rows. Rows that are
equal in every column hash alike; where a bucket shows that such a group is large, its rows are written,
numbered and scattered by number.

Defined results: a null text is an empty one of size 1 (its bytes plus 1) with crc32 0; null ids are ids;
an empty table gives an empty result; repeated rows each get a slot of their own, and equal rows are
interchangeable; a very long text makes its bucket as large as it is; columns of the input stay, and
``shard`` and ``slot`` get an underscore in front where such names are taken. Columns must be orderable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import _common as C

N_SHARDS = 8
SEED = 20_260
#: Copies of a bucket that a task holds while it gathers, sorts and shuffles, and room for the rest.
COPIES = 8
#: Least and largest default of a bucket's text bytes.
LEAST_BUCKET, LARGEST_BUCKET = 8 << 20, 512 << 20
#: A bucket with so many times the mean number of rows holds a group of equal rows.
SWOLLEN = 4
#: Buckets whose offsets one task sums; the totals of such runs are summed once more.
RUN = 1_000
#: Bytes of the offsets that are broadcast; beyond, they are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def memory_for_bucket(spark: SparkSession) -> int:
    """Text bytes of a bucket, from the memory that the session gives a core."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    given = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", given.strip().lower()).groups()
    heap = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 20)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return max(LEAST_BUCKET, min(LARGEST_BUCKET, int(heap * 0.6) // max(1, cores) // COPIES))


def row_hash(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in df.columns))


def scattered(df: DataFrame, n_buckets: int, seed: int, bucket: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with each row's bucket, and (bucket, n)."""
    of = lambda h: F.pmod(h, F.lit(n_buckets)).cast("int")
    out = df.withColumn(bucket, of(row_hash(df, seed)))
    counts = C.written(out.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "counts")
    most, rows = counts.agg(F.max("n"), F.sum("n")).first()
    if not rows or most <= SWOLLEN * (rows / n_buckets) + C.FEW_ROWS:
        return out, counts
    key = C.free_name(out.columns, "key")
    hashed = df.withColumn(key, row_hash(df, seed))
    # A key of more than its share of rows: fewer than HOT_KEYS.
    hot = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(C.FEW_ROWS, rows // C.HOT_KEYS)).select(key)
    hot = C.written(hot, "hot")
    # Numbers follow the written files, so they are the same when a task runs again.
    large = C.written(hashed.join(F.broadcast(hot), key, "left_semi"), "large")
    spread = large.withColumn(bucket, of(F.xxhash64(F.lit(seed), key, F.monotonically_increasing_id()))).drop(key)
    rest = hashed.join(F.broadcast(hot), key, "left_anti").withColumn(bucket, of(F.col(key))).drop(key)
    out = rest.unionByName(spread)
    return out, out.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def offsets(counts: DataFrame) -> DataFrame:
    """(bucket, n) to (bucket, first rank), in two levels so that no task sees every bucket."""
    runs = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    totals = runs.groupBy("run").agg(F.sum("n").alias("run_n"))
    over_runs = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("run", F.coalesce(F.sum("run_n").over(over_runs), F.lit(0)).alias("run_first"))
    within = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("in_run", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, "run").select("bucket", (F.col("run_first") + F.col("in_run")).alias("first"))


def external_shuffle(df: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int | None = None, text_col: str = "text", path: str | None = None) -> tuple[DataFrame, str, str]:
    """Write ``df`` shuffled, as ``path``/shard=K/*.parquet (in the shared folder if no path is given).

    Returns the written rows and the names of the two new columns: the shard (0 to n_shards - 1) and
    the row's slot in it (0, 1, ... without gaps).
    """
    spark = df.sparkSession
    shard, slot = C.free_name(df.columns, "shard"), C.free_name(df.columns, "slot")
    bucket_name = C.free_name(df.columns, "bucket")
    rank = C.free_name([*df.columns, shard, slot], "rank")
    n_rows, n_bytes = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(1, min(max(-(-n_bytes // (bucket_bytes or memory_for_bucket(spark))), tasks), n_rows))

    dealt, counts = scattered(df, n_buckets, seed, bucket_name)
    first = offsets(counts)
    if n_buckets * 16 <= BROADCAST_BYTES:
        first = F.broadcast(first)
    order = F.xxhash64(F.lit(seed + 1), *(F.col(f"`{c}`") for c in df.columns)).alias("order")
    items = dealt.select(F.col(bucket_name).alias("bucket"), F.struct(order, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).alias("item"))
    # A fixed number of tasks and a fixed order inside each: a task that runs again shuffles alike.
    gathered = items.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    shuffled = gathered.join(first, "bucket").select("first", F.shuffle("items", seed).alias("items"))
    ranked = shuffled.select("first", F.posexplode("items").alias("pos", "item")).select("item.row.*", (F.col("first") + F.col("pos")).alias(rank))
    # Shard s holds the ranks from ceil(s * rows / shards) on.
    s = F.expr(f"{rank} * {n_shards} div {max(n_rows, 1)}")
    start = F.expr(f"({shard} * {n_rows} + {n_shards - 1}) div {n_shards}")
    placed = ranked.withColumn(shard, s.cast("int")).withColumn(slot, F.col(rank) - start).drop(rank)
    path = path or C.fresh_path(spark, "shards")
    placed.write.partitionBy(shard).parquet(path)
    return spark.read.schema(placed.schema).parquet(path), shard, slot


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, shard, slot = external_shuffle(C.table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).cast("int").alias("shard"),
        F.col(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op5_external_shuffle": op5_external_shuffle}
