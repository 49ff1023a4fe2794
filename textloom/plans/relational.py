"""Queries of joins, aggregations, set operations, splits, samples and leak audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import metrics as M
from textloom.functions import text as T
from textloom.operators import grids, leakage, quantiles, scoring, series, splits
from textloom.plans._registry import query

NORM = r"trim(regexp_replace(coalesce({}, ''), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', ' ', 'g'))"
SPLIT = """(SELECT doc_id, lang, source, CASE WHEN r <= nt THEN 'train' WHEN r <= nt + nv THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, least(CAST(round_even(0.1::DOUBLE * n, 0) AS INTEGER), n - nt) AS nv FROM (SELECT *, greatest(1, CAST(round_even(0.7::DOUBLE * n, 0) AS INTEGER)) AS nt FROM (
    SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(concat('1337|', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents))))"""


def _split(t):
    return splits.stratified(t("documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"])


# --- leaks --------------------------------------------------------------------------------------------

LINES = f"(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
LEAKS = f"""WITH l AS (SELECT doc_id, {NORM.format('line')} AS n FROM {LINES}), b AS (SELECT DISTINCT {NORM.format('line')} AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark))"""


def _lines(df, *keys):
    return df.select(*keys, F.explode(F.split("text", "\n")).alias("line"))


@query(
    "leak_audit",
    LEAKS + """ SELECT 0::BIGINT AS id_hits, 0::BIGINT AS name_hits, h AS hash_hits, CASE WHEN h = 0 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM (SELECT count(*) AS h FROM l WHERE n <> '' AND n IN (SELECT n FROM b))""",
)
def leak_audit(t):
    """Documents against the benchmark, line by line; their ids come from different spaces."""
    test = _lines(t("documents"), F.concat(F.lit("d"), "doc_id").alias("id"))
    train = _lines(t("benchmark"), F.concat(F.lit("b"), "item_id").alias("id"))
    return leakage.audit(test, train, "id", None, "line")


@query("leak_line_hash", LEAKS + " SELECT doc_id, n AS line FROM l WHERE n <> '' AND n IN (SELECT n FROM b)")
def leak_line_hash(t):
    return leakage.same_text(_lines(t("documents"), "doc_id"), _lines(t("benchmark"), "item_id"), "line", "line").select("doc_id", T.collapse(F.col("line")).alias("line"))


@query("leak_exact_hash", f"SELECT doc_id FROM documents d WHERE source = 'src1' AND {NORM.format('text')} <> '' AND sha256({NORM.format('text')}) IN (SELECT sha256({NORM.format('text')}) FROM documents WHERE source <> 'src1')")
def leak_exact_hash(t):
    d = t("documents")
    return leakage.same_text(d.where("source = 'src1'"), d.where("source <> 'src1'"), "text", "text").select("doc_id")


@query("leak_basename", r"SELECT page_id, url FROM pages WHERE page_id % 2 = 0 AND regexp_extract(url, '[^/]*$') <> '' AND regexp_extract(url, '[^/]*$') IN (SELECT regexp_extract(url, '[^/]*$') FROM pages WHERE page_id % 2 = 1)")
def leak_basename(t):
    p = t("pages").select("page_id", "url")
    return leakage.same_name(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"), "url")


NAMES = "(SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0)"


@query("close_names", "SELECT c.c_custkey, s.s_suppkey, levenshtein(right(c.c_name, 12), right(s.s_name, 12))::INTEGER AS distance FROM customer c, supplier s WHERE levenshtein(right(c.c_name, 12), right(s.s_name, 12)) <= 2")
def close_names(t):
    a = t("customer").select("c_custkey", F.right("c_name", F.lit(12)).alias("a"))
    b = t("supplier").select("s_suppkey", F.right("s_name", F.lit(12)).alias("b"))
    return leakage.close_texts(a, b, "c_custkey", "s_suppkey", "a", "b", 2)


@query("decontam_edit_distance_whole")
def decontam_edit_distance_whole(t):
    """Documents of which neither the text nor a line comes within the limit of a benchmark text or line."""

    def units(df, key):
        each = df.select(key, F.explode(F.array_append(F.split("text", "\n"), F.col("text"))).alias("unit"))
        return each.select(key, T.collapse(F.col("unit")).alias("unit")).where("unit <> ''")

    bank = units(t("documents"), "doc_id").select(F.struct("doc_id", "unit").alias("id"), "unit")
    held = units(t("benchmark"), "item_id").select("unit").distinct().withColumn("held", F.sha2("unit", 256))
    near = leakage.close_texts(bank, held, "id", "held", "unit", "unit")
    return t("documents").select("doc_id").join(near.select("id.doc_id").distinct(), "doc_id", "left_anti")


@query("disagreement", "SELECT s_suppkey, levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE > 0.3 AS reject FROM (SELECT s_suppkey, s_name AS a, replace(s_name, '0', CASE WHEN s_suppkey % 2 = 0 THEN 'oo' ELSE '0' END) AS b FROM supplier)")
def disagreement(t):
    b = F.replace("s_name", F.lit("0"), F.when(F.col("s_suppkey") % 2 == 0, "oo").otherwise("0"))
    return t("supplier").select("s_suppkey", (M.distance(F.col("s_name"), b) / F.greatest(F.length("s_name"), F.length(b)) > 0.3).alias("reject"))


# --- splits, samples, sets ------------------------------------------------------------------------------


@query("stratified_split_members", f"SELECT doc_id, split FROM {SPLIT}")
def stratified_split_members(t):
    return _split(t).select("doc_id", "split")


@query("stratified_split_sizes", f"SELECT lang, source, count_if(split = 'train')::BIGINT AS train, count_if(split = 'val')::BIGINT AS val, count_if(split = 'test')::BIGINT AS test, count(*) AS n_total FROM {SPLIT} GROUP BY ALL")
def stratified_split_sizes(t):
    return _split(t).groupBy("lang", "source").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")), F.count(F.lit(1)).alias("n_total"))


@query("split_fingerprint", f"SELECT split, sha256(concat(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)), chr(10))) AS sha256, count(*) AS n FROM {SPLIT} GROUP BY split")
def split_fingerprint(t):
    return splits.fingerprint(_split(t), "doc_id", "split")


@query("split_disjoint_check", f"SELECT doc_id, count(DISTINCT split) AS splits FROM {SPLIT} GROUP BY doc_id HAVING count(DISTINCT split) > 1")
def split_disjoint_check(t):
    return splits.shared_between(_split(t), "doc_id")


@query(
    "split_assignment",
    "SELECT d.doc_id, CASE min(CASE WHEN l.quality = 1 THEN 1 ELSE 2 END) WHEN 1 THEN 'train' ELSE 'val' END AS split FROM documents d JOIN (SELECT * FROM labels UNION ALL SELECT doc_id, 1, 0 FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY d.doc_id",
)
def split_assignment(t):
    one = t("labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    ids = one.union(t("labels").where("toxic = 1").select("doc_id", F.lit("train")))
    return splits.assigned(t("documents").select("doc_id"), ids, "doc_id")


@query("seeded_sample", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5(concat('7|', doc_id)), doc_id LIMIT 100)")
def seeded_sample(t):
    return splits.take(t("documents").select("doc_id"), 100, "doc_id", 7)


@query("held_out_slice", "SELECT doc_id FROM documents WHERE CAST(concat('0x', substr(md5(concat('5|', doc_id)), 1, 8)) AS BIGINT) % 100 < 5")
def held_out_slice(t):
    return t("documents").where(splits.held_out("doc_id", 5, 5)).select("doc_id")


@query(
    "mix_80_20",
    """WITH c AS (SELECT count_if(lang = 'en') AS s, count_if(lang = 'de') AS r FROM documents), n AS (SELECT CASE WHEN r * 80 <= s * 20 THEN CAST(round_even(r * 100.0::DOUBLE / 20, 0) AS BIGINT) - r ELSE s END AS ns, CASE WHEN r * 80 <= s * 20 THEN r ELSE CAST(round_even(s * 100.0::DOUBLE / 80, 0) AS BIGINT) - s END AS nr FROM c),
  k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('3|', doc_id)), doc_id) AS i FROM documents WHERE lang IN ('en', 'de'))
  SELECT doc_id, CASE lang WHEN 'en' THEN 'synthetic' ELSE 'real' END AS pool FROM k, n WHERE i <= CASE lang WHEN 'en' THEN ns ELSE nr END""",
)
def mix_80_20(t):
    d = t("documents")
    return splits.mix(d.where("lang = 'en'").select("doc_id"), d.where("lang = 'de'").select("doc_id"), 80, "doc_id", 3)


@query("replicate_rows", """SELECT doc_id, CAST(i AS INTEGER) AS replica, CASE WHEN i > 0 THEN CAST(concat('0x', substr(md5(concat('11|', doc_id, '|', i)), 1, 8)) AS BIGINT) END AS augment_seed FROM documents, range(3) r(i)""")
def replicate_rows(t):
    return splits.replicated(t("documents").select("doc_id"), 3, "doc_id", 11)


@query(
    "three_tier_mix",
    """WITH c AS (SELECT least(count_if(lang = 'en') * 100 // 70, count_if(lang = 'de') * 100 // 20, count_if(lang = 'es') * 100 // 10) AS total FROM documents),
  k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('9|', doc_id)), doc_id) AS i FROM documents)
  SELECT doc_id, lang AS pool FROM k, c WHERE i <= total * CASE lang WHEN 'en' THEN 70 WHEN 'de' THEN 20 WHEN 'es' THEN 10 ELSE 0 END // 100""",
)
def three_tier_mix(t):
    pools = {x: t("documents").where(F.col("lang") == x).select("doc_id") for x in ("en", "de", "es")}
    return splits.mix_many(pools, {"en": 70, "de": 20, "es": 10}, "doc_id", 9)


@query("unified_sources", "SELECT concat('d', doc_id) AS id, 'documents' AS source, 'train' AS split, lang FROM documents UNION ALL SELECT concat('b', item_id), 'benchmark', 'test', NULL FROM benchmark")
def unified_sources(t):
    a = t("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("documents").alias("source"), F.lit("train").alias("split"), "lang")
    b = t("benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.lit("benchmark").alias("source"), F.lit("test").alias("split"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "id_sets",
    """SELECT 'both' AS part, n_regionkey AS id FROM (SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region) UNION ALL SELECT 'only', n_nationkey FROM (SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region)
  UNION ALL SELECT 'any', n_nationkey FROM (SELECT n_nationkey FROM nation UNION SELECT r_regionkey FROM region)""",
)
def id_sets(t):
    n, r = t("nation"), t("region").select(F.col("r_regionkey").alias("id"))
    key = n.select(F.col("n_nationkey").alias("id"))
    parts = {"both": leakage.shared_ids(n.select(F.col("n_regionkey").alias("id")), r, "id"), "only": key.exceptAll(r), "any": key.union(r).distinct()}
    out = None
    for name, ids in parts.items():
        ids = ids.select(F.lit(name).alias("part"), "id")
        out = ids if out is None else out.union(ids)
    return out


@query("dedup_keep_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY text")
def dedup_keep_first(t):
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


# --- joins ----------------------------------------------------------------------------------------------


@query("existence_skips", "SELECT o_orderstatus, count(*) AS n, count_if(l.k IS NULL)::BIGINT AS skipped FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') l ON o_orderkey = k GROUP BY ALL")
def existence_skips(t):
    there = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("there", F.lit(True))
    return t("orders").join(there, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("there").isNull()).alias("skipped"))


@query("first_existing", "SELECT o_custkey AS k, arg_min(p, i) AS path FROM (SELECT o_custkey, unnest([o_orderkey * 2, o_orderkey, o_custkey]) AS p, unnest([0, 1, 2]) AS i FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)) WHERE p IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4) GROUP BY ALL")
def first_existing(t):
    one = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("o")).select("k", F.array(F.col("o") * 2, F.col("o"), F.col("k")).alias("c"))
    return grids.first_existing(one, "k", "c", t("lineitem").where("l_linenumber > 4").select(F.col("l_orderkey").alias("path")), "path")


PATHS = "SELECT o_custkey, concat(CASE o_orderkey % 3 WHEN 0 THEN 'photo_' WHEN 1 THEN 'drawing_' ELSE 'scan_' END, o_orderkey, '.jpg') AS p FROM orders"


@query("preferred_item", f"SELECT o_custkey, coalesce(min(p) FILTER (contains(p, 'photo_')), min(p) FILTER (contains(p, 'drawing_')), min(p)) AS p FROM ({PATHS}) GROUP BY ALL")
def preferred_item(t):
    name = F.element_at(F.array(F.lit("photo_"), F.lit("drawing_"), F.lit("scan_")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = t("orders").select("o_custkey", F.concat(name, "o_orderkey", F.lit(".jpg")).alias("p"))
    return rows.groupBy("o_custkey").agg(T.preferred(F.collect_list("p")).alias("p"))


@query("companions", "SELECT p_partkey, c FROM part LEFT JOIN (SELECT p_size, arg_min(concat('x', p_partkey, '.', p_brand), [CASE p_brand WHEN 'Brand#12' THEN 1 ELSE 2 END, 0]::INTEGER[]) AS c0, min(concat(CASE p_brand WHEN 'Brand#12' THEN '1' ELSE '2' END, 'x', p_partkey, '.', p_brand))[2:] AS c FROM part WHERE p_brand IN ('Brand#12', 'Brand#13') GROUP BY p_size) USING (p_size)")
def companions(t):
    b = t("part").select("p_size", F.concat(F.lit("x"), "p_partkey", F.lit("."), "p_brand").alias("path"))
    return grids.companion(t("part").select("p_partkey", "p_size"), b, "p_size", ["Brand#12", "Brand#13"], "path").select("p_partkey", F.col("companion").alias("c"))


@query("three_way_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY md5(concat('1|', o_orderkey)), o_orderkey LIMIT 3)")
def three_way_join(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return splits.take(joined.select("o_orderkey", "c_name", "n_name"), 3, "o_orderkey", 1)


@query("paired_keys", "SELECT o_orderkey, o_custkey AS pred, o_totalprice AS gold FROM orders")
def paired_keys(t):
    rows = t("orders")
    return scoring.paired(rows.select("o_orderkey", F.col("o_custkey").alias("pred")), rows.select("o_orderkey", F.col("o_totalprice").alias("gold")), ["o_orderkey"])


@query("metrics_merge", "SELECT coalesce(n.k, r.k) AS k, coalesce(n.v, r.v) AS v, CASE coalesce(n.k, r.k) WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 999 END AS place FROM (SELECT r_regionkey AS k, r_name AS v FROM region WHERE r_regionkey > 1) r FULL JOIN (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 4) n USING (k)")
def metrics_merge(t):
    core = t("nation").where("n_nationkey < 4").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("v"))
    other = t("region").where("r_regionkey > 1").select(F.col("r_regionkey").cast("string").alias("k"), F.col("r_name").alias("v"))
    return scoring.merged_metrics(core, other, "k", ["v"], ("4", "2")).select(F.col("k").cast("int").alias("k"), "v", F.col("place").cast("int").alias("place"))


@query("model_grid", "SELECT p_partkey, m AS model, s AS scale FROM part, (SELECT unnest(['a', 'b', 'c']) AS m), (SELECT unnest([0.55::DOUBLE, 0.8::DOUBLE]) AS s)")
def model_grid(t):
    return grids.grid(t("part").select("p_partkey"), ("model", ["a", "b", "c"]), ("scale", [0.55, 0.8]))


@query("contact_sheet", "SELECT n_regionkey, min(n_name) FILTER (n_nationkey % 3 = 0) AS c0, min(n_name) FILTER (n_nationkey % 3 = 1) AS c1, min(n_name) FILTER (n_nationkey % 3 = 2) AS c2 FROM nation GROUP BY ALL")
def contact_sheet(t):
    rows = t("nation").withColumn("cell", F.concat(F.lit("c"), F.col("n_nationkey") % 3))
    return grids.sheet(rows, "n_regionkey", "cell", "n_name", ["c0", "c1", "c2"])


@query("dispatch", "SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'other' END AS out FROM events WHERE event_type IN ('click', 'view')")
def dispatch(t):
    return t("events").where("event_type IN ('click', 'view')").select("event_id", grids.dispatch(F.concat(F.lit(" "), F.upper("event_type")), {"click": F.lit("C"), "view": F.lit("V")}).alias("out"))


@query("predict_isolated", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE upper(s_name) END AS prediction, CASE WHEN s_suppkey % 5 = 0 THEN 'ValueError: bad' END AS error FROM supplier")
def predict_isolated(t):
    def make():
        def model(key, name):
            if key % 5 == 0:
                raise ValueError("bad")
            return name.upper()

        return model

    return grids.predicted(t("supplier").select("s_suppkey", "s_name"), ["s_suppkey", "s_name"], make).drop("s_name")


# --- aggregations ---------------------------------------------------------------------------------------


@query("source_counts_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def source_counts_rollup(t):
    return t("documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("slice_cube", "SELECT lang, quality, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, quality)")
def slice_cube(t):
    return t("documents").join(t("labels"), "doc_id").cube("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query(
    "funnel_reasons",
    "SELECT CASE WHEN n_chars < 100 THEN 'too_short' WHEN l.doc_id IS NULL THEN 'no_label' WHEN toxic = 1 THEN 'toxic' ELSE 'emitted' END AS reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS share FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1",
)
def funnel_reasons(t):
    d = t("documents").join(t("labels").withColumn("has", F.lit(1)), "doc_id", "left")
    reason = F.when(F.col("n_chars") < 100, "too_short").when(F.col("has").isNull(), "no_label").when(F.col("toxic") == 1, "toxic").otherwise("emitted")
    counts = d.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


@query("seed_mean_std", "SELECT l_orderkey, round(avg(l_quantity), 9) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 9) AS std FROM lineitem GROUP BY ALL")
def seed_mean_std(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_quantity"), 9).alias("mean"), F.round(M.sample_std(F.col("l_quantity")), 9).alias("std"))


@query("empty_means", "SELECT 'NaN'::DOUBLE AS nan_mean, 0.0::DOUBLE AS zero_mean, count(*) AS n FROM lineitem WHERE l_quantity < 0")
def empty_means(t):
    q = F.col("l_quantity")
    return t("lineitem").where("l_quantity < 0").agg(M.mean_or_nan(q).alias("nan_mean"), M.mean_or_zero(q).alias("zero_mean"), F.count(F.lit(1)).alias("n"))


@query("quantile_audit", "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 9) AS mean, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}::DOUBLE), 4) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM lineitem GROUP BY ALL")
def quantile_audit(t):
    """Prices' quantiles are exact, but no task sees all prices of a flag."""
    rows = t("lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    shares = {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)}
    means = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg("l_quantity"), 9).alias("mean"))
    found = quantiles.quantiles(rows, "l_returnflag", "l_extendedprice", shares).withColumnRenamed("l_returnflag", "flag")
    both = means.join(F.broadcast(found), F.col("l_returnflag").eqNullSafe(F.col("flag")), "left")  # a row per flag
    return both.select(*means.columns, *(F.round(name, 4).alias(name) for name in shares))


@query("distinct_counts", "SELECT lang, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents GROUP BY ALL")
def distinct_counts(t):
    return t("documents").groupBy("lang").agg(F.count_distinct("text").alias("texts"), F.count_distinct("source").alias("sources"))


CHARS = "(SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents)"


@query("char_topk_per_doc", f"SELECT doc_id, c, n FROM (SELECT doc_id, c, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r FROM {CHARS} WHERE c NOT IN ('', ' ') GROUP BY doc_id, c) WHERE r <= 30")
def char_topk_per_doc(t):
    from pyspark.sql.window import Window

    chars = t("documents").select("doc_id", F.posexplode(F.split("text", "")).alias("at", "c")).where("c NOT IN ('', ' ')").groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "at"))
    return chars.withColumn("r", rank).where("r <= 30").select("doc_id", "c", "n")


@query(
    "char_distribution",
    "WITH a AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c), b AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> '' GROUP BY c) SELECT c, coalesce(a.n, 0) AS in_a, coalesce(b.n, 0) AS in_b, round(coalesce(a.n, 0) / (SELECT sum(n) FROM a)::DOUBLE - coalesce(b.n, 0) / (SELECT sum(n) FROM b)::DOUBLE, 9) AS difference FROM a FULL JOIN b USING (c)",
)
def char_distribution(t):
    def counts(name, to):
        each = t(name).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias(to))
        return each.crossJoin(F.broadcast(each.agg(F.sum(to).alias(f"{to}_all"))))  # one row

    both = counts("documents", "in_a").join(counts("benchmark", "in_b"), "c", "full_outer").na.fill(0)
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.nullif(f"{x}_all", F.lit(0))), F.lit(0.0))
    return both.select("c", "in_a", "in_b", F.round(share("in_a") - share("in_b"), 9).alias("difference"))


@query("failure_tallies", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def failure_tallies(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("compute_log", "SELECT coalesce(l_shipmode, 'TOTAL') AS phase, round(sum(l_quantity), 4) AS hours FROM (SELECT l_linestatus AS l_shipmode, l_quantity FROM lineitem) GROUP BY ROLLUP (l_shipmode)")
def compute_log(t):
    return t("lineitem").rollup("l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("hours")).select(F.coalesce("l_linestatus", F.lit("TOTAL")).alias("phase"), "hours")


@query("size_means", "SELECT p_brand, round(avg(p_size), 9) AS w, round(avg(p_retailprice), 6) AS h, round(avg(p_size / p_retailprice), 9) AS aspect FROM part GROUP BY ALL")
def size_means(t):
    return t("part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 9).alias("w"), F.round(F.avg("p_retailprice"), 6).alias("h"), F.round(F.avg(F.col("p_size") / F.col("p_retailprice")), 9).alias("aspect"))


@query("delta_to_reference", "WITH s AS (SELECT l_returnflag AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), r AS (SELECT v AS ref FROM s WHERE k = 'N') SELECT k, round((ref - v) / ref, 9) AS reduction, round(ref / v, 9) AS gain FROM s, r")
def delta_to_reference(t):
    s = t("lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.sum("l_quantity").alias("v"))
    ref = s.where("k = 'N'").select(F.col("v").alias("ref"))
    return s.crossJoin(F.broadcast(ref)).select("k", F.round((F.col("ref") - F.col("v")) / F.col("ref"), 9).alias("reduction"), F.round(F.col("ref") / F.col("v"), 9).alias("gain"))  # one row


@query("first_per_group", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_per_group(t):
    return series.keep_first(t("events"), ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("last_metric", "SELECT user_id, arg_max(value, event_id) AS last FROM events WHERE value IS NOT NULL GROUP BY ALL")
def last_metric(t):
    return t("events").where("value IS NOT NULL").groupBy("user_id").agg(F.max_by("value", "event_id").alias("last"))


@query("best_checkpoint", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1")
def best_checkpoint(t):
    return series.best_row(t("events"), ["user_id"], "value", "event_id", "event_id", "value")


@query("list_fingerprint", "SELECT c_nationkey, sha256(concat(string_agg(c_name, chr(10) ORDER BY c_name), chr(10))) AS sha256, count(*) AS n FROM customer GROUP BY ALL")
def list_fingerprint(t):
    return splits.fingerprint(t("customer"), "c_name", "c_nationkey")
