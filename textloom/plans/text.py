"""Queries of text functions, filters and projections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import metrics as M
from textloom.functions import text as T
from textloom.functions import udf as U
from textloom.operators import grids, scoring
from textloom.plans._registry import query
from textloom.sources import files

W = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NORM = rf"trim(regexp_replace(nfc_normalize(coalesce(text, '')), '{W}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"



@query("norm_text_stats", f"SELECT doc_id, CAST(length({NORM}) AS INTEGER) AS n, sha256({NORM}) AS hash FROM documents")
def norm_text_stats(t):
    norm = T.collapse(F.col("text"))
    return U.with_nfc(t("documents").select("doc_id", "text"), "text").select("doc_id", F.length(norm).alias("n"), F.sha2(norm, 256).alias("hash"))


@query(
    "editorial_norm",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  t, '…+|\.{{3,}}', ' ', 'g'), '\([^()]*\)', '', 'g'), ' {{2,}}', ' ', 'g'), '^{W}+', ''), '{W}+$', ''), ' {{2,}}', ' ', 'g') AS norm
  FROM (SELECT doc_id, replace(replace(nfc_normalize(coalesce(text, '')), 'the ', '(the) '), '. ', '... ') AS t FROM documents)""",
)
def editorial_norm(t):
    marked = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("the "), F.lit("(the) ")), F.lit(". "), F.lit("... "))
    return U.with_nfc(t("documents").select("doc_id", marked.alias("text")), "text").select("doc_id", T.editorial(F.col("text")).alias("norm"))


@query(
    "unified_norm",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(replace(replace(t, chr(160), ' '), '…', ' '), '()[]{{}}', ''), '-{{2,}}', ' ', 'g'), '{W}+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, replace(replace(coalesce(text, ''), ' a', ' (a) --'), '.', '…') AS t FROM documents)""",
)
def unified_norm(t):
    marked = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" a"), F.lit(" (a) --")), F.lit("."), F.lit("…"))
    return t("documents").select("doc_id", T.unified(marked).alias("norm"))


@query(
    "bracket_policies",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\[[^\[\]]*\]', '', 'g'), '{W}+', ' ', 'g')) AS content_gone, replace(replace(t, '[', ''), ']', '') AS brackets_gone
  FROM (SELECT doc_id, replace(coalesce(text, ''), ' the ', ' [the] ') AS t FROM documents)""",
)
def bracket_policies(t):
    marked = F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(" [the] "))
    return t("documents").select("doc_id", T.strip_square(marked).alias("content_gone"), T.drop_square(marked).alias("brackets_gone"))


@query("norm_ws", rf"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{W}+', ' ', 'g')) AS norm FROM documents")
def norm_ws(t):
    return t("documents").select("doc_id", T.collapse(F.col("text")).alias("norm"))


@query(
    "edition_markup",
    rf"""SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line, '(?i)<telia>|<kopie>|<left\s+marginal>', '', 'g'), '^[\d.\s\x0B\x1C-\x1F\x85\p{{Z}}]+', ''), '{W}+', ' ', 'g')) AS clean
  FROM (SELECT doc_id, CAST(i AS INTEGER) AS line_no, concat('2.', CAST(i AS VARCHAR), '  1 <Telia>', lines[i + 1]) AS line
        FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))""",
)
def edition_markup(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marked = F.concat(F.lit("2."), F.col("line_no").cast("string"), F.lit("  1 <Telia>"), F.col("line"))
    return lines.select("doc_id", "line_no", T.edition_markup(marked).alias("clean"))


@query(
    "slugs",
    """SELECT p_partkey, CASE WHEN trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'x' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') END AS safe,
  replace(replace(replace(concat(p_brand, '/', p_type, '.v-1'), '/', '__'), '.', '_'), '-', '_') AS plain, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS padded, lower(trim(p_brand)) AS canonical, starts_with(p_name, '_') AS hidden FROM part""",
)
def slugs(t):
    name = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit(".v-1"))
    padded = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    return t("part").select("p_partkey", T.safe_slug(F.col("p_name")).alias("safe"), T.slug(name).alias("plain"), padded.alias("padded"), F.lower(F.trim("p_brand")).alias("canonical"), F.startswith("p_name", F.lit("_")).alias("hidden"))


@query(
    "url_parts",
    r"""SELECT page_id, regexp_extract(replace(url, '\', '/'), '[^/]*$') AS name, CASE WHEN starts_with(url, 'http:/x/') THEN substr(url, 9) ELSE url END AS relative,
  coalesce(nullif(regexp_replace(regexp_extract(url, '^https?://[^/]+/([^/]+/.+)', 1), '/+$', ''), ''), url) AS id,
  CASE WHEN regexp_matches(r, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN r WHEN starts_with(r, '/') THEN concat('http://base.example', r) ELSE concat('http://base.example/a/', r) END AS joined
  FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN concat('/x/', page_id) ELSE concat('y', page_id) END AS r FROM pages)""",
)
def url_parts(t):
    r = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/x/"), "page_id")).otherwise(F.concat(F.lit("y"), "page_id"))
    u = F.col("url")
    return t("pages").select("page_id", T.basename(u).alias("name"), T.relative_to(u, "http:/x").alias("relative"), T.id_from_url(u, "^https?://[^/]+/([^/]+/.+)").alias("id"), T.url_join("http://base.example/a/b", r).alias("joined"))


@query(
    "xml_lines",
    rf"""SELECT page_id, CASE WHEN len(b) > 0 THEN array_to_string(list_transform(list_filter(b, lambda x: {_strip("x")} <> ''), lambda x: {_strip("regexp_replace(x, '<[^>]+>', '', 'g')")}), ' ')
  ELSE {_strip("regexp_replace(html, '<[^>]+>', ' ', 'g')")} END AS text,
  CASE WHEN len(c) > 0 THEN array_to_string(c, '') ELSE regexp_replace(html, '<[^>]+>', '', 'g') END AS joined
  FROM (SELECT page_id, html, regexp_extract_all(html, '(?is)<li\b[^>]*>(.+?)</li>', 1) AS b, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS c FROM pages)""",
)
def xml_lines(t):
    return t("pages").select("page_id", T.xml_lines(F.col("html"), ("li",), "html", "metadata").alias("text"), T.xml_lines_joined(F.col("html"), "h1", "html").alias("joined"))


@query("page_links", """SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))), ' | ') AS links FROM pages""")
def page_links(t):
    return t("pages").select("page_id", F.array_join(files.links(F.col("html"), 'href="/([^"]*)"'), " | ").alias("links"))


@query(
    "meaningful_filter",
    rf"""SELECT doc_id, CAST(v AS INTEGER) AS visible, CAST(length(n) AS INTEGER) AS n FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\-·\s\x0B\x1C-\x1F\x85\p{{Z}}]')) AS v,
  trim(regexp_replace(coalesce(text, ''), '{W}+', ' ', 'g')) AS n FROM documents) WHERE v >= 5 AND length(n) >= 12""",
)
def meaningful_filter(t):
    norm = T.collapse(F.col("text"))
    kept = t("documents").where(T.is_meaningful(F.col("text")) & (F.length(norm) >= 12))
    return kept.select("doc_id", T.visible(F.col("text")).alias("visible"), F.length(norm).alias("n"))


@query(
    "script_filter",
    r"""SELECT doc_id, CAST(l AS INTEGER) AS letters, CAST(o AS INTEGER) AS own FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\p{L}')) AS l, len(regexp_extract_all(text, '[à-ÿ]')) AS o FROM documents)
  WHERE length(text) >= 12 AND l > 0 AND o >= greatest(4, l // 3)""",
)
def script_filter(t):
    c = F.col("text")
    kept = t("documents").where(T.mostly_script(c, "[à-öø-ÿ÷]"))
    return kept.select("doc_id", F.regexp_count(c, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(c, F.lit("[à-ÿ]")).alias("own"))


@query("word_band", rf"SELECT doc_id, CAST(n AS INTEGER) AS n FROM (SELECT doc_id, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS n FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{W}+', ' ', 'g')) AS c FROM documents)) WHERE n BETWEEN 5 AND 25")
def word_band(t):
    n = F.size(T.words(F.col("text")))
    return t("documents").where(n.between(5, 25)).select("doc_id", n.alias("n"))


@query("photo_filter", "SELECT page_id, url FROM pages WHERE starts_with(regexp_extract(url, '[^/]*$'), '1') OR contains(url, '/fr/')")
def photo_filter(t):
    return t("pages").where(F.startswith(T.basename(F.col("url")), F.lit("1")) | F.contains("url", F.lit("/fr/"))).select("page_id", "url")


@query("status_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'click' AND value IS NOT NULL")
def status_filter(t):
    return t("events").where("event_type = 'click' AND value IS NOT NULL").select("event_id", "event_type")


@query(
    "titlo_first_lines",
    r"""SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head, left(text, 40) AS cut, replace(replace(text, 'th', chr(1155)), chr(1155), '<TITLO>') AS titlo, contains(text, 'tion') AS has FROM documents""",
)
def titlo_first_lines(t):
    c = F.col("text")
    titlo = F.replace(F.replace(c, F.lit("th"), F.lit("҃")), F.lit("҃"), F.lit("<TITLO>"))
    return t("documents").select("doc_id", T.first_lines(c, 2).alias("head"), F.left(c, F.lit(40)).alias("cut"), titlo.alias("titlo"), F.contains(c, F.lit("tion")).alias("has"))


@query(
    "century_bucket",
    r"""SELECT o_orderkey, CASE WHEN len(y) = 0 THEN 'unknown' WHEN list_avg(y) <= 1100 THEN 'XI' WHEN list_avg(y) <= 1200 THEN 'XII' WHEN list_avg(y) <= 1300 THEN 'XIII' WHEN list_avg(y) <= 1400 THEN 'XIV' ELSE 'XV' END AS century, list_min(y) AS earliest
  FROM (SELECT o_orderkey, list_transform(regexp_extract_all(CASE WHEN o_orderkey % 7 = 0 THEN 'no date' ELSE concat('<-', 1000 + o_orderkey % 400, '-', 1040 + o_orderkey % 450, '->') END, '\d{3,4}'), lambda x: CAST(x AS INTEGER)) AS y FROM orders)""",
)
def century_bucket(t):
    k = F.col("o_orderkey")
    date = F.when(k % 7 == 0, "no date").otherwise(F.concat(F.lit("<-"), (1000 + k % 400).cast("string"), F.lit("-"), (1040 + k % 450).cast("string"), F.lit("->")))
    return t("orders").select("o_orderkey", T.century(date).alias("century"), T.earliest_year(date).alias("earliest"))


@query("site_bucket", "SELECT n_nationkey, CASE WHEN contains(lower(n_name), '1') THEN 'One' WHEN contains(lower(n_name), 'n') THEN 'N' ELSE 'other' END AS site FROM nation")
def site_bucket(t):
    return t("nation").select("n_nationkey", T.bucket(F.col("n_name"), (("1", "One"), ("n", "N"))).alias("site"))


@query(
    "audit_buckets",
    """SELECT l_orderkey, l_linenumber, CASE WHEN d > 0.45 OR o < 0.18 OR k < 0.30 THEN 'drop' WHEN d > 0.25 OR o < 0.32 OR k < 0.55 THEN 'soft' ELSE 'keep' END AS bucket, CASE WHEN d >= 0.45 THEN 'drop' ELSE 'keep' END AS decision
  FROM (SELECT l_orderkey, l_linenumber, l_discount * 5 AS d, l_quantity / 50 AS o, 1 - l_tax * 5 AS k FROM lineitem)""",
)
def audit_buckets(t):
    damage = F.col("l_discount") * 5
    bucket = grids.audit(damage, F.col("l_quantity") / 50, 1 - F.col("l_tax") * 5)
    return t("lineitem").select("l_orderkey", "l_linenumber", bucket.alias("bucket"), F.when(damage >= 0.45, "drop").otherwise("keep").alias("decision"))


@query(
    "aligned_sizes",
    """SELECT p_partkey, CAST(greatest(28, floor(coalesce(greatest(28, round_even(w * s, 0)), w) / 28) * 28) AS INTEGER) AS width, CAST(greatest(28, floor(coalesce(greatest(28, round_even(h * s, 0)), h) / 28) * 28) AS INTEGER) AS height,
  CAST(greatest(28, floor(coalesce(floor(w * s), w) / 28) * 28) AS INTEGER) AS cut_width, CAST(greatest(28, floor(coalesce(floor(h * s), h) / 28) * 28) AS INTEGER) AS cut_height, abs(w / h - 1) > 0.05 AS off
  FROM (SELECT *, CASE WHEN w * h > 451584 THEN sqrt(451584 / (w * h)) WHEN w * h < 100352 THEN sqrt(100352 / (w * h)) END AS s FROM (SELECT p_partkey, CAST(p_size * 40 AS DOUBLE) AS w, CAST(100 + p_partkey % 900 AS DOUBLE) AS h FROM part))""",
)
def aligned_sizes(t):
    w, h = (F.col("p_size") * 40).cast("double"), (100 + F.col("p_partkey") % 900).cast("double")
    (a, b), (c, d) = T.aligned_size(w, h), T.aligned_size(w, h, rounded=False)
    return t("part").select("p_partkey", a.alias("width"), b.alias("height"), c.alias("cut_width"), d.alias("cut_height"), (F.abs(w / h - 1) > 0.05).alias("off"))


@query(
    "number_functions",
    """SELECT p_partkey, CAST(round_even(CAST(p_size AS DOUBLE) * 0.7, 0) AS INTEGER) AS even, greatest(5, least(20, p_size)) AS clamped, CAST(p_retailprice * least(1, 1000.0::DOUBLE / p_retailprice) AS INTEGER) AS scaled, (1337 + p_partkey * 7919) % 65536 AS seed,
  round(sqrt((p_size - 10.0::DOUBLE) * (p_size - 10.0::DOUBLE) + 25) / 50, 9) AS distance, coalesce(nullif(nullif(p_brand, 'Brand#11'), ''), 'none') AS filled FROM part""",
)
def number_functions(t):
    size = F.col("p_size")
    scaled = F.bround(F.col("p_retailprice") * F.least(F.lit(1.0), 1000 / F.col("p_retailprice"))).cast("int")
    return t("part").select(
        "p_partkey",
        F.bround(size.cast("double") * 0.7).cast("int").alias("even"),
        F.greatest(F.lit(5), F.least(F.lit(20), size)).alias("clamped"),
        scaled.alias("scaled"),
        ((1337 + F.col("p_partkey") * 7919) % 65536).alias("seed"),
        F.round(F.sqrt((size - 10.0) * (size - 10.0) + 25) / 50, 9).alias("distance"),
        F.coalesce(F.nullif(F.nullif("p_brand", F.lit("Brand#11")), F.lit("")), F.lit("none")).alias("filled"),
    )


@query(
    "array_functions",
    """SELECT vec_id, CAST(list_min(e) AS DOUBLE) AS low, CAST(e[1] AS DOUBLE) AS first, len(list_distinct(e)) AS kinds, round(list_sum(list_transform(range(1, len(e)), lambda i: CAST(e[i + 1] AS DOUBLE) - CAST(e[i] AS DOUBLE))), 6) AS gaps, CAST(list_position(e, list_max(e)) AS INTEGER) AS peak
  FROM (SELECT vec_id, embedding AS e FROM embeddings)""",
)
def array_functions(t):
    e = F.col("embedding")
    gaps = F.zip_with(F.slice(e, 2, 1 << 20), F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), lambda a, b: a.cast("double") - b.cast("double"))
    return t("embeddings").select(
        "vec_id",
        F.array_min(e).cast("double").alias("low"),
        F.element_at(e, 1).cast("double").alias("first"),
        F.size(F.array_distinct(e)).cast("long").alias("kinds"),
        F.round(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x), 6).alias("gaps"),
        F.array_position(e, F.array_max(e)).cast("int").alias("peak"),
    )


@query("props_json", """SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events""")
def props_json(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("cer_nls_by_group_whole")
def cer_nls_by_group_whole(t):
    """The same scores of whole texts, of all rows. DuckDB's distance is of bytes, so no SQL checks it."""
    gold = F.col("text")
    rows = t("documents").select("lang", gold.alias("gold"), F.replace(gold, F.lit("th"), F.lit("t")).alias("pred"))
    out = scoring.summary(scoring.scored(rows, "pred", "gold", U.edits), "lang")
    return out.select("lang", "n", *(F.round(c, 9).alias(c) for c in out.columns[2:]))


@query(
    "eval_summary",
    """WITH r AS (SELECT c_name AS g, replace(c_name, '0', 'o') AS p, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'x' END AS i FROM customer),
  s AS (SELECT *, CASE WHEN i IS NULL THEN 'no_image' ELSE 'scored' END AS reason, levenshtein(p, g) / length(g)::DOUBLE AS cer, 1 - levenshtein(p, g) / greatest(length(p), length(g))::DOUBLE AS nls FROM r)
  SELECT count(*) AS n_rows, count_if(reason = 'scored')::BIGINT AS n_scored, count_if(reason = 'no_image')::BIGINT AS n_no_image, 0::BIGINT AS n_meaningless, round(avg(cer) FILTER (reason = 'scored'), 9) AS mean_cer_raw, round(avg(cer) FILTER (reason = 'scored'), 9) AS mean_cer_stripped, round(avg(nls) FILTER (reason = 'scored'), 9) AS mean_nls FROM s""",
)
def eval_summary(t):
    rows = t("customer").select(F.col("c_name").alias("gold"), F.replace("c_name", F.lit("0"), F.lit("o")).alias("pred"), F.when(F.col("c_custkey") % 9 != 0, "x").alias("image"))
    out = scoring.eval_summary(rows, "pred", "gold", "image")
    return out.select(*out.columns[:4], *(F.round(c, 9).alias(c) for c in out.columns[4:]))


@query(
    "word_f1",
    rf"""SELECT doc_id, round(CASE WHEN len(p) + len(g) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END, 9) AS f1 FROM (SELECT doc_id, list_distinct(string_split(c, ' ')) AS g, list_distinct(string_split(replace(c, 'an', 'en'), ' ')) AS p FROM
  (SELECT doc_id, trim(regexp_replace(text, '{W}+', ' ', 'g')) AS c FROM documents)) """,
)
def word_f1(t):
    return t("documents").select("doc_id", F.round(M.word_f1(F.replace(T.collapse(F.col("text")), F.lit("an"), F.lit("en")), F.col("text")), 9).alias("f1"))


@query("nw_confusion")
def nw_confusion(t):
    """Aligned character pairs of names and their perturbed copies, per row, then over all rows."""
    rows = t("customer").select("c_custkey", F.col("c_name").alias("gold"), F.replace("c_name", F.lit("00"), F.lit("o")).alias("pred"))
    return scoring.merged_confusion(scoring.confusion(rows, "pred", "gold", ["c_custkey"]))


@query("html_document")
def html_document(t):
    doc = U.parse_document(F.col("html"), area="ad", images=("/",))
    return t("pages").select("page_id", doc.alias("d")).select("page_id", "d.main", "d.spaced", F.to_json("d.metadata").alias("metadata"), F.to_json("d.images").alias("images"))


@query("wrapped_lines")
def wrapped_lines(t):
    return t("conversations").select("conv_id", "turn", F.posexplode(U.wrapped(F.col("text"), F.lit(60))).alias("line_no", "line"))
