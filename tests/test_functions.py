"""Hand-derived cases of the text, date, metric and Arrow functions."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import metrics as M
from textloom.functions import text as T
from textloom.functions import udf as U
from textloom.operators import scoring


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


CASES = [
    (T.strip_square, "a[b]c", "ac"),
    (T.strip_square, "a[b", "a"),
    (T.strip_square, "a]b", "ab"),
    (T.strip_square, "a[b[c]d]e", "ae"),
    (T.drop_square, "a[b]c", "abc"),
    (T.unified, "а(б)[в]--г…д", "абв г д"),
    (T.unified, "a b⁞c ", "a b c"),
    (T.editorial, "a((b)c)d", "a(c)d"),
    (T.editorial, "Оборот: слово … ещё....", "слово ещё"),
    (T.editorial, "строка 12: а  б", "а б"),
    (T.editorial, None, ""),
    (T.is_meaningful, "-- · ab", False),
    (T.is_meaningful, "abcde", True),
    (T.is_meaningful, "", False),
    (T.is_meaningful, None, False),
    (T.century, "←1100‒1120→", "XII"),
    (T.century, "1100", "XI"),
    (T.century, "", "unknown"),
    (T.century, "1380‒1420", "XIV"),
    (T.century, "1500", "XV"),
    (T.earliest_year, "1120-1100", 1100),
    (T.bucket, "Старая Русса", "Staraya_Russa"),
    (T.bucket, "Великий Новгород", "Novgorod"),
    (T.bucket, "Звенигород", "other"),
    (T.safe_slug, "Supr 001r!", "supr_001r"),
    (T.safe_slug, "!!!", "x"),
    (T.slug, "a/b.c-d", "a__b_c_d"),
    (T.basename, "a\\b/c.jpg", "c.jpg"),
    (T.dirname, "a\\b/c.jpg", "a/b"),
    (T.collapse, " a  \x1cb\n", "a b"),
    (T.edition_markup, "2.1  1 <Telia>word  <left  marginal>x", "word x"),
    (T.first_filled, "", ""),
    (T.xml_lines, "<HistoricalDocument><Line>ab<Word>c</Word></Line></HistoricalDocument>", "abc"),
    (T.xml_lines, "<HistoricalDocument><Metadata>m</Metadata><b>x</b></HistoricalDocument>", "x"),
    (T.xml_lines, "plain", "plain"),
    (T.xml_lines_joined, "<HistoricalDocument><Line>ab<Word>c</Word></Line></HistoricalDocument>", "abc"),
    (T.mostly_script, "ⷢслово и дело", True),
    (T.mostly_script, "folio 12 recto слов", True),
    (T.mostly_script, "folio 12 recto abc сло", False),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(spark, i):
    f, given, want = CASES[i]
    assert value(spark, f(F.lit(given).cast("string"))) == want


def test_glued_and_preferred(spark):
    lines = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, T.glued(lines("во-", " да", "", "и"))) == "вода и"
    assert value(spark, T.preferred(lines("b/photo_2", "a/drawing_1", "b/photo_1"))) == "b/photo_1"
    assert value(spark, T.preferred(lines("z", "b/drawing_1"))) == "b/drawing_1"
    assert value(spark, T.preferred(lines("z", "y"))) == "y"


def test_metrics(spark):
    both = lambda f, p, g: value(spark, f(F.lit(p), F.lit(g)))
    assert [both(M.nls, "", ""), both(M.nls, "", "a")] == [1.0, 0.0]
    assert [both(M.cer, "", ""), both(M.cer, "a", ""), both(M.cer, "aaaa", "a")] == [0.0, 1.0, 3.0]
    assert both(M.cer_stripped, "ab", "a[x]b") == 0.0 and both(M.exact, "a  b", " a b") is True
    pred, gold = "линоборѧмь омоти", "жиноденелоубо омоти-[е]"  # a published row
    assert abs(both(M.cer, pred, gold) - 0.6086956521739131) < 1e-12
    assert abs(both(M.cer_stripped, pred, gold) - 0.55) < 1e-12
    assert abs(both(M.nls, pred, gold) - 0.3913043478260869) < 1e-12


def test_nfc(spark):
    df = spark.createDataFrame([(1, "é"), (2, "plain é"), (3, None)], "id long, text string")
    assert {r.id: r.text for r in U.with_nfc(df, "text").collect()} == {1: "é", 2: "plain é", 3: None}


def plain_alignment(a, b):
    """Cell by cell."""
    best = {(0, 0): (0, None)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                ways = []
                if i and j:
                    ways.append((best[i - 1, j - 1][0] + (1 if a[i - 1] == b[j - 1] else -1), 2, (a[i - 1], b[j - 1]), (i - 1, j - 1)))
                if i:
                    ways.append((best[i - 1, j][0] - 1, 1, (a[i - 1], None), (i - 1, j)))
                if j:
                    ways.append((best[i, j - 1][0] - 1, 0, (None, b[j - 1]), (i, j - 1)))
                way = max(ways, key=lambda w: w[:2])
                best[i, j] = way[0], way
    out, at = [], (len(a), len(b))
    while at != (0, 0):
        way = best[at][1]
        out.append(way[2])
        at = way[3]
    return out[::-1]


def test_alignment_like_plain_one():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert U.align(a, b) == plain_alignment(a, b), (a, b)


def test_confusion_keeps_what_it_should(spark):
    df = spark.createDataFrame([(1, "aab", "axb"), (2, "c", "")], "id long, gold string, pred string")
    got = {(r.id, r.g, r.p): r.n for r in scoring.confusion(df, "pred", "gold", ["id"], top=1, extra=("z",)).collect()}
    assert got == {(1, "a", "a"): 1, (1, "a", "x"): 1, (2, "c", "<gap>"): 1}


def test_confusion_of_a_group_without_a_key(spark):
    df = spark.createDataFrame([(None, "aab", "axb"), (None, "b𐍈b a", "b a"), (1, "q", "q")], "id long, gold string, pred string")
    got = {(r.id, r.g, r.p): r.n for r in scoring.confusion(df, "pred", "gold", ["id"], top=1).collect()}
    assert got == {(None, "a", "a"): 2, (None, "a", "x"): 1, (1, "q", "q"): 1}


def test_rows_are_dealt_before_they_are_aligned(spark, monkeypatch):
    task = lambda *_: F.array(F.struct(F.spark_partition_id().cast("string").alias("g"), F.lit("x").alias("p"), F.lit(1).alias("n"), F.lit(0).alias("at")))
    monkeypatch.setattr(scoring, "pair_counts", task)
    one_file = spark.range(0, 500, 1, 1).select("id", F.col("id").cast("string").alias("gold"), F.lit("x").alias("pred"))
    assert scoring.merged_confusion(scoring.confusion(one_file, "pred", "gold", ["id"])).count() > 8


def test_pair_counts(spark):
    df = spark.createDataFrame([("aba", "aa"), ("aba", "aa"), ("", ""), (None, "a")], "g string, p string")
    got = [r.x and [tuple(x) for x in r.x] for r in df.select(U.pair_counts("g", "p").alias("x")).collect()]
    assert got == [[("a", "a", 2, 0), ("b", None, 1, 1)]] * 2 + [[], None]


def test_wrap():
    assert U.wrap("one two three", 7) == ["one two", "three"]
    assert U.wrap("abcdefgh", 3) == ["abc", "def", "gh"]
    assert U.wrap("short", 10) == ["short"]


LIST = """<table><thead><tr><th><span>No</span></th></tr></thead><tbody><tr><td><a href="/show/a/1/">One</a><td>1100<td>Town<td>sum
<tr><td><a href="/show/a/1/">Again</a><td>x<td>y<td>z<tr><td>no link<td>1<td>2<td>3</tbody></table><table><thead><tr><th><span>Other</span></th></tr></thead></table>"""


def test_pages(spark):
    rows = U.list_page(LIST, "No", "/show/([^/]+/.+)/?", "http://h.example/list")
    assert rows == [{"url": "http://h.example/show/a/1/", "doc_id": "a/1", "title": "One", "date_raw": "1100", "city": "Town", "summary": "sum"}]
    doc = '<div class="text-area original-text">a&nbsp; b<br>c</div><div class="text-area">a b</div><table><tr><td>k<td>1<tr><td>k<td>2<tr><td>x</table><img src="/thumbs/photo_1.jpg"><img src="/x.png">'
    got = U.document_page(doc)
    assert got == {"main": "a b c", "spaced": "a b", "metadata": {"k": "2"}, "images": ["/thumbs/photo_1.jpg"]}
    assert U.document_page('<div class="text-area">only</div>')["main"] == "only"
    folio = '<ol><li><span class="os">сло</span><span class="os">во</span><li>no</ol><img id="smallImage" src="i.jpg">'
    assert U.folio_page(folio) == {"lines": ["слово"], "image": "i.jpg"}
    df = spark.createDataFrame([(doc, LIST, folio), (None, None, None)], "d string, l string, f string")
    out = df.select(U.parse_document(F.col("d")).alias("d"), U.parse_list(F.col("l"), "No", "/show/([^/]+/.+)/?", "http://h.example/").alias("l"), U.parse_folio(F.col("f")).alias("f")).collect()
    assert out[0].d.metadata == {"k": "2"} and len(out[0].l) == 1 and out[0].f.image == "i.jpg" and out[1].d is None
