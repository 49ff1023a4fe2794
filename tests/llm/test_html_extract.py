import html as H
import re

from textloom.llm import html_extract as X

FRAME = '<html><head><title>{t}</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy {t}</div><article><h1>{t}</h1>{body}</article><div class="comments"><p>nice {t}</p></div><footer>&copy; all rights</footer></body></html>'


def test_blocks():
    body = "<p><b>One&amp;two  &lt;x&gt;<br>three<p>four\n\tfive</p><div>six <i>sev</i>en</div><form>no<input></form><aside>no</aside><ul class='share-links'><li>no</ul><p>&eacute;&#233;&am"
    page = X.Page(FRAME.format(t="T", body=body))
    assert X.main_text(page, frozenset()) == "T\nOne&two <x> three\nfour five\nsix seven\néé&am"



def test_class_names_of_what_encloses_the_content():
    page = '<html class="{0}"><body class="{0}"><div class="{0}"><main class="{0}"><article id="{0}"><p>Text</p><div class="share">no</div></article></main></div></body></html>'
    for name in ("has-sidebar", "no-header", "with-menu", "privacy-notice", "share"):
        assert X.main_text(X.Page(page.format(name)), frozenset()) == "Text"
        bare = X.Page(f'<body class="{name}"><div class="{name}"><p>Text</p><footer>no</footer></div></body>')
        assert X.main_text(bare, frozenset()) == "Text"
    one = X.Page(page.format("share"))
    assert X.main_text(one, frozenset(X.tokens(one))) == "Text"
    assert X.main_text(X.Page('<body class="has-sidebar"><article><p>Text</p></article><div class="comments"><article>no</article></div><nav><article>no</article></nav></body>'), frozenset()) == "Text"
    assert X.main_text(X.Page('<div class="no-header"><p>Text</p></div><div class="ad"><p>no</p></div>'), frozenset()) == "Text"


def test_pages_without_article():
    text = "<body><div><p>Welcome to our site</p></div><div><p>Story {n} goes on</p></div><footer>x</footer>"
    pages = [X.Page(text.format(n=n)) for n in range(5)]
    each = [X.tokens(p) for p in pages]
    template = frozenset(t for t in each[0] if all(e[t] == 1 for e in each))
    assert X.main_text(pages[3], template) == "Story 3 goes on"
    assert X.main_text(pages[3], frozenset()) == "Welcome to our site\nStory 3 goes on"


def test_templates_are_whole_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "HELD", 7)
    rows = [(i, f"http://Host.example/{i % 2}", FRAME.format(t=f"t{i}", body="<p>a</p>" * i), "own") for i in range(12)]
    rows += [(20, None, None, "x"), (21, "", "", "x"), (22, "http://one.example/", "<p>alone " + "w " * 60000, "x"), (22, "http://one.example/", "<p>alone", "x"), (None, "no url", "<<<>& <p", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    found = {(r.host, r.token) for r in X.templates(df).collect()}
    assert ("host.example", "html/body/article") in found and ("host.example", "html/body/footer|rights") in found
    assert not any(h != "host.example" or "t3" in t or t.endswith("/ul/") for h, t in found)
    for limit in (1 << 20, 0):
        monkeypatch.setattr(X, "BROADCAST_BYTES", limit)
        out, name = X.extract(df)
        got = [(r.page_id, r[name]) for r in out.collect()]
        assert name == "_text" and len(got) == len(rows)
        assert all((i, "\n".join([f"t{i}", *["a"] * i])) in got for i in range(12))
        assert (20, "") in got and (21, "") in got and (22, "alone") in got
    assert X.extract(df.limit(0))[0].count() == 0


def test_query(spark, sf_dir):
    """Brute force for these pages: the article's blocks, cut at its tags."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = X.op7_html_extract(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
