"""What the deduced template decides, against occurrence vectors built one by one."""

import random
from collections import Counter

import pytest

from textloom.llm import html_extract as X


def deduced(pages):
    """Tokens of valid classes of one host's pages, by whole vectors."""
    each = [X.tokens(X.Page(p)) for p in pages]
    vectors = {t: tuple(e[t] for e in each) for t in set().union(*each)}
    classes = Counter(vectors.values())
    share = lambda t: sum(n > 0 for n in vectors[t]) / len(pages)
    return {t for t, v in vectors.items() if classes[v] >= X.CLASS and share(t) >= (X.FIXED if "|#" in t else X.SUPPORT)}


def sentence(rng, n=12):
    return " ".join(rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor".split()) + str(rng.randrange(99)) for _ in range(n))


def plain_div(rng):
    """A page of nameless containers: a fixed bar, variable links beside, the text, a fixed end."""
    body = "".join(f"<p>{sentence(rng)}</p>" for _ in range(rng.randrange(8, 15)))
    links = "".join(f"<p>{sentence(rng, 2)}</p>" for _ in range(3))
    text = [" ".join(p.split()) for p in body.replace("<p>", "").split("</p>") if p]
    return f"<html><body><div class='x1'><p>Welcome to our pages</p></div><div class='x2'>{links}</div><div class='x3'><div class='x4'>{body}</div></div><div class='x5'><p>All rights kept here</p></div></body></html>", "\n".join(text)


def got(spark, pages):
    df = spark.createDataFrame([(i, f"http://h{h}.example/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    out, name = X.extract(df.repartition(4))
    return {r.page_id: r[name] for r in out.collect()}, df


def test_templates_like_whole_vectors(spark):
    rng = random.Random(4)
    pages = [(i % 3, plain_div(rng)[0] if i % 3 else f"<div><nav><ul><li>Home<li>x{i % 2}</ul></nav><article><p>Note to all</p><p>{sentence(rng)}</p></article></div>") for i in range(30)]
    _, df = got(spark, pages)
    found = {}
    for r in X.templates(df.repartition(7)).collect():
        found.setdefault(r.host, set()).add(r.token)
    assert found == {f"h{h}.example": deduced([p for k, p in pages if k == h]) for h in range(3)}


@pytest.mark.parametrize("bound", [1 << 25, 0])
def test_hosts_of_plain_containers(spark, monkeypatch, bound):
    monkeypatch.setattr(X, "BROADCAST_BYTES", bound)
    rng = random.Random(5)
    made = [plain_div(rng) for _ in range(12)]
    texts, _ = got(spark, [(0, p) for p, _ in made])
    assert [texts[i] for i in range(12)] == [t for _, t in made]
    assert all(X.main_text(X.Page(p), frozenset()) != t for p, t in made)  # it is the template that decides


def test_fixed_text_inside_articles(spark):
    rng = random.Random(6)
    body = [[sentence(rng) for _ in range(6)] for _ in range(10)]
    pages = ["<html><body><article>" + "".join(f"<p>{x}</p>" for x in b[:3]) + "<div><p>Follow us by letter</p></div>" + "".join(f"<p>{x}</p>" for x in b[3:]) + "</article></body></html>" for b in body]
    texts, _ = got(spark, [(0, p) for p in pages])
    assert [texts[i] for i in range(10)] == ["\n".join(b) for b in body]
    assert "Follow us" in X.main_text(X.Page(pages[0]), frozenset())


def test_copies_of_a_page_stay_whole(spark):
    rng = random.Random(7)
    page = "<html><body><article>" + "".join(f"<p>{sentence(rng)}</p>" for _ in range(5)) + "</article></body></html>"
    texts, _ = got(spark, [(0, page)] * 9 + [(0, page.replace("lorem", "lorum"))])
    assert set(texts.values()) == {X.main_text(X.Page(page), frozenset()), X.main_text(X.Page(page.replace("lorem", "lorum")), frozenset())}


def test_names_are_hints():
    page = X.Page("<article><p>One</p><div class='social-history'><p>Two</p></div><p class='ad'>Buy</p><p id='ad-slot-3'>Buy</p><p class='lead'>Three</p><div class='user-reviews'><p>no</p></div><div class='w-1/2'><p>Four</p></div></article><div class='user-reviews'><p>no</p></div>")
    assert X.main_text(page, frozenset()) == "One\nTwo\nThree\nFour"


def test_very_long_and_repeated_pages(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20000 + "</article>"
    texts, _ = got(spark, [(0, long), (0, long), (1, ""), (1, "<p>x")])
    assert texts[0] == texts[1] == "\n".join(["word & word"] * 20000) and texts[2] == "" and texts[3] == "x"
