"""Main text of web pages by deducing each host's template from its pages.

Deduction. A page becomes tokens: each container with its path of enclosing containers, each word outside
an article with its path, and each block of text inside one. A token's occurrence vector says how often it
is on each page of the host. Vectors are never built: each page adds a hash of (page, count) to its tokens'
sums, so tokens of equal vectors have equal sums, pre-aggregated like any other. Tokens of equal vectors
form a class; it is valid if it has at least CLASS tokens and is on SUPPORT of the host's pages (for blocks
inside articles: FIXED). Containers of valid classes nest by their paths into the host's template; valid
words and blocks are its fixed text.

Extraction. What lies between template tokens are slots. Of the template's containers, articles and main
regions hold the content: their slots are extracted, without nested menus, adverts, forms and the like, and
without fixed blocks (unless these are more than a fourth of the region: then the page is a copy, and the
text its own). Where a host's template has neither, a page's own article or main region serves. A page
without either has its content where its host's variable text is: from the outermost container on, the
template is followed into the one container that holds DOMINANT of the variable text of all pages, as long
as there is one; the slots there that are more than fixed text are extracted. Hosts of fewer than PAGES
pages have no template, and all such a page's text outside of menus and the like is its content.

Names of classes and ids are hints for what the template can't tell. A name tells of an aside only if all its
words do (share-links, but not social-history). They never reject html, body, or an article or main region
itself, nor do those that say what a page has or lacks (has-sidebar, no-header). They choose among regions,
an article among comments being none; but where they would reject every region, or all slots, element names
alone decide about what encloses a region, or about the slots.

Text inside a block has its references decoded and white space made one space; ``<br>`` is white space.
Blocks follow in page order, one newline between them.

Defined results: null and empty pages give an empty text; rows without a url share one nameless host;
repeated rows are pages of their own (copies of an article stay whole); classes of equal size both hold, so
ties need no order, and of containers with equal variable text none dominates; very long pages are read
whole; columns of the input stay, and the new one gets an underscore in front where its name is taken; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import _common as C

#: Share of a host's pages that a valid class is on, its tokens, and the pages a host needs.
SUPPORT, CLASS, PAGES = 0.5, 2, 4
#: Share of a host's pages that a block inside articles is on if it is fixed text, and the largest share of an
#: article's text that such blocks may have.
FIXED, MOSTLY = 0.8, 0.25
#: Share of a container's variable text that the next one has where content is told by it.
DOMINANT = 0.8
#: Templates are broadcast up to so many bytes, and joined by host beyond.
BROADCAST_BYTES = 32 << 20
#: (host, token) pairs that a task adds up before it passes them on.
HELD = 100_000

# Element names and words of class names, by their use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html head body article main section div nav header footer aside form ul ol table noscript template svg button select textarea iframe object canvas dialog title script style".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd tr td th thead tbody tfoot caption blockquote pre figure figcaption address fieldset legend details summary hr hgroup option".split())
ASIDE = frozenset("head title nav header footer aside form noscript template svg button select textarea iframe object canvas dialog script style".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices comment comments review reviews reply replies disqus promo popup modal share sharing social related subscribe signup newsletter widget widgets sponsored sponsor".split())
#: Words that say nothing beside one of those.
PLAIN_WORDS = frozenset("bar block body bottom box button buttons area card cell col column container content form global group icons id inner item items js left link links list main outer page panel post posts primary right row secondary section site slot text title top unit user users wrap wrapper".split())
CONTENT = frozenset(("article", "main"))
#: First words of class names that describe a page instead of naming a part of it.
STATES = frozenset(("has", "no", "with", "without"))

_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Page(HTMLParser):
    """Containers (with their paths, in page order) and blocks (path, text) of a page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.containers: list[tuple[str, ...]] = []
        self.blocks: list[tuple[tuple[str, ...], str]] = []
        self.path: list[str] = []
        self.names: list[str] = []
        self.text: list[str] = []
        self.own: str | None = None
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.blocks.append((tuple(self.path) if self.own is None else (*self.path, self.own), text))
            self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            label = tag
            for name, value in attrs:
                if name in ("class", "id") and value:
                    label += "." + ".".join(value.replace("/", "_").split())
                elif name == "role" and value == "main" or name == "itemprop" and value == "articleBody":
                    label += ":content"
            # A paragraph and the like counts as a label of its own text only if it has a name.
            self.own = label if label != tag and tag not in CONTAINERS else None
            if tag in CONTAINERS:
                self.names.append(tag)
                self.path.append(label)
                self.containers.append(tuple(self.path))
        elif tag == "br":
            self.text.append(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in CONTAINERS and tag in ("svg", "iframe", "object", "canvas"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.own = None
            if tag in self.names:
                while self.names.pop() != tag:
                    self.path.pop()
                self.path.pop()

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def _aside_element(label: str) -> bool:
    return label.split(".")[0].split(":")[0] in ASIDE


def _aside(label: str) -> bool:
    if _aside_element(label):
        return True
    name, *classes = label.split(".")
    if name in ("html", "body") or _content(label):
        return False
    return any(_tells(c.lower()) for c in classes)


@functools.cache
def _tells(name: str) -> bool:
    """Do all words of a class or id say that what it names is beside the content?"""
    parts = [x for x in re.split(r"[-_:]+", name) if x and not x[0].isdigit()]
    return not ASIDE_WORDS.isdisjoint(parts) and all(x in ASIDE_WORDS or x in PLAIN_WORDS for x in parts)


def _content(label: str) -> bool:
    return label.split(".")[0].split(":")[0] in CONTENT or label.endswith(":content")


def block_token(path: tuple[str, ...], text: str) -> str:
    return f"{'/'.join(path)}|#{xxhash.xxh64_hexdigest(text)}"


def tokens(page: Page) -> Counter:
    """Template tokens of a page: containers, words outside content, blocks inside, each with its path."""
    out = Counter("/".join(path) for path in page.containers)
    for path, text in page.blocks:
        if any(map(_content, path)):
            out[block_token(path, text)] += 1
        else:
            where = "/".join(path) + "|"
            out.update(where + w for w in text.split())
    return out


def masses(page: Page) -> Counter:
    """Characters of text inside each container of a page."""
    out: Counter = Counter()
    for path, text in page.blocks:
        for i in range(1, len(path) + 1):
            out["/".join(path[:i])] += len(text)
    return out


def content_path(rows: list[tuple[str, int]]) -> str | None:
    """Where a host's variable text is: (token, characters over all pages) of its template to a container's
    path; None where the template has an article or main region, or no container dominates."""
    text = {token: n for token, n in rows if "|" not in token}
    if any(_content(token.rsplit("/", 1)[-1]) for token in text):
        return None
    inside: dict[str, list[str]] = {}
    for token in text:
        inside.setdefault(token.rpartition("/")[0], []).append(token)
    for token, n in rows:
        if "|" in token:
            path = token.split("|", 1)[0]
            while path:
                if path in text:
                    text[path] -= n
                path = path.rpartition("/")[0]
    at = ""
    while True:
        whole = text[at] if at else max((text[t] for t in inside.get("", [])), default=0)
        best = max((t for t in inside.get(at, []) if not _aside_element(t.rsplit("/", 1)[-1])), key=lambda t: (text[t], t), default=None)
        if best is None or whole <= 0 or text[best] < DOMINANT * whole:
            return at if at.count("/") > 1 else None
        at = best


def main_text(page: Page, template: frozenset[str], where: str | None = None) -> str:
    """The content slots of a page under its host's template (empty: none was deduced), whose variable text is
    in the container ``where``."""

    def region(path: tuple[str, ...], fixed: bool) -> int:
        """How many labels lead to the innermost content container, 0 without one."""
        return next((i for i in range(len(path), 0, -1) if _content(path[i - 1]) and (not fixed or "/".join(path[:i]) in template)), 0)

    for fixed in (True, False):
        if fixed and not template:
            continue
        inside = [(region(path, fixed), path, text) for path, text in page.blocks]
        regions = [path[:n] for path in page.containers if (n := region(path, fixed))]
        if regions:
            # An article in a sidebar or among comments is no content, nor is an aside in an article. Where
            # class names leave no region, only element names count around it.
            chosen = any(not any(map(_aside, r)) for r in regions)
            around = _aside if chosen else _aside_element
            kept = [(path, text) for n, path, text in inside if n and not any(map(around, path[:n])) and not any(map(_aside, path[n:]))]
            same = [bool(template) and block_token(path, text) in template for path, text in kept]
            if sum(len(t) for (_, t), f in zip(kept, same, strict=True) if f) > MOSTLY * sum(len(t) for _, t in kept):
                same = [False] * len(kept)
            return "\n".join(text for (_, text), f in zip(kept, same, strict=True) if not f)
    slots = [(path, text) for path, text in page.blocks if not all("/".join(path) + "|" + w in template for w in text.split())]
    if where and (there := [(path, text) for path, text in slots if ("/".join(path) + "/").startswith(where + "/")]):
        slots = there
    named = [text for path, text in slots if not any(map(_aside, path))]
    return "\n".join(named or [text for path, text in slots if not any(map(_aside_element, path))])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, token, chars) of all valid classes; chars are a container's text, or a word's own, on all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[int]] = {}

        def partial() -> pa.RecordBatch:
            keys, sums = list(held), list(held.values())
            signed = [s[0] - (1 << 64) if s[0] >= 1 << 63 else s[0] for s in sums]
            numbers = [signed, [s[1] for s in sums], [s[2] for s in sums]]
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array(x, pa.int64()) for x in numbers]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["host", "token", "vector", "pages", "chars"])

        for batch in batches:
            for url, html in zip(batch.column(0), batch.column(1), strict=True):
                host, text = host_of(url.as_py()), html.as_py() or ""
                name = xxhash.xxh64_intdigest(f"{url.as_py()}\n{text}")
                page = Page(text)
                mass = masses(page)
                for token, n in [*tokens(page).items(), ("", 1)]:
                    own = held.setdefault((host, token), [0, 0, 0])
                    own[0] = (own[0] + xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed=name)) & (1 << 64) - 1
                    own[1] += 1
                    bar = token.find("|")
                    own[2] += mass.get(token, 0) if bar < 0 else n * (len(token) - bar)
                if len(held) >= HELD:
                    yield partial()
        yield partial()

    # Sums of halves can't overflow, and tasks that split a host's pages differently must agree on them:
    # they are brought back to one sum modulo 2^64.
    found = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "host string, token string, vector bigint, pages bigint, chars bigint")
    low, high = F.expr("vector & 4294967295"), F.shiftrightunsigned("vector", 32)
    summed = found.groupBy("host", "token").agg(F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    carried = summed.withColumn("high", F.expr("(high + shiftrightunsigned(low, 32)) & 4294967295")).withColumn("low", F.expr("low & 4294967295"))
    summed = C.written(carried, "tokens")
    hosts = summed.where("token = ''").where(F.col("pages") >= PAGES).select("host", F.col("pages").alias("all"))
    if hosts.count() * 64 <= BROADCAST_BYTES:
        hosts = F.broadcast(hosts)
        often = summed.where("token <> ''").join(hosts, "host")
    else:  # a host of many tokens is dealt over tasks
        often = C.even_join(summed.where("token <> ''"), hosts, "host", "token")
    often = often.where(F.col("pages") >= F.when(F.contains("token", F.lit("|#")), F.lit(FIXED)).otherwise(SUPPORT) * F.col("all"))
    classes = often.groupBy("host", "low", "high", "pages").agg(F.collect_list(F.struct("token", "chars")).alias("tokens")).where(F.size("tokens") >= CLASS)
    return classes.select("host", F.inline("tokens"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with the main text of each; returns it and the column's name."""
    spark = pages.sparkSession
    found = C.written(templates(pages, url_col, html_col), "templates")
    size = found.agg(F.sum(F.length("token") + F.length("host") + 100)).first()[0] or 0
    name = C.free_name(pages.columns, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), f"`{name}` string"])
    html, url, host, own = (C.free_name([*pages.columns, name], n) for n in ("html_", "url_", "host_", "template_"))
    given = pages.withColumn(html, F.col(html_col)).withColumn(url, F.col(url_col))
    if size <= BROADCAST_BYTES:
        rows: dict[str, list[tuple[str, int]]] = {}
        for r in found.collect():
            rows.setdefault(r["host"], []).append((r["token"], r["chars"]))
        sent = spark.sparkContext.broadcast({h: (frozenset(t for t, _ in x), content_path(x)) for h, x in rows.items()})
    else:
        sent = None
        by_host = found.groupBy("host").agg(F.collect_list(F.struct("token", "chars")).alias(own)).withColumnRenamed("host", host)
        hosted = given.withColumn(host, F.lower(F.coalesce(F.regexp_extract(url, _HOST.pattern, 1), F.lit(""))))
        given = C.even_join(hosted, by_host, host, html, "left").select(*pages.columns, html, url, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pages_columns)
        for batch in batches:
            out = []
            for i in range(len(batch)):
                text, address = (batch.column(n + k)[i].as_py() for k in (0, 1))
                if sent:
                    template, where = sent.value.get(host_of(address), (frozenset(), None))
                else:
                    tokens_ = [(x["token"], x["chars"]) for x in batch.column(n + 2)[i].as_py() or ()]
                    template, where = frozenset(t for t, _ in tokens_), content_path(tokens_)
                out.append(main_text(Page(text or ""), template, where))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string())], names=[*batch.schema.names[:n], name])

    pages_columns = pages.columns
    return given.mapInArrow(run, schema), name


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out, name = extract(pages)
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


QUERIES = {"op7_html_extract": op7_html_extract}
