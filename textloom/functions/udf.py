"""Arrow functions for what Spark has no expression for. All keep their rows and give null for null."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Texts with a character from here on may not be in NFC.
_MAYBE = r"[\x{0300}-\x{10FFFF}]"


@arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFC")


def with_nfc(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """``df`` with the column in NFC; only rows that may need it pass through Python."""
    to = to or column
    maybe = F.coalesce(F.col(column), F.lit("")).rlike(_MAYBE)
    return df.where(~maybe).withColumn(to, F.col(column)).unionByName(df.where(maybe).withColumn(to, nfc(F.col(column))))


def levenshtein(a: str, b: str) -> int:
    """Edit distance by code points, of texts of any length: bits of one integer are a column of the table
    (Myers, Hyyrö). Where the shorter text is the longer one with characters left out, it is the difference
    of their lengths."""
    if len(a) > len(b):
        a, b = b, a
    rest = iter(b)
    if all(c in rest for c in a):
        return len(b) - len(a)
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    differ = np.flatnonzero(x != y[: len(x)])
    first = int(differ[0]) if len(differ) else len(x)
    x, y = x[first:], y[first:]
    differ = np.flatnonzero(x[::-1] != y[len(y) - len(x) :][::-1])
    same = int(differ[0]) if len(differ) else len(x)
    x, y = x[: len(x) - same], y[: len(y) - same]
    if not len(x):
        return len(y)
    where = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x)}
    every, last = (1 << len(x)) - 1, 1 << len(x) - 1
    more, less, score = every, 0, len(x)
    for c in y.tolist():
        eq = where.get(c, 0)
        across = (((eq & more) + more) ^ more) | eq
        up, down = less | every & ~(across | more), more & across
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, down << 1 & every
        more, less = down | every & ~(eq | less | up), up & (eq | less)
    return score


@arrow_udf(IntegerType())
def edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((None if x is None or y is None else levenshtein(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)), pa.int32())


def align(a: str, b: str) -> list[tuple[str | None, str | None]]:
    """Global alignment (match 1, mismatch and gap -1; diagonal before up before left), rows by numpy.

    Along a row, a cell reached from the left is the best earlier cell less its distance: a running maximum.
    """
    if a == b:
        return list(zip(a, b, strict=True))
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    step = np.arange(len(y) + 1)
    rows = [-step]
    for i, c in enumerate(x, 1):
        last = rows[-1]
        best = np.concatenate([[-i], np.maximum(last[:-1] + np.where(y == c, 1, -1), last[1:] - 1)])
        rows.append(np.maximum.accumulate(best + step) - step)
    out: list[tuple[str | None, str | None]] = []
    i, j = len(x), len(y)
    while i or j:
        here = rows[i][j]
        if i and j and here == rows[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and (not j or here == rows[i - 1][j] - 1):
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


@arrow_udf(ArrayType(StructType().add("g", "string").add("p", "string")))
def aligned_pairs(gold: pa.Array, pred: pa.Array) -> pa.Array:
    rows = [None if g is None or p is None else [{"g": x, "p": y} for x, y in align(g, p)] for g, p in zip(gold.to_pylist(), pred.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("g", pa.string()), ("p", pa.string())])))


@arrow_udf(ArrayType(StructType().add("g", "string").add("p", "string").add("n", IntegerType()).add("at", IntegerType())))
def pair_counts(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """The different pairs of each row, how often they occur, and the place of g at the first of them."""
    known: dict[tuple, list[dict] | None] = {(None, None): None}

    def counted(g: str | None, p: str | None) -> list[dict] | None:
        if g is None or p is None:
            return None
        found: dict[tuple, list[int]] = {}
        at = 0
        for pair in align(g, p):
            found.setdefault(pair, [0, at])[0] += 1
            at += pair[0] is not None
        return [{"g": x, "p": y, "n": n, "at": at} for (x, y), (n, at) in found.items()]

    rows = []
    for key in zip(gold.to_pylist(), pred.to_pylist(), strict=True):
        if key not in known:
            known[key] = counted(*key)
        rows.append(known[key])
    return pa.array(rows, pa.list_(pa.struct([("g", pa.string()), ("p", pa.string()), ("n", pa.int32()), ("at", pa.int32())])))


def wrap(text: str, width: int) -> list[str]:
    """Lines of whole words within the width (a wider word has its own); one long word is cut by characters."""
    if len(text) <= width:
        return [text]
    parts = text.split()
    if len(parts) < 2:
        return [text[i : i + width] for i in range(0, len(text), max(1, width))] or [text]
    lines = [parts[0]]
    for word in parts[1:]:
        if len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines


@arrow_udf(ArrayType(StringType()))
def wrapped(text: pa.Array, width: pa.Array) -> pa.Array:
    return pa.array([None if t is None else wrap(t, w) for t, w in zip(text.to_pylist(), width.to_pylist(), strict=True)], pa.list_(pa.string()))


class Dom(HTMLParser):
    """A small tree: nodes are [tag, attributes, children]; text is a string among the children."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    #: A start tag closes open elements of these kinds, up to the given container.
    CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"div", "td", "body"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"})}

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes, within = self.CLOSES.get(tag, ((), ()))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in within:
                break
            if self.open[i][0] in closes:
                del self.open[i:]
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def find(node: list, *tags: str, **attrs: str) -> list[list]:
    """Descendants in page order with one of the tags; ``cls`` asks for a class, other names for a value."""
    out = []
    for child in node[2]:
        if isinstance(child, list):
            if child[0] in tags and all((v in child[1].get("class", "").split()) if k == "cls" else child[1].get(k) == v for k, v in attrs.items()):
                out.append(child)
            out += find(child, *tags, **attrs)
    return out


def texts(node: list) -> list[str]:
    return [t for c in node[2] for t in ([c] if isinstance(c, str) else texts(c))]


def text_of(node: list, between: str = "", stripped: bool = False) -> str:
    found = texts(node)
    if stripped:
        found = [s for t in found if (s := t.strip())]
    return between.join(found)


def _squeezed(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").split())


def list_page(html: str | None, header: str, link: str, base: str) -> list[dict]:
    """Rows of the tables whose first heading is ``header``: four cells at least, a link in the first; the
    first row of each address stays."""
    import re
    from urllib.parse import urljoin

    out: dict[str, dict] = {}
    for table in find(Dom(html).root, "table"):
        head, body = find(table, "thead"), find(table, "tbody")
        titles = [s for th in (find(head[0], "th") if head else []) for s in find(th, "span")]
        if not titles or text_of(titles[0], stripped=True) != header or not body:
            continue
        for tr in find(body[0], "tr"):
            cells = find(tr, "th", "td")
            links = [a for a in find(cells[0], "a") if "href" in a[1]] if len(cells) >= 4 else []
            if links:
                url = urljoin(base, links[0][1]["href"])
                m = re.search(link, url)
                first = text_of(links[0], stripped=True)
                row = {"url": url, "doc_id": m[1].rstrip("/") if m else url, "title": first}
                out.setdefault(url, row | {k: text_of(c, stripped=True) for k, c in zip(("date_raw", "city", "summary"), cells[1:4], strict=True)})
    return list(out.values())


def document_page(html: str | None, area: str = "text-area", original: str = "original-text", images: tuple[str, ...] = ("/thumbs/photo_", "/thumbs/drawing_")) -> dict:
    """Main and second text, a map of the two-cell rows (the last of a key counts), image addresses."""
    root = Dom(html).root
    areas = find(root, "div", cls=area)
    own = [d for d in areas if original in d[1].get("class", "").split()]
    squeezed = lambda d: _squeezed(text_of(d, "\n"))
    main = squeezed(own[0]) if own else squeezed(areas[0]) if len(areas) == 1 else ""
    pairs = [find(tr, "td") for table in find(root, "table") for tr in find(table, "tr")]
    meta = {k: v for tds in pairs if len(tds) == 2 for k, v in [[text_of(td, " ", True) for td in tds]] if k and v}
    found = {i[1]["src"] for i in find(root, "img") if any(part in i[1].get("src", "") for part in images)}
    return {"main": main, "spaced": squeezed(areas[1]) if len(areas) > 1 else None, "metadata": meta, "images": sorted(found)}


def folio_page(html: str | None, cls: str = "os", image: str = "smallImage") -> dict:
    """Lines of ordered lists that have spans of the class, and the address of the one image."""
    root, lines = Dom(html).root, []
    for ol in find(root, "ol"):
        for li in (c for c in ol[2] if isinstance(c, list) and c[0] == "li"):
            if line := "".join(text_of(s, stripped=True) for s in find(li, "span", cls=cls)).strip():
                lines.append(line)
    images = find(root, "img", id=image)
    return {"lines": lines, "image": images[0][1].get("src") if images else None}


LIST_ROW = "array<struct<url:string,doc_id:string,title:string,date_raw:string,city:string,summary:string>>"
DOCUMENT_ROW = "struct<main:string,spaced:string,metadata:map<string,string>,images:array<string>>"
FOLIO_ROW = "struct<lines:array<string>,image:string>"


def _parsed(html: Column, schema: str, kind: pa.DataType, parse) -> Column:
    @arrow_udf(schema)
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if h is None else parse(h) for h in pages.to_pylist()], kind)

    return run(html)


def parse_list(html: Column, header: str, link: str, base: str) -> Column:
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("url", "doc_id", "title", "date_raw", "city", "summary")]))
    return _parsed(html, LIST_ROW, kind, lambda h: list_page(h, header, link, base))


def parse_document(html: Column, **names) -> Column:
    kind = pa.struct([("main", pa.string()), ("spaced", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("images", pa.list_(pa.string()))])
    return _parsed(html, DOCUMENT_ROW, kind, lambda h: (d := document_page(h, **names)) | {"metadata": list(d["metadata"].items())})


def parse_folio(html: Column) -> Column:
    return _parsed(html, FOLIO_ROW, pa.struct([("lines", pa.list_(pa.string())), ("image", pa.string())]), folio_page)


# Names under which recognisers' JSON holds text, and lists of texts.
TEXT_NAMES = ("markdown", "text", "ocr_text", "content", "transcription", "rec_text")
LIST_NAMES = ("rec_texts",)


def harvested(node: object, names: frozenset[str], lists: frozenset[str], scalars: bool = False) -> list[str]:
    """Texts under the names (whatever their case) at any depth, in order. Explicit stack: depth has no bound."""
    out, todo = [], [(None, node)]
    while todo:
        name, x = todo.pop()
        if name in names and isinstance(x, str):
            out.append(x)
        elif name in names and scalars and x is not None and not isinstance(x, (dict, list)):
            out.append(json.dumps(x))
        elif name in lists and isinstance(x, list):
            out += [y if isinstance(y, str) else json.dumps(y) for y in x if y]
        elif isinstance(x, dict):
            todo += [(k.lower(), v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(None, v) for v in reversed(x)]
    return out


def harvest(c: Column, names: tuple[str, ...] = TEXT_NAMES, lists: tuple[str, ...] = LIST_NAMES, scalars: bool = False) -> Column:
    """array<string> of a JSON text's harvest; none for what is null or no JSON. ``scalars``: numbers and
    booleans count as texts too."""
    wanted, listed = frozenset(n.lower() for n in names), frozenset(n.lower() for n in lists)

    @arrow_udf(ArrayType(StringType()))
    def run(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            try:
                out.append(harvested(json.loads(t), wanted, listed, scalars) if t else [])
            except ValueError:
                out.append([])
        return pa.array(out, pa.list_(pa.string()))

    return run(c)
