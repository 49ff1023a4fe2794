"""Text, date, category and number functions as Column expressions.

Four bracket policies exist side by side and are never unified: ``editorial`` removes round brackets with
their content, ``unified`` deletes bracket characters and keeps the content, ``strip_square`` removes
square brackets with their content, ``drop_square`` deletes only the square bracket characters.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: White space as Unicode-aware string functions see it, for engines whose ``\\s`` is ASCII.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

# Editorial phrases, site names and century bounds of the corpus.
EDITORIAL = (
    r"\bоборот\b\s*:?",
    r"\bпервый\s+фрагмент\b\s*:?",
    r"\bвторой\s+фрагмент\b\s*:?",
    r"\bтретий\s+фрагмент\b\s*:?",
    r"\bчетвёртый\s+фрагмент\b\s*:?",
    r"\bфрагмент\s*\d+\s*:?",
    r"\bстрока\s*\d+\s*:?",
    r"\bдля\s+остатков\s+следующей\s+строки[^…\n]*",
)
SITES = (
    ("новгород", "Novgorod"),
    ("русса", "Staraya_Russa"),
    ("смоленск", "Smolensk"),
    ("псков", "Pskov"),
    ("торжок", "Torzhok"),
    ("тверь", "Tver"),
    ("рязань", "Staraya_Ryazan"),
    ("витебск", "Vitebsk"),
    ("вологда", "Vologda"),
    ("москва", "Moscow"),
    ("мстиславль", "Mstislavl"),
    ("переяславль", "Pereslavl"),
)
CENTURIES = ((1100, "XI"), (1200, "XII"), (1300, "XIII"), (1400, "XIV"))
CYRILLIC = r"[\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}\x{1C80}-\x{1C88}]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none stays at the ends."""
    return F.trim(F.regexp_replace(_text(c), f"{WS}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(_text(c), f"^{WS}+|{WS}+$", "")


def editorial(c: Column) -> Column:
    """Editorial phrases, ellipses and innermost round brackets (one pass) go; the input is in NFC.
    Only runs of plain spaces collapse, so tabs and line ends inside stay."""
    out = F.regexp_replace(_text(c), "(?iuU)" + "|".join(EDITORIAL), "")
    out = F.regexp_replace(F.regexp_replace(out, r"…+|\.{3,}", " "), r"\([^()]*\)", "")
    return F.regexp_replace(strip(F.regexp_replace(out, " {2,}", " ")), " {2,}", " ")


def unified(c: Column) -> Column:
    out = F.translate(F.replace(_text(c), F.lit(" "), F.lit(" ")), "…⁞()[]{}", "  ")
    return collapse(F.regexp_replace(out, "-{2,}", " "))


def strip_square(c: Column) -> Column:
    """Square brackets and what they hold, by depth: an unclosed one takes the rest, a stray closing one goes.
    Balanced brackets without nesting need one replacement; the fold over characters is for the others."""
    folded = F.aggregate(
        F.split(c, ""),
        F.struct(F.lit(0).alias("d"), F.lit("").alias("o")),
        lambda a, x: F.when(x == "[", F.struct((a.d + 1).alias("d"), a.o.alias("o")))
        .when(x == "]", F.struct(F.greatest(a.d - 1, F.lit(0)).alias("d"), a.o.alias("o")))
        .otherwise(F.struct(a.d.alias("d"), F.when(a.d == 0, F.concat(a.o, x)).otherwise(a.o).alias("o"))),
        lambda a: a.o,
    )
    plain = F.regexp_replace(c, r"\[[^\[\]]*\]", "")
    return collapse(F.when(plain.rlike(r"[\[\]]"), folded).otherwise(plain))


def drop_square(c: Column) -> Column:
    return F.translate(c, "[]", "")


def edition_markup(c: Column) -> Column:
    out = F.regexp_replace(_text(c), r"(?i)<telia>|<kopie>|<left\s+marginal>", "")
    return collapse(F.regexp_replace(out, rf"^[\d.{WS[1:-1]}]+", ""))


def safe_slug(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "x").otherwise(out)


def slug(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("/"), F.lit("__")), ".-", "__")


def basename(c: Column) -> Column:
    return F.regexp_extract(F.translate(c, "\\", "/"), "[^/]*$", 0)


def dirname(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), "/?[^/]*$", "")


def relative_to(c: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(c, F.lit(root)), F.substring(c, len(root) + 1, 1 << 30)).otherwise(c)


def url_join(base: str, c: Column) -> Column:
    """Absolute addresses pass; a leading slash replaces the path, anything else its last part. What begins
    with two slashes, a question mark or a number sign, or holds a part of dots, is joined in Python (only
    such values are handed over)."""
    odd = c.rlike(r"^(?://|[?#])|(?:^|/)\.\.?(?:[/?#]|$)|^$") & ~c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.when(odd, url_joined(F.lit(base), F.when(odd, c))).otherwise(_plain_join(base, c))


@arrow_udf(StringType())
def url_joined(base: pa.Array, part: pa.Array) -> pa.Array:
    return pa.array((None if b is None or p is None else urljoin(b, p) for b, p in zip(base.to_pylist(), part.to_pylist(), strict=True)), pa.string())


def _plain_join(base: str, c: Column) -> Column:
    root = F.lit(base).substr(1, base.find("/", base.find("//") + 2) if "/" in base[base.find("//") + 2 :] else len(base))
    folder = F.lit(base[: base.rfind("/") + 1])
    return F.when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), c).when(F.startswith(c, F.lit("/")), F.concat(root, c)).otherwise(F.concat(folder, c))


def id_from_url(c: Column, pattern: str) -> Column:
    """Group 1 of the pattern without closing slashes, else the address itself."""
    found = F.regexp_replace(F.regexp_extract(c, pattern, 1), "/+$", "")
    return F.coalesce(F.nullif(found, F.lit("")), c)


def xml_lines_joined(c: Column, tag: str = "Line", root: str = "HistoricalDocument") -> Column:
    """Elements without inner tags, in any case, joined without a separator; without any, the text without
    tags. Text without the root (in its own case) stays as it is."""
    found = F.regexp_extract_all(c, F.lit(f"(?i)<{tag}>([^<]*)</{tag}>"), F.lit(1))
    bare = F.when(F.size(found) > 0, F.array_join(found, "")).otherwise(F.regexp_replace(c, "<[^>]+>", ""))
    return F.when(F.contains(c, F.lit(f"<{root}")), bare).otherwise(c)


def xml_lines(c: Column, tags: tuple[str, ...] = ("Line", "TextLine", "TextRegion"), root: str = "HistoricalDocument", head: str = "Metadata") -> Column:
    """The bodies of the first of the tags that occurs, inner tags dropped, blank ones left out, joined by a
    space; else what follows the head without tags; text without the root stays as it is."""
    out = strip(F.regexp_replace(F.regexp_replace(c, f"(?is)^.*?</{head}>", ""), "<[^>]+>", " "))
    for tag in reversed(tags):
        bodies = F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}\b[^>]*>(.+?)</{tag}>"), F.lit(1))
        lines = F.transform(F.filter(bodies, lambda b: strip(b) != ""), lambda b: strip(F.regexp_replace(b, "<[^>]+>", "")))
        out = F.when(F.size(bodies) > 0, F.array_join(lines, " ")).otherwise(out)
    return F.when(F.contains(c, F.lit(f"<{root}")), out).otherwise(c)


def visible(c: Column) -> Column:
    """Characters other than white space, dashes and middle dots."""
    return F.regexp_count(_text(c), F.lit(rf"[^\-·{WS[1:-1]}]"))


def is_meaningful(c: Column, least: int = 5) -> Column:
    return visible(c) >= least


def mostly_script(c: Column, script: str = CYRILLIC, shortest: int = 12) -> Column:
    """Long enough, and a third of the letters, four at least, belong to the script."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    own = F.regexp_count(c, F.lit(rf"(?=\p{{L}}){script}"))
    return (F.length(c) >= shortest) & (letters > 0) & (own >= F.greatest(F.lit(4), F.floor(letters / 3).cast("int")))


def words(c: Column) -> Column:
    return F.when(collapse(c) == "", F.array().cast("array<string>")).otherwise(F.split(collapse(c), " "))


def first_lines(c: Column, k: int) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), 1, k), "\n")


def century(c: Column) -> Column:
    """By the mean of all runs of three or four digits."""
    years = F.transform(F.regexp_extract_all(_text(c), F.lit(r"\d{3,4}"), F.lit(0)), lambda x: x.cast("int"))
    mean = F.aggregate(years, F.lit(0), lambda a, x: a + x) / F.size(years)
    out = F.when(F.size(years) == 0, "unknown")
    for bound, name in CENTURIES:
        out = out.when(mean <= bound, name)
    return out.otherwise("XV")


def earliest_year(c: Column) -> Column:
    return F.array_min(F.transform(F.regexp_extract_all(_text(c), F.lit(r"\d{3,4}"), F.lit(0)), lambda x: x.cast("int")))


def bucket(c: Column, needles: tuple[tuple[str, str], ...] = SITES, other: str = "other") -> Column:
    """The name of the first needle that the lower-cased text contains."""
    low = F.lower(F.trim(_text(c)))
    out = F.when(F.contains(low, F.lit(needles[0][0])), needles[0][1])
    for needle, name in needles[1:]:
        out = out.when(F.contains(low, F.lit(needle)), name)
    return out.otherwise(other)


def glued(lines: Column) -> Column:
    """Stripped non-empty lines joined by a space, or without it and the hyphen where one ends in a hyphen."""
    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.replace(F.replace(F.array_join(kept, "\x01"), F.lit("-\x01"), F.lit("")), F.lit("\x01"), F.lit(" "))


def preferred(images: Column) -> Column:
    """The least photo, else the least drawing, else the least."""
    named = lambda part: F.array_min(F.filter(images, lambda x: F.contains(x, F.lit(part))))
    return F.coalesce(named("photo_"), named("drawing_"), F.array_min(images))


def shuffle_key(seed: object, *cols: Column) -> Column:
    """Seeded order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cols)))


def aligned_size(width: Column, height: Column, most: int = 451_584, least: int = 100_352, step: int = 28, rounded: bool = True) -> tuple[Column, Column]:
    """Scale into the pixel budget, then down to multiples of ``step``: rounded and at least ``step`` before
    that, or cut off."""
    pixels = width * height
    scale = F.when(pixels > most, F.sqrt(F.lit(most) / pixels)).when(pixels < least, F.sqrt(F.lit(least) / pixels))

    def side(x: Column) -> Column:
        scaled = F.greatest(F.lit(step), F.bround(x * scale)) if rounded else F.floor(x * scale)
        return F.greatest(F.lit(step), F.floor(F.coalesce(scaled, x) / step) * step).cast("int")

    return side(width), side(height)
