"""Personal data by weak supervision, in DataFrame and SQL expressions only.

1. Candidates. Regular expressions mark every match in the whole text; splitting at the marks gives the
   matches and, by summing lengths, their places in code points. The four base kinds are found by their
   fixed definitions; other kinds (local phone numbers, social security numbers, account numbers, names
   with a title or from a list, keys and tokens) are only candidates, as are base matches that fail their
   check.
2. Votes. Four labelers say yes (1), no (-1) or nothing (0) for each: form (checks and ranges of the kind),
   gazetteer (lists: endings, issuers, country codes, area codes, given names, prefixes of keys), context
   (the nearest telling word before the match speaks for its own kind or against all) and shape.
3. Expectation-maximisation over the counts of (kind, votes) estimates, without labels, how common yes is in
   each kind and how reliable each labeler is in all of them: what the base kinds show about a labeler
   speaks for the others too. A logistic classifier over kind, votes, both together, length and share of
   digits is then fitted to the posteriors; it decides spans.
4. Base spans stay. A candidate of another kind is added where the classifier gives it ADD or more and it
   overlaps no base span.

Only counts by (kind, votes, length, digits), at most KINDS * 81 * 12 rows, reach the driver; everything
else is expressions over one row, so neither hot groups nor long texts move between tasks. The patterns are
written without backtracking, and match what the plain definitions match in linear time; texts without a
digit or ``@`` skip most of them.

Defined results: null and empty texts have no spans; repeated rows and rows without an id are handled one by
one; of overlapping spans of two kinds beyond the base the first kind stays; very long texts are searched whole; an
empty table gives an empty result and untrained weights, which add nothing; columns of the input stay,
whatever their names, and the new one gets an underscore in front where its name is taken.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import _common as C

#: Marks a match's ends; where a text holds it, U+FFFD stands in, of the same length and in no pattern.
MARK, STAND_IN = chr(0xE000), chr(0xFFFD)
BASE = ("email", "ip", "card", "phone")
OTHER = ("phone_local", "ssn", "iban", "name", "secret")
LABELERS = ("form", "gazetteer", "context", "shape")
#: Least probability of an added span.
ADD = 0.9
#: Characters before a match in which the context labeler looks.
CONTEXT = 40
#: Parts folded at a time, so that summing lengths stays near linear in the matches of a text.
RUN = 64

# Lists the gazetteer and context labelers look up.
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Michelle Amanda Laura Rebecca "
    "Hans Peter Klaus Wolfgang Jürgen Dieter Stefan Andreas Uwe Günter Ursula Monika Petra Sabine Renate Helga Karin Brigitte Ingrid Heike "
    "Jean Pierre Michel Philippe Alain Jacques Bernard François Christophe Nathalie Isabelle Sylvie Catherine Martine Véronique Françoise Céline Valérie "
    "José Antonio Manuel Francisco Juan Carlos Javier Miguel Alejandro Carmen María Josefa Isabel Pilar Dolores Teresa Lucía Ana Elena"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
NOT_NAMES = "Street Road Avenue University Hospital School College Church Award Prize River Lake Museum Park Pepper Strange Bank Platz Straße Rue Calle".split()
DOMAINS = "com org net edu gov mil io co info biz dev app de fr es uk eu ch at it nl be se no dk pl pt ca us au jp cn in br mx".split()
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk_live_ sk-proj- rk_live_ xoxb- xoxp- AIza eyJ".split()
FAKE_SSN = ("078-05-1120", "219-09-9999", "123-45-6789")
IBAN_SIZES = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_PHONE_WORDS = "phone tel telephone call mobile fax cell telefon anruf handy téléphone appelez teléfono llame móvil".split()
#: kind: words that tell of it.
YES_WORDS = {
    "email": "mail email e-mail contact adresse kontakt correo write schreiben écrire".split(),
    "ip": "ip host server address login adresse serveur servidor".split(),
    "card": "card visa mastercard amex payment karte carte tarjeta".split(),
    "phone": _PHONE_WORDS,
    "phone_local": _PHONE_WORDS,
    "ssn": "ssn social security taxpayer".split(),
    "iban": "iban account bank konto compte cuenta".split(),
    "name": "name named dear contact signed attn patient customer herrn kunde nom client nombre cliente".split(),
    "secret": "token key apikey secret password passwd bearer credential credentials auth passwort clave".split(),
}
NO_WORDS = "version order invoice isbn issn figure fig page chapter total price ticket part model commit checksum build bestellung seite preis commande prix pedido página precio".split()

_LOCAL = "[A-Za-z0-9._%+-]"
_ORDINARY_WORD = r"\p{Lu}\p{L}+"
#: kind: pattern. A start inside a run can only match where the run's start does, so runs are entered at
#: their start, or where the last match ended (\G); possessive quantifiers give up what could not help.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])",
    "name": rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.? {_ORDINARY_WORD}|(?:{'|'.join(GIVEN_NAMES)}) {_ORDINARY_WORD})",
}
#: kind: what a text must hold for the pattern to be tried.
NEEDS = {"email": "instr(__t, '@') > 0", "phone": "instr(__t, '+') > 0", "name": None, "iban": "__digit"}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(words: Sequence[str]) -> str:
    """A pattern for any of the words as a word, whatever its case."""
    return r"(?i)(?<!\p{L})(?:" + "|".join(dict.fromkeys(words)) + r")(?!\p{L})"


def matches(kind: str) -> Column:
    """array<struct<kind, start, end, value, before>> of all leftmost non-overlapping matches in __t."""
    parts = f"split(regexp_replace(__t, {_quoted(PATTERNS[kind])}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    # Odd parts are matches. Runs of parts get their first place from the lengths of the runs before them.
    found = f"""
    flatten(transform(__runs.runs, (run, k) -> aggregate(run,
      struct(__runs.firsts[k] AS place, CAST(0 AS INT) AS i, '' AS last, CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, end: INT, value: STRING, before: STRING>>) AS found),
      (acc, x) -> struct(acc.place + length(x) AS place, acc.i + 1 AS i, x AS last,
        CASE WHEN acc.i % 2 = 1 THEN array_append(acc.found, struct('{kind}' AS kind, acc.place AS start, acc.place + length(x) AS end, x AS value, right(acc.last, {CONTEXT}) AS before)) ELSE acc.found END AS found),
      acc -> acc.found)))"""
    # A run starts with the text before its first match, so every run has an even number of parts.
    runs = f"transform(sequence(0, (size(__parts) - 1) div {RUN}), k -> slice(__parts, k * {RUN} + 1, {RUN}))"
    firsts = "aggregate(__all, array(0), (acc, run) -> array_append(acc, element_at(acc, -1) + aggregate(run, 0, (n, x) -> n + length(x))))"
    # Each step is bound by a one-element transform, so that no expression is evaluated twice.
    bound = f"transform(array({parts}), __parts -> CASE WHEN size(__parts) < 2 THEN NULL ELSE transform(array({runs}), __all -> transform(array(struct(__all AS runs, {firsts} AS firsts)), __runs -> {found})[0])[0] END)[0]"
    need = NEEDS.get(kind, "__digit")
    return F.expr(f"CASE WHEN {need} THEN {bound} END" if need else bound)


def _valid(kind: str, v: str) -> str:
    """SQL: does the value pass its base kind's check?"""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"{v} RLIKE {_quoted(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    doubled = "array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)"
    digit = "CAST(substring(__d, length(__d) - i + 1, 1) AS INT)"
    luhn = f"aggregate(sequence(1, length(__d)), 0, (n, i) -> n + CASE WHEN i % 2 = 1 THEN {digit} ELSE {doubled}[{digit}] END) % 10 = 0"
    return f"exists(array({digits}), __d -> CASE WHEN length(__d) BETWEEN 12 AND 19 THEN {luhn} ELSE false END)"


def _mod97(v: str) -> str:
    """SQL: the remainder of an account number whose first four characters go last."""
    plain = f"replace({v}, ' ', '')"
    step = "(CASE WHEN c RLIKE '[0-9]' THEN n * 10 + CAST(c AS INT) ELSE n * 100 + ascii(c) - 55 END) % 97"
    return f"aggregate(split(concat(substring({plain}, 5), left({plain}, 4)), ''), 0, (n, c) -> CASE WHEN c = '' THEN n ELSE {step} END)"


def _either(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE -1 END"


def _votes(kind: str, v: str, before: str, valid: str) -> dict[str, str]:
    """SQL for each labeler's vote."""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    last_word = f"regexp_extract({v}, '([^ ]+)$', 1)"
    form = {
        "phone_local": _either(f"{digits} RLIKE '^[2-9][0-9]{{2}}[2-9]'"),
        "ssn": _either(f"{v} RLIKE '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)'"),
        "iban": _either(f"{_mod97(v)} = 1"),
        "name": f"CASE WHEN {last_word} IN ({', '.join(map(_quoted, NOT_NAMES))}) THEN -1 WHEN {last_word} RLIKE {_quoted(r'^\p{Lu}\p{Ll}{2,}$')} THEN 1 ELSE 0 END",
        "secret": f"CASE WHEN length({v}) > 128 OR {v} RLIKE '^[A-Za-z]+(?:[-_]+[A-Za-z]*[0-9]*)*$' THEN -1 WHEN {v} RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$' OR {v} RLIKE '[0-9][A-Za-z]+[0-9]+[A-Za-z]' THEN 1 ELSE 0 END",
    }.get(kind, _either(valid))
    sizes = " ".join(f"WHEN {_quoted(c)} THEN {n}" for c, n in IBAN_SIZES.items())
    gazetteer = {
        "email": f"CASE WHEN lower(element_at(split({v}, '[.]'), -1)) IN ({', '.join(map(_quoted, DOMAINS))}) THEN 1 ELSE 0 END",
        "card": _either(f"{digits} RLIKE '^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))'"),
        "phone": _either(f"{digits} RLIKE '^(?:1|3[0-9]|4[0-9]|5[0-9]|7|8[1246]|9[0-58])'"),
        "phone_local": _either(f"{digits} RLIKE '^(?![2-9]11|[2-9]9|37|96)'"),
        "ssn": f"CASE WHEN {v} IN ({', '.join(map(_quoted, FAKE_SSN))}) THEN -1 ELSE 0 END",
        "iban": f"CASE WHEN length(replace({v}, ' ', '')) = CASE left({v}, 2) {sizes} END THEN 1 ELSE -1 END",
        "ip": f"CASE WHEN {v} RLIKE '^(?:0|127|255)[.]' THEN -1 ELSE 0 END",
        "name": f"CASE WHEN {v} RLIKE {_quoted('(?:^| )(?:' + '|'.join(GIVEN_NAMES) + ')(?: |$)')} THEN 1 ELSE 0 END",
        "secret": f"CASE WHEN {v} RLIKE {_quoted('^(?:' + '|'.join(KEY_PREFIXES) + ')')} THEN 1 ELSE 0 END",
    }[kind]
    nearest = f"lower(try_element_at(regexp_extract_all({before}, {_quoted(_words([*YES_WORDS[kind], *NO_WORDS]))}, 0), -1))"
    own = ", ".join(map(_quoted, YES_WORDS[kind]))
    context = f"coalesce(transform(array({nearest}), w -> CASE WHEN w IS NULL THEN 0 WHEN w IN ({own}) THEN 1 ELSE -1 END)[0], 0)"
    glued = rf"{before} RLIKE '[\\p{{L}}_#{'' if kind == 'secret' else '='}/]$'"
    plain = {
        "card": f"length({digits}) = 16",
        "phone": f"length({digits}) BETWEEN 10 AND 13",
        "email": f"length({v}) BETWEEN 6 AND 60",
        "iban": f"length({v}) BETWEEN 15 AND 42",
        "name": f"{before} RLIKE '[\\p{{Ll}},:][ ]$'",
        "secret": rf"{before} RLIKE '[=:] ?[\'\"]?$'",
    }.get(kind, "true")
    return {"form": form, "gazetteer": gazetteer, "context": context, "shape": f"CASE WHEN {glued} THEN -1 WHEN {plain} THEN 1 ELSE 0 END"}


#: Fields of a span that the classifier sees beside its kind and votes.
TRAITS = {"size": "least(3, length(m.value) div 10)", "digits": "least(2, 3 * length(regexp_replace(m.value, '[^0-9]', '')) div length(m.value))"}


def _judged(kind: str) -> str:
    """SQL: the matches in column __m_kind with their votes and base check."""
    votes = _votes(kind, "m.value", "m.before", "ok")
    fields = ", ".join(f"CAST({sql} AS TINYINT) AS {name}" for name, sql in (votes | TRAITS).items())
    base = f"({_valid(kind, 'm.value')})" if kind in BASE else "false"
    rank = (BASE + OTHER).index(kind)
    judged = f"transform(__m_{kind}, m -> transform(array({base}), ok -> struct(m.start AS start, {rank} AS rank, m.kind AS kind, m.end AS end, ok AS base, {fields}))[0])"
    # A failed card or the like that is too short to be one is no candidate at all.
    keep = {"card": "x.base OR x.end - x.start BETWEEN 12 AND 40", "phone": "x.base OR x.end - x.start >= 10"}.get(kind)
    if kind == "secret":  # letters and digits; neither a word nor a number
        judged = judged.replace(f"__m_{kind}", f"filter(__m_{kind}, m -> m.value RLIKE '[0-9]' AND m.value RLIKE '[A-Za-z]')")
    return f"filter({judged}, x -> {keep})" if keep else judged


SPAN = "struct<start:int,rank:int,kind:string,end:int,base:boolean,form:tinyint,gazetteer:tinyint,context:tinyint,shape:tinyint,size:tinyint,digits:tinyint>"


def candidates(df: DataFrame, text_col: str = "text", to: str = "candidates") -> DataFrame:
    """``df`` with the array column ``to``: every candidate span with its votes, by place and kind."""
    kinds = BASE + OTHER
    # The table's own columns travel in one, so that none of its names is in the way.
    t = df.select(F.struct("*").alias("__row"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(STAND_IN)).alias("__t"))
    t = t.withColumn("__digit", F.col("__t").rlike("[0-9]"))
    t = t.select("__row", *(matches(k).alias(f"__m_{k}") for k in kinds))
    empty = f"CAST(array() AS ARRAY<{SPAN}>)"
    every = ", ".join(f"coalesce({_judged(k)}, {empty})" for k in kinds)
    return t.withColumn("__all", F.expr(f"array_sort(concat({every}))")).select("__row.*", F.col("__all").alias(to))


# --- estimation, over counts by (kind, votes) ---------------------------------------------------------

#: kind, votes, number of spans; then, if known, their traits.
Cell = tuple[str, tuple[int, ...], float] | tuple[str, tuple[int, ...], float, tuple[int, ...]]
Table = list[dict[int, tuple[float, float]]]


#: Largest share of yes in a kind. Nearer to 1, a kind that only one labeler speaks for would believe it always.
SURE = 0.9


def estimated(cells: list[Cell], rounds: int = 50) -> tuple[dict[str, float], Table]:
    """EM for a latent yes/no per candidate: each kind's share of yes, and per labeler vote -> (P if yes,
    P if no), which all kinds share.

    Labelers are taken as independent given the truth. They start as right in four of five votes, so
    yes means yes, and counts are smoothed by one.
    """
    n = len(LABELERS)
    shares = {cell[0]: 0.5 for cell in cells}
    table = [{1: (0.6, 0.15), -1: (0.15, 0.6), 0: (0.25, 0.25)} for _ in range(n)]
    for _ in range(rounds if cells else 0):
        yes = [{v: 1.0 for v in (1, -1, 0)} for _ in range(n)]
        no = [{v: 1.0 for v in (1, -1, 0)} for _ in range(n)]
        found = {kind: [1.0, 2.0] for kind in shares}
        for kind, votes, weight, *_ in cells:
            p = posterior(votes, shares[kind], table)
            found[kind][0] += weight * p
            found[kind][1] += weight
            for i, v in enumerate(votes):
                yes[i][v] += weight * p
                no[i][v] += weight * (1 - p)
        shares = {kind: min(SURE, max(1 - SURE, a / b)) for kind, (a, b) in found.items()}
        table = [{v: (yes[i][v] / sum(yes[i].values()), no[i][v] / sum(no[i].values())) for v in (1, -1, 0)} for i in range(n)]
    return shares, table


def reliabilities(cells: list[Cell], rounds: int = 50) -> tuple[float, Table]:
    """The share of yes among all candidates, and the labelers' table."""
    shares, table = estimated(cells, rounds)
    total = sum(cell[2] for cell in cells)
    return (sum(shares[cell[0]] * cell[2] for cell in cells) / total if total else 0.5), table


def posterior(votes: Sequence[int], share: float, table: Table) -> float:
    log = math.log(share) - math.log(1 - share) + sum(math.log(table[i][v][0]) - math.log(table[i][v][1]) for i, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))


def features(kind: str, votes: Sequence[int], traits: Sequence[int] = ()) -> list[str]:
    """Names of a span's features: as they stand in the weights."""
    plain = [f"{name}={v}" for name, v in [*zip(LABELERS, votes, strict=True), *zip(TRAITS, traits)]]
    return [f"kind={kind}", *plain, *(f"{kind}&{name}" for name in plain)]


#: How much harder than a vote alone a vote's meaning in one kind is held to 0.
HELD = 20.0


def fit(cells: list[Cell], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier over ``features``, fitted to EM's posteriors; no cells: none."""
    if not cells:
        return {}
    shares, table = estimated(cells)
    rows = [(features(kind, votes, *traits), weight, posterior(votes, shares[kind], table)) for kind, votes, weight, *traits in cells]
    # Rare cells must count too: weights grow with the square root of the count.
    rows = [(names, math.sqrt(weight), p) for names, weight, p in rows]
    whole = sum(w for _, w, _ in rows)
    weights = {name: 0.0 for names, _, _ in rows for name in names}
    for _ in range(rounds):
        slope = {name: decay * (HELD if "&" in name else 1.0) * w for name, w in weights.items()}
        for names, w, p in rows:
            z = sum(weights[name] for name in names)
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p
            for name in names:
                slope[name] += w / whole * miss
        for name in weights:
            weights[name] -= rate * slope[name] * 4
    return weights


def train(found: DataFrame, column: str = "candidates") -> dict[str, float]:
    cells = found.select(F.inline(column)).groupBy("kind", *LABELERS, *TRAITS).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit([(r["kind"], tuple(r[name] for name in LABELERS), float(r["n"]), tuple(r[name] for name in TRAITS)) for r in sorted(cells)])


def probability(weights: dict[str, float], span: str) -> str:
    """SQL: the classifier's probability for a span."""
    if not weights:
        return "0.0D"

    def cases(prefix: str, field: str) -> str | None:
        own = [(name.split("=", 1)[1], w) for name, w in sorted(weights.items()) if name.startswith(f"{prefix}{field}=")]
        when = " ".join(f"WHEN {_quoted(v) if field == 'kind' else v} THEN {w!r}D" for v, w in own)
        return f"(CASE {span}.{field} {when} ELSE 0.0D END)" if own else None

    fields = (*LABELERS, *TRAITS)
    terms = [x for f in ("kind", *fields) if (x := cases("", f))]
    for kind in BASE + OTHER:
        if own := [x for f in fields if (x := cases(f"{kind}&", f))]:
            terms.append(f"(CASE WHEN {span}.kind = {_quoted(kind)} THEN {' + '.join(own)} ELSE 0.0D END)")
    return f"(1 / (1 + exp(-({' + '.join(terms)}))))"


def chosen(weights: dict[str, float], column: str = "candidates", add: float = ADD) -> Column:
    """The final spans: base ones, and others the classifier accepts that overlap no base span; of those that
    overlap each other, the kind listed first stays."""
    accepted = f"filter({column}, __c -> NOT __c.base AND __c.rank >= {len(BASE)} AND {probability(weights, '__c')} >= {add}D)"
    apart = f"filter({accepted}, __c -> NOT exists({column}, __b -> __b.base AND __b.start < __c.end AND __c.start < __b.end))"
    apart = f"transform(array({apart}), __a -> filter(__a, __c -> NOT exists(__a, __d -> __d.rank < __c.rank AND __d.start < __c.end AND __c.start < __d.end)))[0]"
    return F.expr(f"CASE WHEN size({column}) = 0 THEN {column} ELSE array_sort(concat(filter({column}, __c -> __c.base), {apart})) END")


def find(df: DataFrame, text_col: str = "text", weights: dict[str, float] | None = None) -> tuple[DataFrame, str]:
    """``df`` with a column of final spans (see SPAN); returns it and the column's name.

    The candidates are extracted once, to the shared folder; training and the result both read that.
    """
    name = C.free_name(df.columns, "spans")
    found = C.written(candidates(df, text_col, name), "pii")
    weights = train(found, name) if weights is None else weights
    return found.withColumn(name, chosen(weights, name)), name


def redacted(text: str, spans: str) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    return F.expr(
        f"""CASE WHEN size({spans}) > 0 THEN aggregate({spans}, struct(0 AS done, '' AS out),
        (acc, s) -> CASE WHEN s.end <= acc.done THEN acc
          WHEN s.start < acc.done THEN struct(s.end AS done, acc.out AS out)
          ELSE struct(s.end AS done, concat(acc.out, substring({text}, acc.done + 1, s.start - acc.done), '[', upper(s.kind), ']') AS out) END,
        acc -> concat(acc.out, substring({text}, acc.done + 1))) ELSE {text} END"""
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = candidates(docs, "text", "spans").drop("text")
    found = C.written(kept, "pii")
    out = found.withColumn("spans", chosen(train(found, "spans"), "spans"))
    base = "filter(spans, s -> s.base)"
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return out.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in BASE),
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


QUERIES = {"op1_pii": op1_pii}
