import hashlib
import re

from textloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def fine(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_of(text):
    return sorted((m.start(), list(PLAIN).index(k), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine(k, m.group()))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()


TEXTS = [
    None,
    "",
    "nothing here",
    "mail a.b@c.d-e.com, x@y and a@b.c_d@e.f @@ a@b..c p%q+r@s.t.u.",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 1.2.3 999999999999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 12 4111111111111111 411111111111",
    "tel +1 (269) 555-3296 4524132264652876 + +1 +12345678 +1234567890123456 +49 30 1234567.",
    "né🙂 漢 x@y.zz " + chr(0xE000) + " +1 (543) 555-9258" + chr(0xE000),
    "Contact Mr. John Smith, tel 555-123-4567, ssn 123-45-6789.",
    "a@b.c " * 300 + "1.2.3.4 " * 200,
    "9" * 20000 + " " + "a" * 20000 + " " + "1-" * 5000 + " " + "a." * 5000 + "@ a@" + "b." * 5000 + "c",
    "same +1 (543) 555-9258",
    "same +1 (543) 555-9258",
]


def test_base_spans_like_plain_definitions(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    out, name = pii.find(df)
    assert name == "_spans"
    for r in out.collect():
        got = [(s.start, s.rank, s.kind, s.end) for s in r[name] if s.base]
        assert got == base_of(r.text), r.text and r.text[:50]
        places = [(s.start, s.end) for s in r[name]]
        assert places == sorted(places, key=lambda x: x[0])


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op1_pii(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base_of(docs[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[2] for x in want) for k in PLAIN]
        assert set(f"{k}:{s}:{e}" for s, _, k, e in want) <= set(r.spans.split(","))


def test_em_finds_the_reliable_labelers():
    # form and gazetteer agree with the truth in 95 %, shape is a coin.
    import itertools
    import random

    rng, counts = random.Random(1), {}
    for _ in range(5000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth else -1) * (1 if rng.random() < p else -1) for p in (0.95, 0.95, 0.8)) + (rng.choice((1, -1)),)
        counts[votes] = counts.get(votes, 0) + 1
    share, table = pii.reliabilities([("card", v, float(n)) for v, n in counts.items()])
    assert abs(share - 0.4) < 0.05
    assert table[0][1][0] > 0.9 and table[0][1][1] < 0.1 and abs(table[3][1][0] - table[3][1][1]) < 0.1
    weights = pii.fit([("card", v, float(n)) for v, n in counts.items()])
    assert weights["form=1"] > weights["shape=1"] + 0.5
    assert all(isinstance(k, str) for k in itertools.chain(weights))


def test_added_spans_need_the_classifier(spark):
    df = spark.createDataFrame([(1, "Mr. John Smith")], "doc_id long, text string")
    yes = {"kind=name": 5.0}
    assert [s.kind for s in pii.find(df, weights=yes)[0].first()["spans"]] == ["name"]
    assert pii.find(df, weights={})[0].first()["spans"] == []


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "né a@b.cc, ip 1.2.3.4."), (2, None), (3, "none")], "doc_id long, text string")
    out, name = pii.find(df)
    got = {r.doc_id: r.t for r in out.select("doc_id", pii.redacted("text", name).alias("t")).collect()}
    assert got == {1: "né [EMAIL], ip [IP].", 2: None, 3: "none"}


def test_base_spans_of_random_texts(spark):
    import random

    rng = random.Random(11)
    pieces = ["a", "b1", ".", "@", "+", "-", " ", "(", ")", "_", "%", "12", "255", "256", "0", "4111111111111111", "4111-1111 1111 1111", "1.2.3.4", "x@y.z", "+1 (2) 3-4.5678", "é", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    out, name = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights={})
    for r in out.collect():
        assert [(s.start, s.rank, s.kind, s.end) for s in r[name] if s.base] == base_of(r.text), r.text
