"""What earlier versions got wrong, on small tables against plain definitions."""

import hashlib
from urllib.parse import urljoin

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import udf as U
from textloom.operators import pixels, scoring, splits


def values(spark, column, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, c string")
    return [r.v for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_lines_in_any_case_and_only_under_the_root(spark):
    rows = ["<HistoricalDocument><line>a</line><LINE>b</LINE></HistoricalDocument>", "<line>a</line><b>c</b>", "<HistoricalDocument><b>c</b>", None]
    assert values(spark, T.xml_lines_joined, rows) == ["ab", rows[1], "c", None]


def test_addresses_join_as_the_standard_says(spark):
    base = "http://h.example/a/b/c"
    rows = ["../d", "//o.example/x", "?q=1", "#f", "", "d/./e/../f", "/g", "h.html", "https://x.example/y", "mailto:a@b.example", "..", "a..b/c", None]
    assert values(spark, lambda c: T.url_join(base, c), rows) == [None if r is None else urljoin(base, r) for r in rows]


def test_harvest(spark):
    deep = "[" * 300 + '{"text": "deep"}' + "]" * 300
    rows = ['{"Text": "a,b", "x": {"content": "say \\"hi\\" now"}, "rec_texts": ["p", "", "q"], "text2": "no"}', '{"text": {"markdown": "m"}, "n": 5}', "not json", "", None, deep, '[{"rec_text": "r"}, 3]']
    assert values(spark, U.harvest, rows) == [["a,b", 'say "hi" now', "p", "q"], ["m"], [], [], [], ["deep"], ["r"]]
    assert values(spark, lambda c: U.harvest(c, ("k",), (), scalars=True), ['{"k": 5, "z": [{"k": true}, {"k": null}]}']) == [["5", "true"]]


def plain_split(rows, seed=1337):
    strata = {}
    for key, s in rows:
        strata[key] = min(s, strata.get(key, s))
    groups = {}
    for key, s in strata.items():
        groups.setdefault(s, []).append(key)
    out = {}
    for keys in groups.values():
        keys.sort(key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))
        n = len(keys)
        train = max(1, round(n * 0.7))
        val = min(round(n * 0.1), n - train)
        out |= {k: "train" if i < train else "val" if i < train + val else "test" for i, k in enumerate(keys)}
    return out


def test_a_repeated_key_is_in_one_split(spark, monkeypatch):
    rows = [(i % 400, "abc"[i % 400 % 3]) for i in range(1000)] + [(5, "a"), (6, "c"), (900, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    for digits in (1, 3):
        monkeypatch.setattr(splits, "CELL_DIGITS", digits)
        got = splits.stratified(df, "id", ["s"])
        assert got.columns == ["id", "s", "split"] and got.count() == len(rows)
        assert splits.shared_between(got, "id").count() == 0
        want = plain_split([r for r in rows if r[1] is not None])
        assert {r.id: r.split for r in got.where("id <> 900").collect()} == want


def test_historic_letters_always_show(spark):
    df = spark.createDataFrame([(1, "".join("abcdefghij" * 9) + "ѡ҂", "x" * 92)], "i int, g string, p string")
    shown = {r.g for r in scoring.confusion(df, "p", "g", ["i"], top=3).collect()}
    assert {"ѡ", "҂"} <= shown and "j" not in shown and "ꙋ" not in scoring.HISTORIC


def test_patches_like_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(20):
        strokes, inside, box = rng.random((50, 60)) < 0.3, rng.random((50, 60)) < 0.99, (10, 12, 25, 30)
        best = None
        for y in range(0, 50 - 12 + 1, 6):
            for x in range(0, 60 - 14 + 1, 6):
                far = x + 14 <= 6 or x >= 29 or y + 12 <= 8 or y >= 34
                if far and inside[y : y + 12, x : x + 14].mean() >= 0.95:
                    away = np.hypot(x + 7 - 17.5, y + 6 - 21) / np.hypot(50, 60)
                    score = strokes[y : y + 12, x : x + 14].mean() + 0.18 * away
                    if best is None or score < best[0] - 1e-12:
                        best = (score, y, x)
        assert pixels.clean_patch(strokes, inside, 12, 14, box) == (best and best[1:])


def test_image_parts():
    rng = np.random.default_rng(3)
    values = rng.random(40)
    assert np.allclose(pixels.smooth(values, 4), np.convolve(np.pad(values, 2, mode="edge"), np.ones(5) / 5, "valid"))
    assert pixels.minima(np.array([3, 1, 1, 2, 0, 5])).tolist() == [1, 4]
    image = rng.random((9, 7))
    assert np.allclose(pixels.blurred(np.full((9, 7), 3.0), 2), 3.0) and abs(pixels.blurred(image, 1).mean() - image.mean()) < 0.1
    assert pixels.letterboxed(np.zeros((2, 4), np.uint8), 8).tolist() == [[255] * 8] * 2 + [[0] * 8] * 4 + [[255] * 8] * 2
    one = pixels.grained(np.full((4, 4, 3), 100, np.uint8), 5, 1)
    assert (one == pixels.grained(np.full((4, 4, 3), 100, np.uint8), 5, 1)).all() and (one[..., 0] == one[..., 2]).all()


def test_crops_of_image_rows(spark):
    grey = np.full((400, 200), 255, np.uint8)
    for y in (60, 160, 260):
        grey[y : y + 12, 40:160] = 20
    rows = [(1, bytearray(grey.tobytes()), 200, ["a", "b", "c"]), (2, None, 200, ["x"]), (3, bytearray(b"\xff" * 40), 4, [])]
    df = spark.createDataFrame(rows, "page long, bytes binary, w int, texts array<string>")
    got = pixels.line_crops(df, "page", "bytes", "w", "texts", 2).orderBy("first_line").collect()
    assert [(r.id, r.first_line, r.last_line, r.text) for r in got] == [(1, 1, 2, "a\nb"), (1, 3, 3, "c")]
    (left, top, right, bottom), last = got[0].box, got[1].box
    assert left <= 40 and right >= 160 and top < 60 and 172 < bottom < 262 and last[1] > 172 and last[3] > 272
