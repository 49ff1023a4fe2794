"""Splits, mixes, leaks, series, grids, pixels, sources and streams on small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import udf as U
from textloom.operators import grids, leakage, pixels, scoring, series, splits
from textloom.sources import files
from textloom.streaming import jobs


def test_split_sizes(spark):
    want = {1: (1, 0, 0), 2: (1, 0, 1), 3: (2, 0, 1), 4: (3, 0, 1), 5: (4, 0, 1), 6: (4, 1, 1), 7: (5, 1, 1), 8: (6, 1, 1), 10: (7, 1, 2), 15: (10, 2, 3), 25: (18, 2, 5)}
    df = spark.createDataFrame([(n,) for n in want], "n int")
    train, val = splits.sizes(F.col("n"))
    assert {r.n: (r.t, r.v, r.n - r.t - r.v) for r in df.select("n", train.alias("t"), val.alias("v")).collect()} == want


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 7).alias("s"))
    one, two = (splits.stratified(df.repartition(n), "id", ["s"]) for n in (1, 9))
    assert sorted(one.collect()) == sorted(two.collect())
    assert splits.shared_between(one, "id").count() == 0 and one.count() == 300
    with pytest.raises(ValueError):
        splits.Ratios(0.5, 0.1, 0.1)


def test_mix_sizes():
    got = [splits.mix_sizes(4374, 2535, p) for p in (10, 20, 30, 50, 70, 80, 90)]
    assert got == [(282, 2535), (634, 2535), (1086, 2535), (2535, 2535), (4374, 1875), (4374, 1094), (4374, 486)]


def test_close_texts_like_all_pairs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(words)), "i long, w string")
    got = {(r.i, r.j): r.distance for r in leakage.close_texts(df, df.withColumnRenamed("i", "j"), "i", "j", "w", "w", 2).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    want = {(i, j): d for i, a in enumerate(words) for j, b in enumerate(words) if (d := distance(a, b)) <= 2}
    assert got == want


@pytest.mark.parametrize(("shared", "chars"), [(32, 1 << 20), (1, 200)])
def test_close_texts_of_crowds_and_copies(spark, monkeypatch, shared, chars):
    monkeypatch.setattr(leakage, "SHARED", shared)
    monkeypatch.setattr(leakage, "TRIE_CHARS", chars)
    rng = random.Random(4)
    near = lambda n: [f"er#{rng.randrange(400):06d}" for _ in range(n)]
    a, b = [*near(150), *"xy", "", None, "lonely text", "lonely  texd"], [*near(120), "x", "", None, "a lonely text"]
    ids = lambda rows, key: spark.createDataFrame([(i // 2, w) for i, w in enumerate(rows)], f"{key} long, w string")
    got = sorted(tuple(r) for r in leakage.close_texts(ids(a, "i"), ids(b, "j"), "i", "j", "w", "w", 2).collect())
    want = sorted((i // 2, j // 2, d) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and y is not None and (d := U.levenshtein(x, y)) <= 2)
    assert got == want and len({x[:2] for x in want}) < len(want)


def test_audit_verdict(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, path string, text string")
    train = rows(("1", "a/x.jpg", "One  text"), ("2", None, ""))
    assert leakage.audit(rows(("3", "b/y.jpg", "other"), ("4", "", "")), train, "id", "path", "text").first().verdict == "PASS"
    hit = leakage.audit(rows(("1", "b\\x.jpg", "One text"), ("5", "c/x.jpg", "z")), train, "id", "path", "text").first()
    assert (hit.id_hits, hit.name_hits, hit.hash_hits, hit.verdict) == (1, 2, 1, "REVIEW")
    bank = rows(("1", "", "a long sentence here"), ("2", "", "A long sentense here!"), ("3", "", "quite another"))
    kept = leakage.decontaminated(bank, rows(("9", "", "a long  sentence here")), "id", "text", "text")
    assert [r.id for r in kept.collect()] == ["3"]


def test_series(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([5, 1, 4, 4, 2, 9, 8])], "g int, i int, v double")
    got = [r.s for r in df.withColumn("s", series.smoothed("v", ["g"], ["i"], 3)).orderBy("i").collect()]
    assert np.allclose(got, pixels.smooth(np.array([5, 1, 4, 4, 2, 9, 8.0]), 3))
    stop = series.early_stop(df, ["g"], ["i"], "v", 3).orderBy("i").collect()
    assert [r.since for r in stop] == [0, 0, 1, 2, 3, 4, 5] and [r.stop for r in stop] == [False] * 4 + [True] * 3
    peaks = series.spaced_peaks(df, ["g"], "i", "v", 3, 2).collect()
    assert [r.i for r in peaks] == [0, 5]
    cuts = spark.createDataFrame([([20, 10, 12, 30],), ([],)], "c array<int>").select(series.merged_cuts(F.col("c"), 5).alias("m")).collect()
    assert [r.m for r in cuts] == [[11, 20, 30], []]
    assert series.best_row(df, ["g"], "v", "i", "i").first().i == 1
    assert [r.i for r in series.chunks(df, ["g"], ["i"], 3).orderBy("i").collect()] == list(range(6))


def test_grids(spark):
    df = spark.createDataFrame([(1, "OK "), (2, "bad")], "id int, m string")
    out = grids.dispatch(F.col("m"), {"ok": F.lit("fine")}, {"okay": "ok"})
    assert df.where("id = 1").select(out.alias("o")).first().o == "fine"
    with pytest.raises(Exception, match="unknown backend: bad"):
        df.select(out).collect()
    a = spark.createDataFrame([("d", "photo_1.jpg"), ("e", "photo_2.jpg")], "dir string, p string")
    b = spark.createDataFrame([("d", "drawing_2.png"), ("d", "drawing_3.gif"), ("d", "drawing_1.gif")], "dir string, path string")
    got = {r.dir: r.companion for r in grids.companion(a, b, "dir", ["gif", "png"], "path").collect()}
    assert got == {"d": "drawing_1.gif", "e": None}
    pred = spark.createDataFrame([(1, "a")], "k int, p string")
    with pytest.raises(Exception, match="differ in their keys"):
        scoring.paired(pred, spark.createDataFrame([(2, "g")], "k int, g string"), ["k"]).collect()


def test_pixels():
    grey = np.full((400, 200), 255, np.uint8)
    for y in (60, 160, 260):
        grey[y : y + 12, 40:160] = 20
    assert pixels.ink_box(grey) == (60, 272, 40, 160)
    assert pixels.ink_box(np.full((4, 5), 255, np.uint8)) == (0, 4, 0, 5)
    edges = pixels.band_edges(grey, 3)
    assert len(edges) == 4 and edges == sorted(edges) and 72 < edges[1] < 160 and 172 < edges[2] < 260
    assert pixels.band_edges(grey, 3, equal=True) == [60, 131, 201, 272]
    assert pixels.text_columns(grey, 50, 80, 0.1) == (24, 176)
    rng = np.random.default_rng(1)
    for _ in range(50):
        mask = rng.uniform(size=(6, 7)) < 0.7
        areas = [(b - t + 1) * (r - x + 1) for t in range(6) for b in range(t, 6) for x in range(7) for r in range(x, 7) if mask[t : b + 1, x : r + 1].all()]
        box = pixels.largest_rectangle(mask)
        if areas:
            x, t, r, b = box
            assert mask[t : b + 1, x : r + 1].all() and (b - t + 1) * (r - x + 1) == max(areas)
    assert pixels.largest_rectangle(np.zeros((2, 2), bool)) is None
    strokes, inside = np.zeros((60, 60)), np.ones((60, 60))
    strokes[:, :30] = 1
    top, left = pixels.clean_patch(strokes, inside, 12, 12, (0, 0, 10, 10))
    assert left >= 30 and pixels.clean_patch(strokes, inside, 70, 5, (0, 0, 1, 1)) is None
    assert pixels.tinted(np.array([[0, 255]], np.uint8), (10, 20, 30), (200, 210, 220)).shape == (1, 2, 3)
    assert pixels.multiplied(np.full((2, 2, 3), 100, np.uint8), np.array([[1, 3], [1, 3]]), 1.0)[0].tolist() == [[50] * 3, [150] * 3]


def test_files(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    lines = put("m.jsonl", '{"doc_id": "1", "date_raw": "", "list_date_raw": "1200", "city": "X"}\n\n{"doc_id": "2", "city": null, "list_city": "Y Z"}\n')
    assert sorted(map(tuple, files.manifest(spark, lines).collect())) == [("1", "1200", "X"), ("2", "", "Y Z")]
    folio = put("f.jsonl", '{"folio_id": "a", "n_lines": 1, "lines": ["x"]}\n{"folio_id": "b", "n_lines": 1, "lines": ["x"], "error": "e"}\n{"folio_id": "c", "n_lines": 0, "lines": []}\n')
    assert [r.folio_id for r in files.folios(spark, folio).collect()] == ["a"]
    for s, ids in (("train", "1\n 2 \n\n2\n"), ("val", "3\n"), ("test", "")):
        put(f"ids/{s}_ids.txt", ids)
    assert sorted(map(tuple, splits.id_lists(spark, str(tmp_path / "ids")).collect())) == [("1", "train"), ("2", "train"), ("3", "val")]
    for i in ("b", "a"):
        put(f"docs/{i}/meta.json", json.dumps({"doc_id": i, "metadata": {"k": "v"}}, indent=1))
    assert [r.doc_id for r in files.documents(spark, str(tmp_path / "docs/*/meta.json")).collect()] == ["a", "b"]
    state = put("s.json", json.dumps({"global_step": 3, "log_history": [{"step": 1, "eval_gen_cer": 0.5}, {"step": 2}]}))
    assert [r.step for r in files.history(files.report(spark, state, files.SCHEMAS["trainer_state"])).collect()] == [1]
    bad = put("t/bytes.txt", b"ok\nb\xffd")
    assert [r.line for r in files.text_lines(spark, bad).orderBy("line_no").collect()] == ["ok", "b�d"]
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path / "docs"), "*.json").collect()] == ["meta.json"] * 2

    df = spark.createDataFrame([("2", "train", None), ("1", "train", None), ("3", "val", "why")], "doc_id string, split string, error string")
    files.write_by_split(df, str(tmp_path / "out"))
    assert [r.doc_id for r in spark.read.json(str(tmp_path / "out/split=train")).collect()] == ["1", "2"]
    files.write_with_errors(df, str(tmp_path / "good"))
    assert spark.read.json(str(tmp_path / "good_errors")).count() == 1
    files.write_plain_and_gzip(df, str(tmp_path / "plain"))
    assert spark.read.json(str(tmp_path / "plain_gz")).count() == 3
    files.write_table(df, str(tmp_path / "csv"))
    files.write_report(df.limit(1), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3 and spark.read.text(str(tmp_path / "report")).count() == 1
    assert files.not_yet(df, df.where("split = 'val'"), "doc_id").count() == 2
    assert sorted(map(tuple, files.parameters(spark, {"a": {"b": 1}, "c": "x"}).collect())) == [("a.b", "1"), ("c", "x")]
    assert files.limited(df, 0, "doc_id").count() == 3 and files.limited(df, 1, "doc_id").first().doc_id == "1"


def test_streams(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put = lambda name, *rows: spark.createDataFrame(list(rows), "id long, v double").coalesce(1).write.mode("append").json(source)
    put("a", (1, 1.0), (1, 3.0))
    for rows in ((), ((2, 5.0), (1, 9.0))):
        if rows:
            put("b", *rows)
        query = jobs.appended(jobs.distinct_records(jobs.records(spark, source, "id long, v double"), "id"), out, state)
        query.awaitTermination()
    assert sorted(r.id for r in spark.read.json(out).collect()) == [1, 2]
    means = jobs.running_means(jobs.records(spark, source, "id long, v double"), ["id"], "v")
    q = means.writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.n for r in spark.table("means").collect()} == {1: 3, 2: 1}
