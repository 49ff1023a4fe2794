"""Files of many tasks and segments, with the index joined by shuffling."""

from textloom.llm import token_files as F


def test_more_tasks_than_shuffle_partitions(spark, monkeypatch):
    monkeypatch.setattr(F, "TASK_IDS", 40)
    monkeypatch.setattr(F, "SEGMENT_IDS", 25)
    rows = [(i, f"text number {i} " * (i % 4)) for i in range(60)] + [(7, None), (None, "x"), (7, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = F.write_files(df)
    segments = spark.read.parquet(f"{path}/segments")
    assert segments.select("part").distinct().count() > 4 and segments.count() > segments.select("part").distinct().count()
    want = None
    for bound in (1 << 25, 0):
        monkeypatch.setattr(F, "BROADCAST_BYTES", bound)
        got = sorted(map(tuple, F.read_files(spark, path, ("ids_crc32",)).collect()), key=lambda r: r[1])
        assert len(got) == len(rows) and [r[0] or -1 for r in got] == sorted(r[0] or -1 for r in got)
        ends = [r[1] + r[2] for r in got]
        assert [r[1] for r in got] == [0, *ends[:-1]]
        assert want in (None, got)
        want = got
