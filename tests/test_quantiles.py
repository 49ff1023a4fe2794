"""Quantiles by radix against numpy and Spark's percentile."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import quantiles
from textloom.plans import registry

SHARES = {"low": 0.0, "p10": 0.1, "third": 1 / 3, "p50": 0.5, "p99": 0.99, "top": 1.0}
INF = float("inf")


@pytest.mark.parametrize("bits", [8, 16])
def test_quantiles_like_percentile(spark, monkeypatch, bits):
    monkeypatch.setattr(quantiles, "BITS", bits)
    rng = random.Random(6)
    groups = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(300)],
        "near": [1 + rng.randrange(50) * 2**-52 for _ in range(301)],
        "same": [2.5] * 90,
        "zeros": [-0.0, 0.0, -0.0, 5e-324, -5e-324],
        "ends": [-INF, INF, 1.0, None],
        "one": [None, 7.0],
        None: [3.0, 1.0, 2.0],
    }
    df = spark.createDataFrame([(g, v) for g, values in [*groups.items(), ("none", [None])] for v in values], "g string, v double")
    got = {r.g: r for r in quantiles.quantiles(df, "g", "v", SHARES).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(*(F.percentile("v", s).alias(n) for n, s in SHARES.items())).collect()}
    assert set(got) == set(groups)
    for g in groups:
        assert [got[g][n] for n in SHARES] == pytest.approx([want[g][n] for n in SHARES], rel=0, abs=0, nan_ok=True), g


def test_places_are_in_order(spark):
    values = [-INF, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.5, 1e300, INF, float("nan")]
    df = spark.createDataFrame([(v,) for v in [*values, -0.0, None]], "v double").select("v", quantiles.place("v").alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys[:10] == sorted(set(keys[:10])) and keys[10] == keys[4] and keys[11] is None


def test_no_task_sees_all_values_of_a_flag(spark, tmp_path):
    df = spark.range(0, 200_000, 1, 4).select(F.lit("A").alias("l_returnflag"), F.lit(1.0).alias("l_quantity"), (F.rand(3) * 1e5).alias("l_extendedprice"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = registry.QUERIES["quantile_audit"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan.lower()
    stored = np.array([r[0] for r in spark.read.parquet(f"{tmp_path}/lineitem.parquet").select("l_extendedprice").collect()])
    row = out.first()
    assert [row[f"p{p}"] for p in (10, 25, 50, 75, 90)] == pytest.approx(np.quantile(stored, [0.1, 0.25, 0.5, 0.75, 0.9]).round(4).tolist(), abs=1e-4)
