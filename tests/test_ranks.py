"""The ways taken for large groups give the same answers as the ways for small ones."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemill.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """Group ``hot`` holds more than a third of the rows, half of them one value."""
    rng = np.random.RandomState(0)
    rows = [(i, "hot" if i % 5 < 3 else f"g{i % 7}", 1.0 if i % 2 else float(np.round(rng.exponential(3), 2))) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, g string, x double")


def test_running_total_buckets(skewed):
    counts = skewed.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    small = {(r["g"], r["x"]): r["b"] for r in ranks.running_total(counts, ["g"], ["x"], "n", "b").collect()}
    large = {(r["g"], r["x"]): r["b"] for r in ranks.running_total(counts, ["g"], ["x"], "n", "b", 50).collect()}
    assert small == large
    pdf = counts.toPandas().sort_values(["g", "x"])
    pdf["b"] = pdf.groupby("g")["n"].cumsum() - pdf["n"]
    assert large == {(g, x): b for g, x, b in zip(pdf["g"], pdf["x"], pdf["b"])}


def test_global_rank_buckets(skewed):
    ranked = ranks.global_rank(skewed, ["x", "id"], rows_per_bucket=100).toPandas().sort_values("rank")
    assert list(ranked["rank"]) == list(range(2000))
    assert list(ranked["id"]) == list(ranked.sort_values(["x", "id"])["id"])


@pytest.mark.parametrize("by", [[], ["g"]])
def test_banded_quantiles(skewed, by):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    pdf = skewed.toPandas()
    got = ranks.quantile_table(skewed, ["x"], probs, by=by, exact_rows=1, accuracy=100).collect()
    for r in got:
        values = pdf[pdf["g"] == r["g"]]["x"] if by else pdf["x"]
        assert np.allclose(r["q"], np.quantile(values, probs))
        assert r["n"] == len(values)
    assert len(got) == (pdf["g"].nunique() if by else 1)


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(2.0,)] * 50, "x double")
    assert ranks.quantile_table(df, ["x"], [0.25, 0.5], exact_rows=1).first()["q"] == [2.0, 2.0]


def test_smallest_by_hash_buckets(spark, skewed):
    hashed = skewed.withColumn("h", F.md5(F.col("id").cast("string")))
    quotas = skewed.select("g").distinct().withColumn("q", F.when(F.col("g") == "hot", 400).otherwise(10))
    pdf = skewed.toPandas()
    pdf["h"] = [hashlib.md5(str(i).encode()).hexdigest() for i in pdf["id"]]
    want = set()
    for g, part in pdf.groupby("g"):
        want |= set(part.sort_values("h")["id"][: 400 if g == "hot" else 10])
    for per_bucket in (10, 333, 10**6):
        got = ranks.smallest_by_hash(hashed, ["g"], "h", quotas, "q", per_bucket)
        assert {r["id"] for r in got.collect()} == want


def test_modes_pick_smallest(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "b"), ("y", None)], "k string, v string")
    assert ranks.modes(df, ["k", "v"]) == {"k": "x", "v": "b"}
