"""How often the rows of a table are computed, seen through a column that counts its evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import columns
from tablemill.operators.ranks import quantile_table


def counted(spark, rows: int, kind: str, value):
    """A table whose column ``v`` counts every evaluation."""
    calls = spark.sparkContext.accumulator(0)

    def give(i):
        calls.add(1)
        return value(i)

    seen = F.udf(give, kind).asNondeterministic()
    return spark.range(rows).select("id", seen("id").alias("v")), calls


def test_numeric_table_parses_every_cell_once(spark):
    df, calls = counted(spark, 300, "string", lambda i: None if i % 10 == 0 else f"{i},5 g")
    out, fill = columns.to_numeric_table(df, id_cols=["id"])
    got = {r["id"]: r["v"] for r in out.collect()}
    assert got[7] == 7.5 and got[10] == fill["v"] == 150.5
    assert calls.value == 300


def test_numeric_table_keeps_clashing_names(spark):
    df = spark.createDataFrame([(1, "2", None, 4.0), (2, "x", None, float("inf"))], "p0 int, id0 string, given0 string, v0 double")
    out, fill = columns.to_numeric_table(df, id_cols=["p0"])
    assert {r["p0"]: (r["id0"], r["given0"], r["v0"]) for r in out.collect()} == {1: (2.0, 0.0, 4.0), 2: (2.0, 0.0, 4.0)}


def test_banded_quantiles_read_the_values_twice(spark):
    df, calls = counted(spark, 400, "double", lambda i: float(i * i))
    got = quantile_table(df, ["v"], [0.25, 0.5], exact_rows=1).first()
    assert got["q"] == [(99 * 99) * 0.25 + 100 * 100 * 0.75, (199**2 + 200**2) / 2]
    assert calls.value == 2 * 400  # for the sketch and for the bands around its guesses
