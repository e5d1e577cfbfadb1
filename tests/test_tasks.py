"""How rows are dealt over tasks."""

from __future__ import annotations

from tablemill.operators.cluster import kmeans


def test_kmeans_bounds_the_rows_of_a_task(spark, monkeypatch):
    df = spark.range(200).selectExpr("CAST(id % 2 * 10 + id / 1000 AS DOUBLE) AS x").coalesce(1)
    dealt = kmeans.in_tasks(df, 50)
    sizes = [n for n in dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(sizes) == 4 and max(sizes) <= 60 and sum(sizes) == 200
    assert kmeans.in_tasks(df, 200) is df
    whole = kmeans.fit(df, ["x"], 2)
    monkeypatch.setattr(kmeans, "ROWS_PER_TASK", 50)
    parts = kmeans.fit(df, ["x"], 2)
    assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(whole, parts))
