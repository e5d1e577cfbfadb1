"""Stages of the pipeline start no more Python workers than one for each running task."""

from __future__ import annotations

from tablemill.llm import contamination, paragraphs

PASSAGE = " ".join(f"word{i}" for i in range(60))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_passages_are_cut_out_by_one_python_step(spark):
    docs = spark.createDataFrame([(1, f"{PASSAGE} first"), (2, f"second\n{PASSAGE}"), (3, PASSAGE), (4, None)], "doc_id long, text string")
    left = paragraphs.remove_repeated(docs)
    assert plan_of(left).split("Initial Plan")[0].count("ArrowEvalPython") == 1
    assert sorted(map(tuple, left.collect())) == [(1, f"{PASSAGE} first"), (2, "second"), (4, None)]


def test_benchmark_search_makes_no_rows_in_python(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PASSAGE), (2, "clean words"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("b", PASSAGE)], "item_id string, text string")

    def refused(*args, **kwargs):
        raise AssertionError("rows made in Python need workers of another kind, which stay beside the others")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    found = {r["doc_id"]: (r["n_words"], len(r["spans"])) for r in contamination.find_hits(docs, items).collect()}
    assert found == {1: (60, 48), 2: (2, 0), 3: (0, 0)}
