"""The small tables with known answers, and the edge tables."""

import math

from pyspark.sql import functions as F

from tablemill.functions import numbers, text
from tablemill.operators import clean, columns, encode, reports, scale, types
from tablemill.operators.profile import profile
from tablemill.plans import cleaning


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "A long, B string")
    report = {r["scope"]: r["duplicates"] for r in clean.handle_duplicates(df, "analyze").collect()}
    assert report["full_row"] == 1 and report["all_copies"] == 2
    assert clean.handle_duplicates(df, "remove_all").count() == 3
    assert clean.duplicate_rows(df).collect()[0]["copies"] == 2


def test_category_split(spark):
    df = spark.createDataFrame(list(zip("abcabc", "xxyxxy", range(1, 7))), "cat1 string, cat2 string, num long")
    roles = {r["column"]: r["role"] for r in types.split_categories(df, 5, detect=False).collect()}
    assert roles == {"cat1": "nominal", "cat2": "nominal"}
    assert types.split_categories(df, 2).where("role = 'too_many_categories'").collect()[0]["column"] == "cat1"


def test_missing_markers(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (float("-inf"),), (0.0,)], "x double")
    out = [r[0] for r in numbers.normalise_missing(df).collect()]
    assert out == [None, None, None, None, 0.0]
    p = profile(numbers.normalise_missing(df))["x"]
    assert (p.nulls, p.distinct, p.mean) == (4, 1, 0.0)


def test_dirty_numbers(spark):
    cells = {"12 g": 12.0, "1,5": 1.5, "-": None, "1-2": None, "NA": None, "?": None, "1e5": 15.0, "": None}
    df = spark.createDataFrame([(k,) for k in cells], "raw string")
    got = {r["raw"]: r["v"] for r in df.select("raw", numbers.parse_dirty_number(F.col("raw")).alias("v")).collect()}
    assert got == cells


def test_ean_and_text(spark):
    df = spark.createDataFrame([("4006381333931",), ("4006381333930",), ("12",), (None,), ("40063813339x1",)], "code string")
    assert [r["valid_barcode"] for r in cleaning.check_barcodes(df).collect()] == [True, False, False, False, False]
    t = spark.createDataFrame([("  Crème-brûlée,  SUCRE! ",)], "t string")
    assert t.select(text.clean_text(F.col("t"))).first()[0] == "crème brûlée sucre"


def test_units_and_bins(spark):
    df = spark.createDataFrame([("2 oz",), ("1.5 LB",), ("3 tbsp",), ("30 g",), ("x",), (None,)], "serving_size string")
    rows = cleaning.extract_serving(df).collect()
    assert [r["serving_unit"] for r in rows] == ["g", "g", "ml", "g", None, None]
    assert [round(r["serving_quantity"], 3) if r["serving_quantity"] else None for r in rows] == [56.7, 680.388, 45.0, 30.0, None, None]
    fat = spark.createDataFrame([(0.0,), (3.0,), (3.1,), (20.0,), (21.0,), (None,)], "fat_100g double")
    assert [r["fat_category"] for r in cleaning.enrich(fat).collect()] == [None, "low_fat", "medium_fat", "medium_fat", "high_fat", None]


def test_clip_and_macros(spark):
    df = spark.createDataFrame([(60.0, 50.0, 30.0), (None, 90.0, 20.0), (-5.0, 1.0, 1.0)],
                               "proteins_100g double, carbohydrates_100g double, fat_100g double")
    rows = clean.apply_ranges(df).collect()
    assert math.isclose(sum(rows[0]), 100.0)
    assert rows[1][0] is None and math.isclose(rows[1][1] + rows[1][2], 100.0)
    assert rows[2][0] == 0.0


def test_constant_column_scaling(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    for method in ("standard", "minmax", "robust"):
        assert [r[0] for r in scale.scale(df, ["x"], method)[0].collect()] == [0.0, 0.0, 0.0]
    assert reports.quality_report(df).collect()[0]["is_constant"]


def test_mode_ties_and_imputation(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert sorted(r[0] for r in clean.impute_categories(df).collect()) == ["a", "a", "a", "b", "b"]
    numbers_ = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    assert [tuple(r) for r in clean.median_impute(numbers_, ["x", "y"]).collect()] == [(1.0, 0.0), (3.0, 0.0)]


def test_aggregate_duplicates(spark):
    df = spark.createDataFrame([("k", 1.0, "b"), ("k", 3.0, "a"), ("k", 5.0, "a"), (None, 7.0, None)], "k string, x double, t string")
    out = {r["k"]: (r["x"], r["t"]) for r in clean.handle_duplicates(df, "aggregate", key_cols=["k"]).collect()}
    assert out == {"k": (3.0, "a"), None: (7.0, None)}


def test_numeric_table(spark):
    df = spark.createDataFrame([("1,5", "x", None), ("2", "y", None), ("NA", "z", None)], "a string, b string, e string")
    out, fill = columns.to_numeric_table(df)
    assert set(out.columns) == {"a", "e"} and fill == {"a": 1.75, "e": 0.0}


def test_rare_categories_and_one_hot(spark):
    df = spark.createDataFrame([(i, "a" if i < 60 else "b" if i < 98 else f"r{i}" if i < 100 else None) for i in range(101)], "id long, c string")
    grouped = encode.handle_rare(df, ["c"], 0.05).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in grouped} == {"a": 60, "b": 38, "Other": 2, None: 1}
    assert encode.handle_rare(df, ["c"], 0.05, "drop").count() == 99
    limited = encode.limit_categories(df, ["c"], 0.9, 20).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in limited} == {"a": 60, "b": 38, "Other": 3}
    row = encode.one_hot_columns(df.where("c = 'a'"), ["c"], {"c": ["a", "q"]}).first()
    assert (row["c_a"], row["c_q"]) == (1, 0)
    assert encode.categories_of(df, "c") == sorted({r["c"] for r in df.collect()} - {None})


def test_narrowest_types():
    assert types.narrowest_type(0, 255, False) == "smallint"
    assert types.narrowest_type(-1, 127, False) == "tinyint"
    assert types.narrowest_type(0, 70000, False) == "bigint"
    assert types.narrowest_type(0.5, 1.5, True) == "float"
    assert types.narrowest_type(None, None, False) == "double"
