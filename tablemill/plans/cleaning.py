"""The cleaning flows: nine steps in a fixed order, and the full flow around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemill.functions.names import nutrition_columns, redundant_columns
from tablemill.functions.numbers import (ean13_valid, numeric_columns, quantity_and_unit, quoted, ratio,
                                         right_closed_bins, standard_quantity)
from tablemill.functions.text import clean_text, comma_items, function_words, language_of
from tablemill.operators.clean import (apply_ranges, clip_negative, fill, iqr_filter, per_serving_to_100g,
                                       plan_categories, plan_nutrition)
from tablemill.operators.columns import drop_sparse_rows, sparse_columns
from tablemill.operators.outliers import category_anomalies
from tablemill.operators.profile import profile
from tablemill.operators.reports import problem_columns
from tablemill.session import materialised, spread

INFINITY = float("inf")
LANGUAGE_COLUMNS = ["product_name", "ingredients_text", "generic_name"]


def extract_serving(df: DataFrame, col: str = "serving_size") -> DataFrame:
    """Add serving_quantity and serving_unit, with ounces, pounds and spoons converted."""
    if col not in df.columns:
        return df
    qty, unit = quantity_and_unit(quoted(col))
    raw = df.withColumn("serving_quantity", qty).withColumn("serving_unit", unit)
    q, u = standard_quantity(F.col("serving_quantity"), F.col("serving_unit"))
    return raw.withColumns({"serving_quantity": q, "serving_unit": u})


def clean_table(df: DataFrame, missing_threshold: float = 0.3, iqr_mode: str = "sequential",
                ) -> tuple[DataFrame, DataFrame]:
    """Cleaned table and log (step, column, action, detail).

    Serving sizes are parsed before the column goes. One profile decides which columns go and what
    fills the gaps; the deduplicated table is written once, because the IQR step reads it column by
    column.
    """
    p = profile(df, distinct=False, moments=False)
    sparse = sparse_columns(p, missing_threshold)
    log = [(1, c, "removed_column", "nulls") for c in sparse]
    out = extract_serving(df.drop(*sparse))
    if "ingredients_text" in out.columns:
        out = out.withColumn("ingredients_clean", clean_text(quoted("ingredients_text")))
    log += [(7, c, "extracted", "") for c in out.columns if c not in df.columns]
    redundant = redundant_columns(out.columns)
    log += [(2, c, "removed_column", "redundant") for c in redundant]
    out = out.drop(*redundant)
    for plan, limit in ((plan_nutrition, 0.2), (plan_categories, 0.3)):
        dropped, values, entries = plan(out, p, limit)
        out = fill(out.drop(*dropped), values)
        log += [(3, *e) for e in entries]
    own = [c for c in out.columns if c in df.columns]
    out = materialised(drop_sparse_rows(out, 0.3, own).dropDuplicates(), "cleaned")
    nutrition = [c for c in nutrition_columns(own) if c in numeric_columns(out)]
    out = iqr_filter(out, nutrition, 1.5, iqr_mode)
    if nutrition:
        negative = out.agg(*[F.count_if(quoted(c) < 0).alias(c) for c in nutrition]).first()
        log += [(8, c, "corrected_negative", str(negative[c])) for c in nutrition if negative[c]]
    out = per_serving_to_100g(clip_negative(out, nutrition))
    return out, df.sparkSession.createDataFrame(log, "step int, column string, action string, detail string")


def enrich(df: DataFrame) -> DataFrame:
    """Protein ratio, fat class and ingredient complexity, where the source columns exist."""
    new = {}
    if {"proteins_100g", "energy_100g"} <= set(df.columns):
        new["protein_ratio"] = ratio(F.col("proteins_100g") * 4, F.col("energy_100g"))
    if "fat_100g" in df.columns:
        new["fat_category"] = right_closed_bins(F.col("fat_100g"), [0, 3, 20, INFINITY],
                                                ["low_fat", "medium_fat", "high_fat"])
    if "ingredients_text" in df.columns:
        count = comma_items(F.col("ingredients_text"))
        new["ingredients_count"] = count
        new["ingredients_complexity"] = right_closed_bins(count, [0, 5, 10, INFINITY],
                                                          ["simple", "medium", "complex"])
    return df.withColumns(new) if new else df


def check_barcodes(df: DataFrame, col: str = "code") -> DataFrame:
    return df.withColumn("valid_barcode", ean13_valid(quoted(col))) if col in df.columns else df


def tag_languages(df: DataFrame) -> DataFrame:
    """``<column>_lang`` and, where a declared language exists, ``<column>_consistent``.

    Row-local: no explode and no shuffle, whatever the text length. Words and language are columns of
    their own so that each is computed once.
    """
    columns = [c for c in LANGUAGE_COLUMNS if c in df.columns]
    df = spread(df) if columns else df
    for c in columns:
        df = df.withColumn("_words", function_words(quoted(c))).withColumn(f"{c}_lang", language_of(F.col("_words")))
        df = df.drop("_words")
        if "lang" in df.columns:
            df = df.withColumn(f"{c}_consistent", F.coalesce(quoted(f"{c}_lang") == F.col("lang"), F.lit(False)))
    return df


def full_clean(df: DataFrame, id_col: str = "row_id") -> dict[str, DataFrame]:
    """Cleaned and enriched table, cleaning log, problem columns and anomalies."""
    cleaned, log = clean_table(df)
    ranged = apply_ranges(cleaned)
    numbers = [c for c in ("energy_100g", "proteins_100g", "fat_100g") if c in ranged.columns]
    anomalies = category_anomalies(ranged, id_col, numbers)
    table = tag_languages(check_barcodes(enrich(ranged)))
    return {"table": table, "log": log, "problems": problem_columns(df), "anomalies": anomalies}
