"""Queries for column choice, scalar functions, cleaning and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog.profiling import rounded
from tablemill.catalog.registry import (COLUMNS, NUMBERS, PRODUCTS_SQL, TEXT, WITH_PRODUCTS, per_column, query)
from tablemill.functions import numbers, text
from tablemill.functions.names import clustering_candidates, excluded_from_sampling
from tablemill.functions.numbers import quoted
from tablemill.operators import clean, columns, reports, select, types
from tablemill.operators.profile import profile
from tablemill.plans import cleaning
from tablemill.sources.tables import products, read_table

P = WITH_PRODUCTS


def picked(cols, where: str = "") -> str:
    return P + "SELECT " + ", ".join(cols) + " FROM products " + where


# --- columns and rows -----------------------------------------------------------------------------

@query("prj1_drop_sparse_columns", picked([c for c in COLUMNS if c != "salt_100g"]))
def prj1(spark, d):
    return columns.drop_sparse_columns(products(spark, d), 0.3)


@query("prj2_drop_redundant_columns", picked([c for c in COLUMNS if c != "serving_size"]))
def prj2(spark, d):
    extra = products(spark, d).withColumn("image_url", F.lit("x")).withColumn("last_modified_t", F.lit(0))
    return columns.drop_redundant_columns(extra)


@query("prj3_select_numeric", picked(NUMBERS))
def prj3(spark, d):
    return columns.select_kind(products(spark, d), numeric=True)


@query("prj3_select_categorical", picked(TEXT))
def prj3b(spark, d):
    return columns.select_kind(products(spark, d), numeric=False)


@query("prj4_select_nutrition", picked(NUMBERS))
def prj4(spark, d):
    return columns.select_nutrition(products(spark, d))


PRIORITY = NUMBERS + TEXT


@query("prj5_priority_order", P + "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS non_null FROM products" for i, c in enumerate(PRIORITY)))
def prj5(spark, d):
    df = columns.priority_first(products(spark, d))
    wide = df.agg(*[F.count(quoted(c)).alias(c) for c in df.columns])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), quoted(c).alias("non_null"))
        for i, c in enumerate(df.columns)])))


@query("prj6_clustering_columns", picked(["row_id", "product_name", "categories", "brands", "serving_size"]))
def prj6(spark, d):
    df = products(spark, d)
    return columns.keep(df, clustering_candidates(df.columns)[1])


ROW_GAPS = ("(CAST(serving_size IS NULL AS INT) + CAST(carbohydrates_100g IS NULL AS INT) + "
            "CAST(salt_100g IS NULL AS INT))")


@query("prj7_drop_sparse_rows", picked(["row_id"], f"WHERE {ROW_GAPS} / 5 <= 0.3"))
def prj7(spark, d):
    gaps = ["serving_size", "carbohydrates_100g", "salt_100g", "energy_100g", "fat_100g"]
    return columns.drop_sparse_rows(products(spark, d), 0.3, gaps).select("row_id")


@query("prj8_drop_incomplete_rows", picked(["row_id", "carbohydrates_100g", "salt_100g"],
                                           "WHERE carbohydrates_100g IS NOT NULL AND salt_100g IS NOT NULL"))
def prj8(spark, d):
    df = products(spark, d)
    return columns.drop_incomplete_rows(df, ["carbohydrates_100g", "salt_100g"]).select(
        "row_id", "carbohydrates_100g", "salt_100g")


@query("prj9_drop_crowded_columns", picked([c for c in COLUMNS if c not in ("row_id", "code", "product_name", "serving_size")]))
def prj9(spark, d):
    return columns.drop_crowded_columns(products(spark, d), 30)


@query("prj10_drop_flat_columns", picked(TEXT + ["energy_100g"]))
def prj10(spark, d):
    return columns.drop_flat_columns(products(spark, d), 0.01)


@query("prj11_sampling_exclusion", P + per_column(
    """SELECT '{c}' AS "column", regexp_matches('{c}', '_t$|_datetime$|url|code|creator|created|modified|updated|id|uuid|guid|hash|key|index|timestamp|date|time|version') AS excluded, count({c}) AS non_null FROM products""", COLUMNS))
def prj11(spark, d):
    df = products(spark, d)
    wide = df.agg(*[F.count(quoted(c)).alias(c) for c in df.columns])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(excluded_from_sampling(c)).alias("excluded"),
                 quoted(c).alias("non_null")) for c in df.columns])))


@query("prj12_worth_encoding", P + "SELECT * FROM (" + per_column(
    """SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM products
       HAVING NOT count(DISTINCT {c}) > 0.9 * count(*)""", TEXT) + ")")
def prj12(spark, d):
    p = profile(products(spark, d))
    rows = [(c, p[c].distinct) for c in columns.worth_encoding(p)]
    return spark.createDataFrame(rows, "column string, n long")


@query("prj13_filtered_table", P + """SELECT categories, brands, round(CAST(energy_100g AS FLOAT), 1) AS energy_100g,
  CAST(proteins_100g AS TINYINT) AS proteins_100g, carbohydrates_100g, round(CAST(fat_100g AS FLOAT), 1) AS fat_100g,
  round(CAST(fiber_100g AS FLOAT), 1) AS fiber_100g, round(CAST(sugars_100g AS FLOAT), 1) AS sugars_100g FROM products""")
def prj13(spark, d):
    df = products(spark, d)
    p = profile(df)
    kept = columns.drop_crowded_columns(columns.drop_sparse_columns(df, 0.5, p), 30, p)
    out, _ = types.narrow_numeric(kept, {c: v for c, v in p.items() if c in kept.columns})
    return rounded(out, 1, "energy_100g", "fat_100g", "fiber_100g", "sugars_100g")


# --- scalar functions -----------------------------------------------------------------------------

DIRTY = """CASE WHEN l_orderkey % 7 = 0 THEN 'NA' WHEN l_orderkey % 7 = 1 THEN replace(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',5 g', '.', ',')
 WHEN l_orderkey % 7 = 2 THEN '1-2' WHEN l_orderkey % 7 = 3 THEN '?' WHEN l_orderkey % 7 = 4 THEN '' ELSE CAST(l_partkey AS VARCHAR) END"""


def dirty(spark, d):
    k = F.col("l_orderkey") % 7
    raw = (F.when(k == 0, "NA").when(k == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5 g")))
           .when(k == 2, "1-2").when(k == 3, "?").when(k == 4, "").otherwise(F.col("l_partkey").cast("string")))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", raw.alias("raw"))


@query("scf1_parse_dirty_numbers", f"""
SELECT l_orderkey, raw, TRY_CAST(CASE WHEN raw IN ('', 'NA', 'N/A', 'nan', 'NaN', 'None', '<NA>', 'undefined', '?') THEN NULL
  ELSE regexp_replace(trim(replace(raw, ',', '.')), '[^0-9.-]', '', 'g') END AS DOUBLE) AS parsed
FROM (SELECT l_orderkey, {DIRTY} AS raw FROM lineitem)""")
def scf1(spark, d):
    return dirty(spark, d).select("l_orderkey", "raw", numbers.parse_dirty_number(F.col("raw")).alias("parsed"))


QTY = r"CAST(nullif(regexp_extract(serving_size, '(\d+(?:\.\d+)?)\s*([a-zA-Z]+)', 1), '') AS DOUBLE)"
UNIT = r"lower(nullif(regexp_extract(serving_size, '(\d+(?:\.\d+)?)\s*([a-zA-Z]+)', 2), ''))"


@query("scf2_quantity_and_unit", P + f"SELECT row_id, {QTY} AS quantity, {UNIT} AS unit FROM products")
def scf2(spark, d):
    qty, unit = numbers.quantity_and_unit(F.col("serving_size"))
    return products(spark, d).select("row_id", qty.alias("quantity"), unit.alias("unit"))


@query("scf3_standard_units", P + f""", q AS (SELECT row_id, {QTY} AS quantity, {UNIT} AS unit FROM products)
SELECT row_id, round(quantity * CASE WHEN unit LIKE '%oz%' THEN 28.35 WHEN unit LIKE '%lb%' THEN 453.592
   WHEN unit LIKE '%tbsp%' THEN 15 ELSE 1 END, 6) AS serving_quantity,
  CASE WHEN unit LIKE '%oz%' OR unit LIKE '%lb%' THEN 'g' WHEN unit LIKE '%tbsp%' THEN 'ml' ELSE unit END AS serving_unit
FROM q""")
def scf3(spark, d):
    out = cleaning.extract_serving(products(spark, d)).select("row_id", "serving_quantity", "serving_unit")
    return rounded(out, 6, "serving_quantity")


@query("scf4_per_serving_to_100g", P + f""", q AS (SELECT *, {QTY} AS qty FROM products)
SELECT row_id, round(coalesce(salt_100g, CASE WHEN qty <> 0 THEN sugars_100g * 100 / qty END), 6) AS salt_100g FROM q""")
def scf4(spark, d):
    qty, _ = numbers.quantity_and_unit(F.col("serving_size"))
    df = products(spark, d).withColumn("serving_quantity", qty).withColumn("salt_serving", F.col("sugars_100g"))
    return rounded(clean.per_serving_to_100g(df).select("row_id", "salt_100g"), 6, "salt_100g")


CLEAN_SQL = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("scf5_clean_text", "SELECT doc_id, md5(" + CLEAN_SQL.replace("{c}", "text") + ") AS clean_md5, "
       "length(" + CLEAN_SQL.replace("{c}", "text") + ") AS clean_chars FROM documents")
def scf5(spark, d):
    c = text.clean_text(F.col("text"))
    return read_table(spark, d, "documents").select(
        "doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("clean_chars"))


@query("scf6_serving_format", P + r"SELECT row_id, regexp_matches(serving_size, '^\d+(?:\.\d+)?\s*[a-zA-Z]+$') AS well_formed FROM products")
def scf6(spark, d):
    return products(spark, d).select("row_id", text.matches_serving_format(F.col("serving_size")).alias("well_formed"))


EAN = ("(10 - (" + " + ".join(f"CAST(substr(code, {i}, 1) AS INT) * {3 if i % 2 == 0 else 1}" for i in range(1, 13))
       + ") % 10) % 10 = CAST(substr(code, 13, 1) AS INT)")


@query("scf7_ean13", P + f"SELECT row_id, code, {EAN} AS valid_barcode FROM products")
def scf7(spark, d):
    return cleaning.check_barcodes(products(spark, d)).select("row_id", "code", "valid_barcode")


@query("scf8_clip", P + """SELECT row_id, CASE WHEN proteins_100g IS NULL THEN NULL ELSE greatest(proteins_100g, 0) END AS proteins_100g,
  CASE WHEN carbohydrates_100g IS NULL THEN NULL ELSE least(greatest(carbohydrates_100g, 10), 50) END AS carbohydrates_100g FROM products""")
def scf8(spark, d):
    return products(spark, d).select(
        "row_id", numbers.clip(F.col("proteins_100g"), lower=0.0).alias("proteins_100g"),
        numbers.clip(F.col("carbohydrates_100g"), 10.0, 50.0).alias("carbohydrates_100g"))


MACROS = ["proteins_100g", "carbohydrates_100g", "fat_100g"]
RESCALED = ", ".join(f"CASE WHEN total > 100 THEN {c} / total * 100 ELSE {c} END AS {c}" for c in MACROS)
TOTALS = P + """, t AS (SELECT *, coalesce(proteins_100g, 0) + coalesce(carbohydrates_100g, 0) + coalesce(fat_100g, 0) AS total
FROM products), r AS (SELECT row_id, energy_100g, fiber_100g, salt_100g, """ + RESCALED + " FROM t) "


@query("scf9_rescale_macros", TOTALS + "SELECT row_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in MACROS) + " FROM r")
def scf9(spark, d):
    new = numbers.rescaled_to_cap({c: F.col(c) for c in MACROS})
    return rounded(products(spark, d).select("row_id", *[v.alias(c) for c, v in new.items()]), 6, *MACROS)


@query("scf10_fixed_bins", P + """SELECT row_id, CASE WHEN fat_100g > 0 AND fat_100g <= 3 THEN 'low_fat'
  WHEN fat_100g > 3 AND fat_100g <= 20 THEN 'medium_fat' WHEN fat_100g > 20 THEN 'high_fat' END AS fat_category FROM products""")
def scf10(spark, d):
    return cleaning.enrich(products(spark, d)).select("row_id", "fat_category")


@query("scf11_derived_ratios", P + """SELECT row_id, round(proteins_100g * 4 / nullif(energy_100g, 0), 9) AS protein_ratio FROM products""")
def scf11(spark, d):
    return rounded(cleaning.enrich(products(spark, d)).select("row_id", "protein_ratio"), 9, "protein_ratio")


@query("scf11_item_counts", """SELECT doc_id, CAST(length(text) - length(replace(text, ',', '')) + 1 AS INTEGER) AS ingredients_count,
  CASE WHEN length(text) - length(replace(text, ',', '')) + 1 <= 5 THEN 'simple'
       WHEN length(text) - length(replace(text, ',', '')) + 1 <= 10 THEN 'medium' ELSE 'complex' END AS ingredients_complexity
FROM documents""")
def scf11b(spark, d):
    df = read_table(spark, d, "documents").withColumnRenamed("text", "ingredients_text")
    return cleaning.enrich(df).select("doc_id", "ingredients_count", "ingredients_complexity")


def _language_sql() -> str:
    def score(words):
        listed = ", ".join("'" + w + "'" for w in words)
        return f"len(list_filter(words, lambda w: list_contains([{listed}], w)))"

    ranked = " UNION ALL ".join(f"SELECT doc_id, lang AS declared, '{lang}' AS found, {score(words)} AS n FROM w"
                                for lang, words in text.FUNCTION_WORDS.items())
    clean_sql = CLEAN_SQL.replace("{c}", "text")
    return f"""WITH w AS (SELECT doc_id, lang, string_split({clean_sql}, ' ') AS words FROM documents),
s AS ({ranked}),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, found) AS rn FROM s)
SELECT doc_id, CASE WHEN n > 0 THEN found ELSE 'unknown' END AS ingredients_text_lang,
  CASE WHEN n > 0 THEN found ELSE 'unknown' END = declared AS ingredients_text_consistent FROM b WHERE rn = 1"""


@query("scf12_language", _language_sql())
def scf12(spark, d):
    df = read_table(spark, d, "documents").withColumnRenamed("text", "ingredients_text")
    return cleaning.tag_languages(df).select("doc_id", "ingredients_text_lang", "ingredients_text_consistent")


@query("scf13_short_hash", "SELECT DISTINCT o_orderpriority, substr(md5(o_orderpriority), 1, 8) AS short_hash FROM orders")
def scf13(spark, d):
    return read_table(spark, d, "orders").select("o_orderpriority").distinct().withColumn(
        "short_hash", text.short_hash(F.col("o_orderpriority")))


@query("scf14_missing_markers", """SELECT event_id, CASE WHEN user_id % 5 < 3 THEN NULL ELSE value END AS value FROM events""")
def scf14(spark, d):
    k = F.col("user_id") % 5
    odd = (F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf")))
           .when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value")))
    return numbers.normalise_missing(read_table(spark, d, "events").select("event_id", odd.alias("value")))


@query("scf15_stratum_key", P + """SELECT row_id, concat_ws('-', brands, categories, coalesce(serving_size, 'nan')) AS stratum FROM products""")
def scf15(spark, d):
    return products(spark, d).select("row_id", text.stratum_key([F.col("brands"), F.col("categories"),
                                                                 F.col("serving_size")]).alias("stratum"))


@query("scf16_grouped_digits", "SELECT event_type, format('{:,}', CAST(round(sum(value)) AS BIGINT)) AS shown FROM events GROUP BY 1")
def scf16(spark, d):
    return read_table(spark, d, "events").groupBy("event_type").agg(
        numbers.grouped_digits(F.round(F.sum("value"))).alias("shown"))


# --- cleaning -------------------------------------------------------------------------------------

@query("cln3_impute_nutrition", P + """SELECT row_id, round(coalesce(carbohydrates_100g,
  (SELECT median(carbohydrates_100g) FROM products)), 6) AS carbohydrates_100g, energy_100g, fat_100g FROM products""")
def cln3(spark, d):
    out = clean.impute_nutrition(products(spark, d))
    assert "salt_100g" not in out.columns
    return rounded(out.select("row_id", "carbohydrates_100g", "energy_100g", "fat_100g"), 6, "carbohydrates_100g")


@query("cln4_impute_categories", P + """SELECT row_id, coalesce(serving_size, (SELECT serving_size FROM products
  WHERE serving_size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, serving_size LIMIT 1)) AS serving_size, brands FROM products""")
def cln4(spark, d):
    return clean.impute_categories(products(spark, d)).select("row_id", "serving_size", "brands")


@query("cln5_median_impute", P + "SELECT row_id, " + ", ".join(
    f"round(coalesce({c}, (SELECT median({c}) FROM products)), 6) AS {c}" for c in NUMBERS) + " FROM products")
def cln5(spark, d):
    out = clean.median_impute(products(spark, d), NUMBERS).select("row_id", *NUMBERS)
    return rounded(out, 6, *NUMBERS)


RANGED = {"energy_100g": 3000, "proteins_100g": 100, "carbohydrates_100g": 100, "fat_100g": 100, "fiber_100g": 50,
          "salt_100g": 100}


@query("cln6_range_rules", TOTALS + "SELECT row_id, " + ", ".join(
    f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, 0), {hi}) END, 6) AS {c}" for c, hi in RANGED.items())
    + " FROM r")
def cln6(spark, d):
    out = clean.apply_ranges(products(spark, d)).select("row_id", *RANGED)
    return rounded(out, 6, *RANGED)


def iqr_chain(source: str, cols: list[str]) -> str:
    """CTEs f0..fn, each dropping the rows outside the fences of one more column."""
    out, current = "", source
    for i, c in enumerate(cols):
        out += f""", b{i} AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {current})
, f{i} AS (SELECT s.* FROM {current} s, b{i} WHERE {c} >= a - 1.5 * (b - a) AND {c} <= b + 1.5 * (b - a))"""
        current = f"f{i}"
    return out


IQR_COLUMNS = ["energy_100g", "proteins_100g", "carbohydrates_100g", "fat_100g", "fiber_100g"]


@query("cln7_sequential_iqr_filter", P + iqr_chain("products", IQR_COLUMNS) + "SELECT row_id FROM f4")
def cln7(spark, d):
    return clean.iqr_filter(products(spark, d), IQR_COLUMNS).select("row_id")


@query("cln7_simultaneous_iqr_filter", P + "".join(
    f", b{i} AS (SELECT quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS z{i} FROM products)"
    for i, c in enumerate(IQR_COLUMNS)) + "SELECT row_id FROM products, " + ", ".join(
    f"b{i}" for i in range(5)) + " WHERE " + " AND ".join(
    f"{c} BETWEEN a{i} - 1.5 * (z{i} - a{i}) AND z{i} + 1.5 * (z{i} - a{i})" for i, c in enumerate(IQR_COLUMNS)))
def cln7b(spark, d):
    return clean.iqr_filter(products(spark, d), IQR_COLUMNS, mode="simultaneous").select("row_id")


CLEANED = ["energy_100g", "proteins_100g", "carbohydrates_100g", "fat_100g", "fiber_100g", "sugars_100g"]


@query("cln1_clean_table", P + f""", i AS (SELECT row_id, code, product_name, categories, brands, energy_100g, proteins_100g,
  coalesce(carbohydrates_100g, (SELECT median(carbohydrates_100g) FROM products)) AS carbohydrates_100g, fat_100g, fiber_100g,
  sugars_100g, {QTY} * CASE WHEN {UNIT} = 'oz' THEN 28.35 WHEN {UNIT} = 'lb' THEN 453.592 WHEN {UNIT} = 'tbsp' THEN 15 ELSE 1 END AS serving_quantity,
  CASE WHEN {UNIT} IN ('oz', 'lb') THEN 'g' WHEN {UNIT} = 'tbsp' THEN 'ml' ELSE {UNIT} END AS serving_unit FROM products)"""
       + ", u AS (SELECT DISTINCT * FROM i)" + iqr_chain("u", CLEANED)
       + "SELECT row_id, code, product_name, categories, brands, round(serving_quantity, 6) AS serving_quantity, serving_unit, "
       + ", ".join(f"round(greatest({c}, 0), 6) AS {c}" for c in CLEANED) + " FROM f5")
def cln1(spark, d):
    out, _ = cleaning.clean_table(products(spark, d))
    return rounded(out, 6, "serving_quantity", *CLEANED)


@query("cln1_cleaning_log", P + """SELECT 1 AS step, 'salt_100g' AS "column", 'removed_column' AS action, 'nulls' AS detail
UNION ALL SELECT 2, 'serving_size', 'removed_column', 'redundant'
UNION ALL SELECT 3, 'carbohydrates_100g', 'imputed_median', (SELECT printf('%.2f', median(carbohydrates_100g)) FROM products)
UNION ALL SELECT 7, 'serving_quantity', 'extracted', '' UNION ALL SELECT 7, 'serving_unit', 'extracted', ''
UNION ALL SELECT * FROM (WITH k AS (SELECT * FROM products)""" + iqr_chain(
    "(SELECT energy_100g, proteins_100g, coalesce(carbohydrates_100g, (SELECT median(carbohydrates_100g) FROM products)) AS carbohydrates_100g, fat_100g, fiber_100g, sugars_100g FROM k)", CLEANED)
       + "SELECT 8, 'proteins_100g', 'corrected_negative', CAST(count(*) AS VARCHAR) FROM f5 WHERE proteins_100g < 0 HAVING count(*) > 0)")
def cln1b(spark, d):
    return cleaning.clean_table(products(spark, d))[1]


@query("cln2_full_clean")
def cln2(spark, d):
    return cleaning.full_clean(products(spark, d))["table"]


@query("cln8_remove_all", "SELECT DISTINCT text, lang, source FROM documents")
def cln8(spark, d):
    return clean.handle_duplicates(read_table(spark, d, "documents").select("text", "lang", "source"), "remove_all")


@query("cln8_keep_first", "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def cln8b(spark, d):
    return clean.handle_duplicates(read_table(spark, d, "documents").select("doc_id", "text", "lang"), "keep_first", "doc_id")


@query("cln8_keep_last", "SELECT max(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def cln8c(spark, d):
    return clean.handle_duplicates(read_table(spark, d, "documents").select("doc_id", "text", "lang"), "keep_last", "doc_id")


@query("agg22_aggregate_duplicates", P + """, m AS (SELECT product_name, brands, serving_size, row_number() OVER (
  PARTITION BY product_name, brands ORDER BY count(*) DESC, serving_size) AS rn
  FROM products WHERE serving_size IS NOT NULL GROUP BY product_name, brands, serving_size)
SELECT a.*, m.serving_size FROM (SELECT product_name, brands, round(avg(energy_100g), 6) AS energy_100g,
  round(avg(carbohydrates_100g), 6) AS carbohydrates_100g FROM products GROUP BY product_name, brands) a
LEFT JOIN m ON m.product_name = a.product_name AND m.brands = a.brands AND rn = 1""")
def agg22(spark, d):
    df = products(spark, d).select("product_name", "brands", "serving_size", "energy_100g", "carbohydrates_100g")
    out = clean.handle_duplicates(df, "aggregate", key_cols=["product_name", "brands"])
    return rounded(out, 6, "energy_100g", "carbohydrates_100g")


DUP = ["product_name", "brands", "serving_size"]


@query("agg10_duplicate_report", P + """, g AS (SELECT count(*) AS n FROM products GROUP BY product_name, brands, serving_size)
SELECT 'full_row' AS scope, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g
UNION ALL SELECT 'all_copies', CAST(sum(n) FILTER (n > 1) AS BIGINT) FROM g UNION ALL """ + per_column(
    "SELECT 'column:{c}', count(*) - count(DISTINCT coalesce({c}, '<gap>')) FROM products", DUP))
def agg10(spark, d):
    return clean.handle_duplicates(products(spark, d).select(*DUP), "analyze")


@query("agg10_duplicate_rows", P + "SELECT product_name, brands, serving_size, count(*) AS copies FROM products GROUP BY ALL HAVING count(*) > 1")
def agg10b(spark, d):
    return clean.duplicate_rows(products(spark, d).select(*DUP))


# --- types and selection --------------------------------------------------------------------------

def _range_sql(table: str, c: str, old: str) -> str:
    return f"""SELECT '{c}' AS "column", '{old}' AS old_type, min({c}) AS lo, max({c}) AS hi,
      count(*) FILTER ({c} <> floor({c})) > 0 AS f FROM {table}"""


LINE_NUMBERS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double")]


@query("typ1_narrowest_types", "WITH r AS (" + " UNION ALL ".join(_range_sql("lineitem", c, t) for c, t in LINE_NUMBERS) + """)
SELECT * FROM (SELECT "column", old_type, CASE WHEN f THEN 'float' WHEN lo >= 0 AND hi <= 255 THEN 'smallint'
  WHEN lo >= 0 AND hi <= 65535 THEN 'int' WHEN lo >= 0 THEN 'bigint' END AS new_type FROM r) WHERE old_type <> new_type""")
def typ1(spark, d):
    return types.narrow_numeric(read_table(spark, d, "lineitem"))[1]


@query("typ2_narrowed_values", """SELECT l_orderkey, CAST(l_quantity AS SMALLINT) AS l_quantity, l_linenumber,
  round(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 4) AS l_discount FROM lineitem""")
def typ2(spark, d):
    out, _ = types.narrow_numeric(read_table(spark, d, "lineitem"))
    return out.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "l_quantity",
                      F.col("l_linenumber").cast("int").alias("l_linenumber"),
                      F.round(F.col("l_discount").cast("double"), 4).alias("l_discount"))


@query("typ3_dictionary", P + per_column("""SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
  row_number() OVER (ORDER BY {c}) - 1 AS code FROM products WHERE {c} IS NOT NULL GROUP BY {c}""",
    ["brands", "categories", "serving_size"]))
def typ3(spark, d):
    return types.dictionary(products(spark, d), ["brands", "categories", "serving_size"])


@query("typ3_dictionary_savings", P + "SELECT \"column\", n_values, plain_bytes, vb + nr * CASE WHEN n_values <= 255 THEN 1 WHEN n_values <= 65535 THEN 2 ELSE 4 END AS coded_bytes, "
       "round((plain_bytes - (vb + nr * CASE WHEN n_values <= 255 THEN 1 WHEN n_values <= 65535 THEN 2 ELSE 4 END)) / plain_bytes * 100, 6) AS savings_pct FROM ("
       + per_column("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_values, count({c}) AS nr,
  CAST(sum(strlen({c})) AS BIGINT) AS plain_bytes, (SELECT CAST(sum(strlen(v)) AS BIGINT) FROM (SELECT DISTINCT {c} AS v FROM products)) AS vb
  FROM products""", ["brands", "categories", "serving_size", "code"]) + ")")
def typ3b(spark, d):
    out = types.dictionary_savings(products(spark, d), ["brands", "categories", "serving_size", "code"])
    return rounded(out, 6, "savings_pct")


@query("typ4_ordinal_detection", P + """SELECT 'brands' AS "column", false AS is_ordinal, count(DISTINCT brands) AS n FROM products
UNION ALL SELECT 'code', bool_and(regexp_matches(code, '^[0-9]+$')), count(DISTINCT code) FROM products
UNION ALL SELECT 'level', true, 3 UNION ALL SELECT 'categories', false, count(DISTINCT categories) FROM products""")
def typ4(spark, d):
    level = F.when(F.col("energy_100g") < 500, "low").when(F.col("energy_100g") < 1500, "medium").otherwise("high")
    df = products(spark, d).withColumn("level", level)
    cols = ["brands", "code", "level", "categories"]
    return types.ordinal_report(df, cols).join(
        F.broadcast(reports.profile_table(df.select(*cols)).select("column", F.col("distinct").alias("n"))), "column")


@query("typ5_extended_ordinal_detection", P + """SELECT 'brands' AS "column", false AS is_ordinal
UNION ALL SELECT 'shipped', bool_and(TRY_CAST(strftime(l_shipdate, '%Y-%m-%d') AS DATE) IS NOT NULL) FROM lineitem
UNION ALL SELECT 'often', true FROM (SELECT count(*) FROM products)
UNION ALL SELECT 'key', count(DISTINCT event_id) = count(*) FROM events""")
def typ5(spark, d):
    often = F.when(F.col("fat_100g") < 10, "jamais").when(F.col("fat_100g") < 20, "parfois").otherwise("souvent")
    df = products(spark, d)
    one = types.ordinal_report(df.select("brands", often.alias("often")), extended=True)
    keys = read_table(spark, d, "events").select(F.concat(F.lit("-"), F.col("event_id").cast("string")).alias("key"))
    one = one.unionByName(types.ordinal_report(keys, extended=True))
    dates = read_table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    return one.unionByName(types.ordinal_report(dates, extended=True))


@query("typ6_natural_order_numbers", """SELECT CAST(n_nationkey AS VARCHAR) AS value, row_number() OVER (ORDER BY n_nationkey) - 1 AS position FROM nation""")
def typ6(spark, d):
    return types.natural_order(read_table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k")), "k")


@query("typ6_natural_order_text", """SELECT o_orderpriority AS value, row_number() OVER (ORDER BY o_orderpriority) - 1 AS position
FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def typ6b(spark, d):
    return types.natural_order(read_table(spark, d, "orders"), "o_orderpriority")


@query("typ6_natural_order_vocabulary", """SELECT value, position FROM (VALUES ('jamais', 0), ('rarement', 1), ('parfois', 2), ('souvent', 3))
 v(value, position) WHERE EXISTS (SELECT 1 FROM orders)""")
def typ6c(spark, d):
    k = F.col("o_orderkey") % 4
    word = F.when(k == 0, "souvent").when(k == 1, "parfois").when(k == 2, "jamais").otherwise("rarement")
    return types.natural_order(read_table(spark, d, "orders").select(word.alias("w")), "w").select(
        "value", F.col("position").cast("int").alias("position"))


@query("typ7_category_roles", P + "SELECT \"column\", CASE WHEN n > 30 THEN 'too_many_categories' ELSE 'nominal' END AS role FROM (" + per_column(
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM products", TEXT) + ")")
def typ7(spark, d):
    return types.split_categories(products(spark, d), 30)


@query("typ7_given_ordinals", P + "SELECT \"column\", CASE WHEN n > 30 THEN 'too_many_categories' WHEN \"column\" = 'brands' THEN 'ordinal' ELSE 'nominal' END AS role FROM (" + per_column(
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM products", TEXT) + ")")
def typ7b(spark, d):
    return types.split_categories(products(spark, d), 30, ordinal_columns=["brands"])


@query("typ8_process_numeric", P + """SELECT "column", CASE WHEN n / "rows" < 0.01 THEN 'dropped' ELSE 'narrowed' END AS action,
  CASE WHEN n / "rows" < 0.01 THEN 'low_variance' ELSE 'double->float' END AS detail FROM (""" + per_column(
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n, count(*) AS \"rows\" FROM products", NUMBERS) + ")")
def typ8(spark, d):
    _, log = types.process_numeric(products(spark, d), 0.01)
    return spark.createDataFrame(log, "column string, action string, detail string")


@query("sel1_select_features", P + ", s AS (" + per_column(
    """SELECT '{c}' AS "column", (count(*) - count({c})) / count(*) AS gaps, count(DISTINCT {c}) AS n, count(*) AS "rows" FROM products""", COLUMNS)
       + """) SELECT "column", CASE WHEN gaps > 0.5 THEN 'dropped' WHEN "column" LIKE '%_100g' THEN CASE WHEN n / "rows" < 0.0001 THEN 'dropped' WHEN "column" = 'sugars_100g' THEN 'dropped' ELSE 'numeric' END
  WHEN n > 30 THEN 'dropped' ELSE 'nominal' END AS role,
  CASE WHEN gaps > 0.5 THEN 'too_many_missing' WHEN "column" LIKE '%_100g' THEN CASE WHEN n / "rows" < 0.0001 THEN 'low_variance' WHEN "column" = 'sugars_100g' THEN 'high_correlation' END
  WHEN n > 30 THEN 'too_many_categories' END AS reason FROM s""")
def sel1(spark, d):
    return select.select_features(products(spark, d), min_unique_ratio=0.0001)[1]


@query("sel2_relevant_columns", P + ", s AS (" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", {i} AS position, (count(*) - count({c})) / count(*) AS gaps, count(DISTINCT {c}) / count(*) AS share,
     {'1.0' if c in TEXT else f'var_samp({c})'} AS v FROM products""" for i, c in enumerate(COLUMNS))
       + ") SELECT \"column\", position FROM s WHERE gaps <= 0.3 AND v >= 0.01 AND share >= 0.001")
def sel2(spark, d):
    return select.relevant_columns(products(spark, d), unique_ratio_threshold=0.001)


# --- limits and sets ------------------------------------------------------------------------------

@query("srt1_first_rows", P + "SELECT * FROM products ORDER BY row_id LIMIT 100")
def srt1(spark, d):
    return products(spark, d).orderBy("row_id").limit(100)


@query("set2_distinct_rows", P + "SELECT DISTINCT product_name, categories, brands FROM products")
def set2(spark, d):
    return products(spark, d).select("product_name", "categories", "brands").dropDuplicates()


@query("set4_vocabulary_subset", """SELECT bool_and(lang IN ('de', 'en', 'es', 'fr', 'it', 'nl', 'pt')) AS known,
  bool_and(lang IN ('en', 'fr')) AS english_or_french FROM documents""")
def set4(spark, d):
    inside = lambda words: F.bool_and(F.lower("lang").isin(words))
    return read_table(spark, d, "documents").agg(
        inside(list(text.FUNCTION_WORDS)).alias("known"), inside(["en", "fr"]).alias("english_or_french"))


@query("src6_numeric_table", P + "SELECT row_id, CAST(code AS DOUBLE) AS code, "
       + "coalesce(CAST(nullif(regexp_replace(serving_size, '[^0-9.-]', '', 'g'), '') AS DOUBLE), (SELECT median(CAST(nullif(regexp_replace(serving_size, '[^0-9.-]', '', 'g'), '') AS DOUBLE)) FROM products)) AS serving_size, "
       + "CAST(regexp_replace(brands, '[^0-9.-]', '', 'g') AS DOUBLE) AS brands, "
       + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM products)), 6) AS {c}" for c in NUMBERS) + " FROM products")
def src6(spark, d):
    out, _ = columns.to_numeric_table(products(spark, d), id_cols=["row_id"])
    return rounded(out, 6, *NUMBERS)
