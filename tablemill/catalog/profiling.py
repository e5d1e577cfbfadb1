"""Profiling and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog.registry import (COLUMNS, NUMBERS, PRODUCTS_SQL, TEXT, WITH_PRODUCTS, per_column, query)
from tablemill.functions.numbers import quoted
from tablemill.operators import columns, reports
from tablemill.operators.profile import profile_table
from tablemill.sources.tables import products, read_table

CATEGORY_COLUMNS = ["product_name", "categories", "brands", "serving_size"]


def rounded(df, digits: int, *cols: str):
    """Round so that sums added in another order still compare equal."""
    return df.withColumns({c: F.round(quoted(c), digits) for c in cols})


def _kind_flags(c: str) -> str:
    text = c in TEXT
    dtype = "string" if text else "double"
    return f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, count(*) AS "rows",
  count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct,
  count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) / count(*) * 100, 2) AS distinct_pct,
  count(DISTINCT {c}) = 1 AS is_constant,
  {'count(DISTINCT ' + c + ') / count(*) > 0.5' if text else 'false'} AS is_high_cardinality,
  {'false' if text else 'count(DISTINCT ' + c + ') / count(*) < 0.01'} AS is_low_variance FROM products"""


@query("agg1_quality_report", WITH_PRODUCTS + "\nUNION ALL\n".join(_kind_flags(c) for c in COLUMNS))
def agg1(spark, d):
    return reports.quality_report(products(spark, d))


WIDE_KEYS = ["wide", "exact", "small"]


def wide_keys(spark, d):
    """Integers beyond 2^53 and decimals of 38 digits, which a double cannot tell apart."""
    return read_table(spark, d, "lineitem").select(
        (F.col("l_orderkey") + F.lit(2**60)).alias("wide"),
        (F.col("l_partkey").cast("decimal(38,0)") + F.lit("100000000000000000000").cast("decimal(38,0)")).cast("decimal(38,0)").alias("exact"),
        F.col("l_linenumber").alias("small"))


@query("agg1_wide_keys", """SELECT 'wide' AS "column", count(DISTINCT l_orderkey + 1152921504606846976) AS distinct_values FROM lineitem
UNION ALL SELECT 'exact', count(DISTINCT CAST(l_partkey AS DECIMAL(38,0)) + CAST('100000000000000000000' AS DECIMAL(38,0))) FROM lineitem
UNION ALL SELECT 'small', count(DISTINCT l_linenumber) FROM lineitem""")
def agg1b(spark, d):
    return profile_table(wide_keys(spark, d)).select("column", F.col("distinct").alias("distinct_values"))


@query("prj10_wide_keys", "SELECT l_orderkey + 1152921504606846976 AS wide FROM lineitem")
def prj10b(spark, d):
    return columns.drop_flat_columns(wide_keys(spark, d).select("wide", "small"), 0.01)


@query("agg8_empty_column", """SELECT 'value' AS "column", count(*) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS q50 FROM events
UNION ALL SELECT 'gone', 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)""")
def agg8b(spark, d):
    df = read_table(spark, d, "events").select("value", F.lit(None).cast("double").alias("gone"))
    return rounded(reports.describe_table(df, ["value", "gone"]).select("column", "count", "mean", "q50"), 6, "mean", "q50")


@query("agg2_missing_report", WITH_PRODUCTS + "SELECT * FROM (" + per_column(
    """SELECT '{c}' AS "column", round((count(*) - count({c})) / count(*) * 100, 9) AS null_pct,
    (count(*) - count({c})) / count(*) * 100 > 50 AS alert FROM products""", COLUMNS) + ") WHERE null_pct > 0")
def agg2(spark, d):
    return rounded(reports.missing_report(products(spark, d)), 9, "null_pct")


@query("agg3_consistency_report", WITH_PRODUCTS + """
SELECT 'energy_over_900' AS rule, count(*) FILTER (energy_100g > 900) AS violations FROM products
UNION ALL SELECT 'macros_over_100', count(*) FILTER (coalesce(carbohydrates_100g, 0) + coalesce(proteins_100g, 0)
  + coalesce(fat_100g, 0) > 100) FROM products""")
def agg3(spark, d):
    return reports.consistency_report(products(spark, d), energy="energy_100g")


@query("agg4_problem_columns", WITH_PRODUCTS + "SELECT * FROM (" + per_column(
    """SELECT '{c}' AS "column", 'high_missing' AS issue, round((count(*)-count({c}))/count(*), 9) AS ratio
       FROM products HAVING (count(*)-count({c}))/count(*) > 0.5
    UNION ALL SELECT '{c}', 'high_unique', round(count(DISTINCT {c})/count(*), 9)
       FROM products HAVING count(DISTINCT {c})/count(*) > 0.95
    UNION ALL SELECT '{c}', 'constant', round(count(DISTINCT {c})/count(*), 9)
       FROM products HAVING count(DISTINCT {c}) = 1""", COLUMNS) + r""")
UNION ALL SELECT 'serving_size', 'format_error',
  round(count(*) FILTER (serving_size LIKE '%lb') / count(*), 9) FROM products""")
def agg4(spark, d):
    # sizes in pounds lose their number, which breaks the expected format
    df = products(spark, d).withColumn("serving_size", F.regexp_replace("serving_size", "^[0-9]+ lb$", "lb"))
    return rounded(reports.problem_columns(df), 9, "ratio")


@query("agg5_category_distribution", WITH_PRODUCTS + per_column("""
SELECT '{c}' AS "column", count(*) AS n_categories,
  round(-sum(n / t.total * ln(n / t.total)), 6) AS entropy, round(max(n) / min(n), 6) AS imbalance_ratio,
  round(any_value(t.nulls / t.all_rows), 9) AS null_ratio, round(count(*) / any_value(t.all_rows), 9) AS distinct_ratio
FROM (SELECT {c} AS v, count(*) AS n FROM products WHERE {c} IS NOT NULL GROUP BY 1),
     (SELECT count({c}) AS total, count(*) AS all_rows, count(*) - count({c}) AS nulls FROM products) t""",
    CATEGORY_COLUMNS))
def agg5(spark, d):
    out = reports.category_distribution(products(spark, d), CATEGORY_COLUMNS)
    return rounded(rounded(out, 6, "entropy", "imbalance_ratio"), 9, "null_ratio", "distinct_ratio")


@query("agg6_value_shares", WITH_PRODUCTS + per_column("""
SELECT '{c}' AS "column", {c} AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM products WHERE {c} IS NOT NULL GROUP BY {c}""", CATEGORY_COLUMNS))
def agg6(spark, d):
    return rounded(reports.value_shares(products(spark, d), CATEGORY_COLUMNS), 9, "share")


@query("agg7_distribution_summary", """
SELECT 'value' AS "column", round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(stddev_samp(value), 6) AS sd, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis
FROM events
UNION ALL SELECT 'user_id', round(avg(user_id), 6), round(median(user_id), 6), round(stddev_samp(user_id), 6),
  round(skewness(user_id), 6), round(kurtosis(user_id), 6) FROM events""")
def agg7(spark, d):
    out = reports.distribution_summary(read_table(spark, d, "events"), ["value", "user_id"])
    return rounded(out, 6, "mean", "median", "sd", "skew", "kurtosis")


DESCRIBE_SQL = """SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS "min", round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS "max"
FROM products"""


@query("agg8_describe", WITH_PRODUCTS + per_column(DESCRIBE_SQL, NUMBERS))
def agg8(spark, d):
    out = reports.describe_table(products(spark, d), NUMBERS)
    return rounded(out, 6, "mean", "sd", "min", "q25", "q50", "q75", "max")


@query("agg9_group_centres", WITH_PRODUCTS + """
SELECT categories, round(avg(energy_100g), 6) AS mean, round(median(energy_100g), 6) AS median, any_value(m.mode) AS mode
FROM products JOIN (
  SELECT categories, brands AS mode FROM (
    SELECT categories, brands, row_number() OVER (PARTITION BY categories ORDER BY count(*) DESC, brands) AS rn
    FROM products GROUP BY categories, brands) WHERE rn = 1) m USING (categories)
GROUP BY categories""")
def agg9(spark, d):
    return rounded(reports.group_centres(products(spark, d), "categories", "energy_100g", "brands"), 6,
                   "mean", "median")


def _relevance(c: str) -> str:
    share = f"count(DISTINCT {c})/count(*)"
    unique = f"least({share}, 0.5)*2"
    var = "NULL" if c in TEXT else f"var_samp({c})"
    spread = unique if c in TEXT else (
        f"least(var_samp({c}) / pow(CASE WHEN max({c}) <> min({c}) THEN max({c}) - min({c}) ELSE 1 END, 2), 1)")
    missing = f"count({c})/count(*)"
    return f"""SELECT '{c}' AS "column", round((count(*)-count({c}))/count(*), 6) AS null_ratio,
  round(CAST({var} AS DOUBLE), 6) AS variance, round({share}, 6) AS distinct_ratio,
  round({spread}, 6) AS variance_score, round({missing}, 6) AS missing_score, round({unique}, 6) AS unique_score,
  round({spread}*0.3 + {missing}*0.3 + {unique}*0.4, 6) AS total_score FROM products"""


RELEVANCE_SQL = "\nUNION ALL\n".join(_relevance(c) for c in COLUMNS)


@query("agg12_relevance_report", WITH_PRODUCTS + RELEVANCE_SQL)
def agg12(spark, d):
    out = reports.relevance_report(products(spark, d)).drop("position", "kind")
    return rounded(out, 6, *[c for c in out.columns if c != "column"])


def _storage(c: str) -> str:
    size = f"coalesce(sum(strlen({c})), 0)" if c in TEXT else f"count({c})*8"
    hint = f"CASE WHEN count(DISTINCT {c}) <= 255 THEN 'dictionary' END" if c in TEXT else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{c}' AS "column", '{'string' if c in TEXT else 'double'}' AS dtype,
      CAST({size} AS BIGINT) AS bytes, count(DISTINCT {c}) AS "distinct", {hint} AS suggestion FROM products"""


STORAGE_SQL = "\nUNION ALL\n".join(_storage(c) for c in COLUMNS)


@query("agg14_storage_report", WITH_PRODUCTS + f""", s AS ({STORAGE_SQL})
SELECT *, round(bytes / (SELECT sum(bytes) FROM s) * 100, 6) AS bytes_pct FROM s""")
def agg14(spark, d):
    return rounded(reports.storage_report(products(spark, d)), 6, "bytes_pct")


@query("agg15_before_after", WITH_PRODUCTS + """
SELECT 'before' AS stage, count(*) AS "rows", 13 AS "columns",
  CAST(sum(CAST(serving_size IS NULL AS INT) + CAST(carbohydrates_100g IS NULL AS INT)
    + CAST(salt_100g IS NULL AS INT)) AS BIGINT) AS null_cells, 'fat_ratio' AS added, 'salt_100g' AS removed FROM products
UNION ALL SELECT 'after', count(*), 13,
  CAST(sum(CAST(serving_size IS NULL AS INT) + CAST(carbohydrates_100g IS NULL AS INT)) AS BIGINT), 'fat_ratio', 'salt_100g'
  FROM products WHERE energy_100g <= 3000""")
def agg15(spark, d):
    before = products(spark, d)
    after = before.where("energy_100g <= 3000").drop("salt_100g").withColumn(
        "fat_ratio", F.col("fat_100g") / F.lit(100.0))
    return reports.before_after(before, after)


@query("agg17_category_summary", WITH_PRODUCTS + per_column("""
SELECT '{c}' AS "column", max(v) FILTER (rk = 1) AS most_common, max(pct) FILTER (rk = 1) AS most_common_pct,
  string_agg(v || ' (' || printf('%.2f', pct) || '%)', ', ' ORDER BY rk) FILTER (rk <= 3) AS top3,
  count(*) AS unique_values
FROM (SELECT {c} AS v, round(count(*) / (SELECT count(*) FROM products) * 100, 2) AS pct,
        row_number() OVER (ORDER BY count(*) DESC, {c}) AS rk FROM products WHERE {c} IS NOT NULL GROUP BY {c})""",
    CATEGORY_COLUMNS))
def agg17(spark, d):
    return reports.category_summary(products(spark, d), CATEGORY_COLUMNS)


@query("agg18_contingency", "SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL")
def agg18(spark, d):
    return reports.contingency(read_table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


HISTOGRAM_SQL = """
WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / {bins} AS w FROM events)
SELECT bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, n FROM (
  SELECT CAST(least(floor((value - lo) / w), {bins} - 1) AS INTEGER) AS bin, count(*) AS n
  FROM events, s GROUP BY 1), s"""


@query("agg19_histogram_30_bins", HISTOGRAM_SQL.format(bins=30))
def agg19(spark, d):
    return rounded(reports.histogram(read_table(spark, d, "events"), "value", 30), 6, "low", "high")


@query("agg19_histogram_sqrt_bins",
       HISTOGRAM_SQL.format(bins="(SELECT least(50, floor(sqrt(count(value)))) FROM events)"))
def agg19b(spark, d):
    return rounded(reports.histogram(read_table(spark, d, "events"), "value", None), 6, "low", "high")


@query("agg20_box_plot_table", WITH_PRODUCTS + """
SELECT *, CAST(floor((row_number() OVER (ORDER BY span, "column") - 1) / 5) AS INTEGER) AS panel FROM (""" + per_column("""
SELECT '{c}' AS "column", round(any_value(q1), 6) AS q1, round(any_value(md), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min({c}) FILTER ({c} BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)), 6) AS whisker_low,
  round(max({c}) FILTER ({c} BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)), 6) AS whisker_high,
  count(*) FILTER (NOT {c} BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS outliers,
  round(max({c}) - min({c}), 6) AS span
FROM products, (SELECT quantile_cont({c}, 0.25) AS q1, median({c}) AS md, quantile_cont({c}, 0.75) AS q3 FROM products)""",
    NUMBERS) + ")")
def agg20(spark, d):
    out = reports.box_plot_table(products(spark, d), NUMBERS)
    return rounded(out, 6, "q1", "median", "q3", "whisker_low", "whisker_high", "span")


@query("agg21_dtype_distribution", WITH_PRODUCTS + f""", s AS ({STORAGE_SQL})
SELECT dtype, count(*) AS n_columns, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY dtype""")
def agg21(spark, d):
    return reports.dtype_distribution(products(spark, d))


@query("agg21_group_statistics", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS "min",
  max(value) AS "max", count(value) AS "count" FROM events GROUP BY event_type""")
def agg21b(spark, d):
    return rounded(reports.group_statistics(read_table(spark, d, "events"), "event_type", "value"), 6, "mean", "sd")


@query("agg21_largest_columns", WITH_PRODUCTS + f""", s AS ({STORAGE_SQL})
SELECT "column", bytes FROM s ORDER BY bytes DESC, "column" LIMIT 10""")
def agg21c(spark, d):
    out = reports.storage_report(products(spark, d)).select("column", "bytes")
    return out.orderBy(F.col("bytes").desc(), "column").limit(10)


@query("srt2_extreme_categories", WITH_PRODUCTS + per_column("""
SELECT '{c}' AS "column", 'most' AS side, position, value, n FROM (
  SELECT {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS position
  FROM products WHERE {c} IS NOT NULL GROUP BY {c}) WHERE position <= 5
UNION ALL SELECT '{c}', 'least', position, value, n FROM (
  SELECT {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*), {c} DESC) AS INTEGER) AS position
  FROM products WHERE {c} IS NOT NULL GROUP BY {c}) WHERE position <= 5""", CATEGORY_COLUMNS))
def srt2(spark, d):
    return reports.extreme_categories(products(spark, d), CATEGORY_COLUMNS)
