"""Queries for outliers, encoding, scaling, projection and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog.profiling import DESCRIBE_SQL, rounded
from tablemill.catalog.registry import NUMBERS, TEXT, WITH_PRODUCTS, per_column, query
from tablemill.functions.numbers import quoted
from tablemill.operators import clean, correlate, encode, outliers, project, scale, select, types
from tablemill.operators.joins import lookup, small_side
from tablemill.operators.ranks import value_counts
from tablemill.operators.reports import value_shares
from tablemill.session import work_path
from tablemill.sources.tables import products, read_table

P = WITH_PRODUCTS

# --- outliers -------------------------------------------------------------------------------------

FENCES = "SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}"


@query("out1_tukey", f"""WITH f AS ({FENCES.format(c='value', t='events')})
SELECT event_id, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM events, f""")
def out1(spark, d):
    out, _ = outliers.flag_tukey(read_table(spark, d, "events"), "value")
    return out.select("event_id", "value", "is_outlier")


ANOMALY_COLUMNS = ["energy_100g", "proteins_100g", "fat_100g"]


def _anomalies(group: str | None) -> str:
    label, by = (group, f"GROUP BY {group}") if group else ("'all'", "")
    key = f"p.{group} = f.g" if group else "true"
    return P + per_column(f"""SELECT {'p.' + group if group else label} AS category, '{{c}}' AS "column", row_id AS id
  FROM products p JOIN (SELECT {label} AS g, quantile_cont({{c}}, 0.25) AS a, quantile_cont({{c}}, 0.75) AS b FROM products {by}) f
  ON {key} WHERE {{c}} < a - 0.5 * (b - a) OR {{c}} > b + 0.5 * (b - a)""", ANOMALY_COLUMNS)


@query("out2_category_anomalies", _anomalies("categories"))
def out2(spark, d):
    return outliers.category_anomalies(products(spark, d), "row_id", ANOMALY_COLUMNS, factor=0.5)


@query("out2_overall_anomalies", _anomalies(None))
def out2b(spark, d):
    return outliers.category_anomalies(products(spark, d), "row_id", ANOMALY_COLUMNS, by=None, factor=0.5)


ZSCORE = """SELECT event_id, abs((value - m) / s) > 3 AS is_outlier FROM events,
 (SELECT avg(value) AS m, {sd}(value) AS s FROM events)"""


@query("out3_zscore_population", ZSCORE.format(sd="stddev_pop"))
def out3(spark, d):
    return outliers.flag_zscore(read_table(spark, d, "events"), "value")[0].select("event_id", "is_outlier")


@query("out3_zscore_sample", ZSCORE.format(sd="stddev_samp"))
def out3b(spark, d):
    return outliers.flag_zscore(read_table(spark, d, "events"), "value", ddof=1)[0].select("event_id", "is_outlier")


BOUND_COLUMNS = ["energy_100g", "proteins_100g", "carbohydrates_100g", "fat_100g"]


@query("out4_bounds_iqr", P + per_column("""SELECT '{c}' AS "column",
  count(*) FILTER ({c} < a - 0.5 * (b - a) OR {c} > b + 0.5 * (b - a)) AS n_outliers,
  round(count(*) FILTER ({c} < a - 0.5 * (b - a) OR {c} > b + 0.5 * (b - a)) / count(*), 9) AS ratio,
  round(any_value(a - 0.5 * (b - a)), 6) AS lower, round(any_value(b + 0.5 * (b - a)), 6) AS upper FROM products, ("""
       + FENCES.replace("{t}", "products") + ")", BOUND_COLUMNS))
def out4(spark, d):
    _, report = outliers.bounds_table(products(spark, d), BOUND_COLUMNS, "iqr", 0.5)
    return rounded(rounded(report, 9, "ratio"), 6, "lower", "upper")


@query("out4_bounds_zscore", P + per_column("""SELECT '{c}' AS "column",
  count(*) FILTER ({c} < m - 1.5 * s OR {c} > m + 1.5 * s) AS n_outliers,
  round(count(*) FILTER ({c} < m - 1.5 * s OR {c} > m + 1.5 * s) / count(*), 9) AS ratio,
  round(any_value(m - 1.5 * s), 6) AS lower, round(any_value(m + 1.5 * s), 6) AS upper FROM products,
  (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM products)""", BOUND_COLUMNS))
def out4b(spark, d):
    _, report = outliers.bounds_table(products(spark, d), BOUND_COLUMNS, "zscore", 1.5)
    return rounded(rounded(report, 9, "ratio"), 6, "lower", "upper")


@query("out4_clip", P + "SELECT row_id, " + ", ".join(
    f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, a{i} - 0.5 * (b{i} - a{i})), b{i} + 0.5 * (b{i} - a{i})) END, 6) AS {c}"
    for i, c in enumerate(BOUND_COLUMNS)) + " FROM products, " + ", ".join(
    f"(SELECT quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS b{i} FROM products)" for i, c in enumerate(BOUND_COLUMNS)))
def out4c(spark, d):
    df = products(spark, d).select("row_id", *BOUND_COLUMNS)
    bounds, _ = outliers.bounds_table(df, BOUND_COLUMNS, "iqr", 0.5)
    return rounded(outliers.apply_bounds(df, bounds, "clip"), 6, *BOUND_COLUMNS)


@query("out4_remove", P + "SELECT row_id FROM products, " + ", ".join(
    f"(SELECT quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS b{i} FROM products)" for i, c in enumerate(BOUND_COLUMNS))
       + " WHERE " + " AND ".join(f"({c} IS NULL OR {c} BETWEEN a{i} - 0.5 * (b{i} - a{i}) AND b{i} + 0.5 * (b{i} - a{i}))"
                                  for i, c in enumerate(BOUND_COLUMNS)))
def out4d(spark, d):
    df = products(spark, d)
    bounds, _ = outliers.bounds_table(df, BOUND_COLUMNS, "iqr", 0.5)
    return outliers.apply_bounds(df, bounds, "remove").select("row_id")


MCD_SQL = """WITH v AS (SELECT s_suppkey AS id, s_acctbal AS x, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS r FROM supplier),
n AS (SELECT count(*) AS n, CAST(ceil(0.5 * (count(*) + 2)) AS BIGINT) AS h FROM v),
runs AS (SELECT lo.x AS a, hi.x AS b, hi.x - lo.x AS w FROM v lo, v hi, n WHERE hi.r = lo.r + n.h),
loc AS (SELECT avg((a + b) * 0.5) AS c FROM runs WHERE w = (SELECT min(w) FROM runs)),
near AS (SELECT x, row_number() OVER (ORDER BY abs(x - c), x) AS k FROM v, loc),
raw AS (SELECT var_pop(x) AS s2 FROM near, n WHERE k <= h),
dist AS (SELECT x, (x - c) * (x - c) / s2 AS d FROM v, loc, raw),
cor AS (SELECT median(d) / 0.454936423119572 AS f FROM dist),
core AS (SELECT avg(x) AS m, var_pop(x) AS s2 FROM dist, cor WHERE d / f < 5.023886187314888),
fin AS (SELECT id, (x - m) * (x - m) / s2 AS distance FROM v, core)
SELECT id AS s_suppkey, round(distance, 6) AS distance, distance > (SELECT quantile_cont(distance, 0.9) FROM fin) AS is_outlier FROM fin"""


@query("out5_robust_ellipse", MCD_SQL)
def out5(spark, d):
    out, _ = outliers.flag_elliptic(read_table(spark, d, "supplier"), "s_acctbal", "s_suppkey")
    return rounded(out.select("s_suppkey", "distance", "is_outlier"), 6, "distance")


@query("out6_isolation_forest")
def out6(spark, d):
    out, _ = outliers.flag_forest(read_table(spark, d, "events"), "value", "event_id")
    return out.select("event_id", "value", "score", "is_outlier")


@query("out6_facts", "SELECT count(*) AS n, true AS few FROM events")
def out6b(spark, d):
    """No row is lost, and about the wanted tenth is flagged, but no more."""
    return out6(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_outlier").cast("int")).between(0.05, 0.1).alias("few"))


LOF_SQL = """WITH v AS (SELECT event_id AS id, value AS x, row_number() OVER (ORDER BY value, event_id) AS r FROM events),
pairs AS (SELECT p.id, p.r, q.r AS qr, abs(p.x - q.x) AS dist,
    row_number() OVER (PARTITION BY p.r ORDER BY abs(p.x - q.x), q.r) AS k
  FROM v p JOIN v q ON q.r BETWEEN p.r - 20 AND p.r + 20 AND q.r <> p.r),
nb AS (SELECT * FROM pairs WHERE k <= 20),
kd AS (SELECT r, max(dist) AS kdist FROM nb GROUP BY r),
lrd AS (SELECT nb.r, 1.0 / (avg(greatest(nb.dist, kd.kdist)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.r = nb.qr GROUP BY nb.r),
lof AS (SELECT nb.id, avg(o.lrd) / any_value(me.lrd) AS lof FROM nb JOIN lrd o ON o.r = nb.qr JOIN lrd me ON me.r = nb.r GROUP BY nb.id)
SELECT id AS event_id, round(lof, 4) AS lof FROM lof"""


@query("out7_local_outlier_factor", LOF_SQL)
def out7(spark, d):
    scores = outliers.lof_scores(read_table(spark, d, "events"), "value", "event_id", 20)
    return rounded(scores.select(F.col("id").alias("event_id"), "lof"), 4, "lof")


@query("out8_remove_outliers", f"""WITH f AS ({FENCES.format(c='value', t='events')})
SELECT event_id, value FROM events, f WHERE NOT (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))""")
def out8(spark, d):
    return outliers.treat_outliers(read_table(spark, d, "events"), "value", "remove").select("event_id", "value")


@query("out8_cap_outliers", """SELECT event_id, round(least(greatest(value, m - 3 * s), m + 3 * s), 6) AS value FROM events,
 (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""")
def out8b(spark, d):
    out = outliers.treat_outliers(read_table(spark, d, "events"), "value", "cap", "zscore")
    return rounded(out.select("event_id", "value"), 6, "value")


@query("out8_impute_outliers", f"""WITH f AS ({FENCES.format(c='value', t='events')}),
m AS (SELECT event_id, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS o FROM events, f)
SELECT event_id, round(CASE WHEN o THEN (SELECT median(value) FROM m WHERE NOT o) ELSE value END, 6) AS value FROM m""")
def out8c(spark, d):
    out = outliers.treat_outliers(read_table(spark, d, "events"), "value", "impute")
    return rounded(out.select("event_id", "value"), 6, "value")


@query("out8_cap_lof_outliers", LOF_SQL.replace("SELECT id AS event_id, round(lof, 4) AS lof FROM lof", """SELECT event_id,
 CASE WHEN lof > (SELECT quantile_cont(lof, 0.9) FROM lof) THEN (SELECT median(value) FROM events) ELSE value END AS value
FROM events JOIN lof ON id = event_id"""))
def out8d(spark, d):
    df = read_table(spark, d, "events").select("event_id", "value")
    return outliers.treat_outliers(df, "value", "cap", "lof", "event_id")


@query("out8_repeated_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def out8e(spark, d):
    """An id that repeats neither multiplies nor loses rows."""
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice")
    out = outliers.treat_outliers(df, "l_extendedprice", "cap", "lof", "l_orderkey")
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("out4_empty_column", """WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT 'value' AS "column", count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS n_outliers,
 round(any_value(a - 1.5 * (b - a)), 6) AS lower, round(any_value(b + 1.5 * (b - a)), 6) AS upper FROM events, f
UNION ALL SELECT 'gone', 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)""")
def out4e(spark, d):
    df = read_table(spark, d, "events").select("value", F.lit(None).cast("double").alias("gone"))
    _, report = outliers.bounds_table(df, ["value", "gone"])
    return rounded(report.drop("ratio"), 6, "lower", "upper")


@query("out9_outlier_summary", f"""WITH f AS ({FENCES.format(c='value', t='events')}),
z AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
SELECT count(*) AS total_values, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outlier_count,
  round(count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*) * 100, 6) AS outlier_percentage,
  'tukey' AS detection_method FROM events, f
UNION ALL SELECT count(*), count(*) FILTER (abs((value - m) / s) > 3),
  round(count(*) FILTER (abs((value - m) / s) > 3) / count(*) * 100, 6), 'zscore' FROM events, z""")
def out9(spark, d):
    df = read_table(spark, d, "events")
    both = outliers.outlier_summary(df, "value").unionByName(outliers.outlier_summary(df, "value", "zscore"))
    return rounded(both, 6, "outlier_percentage")


# --- encoding -------------------------------------------------------------------------------------

@query("enc1_label_encoding", """SELECT o_orderkey, CAST(r.code AS INTEGER) AS o_orderpriority FROM orders JOIN (
  SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)) r ON p = o_orderpriority""")
def enc1(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return encode.label_encode(df, ["o_orderpriority"])


@query("enc2_one_hot_columns", "SELECT o_orderkey, " + ", ".join(
    f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\""
    for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def enc2(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return encode.one_hot_columns(df, ["o_orderpriority"])


@query("enc2_one_hot_vectors", P + """SELECT row_id, row_number() OVER () * 0 + r.code AS slot, n.n AS width FROM products
 JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT brands AS v FROM products)) r ON v = brands,
 (SELECT count(DISTINCT brands) AS n FROM products) n""")
def enc2b(spark, d):
    from pyspark.ml.functions import vector_to_array

    out = encode.one_hot_vectors(products(spark, d).select("row_id", "brands"), "brands", "vector")
    slots = vector_to_array("vector")
    return out.select("row_id", (F.array_position(slots, 1.0) - 1).alias("slot"),
                      F.size(slots).cast("long").alias("width"))


@query("enc3_count_encoding", P + """SELECT row_id, count(serving_size) OVER (PARTITION BY serving_size) AS serving_size_count
 FROM products WHERE serving_size IS NOT NULL UNION ALL SELECT row_id, NULL FROM products WHERE serving_size IS NULL""")
def enc3(spark, d):
    return encode.count_encode(products(spark, d), "serving_size", "serving_size_count").select(
        "row_id", "serving_size_count")


@query("enc4_hash_buckets", P + """SELECT row_id, CAST(concat('0x', substr(md5(code), 1, 8)) AS BIGINT) % 256 AS code_hash FROM products""")
def enc4(spark, d):
    return products(spark, d).select("row_id", encode.hash_bucket("code").alias("code_hash"))


@query("enc4_hash_indicators", P + "SELECT row_id, " + ", ".join(
    f"CAST(CAST(concat('0x', substr(md5(brands), 1, 8)) AS BIGINT) % 8 = {i} AS INTEGER) AS brands_hash_{i}" for i in range(8))
    + " FROM products")
def enc4b(spark, d):
    return encode.hash_indicators(products(spark, d).select("row_id", "brands"), "brands").drop("brands")


RARE = """, s AS (SELECT serving_size AS v FROM products WHERE serving_size IS NOT NULL GROUP BY 1
  HAVING count(*) / (SELECT count(serving_size) FROM products) < 0.004) """


@query("enc5_group_rare", P + RARE + """SELECT row_id, CASE WHEN serving_size IN (SELECT v FROM s) THEN 'Other' ELSE serving_size END AS serving_size FROM products""")
def enc5(spark, d):
    df = products(spark, d).select("row_id", "serving_size")
    return encode.handle_rare(df, ["serving_size"], 0.004)


@query("enc5_drop_rare", P + RARE + "SELECT row_id, serving_size FROM products WHERE serving_size IS NULL OR serving_size NOT IN (SELECT v FROM s)")
def enc5b(spark, d):
    df = products(spark, d).select("row_id", "serving_size")
    return encode.handle_rare(df, ["serving_size"], 0.004, "drop")


@query("enc5_rare_report", P + RARE + """SELECT 'serving_size' AS "column", count(DISTINCT serving_size) AS initial_categories,
 (SELECT count(*) FROM s) AS rare_categories FROM products""")
def enc5c(spark, d):
    return encode.rare_report(products(spark, d), ["serving_size"], 0.004)


KEEP = """, c AS (SELECT coalesce(serving_size, 'Unknown') AS v, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC, coalesce(serving_size, 'Unknown')) AS rk FROM products GROUP BY 1),
k AS (SELECT v FROM c WHERE (n / (SELECT sum(n) FROM c) >= 0.005 AND rk <= 20) OR rk <= 2) """


@query("enc6_limit_categories", P + KEEP + """SELECT row_id, CASE WHEN coalesce(serving_size, 'Unknown') IN (SELECT v FROM k)
 THEN coalesce(serving_size, 'Unknown') ELSE 'Other' END AS serving_size FROM products""")
def enc6(spark, d):
    df = products(spark, d).select("row_id", F.coalesce("serving_size", F.lit("Unknown")).alias("serving_size"))
    return encode.limit_categories(df, ["serving_size"])


@query("enc7_encoding_stats", P + "SELECT * FROM (" + per_column("""SELECT '{c}' AS "column", o AS original_categories, e AS encoded_categories,
  round(1 - 1 / e, 9) AS sparsity, 'col_' || substr(md5('{c}'), 1, 8) AS file_prefix, 'one_hot' AS strategy FROM (
  SELECT count(*) AS o, least(count(*), count(*) FILTER ((share >= 0.005 AND rk <= 20) OR rk <= 2)
     + CAST(count(*) FILTER (NOT ((share >= 0.005 AND rk <= 20) OR rk <= 2)) > 0 AS INT)) AS e FROM (
    SELECT v, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, v) AS rk FROM (
      SELECT coalesce({c}, 'Unknown') AS v, count(*) AS n FROM products GROUP BY 1)))""",
    ["product_name", "categories", "brands", "serving_size"]) + ")")
def enc7(spark, d):
    return rounded(encode.encode_all(products(spark, d))[1], 9, "sparsity")


@query("enc7_hash_encoded_table", P + per_column("""SELECT '{c}' AS "column", CAST(concat('0x', substr(md5(v), 1, 8)) AS BIGINT) % 256 AS bucket, sum(n)::BIGINT AS n FROM (
   SELECT CASE WHEN (share >= 0.005 AND rk <= 20) OR rk <= 2 THEN v ELSE 'Other' END AS v, n FROM (
    SELECT v, n, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, v) AS rk FROM (
      SELECT coalesce({c}, 'Unknown') AS v, count(*) AS n FROM products GROUP BY 1))) GROUP BY 2""", ["categories", "brands", "serving_size"]))
def enc7b(spark, d):
    cols = ["categories", "brands", "serving_size"]
    out, _ = encode.encode_all(products(spark, d).select(*cols), encode.EncodingConfig(strategy="hash"), cols)
    long = out.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_hash").alias("bucket")) for c in cols])))
    return long.groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("enc8_stored_encoder", "SELECT o_orderkey, n AS o_orderpriority_count FROM orders JOIN "
       "(SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) USING (o_orderpriority) WHERE o_orderstatus = 'P'")
def enc8(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    stored = encode.StoredEncoder(work_path(spark, "encoder"), "count")
    stored.encode(df, ["o_orderpriority"])
    # a later batch is encoded with the table stored by the first one
    return stored.encode(df.where("o_orderstatus = 'P'"), ["o_orderpriority"]).select(
        "o_orderkey", "o_orderpriority_count")


@query("enc9_encoded_rows", """SELECT p_partkey, true AS numbered FROM part""")
def enc9b(spark, d):
    """Every row gets a cluster from 0 to 3 in place of its text, also where the text is missing."""
    df = read_table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("name"), "p_type")
    out = encode.encode_by_cluster(df, ["name", "p_type"], 4)
    return out.select("p_partkey", (F.col("name").between(0, 3) & F.col("p_type").between(0, 3)).alias("numbered"))


@query("enc9_cluster_categories")
def enc9(spark, d):
    return encode.cluster_categories(read_table(spark, d, "part"), "p_name", 5)


@query("agg23_encoding_effect", """SELECT 'before' AS stage, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'after', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def agg23(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return encode.encoding_effect(df, encode.one_hot_columns(df, ["o_orderpriority"]), "o_orderpriority")


@query("joi2_count_lookup", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS part_count FROM lineitem")
def joi2(spark, d):
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    return encode.count_encode(lines, "part", "part_count").drop("part")


@query("joi3_group_statistics_on_rows", P + """SELECT row_id, round(energy_100g - m, 6) AS gap FROM products
 JOIN (SELECT categories, median(energy_100g) AS m FROM products GROUP BY 1) USING (categories)""")
def joi3(spark, d):
    from tablemill.operators.ranks import quantile_table

    df = products(spark, d).select("row_id", "categories", "energy_100g")
    medians = quantile_table(df, ["energy_100g"], [0.5], by=["categories"]).select("categories", F.col("q")[0].alias("m"))
    out = lookup(df, medians, "categories", "categories", "inner")
    return out.select("row_id", F.round(F.col("energy_100g") - F.col("m"), 6).alias("gap"))


@query("joi4_anti_join_rare", P + RARE + "SELECT row_id, serving_size FROM products WHERE serving_size IS NULL OR serving_size NOT IN (SELECT v FROM s)")
def joi4(spark, d):
    df = products(spark, d).select("row_id", "serving_size")
    rare = value_shares(df, ["serving_size"]).where("share < 0.004").select(F.col("value").alias("v"))
    return df.join(small_side(rare), F.col("serving_size") == F.col("v"), "left_anti")


@query("joi4_semi_join_rare", P + RARE + "SELECT row_id, serving_size FROM products WHERE serving_size IN (SELECT v FROM s)")
def joi4b(spark, d):
    df = products(spark, d).select("row_id", "serving_size")
    rare = value_shares(df, ["serving_size"]).where("share < 0.004").select(F.col("value").alias("v"))
    return df.join(small_side(rare), F.col("serving_size") == F.col("v"), "left_semi")


@query("joi6_attach_one_hot_block", "SELECT o_orderkey, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus_F\", "
       "CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatus_P\" FROM orders")
def joi6(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return encode.one_hot_columns(df, ["o_orderstatus"])


# --- scaling and projection -----------------------------------------------------------------------

LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scaled_sql(centre: str, width: str) -> str:
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(({c} - {centre.format(c=c)}) / coalesce(nullif({width.format(c=c)}, 0), 1), 6) AS {c}" for c in LINES) + " FROM lineitem"


def _scaled(spark, d, method):
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINES)
    return rounded(scale.scale(df, LINES, method)[0], 6, *LINES)


@query("scl1_standard_scaling", _scaled_sql("(SELECT avg({c}) FROM lineitem)", "(SELECT stddev_pop({c}) FROM lineitem)"))
def scl1(spark, d):
    return _scaled(spark, d, "standard")


@query("scl2_minmax_scaling", _scaled_sql("(SELECT min({c}) FROM lineitem)", "(SELECT max({c}) - min({c}) FROM lineitem)"))
def scl2(spark, d):
    return _scaled(spark, d, "minmax")


@query("scl3_robust_scaling", _scaled_sql("(SELECT median({c}) FROM lineitem)",
                                          "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"))
def scl3(spark, d):
    return _scaled(spark, d, "robust")


FORMS = {"original": ("0", "1"), "standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"),
         "robust": ("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}


def _comparison_sql() -> str:
    parts = []
    for form, (centre, width) in FORMS.items():
        for c in LINES:
            inner = f"(SELECT ({c} - a) / b AS x FROM lineitem, (SELECT {centre.format(c=c)} AS a, {width.format(c=c)} AS b FROM lineitem))"
            if form == "original":
                inner = f"(SELECT {c} AS x FROM lineitem)"
            parts.append(f"""SELECT '{form}' AS form, '{c}' AS "column", count(x) AS "count", round(avg(x), 5) + 0.0 AS mean, round(stddev_samp(x), 5) AS sd,
 round(min(x), 5) AS "min", round(quantile_cont(x, 0.25), 5) AS q25, round(quantile_cont(x, 0.5), 5) AS q50, round(quantile_cont(x, 0.75), 5) AS q75,
 round(max(x), 5) AS "max" FROM {inner}""")
    return " UNION ALL ".join(parts)


@query("scl4_scaling_comparison", _comparison_sql())
def scl4(spark, d):
    out = scale.scaling_comparison(read_table(spark, d, "lineitem"), LINES)
    out = rounded(out, 5, "mean", "sd", "min", "q25", "q50", "q75", "max")
    return out.withColumn("mean", F.col("mean") + 0.0)


@query("scl4_correlation_changes", " UNION ALL ".join(
    f"""SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) + 0.0 AS before, round(corr({a}, {b}), 6) + 0.0 AS after, false AS changed FROM lineitem"""
    for i, a in enumerate(LINES) for b in LINES[i + 1:]))
def scl4b(spark, d):
    df = read_table(spark, d, "lineitem").select(*LINES)
    out = correlate.correlation_changes(df, scale.scale(df, LINES, "robust")[0], LINES)
    return rounded(out, 6, "before", "after").withColumns({"before": F.col("before") + 0.0, "after": F.col("after") + 0.0})


IMPACT = """SELECT '{form}' AS form, 'value' AS "column", count(x) AS "count", round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS sd,
 round(min(x), 6) AS "min", round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75,
 round(max(x), 6) AS "max", round(any_value(g.g1), 6) AS g1, round(any_value(g.g2), 6) AS g2, any_value(g.o) AS outliers
 FROM t{i}, (SELECT skewness_pop AS g1, kurtosis_pop(x) AS g2, (SELECT count(*) FROM t{i}, (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM t{i})
   WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS o FROM t{i}, (SELECT avg(pow(x - m, 3)) / pow(stddev_pop(x), 3) AS skewness_pop FROM t{i}, (SELECT avg(x) AS m FROM t{i})) GROUP BY skewness_pop) g"""


@query("scl5_scaling_impact", "WITH t0 AS (SELECT value AS x FROM events), t1 AS (SELECT (value - m) / s AS x FROM events, "
       "(SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)) "
       + " UNION ALL ".join(IMPACT.format(form=f, i=i) for i, f in enumerate(("original", "scaled"))))
def scl5(spark, d):
    df = read_table(spark, d, "events").select("event_id", "value")
    out = scale.scaling_impact(df, scale.scale(df, ["value"], "standard")[0], "value").drop("normality_p")
    out = rounded(out, 6, "mean", "sd", "min", "q25", "q50", "q75", "max", "g1", "g2")
    return out.withColumn("mean", F.col("mean") + 0.0)


@query("scl5_normality_p")
def scl5b(spark, d):
    df = read_table(spark, d, "events").select("event_id", "value")
    return scale.scaling_impact(df, scale.scale(df, ["value"], "standard")[0], "value").select("form", "normality_p")


PCA_SQL = """WITH s AS (SELECT s_suppkey AS id, (s_acctbal - a) / b AS x, (s_nationkey - c) / e AS y FROM supplier,
 (SELECT avg(s_acctbal) AS a, stddev_pop(s_acctbal) AS b, avg(s_nationkey) AS c, stddev_pop(s_nationkey) AS e FROM supplier)),
r AS (SELECT corr(x, y) AS r FROM s)
SELECT id AS s_suppkey, round(CASE WHEN r >= 0 THEN x + y ELSE x - y END / sqrt(2.0), 6) AS major,
 round(abs(CASE WHEN r >= 0 THEN x - y ELSE x + y END) / sqrt(2.0), 6) AS minor FROM s, r"""


@query("pro1_component_scores", PCA_SQL)
def pro1(spark, d):
    df = read_table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))
    cols = ["s_acctbal", "nation"]
    scaled = scale.scale(df, cols, "standard")[0]
    fitted = project.fit_components(scaled, cols, 2)
    # in two dimensions both loadings have the same size, so the sign rule is settled by the first column
    flip = 1.0 if fitted.loadings[0][0] > 0 else -1.0
    out = fitted.transform(scaled, ["s_suppkey"])
    return out.select("s_suppkey", F.round(F.col("PC1") * flip, 6).alias("major"), F.round(F.abs("PC2"), 6).alias("minor"))


@query("pro1_explained_variance")
def pro1b(spark, d):
    _, fitted, gaps = project.reduce_dimensions(products(spark, d), 0.95, NUMBERS)
    return fitted.variance_table(spark).withColumn("imputed_cells", F.lit(gaps))


@query("win5_cumulative_variance")
def win5(spark, d):
    df = read_table(spark, d, "lineitem")
    fitted = project.fit_components(scale.scale(df.select(*LINES), LINES, "standard")[0], LINES, 4)
    return fitted.variance_table(spark)


@query("sel4_component_importance")
def sel4(spark, d):
    return project.feature_importance(clean.median_impute(products(spark, d), NUMBERS), NUMBERS)


# --- correlation ----------------------------------------------------------------------------------

CORR_COLUMNS = ["proteins_100g", "carbohydrates_100g", "fat_100g", "salt_100g", "sugars_100g"]
CORR_PAIRS = [(a, b) for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1:]]


@query("agg11_pearson", P + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) + 0.0 AS correlation FROM products" for a, b in CORR_PAIRS))
def agg11(spark, d):
    out = correlate.correlation_pairs(products(spark, d), CORR_COLUMNS)
    return out.withColumn("correlation", F.round("correlation", 6) + 0.0)


SPEARMAN = """SELECT '{a}' AS var1, '{b}' AS var2, round(corr(ra, rb), 6) + 0.0 AS correlation FROM (
 SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
        rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb
 FROM products WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("agg11_spearman", P + " UNION ALL ".join(SPEARMAN.format(a=a, b=b) for a, b in CORR_PAIRS))
def agg11b(spark, d):
    out = correlate.correlation_pairs(products(spark, d), CORR_COLUMNS, "spearman")
    return out.withColumn("correlation", F.round("correlation", 6) + 0.0)


KENDALL = """SELECT '{a}' AS var1, '{b}' AS var2, round(s / (sqrt(n - tx) * sqrt(n - ty)), 6) + 0.0 AS correlation FROM (
 WITH h AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS c FROM products WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)
 SELECT (SELECT sum(p.c * q.c * sign(p.x - q.x) * sign(p.y - q.y)) / 2 FROM h p, h q) AS s,
  (SELECT sum(c) * (sum(c) - 1) / 2 FROM h) AS n,
  (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM h GROUP BY x)) AS tx,
  (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM h GROUP BY y)) AS ty)"""


@query("agg11_kendall", P + " UNION ALL ".join(KENDALL.format(a=a, b=b) for a, b in CORR_PAIRS if "fat" not in a + b))
def agg11c(spark, d):
    cols = [c for c in CORR_COLUMNS if "fat" not in c]
    out = correlate.correlation_pairs(products(spark, d), cols, "kendall")
    return out.withColumn("correlation", F.round("correlation", 6) + 0.0)


@query("srt4_strong_pairs", P + "SELECT 'carbohydrates_100g' AS var1, 'sugars_100g' AS var2, round(corr(carbohydrates_100g, sugars_100g), 6) AS correlation FROM products")
def srt4(spark, d):
    return rounded(correlate.strong_pairs(correlate.correlation_pairs(products(spark, d))), 6, "correlation")


@query("agg24_lower_triangle", P + " UNION ALL ".join(
    f"SELECT '{b}' AS var1, '{a}' AS var2, round(corr({a}, {b}), 6) + 0.0 AS correlation FROM products" for a, b in CORR_PAIRS))
def agg24(spark, d):
    out = correlate.correlation_pairs(products(spark, d), CORR_COLUMNS)
    return out.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"),
                      (F.round("correlation", 6) + 0.0).alias("correlation"))


@query("sel3_correlation_drop_list", P + """SELECT 'sugars_100g' AS dropped, count(sugars_100g) AS non_null FROM products
 HAVING corr(carbohydrates_100g, sugars_100g) > 0.7""")
def sel3(spark, d):
    df = products(spark, d)
    dropped = correlate.columns_to_drop(df)
    wide = df.agg(*[F.count(quoted(c)).alias(c) for c in dropped])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("dropped"), quoted(c).alias("non_null")) for c in dropped])))


@query("sel5_prepare_for_clustering", P + """SELECT row_number() OVER () * 0 + 1 AS one, brands, categories,
 round(CAST(energy_100g AS FLOAT), 1) AS energy_100g FROM products""")
def sel5(spark, d):
    kept, _, _ = select.prepare_for_clustering(products(spark, d), min_unique_ratio=0.05)
    out = kept.withColumn("one", F.lit(1).cast("long"))
    return rounded(out, 1, "energy_100g")
