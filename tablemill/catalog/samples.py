"""Queries for sampling, drift, files, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tablemill.catalog.profiling import rounded
from tablemill.catalog.registry import NUMBERS, WITH_PRODUCTS, per_column, query
from tablemill.functions.numbers import quoted
from tablemill.operators import drift, encode, reports, sampling, scale
from tablemill.operators.cluster import kmeans
from tablemill.operators.ranks import quantile_table
from tablemill.operators.types import dictionary
from tablemill.session import work_path
from tablemill.sources import files
from tablemill.sources.tables import products, read_table
from tablemill.streaming.apply import apply_to_stream, read_stream

P = WITH_PRODUCTS
HASH = "md5(concat_ws('|', '42', CAST({c} AS VARCHAR)))"

# --- samples --------------------------------------------------------------------------------------


@query("smp1_exact_sample", f"SELECT event_id, value FROM events ORDER BY {HASH.format(c='event_id')} LIMIT 1000")
def smp1(spark, d):
    return sampling.sample_exact(read_table(spark, d, "events"), "event_id", 1000).select("event_id", "value")


@query("smp1_bernoulli_sample")
def smp1b(spark, d):
    return sampling.sample_bernoulli(read_table(spark, d, "events"), 1000).select("event_id", "value")


@query("smp1_bernoulli_facts", "SELECT true AS near_target, true AS all_known")
def smp1d(spark, d):
    """About as many rows as asked for (six standard deviations), each of them an input row."""
    df = read_table(spark, d, "events")
    drawn = sampling.sample_bernoulli(df, 1000).select("event_id", "value")
    known = drawn.join(df.select("event_id", "value"), ["event_id", "value"], "left_semi").count()
    n = drawn.count()
    return spark.createDataFrame([(abs(n - min(1000, df.count())) <= 190, n == known)], "near_target boolean, all_known boolean")


@query("smp1_line_share", "SELECT true AS near_target, true AS all_known")
def smp1e(spark, d):
    """A real sample of the lines of a file: fewer than the file has, and each is a line of it."""
    df = read_table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    source = files.write_delimited(df, work_path(spark, "lines"))
    wanted = df.count() // 2
    target = files.sample_lines(spark, source, work_path(spark, "share"), n=wanted)
    drawn = files.read_delimited(spark, target, schema=df.schema)
    n, known = drawn.count(), drawn.join(df, df.columns, "left_semi").count()
    return spark.createDataFrame([(abs(n - wanted) <= 6 * wanted ** 0.5, n == known)], "near_target boolean, all_known boolean")


@query("smp1_line_sample", "SELECT doc_id, lang, n_chars FROM documents")
def smp1c(spark, d):
    source = files.write_delimited(read_table(spark, d, "documents").select("doc_id", "lang", "n_chars"), work_path(spark, "lines"))
    # the whole file is smaller than the wanted number of lines, so it is copied whole
    target = files.sample_lines(spark, source, work_path(spark, "reduced"), n=10**9)
    files.sample_lines(spark, source, target, n=10)
    schema = "doc_id long, lang string, n_chars long"
    return files.read_delimited(spark, target, schema=T.StructType.fromDDL(schema))


@query("smp2_simple_random_sample", f"SELECT o_orderkey FROM orders ORDER BY {HASH.format(c='o_orderkey')} LIMIT 5000")
def smp2(spark, d):
    return sampling.sample_exact(read_table(spark, d, "orders"), "o_orderkey", 5000).select("o_orderkey")


EVENT_SCORES = """SELECT 'event_type' AS "column", 'text' AS kind, round(-sum(p * ln(p)) / ln(count(*)), 6) AS score FROM (
  SELECT count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type)
UNION ALL SELECT 'value', 'numeric', round(0.3 * count(value) / count(*) + 0.2 * least(1, count(DISTINCT value) / (count(*) * 0.1))
  + 0.3 * least(1, stddev_samp(value) / avg(value)) + 0.2 * (1 - (SELECT avg(CAST(abs((value - m) / s) > 3 AS INT)) FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events))), 6) FROM events"""


@query("smp3_column_scores", EVENT_SCORES)
def smp3(spark, d):
    df = read_table(spark, d, "events").select("event_type", "value", "props")
    return rounded(sampling.column_scores(df).select("column", "kind", "score"), 6, "score")


@query("agg13_quality_scores", EVENT_SCORES)
def agg13(spark, d):
    return smp3(spark, d)


@query("srt3_best_columns", P + """SELECT 'brands' AS "column", 'text' AS kind, count(brands) AS non_null FROM products
UNION ALL SELECT 'categories', 'text', count(categories) FROM products
UNION ALL SELECT 'energy_100g', 'numeric', count(energy_100g) FROM products""")
def srt3(spark, d):
    df = products(spark, d).select("row_id", "brands", "categories", "energy_100g")
    text, numeric = sampling.select_columns(df)
    kinds = {**{c: "text" for c in text}, **{c: "numeric" for c in numeric}}
    wide = df.agg(*[F.count(quoted(c)).alias(c) for c in kinds])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), quoted(c).alias("non_null")) for c, k in kinds.items()])))


@query("smp3_quantile_strata", """WITH e AS (SELECT list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS q FROM events)
SELECT 'Q' || (1 + len(list_filter(q, lambda x: value > x))) AS stratum, count(*) AS n FROM events, e GROUP BY 1""")
def smp3b(spark, d):
    df = read_table(spark, d, "events").select("value")
    return df.groupBy(sampling.strata(df, [], ["value"]).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def _strata_sql(tables: str, key: str, source: str, id_col: str, target: str) -> str:
    return f"""{tables} c AS (SELECT {key} AS k, count(*) AS n FROM {source} GROUP BY 1),
q1 AS (SELECT k, n, greatest(1, floor(t.t * (n / total))) AS q FROM c, (SELECT CAST({target} AS BIGINT) AS t, (SELECT sum(n) FROM c) AS total) t),
q2 AS (SELECT k, n, CASE WHEN (SELECT sum(q) FROM q1) > CAST({target} AS BIGINT)
   THEN greatest(1, floor(q * (CAST({target} AS DOUBLE) / (SELECT sum(q) FROM q1)))) ELSE q END AS q FROM q1),
r AS (SELECT {id_col} AS id, {key} AS k, {HASH.format(c=id_col)} AS h, row_number() OVER (PARTITION BY {key} ORDER BY {HASH.format(c=id_col)}) AS rn FROM {source}),
s AS (SELECT r.id, r.h FROM r JOIN q2 ON r.k = q2.k WHERE rn <= q)
SELECT id AS {id_col} FROM (SELECT id, row_number() OVER (ORDER BY h) AS g FROM s) WHERE g <= CAST({target} AS BIGINT)"""


QUARTER = "(SELECT count(*) // 4 FROM {s})"


@query("smp4_smart_sample", _strata_sql("WITH", "event_type", "events", "event_id", QUARTER.format(s="events")))
def smp4(spark, d):
    df = read_table(spark, d, "events").select("event_id", "event_type", "value")
    return sampling.smart_sample(df, "event_id").select("event_id")


@query("win1_rows_per_stratum", _strata_sql(P + ",", "concat_ws('-', brands, categories)", "products", "row_id", "3000"))
def win1(spark, d):
    df = products(spark, d)
    key = sampling.stratum_key([F.col("brands"), F.col("categories")])
    return sampling.stratified_sample(df, "row_id", key, 3000).select("row_id")


@query("win2_keep_first_duplicate", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def win2(spark, d):
    from tablemill.operators.clean import handle_duplicates

    return handle_duplicates(read_table(spark, d, "documents").select("doc_id", "text"), "keep_first", "doc_id")


@query("win3_strictly_increasing", "SELECT count(event_id) = count(DISTINCT event_id) AS event_id, count(user_id) = count(DISTINCT user_id) AS user_id FROM events")
def win3(spark, d):
    p = reports.profile_table(read_table(spark, d, "events").select("event_id", "user_id"))
    same = lambda c: F.bool_and(F.when(F.col("column") == c, F.col("distinct") == F.col("rows") - F.col("nulls")))
    return p.agg(same("event_id").alias("event_id"), same("user_id").alias("user_id"))


@query("win4_quantile_bins", """WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM lineitem)
SELECT len(list_filter(q, lambda x: l_quantity > x)) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def win4(spark, d):
    df = read_table(spark, d, "lineitem")
    return df.groupBy(sampling.quantile_bins(df, "l_quantity", 10).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("smp5_boosted_quotas", P + """, c AS (SELECT brands AS value, count(*) AS n FROM products GROUP BY 1),
a AS (SELECT value, n, greatest(n / (SELECT sum(n) FROM c), greatest(100 / (SELECT sum(n) FROM c), 1 / (SELECT count(*) FROM c))) AS p FROM c)
SELECT value, n, CAST(round_even(p / (SELECT sum(p) FROM a) * 6000, 0) AS BIGINT) AS quota FROM a""")
def smp5(spark, d):
    return sampling.boosted_quotas(products(spark, d), "brands", 6000)


@query("smp5_representative_sample")
def smp5b(spark, d):
    return sampling.representative_sample(products(spark, d), "row_id", 0.05, ["brands"], ["energy_100g", "fat_100g"])


@query("win6_facts", "SELECT least(200, count(*)) AS n, least(200, count(*)) AS ids FROM orders")
def win6b(spark, d):
    drawn = win6(spark, d)
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("ids"))


@query("smp5_facts", P + "SELECT CAST(floor(count(*) * 0.05) AS BIGINT) AS n, CAST(floor(count(*) * 0.05) AS BIGINT) AS ids FROM products")
def smp5c(spark, d):
    """The sample has the wanted size and no row twice."""
    return smp5b(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"))


@query("win6_nearest_to_centres")
def win6(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("customer"))
    return sampling.nearest_to_centres(df, "o_orderkey", ["o_totalprice", "customer"], None, 200, n_clusters=20)


SAMPLE_SQL = f"s AS (SELECT * FROM orders ORDER BY {HASH.format(c='o_orderkey')} LIMIT 5000)"


def _sample(spark, d):
    df = read_table(spark, d, "orders")
    return df, sampling.sample_exact(df, "o_orderkey", 5000)


@query("joi1_proportion_join", f"""WITH {SAMPLE_SQL}, a AS (SELECT o_orderpriority AS value, count(*) AS n_original FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS value, count(*) AS n_sample FROM s GROUP BY 1)
SELECT value, n_original, coalesce(n_sample, 0) AS n_sample, round(n_original / (SELECT count(*) FROM orders), 9) AS p_original,
 round(coalesce(n_sample, 0) / (SELECT count(*) FROM s), 9) AS p_sample FROM a LEFT JOIN b USING (value)""")
def joi1(spark, d):
    return rounded(drift.proportion_table(*_sample(spark, d), "o_orderpriority"), 9, "p_original", "p_sample")


@query("joi5_not_sampled_yet", f"WITH {SAMPLE_SQL} SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def joi5(spark, d):
    df, drawn = _sample(spark, d)
    return df.select("o_orderkey").join(drawn.select("o_orderkey"), "o_orderkey", "left_anti")


@query("smp6_category_drift", f"""WITH {SAMPLE_SQL}, t AS (SELECT value, a.n AS x, coalesce(b.n, 0) AS y FROM
 (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) a LEFT JOIN (SELECT o_orderpriority AS value, count(*) AS n FROM s GROUP BY 1) b USING (value)),
u AS (SELECT x, y, x / sum(x) OVER () AS p, y / sum(y) OVER () AS q, sum(x) OVER () AS a, sum(y) OVER () AS b FROM t)
SELECT 'o_orderpriority' AS "column", 'prop_difference' AS metric, round(avg(abs(p - q)), 6) AS value FROM u
UNION ALL SELECT 'o_orderpriority', 'kl_divergence', round(sum(p * ln((p + 1e-10) / (q + 1e-10))), 6) FROM u
UNION ALL SELECT 'o_orderpriority', 'chi2', round(sum(pow(x - (x + y) * a / (a + b), 2) / ((x + y) * a / (a + b)) + pow(y - (x + y) * b / (a + b), 2) / ((x + y) * b / (a + b))), 6) FROM u""")
def smp6(spark, d):
    out = drift.category_drift(*_sample(spark, d), ["o_orderpriority"]).where("metric <> 'chi2_pvalue'")
    return rounded(out, 6, "value")


KS_SQL = """(SELECT max(abs(f - g)) FROM (SELECT max(f) AS f, max(g) AS g FROM (
  SELECT o_totalprice AS v, sum(CAST(k = 0 AS INT)) OVER (ORDER BY o_totalprice) / (SELECT count(*) FROM orders) AS f,
   sum(CAST(k = 1 AS INT)) OVER (ORDER BY o_totalprice) / (SELECT count(*) FROM s) AS g
  FROM (SELECT o_totalprice, 0 AS k FROM orders UNION ALL SELECT o_totalprice, 1 FROM s)) GROUP BY v))"""


@query("smp6_numeric_drift", f"""WITH {SAMPLE_SQL}, a AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders),
b AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM s)
SELECT 'o_totalprice' AS "column", metric, round(value, 6) AS value FROM (
 SELECT 'mean_difference' AS metric, abs(a.m - b.m) / a.d AS value FROM a, b UNION ALL SELECT 'std_difference', abs(a.d - b.d) / a.d FROM a, b
 UNION ALL SELECT 'Q1_difference', abs(a.q[1] - b.q[1]) / a.d FROM a, b UNION ALL SELECT 'Q2_difference', abs(a.q[2] - b.q[2]) / a.d FROM a, b
 UNION ALL SELECT 'Q3_difference', abs(a.q[3] - b.q[3]) / a.d FROM a, b UNION ALL SELECT 'ks_statistic', {KS_SQL})""")
def smp6b(spark, d):
    out = drift.numeric_drift(*_sample(spark, d), ["o_totalprice"]).where("metric <> 'ks_pvalue'")
    return rounded(out, 6, "value")


@query("smp6_sample_metrics")
def smp6c(spark, d):
    return drift.sample_metrics(*_sample(spark, d), ["o_orderpriority", "o_orderstatus"], ["o_totalprice"])


@query("smp7_cramers_v", """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM c)
SELECT round(sqrt(sum(pow(n - e, 2) / e) / sum(n) / 2), 6) AS cramers_v FROM e""")
def smp7(spark, d):
    v = drift.cramers_v(read_table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return spark.createDataFrame([(round(v, 6),)], "cramers_v double")


@query("smp8_histogram_comparison", f"""WITH {SAMPLE_SQL}, r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders),
x AS (SELECT 'original' AS side, o_totalprice AS v FROM orders), y AS (SELECT 'sample' AS side, o_totalprice AS v FROM s),
r2 AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM y)
SELECT side, CAST(least(floor((v - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM x, r GROUP BY ALL
UNION ALL SELECT side, CAST(least(floor((v - lo) / w), 29) AS INTEGER), count(*) FROM y, r2 GROUP BY ALL""")
def smp8(spark, d):
    df, drawn = _sample(spark, d)
    side = lambda t, name: reports.histogram(t, "o_totalprice", 30).select(F.lit(name).alias("side"), "bin", "n")
    return side(df, "original").unionByName(side(drawn, "sample"))


@query("smp8_describe_comparison", f"WITH {SAMPLE_SQL} " + " UNION ALL ".join(
    f"""SELECT '{side}' AS side, 'o_totalprice' AS "column", count(*) AS "count", round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd,
 min(o_totalprice) AS "min", round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50,
 round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS "max" FROM {t}""" for side, t in (("original", "orders"), ("sample", "s"))))
def smp8b(spark, d):
    df, drawn = _sample(spark, d)
    side = lambda t, name: reports.describe_table(t, ["o_totalprice"]).withColumn("side", F.lit(name))
    return rounded(side(df, "original").unionByName(side(drawn, "sample")), 4, "mean", "sd", "q25", "q50", "q75")


@query("set1_union_of_strata", f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format(c='event_id')}) AS rn FROM events) WHERE rn <= 50""")
def set1(spark, d):
    df = read_table(spark, d, "events").withColumn("h", sampling.order_hash("event_id", 42))
    quotas = df.select("event_type").distinct().withColumn("q", F.lit(50))
    from tablemill.operators.ranks import smallest_by_hash

    return smallest_by_hash(df, ["event_type"], "h", quotas, "q").select("event_id")


@query("set3_column_difference", P + "SELECT 'salt_100g' AS \"column\", 'removed' AS change, count(salt_100g) AS non_null FROM products "
       "UNION ALL SELECT 'fat_category', 'added', count(*) FILTER (fat_100g > 0) FROM products UNION ALL SELECT 'protein_ratio', 'added', count(*) FROM products")
def set3(spark, d):
    from tablemill.plans.cleaning import enrich

    before = products(spark, d)
    after = enrich(before.drop("salt_100g"))
    changes = {c: "removed" for c in before.columns if c not in after.columns}
    changes.update({c: "added" for c in after.columns if c not in before.columns})
    both = enrich(before)
    wide = both.agg(*[F.count(quoted(c)).alias(c) for c in changes])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("change"), quoted(c).alias("non_null")) for c, k in changes.items()])))


# --- files ----------------------------------------------------------------------------------------

TEXT_PRODUCTS = P + "SELECT row_id, code, product_name, brands, serving_size, energy_100g, fat_100g FROM products"
FILE_COLUMNS = ["row_id", "code", "product_name", "brands", "serving_size", "energy_100g", "fat_100g"]


def _file_rows(spark, d):
    return products(spark, d).select(*FILE_COLUMNS)


@query("src1_read_tsv", TEXT_PRODUCTS)
def src1(spark, d):
    path = files.write_delimited(_file_rows(spark, d), work_path(spark, "tsv"))
    return files.read_delimited(spark, path, schema=_file_rows(spark, d).schema)


@query("src1_inferred_types", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def src1b(spark, d):
    path = files.write_delimited(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), work_path(spark, "tsv"))
    out = files.read_delimited(spark, path)
    return out.withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


@query("src2_sniff_separator", P + "SELECT row_id, brands, CAST(energy_100g AS DOUBLE) AS energy_100g FROM products")
def src2(spark, d):
    path = files.write_delimited(products(spark, d).select("row_id", "brands", "energy_100g"), work_path(spark, "semi"), sep=";")
    out = files.read_tolerant(spark, path)
    return out.withColumn("energy_100g", F.col("energy_100g").cast("double"))


@query("src3_skip_bad_lines", "SELECT CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS b, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderpriority END AS c "
       "FROM orders WHERE o_orderkey % 10 <> 0")
def src3(spark, d):
    k = F.col("o_orderkey") % 10
    key = F.col("o_orderkey").cast("string")
    line = (F.when(k == 0, F.concat_ws("\t", key, "o_orderstatus", "o_orderpriority", F.lit("too"), F.lit("long")))
            .when(k == 1, F.concat_ws("\t", key, "o_orderstatus"))
            .otherwise(F.concat_ws("\t", key, "o_orderstatus", "o_orderpriority")))
    path = work_path(spark, "ragged")
    read_table(spark, d, "orders").select(line.alias("a\tb\tc")).write.options(
        header=True, quote="\u0000", sep="\u0001", escapeQuotes=False).csv(path)
    return files.read_tolerant(spark, path, sep="\t")


@query("src4_read_gzip", TEXT_PRODUCTS)
def src4(spark, d):
    path = files.write_delimited(_file_rows(spark, d), work_path(spark, "gz"), compression="gzip")
    return files.read_delimited(spark, path + "/*.csv.gz", schema=_file_rows(spark, d).schema)


@query("src5_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 30")
def src5(spark, d):
    df = read_table(spark, d, "lineitem")
    return df.where((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 30)).select("l_orderkey", "l_quantity")


@query("src6_load_numeric_file", "SELECT o_orderkey::DOUBLE AS o_orderkey, round(o_totalprice, 2) AS o_totalprice, "
       "CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS o_orderpriority FROM orders")
def src6f(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.substring("o_orderpriority", 1, 1).alias("o_orderpriority"), "o_orderstatus")
    path = files.write_delimited(df, work_path(spark, "comma"), sep=",")
    return files.load_numeric(spark, path)


@query("src7_reload_preprocessed", TEXT_PRODUCTS)
def src7(spark, d):
    path = work_path(spark, "stored")
    return files.read_or_create(spark, path, lambda: _file_rows(spark, d))


@query("snk1_write_preprocessed", TEXT_PRODUCTS)
def snk1(spark, d):
    path = files.write_preprocessed(_file_rows(spark, d), "/data/products.csv.gz", work_path(spark, "out"))
    assert path.endswith("/products_preprocessed.tsv")
    return files.read_delimited(spark, path, schema=_file_rows(spark, d).schema)


@query("snk2_write_encoded", "SELECT o_orderkey, array_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) - 1 AS slot FROM orders")
def snk2(spark, d):
    from pyspark.ml.functions import vector_to_array

    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    names = encode.categories_of(df, "o_orderpriority")
    path = work_path(spark, "encoded")
    files.write_encoded(encode.one_hot_vectors(df, "o_orderpriority", "vector").drop("o_orderpriority"), names, path)
    features, stored = files.read_encoded(spark, path)
    assert stored.count() == len(names)
    return features.select("o_orderkey", (F.array_position(vector_to_array("vector"), 1.0) - 1).cast("int").alias("slot"))


@query("snk3_stored_result", P + "SELECT brands AS value, count(*) AS n, row_number() OVER (ORDER BY brands) - 1 AS code FROM products GROUP BY brands")
def snk3(spark, d):
    path = work_path(spark, "dictionary")
    make = lambda: dictionary(products(spark, d), ["brands"]).drop("column")
    files.read_or_create(spark, path, make)
    return files.read_or_create(spark, path, make)


@query("snk4_write_report", P + "SELECT 'serving_size' AS \"column\", round((count(*) - count(serving_size)) / count(*) * 100, 6) AS null_pct FROM products "
       "UNION ALL SELECT 'carbohydrates_100g', round((count(*) - count(carbohydrates_100g)) / count(*) * 100, 6) FROM products "
       "UNION ALL SELECT 'salt_100g', round((count(*) - count(salt_100g)) / count(*) * 100, 6) FROM products")
def snk4(spark, d):
    path = work_path(spark, "report")
    files.write_report(reports.missing_report(products(spark, d)).drop("alert"), path)
    return rounded(spark.read.schema("column string, null_pct double").option("header", True).csv(path), 6, "null_pct")


CENTRES = [[-1.0, -1.0], [0.0, 1.0], [1.0, -0.5]]
LINE_SCALED = """SELECT l_orderkey, l_linenumber, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS x,
 (l_discount - (SELECT avg(l_discount) FROM lineitem)) / (SELECT stddev_pop(l_discount) FROM lineitem) AS y FROM lineitem"""


def nearest_sql(centres) -> str:
    pairs = ", ".join(f"{{'d': round(pow(x - ({a}), 2) + pow(y - ({b}), 2), 9), 'i': {i}}}" for i, (a, b) in enumerate(centres))
    return f"list_sort([{pairs}])[1].i"


@query("snk5_save_and_load_model", f"SELECT l_orderkey, l_linenumber, CAST({nearest_sql(CENTRES)} AS INTEGER) AS cluster FROM ({LINE_SCALED})")
def snk5(spark, d):
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    cols = ["l_quantity", "l_discount"]
    path = work_path(spark, "model")
    files.save_model(spark, kmeans.KMeansResult(cols, scale.fit_standard(df, cols), CENTRES), path)
    return files.load_model(spark, path).predict(df).select("l_orderkey", "l_linenumber", "cluster")


@query("str1_scaled_stream", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events")
def str1(spark, d):
    scaler = scale.fit_standard(read_table(spark, d, "events"), ["value"])
    stream = read_stream(spark, d, "events.parquet")
    out = apply_to_stream(stream, lambda s: scale.apply_scaler(s.select("event_id", "value"), scaler))
    return rounded(out, 6, "value")


@query("str1_encoded_stream", "SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS \"event_type_click\", CAST(event_type = 'error' AS INTEGER) AS \"event_type_error\", least(value, 100) AS value FROM events")
def str1b(spark, d):
    from tablemill.operators.outliers import apply_bounds

    kinds = {"event_type": ["click", "error"]}
    step = lambda s: encode.one_hot_columns(apply_bounds(s.select("event_id", "event_type", "value"), {"value": (0.0, 100.0)}), ["event_type"], kinds)
    return apply_to_stream(read_stream(spark, d, "events.parquet"), step)
