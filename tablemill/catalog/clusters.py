"""Queries for clustering models and their scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tablemill.catalog.profiling import rounded
from tablemill.catalog.registry import query
from tablemill.catalog.samples import CENTRES, LINE_SCALED, nearest_sql
from tablemill.operators import project, reports
from tablemill.operators.cluster import condensed, density, kmeans, many, metrics, mixture
from tablemill.operators.cluster.compare import compare_models
from tablemill.operators.cluster.dbscan import dbscan
from tablemill.operators.cluster.neighbours import neighbour_distances
from tablemill.operators.scale import apply_scaler, fit_standard
from tablemill.plans.clustering import cluster_table
from tablemill.session import materialised
from tablemill.sources.tables import products, read_table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def scaled_lines(spark, d) -> DataFrame:
    """Line items with standardised quantity ``x`` and discount ``y``."""
    df = read_table(spark, d, "lineitem").select(*KEYS, F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return apply_scaler(df, fit_standard(df, ["x", "y"]))


def lines_with_id(spark, d) -> DataFrame:
    return scaled_lines(spark, d).select(F.concat_ws("-", *KEYS).alias("id"), "x", "y")


def customers(spark, d) -> DataFrame:
    """Customers with standardised balance ``x`` and nation ``y``."""
    df = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return apply_scaler(df, fit_standard(df, ["x", "y"]))


CUSTOMERS_SQL = """c AS (SELECT c_custkey AS id, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS x,
 (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer) AS y FROM customer)"""
LINES_SQL = LINE_SCALED.replace("l_orderkey, l_linenumber,", "l_orderkey, l_linenumber, l_partkey, l_suppkey,")


# --- k-means --------------------------------------------------------------------------------------

@query("clu1_kmeans_fit")
def clu1(spark, d):
    result = kmeans.train(lines_with_id(spark, d), ["x", "y"], "id", k=4, n_init=3)
    return result.labels.select("id", "cluster", "distance2")


@query("clu1_fit_facts", "SELECT count(*) AS n, true AS nearest, 4 AS clusters FROM lineitem")
def clu1b(spark, d):
    """All rows are kept, each at its nearest centre, and no cluster is empty."""
    df = lines_with_id(spark, d)
    result = kmeans.train(df, ["x", "y"], "id", k=4, n_init=1)
    again = result.predict(df)
    gaps = [kmeans.centre_distance(["x", "y"], c) for c in result.centres]
    scaled = apply_scaler(again, result.scaler)
    own = F.element_at(F.array(*gaps), F.col("cluster") + 1)
    return scaled.agg(F.count(F.lit(1)).alias("n"), F.bool_and(own <= F.least(*gaps) + 1e-9).alias("nearest"),
                      F.count_distinct("cluster").cast("int").alias("clusters"))


@query("clu2_k_scan")
def clu2(spark, d):
    rows = kmeans.scan_k(customers(spark, d), ["x", "y"], "id", 2, 5, "calinski_harabasz")
    return spark.createDataFrame(rows, "k int, score double")


def lloyd_sql(rounds: int, centres: list = CENTRES) -> str:
    """Unrolled k-means from fixed centres."""
    sql = f"WITH p AS ({LINES_SQL}), m0 AS (" + " UNION ALL ".join(
        f"SELECT {i} AS k, CAST({a} AS DOUBLE) AS cx, CAST({b} AS DOUBLE) AS cy" for i, (a, b) in enumerate(centres)) + ")"
    for r in range(rounds):
        sql += f""", n{r} AS (SELECT p.x, p.y, (SELECT arg_min(k, pow(p.x - cx, 2) + pow(p.y - cy, 2)) FROM m{r}) AS k FROM p),
m{r + 1} AS (SELECT k, avg(x) AS cx, avg(y) AS cy FROM n{r} GROUP BY k)"""
    return sql + f" SELECT CAST(k AS INTEGER) AS cluster, round(cx, 6) AS cx, round(cy, 6) AS cy FROM m{rounds}"


SCAN_STARTS = {k: CENTRES[:k] for k in range(2, len(CENTRES) + 1)}


@query("clu2_scan_rounds", " UNION ALL ".join(
    f"SELECT {k} AS k, cluster, cx, cy FROM ({lloyd_sql(3, c)})" for k, c in SCAN_STARTS.items()))
def clu2b(spark, d):
    """Three rounds of several k in shared scans."""
    data = many.points(scaled_lines(spark, d), ["x", "y"])
    paths = many.lloyd_many(data, 2, list(SCAN_STARTS.values()), max_iter=3, tol=0.0)
    rows = [(k, i, round(float(c[0]), 6), round(float(c[1]), 6)) for k, p in zip(SCAN_STARTS, paths) for i, c in enumerate(p.centres[-1])]
    return spark.createDataFrame(rows, "k int, cluster int, cx double, cy double")


@query("clu2_scan_facts", "SELECT CAST(k AS INTEGER) AS k, CAST(k AS INTEGER) AS centres, true AS falling, true AS settled FROM generate_series(2, 10) g(k)")
def clu2c(spark, d):
    """The whole default scan: k centres for every k, inertia never rises over the rounds, the last round hardly moves."""
    data = many.points(scaled_lines(spark, d), ["x", "y"])
    paths = many.fit_many(data, 2, [(k, 42, "k-means||") for k in range(2, 11)])
    rows = [(k, len(p.centres[-1]), all(b <= a * (1 + 1e-9) for a, b in zip(p.inertia, p.inertia[1:])),
             bool(((p.centres[-1] - p.centres[-2]) ** 2).sum() <= 1e-8)) for k, p in zip(range(2, 11), paths)]
    return spark.createDataFrame(rows, "k int, centres int, falling boolean, settled boolean")


@query("clu3_given_centres", lloyd_sql(3))
def clu3(spark, d):
    centres = kmeans.lloyd(scaled_lines(spark, d), ["x", "y"], CENTRES, max_iter=3, tol=0.0)
    rows = [(i, round(c[0], 6), round(c[1], 6)) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, "cluster int, cx double, cy double")


@query("clu3_tuned_starts")
def clu3b(spark, d):
    df = customers(spark, d)
    centres = kmeans.tune(df, ["x", "y"], "id", 3, "grid_search", grid={"max_iter": [20], "n_init": [2]}, score="calinski_harabasz")
    return kmeans.assign(df, ["x", "y"], centres).select("id", "cluster")


@query("clu4_assign_new_rows", f"SELECT l_orderkey, l_linenumber, CAST({nearest_sql(CENTRES)} AS INTEGER) AS cluster FROM ({LINE_SCALED})")
def clu4(spark, d):
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    cols = ["l_quantity", "l_discount"]
    model = kmeans.KMeansResult(cols, fit_standard(df, cols), CENTRES)
    return model.predict(df).select("l_orderkey", "l_linenumber", "cluster")


@query("joi8_centre_distances", f"""SELECT l_orderkey, l_linenumber, {', '.join(f'round(pow(x - ({a}), 2) + pow(y - ({b}), 2), 6) AS d{i}' for i, (a, b) in enumerate(CENTRES))}
FROM ({LINE_SCALED})""")
def joi8(spark, d):
    return scaled_lines(spark, d).select("l_orderkey", "l_linenumber", *[
        F.round(kmeans.centre_distance(["x", "y"], c), 6).alias(f"d{i}") for i, c in enumerate(CENTRES)])


@query("met5_inertia", f"SELECT round(sum({nearest_sql(CENTRES).replace('].i', '].d')}), 3) AS inertia FROM ({LINE_SCALED})")
def met5(spark, d):
    return kmeans.assign(scaled_lines(spark, d), ["x", "y"], CENTRES).agg(F.round(F.sum("distance2"), 3).alias("inertia"))


@query("srt5_best_parameter")
def srt5(spark, d):
    rows = kmeans.scan_k(customers(spark, d), ["x", "y"], "id", 2, 4, "davies_bouldin")
    return spark.createDataFrame(rows, "k int, score double").agg(F.max_by(
        F.struct("k", "score"), F.struct("score", -F.col("k"))).alias("b")).select("b.*")


PROFILE_SQL = f"""WITH p AS (SELECT *, {nearest_sql(CENTRES)} AS cluster FROM ({LINES_SQL}) JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
 USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)),
g AS (SELECT cluster, count(*) AS size, """ + ", ".join(f"avg({c}) AS m_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + """ FROM p GROUP BY 1),
o AS (SELECT """ + ", ".join(f"avg({c}) AS o_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + """ FROM p),
t AS (""" + " UNION ALL ".join(f"SELECT cluster, size, '{c}' AS \"column\", m_{c} AS mean, abs(m_{c} - o_{c}) AS distance FROM g, o" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + """)
SELECT CAST(cluster AS INTEGER) AS cluster, size, "column", round(mean, 4) AS mean, round(distance, 4) AS distance,
 CAST(row_number() OVER (PARTITION BY cluster ORDER BY mean DESC) AS INTEGER) AS mean_rank, CAST(row_number() OVER (PARTITION BY cluster ORDER BY distance DESC) AS INTEGER) AS distance_rank FROM t"""


@query("agg16_cluster_profile", PROFILE_SQL)
def agg16(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    # the same line can occur twice with the same keys, so they are told apart before the comparison
    df = read_table(spark, d, "lineitem").select(*KEYS, *cols)
    model = kmeans.KMeansResult(["l_quantity", "l_discount"], fit_standard(df, ["l_quantity", "l_discount"]), CENTRES)
    return rounded(reports.cluster_profile(model.predict(df), cols), 4, "mean", "distance")


# --- mixtures -------------------------------------------------------------------------------------

@query("clu5_mixture_fit")
def clu5(spark, d):
    result = mixture.train(lines_with_id(spark, d), ["x", "y"], "id", k=3, tune_method="covariance_type", kinds=("full",))
    return result.labels.select("id", "cluster")


@query("clu6_component_scan")
def clu6(spark, d):
    rows = mixture.scan_components(customers(spark, d), ["x", "y"], "id", 2, 4, "bic")
    return spark.createDataFrame(rows, "n_components int, score double")


START = mixture.Mixture("diag", np.array([0.5, 0.5]), np.array([[-1.0, 0.0], [1.0, 0.0]]), np.array([np.eye(2), np.eye(2)]))

EM_SQL = f"""WITH p AS ({LINE_SCALED}), e AS (SELECT x, y, -0.5 * (pow(x + 1, 2) + y * y) AS a, -0.5 * (pow(x - 1, 2) + y * y) AS b FROM p),
r AS (SELECT x, y, 1 / (1 + exp(b - a)) AS r0, 1 / (1 + exp(a - b)) AS r1, ln(0.5) - ln(2 * pi()) + greatest(a, b) + ln(1 + exp(-abs(a - b))) AS ll FROM e),
s AS (SELECT 0 AS j, sum(r0) AS n, sum(r0 * x) / sum(r0) AS mx, sum(r0 * y) / sum(r0) AS my, sum(r0 * x * x) / sum(r0) AS qx, sum(r0 * y * y) / sum(r0) AS qy FROM r
 UNION ALL SELECT 1, sum(r1), sum(r1 * x) / sum(r1), sum(r1 * y) / sum(r1), sum(r1 * x * x) / sum(r1), sum(r1 * y * y) / sum(r1) FROM r)
SELECT CAST(j AS INTEGER) AS component, round(n / (SELECT count(*) FROM p), 6) AS weight, round(mx, 6) AS mean_x, round(my, 5) + 0.0 AS mean_y,
 round(qx - mx * mx + 1e-6, 6) AS var_x, round(qy - my * my + 1e-6, 6) AS var_y, round((SELECT sum(ll) FROM r), 3) AS log_likelihood FROM s"""


@query("clu7_one_em_step", EM_SQL)
def clu7(spark, d):
    m, loglik = mixture.em_step(scaled_lines(spark, d), ["x", "y"], START)
    rows = [(j, round(float(m.weights[j]), 6), round(float(m.means[j][0]), 6), round(float(m.means[j][1]), 5) + 0.0,
             round(float(m.covariances[j][0, 0]), 6), round(float(m.covariances[j][1, 1]), 6), round(loglik, 3)) for j in range(2)]
    return spark.createDataFrame(rows, "component int, weight double, mean_x double, mean_y double, var_x double, var_y double, log_likelihood double")


@query("clu7_covariance_types")
def clu7b(spark, d):
    df = customers(spark, d)
    rows = []
    for kind in mixture.KINDS:
        m = mixture.fit(df, ["x", "y"], 2, kind, max_iter=10)
        rows.append((kind, mixture.information(df, ["x", "y"], m)["bic"]))
    return spark.createDataFrame(rows, "kind string, bic double")


@query("met5_information_criteria", f"""WITH p AS ({LINE_SCALED}), s AS (SELECT count(*) AS n, sum(ln(0.5) - ln(2 * pi()) + greatest(-0.5 * pow(x + 1, 2), -0.5 * pow(x - 1, 2)) - 0.5 * y * y
   + ln(1 + exp(-abs(2 * x)))) AS ll FROM p)
SELECT round(ll, 3) AS log_likelihood, round(-2 * ll + 9 * ln(n), 3) AS bic, round(-2 * ll + 18, 3) AS aic FROM s""")
def met5b(spark, d):
    i = mixture.information(scaled_lines(spark, d), ["x", "y"], START)
    return spark.createDataFrame([tuple(round(i[k], 3) for k in ("log_likelihood", "bic", "aic"))],
                                 "log_likelihood double, bic double, aic double")


# --- density --------------------------------------------------------------------------------------

NEAR_SQL = f"""WITH {CUSTOMERS_SQL}, nb AS (SELECT p.id, q.id AS other FROM c p, c q WHERE sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 0.15),
core AS (SELECT id FROM nb GROUP BY id HAVING count(*) >= 5)
SELECT c.id, c.id IN (SELECT id FROM core) AS is_core, c.id NOT IN (SELECT id FROM nb WHERE other IN (SELECT id FROM core)) AS is_noise FROM c"""


@query("clu8_core_and_noise", NEAR_SQL)
def clu8(spark, d):
    out = dbscan(customers(spark, d), ["x", "y"], 0.15, 5)
    return out.select("id", "is_core", (F.col("cluster") == -1).alias("is_noise"))


@query("clu8_core_clusters", f"""WITH RECURSIVE {CUSTOMERS_SQL}, nb AS (SELECT p.id, q.id AS other FROM c p, c q WHERE sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 0.15),
core AS (SELECT id FROM nb GROUP BY id HAVING count(*) >= 5),
g AS (SELECT id, other FROM nb WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT g.other, reach.root FROM reach JOIN g ON g.id = reach.id WHERE reach.root < g.other)
SELECT id, min(root) AS first_id FROM reach GROUP BY id""")
def clu8b(spark, d):
    out = dbscan(customers(spark, d), ["x", "y"], 0.15, 5).where("is_core")
    first = out.groupBy("cluster").agg(F.min("id").alias("first_id"))
    return out.join(first, "cluster").select("id", "first_id")


def cuts_sql(eps: str, samples: list[int]) -> str:
    """CTEs of DBSCAN at all radii ``eps`` (k, eps) and neighbour counts over the distinct customers.

    ``lab`` (node, m, k, root) holds core and border points; the root is the first point of the cluster.
    """
    return f"""WITH RECURSIVE {CUSTOMERS_SQL}, u AS MATERIALIZED (SELECT x, y, count(*) AS w, row_number() OVER (ORDER BY x, y) - 1 AS node FROM c GROUP BY x, y),
eps AS MATERIALIZED ({eps}), ms AS (SELECT unnest({samples}) AS m),
nb AS MATERIALIZED (SELECT p.node AS a, q.node AS b, q.w, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d FROM u p, u q
 WHERE pow(p.x - q.x, 2) + pow(p.y - q.y, 2) <= (SELECT max(eps) * max(eps) * 1.0001 FROM eps)),
sums AS (SELECT a, d, sum(w) OVER (PARTITION BY a ORDER BY d) AS total FROM nb),
core AS MATERIALIZED (SELECT a AS node, m, min(d) AS core FROM sums JOIN ms ON total >= m GROUP BY a, m),
alive AS MATERIALIZED (SELECT node, m, k, eps FROM core JOIN eps ON core <= eps),
g AS MATERIALIZED (SELECT nb.a, nb.b, s.m, s.k FROM nb JOIN alive s ON s.node = nb.a JOIN alive t ON t.node = nb.b AND t.m = s.m AND t.k = s.k WHERE nb.d <= s.eps AND nb.a <> nb.b),
cc(node, m, k, root) USING KEY (node, m, k) AS (SELECT node, m, k, node FROM alive UNION
 (SELECT g.b, g.m, g.k, min(cc.root) FROM cc JOIN g ON g.a = cc.node AND g.m = cc.m AND g.k = cc.k
  JOIN recurring.cc o ON o.node = g.b AND o.m = g.m AND o.k = g.k WHERE cc.root < o.root GROUP BY g.b, g.m, g.k)),
border AS (SELECT nb.a AS node, s.m, s.k, min(cc.root) AS root FROM nb JOIN alive s ON s.node = nb.b AND nb.d <= s.eps
 JOIN cc ON cc.node = s.node AND cc.m = s.m AND cc.k = s.k ANTI JOIN alive t ON t.node = nb.a AND t.m = s.m AND t.k = s.k GROUP BY ALL),
lab AS (SELECT node, m, k, root FROM cc UNION ALL SELECT node, m, k, root FROM border)"""


EPS_SQL = """SELECT i AS k, v.m * 0.5 + i * (v.m * 1.5) / 9 AS eps FROM (SELECT avg(d2) / 2 AS m FROM (
 SELECT (SELECT list_sort(list(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))))[2] FROM c q) AS d2 FROM c p)) v, range(10) r(i)"""
CUT_SCORES_SQL = cuts_sql(EPS_SQL, list(range(2, 11))) + """,
every AS (SELECT u.x, u.y, u.w, ms.m, eps.k, coalesce(lab.root, -1) AS label FROM u CROSS JOIN ms CROSS JOIN eps LEFT JOIN lab ON lab.node = u.node AND lab.m = ms.m AND lab.k = eps.k),
cen AS (SELECT m, k, label, sum(w) AS n, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM every GROUP BY ALL),
mid AS (SELECT m, k, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w) AS rows FROM every GROUP BY ALL),
within AS (SELECT m, k, sum(w * (pow(x - cx, 2) + pow(y - cy, 2))) AS s FROM every JOIN cen USING (m, k, label) GROUP BY ALL),
between AS (SELECT m, k, sum(n * (pow(cx - mx, 2) + pow(cy - my, 2))) AS s, count(*) AS labels, count(*) FILTER (label >= 0) AS n_clusters,
 coalesce(sum(n) FILTER (label < 0), 0) AS n_noise, any_value(rows) AS rows FROM cen JOIN mid USING (m, k) GROUP BY ALL),
scores AS (SELECT m, k, n_clusters, n_noise, labels, (between.s / nullif(labels - 1, 0)) / (within.s / nullif(rows - labels, 0)) AS score FROM between JOIN within USING (m, k))
"""


@query("clu9_density_scan", CUT_SCORES_SQL + """SELECT round(eps, 9) AS eps, CAST(m AS INTEGER) AS min_samples, round(score, 6) AS score
FROM scores JOIN eps USING (k) WHERE n_clusters > 0 AND labels > 1""")
def clu9(spark, d):
    """The whole default grid: ten radii, two to ten neighbours."""
    rows = density.scan(customers(spark, d), ["x", "y"], "id", method="calinski_harabasz")
    return spark.createDataFrame([(round(e, 9), m, round(v, 6)) for e, m, v in rows], "eps double, min_samples int, score double")


@query("clu9_cut_counts", CUT_SCORES_SQL + """SELECT CAST(k AS INTEGER) AS step, CAST(m AS INTEGER) AS min_samples, CAST(n_clusters AS BIGINT) AS n_clusters,
CAST(n_noise AS BIGINT) AS n_noise FROM scores""")
def clu9c(spark, d):
    df = customers(spark, d)
    eps = density.eps_range(df, ["x", "y"], "id")
    graph = density.reachability(df, ["x", "y"], eps, list(range(2, 11)))
    table = density.cut_scores(graph, materialised(graph.cuts(eps), "cuts"), eps)
    step = F.array_position(F.array(*[F.lit(e) for e in eps]), F.col("eps")).cast("int") - 1
    return table.select(step.alias("step"), F.col("m").alias("min_samples"), F.col("n_clusters").cast("long").alias("n_clusters"), "n_noise")


@query("clu9_eps_range", f"""WITH {CUSTOMERS_SQL}, n AS (SELECT p.id, (SELECT list_sort(list(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))))[2] FROM c q) AS d2 FROM c p),
m AS (SELECT avg(d2) / 2 AS m FROM n) SELECT CAST(i AS INTEGER) AS step, round(m * 0.5 + i * (m * 1.5) / 9, 9) AS eps FROM m, range(10) r(i)""")
def clu9b(spark, d):
    rows = list(enumerate(density.eps_range(customers(spark, d), ["x", "y"], "id")))
    return spark.createDataFrame([(i, round(v, 9)) for i, v in rows], "step int, eps double")


KNEE_SQL = f"""WITH {CUSTOMERS_SQL}, n AS (SELECT p.id, (SELECT list_sort(list(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))))[5] FROM c q) AS distance FROM c p),
r AS (SELECT *, row_number() OVER (ORDER BY distance, id) - 1 AS rk FROM n),
g AS (SELECT *, rk / (SELECT max(rk) FROM r) - (distance - (SELECT min(distance) FROM r)) / ((SELECT max(distance) FROM r) - (SELECT min(distance) FROM r)) AS gap FROM r)
SELECT round(arg_max(distance, gap), 9) AS eps FROM g"""


@query("clu10_knee", KNEE_SQL)
def clu10(spark, d):
    return spark.createDataFrame([(round(density.knee_eps(customers(spark, d), ["x", "y"], "id", 5), 9),)], "eps double")


KTH_SQL = f"""WITH {CUSTOMERS_SQL} SELECT p.id, round((SELECT list_sort(list(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))))[{{k}}] FROM c q), 6) AS distance FROM c p"""


@query("joi7_kth_neighbour", KTH_SQL.format(k=2))
def joi7(spark, d):
    return rounded(neighbour_distances(customers(spark, d), ["x", "y"], "id", 2), 6, "distance")


VECTOR_COLUMNS = [f"x{i}" for i in range(6)]


@query("joi7_six_columns", "WITH c AS (SELECT vec_id AS id, "
       + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(VECTOR_COLUMNS)) + " FROM embeddings) "
       + "SELECT p.id, round((SELECT list_sort(list(sqrt(" + " + ".join(f"pow(p.{c} - q.{c}, 2)" for c in VECTOR_COLUMNS)
       + ")))[5] FROM c q), 6) AS distance FROM c p")
def joi7b(spark, d):
    vectors = read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(VECTOR_COLUMNS)])
    return rounded(neighbour_distances(vectors, VECTOR_COLUMNS, "id", 5), 6, "distance")


@query("clu11_core_distance", KTH_SQL.format(k=5))
def clu11(spark, d):
    return rounded(density.core_distances(customers(spark, d), ["x", "y"], "id", 5), 6, "distance")


@query("clu11_density_cuts", cuts_sql("SELECT k, CAST(eps AS DOUBLE) AS eps FROM (VALUES (0, 0.1), (1, 0.2)) v(k, eps)", [5]) + """
SELECT c.id, eps.eps, coalesce(lab.root, -1) AS cluster FROM c JOIN u ON u.x = c.x AND u.y = c.y CROSS JOIN eps LEFT JOIN lab ON lab.node = u.node AND lab.k = eps.k""")
def clu11b(spark, d):
    return density.density_cuts(customers(spark, d), ["x", "y"], "id", 5, [0.1, 0.2])


@query("clu11_lasting_clusters", "SELECT count(*) AS n, true AS large, true AS several FROM customer")
def clu11c(spark, d):
    """Facts of the condensed tree: every row once, clusters of at least 20 rows, more than one of them."""
    out = condensed.clusters(customers(spark, d), ["x", "y"], 5, 20)
    sizes = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    inner = F.col("cluster") >= 0
    return sizes.agg(F.sum("size").alias("n"), F.coalesce(F.min(F.when(inner, F.col("size"))) >= 20, F.lit(True)).alias("large"),
                     (F.count_if(inner) > 1).alias("several"))


@query("clu12_model_comparison")
def clu12(spark, d):
    done = compare_models(customers(spark, d), ["x", "y"], "id", kmeans={"k": 3, "n_init": 1},
                          gmm={"k": 3, "n_init": 1}, dbscan={"eps": 0.2, "min_samples": 8})
    return done.metrics()


@query("clu13_end_to_end")
def clu13(spark, d):
    df = products(spark, d).select("row_id", "code", "brands", "energy_100g", "proteins_100g", "sugars_100g")
    _, done = cluster_table(df, "row_id", min_unique_ratio=0.0001, kmeans={"k": 3, "n_init": 1},
                            gmm={"k": 2, "n_init": 1, "max_iter": 5}, dbscan={"eps": 0.3, "min_samples": 10})
    return done.metrics()


@query("pro2_cluster_points")
def pro2(spark, d):
    df = kmeans.assign(customers(spark, d), ["x", "y"], CENTRES)
    return project.cluster_points(df, ["x", "y"], dims=2, keep=["id"])


# --- scores ---------------------------------------------------------------------------------------

DIMS = 64
VECTOR = [f"e{i}" for i in range(DIMS)]


def vectors(spark, d) -> DataFrame:
    return read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTOR)],
        F.col("label").alias("cluster"))


VALUES = "v AS (SELECT vec_id AS id, label AS c, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
CENTRE_SQL = f"""{VALUES}, u AS (SELECT id, c, unnest(e) AS x, unnest(range(64)) AS i FROM v),
m AS (SELECT c, i, avg(x) AS m FROM u GROUP BY 1, 2), cen AS (SELECT c, list(m ORDER BY i) AS m FROM m GROUP BY c),
w AS (SELECT v.c, count(*) AS n, sum(pow(list_distance(e, m), 2)) AS within, avg(list_distance(e, m)) AS reach FROM v JOIN cen USING (c) GROUP BY v.c)"""


@query("met1_silhouette_euclidean", f"""WITH {VALUES}, p AS (SELECT a.id, a.c, b.c AS o, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM v a, v b GROUP BY ALL),
f AS (SELECT id, max(n) FILTER (c = o) AS size, max(s / nullif(n - 1, 0)) FILTER (c = o) AS a, min(s / n) FILTER (c <> o) AS b FROM p GROUP BY id)
SELECT id, round(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS silhouette FROM f""")
def met1(spark, d):
    out = metrics.silhouette_values(vectors(spark, d), VECTOR, "id", block_rows=300)
    return rounded(out.select("id", "silhouette"), 5, "silhouette")


@query("met1_silhouette_squared", f"""WITH {VALUES}, p AS (SELECT a.id, a.c, b.c AS o, sum(pow(list_distance(a.e, b.e), 2)) AS s, count(*) AS n FROM v a, v b GROUP BY ALL),
f AS (SELECT id, max(n) FILTER (c = o) AS size, max(s / nullif(n - 1, 0)) FILTER (c = o) AS a, min(s / n) FILTER (c <> o) AS b FROM p GROUP BY id)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM f""")
def met1b(spark, d):
    return spark.createDataFrame([(round(metrics.silhouette_squared(vectors(spark, d), VECTOR), 6),)], "silhouette double")


@query("met2_calinski_harabasz", f"""WITH {CENTRE_SQL}, o AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM u GROUP BY i)),
b AS (SELECT sum(n * pow(list_distance(cen.m, o.m), 2)) AS b FROM w JOIN cen USING (c), o)
SELECT round((b / (count(*) - 1)) / (sum(within) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM w, b GROUP BY b""")
def met2(spark, d):
    s = metrics.spread_scores(vectors(spark, d), VECTOR)
    return spark.createDataFrame([(round(s["calinski_harabasz"], 6),)], "calinski_harabasz double")


@query("met3_davies_bouldin", f"""WITH {CENTRE_SQL}, r AS (SELECT a.c, max((a.reach + b.reach) / list_distance(ca.m, cb.m)) AS r FROM w a JOIN cen ca USING (c), w b JOIN cen cb USING (c)
 WHERE a.c <> b.c GROUP BY a.c) SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def met3(spark, d):
    s = metrics.spread_scores(vectors(spark, d), VECTOR)
    return spark.createDataFrame([(round(s["davies_bouldin"], 6),)], "davies_bouldin double")


@query("met4_all_scores", f"""WITH {CENTRE_SQL}, o AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM u GROUP BY i)),
b AS (SELECT sum(n * pow(list_distance(cen.m, o.m), 2)) AS b FROM w JOIN cen USING (c), o),
r AS (SELECT a.c, max((a.reach + b.reach) / list_distance(ca.m, cb.m)) AS r FROM w a JOIN cen ca USING (c), w b JOIN cen cb USING (c) WHERE a.c <> b.c GROUP BY a.c),
p AS (SELECT a.id, a.c, b.c AS o, sum(pow(list_distance(a.e, b.e), 2)) AS s, count(*) AS n FROM v a, v b GROUP BY ALL),
f AS (SELECT id, max(n) FILTER (c = o) AS size, max(s / nullif(n - 1, 0)) FILTER (c = o) AS a, min(s / n) FILTER (c <> o) AS b FROM p GROUP BY id)
SELECT 'squared' AS silhouette_kind, (SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM f) AS silhouette,
 (SELECT round((b / (count(*) - 1)) / (sum(within) / (sum(n) - count(*))), 6) FROM w, b GROUP BY b) AS calinski_harabasz,
 (SELECT round(avg(r), 6) FROM r) AS davies_bouldin, (SELECT round(sum(within), 6) FROM w) AS inertia""")
def met4(spark, d):
    row = metrics.metrics_row(vectors(spark, d), VECTOR, "id")
    row = {k: round(v, 6) if isinstance(v, float) else v for k, v in row.items()}
    return spark.createDataFrame([tuple(row.values())], "silhouette_kind string, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double")
