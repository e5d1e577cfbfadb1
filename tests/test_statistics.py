"""Correlation, outliers and drift against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.operators import correlate, drift, encode, outliers, project, scale, types


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.RandomState(3)
    n = 150
    a = np.round(rng.normal(size=n), 1)
    b = np.round(a * 0.5 + rng.normal(size=n), 1)
    c = rng.randint(0, 4, n).astype(float)
    rows = [(i, None if i % 11 == 0 else float(a[i]), None if i % 7 == 0 else float(b[i]), float(c[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def kendall(x, y):
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    n = len(x) * (len(x) - 1) / 2
    ties = lambda v: sum(k * (k - 1) / 2 for k in np.unique(v, return_counts=True)[1])
    return s / math.sqrt((n - ties(x)) * (n - ties(y)))


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlations(gappy, method):
    pdf = gappy.toPandas()
    for r in correlate.correlation_pairs(gappy, ["a", "b", "c"], method).collect():
        both = pdf[[r["var1"], r["var2"]]].dropna()
        x, y = both[r["var1"]], both[r["var2"]]
        if method == "spearman":
            x, y = x.rank(), y.rank()
        want = kendall(x.to_numpy(), y.to_numpy()) if method == "kendall" else np.corrcoef(x, y)[0, 1]
        assert math.isclose(r["correlation"], want, abs_tol=1e-9)


def test_drop_list():
    pairs = [("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.1), ("c", "d", -0.95)]
    # strongest first; c and a each have two strong partners
    assert correlate.drop_list(pairs, 0.7) == ["c", "a"]


def brute_lof(x, k):
    order = np.argsort(x, kind="stable")
    v = x[order]
    n = len(v)
    near, dist = [], []
    for i in range(n):
        others = [j for j in range(max(0, i - k), min(n, i + k + 1)) if j != i]
        others.sort(key=lambda j: (abs(v[j] - v[i]), j))
        near.append(others[:k])
        dist.append([abs(v[j] - v[i]) for j in others[:k]])
    kd = [d[-1] for d in dist]
    lrd = [1 / (np.mean([max(d, kd[j]) for d, j in zip(dist[i], near[i])]) + 1e-10) for i in range(n)]
    lof = np.array([np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(n)])
    out = np.empty(n)
    out[order] = lof
    return out


def test_lof_across_blocks(spark):
    rng = np.random.RandomState(5)
    x = np.round(np.concatenate([rng.normal(size=300), [9.0, -7.0], np.repeat(0.5, 40)]), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    want = brute_lof(x, 6)
    got = {r["id"]: r["lof"] for r in outliers.lof_scores(df, "x", "id", 6, block_rows=40).collect()}
    assert len(got) == len(x)
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-6)
    flags, _ = outliers.flag_lof(df, "x", "id", 6, 0.05)
    assert {300, 301} <= {r["id"] for r in flags.where("is_outlier").collect()}


def test_isolation_forest(spark):
    rng = np.random.RandomState(6)
    x = np.concatenate([rng.normal(size=500), [40.0, -35.0], np.repeat(0.0, 250)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(9999, None)], "id long, x double")
    a = outliers.flag_forest(df, "x", "id", 0.01, 30)[0].toPandas().sort_values("id")
    b = outliers.flag_forest(df.repartition(7), "x", "id", 0.01, 30)[0].toPandas().sort_values("id")
    assert np.allclose(a["score"].dropna(), b["score"].dropna())
    assert {500, 501} <= set(a[a["is_outlier"]]["id"])
    assert not a[a["id"] == 9999]["is_outlier"].any()


def test_treatments_keep_count(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)] + [(100, 500.0)], "id long, x double")
    for method in ("tukey", "zscore", "elliptic", "lof", "isolation_forest"):
        kw = {} if method in ("tukey", "zscore") else {"contamination": 0.02}
        kept = outliers.treat_outliers(df, "x", "remove", method, "id", **kw)
        assert kept.where("id = 100").count() == 0, method
        capped = outliers.treat_outliers(df, "x", "cap", method, "id", **kw)
        assert capped.count() == 101 and capped.agg(F.max("x")).first()[0] < 500.0
    imputed = outliers.treat_outliers(df, "x", "impute").where("id = 100").first()["x"]
    assert imputed == 4.5


def test_drift_of_a_copy(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 13)) for i in range(300)], "id long, c string, x double")
    same = {(r["column"], r["metric"]): r["value"] for r in drift.sample_metrics(df, df, ["c"], ["x"]).collect()}
    assert same[("x", "ks_statistic")] == 0.0 and same[("x", "ks_pvalue")] == 1.0
    assert same[("c", "prop_difference")] == 0.0 and math.isclose(same[("c", "chi2_pvalue")], 1.0)


def test_p_values():
    # textbook values
    assert math.isclose(drift.chi2_p(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(drift.chi2_p(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(drift.kolmogorov_p(0.2, 100, 100), 0.0366, abs_tol=5e-4)
    assert drift.yates([[10, 20], [30, 40]]) == pytest.approx(0.4464285714, rel=1e-6)


def test_components(spark):
    rng = np.random.RandomState(8)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0, 0.1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    out, fitted, gaps = project.reduce_dimensions(df, 2, ["a", "b", "c"], ["id"])
    scores = out.toPandas().sort_values("id")[["PC1", "PC2"]].to_numpy()
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert gaps == 0 and np.allclose(np.var(scores, axis=0, ddof=1), values[:2])
    assert np.allclose(fitted.ratios, values[:2] / values.sum())
    assert len(project.fit_components(df, ["a", "b", "c"], 0.95).loadings) == 2


def test_ordinals_and_order(spark):
    df = spark.createDataFrame([("low", "x1", "3"), ("HIGH", "b", "10"), (None, "c", "2")], "level string, word string, num string")
    found = {r["column"]: r["is_ordinal"] for r in types.ordinal_report(df).collect()}
    assert found == {"level": True, "word": False, "num": True}
    assert [r["value"] for r in types.natural_order(df, "num").orderBy("position").collect()] == ["2", "3", "10"]


def test_scaler_round_trip(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "x double, y double")
    scaler = scale.fit_robust(df, ["x", "y"])
    assert scale.scaler_from(scale.scaler_table(spark, scaler)) == scaler


def test_words_of_categories_stay_in_spark(spark, monkeypatch):
    """The vocabulary of a column does not come to the driver, and texts without words get a cluster too."""
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql.classic.dataframe import DataFrame

    rows, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: rows.append(collect(df)) or rows[-1])
    monkeypatch.setattr(CountVectorizer, "fit", lambda *a: pytest.fail("a vocabulary on the driver"))
    texts = [f"red apple w{i}" for i in range(200)] + [f"blue stone v{i}" for i in range(200)] + ["-", "red apple w1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = encode.cluster_categories(df, "t", 3)
    assert sum(map(len, rows)) < 100
    found = {r["value"]: (r["n"], r["cluster"]) for r in collect(out)}
    assert len(found) == 401 and found["red apple w1"][0] == 2 and all(0 <= c < 3 for _, c in found.values())
    red, blue = ({found[t][1] for t in found if t.startswith(w)} for w in ("red", "blue"))
    assert not red & blue
