"""Principal components from one aggregation of co-moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tablemill.functions.numbers import numeric_columns, quoted
from tablemill.operators.clean import median_impute
from tablemill.operators.scale import apply_scaler, fit_standard


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, sample covariance matrix and row count: one agg, d x d numbers on the driver."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)]
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i:], i):
            aggs.append(F.covar_samp(quoted(a).cast("double"), quoted(b).cast("double")).alias(f"c{i}_{j}"))
    r = df.agg(*aggs).first()
    d = len(cols)
    m = np.array([r[f"m{i}"] for i in range(d)], dtype=float)
    cov = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    return m, cov, r["n"]


class Components:
    """Fitted components: means, loadings (rows are components) and explained variance ratios."""

    def __init__(self, cols, means, loadings, ratios):
        self.cols, self.means, self.loadings, self.ratios = cols, means, loadings, ratios

    @property
    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(len(self.loadings))]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        scores = []
        for name, weights in zip(self.names, self.loadings):
            total = F.lit(0.0)
            for c, m, w in zip(self.cols, self.means, weights):
                total = total + (quoted(c) - float(m)) * float(w)
            scores.append(total.alias(name))
        return df.select(*[quoted(c) for c in keep or []], *scores)

    def variance_table(self, spark) -> DataFrame:
        """(component, explained_ratio, cumulative_ratio); one row per component."""
        rows = [(i + 1, float(v)) for i, v in enumerate(self.ratios)]
        w = Window.partitionBy(F.lit(1)).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
        return spark.createDataFrame(rows, "component int, explained_ratio double").withColumn(
            "cumulative_ratio", F.sum("explained_ratio").over(w))

    def importance_table(self, spark) -> DataFrame:
        weight = np.abs(self.loadings).mean(axis=0)
        return spark.createDataFrame([(c, float(v)) for c, v in zip(self.cols, weight)],
                                     "column string, importance double")


def fit_components(df: DataFrame, cols: list[str], n_components: float = 0.95) -> Components:
    """A whole number keeps that many components, a share below 1 as many as explain it.

    Signs are fixed: the largest loading of a component is positive.
    """
    means, cov, _ = covariance(df, cols)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order].T
    ratios = values / (values.sum() or 1.0)
    if n_components < 1:
        k = int(np.searchsorted(np.cumsum(ratios), n_components, side="right")) + 1
    else:
        k = int(n_components)
    k = min(k, len(cols))
    loadings = vectors[:k]
    for row in loadings:
        if row[np.argmax(np.abs(row))] < 0:
            row *= -1
    return Components(cols, means, loadings, ratios[:k])


def reduce_dimensions(df: DataFrame, n_components: float = 0.95, cols: list[str] | None = None,
                      keep: list[str] | None = None) -> tuple[DataFrame, Components, int]:
    """Median-imputed component scores, the fitted components and the number of imputed cells."""
    cols = cols or numeric_columns(df)
    gaps = df.agg(F.sum(sum((quoted(c).isNull().cast("long") for c in cols), F.lit(0).cast("long")))).first()[0] or 0
    filled = median_impute(df, cols)
    fitted = fit_components(filled, cols, n_components)
    return fitted.transform(filled, keep), fitted, gaps


def feature_importance(df: DataFrame, cols: list[str], n_components: int = 2) -> DataFrame:
    """Mean absolute loading per column on standardised data."""
    scaled = apply_scaler(df, fit_standard(df, cols))
    return fit_components(scaled, cols, n_components).importance_table(df.sparkSession)


def cluster_points(df: DataFrame, cols: list[str], cluster: str = "cluster", dims: int = 2,
                   keep: list[str] | None = None) -> DataFrame:
    """2-D or 3-D points with their cluster and a noise mark."""
    fitted = fit_components(df, cols, dims)
    return fitted.transform(df, (keep or []) + [cluster]).withColumn("is_noise", F.col(cluster) == -1)
