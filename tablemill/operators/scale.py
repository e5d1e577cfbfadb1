"""Scaling: fitted centres and scales are two numbers per column, applied as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tablemill.functions.numbers import numeric_columns, quoted
from tablemill.operators.ranks import quantiles
from tablemill.operators.reports import describe_table, distribution_summary

Scaler = dict[str, tuple[float, float]]


def fit_standard(df: DataFrame, cols: list[str]) -> Scaler:
    """Mean and population sd; a constant column is only centred."""
    r = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(quoted(c)).alias(f"m{i}"), F.stddev_pop(quoted(c)).alias(f"s{i}"))]).first()
    return {c: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def fit_minmax(df: DataFrame, cols: list[str]) -> Scaler:
    r = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.min(quoted(c)).cast("double").alias(f"a{i}"), F.max(quoted(c)).cast("double").alias(f"b{i}"))]).first()
    return {c: (r[f"a{i}"] or 0.0, ((r[f"b{i}"] or 0.0) - (r[f"a{i}"] or 0.0)) or 1.0) for i, c in enumerate(cols)}


def fit_robust(df: DataFrame, cols: list[str]) -> Scaler:
    """Exact median and IQR; an IQR of zero divides by one."""
    return {c: (0.0, 1.0) if m is None else (m, (b - a) or 1.0)
            for c, (a, m, b) in quantiles(df, cols, [0.25, 0.5, 0.75]).items()}


FITTERS = {"standard": fit_standard, "minmax": fit_minmax, "robust": fit_robust}


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.select(*[
        ((quoted(c) - F.lit(float(scaler[c][0]))) / F.lit(float(scaler[c][1]))).alias(c) if c in scaler else quoted(c)
        for c in df.columns])


def scale(df: DataFrame, cols: list[str] | None = None, method: str = "robust") -> tuple[DataFrame, Scaler]:
    scaler = FITTERS[method](df, cols or numeric_columns(df))
    return apply_scaler(df, scaler), scaler


def scaler_table(spark, scaler: Scaler) -> DataFrame:
    return spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in scaler.items()],
                                 "column string, centre double, scale double")


def scaler_from(table: DataFrame) -> Scaler:
    return {r["column"]: (r["centre"], r["scale"]) for r in table.collect()}


def scaling_comparison(df: DataFrame, cols: list[str]) -> DataFrame:
    """describe() of the original and the three scaled forms.

    Scaling is affine, so every statistic of a scaled column follows from the one of the original
    column: a single describe is enough for all four.
    """
    base = describe_table(df, cols)
    rows = {r["column"]: r for r in base.collect()}
    scalers = {"standard": fit_standard(df, cols),
               "minmax": {c: (r["min"], (r["max"] - r["min"]) or 1.0) if r["count"] else (0.0, 1.0) for c, r in rows.items()},
               "robust": {c: (r["q50"], (r["q75"] - r["q25"]) or 1.0) if r["count"] else (0.0, 1.0) for c, r in rows.items()}}
    stats = ["mean", "min", "q25", "q50", "q75", "max"]
    out = base.select(F.lit("original").alias("form"), *base.columns)
    for form, scaler in scalers.items():
        centre = F.create_map(*[x for c, (a, _) in scaler.items() for x in (F.lit(c), F.lit(float(a)))])
        width = F.create_map(*[x for c, (_, b) in scaler.items() for x in (F.lit(c), F.lit(float(b)))])
        moved = {s: (F.col(s) - centre[F.col("column")]) / width[F.col("column")] for s in stats}
        out = out.unionByName(base.select(
            F.lit(form).alias("form"), "column", "count", (F.col("sd") / width[F.col("column")]).alias("sd"),
            *[moved[s].alias(s) for s in stats]))
    return out


def normality_p(n: float, skew: float, kurtosis: float) -> float:
    """D'Agostino-Pearson K2 p-value from n and the population skewness and kurtosis (excess)."""
    g1, b2 = skew, kurtosis + 3
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    y = y or 1.0
    z_skew = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (b2 - mean) / math.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(
        6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + math.sqrt(1 + 4.0 / root**2))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * math.sqrt(2 / (a - 4.0))
    term2 = math.copysign(abs((1 - 2.0 / a) / denom) ** (1 / 3.0), denom) if denom else 0.0
    z_kurt = (term1 - term2) / math.sqrt(2 / (9.0 * a))
    return math.exp(-(z_skew**2 + z_kurt**2) / 2)


def scaling_impact(original: DataFrame, scaled: DataFrame, col: str, factor: float = 1.5) -> DataFrame:
    """(form, count, mean, sd, quartiles, skew, kurtosis, normality_p, outliers) before and after."""
    out = None
    for form, df in (("original", original), ("scaled", scaled)):
        q1, _, q3 = quantiles(df, [col], [0.25, 0.5, 0.75])[col]
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        c = quoted(col)
        moments = df.agg(F.count(c).alias("n"), F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2"),
                         F.count_if((c < low) | (c > high)).alias("outliers")).first()
        p = normality_p(float(moments["n"]), moments["g1"], moments["g2"])
        row = describe_table(df, [col]).select(
            F.lit(form).alias("form"), "*", F.lit(moments["g1"]).alias("g1"), F.lit(moments["g2"]).alias("g2"),
            F.lit(p).alias("normality_p"), F.lit(moments["outliers"]).alias("outliers"))
        out = row if out is None else out.unionByName(row)
    return out
