"""How far a sample, or a later batch, is from the table it came from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.operators.ranks import long_values, quantiles, running_total, value_counts

EPS = 1e-10


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_p(statistic: float, dof: int) -> float:
    return upper_gamma(dof / 2, statistic / 2) if dof > 0 else 1.0


def kolmogorov_p(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    x = d * math.sqrt(n1 * n2 / (n1 + n2))
    if x < 1e-3:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def proportion_table(original: DataFrame, sample: DataFrame, col: str) -> DataFrame:
    """(value, n_original, n_sample, p_original, p_sample): left join, values missing in the sample are 0."""
    a = value_counts(original, [col]).select("value", F.col("n").alias("n_original"))
    b = value_counts(sample, [col]).select("value", F.col("n").alias("n_sample"))
    n1 = original.agg(F.count(quoted(col))).first()[0]
    n2 = sample.agg(F.count(quoted(col))).first()[0]
    both = a.join(b, "value", "left").withColumn("n_sample", F.coalesce("n_sample", F.lit(0)))
    return both.select(
        "value", "n_original", "n_sample", (F.col("n_original") / F.lit(n1)).alias("p_original"),
        F.try_divide(F.col("n_sample"), F.lit(n2)).alias("p_sample"))


def category_drift(original: DataFrame, sample: DataFrame, cols: list[str]) -> DataFrame:
    """(column, metric, value): mean absolute difference of shares, KL divergence, chi-square with p."""
    rows = []
    for c in cols:
        t = proportion_table(original, sample, c)
        p, q = F.col("p_original"), F.coalesce("p_sample", F.lit(0.0))
        smoothed = F.when(q > 0, q).otherwise(F.lit(EPS)) + EPS
        r = t.agg(
            F.avg(F.abs(p - q)).alias("diff"), F.sum(p * F.ln((p + EPS) / smoothed)).alias("kl"),
            F.count(F.lit(1)).alias("k"), F.sum("n_original").alias("a"), F.sum("n_sample").alias("b"),
            F.sum(F.col("n_original") ** 2 / (F.col("n_original") + F.col("n_sample"))).alias("sa"),
            F.sum(F.col("n_sample") ** 2 / (F.col("n_original") + F.col("n_sample"))).alias("sb")).first()
        a, b = r["a"] or 0, r["b"] or 0
        if a and b:
            chi2 = (a + b) * (r["sa"] / a + r["sb"] / b - 1)
            if r["k"] == 2:
                cells = t.select("n_original", "n_sample").collect()
                chi2 = yates([[x["n_original"] for x in cells], [x["n_sample"] for x in cells]])
            rows += [(c, "chi2", max(chi2, 0.0)), (c, "chi2_pvalue", chi2_p(max(chi2, 0.0), r["k"] - 1))]
        rows += [(c, "prop_difference", r["diff"]), (c, "kl_divergence", r["kl"])]
    return original.sparkSession.createDataFrame(rows, "column string, metric string, value double")


def yates(table: list[list[int]]) -> float:
    """Chi-square of a 2 x 2 table with continuity correction."""
    rows = [sum(r) for r in table]
    cols = [table[0][j] + table[1][j] for j in range(2)]
    n = sum(rows)
    total = 0.0
    for i in range(2):
        for j in range(2):
            expected = rows[i] * cols[j] / n
            gap = abs(table[i][j] - expected)
            total += (gap - min(0.5, gap)) ** 2 / expected if expected else 0.0
    return total


def ks_statistics(original: DataFrame, sample: DataFrame, cols: list[str]) -> dict[str, tuple[float, int, int]]:
    """Largest gap of the two distribution functions per column, from counts per distinct value."""
    a = long_values(original, [], cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n1"))
    b = long_values(sample, [], cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n2"))
    both = a.join(b, ["column", "value"], "full").select(
        "column", "value", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"))
    sizes = both.groupBy("column").agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    # whole-number weights keep the running gap exact
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cross = (big("n1") * big("t2") - big("n2") * big("t1")).cast("decimal(38,0)")
    weighted = both.join(F.broadcast(sizes), "column").withColumn("w", cross)
    placed = running_total(weighted, ["column"], ["value"], "w", "before")
    gap = F.abs((F.col("before") + F.col("w")).cast("double")) / (F.col("t1").cast("double") * F.col("t2"))
    rows = placed.groupBy("column").agg(F.max(gap).alias("d"), F.max("t1").alias("t1"), F.max("t2").alias("t2"))
    return {r["column"]: (r["d"], r["t1"], r["t2"]) for r in rows.collect()}


def numeric_drift(original: DataFrame, sample: DataFrame, cols: list[str]) -> DataFrame:
    """(column, metric, value): mean, sd and quartile differences in sd units, KS statistic and p."""
    stats = lambda df: df.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(quoted(c)).alias(f"m{i}"), F.stddev(quoted(c)).alias(f"s{i}"))]).first()
    a, b = stats(original), stats(sample)
    qa, qb = quantiles(original, cols, [0.25, 0.5, 0.75]), quantiles(sample, cols, [0.25, 0.5, 0.75])
    ks = ks_statistics(original, sample, cols)
    rows = []
    for i, c in enumerate(cols):
        unit = a[f"s{i}"] or 1.0
        if a[f"m{i}"] is None or b[f"m{i}"] is None:  # a side without values cannot be compared
            continue
        rows += [(c, "mean_difference", abs(a[f"m{i}"] - b[f"m{i}"]) / unit),
                 (c, "std_difference", abs(a[f"s{i}"] - b[f"s{i}"]) / unit),
                 (c, "ks_statistic", ks[c][0]), (c, "ks_pvalue", kolmogorov_p(*ks[c]))]
        rows += [(c, f"Q{k + 1}_difference", abs(x - y) / unit) for k, (x, y) in enumerate(zip(qa[c], qb[c]))]
    return original.sparkSession.createDataFrame(rows, "column string, metric string, value double")


def sample_metrics(original: DataFrame, sample: DataFrame, text: list[str], numeric: list[str]) -> DataFrame:
    n, m = original.count(), sample.count()
    out = original.sparkSession.createDataFrame([("*", "reduction_ratio", m / n)],
                                                "column string, metric string, value double")
    if text:
        out = out.unionByName(category_drift(original, sample, text))
    return out.unionByName(numeric_drift(original, sample, numeric)) if numeric else out


def cramers_v(df: DataFrame, a: str, b: str) -> float:
    """Association of two columns, with continuity correction for 2 x 2 tables."""
    cells = df.where(quoted(a).isNotNull() & quoted(b).isNotNull()).groupBy(
        quoted(a).alias("a"), quoted(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    rb = cells.groupBy("b").agg(F.sum("n").alias("rb"))
    shape = ra.agg(F.count(F.lit(1)).alias("r"), F.sum("ra").alias("n")).first()
    columns = rb.count()
    n, smallest = shape["n"], min(shape["r"], columns) - 1
    if shape["r"] == 2 and columns == 2:
        found = {(r["a"], r["b"]): r["n"] for r in cells.collect()}
        rows, cols = sorted({k[0] for k in found}), sorted({k[1] for k in found})
        chi2 = yates([[found.get((x, y), 0) for y in cols] for x in rows])
    else:
        part = cells.join(ra, "a").join(rb, "b").agg(
            F.sum(F.col("n").cast("double") * F.col("n") / (F.col("ra").cast("double") * F.col("rb")))).first()[0]
        chi2 = n * (part - 1)
    return math.sqrt(max(chi2, 0.0) / (n * smallest)) if smallest else 0.0
