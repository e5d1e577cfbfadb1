"""Outlier detectors on one column, bounds on many, and the ways to treat what they flag."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tablemill.functions.numbers import clip, numeric_columns, quoted
from tablemill.operators.joins import small_side
from tablemill.operators.ranks import global_rank, quantile_table, quantiles

FLAG = "is_outlier"


def tukey_stats(df: DataFrame, col: str, threshold: float = 1.5) -> dict[str, float]:
    q1, q3 = quantiles(df, [col], [0.25, 0.75])[col]
    if q1 is None:  # no values
        return dict.fromkeys(("q1", "q3", "iqr", "lower_bound", "upper_bound"))
    iqr = q3 - q1
    return {"q1": q1, "q3": q3, "iqr": iqr, "lower_bound": q1 - threshold * iqr, "upper_bound": q3 + threshold * iqr}


def zscore_stats(df: DataFrame, col: str, threshold: float = 3.0, ddof: int = 0) -> dict[str, float]:
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    mean, std = df.agg(F.avg(quoted(col)), sd(quoted(col))).first()
    if std is None:
        return {"mean": mean, "std": None, "lower_bound": None, "upper_bound": None}
    return {"mean": mean, "std": std, "lower_bound": mean - threshold * std, "upper_bound": mean + threshold * std}


def flag_tukey(df: DataFrame, col: str, threshold: float = 1.5) -> tuple[DataFrame, dict]:
    s = tukey_stats(df, col, threshold)
    if s["q1"] is None:
        return df.withColumn(FLAG, F.lit(False)), s
    x = quoted(col)
    hit = F.coalesce((x < s["lower_bound"]) | (x > s["upper_bound"]), F.lit(False))
    return df.withColumn(FLAG, hit), s


def flag_zscore(df: DataFrame, col: str, threshold: float = 3.0, ddof: int = 0) -> tuple[DataFrame, dict]:
    s = zscore_stats(df, col, threshold, ddof)
    if not s["std"]:
        return df.withColumn(FLAG, F.lit(False)), s
    score = F.abs((quoted(col) - s["mean"]) / s["std"])
    return df.withColumn(FLAG, F.coalesce(score > threshold, F.lit(False))), s


def category_anomalies(df: DataFrame, id_col: str, cols: list[str], by: str | None = "categories",
                       factor: float = 1.5) -> DataFrame:
    """(category, column, id) of values outside the IQR fences of their category, or of all rows."""
    by_cols = [by] if by and by in df.columns else []
    q = quantile_table(df, cols, [0.25, 0.75], by=by_cols)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    bounds = q.select(*[F.col(b).alias("_by") for b in by_cols], F.col("column").alias("_column"),
                      (q1 - factor * (q3 - q1)).alias("_low"), (q3 + factor * (q3 - q1)).alias("_high"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in cols])
    category = quoted(by_cols[0]) if by_cols else F.lit("all")
    long = df.select(category.alias("category"), quoted(id_col).alias("id"), F.inline(pairs))
    on = F.col("column") == F.col("_column")
    if by_cols:
        on = on & (F.col("category") == F.col("_by"))
    hit = long.join(small_side(bounds), on)
    return hit.where((F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high"))).select(
        "category", "column", "id")


def bounds_table(df: DataFrame, cols: list[str] | None = None, method: str = "iqr", threshold: float = 1.5,
                 ) -> tuple[dict[str, tuple[float, float]], DataFrame]:
    """Bounds per column from the input rows and the report (column, n_outliers, ratio, lower, upper)."""
    cols = cols or numeric_columns(df)
    if method == "iqr":
        bounds = {c: (None, None) if a is None else (a - threshold * (b - a), b + threshold * (b - a))
                  for c, (a, b) in quantiles(df, cols, [0.25, 0.75]).items()}
    elif method == "zscore":
        r = df.agg(*[x for i, c in enumerate(cols) for x in (
            F.avg(quoted(c)).alias(f"m{i}"), F.stddev_samp(quoted(c)).alias(f"s{i}"))]).first()
        bounds = {c: (None, None) if r[f"s{i}"] is None else (
            r[f"m{i}"] - threshold * r[f"s{i}"], r[f"m{i}"] + threshold * r[f"s{i}"]) for i, c in enumerate(cols)}
    else:
        raise ValueError(f"unknown method {method}")
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[
        (F.lit(0).cast("long") if low is None else F.count_if((quoted(c) < low) | (quoted(c) > high))).alias(f"o{i}")
        for i, (c, (low, high)) in enumerate(bounds.items())])
    report = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("n_outliers"),
                 (F.col(f"o{i}") / F.col("n")).alias("ratio"), F.lit(low).cast("double").alias("lower"),
                 F.lit(high).cast("double").alias("upper"))
        for i, (c, (low, high)) in enumerate(bounds.items())])))
    return bounds, report


def apply_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]], strategy: str = "clip") -> DataFrame:
    """``clip`` values to their bounds or ``remove`` rows outside them; rows with NULL stay, and so does a
    column without values, whose bounds are None."""
    bounds = {c: b for c, b in bounds.items() if b[0] is not None}
    if strategy == "clip":
        return df.select(*[clip(quoted(c), *bounds[c]).alias(c) if c in bounds else quoted(c) for c in df.columns])
    if strategy == "remove":
        for c, (low, high) in bounds.items():
            df = df.where(quoted(c).isNull() | quoted(c).between(low, high))
        return df
    raise ValueError(f"unknown strategy {strategy}")


# --- robust ellipse (minimum covariance determinant in one dimension) -----------------------------

# Chi-square quantiles with one degree of freedom at 0.5 and 0.975.
CHI2_MEDIAN = 0.454936423119572
CHI2_975 = 5.023886187314888


def elliptic_fit(df: DataFrame, col: str, id_col: str) -> dict[str, float]:
    """Robust location and variance of one column.

    The best half of the data is the shortest run of h neighbours in sorted order. Every row gets its
    global rank from range splits, and a join on rank = rank + h (unique, evenly spread keys) gives the
    length of every run; nothing is sorted in one task.
    """
    x = quoted(col).cast("double")
    data = df.where(quoted(col).isNotNull()).select(x.alias("x"), quoted(id_col).alias("id"))
    n = data.count()
    h = math.ceil(0.5 * (n + 2))
    if h < n:
        ranked = global_rank(data, ["x", "id"])
        runs = ranked.select("rank", F.col("x").alias("lo")).join(
            ranked.select((F.col("rank") - h).alias("rank"), F.col("x").alias("hi")), "rank")
        widths = runs.groupBy((F.col("hi") - F.col("lo")).alias("w")).agg(
            F.sum((F.col("lo") + F.col("hi")) * 0.5).alias("s"), F.count(F.lit(1)).alias("k"))
        best = widths.agg(F.min(F.struct("w", "s", "k")).alias("b")).select("b.*").first()
        location = best["s"] / best["k"]
        variance = _nearest_variance(data, location, h)
    else:
        location, variance = data.agg(F.avg("x"), F.var_pop("x")).first()
    squared = (F.col("x") - location) ** 2 / (variance or 1e-300)
    median = quantiles(data.select(squared.alias("d")), ["d"], [0.5])["d"][0]
    correction = median / CHI2_MEDIAN
    core = data.where(squared / (correction or 1e-300) < CHI2_975)
    loc, var = core.agg(F.avg("x"), F.var_pop("x")).first()
    return {"location": loc, "variance": var, "raw_location": location, "raw_variance": variance * correction}


def _nearest_variance(data: DataFrame, location: float, h: int) -> float:
    """Variance of the h rows nearest to ``location``; ties at the edge are filled from below."""
    dist = F.abs(F.col("x") - location)
    n = data.count()
    edge = quantiles(data.select(dist.alias("d")), ["d"], [(h - 1) / (n - 1)])["d"][0]
    # the position is a whole number, so interpolation leaves a value of the data up to rounding
    tol = 1e-12 * max(1.0, abs(edge))
    c = F.col("x") - location
    r = data.agg(
        F.count_if(dist < edge - tol).alias("n"), F.sum(F.when(dist < edge - tol, c)).alias("s"),
        F.sum(F.when(dist < edge - tol, c * c)).alias("q"),
        F.count_if((dist >= edge - tol) & (dist <= edge + tol) & (c < 0)).alias("below")).first()
    low = min(h - r["n"], r["below"])
    high = h - r["n"] - low
    s = (r["s"] or 0.0) - low * edge + high * edge
    q = (r["q"] or 0.0) + (low + high) * edge * edge
    return q / h - (s / h) ** 2


def flag_elliptic(df: DataFrame, col: str, id_col: str, contamination: float = 0.1) -> tuple[DataFrame, dict]:
    s = elliptic_fit(df, col, id_col)
    dist = (quoted(col) - s["location"]) ** 2 / (s["variance"] or 1e-300)
    scored = df.withColumn("distance", dist)
    cut = quantiles(scored, ["distance"], [1 - contamination])["distance"][0]
    return scored.withColumn(FLAG, F.coalesce(F.col("distance") > cut, F.lit(False))), {**s, "cut": cut}


# --- isolation forest -----------------------------------------------------------------------------

TREE_ROWS = 256


def _mean_path(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def forest_fit(df: DataFrame, col: str, id_col: str, n_estimators: int = 100, seed: int = 42,
               max_samples: int = TREE_ROWS):
    """Breakpoints and mean path lengths of a one-column isolation forest.

    Every tree sees the ``max_samples`` rows with the smallest hash of (seed, tree, id). Only rows under a hash bound
    that leaves out none of these (but by a chance of 10^-20) are dealt to a tree, so few rows move. Trees are
    grown in parallel, one small group each, and in one dimension a tree is a step function of the value.
    The forest is the average of those steps: at most trees x max_samples numbers.
    """
    data = df.where(quoted(col).isNotNull()).select(quoted(col).cast("double").alias("x"),
                                                    quoted(id_col).cast("string").alias("id"))
    n = data.count()
    size = min(max_samples, n)
    bound = min(1.0, (size + 10 * math.sqrt(size) + 20) / max(n, 1))
    draw = lambda tree: F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, F.col("id")), 11).cast("double") * F.lit(2.0 ** -53)
    dealt = data.select("x", "id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_estimators - 1)),
                                                      lambda t: draw(t) <= bound)).alias("tree"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(draw(F.col("tree")), "id", "x"))
    dealt = dealt.withColumn("place", place).where(F.col("place") <= size).select("tree", "x")

    def grow(key, pdf):
        rng = np.random.RandomState((seed + 7919 * int(key[0])) % (2**32))
        limit = math.ceil(math.log2(max(size, 2)))
        leaves = []

        def split(values, low, depth):
            if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
                leaves.append((low, depth + _mean_path(len(values))))
                return
            cut = rng.uniform(values[0], values[-1])
            at = np.searchsorted(values, cut, side="right")
            split(values[:at], low, depth + 1)
            split(values[at:], cut, depth + 1)

        split(np.sort(pdf["x"].to_numpy()), -np.inf, 0)
        return pd.DataFrame(leaves, columns=["low", "depth"]).assign(tree=int(key[0]))[["tree", "low", "depth"]]

    leaves = dealt.groupBy("tree").applyInPandas(grow, "tree int, low double, depth double").toPandas()
    starts = np.unique(leaves["low"].to_numpy())
    total = np.zeros(len(starts))
    count = 0
    for _, tree in leaves.sort_values(["tree", "low"]).groupby("tree"):
        at = np.searchsorted(tree["low"].to_numpy(), starts, side="right") - 1
        total += tree["depth"].to_numpy()[at]
        count += 1
    return starts, total / max(count, 1), size


def flag_forest(df: DataFrame, col: str, id_col: str, contamination: float = 0.1, n_estimators: int = 100,
                seed: int = 42) -> tuple[DataFrame, dict]:
    starts, paths, size = forest_fit(df, col, id_col, n_estimators, seed)
    scale = _mean_path(size) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype="float64", na_value=np.nan)
        # a split sends values equal to the cut to the left branch
        at = np.searchsorted(starts, v, side="left") - 1
        out = -np.power(2.0, -paths[np.clip(at, 0, len(paths) - 1)] / scale)
        return pd.Series(np.where(np.isnan(v), np.nan, out))

    raw = df.withColumn("score", F.when(quoted(col).isNotNull(), score(quoted(col).cast("double"))))
    cut = quantiles(raw, ["score"], [contamination])["score"][0]
    return raw.withColumn(FLAG, F.coalesce(F.col("score") < cut, F.lit(False))), {
        "cut": cut, "n_estimators": n_estimators, "contamination": contamination, "random_state": seed}


# --- local outlier factor -------------------------------------------------------------------------

def lof_scores(df: DataFrame, col: str, id_col: str, n_neighbors: int = 20, block_rows: int = 50_000) -> DataFrame:
    """(id, x, lof): local outlier factor of one column.

    In one dimension the k nearest neighbours lie within k places in sorted order. Rows are ranked,
    cut into blocks of equal size, and each block also gets 3k rows of its neighbours on either side,
    enough for distances, densities and factors. Blocks are bounded whatever the data looks like.
    Neighbours are ordered by distance, then by rank.
    """
    data = df.where(quoted(col).isNotNull()).select(quoted(col).cast("double").alias("x"), quoted(id_col).alias("id"))
    ranked = global_rank(data, ["x", "id"])
    n = ranked.count()
    k = max(1, min(n_neighbors, n - 1))
    halo = 3 * k
    size = max(block_rows, halo)
    base = (F.col("rank") / size).cast("long")
    pos = F.col("rank") - base * size
    homes = F.array_compact(F.array(
        base, F.when((pos < halo) & (base > 0), base - 1),
        F.when((pos >= size - halo) & ((base + 1) * size < n), base + 1)))
    spread = ranked.select("x", "id", "rank", F.explode(homes).alias("block"))
    id_type = data.schema["id"].dataType.simpleString()

    def block(key, pdf):
        pdf = pdf.sort_values("rank")
        x = pdf["x"].to_numpy()
        m = len(x)
        offsets = np.concatenate([np.arange(-k, 0), np.arange(1, k + 1)])
        idx = np.arange(m)[:, None] + offsets[None, :]
        valid = (idx >= 0) & (idx < m)
        idx = np.clip(idx, 0, m - 1)
        dist = np.where(valid, np.abs(x[idx] - x[:, None]), np.inf)
        near = np.argsort(dist, axis=1, kind="stable")[:, :k]
        nbr = np.take_along_axis(idx, near, axis=1)
        d = np.take_along_axis(dist, near, axis=1)
        kdist = d[:, -1]
        reach = np.maximum(d, kdist[nbr])
        lrd = 1.0 / (reach.mean(axis=1) + 1e-10)
        lof = lrd[nbr].mean(axis=1) / lrd
        mine = (pdf["rank"].to_numpy() // size) == int(key[0])
        return pd.DataFrame({"id": pdf["id"].to_numpy()[mine], "x": x[mine], "lof": lof[mine]})

    return spread.groupBy("block").applyInPandas(block, f"id {id_type}, x double, lof double")


def flag_lof(df: DataFrame, col: str, id_col: str, n_neighbors: int = 20, contamination: float = 0.1,
             ) -> tuple[DataFrame, dict]:
    """(id, x, lof, is_outlier): the share ``contamination`` with the highest factor is flagged."""
    scores = lof_scores(df, col, id_col, n_neighbors)
    cut = quantiles(scores, ["lof"], [1 - contamination])["lof"][0]
    return scores.withColumn(FLAG, F.col("lof") > cut), {"cut": cut, "n_neighbors": n_neighbors}


# --- treatment ------------------------------------------------------------------------------------

def flagged(df: DataFrame, col: str, method: str = "tukey", id_col: str | None = None, **kw,
            ) -> tuple[DataFrame, dict]:
    """The input with a boolean ``is_outlier`` column, for any of the five detectors."""
    if method == "tukey":
        return flag_tukey(df, col, **kw)
    if method == "zscore":
        return flag_zscore(df, col, **kw)
    if id_col is None:
        raise ValueError(f"{method} needs id_col")
    if method == "elliptic":
        out, s = flag_elliptic(df, col, id_col, **kw)
        return out.drop("distance"), s
    if method == "isolation_forest":
        out, s = flag_forest(df, col, id_col, **kw)
        return out.drop("score"), s
    if method == "lof":
        scores, s = flag_lof(df, col, id_col, **kw)
        # one line per (id, value), so that a repeated id cannot multiply rows
        marks = scores.groupBy(F.col("id").alias("_id"), F.col("x").alias("_x")).agg(F.max(FLAG).alias(FLAG))
        same = (quoted(id_col) == F.col("_id")) & (quoted(col).cast("double") == F.col("_x"))
        out = df.join(marks, same, "left").drop("_id", "_x")
        return out.withColumn(FLAG, F.coalesce(F.col(FLAG), F.lit(False))), s
    raise ValueError(f"unknown detection method {method}")


def treat_outliers(df: DataFrame, col: str, strategy: str = "remove", method: str = "tukey",
                   id_col: str | None = None, **kw) -> DataFrame:
    """``remove`` flagged rows, ``impute`` them (and gaps) with the median of the rest, or ``cap`` them.

    Tukey and z-score cap at their bounds, the others put the median of the column.
    """
    marked, s = flagged(df, col, method, id_col, **kw)
    if strategy == "remove":
        return marked.where(~F.col(FLAG)).drop(FLAG)
    if strategy == "impute":
        median = quantiles(marked.where(~F.col(FLAG)), [col], [0.5])[col][0]
        value = F.when(F.col(FLAG) | quoted(col).isNull(), F.lit(median)).otherwise(quoted(col))
        return marked.withColumn(col, value).drop(FLAG)
    if strategy == "cap":
        if method in ("tukey", "zscore"):
            if s["lower_bound"] is None:
                return df
            return df.withColumn(col, clip(quoted(col), s["lower_bound"], s["upper_bound"]))
        median = quantiles(df, [col], [0.5])[col][0]
        return marked.withColumn(col, F.when(F.col(FLAG), F.lit(median)).otherwise(quoted(col))).drop(FLAG)
    raise ValueError(f"unknown strategy {strategy}")


def outlier_summary(df: DataFrame, col: str, method: str = "tukey", id_col: str | None = None, **kw) -> DataFrame:
    marked, _ = flagged(df, col, method, id_col, **kw)
    return marked.agg(F.count(F.lit(1)).alias("total_values"), F.count_if(FLAG).alias("outlier_count")).select(
        "total_values", "outlier_count",
        (F.col("outlier_count") / F.col("total_values") * 100).alias("outlier_percentage"),
        F.lit(method).alias("detection_method"))
