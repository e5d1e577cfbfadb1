"""Data quality, distribution and comparison reports, each a small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.functions.numbers import numeric_columns, quoted, text_columns
from tablemill.functions.text import matches_serving_format
from tablemill.operators.profile import profile_table
from tablemill.operators.ranks import long_values, quantile_table, quantiles, value_counts


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 2))


def quality_report(df: DataFrame, approx: bool = False, profiled: DataFrame | None = None) -> DataFrame:
    p = profiled or profile_table(df, approx, moments=False)
    share = F.col("distinct") / F.col("rows")
    return p.select(
        "column", "dtype", "rows",
        F.col("nulls").alias("null_count"),
        percent(F.col("nulls"), F.col("rows")).alias("null_pct"),
        F.col("distinct").alias("distinct_count"),
        percent(F.col("distinct"), F.col("rows")).alias("distinct_pct"),
        (F.col("distinct") == 1).alias("is_constant"),
        ((F.col("kind") == "text") & (share > 0.5)).alias("is_high_cardinality"),
        ((F.col("kind") == "numeric") & (share < 0.01)).alias("is_low_variance"),
    )


def missing_report(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    p = profile_table(df, distinct=False, moments=False)
    pct = F.col("nulls") / F.col("rows") * 100
    return (
        p.where(F.col("nulls") > 0)
        .select("column", pct.alias("null_pct"), (pct > threshold).alias("alert"))
        .orderBy(F.col("null_pct").desc(), "column")
    )


def consistency_report(df: DataFrame, energy: str = "energy-kcal_100g",
                       macros: tuple = ("carbohydrates_100g", "proteins_100g", "fat_100g")) -> DataFrame:
    """Rows that break a rule, one line per rule whose columns exist."""
    rules = []
    if energy in df.columns:
        rules.append(("energy_over_900", quoted(energy) > 900))
    if all(m in df.columns for m in macros):
        total = sum((F.coalesce(quoted(m), F.lit(0.0)) for m in macros), F.lit(0.0))
        rules.append(("macros_over_100", total > 100))
    counted = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name, _ in rules
    ])))


def problem_columns(df: DataFrame, missing_threshold: float = 0.5, unique_threshold: float = 0.95,
                    format_column: str = "serving_size") -> DataFrame:
    """(column, issue, ratio): too many nulls, nearly unique, constant, bad format."""
    p = profile_table(df, moments=False)
    null_ratio, share = F.col("nulls") / F.col("rows"), F.col("distinct") / F.col("rows")
    issues = F.array(
        F.struct(F.lit("high_missing").alias("issue"), null_ratio.alias("ratio"),
                 (null_ratio > missing_threshold).alias("hit")),
        F.struct(F.lit("high_unique").alias("issue"), share.alias("ratio"),
                 (share > unique_threshold).alias("hit")),
        F.struct(F.lit("constant").alias("issue"), share.alias("ratio"),
                 (F.col("distinct") == 1).alias("hit")),
    )
    out = p.select("column", F.explode(issues).alias("i")).select("column", "i.*").where("hit").drop("hit")
    if format_column in df.columns:
        bad = df.agg(F.count_if(quoted(format_column).isNotNull()
                                & ~matches_serving_format(quoted(format_column))).alias("bad"),
                     F.count(F.lit(1)).alias("rows"))
        out = out.unionByName(bad.where("bad > 0").select(
            F.lit(format_column).alias("column"), F.lit("format_error").alias("issue"),
            (F.col("bad") / F.col("rows")).alias("ratio")))
    return out


def value_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n, share) with share over the non-null rows of the column."""
    counts = value_counts(df, cols)
    wide = df.agg(*[F.count(quoted(c)).alias(f"t{i}") for i, c in enumerate(cols)])
    # one row per column, so the broadcast is as small as the column list
    totals = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"t{i}").alias("total")) for i, c in enumerate(cols)
    ])))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def category_distribution(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Size, natural-log entropy, imbalance and null share of every text column."""
    cols = cols or text_columns(df)
    shares = value_shares(df, cols)
    stats = shares.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_categories"),
        (-F.sum(F.col("share") * F.ln("share"))).alias("entropy"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
    )
    rows = profile_table(df.select(*[quoted(c) for c in cols]), distinct=False, moments=False)
    return stats.join(F.broadcast(rows), "column").select(
        "column", "n_categories", "entropy", "imbalance_ratio",
        (F.col("nulls") / F.col("rows")).alias("null_ratio"),
        (F.col("n_categories") / F.col("rows")).alias("distinct_ratio"),
    )


def extreme_categories(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """The ``k`` most and least frequent values per column.

    Both windows are followed by a rank limit, which Spark applies before the shuffle too.
    """
    counts = value_counts(df, cols)

    def side(label, order):
        w = Window.partitionBy("column").orderBy(*order)
        return counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select(
            "column", F.lit(label).alias("side"), "position", "value", "n")

    return side("most", [F.col("n").desc(), F.col("value")]).unionByName(
        side("least", [F.col("n"), F.col("value").desc()]))


def category_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct count, most common value with its share and a top-3 text per column."""
    counts = value_counts(df, cols)
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    top = counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 3)
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    pct = F.round(F.col("n") / F.lit(df.count()) * 100, 2)
    texts = top.withColumn("pct", pct).groupBy("column").agg(
        F.max(F.when(F.col("rk") == 1, F.col("value"))).alias("most_common"),
        F.max(F.when(F.col("rk") == 1, F.col("pct"))).alias("most_common_pct"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rk", "value", "pct"))),
            lambda s: F.concat(s["value"], F.lit(" ("), F.format_string("%.2f", s["pct"]), F.lit("%)"))), ", ",
        ).alias("top3"),
    )
    return texts.join(F.broadcast(sizes), "column")


def distribution_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, median, sd and the bias-corrected skewness and excess kurtosis per column."""
    medians = quantile_table(df, cols, [0.5])
    wide = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.count(quoted(c)).alias(f"n{i}"), F.avg(quoted(c)).alias(f"m{i}"),
        F.stddev(quoted(c)).alias(f"s{i}"), F.skewness(quoted(c)).alias(f"g{i}"),
        F.kurtosis(quoted(c)).alias(f"k{i}"))])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("double").alias("n"), F.col(f"m{i}").alias("mean"),
                 F.col(f"s{i}").alias("sd"), F.col(f"g{i}").alias("g1"), F.col(f"k{i}").alias("g2"))
        for i, c in enumerate(cols)
    ])))
    n = F.col("n")
    return long.join(F.broadcast(medians.select("column", F.col("q")[0].alias("median"))), "column", "left").select(
        "column", "mean", "median", "sd",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
    )


def describe_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, count, mean, sd, min, q25, q50, q75, max)."""
    cols = cols or numeric_columns(df)
    q = quantile_table(df, cols, [0.25, 0.5, 0.75])
    wide = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.count(quoted(c)).alias(f"n{i}"), F.avg(quoted(c)).alias(f"m{i}"), F.stddev(quoted(c)).alias(f"s{i}"),
        F.min(quoted(c)).cast("double").alias(f"lo{i}"), F.max(quoted(c)).cast("double").alias(f"hi{i}"))])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                 F.col(f"s{i}").alias("sd"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)
    ])))
    return long.join(F.broadcast(q), "column", "left").select(
        "column", "count", "mean", "sd", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"), "max")


def group_centres(df: DataFrame, by: str, number: str, label: str) -> DataFrame:
    """Mean and median of ``number`` and the mode of ``label`` per group."""
    means = df.groupBy(quoted(by)).agg(F.avg(quoted(number)).alias("mean"))
    medians = quantile_table(df, [number], [0.5], by=[by]).select(by, F.col("q")[0].alias("median"))
    counted = df.where(quoted(label).isNotNull()).groupBy(quoted(by), quoted(label).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    mode = counted.groupBy(by).agg(F.min(F.struct((-F.col("_n")).alias("a"), F.col("_v").alias("b"))).alias("_m"))
    return means.join(medians, by, "left").join(mode.select(by, F.col("_m.b").alias("mode")), by, "left")


def relevance_report(df: DataFrame, variance_weight: float = 0.3, missing_weight: float = 0.3,
                     unique_weight: float = 0.4) -> DataFrame:
    """Weighted score of spread, completeness and distinctness per column."""
    p = profile_table(df)
    null_ratio, share = F.col("nulls") / F.col("rows"), F.col("distinct") / F.col("rows")
    unique_score = F.least(share, F.lit(0.5)) * 2
    span = F.when(F.col("max") != F.col("min"), F.col("max") - F.col("min")).otherwise(F.lit(1.0))
    spread = F.when(F.col("kind") == "numeric", F.least(F.col("var") / (span * span), F.lit(1.0))).otherwise(
        unique_score)
    scored = p.select(
        "column", "position", "kind", null_ratio.alias("null_ratio"), F.col("var").alias("variance"),
        share.alias("distinct_ratio"), spread.alias("variance_score"), (1 - null_ratio).alias("missing_score"),
        unique_score.alias("unique_score"))
    return scored.withColumn(
        "total_score",
        F.col("variance_score") * variance_weight + F.col("missing_score") * missing_weight
        + F.col("unique_score") * unique_weight)


def storage_report(df: DataFrame) -> DataFrame:
    """Estimated bytes per column, their share and a narrower type where the values allow it."""
    p = profile_table(df)
    # one row per column: the window is as small as the column list
    total = F.sum("bytes").over(Window.partitionBy(F.lit(1)))
    hint = (
        F.when((F.col("kind") == "text") & (F.col("distinct") <= 255), "dictionary")
        .when((F.col("dtype") == "bigint") & (F.col("min") >= 0) & (F.col("max") <= 255), "smallint")
    )
    return p.select(
        "column", "dtype", "bytes", (F.col("bytes") / total * 100).alias("bytes_pct"), "distinct",
        hint.alias("suggestion"))


def dtype_distribution(df: DataFrame) -> DataFrame:
    p = profile_table(df, distinct=False)
    return p.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("bytes").alias("bytes"))


def group_statistics(df: DataFrame, by: str, number: str) -> DataFrame:
    c = quoted(number)
    return df.groupBy(quoted(by)).agg(
        F.avg(c).alias("mean"), F.stddev(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.count(c).alias("count"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and null cells of both tables and the columns added and removed."""

    def side(df, label):
        cells = sum((F.col(c).isNull().cast("long") for c in map(_tick, df.columns)), F.lit(0).cast("long"))
        return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(cells).alias("null_cells")).select(
            F.lit(label).alias("stage"), "rows", F.lit(len(df.columns)).alias("columns"), "null_cells")

    added = [c for c in after.columns if c not in before.columns]
    removed = [c for c in before.columns if c not in after.columns]
    both = side(before, "before").unionByName(side(after, "after"))
    return both.withColumn("added", F.lit(",".join(sorted(added)))).withColumn(
        "removed", F.lit(",".join(sorted(removed))))


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(quoted(a).isNotNull() & quoted(b).isNotNull()).groupBy(
        quoted(a).alias("a"), quoted(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int | None = 30) -> DataFrame:
    """(bin, low, high, n) over equal-width bins; ``bins=None`` takes min(50, floor(sqrt(rows)))."""
    stats = df.agg(F.min(quoted(col)), F.max(quoted(col)), F.count(quoted(col))).first()
    if not stats[2]:  # no values, no bins
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    low, high, n = float(stats[0]), float(stats[1]), stats[2]
    bins = bins or min(50, int(n**0.5))
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((quoted(col) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(quoted(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


def box_plot_table(df: DataFrame, cols: list[str], whisker: float = 1.5, per_panel: int = 5) -> DataFrame:
    """Quartiles, whisker ends, outlier count and the panel (by value range) of every column."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        q1, _, q3 = q[c]
        low, high = (0.0, 0.0) if q1 is None else (q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1))
        x = quoted(c)
        inside = (x >= low) & (x <= high)
        aggs += [F.min(F.when(inside, x)).cast("double").alias(f"lo{i}"),
                 F.max(F.when(inside, x)).cast("double").alias(f"hi{i}"),
                 F.count_if(~inside).alias(f"o{i}"), (F.max(x) - F.min(x)).cast("double").alias(f"r{i}")]
    wide = df.agg(*aggs)
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.lit(v).cast("double").alias(n) for n, v in zip(("q1", "median", "q3"), q[c])],
                 F.col(f"lo{i}").alias("whisker_low"), F.col(f"hi{i}").alias("whisker_high"),
                 F.col(f"o{i}").alias("outliers"), F.col(f"r{i}").alias("span"))
        for i, c in enumerate(cols)
    ])))
    # one row per column: the window is as small as the column list
    w = Window.partitionBy(F.lit(1)).orderBy("span", "column")
    return long.withColumn("panel", F.floor((F.row_number().over(w) - 1) / per_panel).cast("int"))


def cluster_profile(df: DataFrame, cols: list[str], cluster: str = "cluster", k: int = 5) -> DataFrame:
    """Per cluster: size, the highest column means and the columns farthest from the global mean."""
    means = df.where(quoted(cluster) != -1).groupBy(quoted(cluster)).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(quoted(c)).alias(c) for c in cols])
    overall = df.agg(*[F.avg(quoted(c)).alias(c) for c in cols])
    long = means.unpivot([cluster, "size"], cols, "column", "mean")
    base = overall.unpivot([], cols, "column", "global_mean")
    joined = long.join(F.broadcast(base), "column").withColumn(
        "distance", F.abs(F.col("mean") - F.col("global_mean")))
    by_mean = Window.partitionBy(cluster).orderBy(F.col("mean").desc(), "column")
    by_distance = Window.partitionBy(cluster).orderBy(F.col("distance").desc(), "column")
    return joined.select(
        cluster, "size", "column", "mean", "distance",
        F.row_number().over(by_mean).alias("mean_rank"), F.row_number().over(by_distance).alias("distance_rank"),
    ).where((F.col("mean_rank") <= k) | (F.col("distance_rank") <= k))
