"""Imputation, range rules, duplicate handling and the IQR row filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemill.functions.names import nutrition_columns
from tablemill.functions.numbers import clip, numeric_columns, quoted, ratio, rescaled_to_cap, text_columns
from tablemill.operators.profile import ColumnProfile, profile, profile_table
from tablemill.operators.ranks import modes, quantiles

# Allowed range per column.
VALID_RANGES = {
    "energy_100g": (0.0, 3000.0),
    "proteins_100g": (0.0, 100.0),
    "carbohydrates_100g": (0.0, 100.0),
    "fat_100g": (0.0, 100.0),
    "fiber_100g": (0.0, 50.0),
    "salt_100g": (0.0, 100.0),
}
MACROS = ["proteins_100g", "carbohydrates_100g", "fat_100g"]


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        F.coalesce(quoted(c), F.lit(values[c]).cast(types[c])).alias(c) if c in values else quoted(c)
        for c in df.columns])


def median_impute(df: DataFrame, cols: list[str], default: float = 0.0) -> DataFrame:
    found = quantiles(df, cols, [0.5])
    return fill(df, {c: default if found[c][0] is None else float(found[c][0]) for c in cols})


Plan = tuple[list[str], dict[str, object], list[tuple]]


def plan_nutrition(df: DataFrame, p: dict[str, ColumnProfile], limit: float = 0.2) -> Plan:
    """Nutrition columns: dropped above ``limit`` gaps, else filled with the median."""
    numeric = set(numeric_columns(df))
    cols = [c for c in nutrition_columns(df.columns) if c in numeric and c in p]
    dropped = [c for c in cols if p[c].null_ratio > limit]
    rest = [c for c in cols if c not in dropped and p[c].nulls]
    found = {c: q[0] for c, q in quantiles(df, rest, [0.5]).items() if q[0] is not None} if rest else {}
    log = [(c, "removed_column", "nulls") for c in dropped]
    log += [(c, "imputed_median", f"{m:.2f}") for c, m in found.items()]
    return dropped, found, log


def plan_categories(df: DataFrame, p: dict[str, ColumnProfile], limit: float = 0.3) -> Plan:
    """Text columns: dropped above ``limit`` gaps, else filled with the most frequent value.

    Only columns that have gaps need their value counts.
    """
    cols = [c for c in text_columns(df) if c in p]
    dropped = [c for c in cols if p[c].null_ratio > limit]
    gaps = [c for c in cols if c not in dropped and p[c].nulls]
    found = modes(df, gaps) if gaps else {}
    log = [(c, "removed_column", "nulls") for c in dropped]
    log += [(c, "imputed_mode", v) for c, v in found.items()]
    return dropped, found, log


def impute_nutrition(df: DataFrame, limit: float = 0.2, p: dict[str, ColumnProfile] | None = None) -> DataFrame:
    dropped, values, _ = plan_nutrition(df, p or profile(df, distinct=False, moments=False), limit)
    return fill(df.drop(*dropped), values)


def impute_categories(df: DataFrame, limit: float = 0.3, p: dict[str, ColumnProfile] | None = None) -> DataFrame:
    dropped, values, _ = plan_categories(df, p or profile(df, distinct=False, moments=False), limit)
    return fill(df.drop(*dropped), values)


def apply_ranges(df: DataFrame, ranges: dict | None = None, macros: list[str] | None = None,
                 cap: float = 100.0) -> DataFrame:
    """Rescale macro nutrients whose sum is above ``cap``, then clip every column to its range."""
    ranges, macros = ranges or VALID_RANGES, macros or MACROS
    current = {c: quoted(c) for c in df.columns}
    if all(m in df.columns for m in macros):
        current.update(rescaled_to_cap({m: quoted(m) for m in macros}, cap))
    for c, (low, high) in ranges.items():
        if c in current:
            current[c] = clip(current[c], low, high)
    return df.select(*[current[c].alias(c) for c in df.columns])


def clip_negative(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[clip(quoted(c), lower=0.0).alias(c) if c in cols else quoted(c) for c in df.columns])


def per_serving_to_100g(df: DataFrame, quantity: str = "serving_quantity") -> DataFrame:
    """Fill gaps of ``*_100g`` from ``*_serving`` and the serving quantity."""
    pairs = {c.replace("_serving", "_100g"): c for c in df.columns if "_serving" in c}
    pairs = {base: c for base, c in pairs.items() if base in df.columns and base != c}
    if quantity not in df.columns:
        return df
    return df.select(*[
        F.coalesce(quoted(c), ratio(quoted(pairs[c]) * 100, quoted(quantity))).alias(c) if c in pairs else quoted(c)
        for c in df.columns])


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = 1.5, at_most: int | None = None,
               ) -> dict[str, tuple[float, float]]:
    return {c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
            for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75], at_most=at_most).items() if q1 is not None}


def iqr_filter(df: DataFrame, cols: list[str], factor: float = 1.5, mode: str = "sequential") -> DataFrame:
    """Drop rows outside the IQR fences; rows with NULL in a column drop out.

    ``sequential`` takes each column's fences from the rows that survived the columns before it, which
    costs one scan per column of a table that should be materialised first. ``simultaneous`` takes
    all fences from the input in one scan.
    """
    if mode == "simultaneous":
        bounds = iqr_bounds(df, cols, factor)
        for c in cols:
            df = df.where(quoted(c).between(*bounds[c])) if c in bounds else df.where(F.lit(False))
        return df
    rows = df.count()
    for c in cols:
        bounds = iqr_bounds(df, [c], factor, rows)
        df = df.where(quoted(c).between(*bounds[c])) if c in bounds else df.where(F.lit(False))
    return df


def handle_duplicates(df: DataFrame, strategy: str = "analyze", id_col: str | None = None,
                      key_cols: list[str] | None = None) -> DataFrame:
    """``analyze``, ``remove_all``, ``keep_first``, ``keep_last`` or ``aggregate``.

    First and last are meant in the order of ``id_col``, which does not take part in the comparison.
    All strategies are plain aggregations, so a row with very many copies is reduced before the
    shuffle.
    """
    if strategy == "analyze":
        return duplicate_report(df)
    if strategy == "remove_all":
        return df.dropDuplicates()
    if strategy in ("keep_first", "keep_last"):
        if id_col is None:
            return df.dropDuplicates()
        pick = F.min if strategy == "keep_first" else F.max
        keys = [c for c in df.columns if c != id_col]
        return df.groupBy(*[quoted(c) for c in keys]).agg(pick(quoted(id_col)).alias(id_col)).select(
            *[quoted(c) for c in df.columns])
    if strategy == "aggregate":
        if not key_cols:
            raise ValueError("aggregate needs key_cols")
        return aggregate_duplicates(df, key_cols)
    raise ValueError(f"unknown strategy {strategy}")


def aggregate_duplicates(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per key: mean of numeric columns, most frequent value (smallest on ties) of the others."""
    numbers = [c for c in numeric_columns(df) if c not in key_cols]
    others = [c for c in df.columns if c not in numbers and c not in key_cols]
    keys = [quoted(k) for k in key_cols]
    out = df.groupBy(*keys).agg(*[F.avg(quoted(c)).alias(c) for c in numbers], F.count(F.lit(1)).alias("_n"))
    for c in others:
        counted = df.where(quoted(c).isNotNull()).groupBy(*keys, quoted(c).alias("_v")).agg(
            F.count(F.lit(1)).alias("_k"))
        best = counted.groupBy(*key_cols).agg(
            F.min(F.struct((-F.col("_k")).alias("k"), F.col("_v").alias("v"))).alias("_b"))
        best = best.select(*key_cols, F.col("_b.v").alias(c))
        right = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)], quoted(c))
        same = [quoted(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key_cols)]
        on = same[0]
        for s in same[1:]:
            on = on & s
        out = out.join(right, on, "left").drop(*[f"_k{i}" for i in range(len(key_cols))])
    return out.select(*[quoted(c) for c in df.columns])


def duplicate_report(df: DataFrame) -> DataFrame:
    """(scope, duplicates): whole rows, all copies of repeated rows, and repeats within each column."""
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    whole = groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("copies"))
    rows = whole.select(F.inline(F.array(
        F.struct(F.lit("full_row").alias("scope"), F.col("extra").alias("duplicates")),
        F.struct(F.lit("all_copies").alias("scope"), F.col("copies").alias("duplicates")))))
    # a missing cell counts as one more value
    per_column = profile_table(df, moments=False).select(
        F.concat(F.lit("column:"), F.col("column")).alias("scope"),
        (F.col("rows") - F.col("distinct") - F.when(F.col("nulls") > 0, 1).otherwise(0)).alias("duplicates"))
    return rows.unionByName(per_column)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, each with its number of copies."""
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
