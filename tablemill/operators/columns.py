"""Column and row selection. Thresholds are tested on one profile, the result is one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemill.functions.names import (excluded_from_encoding, nutrition_columns, priority_order,
                                       redundant_columns)
from tablemill.functions.numbers import finite, is_numeric, parse_dirty_number, quoted
from tablemill.operators.profile import ColumnProfile, profile
from tablemill.operators.ranks import quantiles
from tablemill.session import materialised

Profile = dict[str, ColumnProfile]


def keep(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in names])


def sparse_columns(p: Profile, threshold: float) -> list[str]:
    return [c.column for c in p.values() if c.null_ratio > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.3, p: Profile | None = None) -> DataFrame:
    p = p or profile(df, distinct=False, moments=False)
    return df.drop(*sparse_columns(p, threshold))


def drop_redundant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*redundant_columns(df.columns))


def crowded_columns(p: Profile, max_categories: int) -> list[str]:
    return [c.column for c in p.values() if c.kind == "text" and (c.distinct or 0) > max_categories]


def flat_columns(p: Profile, min_unique_ratio: float) -> list[str]:
    return [c.column for c in p.values()
            if c.kind == "numeric" and c.rows and c.distinct_ratio < min_unique_ratio]


def drop_crowded_columns(df: DataFrame, max_categories: int = 30, p: Profile | None = None) -> DataFrame:
    return df.drop(*crowded_columns(p or profile(df, moments=False), max_categories))


def drop_flat_columns(df: DataFrame, min_unique_ratio: float = 0.01, p: Profile | None = None) -> DataFrame:
    return df.drop(*flat_columns(p or profile(df, moments=False), min_unique_ratio))


def select_kind(df: DataFrame, numeric: bool) -> DataFrame:
    return keep(df, [f.name for f in df.schema if is_numeric(f) == numeric])


def select_nutrition(df: DataFrame) -> DataFrame:
    return keep(df, nutrition_columns(df.columns))


def priority_first(df: DataFrame) -> DataFrame:
    return keep(df, priority_order(df.columns))


def null_share_of_row(columns: list[str]):
    missing = sum((quoted(c).isNull().cast("int") for c in columns), F.lit(0))
    return missing / F.lit(float(len(columns)))


def drop_sparse_rows(df: DataFrame, threshold: float = 0.3, columns: list[str] | None = None) -> DataFrame:
    return df.where(null_share_of_row(columns or df.columns) <= threshold)


def drop_incomplete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def worth_encoding(p: Profile, max_distinct_ratio: float = 0.9) -> list[str]:
    return [c.column for c in p.values()
            if c.kind == "text" and not excluded_from_encoding(c.column)
            and not (c.distinct or 0) > max_distinct_ratio * c.rows]


def to_numeric_table(df: DataFrame, min_valid_ratio: float = 0.05, id_cols: list[str] | None = None,
                     ) -> tuple[DataFrame, dict[str, float]]:
    """Turn a mixed table into an all-numeric one without gaps.

    Text columns are parsed as dirty numbers and kept if enough cells parse. Columns with no value at
    all count as numeric. Infinities and gaps become the column median, or 0 if there is none. Every
    cell is parsed once, into a work table from which the valid shares, the medians and the result are
    read. ``id_cols`` pass through untouched.
    """
    id_cols = id_cols or []
    order = [c for c in priority_order(df.columns) if c not in id_cols]
    types = {f.name: f for f in df.schema}
    parsed = {c: quoted(c).cast("double") if is_numeric(types[c]) else parse_dirty_number(quoted(c)) for c in order}
    text = [c for c in order if not is_numeric(types[c])]
    # by position, since the names of the table may clash with any other name
    table = materialised(df.select(
        *[quoted(c).alias(f"id{i}") for i, c in enumerate(id_cols)], *[parsed[c].alias(f"p{i}") for i, c in enumerate(order)],
        *[quoted(c).isNotNull().alias(f"given{i}") for i, c in enumerate(text)]), "parsed")
    place = {c: F.col(f"p{i}") for i, c in enumerate(order)}
    stats = table.agg(F.count(F.lit(1)).alias("n"), *[
        x for i, c in enumerate(text)
        for x in (F.count(place[c]).alias(f"v{i}"), F.count_if(f"given{i}").alias(f"c{i}"))]).first()
    rows = stats["n"]
    kept = [c for c in order if c not in text
            or stats[f"c{text.index(c)}"] == 0
            or stats[f"v{text.index(c)}"] > min_valid_ratio * rows]
    if not kept:
        raise ValueError("no numeric column found")
    numbers = table.select(*[F.col(f"id{i}").alias(c) for i, c in enumerate(id_cols)], *[finite(place[c]).alias(c) for c in kept])
    medians = {c: q[0] for c, q in quantiles(numbers, kept, [0.5]).items()}
    fill = {c: float(medians[c] or 0.0) for c in kept}
    return numbers.select(
        *[quoted(c) for c in id_cols],
        *[F.coalesce(quoted(c), F.lit(fill[c])).alias(c) for c in kept]), fill
