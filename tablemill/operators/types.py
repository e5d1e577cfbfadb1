"""Type narrowing and the detection of ordered categories."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from tablemill.functions.numbers import quoted, text_columns
from tablemill.operators.columns import crowded_columns, flat_columns
from tablemill.operators.joins import small_side
from tablemill.operators.profile import ColumnProfile, profile
from tablemill.operators.ranks import running_total, value_counts

# Name parts that mark an ordered category.
ORDINAL_NAME_PARTS = ["_level", "_grade", "_score", "_rating", "grade_", "level_", "score_"]

# Vocabularies of ordered categories.
ORDERED_VOCABULARIES = [
    ["A+", "A", "B+", "B", "C+", "C", "D+", "D", "E+", "E"],
    ["excellent", "good", "average", "poor", "bad"],
    ["high", "medium", "low"],
    ["1st", "2nd", "3rd", "4th", "5th"],
    ["beginner", "intermediate", "advanced", "expert"],
]

# Further vocabularies of the extended test.
EXTENDED_VOCABULARIES = [
    ["très faible", "faible", "moyen", "élevé", "très élevé"],
    ["débutant", "intermédiaire", "avancé", "expert"],
    ["jamais", "parfois", "souvent", "toujours"],
    ["nul", "passable", "assez bien", "bien", "très bien", "excellent"],
    ["pas du tout d'accord", "pas d'accord", "neutre", "d'accord", "tout à fait d'accord"],
]

# Vocabularies with a natural order, lowest first.
NATURAL_ORDERS = [
    ["débutant", "intermédiaire", "avancé", "expert"],
    ["pas du tout d'accord", "pas d'accord", "neutre", "d'accord", "tout à fait d'accord"],
    ["mauvais", "passable", "moyen", "bon", "excellent"],
    ["jamais", "rarement", "parfois", "souvent", "toujours"],
    ["très faible", "faible", "moyen", "fort", "très fort"],
]

FLOAT_MAX = 3.4028234663852886e38


def narrowest_type(low: float | None, high: float | None, has_decimals: bool) -> str:
    """Smallest Spark type that holds the range. Spark has signed types only, so an unsigned byte
    becomes a smallint and so on."""
    if low is None or high is None or math.isinf(low) or math.isinf(high) or math.isnan(low):
        return "double"
    if has_decimals:
        return "float" if low >= -FLOAT_MAX and high <= FLOAT_MAX else "double"
    if low >= 0:
        for limit, name in ((255, "smallint"), (65535, "int"), (4294967295, "bigint")):
            if high <= limit:
                return name
        return "decimal(20,0)" if high >= 2.0**63 else "bigint"
    for bits, name in ((7, "tinyint"), (15, "smallint"), (31, "int")):
        if low >= -(2**bits) and high <= 2**bits - 1:
            return name
    return "bigint"


def narrowing(p: dict[str, ColumnProfile], with_gaps: bool = False) -> dict[str, tuple[str, str]]:
    """column -> (old, new) for numeric columns without gaps whose narrowest type differs."""
    out = {}
    for c in p.values():
        if c.kind == "numeric" and c.rows and (with_gaps or c.nulls == 0) and c.nulls < c.rows:
            new = narrowest_type(c.min, c.max, bool(c.fractional))
            if new != c.dtype:
                out[c.column] = (c.dtype, new)
    return out


def narrow_numeric(df: DataFrame, p: dict[str, ColumnProfile] | None = None, with_gaps: bool = False,
                   ) -> tuple[DataFrame, DataFrame]:
    """Narrowed table and its change log (column, old_type, new_type)."""
    changes = narrowing(p or profile(df, distinct=False), with_gaps)
    out = df.select(*[quoted(c).cast(changes[c][1]).alias(c) if c in changes else quoted(c) for c in df.columns])
    log = df.sparkSession.createDataFrame(
        [(c, old, new) for c, (old, new) in changes.items()], "column string, old_type string, new_type string")
    return out, log


def dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n, code) with codes in sorted order of the values, starting at 0."""
    counts = value_counts(df, cols).withColumn("_one", F.lit(1).cast("long"))
    return running_total(counts, ["column"], ["value"], "_one", "code").drop("_one")


def dictionary_savings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Estimated bytes of plain strings against codes plus dictionary, per text column."""
    cols = cols or text_columns(df)
    width = F.when(F.col("n_values") <= 255, 1).when(F.col("n_values") <= 65535, 2).otherwise(4)
    grouped = value_counts(df, cols).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_rows"),
        F.sum(F.col("n") * F.octet_length("value")).alias("plain_bytes"),
        F.sum(F.octet_length("value")).alias("value_bytes"))
    coded = F.col("value_bytes") + F.col("n_rows") * width
    return grouped.select(
        "column", "n_values", "plain_bytes", coded.alias("coded_bytes"),
        ((F.col("plain_bytes") - coded) / F.col("plain_bytes") * 100).alias("savings_pct"))


def _name_says_ordinal(column: str) -> bool:
    return any(part in column.lower() for part in ORDINAL_NAME_PARTS)


def ordinal_report(df: DataFrame, cols: list[str] | None = None, extended: bool = False,
                   compat: bool = False) -> DataFrame:
    """(column, is_ordinal) from the column name and the distinct values.

    A vocabulary matches when every value is one of its words; ``compat`` accepts values that merely
    contain one, and counts missing cells as the text ``nan``. ``extended`` also accepts strictly
    increasing numbers, dates and more vocabularies.
    """
    cols = cols or text_columns(df)
    counts = value_counts(df, cols, keep_null=True)
    v = F.lower(F.col("value"))
    if compat:
        v = F.coalesce(v, F.lit("nan"))

    def all_of(vocabulary):
        words = [w.lower() for w in vocabulary]
        if compat:
            hit = F.lit(False)
            for w in words:
                hit = hit | v.contains(w)
        else:
            hit = v.isin(words)
        return F.coalesce(F.bool_and(hit), F.lit(False))

    plain = F.replace(F.col("value"), F.lit("."), F.lit(""))
    tests = [F.coalesce(F.bool_and(plain.rlike("^[0-9]+$")), F.lit(True))]
    tests += [all_of(w) for w in ORDERED_VOCABULARIES]
    if extended:
        number = F.col("value").try_cast("double")
        parsed = F.count(number)
        increasing = (parsed > 0) & (F.max(F.when(number.isNotNull(), F.col("n"))) == 1) \
            & (F.count_distinct(number) == parsed)
        dates = F.bool_and(F.col("value").isNull() | F.try_to_timestamp(F.col("value")).isNotNull())
        tests += [F.coalesce(increasing, F.lit(False)), F.coalesce(dates, F.lit(False))]
        tests += [all_of(w) for w in EXTENDED_VOCABULARIES]
    verdict = tests[0]
    for t in tests[1:]:
        verdict = verdict | t
    named = [c for c in cols if _name_says_ordinal(c)]
    return counts.groupBy("column").agg(verdict.alias("_by_value")).select(
        "column", (F.col("column").isin(named) | F.col("_by_value")).alias("is_ordinal"))


def natural_order(df: DataFrame, col: str) -> DataFrame:
    """(value, position) of the distinct values: by number, else by date, else by a known vocabulary,
    else alphabetically."""
    values = value_counts(df, [col]).select("value")
    number, stamp = F.col("value").try_cast("double"), F.try_to_timestamp(F.col("value"))
    lowered = F.lower("value")
    checks = values.agg(
        F.bool_and(number.isNotNull()).alias("numbers"),
        F.bool_and(stamp.isNotNull()).alias("dates"),
        *[F.bool_and(lowered.isin(words)).alias(f"w{i}") for i, words in enumerate(NATURAL_ORDERS)],
    ).first()
    if checks["numbers"]:
        key = number
    elif checks["dates"]:
        key = F.unix_micros(stamp.cast("timestamp"))
    else:
        words = next((w for i, w in enumerate(NATURAL_ORDERS) if checks[f"w{i}"]), None)
        key = (F.array_position(F.array(*[F.lit(w) for w in words]), lowered) if words else F.lit(0))
    keyed = values.select("value", key.alias("_key"), F.lit(1).cast("long").alias("_one"))
    return running_total(keyed, [], ["_key", "value"], "_one", "position").select("value", "position")


def split_categories(df: DataFrame, max_categories: int, detect: bool = True,
                     ordinal_columns: list[str] | None = None,
                     p: dict[str, ColumnProfile] | None = None) -> DataFrame:
    """(column, role) with role ordinal, nominal or too_many_categories for every text column."""
    p = p or profile(df)
    dropped = crowded_columns(p, max_categories)
    valid = [c.column for c in p.values() if c.kind == "text" and c.column not in dropped]
    ordinal = set(ordinal_columns or [])
    if ordinal_columns is None and detect and valid:
        ordinal = {r["column"] for r in ordinal_report(df, valid).where("is_ordinal").collect()}
    rows = [(c, "ordinal" if c in ordinal else "nominal") for c in valid]
    rows += [(c, "too_many_categories") for c in dropped]
    return df.sparkSession.createDataFrame(rows, "column string, role string")


def process_numeric(df: DataFrame, min_unique_ratio: float = 0.01,
                    p: dict[str, ColumnProfile] | None = None) -> tuple[DataFrame, list[tuple]]:
    """Drop nearly constant numeric columns, narrow the rest; log of (column, action, detail)."""
    p = p or profile(df)
    flat = flat_columns(p, min_unique_ratio)
    rest = {k: v for k, v in p.items() if k not in flat}
    changes = narrowing(rest)
    out = df.select(*[quoted(c).cast(changes[c][1]).alias(c) if c in changes else quoted(c)
                      for c in df.columns if c not in flat])
    log = [(c, "dropped", "low_variance") for c in flat]
    log += [(c, "narrowed", f"{a}->{b}") for c, (a, b) in changes.items()]
    return out, log
