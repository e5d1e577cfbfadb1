"""Numeric column expressions. All of them are NULL-safe and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Cell texts that mean "missing".
NULL_TOKENS = ["", "NA", "N/A", "nan", "NaN", "None", "<NA>", "undefined", "?"]

# Unit conversion factors, in the order in which they apply.
UNIT_FACTORS = [("oz", 28.35, "g"), ("lb", 453.592, "g"), ("tbsp", 15.0, "ml")]


def quoted(name: str) -> Column:
    """Column reference that survives names such as ``energy-kcal_100g``."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f)]


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), c)


def normalise_missing(df: DataFrame) -> DataFrame:
    """One projection that leaves NULL as the only missing marker of the table."""
    return df.select(
        *[
            finite(quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else quoted(f.name)
            for f in df.schema
        ]
    )


def parse_dirty_number(c: Column) -> Column:
    """Free text to double, NULL when it does not parse."""
    text = c.cast("string")
    body = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^0-9.\-]+", "")
    return F.when(~text.isin(NULL_TOKENS), body.try_cast("double"))


def clip(c: Column, lower=None, upper=None) -> Column:
    """Clip that leaves NULL alone (``greatest``/``least`` on their own skip NULL)."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower) if not isinstance(lower, Column) else lower)
    if upper is not None:
        out = F.least(out, F.lit(upper) if not isinstance(upper, Column) else upper)
    return F.when(c.isNotNull(), out)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def right_closed_bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (edges[i], edges[i+1]] that holds the value, else NULL."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        inside = c > F.lit(float(low))
        if high != float("inf"):
            inside = inside & (c <= F.lit(float(high)))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def rescaled_to_cap(cols: dict[str, Column], cap: float = 100.0) -> dict[str, Column]:
    """Shrink several columns in proportion so that their sum is at most ``cap``."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols.values()), F.lit(0.0))
    return {name: F.when(total > cap, c / total * cap).otherwise(c) for name, c in cols.items()}


def quantity_and_unit(c: Column) -> tuple[Column, Column]:
    """Leading quantity and lower-cased unit of a text such as ``1.5 oz``."""
    pattern = r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+)"
    qty = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("double")
    unit = F.lower(F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")))
    return qty, unit


def standard_quantity(qty: Column, unit: Column) -> tuple[Column, Column]:
    """Ounces and pounds to grams, table spoons to millilitres."""
    out_qty, out_unit = qty, unit
    for token, factor, target in UNIT_FACTORS:
        hit = F.lower(unit).contains(token)
        out_qty = F.when(hit, out_qty * factor).otherwise(out_qty)
        out_unit = F.when(hit, F.lit(target)).otherwise(out_unit)
    return out_qty, out_unit


def ean13_valid(c: Column) -> Column:
    """Check digit test of a 13 digit product code; anything else is false."""
    weighted = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)),
        F.lit(0),
        lambda acc, i: acc
        + F.substring(c, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, F.lit(3)).otherwise(F.lit(1)),
    )
    check = (F.lit(10) - weighted % 10) % 10
    shaped = F.coalesce(c.rlike("^[0-9]{13}$"), F.lit(False))
    return F.when(shaped, check == F.substring(c, 13, 1).try_cast("int")).otherwise(F.lit(False))


def grouped_digits(c: Column) -> Column:
    return F.format_number(c, 0)
