"""One aggregation that profiles all columns. Most reports and column choices read from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tablemill.functions.numbers import is_numeric, is_text, quoted

# Bytes per value of the fixed-width types.
TYPE_WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1,
               "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def _kind(field: T.StructField) -> str:
    return "numeric" if is_numeric(field) else "text" if is_text(field) else "other"


def _exact_type(field: T.StructField) -> str:
    """A type that keeps different values of the field different."""
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(field.dataType, T.DecimalType):
        return field.dataType.simpleString()
    return "double" if is_numeric(field) else "string"


def distinct_counts(df: DataFrame) -> DataFrame:
    """(position, distinct) per column.

    Values are unpivoted by exact type and grouped by (column, value), with duplicates removed before
    the shuffle. This spreads the work evenly and avoids the wide Expand of many ``count(DISTINCT ..)``.
    Columns share a scan only if one type holds the values of all of them without loss.
    """
    families: dict[str, list[tuple[int, T.StructField]]] = {}
    for i, f in enumerate(df.schema):
        if not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            families.setdefault(_exact_type(f), []).append((i, f))
    parts = []
    for cast, fields in families.items():
        pairs = F.array(*[F.struct(F.lit(i).alias("position"), quoted(f.name).cast(cast).alias("value"))
                          for i, f in fields])
        long = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
        parts.append(long.groupBy("position", "value").agg(F.lit(1).alias("_one"))
                     .groupBy("position").agg(F.count(F.lit(1)).alias("distinct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_table(df: DataFrame, approx: bool = False, distinct: bool = True, moments: bool = True) -> DataFrame:
    """(column, position, dtype, kind, rows, nulls, distinct, min, max, mean, var, sd, fractional, bytes).

    One ``agg`` for everything but the exact distinct counts; ``approx`` puts sketches into that same
    ``agg`` and drops the shuffle of values. Without ``moments`` only counts are taken.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema):
        c = quoted(field.name)
        aggs.append(F.count(c).alias(f"c{i}"))
        if distinct and approx and not isinstance(field.dataType, (T.ArrayType, T.MapType)):
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
        if moments and is_numeric(field):
            d = c.cast("double")
            aggs += [F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.avg(d).alias(f"m{i}"),
                     F.var_samp(d).alias(f"v{i}"), F.count_if(d != F.floor(d)).alias(f"f{i}")]
        if moments and is_text(field):
            aggs.append(F.sum(F.octet_length(c)).alias(f"b{i}"))
    wide = df.agg(*aggs)
    present = set(wide.columns)

    def pick(name: str, kind: str):
        return (F.col(name) if name in present else F.lit(None)).cast(kind)

    structs = []
    for i, field in enumerate(df.schema):
        width = TYPE_WIDTHS.get(field.dataType.simpleString(), 8)
        size = F.coalesce(pick(f"b{i}", "long"), F.lit(0)) if is_text(field) else F.col(f"c{i}") * width
        structs.append(F.struct(
            F.lit(field.name).alias("column"),
            F.lit(i).alias("position"),
            F.lit(field.dataType.simpleString()).alias("dtype"),
            F.lit(_kind(field)).alias("kind"),
            F.col("rows"),
            (F.col("rows") - F.col(f"c{i}")).alias("nulls"),
            pick(f"d{i}", "long").alias("distinct"),
            pick(f"lo{i}", "double").alias("min"),
            pick(f"hi{i}", "double").alias("max"),
            pick(f"m{i}", "double").alias("mean"),
            pick(f"v{i}", "double").alias("var"),
            F.sqrt(pick(f"v{i}", "double")).alias("sd"),
            pick(f"f{i}", "long").alias("fractional"),
            size.cast("long").alias("bytes"),
        ))
    out = wide.select(F.inline(F.array(*structs)))
    if not distinct or approx:
        return out
    # both sides have one row per column
    exact = out.drop("distinct").join(F.broadcast(distinct_counts(df)), "position", "left")
    return exact.withColumn("distinct", F.coalesce("distinct", F.lit(0))).select(*out.columns)


@dataclass(frozen=True)
class ColumnProfile:
    column: str
    position: int
    dtype: str
    kind: str
    rows: int
    nulls: int
    distinct: int | None
    min: float | None
    max: float | None
    mean: float | None
    var: float | None
    sd: float | None
    fractional: int | None
    bytes: int

    @property
    def null_ratio(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    @property
    def distinct_ratio(self) -> float:
        return (self.distinct or 0) / self.rows if self.rows else 0.0


def profile(df: DataFrame, approx: bool = False, distinct: bool = True, moments: bool = True,
            ) -> dict[str, ColumnProfile]:
    """The same numbers on the driver, one record per column."""
    rows = profile_table(df, approx, distinct, moments).orderBy("position").collect()
    return {r["column"]: ColumnProfile(**r.asDict()) for r in rows}
