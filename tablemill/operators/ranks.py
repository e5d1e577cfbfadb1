"""Running totals, global ranks and exact quantiles that never need one task to hold a group.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, and a window without
``partitionBy`` sorts a whole table in one task. Both are used here only for groups whose size was
counted first. Larger groups take the bucketed way, which gives the same answer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.functions.numbers import quoted
from tablemill.operators.joins import small_side
from tablemill.session import checkpointed

ROWS_PER_BUCKET = 1_000_000
EXACT_GROUP_ROWS = 2_000_000
#: One in so many rows may lie between a sketch's guess and the place meant. The sketches of all tasks of a column are merged in
#: one task, so they are kept small; the values of the band around a guess are counted over all tasks.
SKETCH_ACCURACY = 10_000


def range_buckets(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Split into ``n`` sorted ranges of ``keys`` and number them in ``_bucket``.

    The result is checkpointed, so bucket numbers stay the same when a lost task is run again.
    """
    ranged = df.repartitionByRange(n, *[quoted(k) for k in keys])
    return checkpointed(ranged.withColumn("_bucket", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    by: list[str],
    order: list[str],
    weight: str,
    out: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over earlier rows of the same ``by`` group.

    ``by`` + ``order`` must be unique. A small table uses one window per group. Otherwise the rows
    are range-split over (by, order): a window inside each split plus the totals of earlier splits,
    a table of groups x splits, give the same number, and a group that holds a third of all rows is
    spread over a third of the splits.
    """
    rows = df.count()
    buckets = max(1, math.ceil(rows / rows_per_bucket))
    earlier = lambda cols: Window.partitionBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    if buckets == 1:
        w = earlier([quoted(b) for b in by] or [F.lit(1)]).orderBy(*[quoted(o) for o in order])
        return df.withColumn(out, F.coalesce(F.sum(quoted(weight)).over(w), F.lit(0)))
    split = range_buckets(df, by + order, buckets)
    totals = split.groupBy(*by, "_bucket").agg(F.sum(quoted(weight)).alias("_sum"))
    w = earlier([quoted(b) for b in by] or [F.lit(1)]).orderBy("_bucket")
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset"))
    inner = earlier([quoted(b) for b in by] + [F.col("_bucket")]).orderBy(*[quoted(o) for o in order])
    inside = split.withColumn("_inside", F.coalesce(F.sum(quoted(weight)).over(inner), F.lit(0)))
    return (
        inside.join(offsets, by + ["_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_offset", "_inside")
    )


def global_rank(df: DataFrame, order: list[str], out: str = "rank",
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Zero-based position of every row in the order of ``order`` (which must be unique)."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), [], order, "_one", out,
                         rows_per_bucket).drop("_one")


def long_values(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """(by..., column, value) for the given numeric columns, NULLs left out."""
    pairs = [F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in cols]
    return (
        df.select(*[quoted(b) for b in by], F.explode(F.array(*pairs)).alias("_p"))
        .select(*[quoted(b) for b in by], "_p.column", "_p.value")
        .where(F.col("value").isNotNull())
    )


def _interpolated(low: Column, high: Column, q: float, n: Column) -> Column:
    pos = F.lit(q) * (n - 1)
    frac = pos - F.floor(pos)
    return low * (1 - frac) + high * frac


def quantile_table(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: list[str] | None = None,
    exact_rows: int = EXACT_GROUP_ROWS,
    accuracy: int = SKETCH_ACCURACY,
    at_most: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles as (by..., column, n, q) with ``q`` an array.

    Groups are counted first. If none is larger than ``exact_rows``, Spark's ``percentile`` does it in
    one aggregation. Otherwise a mergeable sketch brackets every wanted position within a narrow value
    band, a second scan counts the rows below each band and the distinct values inside it, and the
    answer is read off the band. The bracket is checked, not trusted. ``at_most`` is a known bound on
    the rows of a group and saves the count.
    """
    by = by or []
    keys = by + ["column"]
    largest = at_most
    if largest is None:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        largest = counts.agg(F.max("_n")).first()[0] or 0
    if largest <= exact_rows:
        array = F.array(*[F.lit(float(q)) for q in probs])
        aggs = []
        for i, c in enumerate(cols):
            d = quoted(c).cast("double")
            aggs += [F.percentile(d, array).alias(f"_q{i}"), F.count(d).alias(f"_n{i}")]
        wide = df.groupBy(*by).agg(*aggs)
        rows = F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_q{i}").alias("q"))
            for i, c in enumerate(cols)
        ])
        out = wide.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")
        return out.where(F.col("n") > 0)
    return _banded_quantiles(df, cols, probs, by, keys, accuracy)


def _banded_quantiles(df, cols, probs, by, keys, accuracy):
    values = long_values(df, by, cols)
    slack = 2.0 / accuracy
    marks = []
    for q in probs:
        marks += [max(0.0, q - slack), min(1.0, q + slack)]
    stats = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        F.percentile_approx("value", F.array(*[F.lit(m) for m in marks]), F.lit(accuracy)).alias("marks"),
    )
    probes = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("probe"),
            F.lit(float(q)).alias("p"),
            (F.col("lowest") if q <= slack else F.col("marks")[2 * i]).alias("lo"),
            (F.col("highest") if q >= 1 - slack else F.col("marks")[2 * i + 1]).alias("hi"),
        )
        for i, q in enumerate(probs)
    ]))
    bands = checkpointed(stats.select(*keys, "n", "lowest", "highest", probes.alias("_b")).select(
        *keys, "n", "lowest", "highest", "_b.*"))
    picked = checkpointed(_read_bands(values, bands, keys))
    missed = picked.where("low IS NULL OR high IS NULL").select(*keys, "probe")
    if missed.head(1):  # the sketch was off: these positions are looked for among all values
        wide = bands.join(missed, keys + ["probe"], "left_semi").withColumns({"lo": F.col("lowest"), "hi": F.col("highest")})
        found = picked.where("low IS NOT NULL AND high IS NOT NULL")
        picked = found.unionByName(_read_bands(values, checkpointed(wide), keys))
    pos = F.col("p") * (F.col("n") - 1)
    part = pos - F.floor(pos)
    return picked.withColumn("value", F.col("low") * (1 - part) + F.col("high") * part).groupBy(*keys, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("probe", "value"))), lambda s: s["value"]).alias("q"))


def _read_bands(values: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """The two values around each wanted position, NULL where they lie outside the band."""
    hit = values.join(small_side(bands, True), keys).where(F.col("value") <= F.col("hi"))
    # rows under the band collapse to one NULL-valued row, copies inside it to one weighted value
    inside = F.when(F.col("value") >= F.col("lo"), F.col("value"))
    grouped = hit.groupBy(*keys, "probe", "p", "n", inside.alias("v")).agg(F.count(F.lit(1)).alias("w"))
    grouped = checkpointed(grouped)  # read twice below, but the values only once
    placed = running_total(grouped, keys + ["probe"], ["v"], "w", "before")
    pos = F.col("p") * (F.col("n") - 1)
    covers = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("w"))
    return placed.groupBy(*keys, "probe", "p", "n").agg(
        F.max(F.when(covers(F.floor(pos)), F.col("v"))).alias("low"),
        F.max(F.when(covers(F.ceil(pos)), F.col("v"))).alias("high"),
    )


def quantiles(df: DataFrame, cols: list[str], probs: list[float], **kw) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver: columns x probs numbers, None for columns without values."""
    found = {r["column"]: list(r["q"]) for r in quantile_table(df, cols, probs, **kw).collect()}
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def value_counts(df: DataFrame, cols: list[str], keep_null: bool = False) -> DataFrame:
    """(column, value, n) over text columns. Partial counts are made before the shuffle."""
    pairs = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols]
    long = df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")
    if not keep_null:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties."""
    best = value_counts(df, cols).groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("m")
    )
    return {r["column"]: r["value"] for r in best.select("column", "m.value").collect()}


def smallest_by_hash(
    df: DataFrame,
    by: list[str],
    hash_col: str,
    quotas: DataFrame,
    quota_col: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Keep, per ``by`` group, the ``quota_col`` rows with the smallest md5 text in ``hash_col``.

    The first eight hex digits cut the hash range into equal buckets. Counts per (group, bucket) tell
    which buckets are kept whole and which single bucket is cut, so only the rows of that one bucket
    are sorted, even for a group that holds a third of the table.
    """
    total = df.count()
    n = max(1, math.ceil(total / rows_per_bucket))
    # a plain count of hash ranges; 2^32 / n per bucket
    bucket = F.floor(F.conv(F.substring(F.col(hash_col), 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(2**32))
    keyed = df.withColumn("_hb", bucket.cast("int"))
    sizes = keyed.groupBy(*by, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*([quoted(b) for b in by] or [F.lit(1)])).orderBy("_hb").rowsBetween(
        Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    joined = before.join(quotas, by) if by else before.withColumn(quota_col, F.lit(quotas.first()[quota_col]))
    # bucket that the quota runs out in, and how many of its rows are still wanted
    cuts = joined.where(F.col("_before") < F.col(quota_col)).groupBy(*by).agg(
        F.max("_hb").alias("_cut"),
        F.max_by(F.col(quota_col) - F.col("_before"), F.col("_hb")).alias("_want"),
    )
    if by:
        rows = keyed.join(small_side(cuts), by)
    else:
        cut = cuts.first()
        rows = keyed.withColumns({"_cut": F.lit(cut["_cut"]).cast("int"), "_want": F.lit(cut["_want"]).cast("long")})
    whole = rows.where(F.col("_hb") < F.col("_cut"))
    ranked = rows.where(F.col("_hb") == F.col("_cut")).withColumn(
        "_rn",
        F.row_number().over(
            Window.partitionBy(*([quoted(b) for b in by] or [F.lit(1)])).orderBy(
                F.col(hash_col), F.xxhash64(*[quoted(c) for c in df.columns]))),
    )
    part = ranked.where(F.col("_rn") <= F.col("_want")).drop("_rn")
    return whole.unionByName(part).drop("_hb", "_cut", "_want")
