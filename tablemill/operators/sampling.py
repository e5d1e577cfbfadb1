"""Seeded samples: simple, stratified and representative. The same seed gives the same rows on any
cluster, because rows are ordered by an md5 of seed and id, never by their position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.functions.names import excluded_from_sampling
from tablemill.functions.numbers import numeric_columns, quoted, text_columns
from tablemill.functions.text import stratum_key
from tablemill.operators.profile import profile
from tablemill.operators.ranks import quantiles, running_total, smallest_by_hash, value_counts
from tablemill.operators.reports import value_shares
from tablemill.session import materialised


def order_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), quoted(id_col).cast("string")))


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all): those with the smallest hash."""
    want = df.sparkSession.createDataFrame([(int(n),)], "_quota long")
    hashed = df.withColumn("_h", order_hash(id_col, seed))
    return smallest_by_hash(hashed, [], "_h", want, "_quota").select(*[quoted(c) for c in df.columns])


def sample_bernoulli(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """One-pass seeded coin flips with expectation ``n``; a table of at most ``n`` rows is returned whole."""
    total = df.count()
    return df if total <= n else df.sample(fraction=n / total, seed=seed)


def column_scores(df: DataFrame) -> DataFrame:
    """(column, kind, score, sd, null_ratio, distinct): suitability of columns for a stratified sample.

    Categorical: entropy over its maximum. Numeric: completeness, distinctness, relative spread and the
    share of values within three sd. Columns that are excluded, too empty or too varied are left out.
    """
    p = profile(df)
    names = [c for c in p.values() if not excluded_from_sampling(c.column) and 1 - c.null_ratio >= 0.3]
    text = [c.column for c in names if c.kind == "text" and 2 <= (c.distinct or 0) <= 50]
    numeric = [c for c in names if c.kind == "numeric"]
    rows: list[tuple] = []
    if text:
        shares = value_shares(df, text).groupBy("column").agg(
            (-F.sum(F.col("share") * F.ln("share")) / F.ln(F.count(F.lit(1)))).alias("score"))
        rows += [(r["column"], "text", r["score"], None, p[r["column"]].null_ratio, p[r["column"]].distinct)
                 for r in shares.collect()]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.abs((quoted(c.column) - c.mean) / c.sd) > 3).alias(f"z{i}")
        for i, c in enumerate(numeric) if c.sd]).first()
    for i, c in enumerate(numeric):
        score = 0.0
        if c.sd:
            spread = min(1.0, c.sd / c.mean) if c.mean else 0.0
            score = (0.3 * (1 - c.null_ratio) + 0.2 * min(1.0, c.distinct / (c.rows * 0.1)) + 0.3 * spread
                     + 0.2 * (1 - wide[f"z{i}"] / wide["n"]))
        rows.append((c.column, "numeric", score, c.sd, c.null_ratio, c.distinct))
    return df.sparkSession.createDataFrame(
        rows, "column string, kind string, score double, sd double, null_ratio double, distinct long")


def select_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Best three categorical (score > 0.3) and best five numeric (score > 0.5) columns."""
    rows = column_scores(df).collect()
    best = lambda kind, floor, k: [r["column"] for r in sorted(
        (r for r in rows if r["kind"] == kind and (r["score"] or 0) > floor),
        key=lambda r: (-round(r["score"], 9), r["column"]))][:k]
    return best("text", 0.3, 3), best("numeric", 0.5, 5)


def quantile_bins(df: DataFrame, col: str, q: int) -> Column:
    """Number of the quantile bin (0-based, right-closed), repeated edges dropped; NULL takes the median."""
    median, *edges = quantiles(df, [col], [0.5] + [i / q for i in range(q + 1)])[col]
    edges = sorted(set(edges))
    value = F.coalesce(quoted(col), F.lit(median))
    out = F.lit(0)
    for edge in edges[1:-1]:
        out = out + (value > edge).cast("int")
    return out


def strata(df: DataFrame, text: list[str], numeric: list[str]) -> Column:
    """Stratum of every row. Without a categorical column, bins of the best numeric one."""
    if text:
        return stratum_key([quoted(c) for c in text])
    c = numeric[0]
    distinct = profile(df.select(quoted(c)))[c].distinct
    return F.concat(F.lit("Q"), (quantile_bins(df, c, min(5, distinct)) + 1).cast("string"))


def stratum_quotas(counts: DataFrame, target: int) -> DataFrame:
    """Rows to draw per stratum: its share of ``target``, at least one, scaled down once if they add up
    to more."""
    total = counts.agg(F.sum("n")).first()[0]
    first = counts.withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(target) * (F.col("n") / F.lit(total)))))
    allocated = first.agg(F.sum("quota")).first()[0]
    if allocated > target:
        first = first.withColumn("quota", F.greatest(F.lit(1), F.floor(F.col("quota") * F.lit(target / allocated))))
    return first.withColumn("quota", F.col("quota").cast("long"))


def stratified_sample(df: DataFrame, id_col: str, stratum: Column, target: int, seed: int = 42) -> DataFrame:
    keyed = df.withColumn("_stratum", stratum).withColumn("_h", order_hash(id_col, seed))
    quotas = stratum_quotas(keyed.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")), target)
    drawn = smallest_by_hash(keyed, ["_stratum"], "_h", quotas.select("_stratum", F.col("quota").alias("_quota")),
                             "_quota")
    size = quotas.agg(F.sum(F.least("n", "quota"))).first()[0]
    out = drawn.select(*[quoted(c) for c in df.columns])
    return sample_exact(out, id_col, target, seed) if size > target else out


def smart_sample(df: DataFrame, id_col: str, target: int | None = None, seed: int = 42) -> DataFrame:
    """Stratified sample on automatically chosen columns (a quarter of the rows by default)."""
    target = df.count() // 4 if target is None else target
    text, numeric = select_columns(df.drop(id_col))
    if not text and not numeric:
        return sample_exact(df, id_col, target, seed)
    return stratified_sample(df, id_col, strata(df, text, numeric), target, seed)


def boosted_quotas(df: DataFrame, col: str, target: int, balance: bool = True, min_size: int = 100) -> DataFrame:
    """(value, n, quota) of one column; rare values are lifted to a minimum share."""
    total = df.count()
    counts = value_counts(df, [col]).select("value", "n")
    share = F.col("n") / F.lit(float(total))
    if balance:
        floor = max(min_size / total, 1 / max(1, counts.count()))
        share = F.greatest(share, F.lit(floor))
        whole = counts.agg(F.sum(share)).first()[0]
        share = share / F.lit(whole)
    return counts.withColumn("quota", F.rint(share * target).cast("long"))


def representative_sample(df: DataFrame, id_col: str, size: float = 0.3, stratify: list[str] | None = None,
                          numeric: list[str] | None = None, balance: bool = True, min_size: int = 100,
                          seed: int = 42, n_clusters: int = 100) -> DataFrame:
    """Category quotas column by column, then rows near the centres of numeric clusters.

    Later columns only draw rows not drawn yet (anti join on the id). The union is cut to the target by
    hash. If rows are missing, ``n_clusters`` clusters share them by size, nearest first.
    """
    total = df.count()
    target = int(total * size) if 0 < size < 1 else int(size)
    stratify = [c for c in text_columns(df) if c != id_col] if stratify is None else stratify
    drawn = None
    for c in stratify:
        rest = df if drawn is None else df.join(drawn, id_col, "left_anti")
        quotas = boosted_quotas(df, c, target, balance, min_size).select(
            F.col("value").alias("_v"), F.col("quota").alias("_quota")).where("_quota > 0")
        keyed = rest.select(quoted(id_col), quoted(c).cast("string").alias("_v"),
                            order_hash(id_col, seed).alias("_h")).where(F.col("_v").isNotNull())
        picked = smallest_by_hash(keyed, ["_v"], "_h", quotas, "_quota").select(quoted(id_col))
        drawn = materialised(picked if drawn is None else drawn.unionByName(picked), "drawn")
    got = drawn.count() if drawn is not None else 0
    if got > target:
        drawn, got = sample_exact(drawn, id_col, target, seed), target
    numeric = numeric_columns(df) if numeric is None else numeric
    if numeric and got < target:
        extra = nearest_to_centres(df, id_col, numeric, drawn, target - got, seed, n_clusters)
        drawn = extra if drawn is None else drawn.unionByName(extra)
    return df.join(drawn, id_col, "left_semi")


def nearest_to_centres(df: DataFrame, id_col: str, cols: list[str], taken: DataFrame | None, want: int,
                       seed: int = 42, n_clusters: int = 100) -> DataFrame:
    """Ids of ``want`` rows not in ``taken``, nearest to the centres of ``n_clusters`` clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tablemill.operators.scale import apply_scaler, fit_standard

    means = df.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    filled = df.select(quoted(id_col), *[F.coalesce(quoted(c).cast("double"), F.lit(means[f"m{i}"] or 0.0)).alias(c)
                                         for i, c in enumerate(cols)])
    scaled = materialised(apply_scaler(filled, fit_standard(filled, cols)), "scaled")
    vectors = VectorAssembler(inputCols=cols, outputCol="features").transform(scaled)
    model = KMeans(k=n_clusters, seed=seed, predictionCol="cluster").fit(vectors)
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    table = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres])
    point = vector_to_array("features")
    centre = F.element_at(table, F.col("cluster") + 1)
    distance = F.aggregate(F.zip_with(point, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    scored = model.transform(vectors).select(quoted(id_col), "cluster", distance.alias("distance"))
    if taken is not None:
        scored = scored.join(taken, id_col, "left_anti")
    scored = materialised(scored.withColumn("one", F.lit(1).cast("long")), "scored")
    sizes = {r["cluster"]: r["n"] for r in scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    available = sum(sizes.values())
    want = min(want, available)
    quotas = {c: n * want // available for c, n in sizes.items()} if available else {}
    for c in sorted(sizes, key=lambda c: (-(sizes[c] * want % available), c))[: want - sum(quotas.values())]:
        quotas[c] += 1
    table = df.sparkSession.createDataFrame([(c, q) for c, q in quotas.items()], "cluster int, quota long")
    placed = running_total(scored, ["cluster"], ["distance", id_col], "one", "place")
    # one row per cluster
    return placed.join(F.broadcast(table), "cluster").where("place < quota").select(quoted(id_col))
