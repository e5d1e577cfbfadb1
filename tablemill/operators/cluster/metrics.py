"""Cluster quality. Everything except the exact Euclidean silhouette is linear in the rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.operators.joins import small_side
from tablemill.session import checkpointed, materialised

BLOCK_ROWS = 2_000
#: Numbers in a block of the Euclidean silhouette at most (16 MB), blocks before they grow, and tasks at most.
BLOCK_VALUES, MIN_BLOCKS, MOST_TASKS = 2_000_000, 12, 2_000
#: Distances in a tile, near pairs taken at once, and the share of the squared norms below which a pair counts as near.
TILE, PAIRS, NEAR = 500_000, 50_000, 1e-6
KINDS = ("squared", "euclidean")
#: With up to so many columns, sums over coordinates are spelled out, which generated code takes much faster than loops over arrays;
#: with up to so many clusters as well, the silhouette is one expression.
SPELLED_OUT, FEW_CLUSTERS = 8, 16


def squared_distance(a: Column, b: Column, d: int | None = None) -> Column:
    """``d`` is the number of coordinates, where it is known."""
    if d is not None and d <= SPELLED_OUT:
        return sum(((a[i] - b[i]) * (a[i] - b[i]) for i in range(d)), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def point(cols: list[str]) -> Column:
    return F.array(*[quoted(c).cast("double") for c in cols])


def labelled(df: DataFrame, cols: list[str], cluster: str, include_noise: bool = True) -> DataFrame:
    out = df.select(point(cols).alias("p"), quoted(cluster).cast("long").alias("c"))
    return out if include_noise else out.where("c <> -1")


def moments(df: DataFrame, d: int) -> DataFrame:
    """(c, n, centre, q): count, centre and sum of squared norms per cluster."""
    return df.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("p")[i]) for i in range(d)]).alias("centre"),
        F.sum(_square(d)).alias("q"))


def _square(d: int) -> Column:
    if d <= SPELLED_OUT:
        return sum((F.col("p")[i] * F.col("p")[i] for i in range(d)), F.lit(0.0))
    return F.aggregate("p", F.lit(0.0), lambda s, v: s + v * v)


def spreads(df: DataFrame, d: int) -> DataFrame:
    """(c, n, centre, within, reach): adds the sum of squared and the mean plain distance to the centre.

    Two passes, because subtracting squared sums loses digits on data far from the origin.
    """
    centres = small_side(df.groupBy("c").agg(F.array(*[F.avg(F.col("p")[i]) for i in range(d)]).alias("centre")))
    gap = df.join(centres, "c").withColumn("g", squared_distance(F.col("p"), F.col("centre"), d))
    # numbers only, so that rows are hashed and not sorted
    sums = gap.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("within"), F.avg(F.sqrt("g")).alias("reach"))
    return sums.join(centres, "c")


def spread_scores(df: DataFrame, cols: list[str], cluster: str = "cluster", include_noise: bool = True) -> dict:
    """inertia, Calinski-Harabasz and Davies-Bouldin from one table of cluster spreads.

    The table has one line per cluster and may be long, so it stays in Spark; a few sums reach the driver.
    """
    d = len(cols)
    table = checkpointed(spreads(labelled(df, cols, cluster, include_noise), d))
    n = F.col("n")
    k, rows, inertia, overall = table.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("within"),
        F.array(*[F.sum(F.col("centre")[i] * n) / F.sum(n) for i in range(d)])).first()
    if k < 2 or rows <= k:
        return {"inertia": inertia or 0, "calinski_harabasz": None, "davies_bouldin": None, "n_labels": k}
    between = table.agg(F.sum(n * squared_distance(F.col("centre"), F.array(*map(F.lit, overall))))).first()[0]
    ch = between / (k - 1) / (inertia / (rows - k)) if inertia else 1.0
    return {"inertia": inertia, "calinski_harabasz": ch, "davies_bouldin": _davies_bouldin(table, k), "n_labels": k}


def _davies_bouldin(table: DataFrame, k: int) -> float:
    """Mean over the clusters of the worst ratio of reaches to the distance of the centres.

    Every pair of clusters counts, so the work is quadratic in the clusters; pairs of blocks of clusters are
    compared in tasks of bounded size, and each gives one line per cluster.
    """
    blocks = max(1, math.ceil(k / BLOCK_ROWS))
    keyed = table.select("c", "centre", "reach", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = keyed.select(F.col("b").alias("i"), every.alias("j"), "c", "centre", "reach")
    right = keyed.select(every.alias("i"), F.col("b").alias("j"), "c", "centre", "reach")

    def worst(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"c": a["c"][:0], "worst": []})
        x, y = np.array(a["centre"].tolist()), np.array(b["centre"].tolist())
        out = np.full(len(x), -np.inf)
        for s in range(0, len(x), 256):
            gap = np.sqrt(((x[s:s + 256, None, :] - y[None, :, :]) ** 2).sum(axis=2))
            both = a["reach"].to_numpy()[s:s + 256, None] + b["reach"].to_numpy()[None, :]
            ratio = np.divide(both, gap, out=np.zeros_like(gap), where=gap > 0)
            ratio[a["c"].to_numpy()[s:s + 256, None] == b["c"].to_numpy()[None, :]] = -np.inf
            out[s:s + 256] = ratio.max(axis=1)
        return pd.DataFrame({"c": a["c"], "worst": out})

    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(worst, "c long, worst double")
    return parts.groupBy("c").agg(F.max("worst").alias("worst")).agg(F.avg("worst")).first()[0]


def silhouette_squared(df: DataFrame, cols: list[str], cluster: str = "cluster", include_noise: bool = True) -> float | None:
    """Mean silhouette under squared Euclidean distance.

    The mean squared distance from a point to a cluster follows from the cluster's count, centre and
    sum of squares, so the cost is rows x clusters and no pair of rows is formed. Blocks of rows meet blocks
    of clusters, so no task and not the driver holds all clusters.
    """
    data = labelled(df, cols, cluster, include_noise)
    d = len(cols)
    shift = data.agg(F.array(*[F.avg(F.col("p")[i]) for i in range(d)])).first()[0]
    if shift is None or shift[0] is None:
        return None
    if d <= SPELLED_OUT:
        moved = data.select(F.array(*[F.col("p")[i] - F.lit(float(v)) for i, v in enumerate(shift)]).alias("p"), "c")
    else:
        moved = data.select(F.zip_with("p", F.array(*[F.lit(float(v)) for v in shift]), lambda x, m: x - m).alias("p"), "c")
    table = checkpointed(moments(moved, d))
    k = table.count()
    if k < 2:
        return None
    blocks = math.ceil(k / BLOCK_ROWS)
    own = table.select("c", F.col("n").alias("size"), F.col("centre").alias("home"), F.col("q").alias("home_q"))
    rows = moved.join(small_side(own, True), "c")
    if k <= FEW_CLUSTERS and d <= SPELLED_OUT:
        return _mean_silhouette(rows.select("size", *_few_others(table.select("c", "n", "centre", "q").collect(), d)))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = materialised(rows, "silhouette") if blocks > 1 else rows
    block = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")
    parts = []
    for b in range(blocks):  # one block of at most about BLOCK_ROWS clusters goes to each task at a time
        some = table.where(block == b).select("c", "n", "centre", "q").toPandas()
        parts.append(rows.mapInPandas(_nearest_other(some), "row long, own double, size long, other double"))
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    if blocks > 1:
        near = near.groupBy("row").agg(F.max("own").alias("own"), F.max("size").alias("size"), F.min("other").alias("other"))
    return _mean_silhouette(near)


def _mean_silhouette(near: DataFrame) -> float:
    a = F.col("own") * F.col("size") / F.greatest(F.col("size") - 1, F.lit(1))
    top = F.greatest(a, F.col("other"))
    value = F.when((F.col("size") > 1) & (top > 0), (F.col("other") - a) / top).otherwise(0.0)
    return near.agg(F.avg(value)).first()[0]


def _few_others(clusters: list, d: int) -> list[Column]:
    """``own`` and ``other`` as ``_nearest_other`` gives them, for a few clusters as plain expressions. A missing number is NaN."""
    nan = F.lit(float("nan"))
    x = [F.coalesce(F.col("p")[i], nan) for i in range(d)]
    square = sum((v * v for v in x), F.lit(0.0))

    def mean(size, q, centre):
        return square + F.coalesce(q / size, nan) - F.lit(2.0) * sum((v * m for v, m in zip(x, centre)), F.lit(0.0))

    number = lambda v: F.lit(float("nan") if v is None else float(v))
    own = mean(F.col("size"), F.col("home_q"), [F.coalesce(F.col("home")[i], nan) for i in range(d)])
    others = [F.when(F.lit(True) if r["c"] is None else F.col("c") != r["c"], mean(number(r["n"]), number(r["q"]), [number(v) for v in r["centre"]]))
              for r in clusters]
    return [own.alias("own"), F.least(*others).alias("other") if len(others) > 1 else others[0].alias("other")]


def _nearest_other(some: pd.DataFrame):
    """Mean squared distance of each row to its own cluster and to the nearest other one of a block."""
    labels, sizes, squares = some["c"].to_numpy(), some["n"].to_numpy(dtype=float), some["q"].to_numpy()
    centres = np.array(some["centre"].tolist(), dtype=float)

    def nearest(batches):
        for b in batches:
            if not len(b):
                continue
            x, home = np.array(b["p"].tolist(), dtype=float), np.array(b["home"].tolist(), dtype=float)
            square, size = (x * x).sum(axis=1), b["size"].to_numpy()
            own = square + b["home_q"].to_numpy() / size - 2 * (x * home).sum(axis=1)
            other = np.full(len(x), np.inf)
            if len(labels):
                mean = square[:, None] + (squares / sizes)[None, :] - 2 * x @ centres.T
                mean[b["c"].to_numpy()[:, None] == labels[None, :]] = np.inf
                other = mean.min(axis=1)
            yield pd.DataFrame({"row": b["row"], "own": own, "size": size, "other": other})

    return nearest


def _grouped_distances(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray,
                       both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of Euclidean distances: rows of ``x`` by labels of ``y``, and with ``both`` rows of ``y`` by labels of ``x``.

    ``at_x`` and ``at_y`` number the labels from 0 and ascend. Squares come from products of tiles; where digits would be
    lost (near pairs) or values are not finite, the pair is taken by its differences.
    """
    starts = lambda at: np.flatnonzero(np.diff(at, prepend=-1))
    starts_y = starts(at_y)
    by_y, by_x = np.zeros((len(x), len(starts_y))), np.zeros((len(y), at_x[-1] + 1))
    sound = x[np.isfinite(x).all(axis=1)]
    middle = sound.mean(axis=0) if len(sound) else 0.0
    with np.errstate(all="ignore"):
        xs, ys = x - middle, y - middle
        square_x, square_y = (xs * xs).sum(axis=1), (ys * ys).sum(axis=1)
        ahead = np.column_stack([xs, square_x, np.ones(len(x))])
        turned = np.ascontiguousarray(np.column_stack([ys * -2.0, np.ones(len(y)), square_y]).T)
        step = min(len(x), max(1, TILE // len(y)))
        tile, least = np.empty((step, len(y))), NEAR * (square_x.max() + square_y.max())
        for s in range(0, len(x), step):
            gap = np.matmul(ahead[s:s + step], turned, out=tile[:len(x) - s])
            if not (gap.min() > least and gap.max() < np.inf):
                scale = NEAR * (square_x[s:s + step, None] + square_y[None, :])
                r, c = np.nonzero(~(gap > scale) | ~np.isfinite(gap))
                for f in range(0, len(r), PAIRS):
                    i, j = r[f:f + PAIRS], c[f:f + PAIRS]
                    gap[i, j] = ((x[s + i] - y[j]) ** 2).sum(axis=1)
            np.sqrt(gap, out=gap)
            by_y[s:s + step] = np.add.reduceat(gap, starts_y, axis=1)
            if both:
                labels = at_x[s:s + step]
                first = starts(labels)
                by_x[:, labels[first]] += np.add.reduceat(gap, first, axis=0).T
    for total in (by_y, by_x):  # a distance that is not finite leaves no sum to the other labels of the block
        bad = ~np.isfinite(total)
        total[bad.sum(axis=1, keepdims=True) - bad > 0] = np.nan
    return by_y, by_x


def silhouette_values(df: DataFrame, cols: list[str], id_col: str, cluster: str = "cluster",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, c, silhouette) with plain Euclidean distance, exact.

    The cost is quadratic by nature. Rows are cut into hash blocks and every pair of blocks is one bounded task that
    returns sums per (row, cluster) for the rows of both; pairs of rows never leave the task. A block has ``block_rows`` rows;
    from ``MIN_BLOCKS`` blocks on it grows to ``BLOCK_VALUES`` numbers first, as each row is copied once for every block.
    """
    data = df.select(quoted(id_col).alias("id"), point(cols).alias("p"), quoted(cluster).cast("long").alias("c"))
    data = materialised(data, "silhouette")
    n = data.count()
    most = max(block_rows, BLOCK_VALUES // len(cols))
    blocks = max(1, min(math.ceil(n / block_rows), max(MIN_BLOCKS, math.ceil(n / most))))
    keyed = data.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = keyed.select(F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("j"), "id", "p", "c")
    right = keyed.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"),
                         F.col("id").alias("id_b"), F.col("p").alias("p_b"), F.col("c").alias("c_b"))  # names of one side only
    id_type = data.schema["id"].dataType.simpleString()

    def sums(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "c": [], "other": [], "total": []})
        b = b.rename(columns={"id_b": "id", "p_b": "p", "c_b": "c"})
        sides = []
        for side in (a, b):
            labels, at = np.unique(side["c"].to_numpy(), return_inverse=True)
            order = np.argsort(at, kind="stable")
            side = side.iloc[order]
            sides.append((side, np.array(side["p"].tolist(), dtype=float), at[order], labels))
        (a, x, at_x, in_a), (b, y, at_y, in_b) = sides
        two = key[0] != key[1]
        by_y, by_x = _grouped_distances(x, y, at_x, at_y, two)
        out = []
        for rows, labels, total in ((a, in_b, by_y), (b, in_a, by_x))[:1 + two]:
            k = len(labels)
            out.append(pd.DataFrame({"id": np.repeat(rows["id"].to_numpy(), k), "c": np.repeat(rows["c"].to_numpy(), k),
                                     "other": np.tile(labels, len(rows)), "total": total.ravel()}))
        return pd.concat(out, ignore_index=True)

    # the work is in pairs of rows, not in bytes, so the number of tasks is given
    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    parts = left.repartition(tasks, "i", "j").groupBy("i", "j").cogroup(
        right.repartition(tasks, "i", "j").groupBy("i", "j")).applyInPandas(
        sums, f"id {id_type}, c long, other long, total double")
    sizes = data.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    per = parts.groupBy("id", "c", "other").agg(F.sum("total").alias("total")).join(
        small_side(sizes.withColumnRenamed("c", "other")), "other")
    own = F.col("other") == F.col("c")
    folded = per.groupBy("id", "c").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return folded.select("id", "c", value.alias("silhouette"))


def silhouette_euclidean(df: DataFrame, cols: list[str], id_col: str, cluster: str = "cluster") -> float:
    return silhouette_values(df, cols, id_col, cluster).agg(F.avg("silhouette")).first()[0]


def silhouette(df: DataFrame, cols: list[str], id_col: str, cluster: str = "cluster",
               kind: str = "squared") -> float | None:
    """Mean silhouette of the named kind: ``squared`` distances in linear time, or ``euclidean`` in quadratic."""
    if kind not in KINDS:
        raise ValueError(f"unknown silhouette {kind}")
    if kind == "euclidean":
        return silhouette_euclidean(df, cols, id_col, cluster)
    return silhouette_squared(df, cols, cluster)


def score(df: DataFrame, cols: list[str], id_col: str, method: str, cluster: str = "cluster",
          kind: str = "squared") -> float | None:
    """One number to maximise: silhouette, calinski_harabasz, minus davies_bouldin or minus inertia."""
    if method == "silhouette":
        return silhouette(df, cols, id_col, cluster, kind)
    s = spread_scores(df, cols, cluster)
    if method == "calinski_harabasz":
        return s["calinski_harabasz"]
    if method in ("davies_bouldin", "inertia"):
        return None if s[method] is None else -s[method]
    raise ValueError(f"unknown score {method}")


def metrics_row(df: DataFrame, cols: list[str], id_col: str, cluster: str = "cluster",
                kind: str = "squared") -> dict:
    """All scores of one labelling."""
    s = spread_scores(df, cols, cluster)
    value = silhouette(df, cols, id_col, cluster, kind) if s["n_labels"] > 1 else None
    return {"silhouette_kind": kind if s["n_labels"] > 1 else "none", "silhouette": value, "calinski_harabasz": s["calinski_harabasz"],
            "davies_bouldin": s["davies_bouldin"], "inertia": s["inertia"]}
