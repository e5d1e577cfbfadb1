"""k-means: all seeded starts and all k in one scan per round, assignment as an expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.operators.cluster import many, metrics
from tablemill.operators.scale import apply_scaler, fit_standard
from tablemill.session import materialised

Centres = list[list[float]]
#: Spark's k-means keeps the rows of a task in memory, about 170 bytes each for two columns, and reads them again each round.
ROWS_PER_TASK = 1_000_000


def in_tasks(df: DataFrame, most: int) -> DataFrame:
    """The table dealt over enough tasks for ``most`` rows each; it stays as it is where it has as many already.

    Scans are cut by bytes, so a task may get very many rows of a few narrow columns.
    """
    tasks = math.ceil(df.count() / most)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def centre_distance(cols: list[str], centre: list[float]) -> Column:
    total = F.lit(0.0)
    for c, v in zip(cols, centre):
        total = total + (quoted(c) - F.lit(float(v))) * (quoted(c) - F.lit(float(v)))
    return total


def assign(df: DataFrame, cols: list[str], centres: Centres, out: str = "cluster") -> DataFrame:
    """Nearest centre of every row (the first on ties) and the squared distance to it."""
    options = [F.struct(centre_distance(cols, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    best = F.least(*options) if len(options) > 1 else options[0]
    return df.withColumn("_b", best).withColumns({out: F.col("_b.i"), "distance2": F.col("_b.d")}).drop("_b")


def lloyd(df: DataFrame, cols: list[str], centres: Centres, max_iter: int = 300, tol: float = 1e-4) -> Centres:
    """Iterate assignment and averaging from given centres; an empty cluster keeps its centre.

    Each round is one aggregation with k x d numbers coming back.
    """
    for _ in range(max_iter):
        rows = assign(df, cols, centres).groupBy("cluster").agg(*[F.avg(quoted(c)).alias(f"m{i}")
                                                                  for i, c in enumerate(cols)]).collect()
        moved = {r["cluster"]: [r[f"m{i}"] for i in range(len(cols))] for r in rows}
        new = [moved.get(i, c) for i, c in enumerate(centres)]
        shift = sum((a - b) ** 2 for old, fresh in zip(centres, new) for a, b in zip(old, fresh))
        centres = new
        if shift <= tol * tol:
            break
    return centres


def fit(df: DataFrame, cols: list[str], k: int, seed: int = 42, init: str = "k-means||", max_iter: int = 300,
        ) -> Centres:
    """Centres from one seeded start, ordered so that numbering does not depend on the start."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=cols, outputCol="features").transform(
        in_tasks(df.select(*[quoted(c) for c in cols]), ROWS_PER_TASK)).select("features")
    model = KMeans(k=k, seed=seed, initMode=init, maxIter=max_iter).fit(vectors)
    return sorted([float(v) for v in c] for c in model.clusterCenters())


def scan_k(df: DataFrame, cols: list[str], id_col: str, k_min: int = 2, k_max: int = 10, method: str = "silhouette",
           seed: int = 42, **kw) -> list[tuple[int, float]]:
    """(k, score) for every k. Inertia always favours the largest k.

    All k are fitted together (``many``), one job a round. Scores share two more jobs; only the Euclidean
    silhouette, which compares rows with rows, is taken for one k after another.
    """
    data = many.points(df, cols)
    ks = list(range(k_min, k_max + 1))
    paths = many.fit_many(data, len(cols), [(k, seed, "k-means||") for k in ks])
    return list(zip(ks, _scores(df, data, cols, id_col, [p.at(len(p.centres)) for p in paths], method, **kw)))


def _scores(df: DataFrame, data: DataFrame, cols: list[str], id_col: str, models: list[Centres], method: str,
            kind: str = "squared") -> list[float | None]:
    if method == "silhouette" and kind != "squared":
        return [metrics.score(assign(df, cols, c), cols, id_col, method, kind=kind) if c else None for c in models]
    return many.scores_many(data, len(cols), models, method)


def tune(df: DataFrame, cols: list[str], id_col: str, k: int, method: str = "multiple_init", n_init: int = 10,
         max_iter: int = 300, seed: int = 42, init_centres: Centres | None = None, grid: dict | None = None,
         score: str = "silhouette") -> Centres:
    """``multiple_init`` (best of seeded starts), ``grid_search`` or ``custom_init`` (given centres).

    All starts are fitted together, one job a round. Options that differ only in their number of rounds read the
    same path at different places. Equal scores go to the option named first.
    """
    if method == "custom_init":
        if init_centres is None:
            raise ValueError("init_centres is needed")
        return lloyd(df, cols, init_centres, max_iter)
    if method == "multiple_init":
        options = [("k-means||", max_iter, seed + i) for i in range(n_init)]
    elif method == "grid_search":
        grid = {"init": ["k-means||", "random"], "max_iter": [200, 300, 400], "n_init": [10], **(grid or {})}
        options = [(i, m, seed + s) for i in grid["init"] for m in grid["max_iter"] for s in range(max(grid["n_init"]))]
    else:
        raise ValueError(f"unknown method {method}")
    data = many.points(df, cols)
    starts = list(dict.fromkeys((k, start, init) for init, _, start in options))
    paths = dict(zip(starts, many.fit_many(data, len(cols), starts, max(m for _, m, _ in options))))
    models = [paths[k, start, init].at(iterations) for init, iterations, start in options]
    different = [list(c) for c in dict.fromkeys(tuple(map(tuple, c)) for c in models)]
    scored = [(v, c) for v, c in zip(_scores(df, data, cols, id_col, different, score), different) if v is not None]
    return [list(c) for c in max(scored, key=lambda s: s[0])[1]] if scored else None


class KMeansResult:
    """Scaler and centres; ``predict`` is a pure projection and works on streams."""

    def __init__(self, cols, scaler, centres, info=None, labels=None):
        self.cols, self.scaler, self.centres, self.info, self.labels = cols, scaler, centres, info or {}, labels

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        raw = {f"_raw{i}": quoted(c) for i, c in enumerate(self.cols)}
        scaled = apply_scaler(df.withColumns(raw), self.scaler)
        done = assign(scaled, self.cols, self.centres, out).drop("distance2")
        return done.withColumns({c: F.col(f"_raw{i}") for i, c in enumerate(self.cols)}).drop(*raw)


def train(df: DataFrame, cols: list[str], id_col: str, k: int | None = None, score: str = "silhouette",
          tune_method: str = "multiple_init", k_min: int = 2, k_max: int = 10, seed: int = 42, **kw) -> KMeansResult:
    """Standardise, choose k unless given, tune, score. The scaled table is written once and re-read."""
    scaler = fit_standard(df, cols)
    data = materialised(apply_scaler(df.select(quoted(id_col), *[quoted(c).cast("double").alias(c) for c in cols]),
                                     scaler), "kmeans", spread_out=True)
    scan = []
    if k is None:
        scan = scan_k(data, cols, id_col, k_min, k_max, score, seed)
        k = max((s for s in scan if s[1] is not None), key=lambda s: (s[1], -s[0]))[0]
    centres = tune(data, cols, id_col, k, tune_method, seed=seed, score=score, **kw)
    labels = assign(data, cols, centres)
    info = {"n_clusters": k, "scan": scan, **metrics.metrics_row(labels, cols, id_col)}
    return KMeansResult(cols, scaler, centres, info, labels)
