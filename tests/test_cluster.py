"""Clustering against brute force, with hot cells and hot points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.operators.cluster import components, dbscan as dbscan_module, density, kmeans, metrics, mixture
from tablemill.operators.cluster.dbscan import dbscan
from tablemill.operators.cluster.neighbours import neighbour_distances
from tablemill.sources import files


def frame(spark, x):
    d = x.shape[1]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                                 "id long, " + ", ".join(f"x{i} double" for i in range(d))), [f"x{i}" for i in range(d)]


def blobs(d, seed=1):
    """Two groups, scattered points, and a third of all rows on one single point."""
    rng = np.random.RandomState(seed)
    return np.round(np.concatenate([rng.normal(0, 0.3, (80, d)), rng.normal(2, 0.2, (80, d)), rng.uniform(-3, 5, (30, d)),
                                    np.tile(rng.normal(1, 1, (1, d)), (90, 1))]), 2)


def brute_dbscan(x, eps, k):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps * (1 + 1e-12)
    core = near.sum(1) >= k
    label = -np.ones(len(x), int)
    c = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], c
            while stack:
                for m in np.where(near[stack.pop()] & core)[0]:
                    if label[m] < 0:
                        label[m] = c
                        stack.append(m)
            c += 1
    return near, core, label


@pytest.mark.parametrize("d,direct", [(1, 4096), (2, 1), (3, 4096)])
def test_dbscan(spark, monkeypatch, d, direct):
    monkeypatch.setattr(dbscan_module, "DIRECT_PAIRS", direct)
    x = blobs(d)
    df, cols = frame(spark, x)
    eps = 0.1 * (d + 0.5)
    near, core, label = brute_dbscan(x, eps, 5)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(df, cols, eps, 5).collect()}
    names = {}
    for i in range(len(x)):
        assert got[i][1] == core[i]
        if core[i]:
            assert names.setdefault(got[i][0], label[i]) == label[i]
        else:
            around = {got[j][0] for j in np.where(near[i] & core)[0]}
            assert (got[i][0] in around) if around else got[i][0] == -1
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("d", [2, 3])
def test_dbscan_of_many_cells(spark, monkeypatch, d):
    """Touching crowded cells are linked first, and cells of the largest component look for no other cells."""
    searched = []

    def spied(sources, targets, *rest):
        searched.append((sources.count(), targets.count()))
        return near_cells(sources, targets, *rest)

    near_cells = dbscan_module.near_cells
    monkeypatch.setattr(dbscan_module, "near_cells", spied)
    rng = np.random.RandomState(d)
    # a crowded block, a second one just out of reach, a bridge of single points, lone points and points between cells
    x = np.concatenate([rng.uniform(0, 1, (500, d)), rng.uniform(0, 1, (200, d)) + 1.3, rng.uniform(-1, 4, (60, d)), np.tile(rng.uniform(3, 4, (1, d)), (9, 1))])
    df, cols = frame(spark, x)
    eps = 0.1 * (d + 0.5)
    near, core, label = brute_dbscan(x, eps, 4)
    plain = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(df, cols, eps, 4).collect()}
    monkeypatch.setattr(dbscan_module, "MANY_CELLS", 0)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(df, cols, eps, 4).collect()}
    assert got == plain
    assert all(got[i][1] == core[i] for i in range(len(x)))
    names = {(got[i][0], label[i]) for i in range(len(x)) if core[i]}
    assert len(names) == len({a for a, _ in names}) == len({b for _, b in names})
    (all_cells, targets), (outer, targets_again) = searched
    assert all_cells == targets == targets_again and outer < all_cells


def test_components(spark):
    rng = np.random.RandomState(2)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)]
    edges += [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["label"] for r in components.connected_components(df).collect()}
    least = {n: n for e in edges for n in e}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: m for n, m in least.items() if n not in alone}
    assert found[440] == 400 and found[559] == 500


@pytest.mark.parametrize("k", [2, 5])
def test_neighbour_distances(spark, k):
    x = blobs(2)
    df, cols = frame(spark, x)
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, k - 1]
    got = {r["id"]: r["distance"] for r in neighbour_distances(df, cols, "id", k).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)


def test_scores(spark):
    rng = np.random.RandomState(4)
    x = np.concatenate([rng.normal(0, 1, (40, 2)), rng.normal(6, 1, (50, 2)), [[20.0, 20.0]]])
    y = np.array([0] * 40 + [1] * 50 + [2])
    df, cols = frame(spark, x)
    df = df.withColumn("cluster", F.when(F.col("id") < 40, 0).when(F.col("id") < 90, 1).otherwise(2))
    for power, got in ((1, metrics.silhouette_euclidean(df, cols, "id")), (2, metrics.silhouette_squared(df, cols))):
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) ** power
        s = []
        for i in range(len(x)):
            own = y == y[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a = dist[i][own].sum() / (own.sum() - 1)
            b = min(dist[i][y == c].mean() for c in set(y) if c != y[i])
            s.append((b - a) / max(a, b))
        assert np.isclose(got, np.mean(s))
    many = metrics.silhouette_values(df, cols, "id", block_rows=20).agg(F.avg("silhouette")).first()[0]
    assert np.isclose(many, metrics.silhouette_euclidean(df, cols, "id"))
    got = metrics.spread_scores(df, cols)
    centres = np.array([x[y == c].mean(0) for c in range(3)])
    within = sum(((x[y == c] - centres[c]) ** 2).sum() for c in range(3))
    assert np.isclose(got["inertia"], within)


def test_kmeans_and_storage(spark, tmp_path):
    rng = np.random.RandomState(9)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(5, 0.3, (60, 2)), rng.normal([0, 5], 0.3, (60, 2))])
    df, cols = frame(spark, x)
    result = kmeans.train(df, cols, "id", k_min=2, k_max=4, n_init=2)
    assert result.info["n_clusters"] == 3
    files.save_model(spark, result, str(tmp_path / "m"))
    loaded = files.load_model(spark, str(tmp_path / "m"))
    a = {r["id"]: r["cluster"] for r in result.predict(df).collect()}
    b = {r["id"]: (r["cluster"], r["x0"]) for r in loaded.predict(df).collect()}
    assert all(b[i] == (a[i], x[i][0]) for i in a)
    assert len({a[i] for i in range(60)}) == 1
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("kind", mixture.KINDS)
def test_mixture(spark, kind):
    rng = np.random.RandomState(11)
    x = np.concatenate([rng.normal(0, 1, (80, 2)), rng.normal(6, 0.5, (80, 2))])
    df, cols = frame(spark, x)
    m = mixture.initial(df, cols, 2, kind, 1)
    last = -np.inf
    for _ in range(3):
        m, loglik = mixture.em_step(df, cols, m)
        assert loglik >= last - 1e-6
        last = loglik
    labels = {r["id"]: r["cluster"] for r in mixture.assign(df, cols, m).collect()}
    assert len({labels[i] for i in range(80)}) == 1 and labels[0] != labels[100]


def test_knee_and_given_eps(spark):
    df, cols = frame(spark, blobs(2))
    assert density.knee_eps(df, cols, "id", 4) > 0
    result = density.train(df, cols, "id", eps=0.3, min_samples=5)
    assert result.eps == 0.3 and result.info["n_clusters"] >= 2


def test_scores_of_many_clusters(spark, monkeypatch):
    """Blocks of clusters give the same scores as all clusters at once."""
    rng = np.random.RandomState(8)
    x, c = rng.normal(0, 5, (900, 3)), rng.randint(0, 250, 900)
    df, cols = frame(spark, x)
    df = df.join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(c)], "id long, cluster long"), "id")
    one = metrics.metrics_row(df, cols, "id")
    monkeypatch.setattr(metrics, "BLOCK_ROWS", 40)
    many = metrics.metrics_row(df, cols, "id")
    assert one["silhouette_kind"] == many["silhouette_kind"] == "squared"
    centres = {v: x[c == v].mean(0) for v in set(c.tolist())}
    reach = {v: np.sqrt(((x[c == v] - m) ** 2).sum(1)).mean() for v, m in centres.items()}
    worst = [max((reach[a] + reach[b]) / np.linalg.norm(centres[a] - centres[b]) for b in centres if b != a) for a in centres]
    inner = sum(((x[c == v] - m) ** 2).sum() for v, m in centres.items())
    outer = sum((c == v).sum() * ((m - x.mean(0)) ** 2).sum() for v, m in centres.items())
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    values = []
    for i, v in enumerate(c):
        own = c == v
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = gap[i][own].sum() / (own.sum() - 1)
        b = min(gap[i][c == o].mean() for o in centres if o != v)
        values.append((b - a) / max(a, b))
    for got in (one, many):
        assert np.isclose(got["davies_bouldin"], np.mean(worst)) and np.isclose(got["inertia"], inner)
        assert np.isclose(got["calinski_harabasz"], outer / (len(centres) - 1) / (inner / (900 - len(centres))))
        assert np.isclose(got["silhouette"], np.mean(values))
    with pytest.raises(ValueError):
        metrics.silhouette(df, cols, "id", kind="other")


def test_wide_distinct_counts(spark):
    from tablemill.operators import profile

    df = spark.range(1000).select((F.col("id") + 2**60).alias("wide"), (F.col("id") % 7).alias("small"),
                                  (F.col("id").cast("decimal(38,0)") + F.lit("1" + "0" * 30).cast("decimal(38,0)")).alias("exact"))
    found = profile.profile(df)
    assert [found[c].distinct for c in ("wide", "small", "exact")] == [1000, 7, 1000]


def test_euclidean_silhouette_of_near_far_and_repeated_rows(spark, monkeypatch):
    """Far from the origin, with exact and near copies, a lone label and one id twice, on few blocks and on many."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) + np.array([1e6, -1e6, 0.0])
    x[10], x[11], x[12] = x[0], x[0] + 1e-4, x[1]
    c = np.r_[np.arange(59) % 4, 9]
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, c))],
                               "id long, x double, y double, z double, cluster int")
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(60):
        inner = {k: gap[i, c == k].sum() / max(1, (c == k).sum() - (k == c[i])) for k in set(c.tolist())}
        a, b = inner.pop(int(c[i])), min(inner.values())
        want.append(0.0 if (c == c[i]).sum() == 1 else (b - a) / max(a, b))
    for block, least in ((60, 24), (7, 24), (7, 2)):
        monkeypatch.setattr(metrics, "MIN_BLOCKS", least)
        monkeypatch.setattr(metrics, "BLOCK_VALUES", 60)
        got = dict(metrics.silhouette_values(df, ["x", "y", "z"], "id", block_rows=block).select("id", "silhouette").collect())
        assert np.allclose([got[i] for i in range(60)], want, rtol=0, atol=1e-12)
    twice = df.unionByName(df.where("id = 3"))
    assert metrics.silhouette_values(twice, ["x", "y", "z"], "id").where("id = 3").count() == 1


def test_euclidean_silhouette_copies_each_row_few_times(spark, monkeypatch):
    """Rows are not copied once for every ``block_rows`` rows of the table."""
    df = spark.range(3000).select("id", F.rand(1).alias("x"), (F.col("id") % 3).cast("int").alias("cluster"))
    seen = []
    whole = metrics.F.sequence
    monkeypatch.setattr(metrics.F, "sequence", lambda *a: seen.append(a) or whole(*a))
    tasks = metrics.silhouette_values(df, ["x"], "id", block_rows=10)
    assert tasks.count() == 3000
    copies = df.select(F.lit(0).alias("b")).limit(1).select(*[F.size(whole(*a)).alias(f"s{i}") for i, a in enumerate(seen)]).first()
    assert max(copies) <= metrics.MIN_BLOCKS


def test_dbscan_compares_no_points_inside_a_linked_block(spark, monkeypatch):
    """Crowded cells that touch are linked by their boxes; only points next to what is still open are read again."""
    searched, read = [], []
    core_edges, distinct_in = dbscan_module._core_edges, getattr(dbscan_module, "_distinct_in", None)

    def spied(core, pairs, *rest):
        searched.append(pairs.count())
        return core_edges(core, pairs, *rest)

    def spied_read(*given):
        out = distinct_in(*given)
        read.append(out.count())
        return out

    monkeypatch.setattr(dbscan_module, "_core_edges", spied)
    if distinct_in:
        monkeypatch.setattr(dbscan_module, "_distinct_in", spied_read)
    rng = np.random.RandomState(7)
    x = np.concatenate([rng.uniform(0, 1, (4000, 2)), rng.uniform(-2, 3, (40, 2))])
    df, cols = frame(spark, x)
    _, core, label = brute_dbscan(x, 0.2, 6)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(df, cols, 0.2, 6).collect()}
    assert all(got[i][1] == core[i] for i in range(len(x)))
    names = {(got[i][0], label[i]) for i in range(len(x)) if core[i]}
    assert len(names) == len({a for a, _ in names}) == len({b for _, b in names})
    assert not searched and sum(read) < len(x) / 2


def test_dbscan_keeps_rows_without_a_coordinate(spark):
    """They are near no other row: noise, or a cluster of their own where a cell of them is crowded."""
    rows = [(i, 0.1, 0.1 + i / 100) for i in range(6)] + [(i, None, 0.1) for i in range(10, 16)] + [(20, 0.1, None), (21, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(df, ["x", "y"], 0.5, 4).collect()}
    assert len(got) == len(rows) and got[20] == got[21] == (-1, False)
    assert {got[i] for i in range(6)} == {(1, True)} and {got[i] for i in range(10, 16)} == {(0, True)}


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    edges = [([a // 10, a % 10], [b // 10, b % 10]) for a, b in [(1, 2), (2, 13), (20, 31), (31, 1), (50, 41), (60, 60)]]
    df = spark.createDataFrame(edges, "a array<long>, b array<long>")
    found = {tuple(r["node"]): tuple(r["label"]) for r in components.few_components(df).collect()}
    assert found == {(0, 1): (0, 1), (0, 2): (0, 1), (1, 3): (0, 1), (2, 0): (0, 1), (3, 1): (0, 1), (4, 1): (4, 1), (5, 0): (4, 1)}
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert {tuple(r["node"]): tuple(r["label"]) for r in components.few_components(df).collect()} == found
