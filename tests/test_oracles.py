"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from velotrace.plans import registry
from velotrace.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    some = df[cols].apply(lambda s: s.astype(float).round(6) + 0.0 if s.dtype.kind == "f" else s).astype(str)
    return cols, some.sort_values(cols).values.tolist()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_thresholds_of_all_rows(spark, duck):
    got = QUERIES["overtake_thresholds"](spark, SF).toPandas()
    assert len(got[["track_id", "frame"]].drop_duplicates()) == duck.execute("SELECT count(*) FROM events").fetchone()[0]


def test_embeddings_are_whole(spark):
    """Scaling, PCA and metrics of all 64 components against NumPy."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, lab = np.array(e.embedding.tolist(), float), e.label.to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    got = QUERIES["zscore"](spark, SF).toPandas().sort_values("vec_id")
    assert np.allclose(got[[f"e{k}" for k in range(64)]], z, atol=2e-6)
    assert len(registry._vectors(spark, SF).first().features) == 64
    share = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1] / 64 * (len(z) - 1) / len(z)
    n = int(np.searchsorted(np.cumsum(share), 0.95 - 1e-12) + 1)
    assert np.allclose(QUERIES["pca_variance"](spark, SF).toPandas().sort_values("component").variance, share[:n], atol=1e-4)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    mean = {c: d[:, lab == c].sum(1) / np.maximum((lab == c).sum() - (lab == c), 1) for c in set(lab)}
    a = np.array([mean[c][i] for i, c in enumerate(lab)])
    b = np.array([min(m[i] for k, m in mean.items() if k != c) for i, c in enumerate(lab)])
    got = QUERIES["silhouette"](spark, SF).toPandas().sort_values("vec_id")
    assert np.allclose(got.s, (b - a) / np.maximum(a, b), atol=2e-6)
    c = {k: x[lab == k].mean(0) for k in mean}
    within = {k: ((x[lab == k] - c[k]) ** 2).sum(1) for k in c}
    ch = sum((lab == k).sum() * ((c[k] - x.mean(0)) ** 2).sum() for k in c) / (len(c) - 1) / (sum(w.sum() for w in within.values()) / (len(x) - len(c)))
    spread = {k: np.sqrt(w).mean() for k, w in within.items()}
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(c[i] - c[j]) for j in c if j != i) for i in c])
    row = QUERIES["ch_db"](spark, SF).first()
    assert np.allclose([row.calinski_harabasz, row.davies_bouldin], [ch, db], atol=2e-6) and row.n_clusters == len(c)


def _segments(points, tolerance):
    """Douglas and Peucker by recursion."""
    (x0, y0), (x1, y1) = points[0], points[-1]
    length2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
    far, at = 0.0, None
    for k, (x, y) in enumerate(points[1:-1], 1):
        t = min(1, max(0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / length2)) if length2 else 0
        d2 = (x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2
        if d2 > far:
            far, at = d2, k
    if far <= tolerance**2:
        return [points[0], points[-1]]
    return _segments(points[: at + 1], tolerance)[:-1] + _segments(points[at:], tolerance)


def test_simplified_tracks(spark):
    """The queries of simplification, against recursion on every track."""
    traj = registry.trajectories(spark, SF).orderBy("track_id", "frame").toPandas()
    lines = {k: list(zip(g.translation_x, g.translation_y)) for k, g in traj.groupby("track_id")}
    want = {(k, n): (*a, *b) for k, p in lines.items() for kept in [_segments(p, 0.1)] for n, (a, b) in enumerate(zip(kept, kept[1:]))}
    got = {(r.track_id, r.segment): (r.x0, r.y0, r.x1, r.y1) for r in QUERIES["simplify_segments"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-6) for k in want)
    for r in QUERIES["simplification_sweep"](spark, SF).collect():
        kept = [_segments(p, r.tolerance) for p in lines.values()]
        steps = [np.hypot(b[0] - a[0], b[1] - a[1]) for p in kept for a, b in zip(p, p[1:])]
        assert np.allclose([r.segments, r.length], [len(steps) / len(kept), np.mean(steps)], atol=2e-6)


def test_embedding_clusters(spark):
    """Queries without SQL, whose clusters no statement names: sizes and costs hold together, and more clusters cost less."""
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    sizes = QUERIES["kmeans_sizes"](spark, SF).orderBy("rank").collect()
    assert sum(r.n for r in sizes) == n and [r.n for r in sizes] == sorted((r.n for r in sizes), reverse=True)
    found = QUERIES["auto_k"](spark, SF).orderBy("k").collect()
    costs = [r.cost for r in found]
    assert costs == sorted(costs, reverse=True) and costs[0] < 64 * n and sum(r.chosen for r in found) == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
