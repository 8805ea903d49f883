"""Operators on hand-made tracks and against NumPy."""

import glob
import gzip
import inspect
import json
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from velotrace.functions import sequence as S
from velotrace.operators import analysis as A
from velotrace.operators import interactions as I
from velotrace.operators import learning as L
from velotrace.operators import maneuvers as M
from velotrace.operators import windows as W
from velotrace.operators.builder import WindowBuilder
from velotrace.plans.registry import QUERIES
from velotrace.sources import config as C
from velotrace.sources import tracks as T

COLS = "track_id long, frame long, category int, translation_x double, translation_y double, velocity_x double, velocity_y double, acceleration_x double, acceleration_y double, rotation_z double"


def tracks(spark, *parts):
    rows = [(tid, int(f), cat, float(x), float(y), float(vx), 0.0, 0.0, 0.0, 0.0) for tid, cat, fs, x0, y0, vx in parts for f, x, y in ((f, x0 + vx * 0.08 * f, y0(f) if callable(y0) else y0) for f in fs)]
    return spark.createDataFrame(rows, COLS).withColumn("timestamp", F.col("frame") * 0.08)


def test_constant_gap_is_one_interaction(spark):
    t = tracks(spark, (1, 3, range(50), 0, 0, 4), (2, 3, range(50), 5, 0, 4), (3, 3, range(50), 100, 0, 4))
    got = {(r.track_id, r.other_id): r for r in I.interactions(t, 3, 3, 10.0).collect()}
    assert set(got) == {(1, 2), (2, 1)}
    assert got[1, 2].dist_min == 5.0 and got[1, 2].rel_speed == 0.0 and got[1, 2].duration == 3.92 and got[1, 2].is_crossing == 0


def test_missing_common_frames_do_not_part_a_run(spark):
    frames = [f for f in range(50) if not 20 <= f < 25]
    t = tracks(spark, (1, 3, frames, 0, 0, 4), (2, 3, range(50), 5, 0, 4))
    assert I.interactions(t, 3, 3, 10.0).count() == 2


def test_field_of_view_and_contact_at_zero(spark):
    t = tracks(spark, (1, 3, range(30), 0, 0, 4), (2, 3, range(30), 5, 0, 4))
    got = I.interactions(t, 3, 3, 10.0, fov=90.0).collect()
    assert [(r.track_id, r.t_start) for r in got] == [(1, 0.0)]


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    t = tracks(spark, *[(k, 1 + k % 3, range(20), rng.uniform(0, 60), rng.uniform(0, 30), rng.uniform(1, 6)) for k in range(25)])
    got = {(r.track_id, r.other_id) for r in I.proximity_pairs(t.where("category = 3"), t, 7.5).collect()}
    p = t.toPandas()
    want = {(a.track_id, b.track_id) for a in p[p.category == 3].itertuples() for b in p[p.frame == a.frame].itertuples() if a.track_id != b.track_id and math.hypot(a.translation_x - b.translation_x, a.translation_y - b.translation_y) <= 7.5}
    assert got == want


def test_filter_and_unordered_pairs(spark):
    t = tracks(spark, (1, 3, range(100), 0, 0, 4), (2, 3, range(100), 5, 0, 4))
    found = I.interactions(t, 3, 3, 10.0)
    assert I.filter_interactions(t, found).count() == 0  # equal speed: a duplicated track
    moved = found.withColumn("rel_speed", F.lit(1.0))
    assert I.filter_interactions(t, moved).count() == 2
    assert I.filter_interactions(t, moved, min_distance=1000).count() == 0
    assert I.unordered_pairs(found).count() == 1


def test_following_finds_leader(spark):
    t = tracks(spark, (1, 3, range(60), 0, 0, 4), (2, 3, range(60), 8, 0.2, 4))
    found = I.interactions(t, 3, 3, 10.0).where("track_id = 1")
    got = M.following(M.smoothed(M.pair_frames(t, found)), M.Following()).collect()
    assert len(got) == 1 and got[0].ego_id == 1 and got[0].other_id == 2
    assert abs(got[0].long_distance_mean - 8) < 1e-9 and abs(got[0].lateral_offset_mean - 0.2) < 1e-9


def test_overtaking_lane_change(spark):
    y = lambda f: 1.5 * math.exp(-(((f - 75) / 22) ** 2))
    t = tracks(spark, (1, 3, range(150), 0, y, 6), (2, 3, range(150), 6 * 0.08 * 75 - 3 * 0.08 * 75, 0, 3))
    found = I.interactions(t, 3, 3, 30.0).where("track_id = 1")
    got = M.overtaking(M.smoothed(M.pair_frames(t, found, 10.0), speeds=False)).collect()
    assert len(got) == 1 and got[0].ego_id == 1 and abs(got[0].t_cross - 6.0) < 0.2
    assert got[0].t_start < got[0].t_cross < got[0].t_end and got[0].left_side is False


def test_heading_cleaning_equals_loop(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(20):
        h = np.cumsum(rng.normal(0, 0.1, 60)) + rng.uniform(-3, 3) + np.pi * (rng.random(60) < 0.15)
        h = (h + np.pi) % (2 * np.pi) - np.pi
        rows += [(k, i, float(x)) for i, x in enumerate(h)]
        c = np.unwrap(h)
        c[0] -= np.round((c[0] - np.median(c[: max(25, len(c) // 2)])) / np.pi) * np.pi
        for i in range(1, len(c)):
            c[i] -= np.round((c[i] - c[i - 1]) / np.pi) * np.pi
        want[k] = c
    got = S.add_clean_heading(spark.createDataFrame(rows, "k long, i long, h double"), "h", "c", ["k"], "i").toPandas().sort_values(["k", "i"])
    for k, c in want.items():
        assert np.allclose(got[got.k == k].c, c)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_smoothing_equals_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    got = S.smooth(spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k long, i long, x double"), {"y": ("x", 0.2)}, ["k"], "i").toPandas().sort_values("i").y
    w = np.array(S.gaussian_kernel(2.5))
    idx = np.arange(-10, n + 10) % (2 * n)
    assert np.allclose(got, np.convolve(x[np.where(idx >= n, 2 * n - 1 - idx, idx)], w, "valid"))


def test_sliding_windows(spark):
    spans = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.0, 0.5), (3, 0.08, 1.44)], "k long, first_t double, last_t double")
    got = sorted((r.k, r.w, r.f0, r.f1) for r in W.sliding_windows(spans, ["k"]).collect())
    assert got == [(1, 0, 0, 12), (1, 1, 6, 19), (1, 2, 12, 25), (3, 0, 1, 14), (3, 1, 5, 18)]


def test_regime_aggregation(spark):
    seq = spark.createDataFrame([(7, i, v) for i, v in enumerate([False, True, True, False, True])] + [(8, 0, False)], "maneuver_id long, w long, volatile boolean")
    got = {r.maneuver_id: r for r in W.aggregate_regimes(seq).collect()}
    assert (got[7].p_volatile, got[7].transition_rate, got[7].mean_run_volatile, got[7].std_run_volatile, got[7].mean_volatile_gap) == (0.6, 0.75, 1.5, 0.5, 0.2)
    assert not got[8].is_active and got[8].mean_volatile_gap == 1.0


def test_simplify_keeps_corners(spark):
    x = np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 0.01, 0, 2, 4])
    assert A.simplify_points(*x, 0.1).tolist() == [0, 2, 4]


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (20, 2)), rng.normal(4, 1, (30, 2))])
    df = spark.createDataFrame([(i, int(i >= 20), float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, label int, a double, b double")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    lab = np.arange(50) >= 20
    s = []
    for i in range(50):
        own, other = lab == lab[i], lab != lab[i]
        a, b = d[i][own].sum() / (own.sum() - 1), d[i][other].mean()
        s.append((b - a) / max(a, b))
    got = L.silhouette(df.withColumn("v", F.array("a", "b"))).toPandas().sort_values("id").s
    assert np.allclose(got, s)
    assert L.adjusted_rand(df.withColumn("q", F.col("label")), "label", "q").first().ari == 1.0
    z = L.zscore(df, ["a", "b"]).toPandas()
    assert np.allclose(z[["a", "b"]].std(ddof=0), 1) and np.allclose(z[["a", "b"]].mean(), 0)
    r = L.Reducer(["a", "b"], 0.9).fit(df)
    ev = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(r.explained, (ev / ev.sum())[: r.k])
    g = L.gram(df, ["a", "b"])
    assert np.allclose(list(L.vif(df, ["a", "b"]).values()), np.diag(g) * np.diag(np.linalg.inv(g)))


def test_sources_round_trip(spark, tmp_path):
    t = tracks(spark, (1, 3, range(5), 0, 0, 4)).withColumn("dimension_z", F.lit(1.0))
    t.drop("frame").write.option("header", True).csv(str(tmp_path / "csv"))
    got = T.read_tracks(spark, str(tmp_path / "csv"))
    assert "dimension_z" not in got.columns and sorted(r.frame for r in got.collect()) == list(range(5))
    (tmp_path / "m.json").write_text('{"categories": {"car": 1,\n "bicycle": 3}}')
    assert T.read_metadata(spark, str(tmp_path / "m.json")) == {"car": 1, "bicycle": 3}
    flat = spark.createDataFrame([(1, 2.0005, (1.0, None)), (2, None, None)], "id long, x double, f struct<a:double,b:double>")
    wide = T.flatten(flat, {"f": "f"})
    assert wide.columns == ["id", "x", "f_a", "f_b"]
    back = T.unflatten(wide, {"f": ("f", flat.schema["f"].dataType)}).orderBy("id").collect()
    assert back[0].f.a == 1.0 and back[1].f is None
    T.write_records(flat, str(tmp_path / "rec"))
    assert T.read_records(spark, str(tmp_path / "rec"), flat.schema).orderBy("id").collect() == flat.orderBy("id").collect()
    T.write_maneuvers_csv(flat.union(flat), str(tmp_path / "man"))
    assert spark.read.option("header", True).csv(str(tmp_path / "man")).count() == 2
    calls = []
    make = lambda: calls.append(1) or flat
    for force in (False, False, True):
        assert T.load_or_process(spark, str(tmp_path / "kept"), make, force=force).count() == 2
    assert len(calls) == 2


def test_clustering_pipeline(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(9, 1, (40, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, None, 1.0, 1.0)], "k long, a_mean double, b_std double, c_max double")
    for reducer in (None, L.Reducer(["a_mean", "b_std", "c_max"]), L.SplitReducer(["a_mean", "b_std", "c_max"])):
        p = L.ClusteringPipeline(["a_mean", "b_std", "c_max"], 2, reducer, restarts=2)
        got = {r.k: r.cluster_id for r in p.run(df).collect()}
        assert len(got) == 80 and len({got[i] for i in range(40)}) == 1 and got[0] != got[79]
        centers = p.centers(spark).orderBy("a_mean").collect()
        assert abs(centers[0].a_mean) < 1.5 and abs(centers[1].a_mean - 9) < 1.5
        regimes = {r.cluster_id: r.regime for r in W.regime_map(p.centers(spark), ["a_mean", "b_std", "c_max"]).collect()}
        assert regimes[got[79]] == "volatile" and regimes[got[0]] == "stable"
    assert L.ClusteringPipeline(["a_mean"], range(2, 4), restarts=1).run(df).count() == 80
    with pytest.raises(ValueError):
        L.ClusteringPipeline(["a_mean"], 2).run(df.limit(0))
    assert L.split_columns(["a_mean", "b_std", "c_max"]) == (["a_mean", "c_max"], ["b_std"])


def plain_kmeans(x, centers):
    """Lloyd's steps until nothing changes."""
    while True:
        label = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        new = np.array([x[label == k].mean(0) if (label == k).any() else c for k, c in enumerate(centers)])
        if np.allclose(new, centers, atol=1e-12):
            return centers, ((x - centers[label]) ** 2).sum()
        centers = new


def vectors(spark, x):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"c{k} double" for k in range(x.shape[1])))
    return L.feature_matrix(df, [f"c{k}" for k in range(x.shape[1])])[0].select("id", "features").repartition(3)


def test_kmeans_equals_plain_steps(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1.0, (40, 3)) for c in (0, 3, 7)])
    monkeypatch.setattr(L, "MOVE", 1e-18)
    seen, real = [], L._first_centers
    monkeypatch.setattr(L, "_first_centers", lambda s, k, seed: seen.append(real(s, k, seed)) or seen[-1])
    df = vectors(spark, x)
    fits = L.fit_many(df, [(L.View(), k, seed) for k in (1, 2, 4) for seed in (0, 1)])
    for first, fit in zip(seen, fits):
        centers, cost = plain_kmeans(x, first)
        assert np.allclose(fit.centers, centers) and np.isclose(fit.cost, cost)
    labelled = fits[-1].transform(df).toPandas().sort_values("id")
    assert labelled.prediction.tolist() == ((x[:, None] - fits[-1].centers) ** 2).sum(2).argmin(1).tolist()
    assert L.kmeans(df, 3).cost == min(f.cost for f in L.fit_many(df, [(L.View(), 3, s) for s in range(L.RESTARTS)])) and L.RESTARTS == 20


def test_views_follow_from_the_rows():
    rng = np.random.default_rng(1)
    x, key = rng.normal(size=(20_000, 2)), rng.integers(-(2**63), 2**63 - 1, 20_000)
    some, more = L.View(3, 0.8), L.View(4, 0.8)
    at, seen = some.rows(x, key, None)
    assert abs(len(at) / len(x) - 0.8) < 0.02 and (seen == x[at]).all() and set(at) != set(more.rows(x, key, None)[0])
    part = some.rows(x[500:900], key[500:900], None)[0] + 500
    assert set(part) == {k for k in at if 500 <= k < 900}
    noise = L.View(3, 1.0, 0.05).rows(x, key, np.array([2.0, 10.0]))[1] - x
    assert np.allclose(noise.std(0), [0.1, 0.5], rtol=0.03) and np.allclose(noise.mean(0), 0, atol=0.01) and abs(np.corrcoef(noise.T)[0, 1]) < 0.03
    assert abs(((noise / noise.std(0)) ** 4).mean() - 3) < 0.2


def test_auto_k_and_stability(spark):
    rng = np.random.default_rng(6)
    df = vectors(spark, np.vstack([rng.normal(c, 0.5, (20, 2)) for c in (0, 9, 18)]))
    best, costs, scores = L.auto_k(df, range(2, 5))
    assert len(costs) == len(scores) == 3 and int(np.argmax(scores)) == 1 and best == min(3, range(2, 5)[int(np.argmin(np.gradient(costs)))])
    found = L.stability(df, 3, runs=3)
    assert [m for m, *_ in found] == ["ari_subsample", "ari_seed", "ari_noise"] and all(v == [1.0] * 3 for _, *v in found)
    rng = np.random.default_rng(8)
    rough = {m: v for m, *v in L.stability(vectors(spark, rng.normal(size=(150, 4))), 4, runs=4, restarts=1)}
    assert all(-0.2 < low <= middle <= high <= 1 for middle, low, high in rough.values()) and rough["ari_seed"][0] < 1


def test_contingency_index(spark):
    rng = np.random.default_rng(3)
    p, q = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    q[:120] = p[:120]
    table = np.zeros((3, 4))
    np.add.at(table, (p, q), 1)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(p, q)], "p int, q int")
    assert np.isclose(L._ari(table), L.adjusted_rand(df, "p", "q").first().ari)


def test_registered_restarts(spark, monkeypatch):
    """The registered queries ask for as many runs and restarts as the reference."""
    asked = {}

    def keep(name, result):
        f = getattr(L, name)

        def kept(*a, **b):
            given = inspect.signature(f).bind(*a, **b)
            given.apply_defaults()
            asked.setdefault(name, []).append(given.arguments)
            return result

        monkeypatch.setattr(L, name, kept)

    keep("stability", [("ari_seed", 1.0, 1.0, 1.0)])
    keep("auto_k", (2, [1.0] * 4, [1.0] * 4))
    keep("kmeans", L.Clusters(np.zeros((1, 64)), 0.0))
    for name in ("stability", "auto_k", "kmeans_sizes"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked["stability"][0]["runs"] == 30 and all(a["restarts"] == 20 for some in asked.values() for a in some) and len(asked) == 3


def test_equal_fits_go_on_as_one(spark, monkeypatch):
    """A fit asked for again takes no steps of its own, and comes out as it does alone."""
    rng, begun, real = np.random.default_rng(4), [], L._first_centers
    df = vectors(spark, rng.normal(size=(200, 3)))
    monkeypatch.setattr(L, "_first_centers", lambda s, k, seed: begun.append((k, seed)) or real(s, k, seed))
    views = (L.View(), L.View(1, 0.7), L.View(1, 1.0, 0.1))
    wanted = [(v, k, seed) for v in views for k in (1, 3) for seed in (0, 1)]
    fits = L.fit_many(df, wanted + wanted[::-1], np.ones(3))
    assert len(begun) == len(wanted)
    for f, g in zip(fits, fits[::-1]):
        assert (f.centers == g.centers).all() and f.cost == g.cost
    alone = L.fit_many(df, wanted[5:6], np.ones(3))[0]
    assert np.allclose(fits[5].centers, alone.centers) and np.isclose(fits[5].cost, alone.cost)


def test_step_of_a_fit_is_one_stage(spark, monkeypatch):
    """Partitions' sums go straight to the driver; more than GATHERED of them take a second stage, with the same result."""
    df = vectors(spark, np.random.default_rng(9).normal(size=(90, 2)))
    wanted, fits, stages = [(v, k, 0) for v in (L.View(), L.View(1, 0.8)) for k in (2, 3)], [], []
    for group, most in (("straight", L.GATHERED), ("by fit", 0)):
        monkeypatch.setattr(L, "GATHERED", most)
        spark.sparkContext.setJobGroup(group, "")
        fits.append(L.fit_many(df, wanted))
        status = spark.sparkContext.statusTracker()
        stages.append(len(status.getJobInfo(max(status.getJobIdsForGroup(group))).stageIds))
    assert stages == [2, 3]  # the first is the vectors' own exchange, skipped
    for f, g in zip(*fits):
        assert np.allclose(f.centers, g.centers) and np.isclose(f.cost, g.cost)


def test_pipeline_reads_its_rows_from_a_file(spark):
    """What the rows are made of is in no plan after the first, nothing stays in the cache, and all columns come out as they were."""
    w = Window.partitionBy("g").orderBy("k")
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.lit(None).alias("nothing"), F.when(F.col("id") != 7, (F.col("id") % 2) * 9.0 + F.col("id") / 100).alias("a_mean"))
    df = df.withColumn("before", F.lag("k").over(w))
    spark.catalog.clearCache()
    got = L.ClusteringPipeline(["a_mean"], 2, L.Reducer(["a_mean"]), restarts=2).run(df)
    assert "Window" not in got._jdf.queryExecution().analyzed().toString() and spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()
    assert got.dtypes == [*df.dtypes, ("cluster_id", "int")]
    rows = {r.k: r for r in got.collect()}
    assert set(rows) == set(range(60)) - {7} and all(r.before == (k - 3 if k > 2 else None) and r.nothing is None for k, r in rows.items())
    assert len({(k % 2, r.cluster_id) for k, r in rows.items()}) == 2


def test_pipeline_begins_from_the_same_rows(spark, monkeypatch):
    """Values that differ in their last bits, and other partitions, change no cluster, though the first centres are of few rows."""
    monkeypatch.setattr(L, "INIT_ROWS", 20)
    x, fits = np.random.default_rng(3).normal(size=(400, 2)), []
    for factor, parts in ((1.0, 2), (1.0 + 2**-52, 5)):
        df = spark.createDataFrame([(i, *map(float, r * factor)) for i, r in enumerate(x)], "k long, a double, b double").repartition(parts)
        p = L.ClusteringPipeline(["a", "b"], 4, restarts=1)
        fits.append(({r.k: r.cluster_id for r in p.run(df).collect()}, p.model))
    assert fits[0][0] == fits[1][0] and np.allclose(fits[0][1].centers, fits[1][1].centers, atol=1e-9)


def test_scores_are_one_product(spark):
    """The plan of 64 components' scores does not grow with the loadings; scores are NumPy's, and null where a column is."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 64)) @ rng.normal(size=(64, 64))
    names = [f"c{k}" for k in range(64)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, *[1.0] * 63)], ", ".join(f"{c} double" for c in names))
    r = L.Reducer(names, 1.0).fit(df.na.drop())
    got = r.transform(df)
    assert got.columns == names + [f"pc{k + 1}" for k in range(64)]
    assert len(got._jdf.queryExecution().analyzed().toString()) < 200_000
    scores = [[row[f"pc{k + 1}"] for k in range(64)] for row in got.where("c0 IS NOT NULL").collect()]
    assert np.allclose(scores, (x - x.mean(0)) @ r.parts.T) and got.where("c0 IS NULL").first()["pc1"] is None


def test_cross_sums_with_nulls(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1000, 1, (300, 4))
    x[:, 3] = x[:, 0] + rng.normal(0, 0.1, 300)
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("e", F.lit(5.0)).repartition(3)
    want = df.toPandas().corr()
    got = {(r.a, r.b): r["corr"] for r in L.correlations(df, list("abcde")).collect()}
    assert len(got) == 10
    for (a, b), v in got.items():
        assert v is None if "e" in (a, b) else np.isclose(v, want.loc[a, b])


def test_silhouette_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(50, 1, 3).tolist()) for i in range(120)] + [(200, 0, [1.0, 1.0, 1.0]), (201, 1, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    a, b = ({r.id: r.s for r in L.silhouette(df, block=n).collect()} for n in (7, 1000))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) and len(a) == 122


def test_feature_adapter(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a_mean double, b_std double, c_max double")
    adapter = L.FeatureAdapter(df.columns, exclude=("c_max",))
    assert (adapter.names, adapter.magnitude, adapter.volatility) == (["a_mean", "b_std"], ["a_mean"], ["b_std"])
    back = adapter.from_vector(adapter.to_vector(df)).first()
    assert back.struct.asDict() == {"a_mean": 1.0, "b_std": 2.0}
    with pytest.raises(Exception, match="a vector of 2"):
        adapter.from_vector(L.FeatureAdapter(df.columns).to_vector(df)).collect()


def test_signals_by_salt(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sig = [("TrafficLight" if k % 2 else "WarningSign", *map(float, rng.uniform(0, 300, 2))) for k in range(40)]
    pts = [(k, 0, *map(float, rng.uniform(-50, 350, 2))) for k in range(200)]
    s, p = spark.createDataFrame(sig, "name string, x double, y double"), spark.createDataFrame(pts, "track_id long, frame long, translation_x double, translation_y double")
    for most in (W.BROADCAST_SIGNALS, 3):
        monkeypatch.setattr(W, "BROADCAST_SIGNALS", most)
        got = {r.track_id: r for r in W.signal_distances(p, s).collect()}
        assert len(got) == 200
        for k, _, x, y in pts:
            for kind, r in W.SIGNAL_RADIUS.items():
                d = min((math.hypot(x - a, y - b) for n, a, b in sig if n == kind), default=math.inf)
                assert got[k][f"dist_{kind}"] == (pytest.approx(d) if d <= r else None)
        assert W.nearest_signal(p, s, "WarningSign", 20.0).columns == ["track_id", "frame", "distance"]


def test_rows_that_are_not_finite_are_no_encounters(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 3.0, 1.0, -2.0, 0.0, 3.2, 4.0), (1, 1, nan, 1.0, -2.0, 0.0, 3.2, 4.0), (1, 2, 3.0, 1.0, -2.0, 0.0, inf, 4.0), (1, 3, 3.0, 1.0, None, 0.0, 3.2, 4.0), (1, 4, 3.0, 1.0, -2.0, 0.0, 3.2, nan)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "ego_id long, frame long, dx double, dy double, vx_rel double, vy_rel double, distance double, velocity double, category int")
    assert [r.frame for r in W.frame_safety(df, ["ego_id", "frame"]).collect()] == [0]


def test_ids_are_dense_and_ordered(spark):
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), float(t), float(t + 1), float(k)) for k, (a, b, t) in enumerate(zip(rng.integers(0, 9, 300), rng.integers(0, 9, 300), rng.integers(0, 50, 300)))]
    got = sorted(M.with_ids(spark.createDataFrame(rows, "ego_id long, other_id long, t_start double, t_end double, x double").repartition(5)).collect())
    assert [r.id for r in got] == list(range(300)) and [tuple(r)[1:] for r in got] == sorted(rows)
    assert M.with_ids(spark.createDataFrame([], "ego_id long, other_id long, t_start double, t_end double")).count() == 0


def test_window_builder(spark):
    t = tracks(spark, (1, 3, range(60), 0, 0, 4), (2, 1, range(60), 5, 0.5, 4.5))
    m = spark.createDataFrame([(1, 2, 0.0, 4.0)], "ego_id long, other_id long, t_start double, t_end double")
    whole = WindowBuilder(t, m)
    records = whole.records()
    assert records.schema["infrastructure"].dataType == T.INFRASTRUCTURE
    got = records.collect()
    assert len(got) == whole.windows().count() > 3 and all(r.infrastructure is None and r.riding.speed_max == 4.5 and r.traffic is not None for r in got)
    none = WindowBuilder(t, m, riding=False, traffic=False).records()
    assert none.schema["riding"].dataType == T.RIDING and none.schema["traffic"].dataType == T.TRAFFIC and all(r.riding is None for r in none.collect())
    assert {r.speed_max for r in WindowBuilder(t, m, ego_only=True).riding().collect()} == {4.0}


def test_config(tmp_path):
    text = "# c\na:\n  b: ${env.X}/y\n  n: 3\n  deep:\n    f: 1.5  # note\n    t: true\n    s: 'x # y'\nz: ${a.b}-${a.n}\nw: ${a.n}\nempty: null\n"
    got = C.parse_config(text, {"X": "q"})
    assert got == {"a": {"b": "q/y", "n": 3, "deep": {"f": 1.5, "t": True, "s": "x # y"}}, "z": "q/y-3", "w": 3, "empty": None}
    assert C.flat(got)["a.deep.f"] == 1.5
    for bad, kind in (("a: ${env.NONE}", KeyError), ("a: ${b}\nb: ${a}", ValueError), ("no key", ValueError)):
        with pytest.raises(kind):
            C.parse_config(bad, {})


def test_lists_are_json_arrays(spark, tmp_path):
    df = spark.range(10).withColumn("s", F.lit("a,]b")).repartition(3)
    T.write_lists(df, str(tmp_path / "l"))
    parts = [json.loads(gzip.open(p).read()) for p in glob.glob(str(tmp_path / "l" / "*.gz"))]
    assert sorted(r["id"] for p in parts for r in p) == list(range(10))
    T.write_lists(df.limit(0), str(tmp_path / "none"))
    assert T.read_records(spark, str(tmp_path / "none"), df.schema, array=True).count() == 0
    T.write_tracks(tracks(spark, (1, 3, range(5), 0, 0, 4)).unionByName(tracks(spark, (1, 3, range(3), 9, 0, 4))).drop("frame"), str(tmp_path / "t"))
    got = T.read_tracks(spark, str(tmp_path / "t")).orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(5)) and got[0].translation_x == 0.0


def test_sampled_scatter(spark):
    df = spark.range(20_000).selectExpr("id", "id * 2 AS y", "'f' AS family", "CASE WHEN id % 5 > 0 THEN id END AS x")
    assert A.scatter(df, "x", "y", ["family"]).count() == 16_000
    assert abs(A.scatter(df, "x", "y", ["family"], share=0.25).count() - 4000) < 300


def test_interaction_files_and_slices(spark, tmp_path):
    t = tracks(spark, (1, 3, range(50), 0, 0, 4), (2, 3, range(50), 5, 0, 4))
    found = I.interactions(t, 3, 3, 10.0)
    T.write_interactions(found, str(tmp_path / "i"))
    assert sorted(T.read_interactions(spark, str(tmp_path / "i")).collect()) == sorted(found.collect())
    m = found.withColumnRenamed("track_id", "ego_id")
    assert I.slice_maneuvers(t, m).count() == 200 and I.slice_maneuvers(t, m, ego_only=True).count() == 100
