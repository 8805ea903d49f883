"""The registered queries, each on the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velotrace.functions import kinematics as K
from velotrace.functions import sequence as S
from velotrace.operators import analysis as A
from velotrace.operators import interactions as I
from velotrace.operators import learning as L
from velotrace.operators import maneuvers as M
from velotrace.operators import records as R
from velotrace.operators import windows as W
from velotrace.operators.builder import WindowBuilder
from velotrace.plans import oracles as O
from velotrace.plans.fixtures import LANE_SQL, SIGNAL_SQL, TRAJ_SQL, lanes, regime_sequence, signals, table, trajectories
from velotrace.sources import config as C
from velotrace.sources import tracks as X
from velotrace.sources.storage import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FAMILIES = {"bike_bike": (3, "= 3"), "bike_car": (1, "= 1"), "bike_ped": (2, "= 2")}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def _bikes(spark: SparkSession, sf_dir: str, other: int = 3, d: float = 10.0, **more) -> DataFrame:
    return I.interactions(trajectories(spark, sf_dir), 3, other, d, **more)


def _some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bikes(spark, sf_dir).where("duration > 1")


def _maneuvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bikes(spark, sf_dir, 1).where("duration > 1")
    return found.select(F.col("track_id").alias("ego_id"), "other_id", "t_start", "t_end")


def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.slice_maneuvers(trajectories(spark, sf_dir), _maneuvers(spark, sf_dir)).withColumnRenamed("member_id", "track_id")


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_rows(_slice(spark, sf_dir), W.ID)


def _builder(spark: SparkSession, sf_dir: str) -> WindowBuilder:
    traj = trajectories(spark, sf_dir)
    return WindowBuilder(traj, _maneuvers(spark, sf_dir), lanes=lanes(traj), signals=signals(spark, sf_dir))


def _encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.encounters(trajectories(spark, sf_dir), _maneuvers(spark, sf_dir).withColumnRenamed("ego_id", "track_id"))


T = f"WITH {TRAJ_SQL}"
_TRAJ = ["timestamp", "translation_x", "translation_y", "velocity_x", "velocity_y", "acceleration_x", "acceleration_y", "rotation_z"]


@query("traj_projection", f"{T} SELECT track_id, category, frame, {', '.join(O.R(c, c) for c in _TRAJ)} FROM traj")
def traj_projection(spark, sf_dir):
    return rounded(trajectories(spark, sf_dir).select("track_id", "category", "frame", *_TRAJ))


@query("time_window", f"{T} SELECT track_id, frame, {O.R('translation_x', 'translation_x')}, {O.R('translation_y', 'translation_y')} FROM traj WHERE timestamp BETWEEN 1.99 AND 4.01 AND category IN (1, 3)")
def time_window(spark, sf_dir):
    return rounded(I.time_window(trajectories(spark, sf_dir), 1.99, 4.01).where(F.col("category").isin(1, 3)).select("track_id", "frame", "translation_x", "translation_y"))


@query("time_span", f"{T} SELECT {O.R('min(timestamp)', 't_start')}, {O.R('max(timestamp)', 't_end')} FROM traj WHERE track_id IN (1, 2, 3, 5, 8, 13)")
def time_span(spark, sf_dir):
    return rounded(I.time_span(trajectories(spark, sf_dir), [1, 2, 3, 5, 8, 13]))


@query("track_lifespan", f"{T} SELECT track_id, {O.R('min(timestamp)', 't_first')}, {O.R('max(timestamp)', 't_last')} FROM traj GROUP BY track_id")
def track_lifespan(spark, sf_dir):
    return rounded(I.lifespans(trajectories(spark, sf_dir)))


@query(
    "path_length",
    f"{T}, s AS (SELECT track_id, sqrt((translation_x - lag(translation_x) OVER w) ** 2 + (translation_y - lag(translation_y) OVER w) ** 2) AS d FROM traj WINDOW w AS (PARTITION BY track_id ORDER BY frame)) SELECT track_id, {O.R('sum(d)', 'length')}, count(*) AS n_points FROM s GROUP BY track_id HAVING count(*) > 1",
)
def path_length(spark, sf_dir):
    return rounded(I.path_lengths(trajectories(spark, sf_dir)))


@query("polylines", f"{T}, p AS (SELECT track_id, frame, translation_x AS x, translation_y AS y, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY track_id) AS n FROM traj) SELECT track_id, pos, frame, {O.R('x', 'x')}, {O.R('y', 'y')} FROM p WHERE n > 1")
def polylines(spark, sf_dir):
    points = I.polylines(trajectories(spark, sf_dir)).select("track_id", F.posexplode("points").alias("pos", "point"))
    return rounded(points.select("track_id", F.col("pos").cast("long").alias("pos"), "point.*"))


@query(
    "kinematics",
    f"{T} SELECT track_id, frame, {O.R('sqrt(velocity_x ** 2 + velocity_y ** 2)', 'speed')}, {O.R('sqrt(acceleration_x ** 2 + acceleration_y ** 2)', 'acceleration')}, {O.R('velocity_x * cos(rotation_z) + velocity_y * sin(rotation_z)', 'long_v')}, {O.R('-velocity_x * sin(rotation_z) + velocity_y * cos(rotation_z) + 1e0', 'lat_v1')}, {O.R('acceleration_x * cos(rotation_z) + acceleration_y * sin(rotation_z)', 'long_a')}, {O.R('-acceleration_x * sin(rotation_z) + acceleration_y * cos(rotation_z)', 'lat_a')}, {O.R('10e0 / (sqrt(velocity_x ** 2 + velocity_y ** 2) + 1e-6)', 'headway_10m')} FROM traj",
)
def kinematics(spark, sf_dir):
    v, a, h = (F.col("velocity_x"), F.col("velocity_y")), (F.col("acceleration_x"), F.col("acceleration_y")), F.col("rotation_z")
    return rounded(
        trajectories(spark, sf_dir).select(
            "track_id", "frame", K.speed(*v).alias("speed"), K.acceleration(*a).alias("acceleration"), K.longitudinal(*v, h).alias("long_v"), (K.lateral(*v, h) + 1.0).alias("lat_v1"),
            K.longitudinal(*a, h).alias("long_a"), K.lateral(*a, h).alias("lat_a"), K.time_headway(F.lit(10.0), K.speed(*v)).alias("headway_10m"),
        )
    )


@query("yaw_rate", f"{T} SELECT track_id, frame, {O.R('coalesce((rotation_z - lag(rotation_z) OVER w) / nullif(timestamp - lag(timestamp) OVER w, 0), 0)', 'yaw_rate')} FROM traj WINDOW w AS (PARTITION BY track_id ORDER BY frame)")
def yaw_rate(spark, sf_dir):
    return rounded(A.heading_steps(trajectories(spark, sf_dir)).select("track_id", "frame", "yaw_rate"))


@query("heading_clean", f"{T}, {O.clean('traj', 'h', 'rotation_z_raw', 'heading', 'track_id', 'frame')} SELECT track_id, frame, {O.R('heading', 'heading')} FROM h")
def heading_clean(spark, sf_dir):
    return rounded(S.add_clean_heading(trajectories(spark, sf_dir), "rotation_z_raw", "heading", ["track_id"], "frame").select("track_id", "frame", "heading"))


@query(
    "gaussian_smooth",
    f"{T}, p AS (SELECT track_id, frame, translation_y, velocity_x, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM traj), {O.kernel('k50', 6.25)}, {O.kernel('k20', 2.5)}, {O.smooth('p', 's', [('k50', 'translation_y', 'ys'), ('k20', 'velocity_x', 'vs')], ['track_id'])} SELECT track_id, frame, {O.R('ys', 'y_smooth')}, {O.R('vs', 'v_smooth')} FROM s",
)
def gaussian_smooth(spark, sf_dir):
    df = trajectories(spark, sf_dir).select("track_id", "frame", "translation_y", "velocity_x")
    return rounded(S.smooth(df, {"y_smooth": ("translation_y", 0.5), "v_smooth": ("velocity_x", 0.2)}, ["track_id"], "frame").select("track_id", "frame", "y_smooth", "v_smooth"))


_PF = f"{T}, {O.BIKE_BIKE}, {O.SOME}, {O.pair_frames(0)}"
_PF10 = f"{T}, {O.BIKE_BIKE}, {O.SOME}, {O.pair_frames(10, speeds=False)}"
_KEY = "track_id, other_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end"


@query("lat_long", f"{_PF} SELECT {_KEY}, frame, CAST(i AS INT) AS i, {', '.join(O.R(f'{s}_{c}', f'{s}_{c}') for s in 'ab' for c in ('lat', 'long', 'lat_s', 'long_s', 'heading', 'vlong_s'))} FROM pf")
def lat_long(spark, sf_dir):
    pf = M.smoothed(M.pair_frames(trajectories(spark, sf_dir), _some(spark, sf_dir)))
    return rounded(pf.select(*M.KEYS, "frame", "i", *[f"{s}_{c}" for s in "ab" for c in ("lat", "long", "lat_s", "long_s", "heading", "vlong_s")]))


_CENTRED = "c AS (SELECT track_id, frame, translation_y - avg(translation_y) OVER (PARTITION BY track_id) AS x, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS i FROM traj)"


def _centred(spark, sf_dir) -> DataFrame:
    df = trajectories(spark, sf_dir).select("track_id", "frame", (F.col("translation_y") - F.avg("translation_y").over(Window.partitionBy("track_id"))).alias("x"))
    return df.withColumn("i", (F.row_number().over(S.ordered(["track_id"], "frame")) - 1).cast("long"))


@query("sign_flips", f"{T}, {_CENTRED}, s AS (SELECT *, CASE WHEN x < 0 THEN -1 ELSE 1 END AS s FROM c), l AS (SELECT *, lead(s) OVER (PARTITION BY track_id ORDER BY i) AS nx FROM s) SELECT track_id, i FROM l WHERE nx <> s")
def sign_flips(spark, sf_dir):
    return _centred(spark, sf_dir).withColumn("f", S.flips_after(F.col("x"), ["track_id"], "i")).where("f").select("track_id", "i")


@query(
    "crossings",
    f"{T}, {_CENTRED}, k AS (SELECT *, lag(x) OVER w > 0 AND x < 0 AND min(sign(x)) OVER f = max(sign(x)) OVER f AS hit FROM c WINDOW w AS (PARTITION BY track_id ORDER BY i), f AS (PARTITION BY track_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), h AS (SELECT track_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY track_id ORDER BY i) > 20 THEN 1 ELSE 0 END AS fresh FROM k WHERE hit) SELECT track_id, i, CAST(sum(fresh) OVER (PARTITION BY track_id ORDER BY i) AS BIGINT) AS grp FROM h",
)
def crossings(spark, sf_dir):
    x, key = F.col("x"), ["track_id"]
    hit = _centred(spark, sf_dir).withColumn("hit", S.falls_through_zero(x, key, "i") & S.sign_persists(x, key, "i", 3)).where("hit")
    return hit.select("track_id", "i", F.coalesce(S.session("i", key, 20), F.lit(0)).cast("long").alias("grp"))


@query("true_intervals", f"{T}, b AS (SELECT track_id, frame, acceleration_x > 0 AS ok, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn FROM traj), g AS (SELECT *, rn - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS g FROM b WHERE ok) SELECT track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM g GROUP BY track_id, g")
def true_intervals(spark, sf_dir):
    df = trajectories(spark, sf_dir).withColumn("ok", F.col("acceleration_x") > 0)
    df = df.withColumn("g", S.island(F.col("ok"), ["track_id"], "frame")).where("ok")
    return df.groupBy("track_id", "g").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n")).drop("g")


@query("proximity_pairs", f"{T} SELECT DISTINCT a.track_id, b.track_id AS other_id FROM traj a JOIN traj b ON a.frame = b.frame AND a.track_id <> b.track_id WHERE a.category = 3 AND (a.translation_x - b.translation_x) ** 2 + (a.translation_y - b.translation_y) ** 2 <= 100")
def proximity_pairs(spark, sf_dir):
    traj = trajectories(spark, sf_dir)
    return I.proximity_pairs(traj.where("category = 3"), traj, 10.0)


def _family(name: str, other: int, cond: str, d: float) -> None:
    def run(spark, sf_dir):
        return rounded(_bikes(spark, sf_dir, other, d))

    query(name, f"{T}, {O.interactions(cond, d)} SELECT {O.FOUND} FROM found")(run)


for _name, (_other, _cond) in FAMILIES.items():
    for _d in (5.0, 10.0, 25.0):
        _family(f"interactions_{_name}" + ("" if _d == 10 else f"_{_d:.0f}m"), _other, _cond, _d)


@query("interactions_fov_speed", f"{T}, {O.interactions('= 3', 10, 120, 2.6)} SELECT {O.FOUND} FROM found")
def interactions_fov_speed(spark, sf_dir):
    return rounded(_bikes(spark, sf_dir, 3, 10.0, fov=120.0, min_speed=2.6))


@query("interactions_excluding", f"{T}, {O.interactions('<> 3', 10)} SELECT {O.FOUND} FROM found")
def interactions_excluding(spark, sf_dir):
    traj = trajectories(spark, sf_dir)
    return rounded(I.interactions(traj, 3, None, 10.0, exclude_ids=traj.where("category = 3")))


@query(
    "interaction_families",
    f"{T}, " + ", ".join(O.interactions(c, d, prefix=f"{n}{d:.0f}_") for n, (_, c) in FAMILIES.items() for d in (5.0, 10.0, 25.0)) + " " + " UNION ALL ".join(f"SELECT '{n}' AS family, {d}e0 AS radius, {O.FOUND} FROM {n}{d:.0f}_found" for n in FAMILIES for d in (5.0, 10.0, 25.0)),
)
def interaction_families(spark, sf_dir):
    return rounded(I.interaction_families(trajectories(spark, sf_dir)))


@query(
    "interactions_filtered",
    f"{T}, {O.interactions('IN (1, 3)', 10)}, life AS (SELECT track_id, min(timestamp) AS a, max(timestamp) AS b FROM traj GROUP BY track_id), "
    "ok AS (SELECT f.* FROM found f JOIN life x ON x.track_id = f.track_id JOIN life y ON y.track_id = f.other_id WHERE NOT (dist_mean < 0.5 OR rel_speed = 0) AND dist_min < 20 AND dist_mean < 40 AND rel_heading <= 45 AND least(x.b, y.b) - greatest(x.a, y.a) >= 2.99), "
    "st AS (SELECT k.track_id, k.other_id, k.t_start, k.t_end, t.track_id AS m, sqrt((translation_x - lag(translation_x) OVER w) ** 2 + (translation_y - lag(translation_y) OVER w) ** 2) AS d FROM ok k JOIN traj t ON t.track_id IN (k.track_id, k.other_id) AND t.timestamp BETWEEN k.t_start AND k.t_end WINDOW w AS (PARTITION BY k.track_id, k.other_id, k.t_start, k.t_end, t.track_id ORDER BY frame)), "
    "mv AS (SELECT track_id, other_id, t_start, t_end FROM (SELECT track_id, other_id, t_start, t_end, m, sum(d) AS l FROM st GROUP BY ALL) GROUP BY ALL HAVING count(*) = 2 AND min(l) >= 3.0001) "
    f"SELECT {O.FOUND} FROM ok JOIN mv USING (track_id, other_id, t_start, t_end)",
)
def interactions_filtered(spark, sf_dir):
    traj = trajectories(spark, sf_dir)
    found = I.interactions(traj, 3, 3, 10.0).unionByName(I.interactions(traj, 3, 1, 10.0))
    return rounded(I.filter_interactions(traj, found, min_distance=3.0001, min_overlap=2.99))


@query("unordered_pairs", f"{T}, {O.BIKE_BIKE}, u AS (SELECT *, row_number() OVER (PARTITION BY least(track_id, other_id), greatest(track_id, other_id) ORDER BY t_start, t_end, track_id) AS k FROM found) SELECT {O.FOUND} FROM u WHERE k = 1")
def unordered_pairs(spark, sf_dir):
    return rounded(I.unordered_pairs(_bikes(spark, sf_dir)))


_ALL10 = f"{T}, {', '.join(O.interactions(c, 10, prefix=n + '_') for n, (_, c) in FAMILIES.items())}, fam AS ({' UNION ALL '.join(f'''SELECT '{n}' AS family, * FROM {n}_found''' for n in FAMILIES)})"


def _families10(spark, sf_dir) -> DataFrame:
    return I.interaction_families(trajectories(spark, sf_dir), (10.0,))


@query("interaction_counts", f"{_ALL10} SELECT track_id, count(*) FILTER (WHERE family = 'bike_bike') AS bike_bike, count(*) FILTER (WHERE family = 'bike_car') AS bike_car, count(*) FILTER (WHERE family = 'bike_ped') AS bike_ped, count(*) AS total FROM fam GROUP BY track_id")
def interaction_counts(spark, sf_dir):
    return A.family_counts(_families10(spark, sf_dir), list(FAMILIES))


@query("filter_ranges", f"{_ALL10} SELECT family, {O.FOUND} FROM fam WHERE duration >= 1 AND dist_min <= 5 AND rel_speed BETWEEN 0.5 AND 3 AND duration > 1 AND rel_heading > 0.5")
def filter_ranges(spark, sf_dir):
    return rounded(I.filter_range(_families10(spark, sf_dir).drop("radius"), {"duration": (1.0, None), "dist_min": (None, 5.0), "rel_speed": (0.5, 3.0)}).where("duration > 1 AND rel_heading > 0.5"))


@query("feature_histogram", f"{_ALL10}, b AS (SELECT family, CAST(least(floor(dist_min / (10e0 / 30)), 29) AS INT) AS bin, count(*) AS n FROM fam WHERE dist_min BETWEEN 0 AND 10 GROUP BY ALL) SELECT family, bin, n, {O.R('n / (sum(n) OVER (PARTITION BY family) * (10e0 / 30))', 'density')} FROM b")
def feature_histogram(spark, sf_dir):
    return rounded(A.histogram(_families10(spark, sf_dir), "dist_min", 0.0, 10.0, by=["family"]))


@query(
    "box_stats",
    f"{_ALL10}, q AS (SELECT family, count(*) AS n, avg(rel_speed) AS mean, quantile_cont(rel_speed, 0.25) AS q1, quantile_cont(rel_speed, 0.5) AS median, quantile_cont(rel_speed, 0.75) AS q3 FROM fam GROUP BY family) SELECT family, any_value(q.n) AS n, {O.R('any_value(mean)', 'mean')}, {O.R('min(rel_speed)', 'low')}, {O.R('any_value(q1)', 'q1')}, {O.R('any_value(median)', 'median')}, {O.R('any_value(q3)', 'q3')}, {O.R('max(rel_speed)', 'high')} FROM fam JOIN q USING (family) WHERE rel_speed BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY family",
)
def box_stats(spark, sf_dir):
    return rounded(A.box_statistics(_families10(spark, sf_dir), "rel_speed", ["family"]))


@query("bounding_box", f"{T} SELECT {O.R('min(translation_x) - 10', 'min_x')}, {O.R('max(translation_x) + 10', 'max_x')}, {O.R('min(translation_y) - 10', 'min_y')}, {O.R('max(translation_y) + 10', 'max_y')} FROM traj WHERE timestamp BETWEEN 1.99 AND 4.01")
def bounding_box(spark, sf_dir):
    return rounded(A.bounding_box(I.time_window(trajectories(spark, sf_dir), 1.99, 4.01), 10.0))


@query("following", f"{_PF}, {O.FOLLOWING}")
def following(spark, sf_dir):
    return rounded(M.following(M.smoothed(M.pair_frames(trajectories(spark, sf_dir), _some(spark, sf_dir))), M.JOB))


def _pf10(spark, sf_dir) -> DataFrame:
    return M.smoothed(M.pair_frames(trajectories(spark, sf_dir), _some(spark, sf_dir), 10.0), speeds=False)


@query("overtake_windows", f"{_PF10}, {O.OVERTAKE_WINDOWS} SELECT {_KEY}, CAST(grp AS INT) AS grp, CAST(z AS INT) AS z, CAST(from_i AS INT) AS from_i, CAST(to_i AS INT) AS to_i, pov FROM win")
def overtake_windows(spark, sf_dir):
    return rounded(M.overtake_windows(_pf10(spark, sf_dir)).select(*M.KEYS, F.col("grp").cast("int").alias("grp"), "z", "from_i", "to_i", "pov"))


@query("overtake_thresholds", f"{T}, l AS (SELECT track_id, frame, translation_y AS lat_z FROM traj) SELECT track_id, frame, k AS k, round(ths[k], 6) AS threshold FROM (SELECT *, {O.THRESHOLDS} AS ths FROM l), unnest(generate_series(1, len(ths))) AS u(k)")
def overtake_thresholds(spark, sf_dir):
    df = trajectories(spark, sf_dir).select("track_id", "frame", F.posexplode(M.thresholds(F.col("translation_y"))).alias("k", "threshold"))
    return rounded(df.withColumn("k", (F.col("k") + 1).cast("long")))


@query("overtaking", f"{_PF10}, {O.OVERTAKE_WINDOWS}, {O.OVERTAKING}")
def overtaking(spark, sf_dir):
    return rounded(M.overtaking(_pf10(spark, sf_dir)))


@query("sliding_windows", f"{T}, {O.MANEUVERS}, {O.SLICE}, {O.BOUNDS} SELECT {O.OUT}, f0, f1 FROM bnd")
def sliding_windows(spark, sf_dir):
    spans = _slice(spark, sf_dir).groupBy(*W.ID).agg(F.min("timestamp").alias("first_t"), F.max("timestamp").alias("last_t"))
    return rounded(W.sliding_windows(spans, W.ID))


@query("window_rows", f"WITH {O.WINDOWED} SELECT {O.OUT}, count(*) AS n_rows, count(DISTINCT track_id) AS n_tracks, min(frame) AS first_frame, max(frame) AS last_frame FROM rws GROUP BY {O.M}, w")
def window_rows(spark, sf_dir):
    rows = _windowed(spark, sf_dir).groupBy(*W.ID, "w")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("track_id").alias("n_tracks"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")))


@query("window_stats", O.WINDOW_STATS)
def window_stats(spark, sf_dir):
    df = _windowed(spark, sf_dir).withColumn("speed", K.speed(F.col("velocity_x"), F.col("velocity_y")))
    df, agg = W.statistics("speed", [*W.ID, "w"], df)
    return rounded(df.groupBy(*W.ID, "w").agg(*[a.alias(f"speed_{k}") for k, a in agg.items()]))


@query("riding_features", O.RIDING)
def riding_features(spark, sf_dir):
    return rounded(_builder(spark, sf_dir).riding())


_ENC = f"{T}, {O.MANEUVERS}, {O.ENCOUNTERS}"


@query("encounters", f"{_ENC} SELECT {O.E_KEY}, other_id, category, {O.R('dx', 'dx')}, {O.R('dy', 'dy')}, {O.R('vx', 'vx_rel')}, {O.R('vy', 'vy_rel')}, {O.R('velocity', 'velocity')}, {O.R('distance', 'distance')} FROM enc")
def encounters(spark, sf_dir):
    return rounded(_encounters(spark, sf_dir))


@query("counts_radius", f"{_ENC}, {O.SAFETY}, {O.FRAME_SAFETY} SELECT {O.E_KEY}, car_count, pedestrian_count, bicycle_count, {O.R('car_count / (pi() * 400)', 'car_density')} FROM fs")
def counts_radius(spark, sf_dir):
    df = W.frame_safety(_encounters(spark, sf_dir), ["ego_id", "t_start", "t_end", "frame"])
    return rounded(df.select("ego_id", "t_start", "t_end", "frame", "car_count", "pedestrian_count", "bicycle_count", K.density(F.col("car_count"), 20.0).alias("car_density")))


@query("ttc_dca", f"{_ENC}, {O.SAFETY}, {O.FRAME_SAFETY} SELECT {O.E_KEY}, " + ", ".join(f"{O.R(f'{c}_min_ttc', f'{c}_min_ttc')}, {O.R(f'{c}_min_dca', f'{c}_min_dca')}, {c}_num_ttc_below_3s" for c in W.CATEGORIES) + " FROM fs")
def ttc_dca(spark, sf_dir):
    df = W.frame_safety(_encounters(spark, sf_dir), ["ego_id", "t_start", "t_end", "frame"])
    return rounded(df.select("ego_id", "t_start", "t_end", "frame", *[f"{c}_{x}" for c in W.CATEGORIES for x in ("min_ttc", "min_dca", "num_ttc_below_3s")]))


@query("drac", f"{_ENC}, {O.SAFETY}, {O.FRAME_SAFETY} SELECT {O.E_KEY}, {', '.join(O.R(f'{c}_max_drac', f'{c}_max_drac') for c in W.CATEGORIES)} FROM fs")
def drac(spark, sf_dir):
    df = W.frame_safety(_encounters(spark, sf_dir), ["ego_id", "t_start", "t_end", "frame"])
    return rounded(df.select("ego_id", "t_start", "t_end", "frame", *[f"{c}_max_drac" for c in W.CATEGORIES]))


@query("traffic_features", O.TRAFFIC)
def traffic_features(spark, sf_dir):
    df = _builder(spark, sf_dir).traffic()
    # Infinity stands for no encounter; the registered result shows 1e9, since it can't be compared rounded.
    return rounded(df.withColumns({f"{c}_min_dca_min": F.when(F.col(f"{c}_min_dca_min") < math.inf, F.col(f"{c}_min_dca_min")).otherwise(1e9) for c in W.CATEGORIES}))


@query("nearest_signal", f"{T}, {SIGNAL_SQL}{O.SIGNALS} SELECT track_id, frame, {', '.join(O.R(f'dist_{k}', f'dist_{k}') for k in W.SIGNAL_RADIUS)} FROM traj LEFT JOIN d_TrafficLight USING (track_id, frame) LEFT JOIN d_RegulatorySign USING (track_id, frame) LEFT JOIN d_WarningSign USING (track_id, frame)")
def nearest_signal(spark, sf_dir):
    return rounded(W.signal_distances(trajectories(spark, sf_dir), signals(spark, sf_dir)))



_LANE_OUT = ("offset_lane_center", "rel_offset_lane_center", "rel_position_lane", "min_lateral_clearance", "max_lateral_clearance")


@query("lane_features", f"{T}, {LANE_SQL}, {O.LANES} SELECT track_id, frame, on_bikelane, on_sidewalk, on_motorway, {', '.join(O.R(c, c) for c in _LANE_OUT)} FROM lc")
def lane_features(spark, sf_dir):
    return rounded(W.lane_columns(lanes(trajectories(spark, sf_dir))).select("track_id", "frame", "on_bikelane", "on_sidewalk", "on_motorway", *_LANE_OUT))


_GAP = "CASE WHEN frame % 7 NOT IN (0, 1, 2) THEN lane_type END"
_NEAR = "coalesce(g, lag(g, 1) OVER w, lead(g, 1) OVER w, lag(g, 2) OVER w, lead(g, 2) OVER w)"


@query("lane_gap_fill", f"{T}, {LANE_SQL}, h AS (SELECT track_id, frame, {_GAP} AS g FROM lane) SELECT track_id, frame, {_NEAR} AS lane_type FROM h WINDOW w AS (PARTITION BY track_id ORDER BY frame)")
def lane_gap_fill(spark, sf_dir):
    holes = lanes(trajectories(spark, sf_dir)).select("track_id", "frame", F.when(~(F.col("frame") % 7).isin(0, 1, 2), F.col("lane_type")).alias("lane_type"))
    return W.fill_lane_gaps(holes, ["lane_type"])


@query("infrastructure_features", O.INFRA)
def infrastructure_features(spark, sf_dir):
    return rounded(_builder(spark, sf_dir).infrastructure())


@query("regime_aggregation", O.REGIMES)
def regime_aggregation(spark, sf_dir):
    return rounded(W.aggregate_regimes(regime_sequence(spark, sf_dir).withColumn("volatile", F.col("local_regime") == 1)))


_DIMS = [f"e{k}" for k in range(64)]
_EMB = f"WITH x AS (SELECT vec_id, label, {', '.join(f'CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}' for k in range(64))} FROM embeddings)"


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)])


def _long(more: str = "") -> str:
    """CTE of the embeddings' components (vec_id, d, v), d from 0; `more` adds derived ones."""
    return f"l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings{more})"


_DERIVED = " UNION ALL SELECT vec_id, 64 AS d, CAST(embedding[1] AS DOUBLE) * 2 + 0.001e0 * CAST(embedding[2] AS DOUBLE) AS v FROM embeddings"
_CORR = "c AS (SELECT a.d AS i, b.d AS j, corr(a.v, b.v) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.d < b.d GROUP BY ALL)"
#: The diagonal of the inverse by sweeps: after all of them the matrix is the inverse's negative.
_VIF = """g AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) AS s FROM kept a JOIN kept b USING (vec_id) GROUP BY ALL),
nr AS (SELECT i, list(s ORDER BY j) AS r FROM g GROUP BY i), g0 AS (SELECT list(r ORDER BY i) AS m, list(i ORDER BY i) AS names, count(*) AS n FROM nr),
sw AS (SELECT 1 AS k, m, m AS g, names, n FROM g0 UNION ALL SELECT k + 1, [[CASE WHEN i = k AND j = k THEN -1 / m[k][k] WHEN i = k OR j = k THEN m[i][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END FOR j IN range(1, n + 1)] FOR i IN range(1, n + 1)], g, names, n FROM sw WHERE k <= n),
v AS (SELECT names[i] AS d, -m[i][i] * g[i][i] AS vif FROM sw, unnest(range(1, n + 1)) AS u(i) WHERE k = n + 1)"""


@query("zscore", f"{_EMB} SELECT vec_id, {', '.join(O.R(f'(e{k} - avg(e{k}) OVER ()) / (CASE WHEN stddev_pop(e{k}) OVER () > 0 THEN stddev_pop(e{k}) OVER () ELSE 1 END)', f'e{k}') for k in range(64))} FROM x")
def zscore(spark, sf_dir):
    return rounded(L.zscore(_embeddings(spark, sf_dir), _DIMS).drop("label"))


@query("corr_pairs", f"WITH {_long()}, {_CORR} SELECT 'e' || i AS a, 'e' || j AS b, {O.R('r', 'corr')} FROM c")
def corr_pairs(spark, sf_dir):
    return rounded(L.correlations(_embeddings(spark, sf_dir), _DIMS))


@query("vif", f"WITH RECURSIVE {_long()}, kept AS (SELECT * FROM l), {_VIF} SELECT 'e' || d AS feature, round(vif, 4) AS vif FROM v")
def vif(spark, sf_dir):
    found = L.vif(_embeddings(spark, sf_dir), _DIMS)
    return rounded(spark.createDataFrame(list(found.items()), "feature string, vif double"), 4)


@query("feature_selection", f"WITH RECURSIVE {_long(_DERIVED)}, {_CORR}, gone AS (SELECT DISTINCT j FROM c WHERE abs(r) > 0.9), kept AS (SELECT * FROM l WHERE d NOT IN (SELECT j FROM gone)), {_VIF} SELECT 'e' || x.d AS feature, coalesce(v.vif > 5, true) AS dropped FROM (SELECT DISTINCT d FROM l) x LEFT JOIN v USING (d)")
def feature_selection(spark, sf_dir):
    names = [*_DIMS, "e64"]
    df = _embeddings(spark, sf_dir).withColumn("e64", F.col("e0") * 2 + 0.001 * F.col("e1"))
    dropped = L.select_features(df, names)
    return spark.createDataFrame([(c, c in dropped) for c in names], "feature string, dropped boolean")


@query("pca_variance")
def pca_variance(spark, sf_dir):
    r = L.Reducer(_DIMS).fit(L.zscore(_embeddings(spark, sf_dir), _DIMS))
    return rounded(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(r.explained)], "component int, variance double"), 4)


def _vectors(spark, sf_dir) -> DataFrame:
    df, _ = L.feature_matrix(L.zscore(_embeddings(spark, sf_dir), _DIMS), _DIMS)
    return df.select(F.col("vec_id").alias("id"), "label", "features")


@query("kmeans_sizes")
def kmeans_sizes(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    model = L.kmeans(df, 4)
    return L.cluster_sizes(model.transform(df).select(F.col("prediction").alias("label")))


@query("auto_k")
def auto_k(spark, sf_dir):
    best, costs, scores = L.auto_k(_vectors(spark, sf_dir), range(2, 6))
    return rounded(spark.createDataFrame([(k, float(c), float(s), k == best) for k, c, s in zip(range(2, 6), costs, scores)], "k int, cost double, silhouette double, chosen boolean"), 4)


@query("stability")
def stability(spark, sf_dir):
    return rounded(spark.createDataFrame(L.stability(_vectors(spark, sf_dir), 3, runs=30), "metric string, median double, p10 double, p90 double"), 4)


#: Of each track the mean speed along x: five values, far apart, whatever the table's size.
_SPEEDS = f"{T}, x AS (SELECT track_id, track_id % 5 AS label, avg(velocity_x) AS v FROM traj GROUP BY track_id)"


def _speeds(spark, sf_dir) -> DataFrame:
    df = trajectories(spark, sf_dir).groupBy(F.col("track_id").alias("id")).agg(F.avg("velocity_x").alias("v"))
    return L.feature_matrix(df, ["v"])[0].select("id", "features")


@query("kmeans_speeds", f"{_SPEEDS}, c AS (SELECT label, count(*) AS n, avg(v) AS c, sum((v - m) ** 2) AS cost FROM x JOIN (SELECT label, avg(v) AS m FROM x GROUP BY label) USING (label) GROUP BY label) SELECT n, {O.R('c', 'center', 4)}, {O.R('sum(cost) OVER ()', 'cost', 4)} FROM c")
def kmeans_speeds(spark, sf_dir):
    """Where the best clusters are known, k-means finds them: members, centres and cost."""
    df = _speeds(spark, sf_dir)
    model = L.kmeans(df, 5)
    sizes = model.transform(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    centers = spark.createDataFrame([(k, float(c[0])) for k, c in enumerate(model.centers)], "prediction int, center double")
    return rounded(sizes.join(F.broadcast(centers), "prediction").select("n", "center", F.lit(model.cost).alias("cost")), 4)


@query(
    "auto_k_speeds",
    f"{_SPEEDS}, d AS (SELECT a.track_id, a.label AS la, b.label AS lb, sum(abs(a.v - b.v)) AS d, count(*) AS n FROM x a CROSS JOIN x b GROUP BY ALL), p AS (SELECT track_id, max(d / nullif(n - 1, 0)) FILTER (WHERE la = lb) AS a, min(d / n) FILTER (WHERE la <> lb) AS b FROM d GROUP BY track_id) "
    f"SELECT 5 AS best_silhouette_k, {O.R('avg((b - a) / greatest(a, b))', 'silhouette', 4)} FROM p",
)
def auto_k_speeds(spark, sf_dir):
    """The number of clusters with the best silhouette, and that silhouette."""
    _, _, scores = L.auto_k(_speeds(spark, sf_dir), range(2, 8))
    best = max(range(len(scores)), key=scores.__getitem__)
    return rounded(spark.createDataFrame([(best + 2, float(scores[best]))], "best_silhouette_k int, silhouette double"), 4)


@query("stability_speeds", "SELECT * FROM (VALUES ('ari_subsample', 1e0, 1e0, 1e0), ('ari_seed', 1e0, 1e0, 1e0), ('ari_noise', 1e0, 1e0, 1e0)) AS t(metric, median, p10, p90)")
def stability_speeds(spark, sf_dir):
    """Clusters that are far apart stay the same under subsamples, seeds and noise."""
    return rounded(spark.createDataFrame(L.stability(_speeds(spark, sf_dir), 5), "metric string, median double, p10 double, p90 double"), 4)


@query(
    "pca_moments",
    f"WITH {_long()}, c AS (SELECT a.d AS i, b.d AS j, corr(a.v, b.v) AS r FROM l a JOIN l b USING (vec_id) GROUP BY ALL), s AS (SELECT a.i, b.j, sum(a.r * b.r) AS r FROM c a JOIN c b ON a.j = b.i GROUP BY ALL) "
    "SELECT 64 AS components, round(1e0, 8) AS p1, (SELECT round(sum(r * r) / 64e0 ** 2, 8) FROM c) AS p2, (SELECT round(sum(s.r * c.r) / 64e0 ** 3, 8) FROM s JOIN c ON s.i = c.i AND s.j = c.j) AS p3, (SELECT round(sum(r * r) / 64e0 ** 4, 8) FROM s) AS p4",
)
def pca_moments(spark, sf_dir):
    """Sums of powers of the components' shares, which are those of the correlation matrix's eigenvalues, found without eigenvalues in SQL."""
    shares = L.Reducer(_DIMS, 1.0).fit(L.zscore(_embeddings(spark, sf_dir), _DIMS)).explained
    return rounded(spark.createDataFrame([(len(shares), *(float((shares**p).sum()) for p in (1, 2, 3, 4)))], "components int, p1 double, p2 double, p3 double, p4 double"), 8)


@query("pca_scores", "SELECT unnest(generate_series(1, 64)) AS component, 0e0 AS mean, 0e0 AS share_off, 0e0 AS most_correlated")
def pca_scores(spark, sf_dir):
    """Of each component's scores: mean zero, variance as its share says, no correlation with any other's."""
    z = L.zscore(_embeddings(spark, sf_dir), _DIMS)
    r = L.Reducer(_DIMS, 1.0).fit(z)
    names = [f"pc{k + 1}" for k in range(r.k)]
    sums = L.cross_sums(r.transform(z).select(*names), names)
    some = sums.groupBy("i").agg(F.max(F.when(F.col("i") == F.col("j"), F.col("x") / F.col("n"))).alias("mean"), F.max(F.when(F.col("i") == F.col("j"), F.col("xx") / F.col("n") / 64)).alias("share"), F.max(F.when(F.col("i") != F.col("j"), F.abs(F.col("xy") / F.col("n")))).alias("most"))
    shares = F.array(*[F.lit(float(x)) for x in r.explained])
    return some.select((F.col("i") + 1).alias("component"), *[(F.round(c, 5) + 0.0).alias(n) for c, n in ((F.abs("mean"), "mean"), (F.abs(F.col("share") - shares[F.col("i")]), "share_off"), (F.col("most"), "most_correlated"))])


_DIST = "sqrt(" + " + ".join(f"(a.e{k} - b.e{k}) ** 2" for k in range(64)) + ")"


@query(
    "silhouette",
    f"{_EMB}, s AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum({_DIST}) AS d, count(*) AS n FROM x a CROSS JOIN x b GROUP BY ALL), p AS (SELECT vec_id, la AS label, max(d / nullif(n - 1, 0)) FILTER (WHERE la = lb) AS a, min(d / n) FILTER (WHERE la <> lb) AS b FROM s GROUP BY vec_id, la) SELECT vec_id, label, {O.R('CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END', 's')} FROM p",
)
def silhouette(spark, sf_dir):
    df = _embeddings(spark, sf_dir).select("vec_id", "label", F.array(*_DIMS).alias("v"))
    return rounded(L.silhouette(df, key="vec_id").select("vec_id", "label", "s"))


_C = ", ".join(f"avg(e{k}) AS c{k}" for k in range(64))


@query(
    "ch_db",
    f"{_EMB}, c AS (SELECT label, count(*) AS n, {_C} FROM x GROUP BY label), g AS (SELECT count(*) AS total, {_C.replace(' AS c', ' AS g')} FROM x), "
    f"f AS (SELECT label, n, {' + '.join(f'(e{k} - c{k}) ** 2' for k in range(64))} AS d2 FROM x JOIN c USING (label)), w AS (SELECT label, sum(d2) AS w, avg(sqrt(d2)) AS s FROM f GROUP BY label), "
    f"r AS (SELECT a.label, max((wa.s + wb.s) / sqrt({' + '.join(f'(a.c{k} - b.c{k}) ** 2' for k in range(64))})) AS r FROM c a JOIN c b ON a.label <> b.label JOIN w wa ON wa.label = a.label JOIN w wb ON wb.label = b.label GROUP BY a.label), "
    f"bt AS (SELECT sum(n * ({' + '.join(f'(c{k} - g{k}) ** 2' for k in range(64))})) AS b, count(*) AS k, max(total) AS total FROM c CROSS JOIN g) "
    f"SELECT {O.R('(b / (k - 1)) / ((SELECT sum(w) FROM w) / (total - k))', 'calinski_harabasz')}, {O.R('(SELECT avg(r) FROM r)', 'davies_bouldin')}, k AS n_clusters FROM bt",
)
def ch_db(spark, sf_dir):
    return rounded(L.calinski_davies(_embeddings(spark, sf_dir), _DIMS))


@query("ari", "WITH x AS (SELECT label AS p, label // 2 AS q FROM embeddings), c AS (SELECT p, q, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY p)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY q)) SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s, a, b")
def ari(spark, sf_dir):
    return rounded(L.adjusted_rand(table(spark, sf_dir, "embeddings").selectExpr("label AS p", "CAST(floor(label / 2) AS INT) AS q"), "p", "q"))


@query(
    "regime_map",
    f"{_EMB}, c AS (SELECT label AS cluster_id, (avg(e0) + avg(e1) + avg(e2)) / 3 AS v FROM x GROUP BY label) SELECT cluster_id, CASE WHEN cluster_id = (SELECT arg_max(cluster_id, (v, -cluster_id)) FROM c) THEN 'volatile' WHEN cluster_id = (SELECT arg_min(cluster_id, (v, cluster_id)) FROM c) THEN 'stable' END AS regime FROM c",
)
def regime_map(spark, sf_dir):
    centers = _embeddings(spark, sf_dir).groupBy(F.col("label").alias("cluster_id")).agg(F.avg("e0").alias("speed_std"), F.avg("e1").alias("acc_mad"), F.avg("e2").alias("acc_qcv"), F.avg("e3").alias("speed_max"))
    return W.regime_map(centers, centers.columns)


@query("regimes_of_windows", O.REGIMES.replace(O.REGIME_SQL, f"ride AS ({O.RIDING}), seq AS (SELECT concat_ws(':', ego_id, other_id, CAST(round_even(t_start / 0.08e0, 0) AS BIGINT)) AS maneuver_id, w, CAST(acc_std > 0.25 AS INT) AS local_regime FROM ride)"))
def regimes_of_windows(spark, sf_dir):
    """Riding windows to regimes by a limit on one feature, aggregated for each maneuver."""
    df = _builder(spark, sf_dir).riding()
    key = F.concat_ws(":", "ego_id", "other_id", F.rint(F.col("t_start") / 0.08).cast("long"))
    return rounded(W.aggregate_regimes(df.select(key.alias("maneuver_id"), "w", (F.col("acc_std") > 0.25).alias("volatile"))))


@query("window_regimes")
def window_regimes(spark, sf_dir):
    """Riding windows to regimes to one aggregation per maneuver: matrix, scaling, PCA, two clusters, mapping, sequence."""
    features = _builder(spark, sf_dir).riding()
    names = [c for c in features.columns if c not in (*W.ID, "w")]
    pipeline = L.ClusteringPipeline(names, 2, L.Reducer(names, 0.8))
    labelled = pipeline.run(features)
    mapping = W.regime_map(pipeline.centers(spark), names)
    regimes = labelled.join(F.broadcast(mapping), "cluster_id").select(F.struct(*W.ID).alias("maneuver_id"), "w", (F.col("regime") == "volatile").alias("volatile"))
    return rounded(W.aggregate_regimes(regimes).select("maneuver_id.*", "*").drop("maneuver_id"))


def _simplified(tolerance: float) -> str:
    """CTEs ending in kept (track_id, a, b): stretches of each track's points that stay one segment, halved at the farthest point until none is."""
    return f"""p AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS i, translation_x AS x, translation_y AS y FROM traj),
st AS (SELECT track_id, CAST(0 AS BIGINT) AS a, max(i) AS b, false AS done FROM p GROUP BY track_id HAVING max(i) > 0 UNION ALL
  SELECT track_id, u.s.a, u.s.b, u.s.done FROM (SELECT track_id, a, b, max(d2) AS m, arg_max(i, (d2, -i)) AS f FROM (
    SELECT track_id, a, b, i, (px - t * dx) ** 2 + (py - t * dy) ** 2 AS d2 FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS t FROM (
      SELECT st.track_id, st.a, st.b, q.i, e.x - o.x AS dx, e.y - o.y AS dy, q.x - o.x AS px, q.y - o.y AS py FROM st JOIN p o ON o.track_id = st.track_id AND o.i = st.a JOIN p e ON e.track_id = st.track_id AND e.i = st.b LEFT JOIN p q ON q.track_id = st.track_id AND q.i > st.a AND q.i < st.b WHERE NOT st.done)))
    GROUP BY track_id, a, b), unnest(CASE WHEN m > {tolerance}e0 * {tolerance}e0 THEN [{{'a': a, 'b': f, 'done': false}}, {{'a': f, 'b': b, 'done': false}}] ELSE [{{'a': a, 'b': b, 'done': true}}] END) AS u(s)),
kept AS (SELECT k.track_id, a, b, o.x AS x0, o.y AS y0, e.x AS x1, e.y AS y1 FROM st k JOIN p o ON o.track_id = k.track_id AND o.i = a JOIN p e ON e.track_id = k.track_id AND e.i = b WHERE done)"""


def _mean_segments(tolerance: float) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {TRAJ_SQL}, {_simplified(tolerance)} SELECT {tolerance}e0 AS tolerance, round(count(*) / count(DISTINCT track_id), 6) AS segments, {O.R('avg(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2))', 'length')} FROM kept)"


@query("simplify_segments", f"WITH RECURSIVE {TRAJ_SQL}, {_simplified(0.1)} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY a) - 1 AS segment, {', '.join(O.R(c, c) for c in ('x0', 'y0', 'x1', 'y1'))} FROM kept")
def simplify_segments(spark, sf_dir):
    return rounded(A.simplify_tracks(trajectories(spark, sf_dir), 0.1))


@query("simplification_sweep", " UNION ALL ".join(_mean_segments(t) for t in (0.05, 0.1, 0.5)))
def simplification_sweep(spark, sf_dir):
    return rounded(A.simplification_sweep(trajectories(spark, sf_dir), [0.05, 0.1, 0.5]))


_SHOWN = {"r": ("ride", ("speed_mean", "acc_std", "rot_fluc_mad")), "t": ("env", ("car_count_mean", "bicycle_min_ttc_min")), "i": ("infra", ("lane_width", "distance_traffic_light"))}


@query(
    "window_records",
    "SELECT ego_id, other_id, t_start, t_end, w, round(f0 * 0.08, 6) AS win_start, round(f1 * 0.08, 6) AS win_end, "
    + ", ".join(f"{a}.{c} AS {p}_{c}" for a, (p, cs) in _SHOWN.items() for c in cs)
    + f" FROM ({T}, {O.MANEUVERS}, {O.SLICE}, {O.BOUNDS} SELECT {O.OUT}, f0, f1 FROM bnd) b "
    + " ".join(f"LEFT JOIN ({sql}) {a} USING (ego_id, other_id, t_start, t_end, w)" for a, sql in (("r", O.RIDING), ("t", O.TRAFFIC), ("i", O.INFRA))),
)
def window_records(spark, sf_dir):
    return rounded(R.flat_records(_builder(spark, sf_dir).records()).select(*R.KEYS, "win_start", "win_end", *[f"{p}_{c}" for p, cs in _SHOWN.values() for c in cs]))


@query("windows_grouped", f"{T}, {O.MANEUVERS}, {O.SLICE}, {O.BOUNDS} SELECT {O.OUT.replace(', CAST(w AS INT) AS w', '')}, count(*) AS n_windows, min(f0) AS f_first, max(f1) AS f_last FROM bnd GROUP BY {O.M}")
def windows_grouped(spark, sf_dir):
    spans = _slice(spark, sf_dir).groupBy(*W.ID).agg(F.min("timestamp").alias("first_t"), F.max("timestamp").alias("last_t"))
    grouped = R.group_windows(W.sliding_windows(spans, W.ID), ["f0", "f1"])
    return rounded(grouped.select(*W.ID, F.size("windows").cast("long").alias("n_windows"), F.array_min("windows.f0").alias("f_first"), F.array_max("windows.f1").alias("f_last")))


@query("signal_ecdf", f"{T}, {SIGNAL_SQL}{O.SIGNALS}, v AS (SELECT category, round(dist_TrafficLight, 1) AS d FROM traj JOIN d_TrafficLight USING (track_id, frame) WHERE dist_TrafficLight IS NOT NULL), c AS (SELECT category, d, count(*) AS n FROM v GROUP BY ALL) SELECT category, d AS distance, {O.R('sum(n) OVER (PARTITION BY category ORDER BY d) / sum(n) OVER (PARTITION BY category)', 'share')} FROM c")
def signal_ecdf(spark, sf_dir):
    traj = trajectories(spark, sf_dir)
    near = W.nearest_signal(traj, signals(spark, sf_dir), "TrafficLight", W.SIGNAL_RADIUS["TrafficLight"]).withColumn("distance", F.round("distance", 1))
    return rounded(R.ecdf(traj.select("track_id", "frame", "category").join(near, ["track_id", "frame"]), "distance", ["category"]))


@query("regimes_by_lane", f"{T}, {LANE_SQL}, j AS (SELECT lane_type, category, sqrt(velocity_x ** 2 + velocity_y ** 2) AS v FROM traj JOIN lane USING (track_id, frame)) SELECT lane_type, CAST(category AS VARCHAR) AS category, count(*) AS n, {O.R('avg(v)', 'speed_mean')}, {O.R('stddev_pop(v)', 'speed_std')} FROM j GROUP BY CUBE (lane_type, category)")
def regimes_by_lane(spark, sf_dir):
    traj = trajectories(spark, sf_dir)
    rows = traj.select("track_id", "frame", "category", K.speed(F.col("velocity_x"), F.col("velocity_y")).alias("v")).join(lanes(traj), ["track_id", "frame"])
    return rounded(rows.withColumn("category", F.col("category").cast("string")).cube("lane_type", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("speed_mean"), F.stddev_pop("v").alias("speed_std")))


# Files: each query writes them to the shared folder and reads them back.


@query("tracks_csv", f"{T} SELECT track_id, category, frame, {', '.join(O.R(c, c) for c in _TRAJ)} FROM traj")
def tracks_csv(spark, sf_dir):
    """Two folders of CSV files with columns in another order, columns that aren't wanted and rows twice, read as one table."""
    path, traj = scratch_path(spark, "tracks"), trajectories(spark, sf_dir)
    some = traj.select("rotation_z", "category", *[c for c in _TRAJ if c != "rotation_z"], "track_id", F.lit(1.5).alias("dimension_z"), F.lit(False).alias("interpolated"))
    X.write_tracks(some.where("track_id % 2 = 0"), f"{path}/day=1")
    X.write_tracks(some.where("track_id % 2 = 1").unionByName(some.where("track_id % 6 = 1")), f"{path}/day=2")
    found = X.read_tracks(spark, f"{path}/day=*")
    return rounded(found.select("track_id", "category", "frame", *_TRAJ))


@query("metadata_json", "SELECT * FROM (VALUES ('bicycle', 3), ('car', 1), ('pedestrian', 2)) AS t(name, code)")
def metadata_json(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    spark.createDataFrame([('{"site": "x",\n "categories": {"car": 1,\n "pedestrian": 2, "bicycle": 3}}',)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame(list(X.read_metadata(spark, path).items()), "name string, code int")


@query("interactions_csv", f"{T}, {O.BIKE_BIKE} SELECT {O.FOUND} FROM found")
def interactions_csv(spark, sf_dir):
    path = scratch_path(spark, "interactions")
    X.write_interactions(_bikes(spark, sf_dir), path)
    return rounded(X.read_interactions(spark, path))


@query("interactions_lists", f"{T}, {O.BIKE_BIKE} SELECT {O.FOUND} FROM found")
def interactions_lists(spark, sf_dir):
    """Gzipped JSON arrays, one in each file."""
    path = scratch_path(spark, "lists")
    X.write_lists(_bikes(spark, sf_dir), path)
    return rounded(X.read_records(spark, path, X.INTERACTION, array=True))


@query("load_or_process", f"{T}, {O.BIKE_BIKE} SELECT {O.FOUND} FROM found")
def load_or_process(spark, sf_dir):
    """The second call reads what the first has written."""
    path = scratch_path(spark, "kept")
    X.load_or_process(spark, path, lambda: _bikes(spark, sf_dir))
    return rounded(X.load_or_process(spark, path, lambda: spark.createDataFrame([], X.INTERACTION)))


_FOLLOWING_FEATURES = [f.name for f in X.FOLLOWING_FEATURES]
_OVERTAKING_FEATURES = [f.name for f in X.OVERTAKING_FEATURES]


def _with_features(df: DataFrame, schema) -> DataFrame:
    """Maneuvers in the form of their files: features in a struct, what is missing null."""
    features = schema["features"].dataType
    return df.select(*[F.struct(*features.names).alias("features") if f.name == "features" else (F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)) for f in schema])


@query("following_files", f"WITH f AS ({_PF}, {O.FOLLOWING}) SELECT row_number() OVER (ORDER BY ego_id, other_id, t_start, t_end, {', '.join(_FOLLOWING_FEATURES)}) - 1 AS id, * FROM f")
def following_files(spark, sf_dir):
    """Following maneuvers with ids, as gzipped JSON with nested features, read back flat."""
    path = scratch_path(spark, "following")
    X.write_records(_with_features(M.with_ids(following(spark, sf_dir)), X.FOLLOWING), path)
    found = X.read_records(spark, path, X.FOLLOWING)
    return rounded(found.select("id", *W.ID, "duration", *[F.col(f"features.{c}").alias(c) for c in _FOLLOWING_FEATURES]))


@query("overtaking_files", f"WITH o AS ({_PF10}, {O.OVERTAKE_WINDOWS}, {O.OVERTAKING}) SELECT row_number() OVER (ORDER BY ego_id, other_id, t_start NULLS FIRST, t_end NULLS FIRST, duration NULLS FIRST, t_cross) - 1 AS id, * FROM o")
def overtaking_files(spark, sf_dir):
    path = scratch_path(spark, "overtaking")
    found = overtaking(spark, sf_dir).select(*W.ID, "duration", "t_cross", *_OVERTAKING_FEATURES)
    X.write_records(_with_features(M.with_ids(found), X.OVERTAKING), path)
    back = X.read_records(spark, path, X.OVERTAKING)
    return rounded(back.select("id", *W.ID, "duration", "t_cross", *[F.col(f"features.{c}").alias(c) for c in _OVERTAKING_FEATURES]))


@query("maneuvers_csv", f"WITH f AS ({_PF}, {O.FOLLOWING}) SELECT DISTINCT ego_id, other_id, " + ", ".join(f"round_even({c}, 3) AS {c}" for c in ("t_start", "t_end", "duration")) + ", " + ", ".join(f"round_even({c}, 3) AS features_{c}" for c in _FOLLOWING_FEATURES) + " FROM f")
def maneuvers_csv(spark, sf_dir):
    """Maneuvers once each, flat, rounded to three digits."""
    path = scratch_path(spark, "maneuvers")
    found = following(spark, sf_dir).select(*W.ID, "duration", F.struct(*_FOLLOWING_FEATURES).alias("features"))
    X.write_maneuvers_csv(found.unionByName(found), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(c).cast("long" if c in ("ego_id", "other_id") else "double").alias(c) for c in back.columns])


_RECORDS = ORACLES["window_records"].replace("SELECT ego_id, other_id, t_start, t_end, w,", "SELECT ego_id, other_id, w,", 1)


@query("window_files", _RECORDS)
def window_files(spark, sf_dir):
    """Window records as gzipped JSON, two kinds of features in one half, and a third that is missing in the other."""
    path, b = scratch_path(spark, "records"), _builder(spark, sf_dir)
    records = b.records().select(F.struct(F.col("other_id").alias("maneuver_id"), F.lit("interaction").alias("maneuver_type"), "ego_id").alias("meta"), F.col("win_start").alias("t_start"), F.col("win_end").alias("t_end"), "riding", "traffic", "infrastructure", F.col("w").cast("int").alias("local_regime"))
    infinite = records.schema["traffic"].dataType.names
    finite = F.struct(*[F.when(F.abs(F.col(f"traffic.{c}")) < math.inf, F.col(f"traffic.{c}")).alias(c) for c in infinite])
    X.write_records(records.withColumn("traffic", F.when(F.col("traffic").isNotNull(), finite)), path)
    back = X.read_records(spark, path, X.WINDOW)
    flat = X.flatten(back, {n: p for n, p in R.PREFIX.items()})
    return rounded(flat.select(F.col("meta.ego_id").alias("ego_id"), F.col("meta.maneuver_id").alias("other_id"), F.col("local_regime").alias("w"), F.col("t_start").alias("win_start"), F.col("t_end").alias("win_end"), *[f"{p}_{c}" for p, cs in _SHOWN.values() for c in cs]))


@query("config", "SELECT * FROM (VALUES ('map.offset_x', '692009.0'), ('map.offset_y', '5338095.0'), ('paths.map', '/data/raw/map/site.xodr'), ('paths.raw', '/data/raw')) AS t(name, value)")
def config(spark, sf_dir):
    text = "paths:\n  raw: ${env.DATA_ROOT}/raw\n  map: ${paths.raw}/map/site.xodr\n\nmap:\n  offset_x: 692009.0  # metres\n  offset_y: 5338095.0\n"
    found = C.flat(C.parse_config(text, {"DATA_ROOT": "/data"}))
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "name string, value string")


# More operators.


@query("switch_points", f"{T}, {_CENTRED}, k AS (SELECT *, lag(x) OVER w > 0 AND x < 0 AND min(sign(x)) OVER f = max(sign(x)) OVER f AS hit, coalesce(sum(CAST(x < 0 AS INT)) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS score FROM c WINDOW w AS (PARTITION BY track_id ORDER BY i), f AS (PARTITION BY track_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), h AS (SELECT track_id, i, score, CASE WHEN i - lag(i) OVER (PARTITION BY track_id ORDER BY i) > 20 THEN 1 ELSE 0 END AS fresh FROM k WHERE hit), g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY track_id ORDER BY i) AS BIGINT) AS grp FROM h) SELECT track_id, grp, arg_max(i, (score, -i)) AS i FROM g GROUP BY track_id, grp")
def switch_points(spark, sf_dir):
    return M.switch_points(crossings(spark, sf_dir), _centred(spark, sf_dir), "x", ["track_id"])


@query("following_compat", f"{_PF}, " + O.FOLLOWING.replace("parted AS (", "parted0 AS (").replace("FROM cutr WHERE NOT fl),", "FROM cutr WHERE NOT fl), parted1 AS (SELECT *, max(i) OVER (PARTITION BY track_id, other_id, t_start, t_end, part) AS e FROM parted0), parted AS (SELECT * EXCLUDE (af), avg(a_long_s) OVER (PARTITION BY track_id, other_id, t_start, t_end, part) > 0 AS af FROM parted1 WHERE i < e),"))
def following_compat(spark, sf_dir):
    return rounded(M.following(M.smoothed(M.pair_frames(trajectories(spark, sf_dir), _some(spark, sf_dir))), M.JOB, compat=True))


_ROAD = "CASE WHEN frame % 7 NOT IN (0, 1, 2) THEN lane_type END"


def _roads(spark, sf_dir) -> DataFrame:
    """Lanes with an angle, without every third of seven frames, and some rows twice with another width."""
    traj = trajectories(spark, sf_dir)
    rows = lanes(traj).join(traj.select("track_id", "frame", "event_id"), ["track_id", "frame"]).where("frame % 7 NOT IN (0, 1, 2)").withColumn("lane_angle", F.expr("(event_id % 7 - 3) * 0.1e0"))
    cols = ["track_id", "frame", "lane_type", "lane_width", "inner_dist", "outer_dist", "lane_angle"]
    return rows.select(*cols).unionByName(rows.where("event_id % 10 = 0").withColumn("lane_width", F.col("lane_width") + 1).select(*cols))


def _near(c: str) -> str:
    return f"CASE WHEN lane_type IS NOT NULL THEN {c} WHEN lag(lane_type, 1) OVER w IS NOT NULL THEN lag({c}, 1) OVER w WHEN lead(lane_type, 1) OVER w IS NOT NULL THEN lead({c}, 1) OVER w WHEN lag(lane_type, 2) OVER w IS NOT NULL THEN lag({c}, 2) OVER w ELSE lead({c}, 2) OVER w END"


@query(
    "basic_infrastructure",
    f"{T}, {LANE_SQL}, r AS (SELECT l.*, (event_id % 7 - 3) * 0.1e0 AS lane_angle FROM lane l JOIN traj USING (track_id, frame) WHERE frame % 7 NOT IN (0, 1, 2)), j AS (SELECT t.*, r.* EXCLUDE (track_id, frame) FROM traj t LEFT JOIN r USING (track_id, frame)), "
    f"f AS (SELECT track_id, frame, translation_x + 692009e0 AS abs_x, translation_y + 5338095e0 AS abs_y, velocity_x, velocity_y, {O.WRAP('rotation_z')} AS h, {_near('lane_type')} AS lane_type, {_near('lane_width')} AS lane_width, {_near('lane_angle')} AS lane_angle FROM j WINDOW w AS (PARTITION BY track_id ORDER BY frame)) "
    f"SELECT track_id, frame, {O.R('abs_x', 'abs_x')}, {O.R('abs_y', 'abs_y')}, {O.R('sqrt(velocity_x ** 2 + velocity_y ** 2)', 'velocity')}, lane_type, lane_width, {O.R(O.WRAP('h - lane_angle'), 'heading_deviation')} FROM f WHERE abs_x BETWEEN 692009e0 AND 712009e0 AND abs_y BETWEEN 5338094e0 AND 5338098e0",
)
def basic_infrastructure(spark, sf_dir):
    found = W.basic_infrastructure(trajectories(spark, sf_dir), _roads(spark, sf_dir), 692009.0, 5338095.0, (692009.0, 712009.0, 5338094.0, 5338098.0))
    return rounded(found.select("track_id", "frame", "abs_x", "abs_y", "velocity", "lane_type", "lane_width", "heading_deviation"))


@query("feature_adapter", "SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{k + 1}] AS DOUBLE), 6) AS e{k}" for k in range(64) if k != 3) + " FROM embeddings")
def feature_adapter(spark, sf_dir):
    """Features to vectors and back, one left out."""
    adapter = L.FeatureAdapter(_DIMS, exclude=("e3",))
    vectors = adapter.to_vector(_embeddings(spark, sf_dir)).select("vec_id", "features")
    return rounded(adapter.from_vector(vectors).select("vec_id", "struct.*"))


@query("maneuver_matrix", f"WITH agg AS ({O.REGIMES}), p AS ({ORACLES['path_length']}) SELECT maneuver_id, length, n_points, p_volatile, transition_rate, mean_run_volatile FROM agg JOIN p ON maneuver_id = track_id")
def maneuver_matrix(spark, sf_dir):
    """Features of maneuvers beside their regimes', as columns of one matrix."""
    found = I.path_lengths(trajectories(spark, sf_dir)).withColumnRenamed("track_id", "maneuver_id")
    regimes = W.aggregate_regimes(regime_sequence(spark, sf_dir).withColumn("volatile", F.col("local_regime") == 1))
    matrix, names = R.maneuver_matrix(found, regimes, ["length", "n_points"], exclude=("n_windows", "is_active", "std_run_volatile", "mean_volatile_gap"), on=["maneuver_id"])
    return rounded(matrix.select("maneuver_id", *names))


@query("describe_interactions", f"{T}, {O.BIKE_BIKE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, {O.R(f'avg({c})', 'mean')}, {O.R(f'stddev_samp({c})', 'std')}, {O.R(f'min({c})', 'min')}, {O.R(f'quantile_cont({c}, 0.25)', 'q1')}, {O.R(f'quantile_cont({c}, 0.5)', 'median')}, {O.R(f'quantile_cont({c}, 0.75)', 'q3')}, {O.R(f'max({c})', 'max')} FROM found" for c in ("duration", "dist_min", "rel_speed")))
def describe_interactions(spark, sf_dir):
    return rounded(A.describe(_bikes(spark, sf_dir), ["duration", "dist_min", "rel_speed"]))


@query("feature_scatter", f"{_ALL10} SELECT family, duration, dist_min FROM fam WHERE duration >= 0 AND rel_heading <= 45")
def feature_scatter(spark, sf_dir):
    some = I.filter_range(_families10(spark, sf_dir), {"duration": (0.0, None), "rel_heading": (None, 45.0)})
    return rounded(A.scatter(some, "duration", "dist_min", ["family"]))
