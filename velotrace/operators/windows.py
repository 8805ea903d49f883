"""Sliding windows over maneuvers, window statistics, riding, traffic and infrastructure features, regimes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotrace.functions import kinematics as K
from velotrace.functions import sequence as S

ID = ["ego_id", "other_id", "t_start", "t_end"]
CATEGORIES = {"car": 1, "pedestrian": 2, "bicycle": 3}
R_SAFE = {"car": 3.5, "pedestrian": 1.2, "bicycle": 1.8}
#: Radius and least speed of counted neighbours.
COUNTED = {"car": (20.0, 5.0), "pedestrian": (5.0, 0.5), "bicycle": (10.0, 2.0)}
TTC_LIMITS = {"1_5": 1.5, "2": 2.0, "3": 3.0}
SIGNAL_RADIUS = {"TrafficLight": 60.0, "RegulatorySign": 30.0, "WarningSign": 20.0}
#: Signals that are broadcast at most; and parts of a cell's rows where there are more.
BROADCAST_SIGNALS, SALTS = 100_000, 32


def sliding_windows(spans: DataFrame, keys: list[str], win_s: float = 1.0, overlap: float = 0.5, fps: float = 12.5) -> DataFrame:
    """keys, w, f0, f1: windows in whole frames over (first_t, last_t) of each row.

    Full windows start at first_t and step on by win_s * (1 - overlap); if the last one ends before last_t, a window
    that ends there follows. Both bounds belong to a window.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    step, dt = win_s * (1 - overlap), 1 / fps
    count = F.greatest(F.floor((F.col("last_t") - F.col("first_t") - win_s + 1e-8) / step).cast("int") + 1, F.lit(0))
    snap = lambda t: F.rint(t / dt).cast("long")
    df = spans.withColumn("count", count).where("count > 0")
    at = lambda k: F.col("first_t") + k * step
    full = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda k: F.struct(k.alias("w"), snap(at(k)).alias("f0"), snap(at(k) + win_s).alias("f1")))
    tail = F.array(F.struct(F.col("count").alias("w"), snap(F.col("last_t") - win_s).alias("f0"), snap(F.col("last_t")).alias("f1")))
    every = F.when(snap(at(F.col("count") - 1) + win_s) < snap(F.col("last_t")), F.concat(full, tail)).otherwise(full)
    return df.select(*keys, F.inline(every))


def window_rows(rows: DataFrame, keys: list[str], win_s: float = 1.0, overlap: float = 0.5, fps: float = 12.5) -> DataFrame:
    """rows with the windows that they fall in (w, f0, f1); a row on a shared bound is in both windows."""
    spans = rows.groupBy(*keys).agg(F.min("timestamp").alias("first_t"), F.max("timestamp").alias("last_t"))
    return rows.join(sliding_windows(spans, keys, win_s, overlap, fps), keys).where("frame BETWEEN f0 AND f1")


def statistics(x: str, keys: list[str], df: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """df with the group's mean of x beside each row, and aggregates min, max, mean, std, mad, cv, qcv, p90, p90_abs, max_abs over it."""
    mean = f"__mean_{x}"
    df = df.withColumn(mean, F.avg(x).over(Window.partitionBy(*keys)))
    q = lambda p: F.percentile(x, p)
    spread = F.abs(q(0.75)) + F.abs(q(0.25))
    every = {
        "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_pop(x), "mad": F.avg(F.abs(F.col(x) - F.col(mean))),
        "cv": F.try_divide(F.stddev_pop(x), F.avg(x)), "qcv": F.when(spread > 1e-8, F.try_divide(q(0.75) - q(0.25), spread)),
        "p90": q(0.9), "p90_abs": F.percentile(F.abs(x), 0.9), "max_abs": F.max(F.abs(x)),
    }
    return df, {k: every[k] for k in names or every}


def rotation_fluctuation(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rot_fluc: the step of the heading (wrapped) less its mean over the five rows around; our own definition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("__step", F.coalesce(K.wrap(F.col("rotation_z") - F.lag("rotation_z").over(w)), F.lit(0.0)))
    return df.withColumn("rot_fluc", F.col("__step") - F.avg("__step").over(w.rowsBetween(-2, 2))).drop("__step")


def riding_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """15 riding features per window of rows (with w); the maneuver's rows of both tracks are pooled, as they come."""
    df = rows.withColumn("speed", K.speed(F.col("velocity_x"), F.col("velocity_y"))).withColumn("acc", K.longitudinal(F.col("acceleration_x"), F.col("acceleration_y"), F.col("rotation_z")))
    g, out = [*keys, "w"], []
    for x in ("speed", "acc"):
        df, agg = statistics(x, g, df, ["max", "min", "mean", "std", "mad", "qcv"])
        out += [a.alias(f"{x}_{k}") for k, a in agg.items()]
    df, agg = statistics("rot_fluc", g, df, ["mad", "std", "max_abs"])
    return df.groupBy(*g).agg(*out, *[a.alias(f"rot_fluc_{k}") for k, a in agg.items()])


def frame_safety(enc: DataFrame, keys: list[str], horizon: float = 6.0) -> DataFrame:
    """Per keys (one frame each): counts, least TTC and DCA, numbers below the TTC limits and greatest DRAC, by category; one aggregation. Rows with a missing, NaN or infinite input are left out."""
    enc = enc.where(K.all_finite("dx", "dy", "vx_rel", "vy_rel", "distance", "velocity"))
    r = F.coalesce(*[F.when(F.col("category") == c, F.lit(R_SAFE[k])) for k, c in CATEGORIES.items()])
    dx, dy, vx, vy = (F.col(c) for c in ("dx", "dy", "vx_rel", "vy_rel"))
    df = enc.withColumn("ttc", K.time_to_collision(dx, dy, vx, vy, r, horizon)).withColumn("dca", K.distance_at_closest_approach(dx, dy, vx, vy, horizon)).withColumn("drac", K.deceleration_to_avoid(dx, dy, vx, vy, r))
    out = []
    for name, c in CATEGORIES.items():
        own = F.col("category") == c
        radius, least = COUNTED[name]
        out += [
            F.count_if(own & (F.col("distance") <= radius) & (F.col("velocity") >= least)).alias(f"{name}_count"),
            F.min(F.when(own, F.col("ttc"))).alias(f"{name}_min_ttc"),
            F.min(F.when(own, F.col("dca"))).alias(f"{name}_min_dca"),
            F.max(F.when(own, F.col("drac"))).alias(f"{name}_max_drac"),
            *[F.count_if(own & (F.col("ttc") < t)).alias(f"{name}_num_ttc_below_{n}s") for n, t in TTC_LIMITS.items()],
        ]
    return df.groupBy(*keys).agg(*out)


def traffic_features(rows: DataFrame, safety: DataFrame, keys: list[str], horizon: float = 6.0, dca_threshold: float = 5.0, compat: bool = False) -> DataFrame:
    """54 traffic features per window. rows: a maneuver's rows with w and ego_id; safety: frame_safety keyed by ego_id, t_start, t_end, frame.

    Frames without encounters have the horizon as TTC, infinity as DCA, no DRAC and zero counts; `compat` counts them
    as frames with a low TTC. Tenths and ninetieths are over finite values, 0 if there are none.
    """
    df = rows.join(safety, ["ego_id", "t_start", "t_end", "frame"], "left")
    out = []
    for c in CATEGORIES:
        ttc, dca = F.coalesce(f"{c}_min_ttc", F.lit(horizon)), F.coalesce(f"{c}_min_dca", F.lit(math.inf))
        drac, count = F.coalesce(f"{c}_max_drac", F.lit(0.0)), F.coalesce(f"{c}_count", F.lit(0))
        tenth = lambda x, p: F.coalesce(F.percentile(K.finite(x), p), F.lit(0.0))
        out += [
            F.avg(count).alias(f"{c}_count_mean"), F.max(count).cast("double").alias(f"{c}_count_max"), F.min(ttc).alias(f"{c}_min_ttc_min"), tenth(ttc, 0.1).alias(f"{c}_min_ttc_p10"),
            F.max(drac).alias(f"{c}_max_drac"), tenth(drac, 0.9).alias(f"{c}_max_drac_p90"), F.min(dca).alias(f"{c}_min_dca_min"), tenth(dca, 0.1).alias(f"{c}_min_dca_p10"),
            F.avg((dca < dca_threshold).cast("int")).alias(f"{c}_fraction_dca_below_th"),
        ]
        for n, t in TTC_LIMITS.items():
            num = F.coalesce(f"{c}_num_ttc_below_{n}s", F.lit(0))
            any_low = (num > 0) | F.col(f"{c}_min_ttc").isNull() if compat else num > 0
            out += [
                F.avg(any_low.cast("int")).alias(f"{c}_fraction_ttc_below_{n}s"),
                F.max(num).cast("double").alias(f"{c}_max_num_ttc_below_{n}s"),
                F.sum(F.greatest(t - ttc, F.lit(0.0))).alias(f"{c}_ttc_exposure_{n}s"),
            ]
    return df.groupBy(*keys, "w").agg(*out)


def nearest_signal(rows: DataFrame, signals: DataFrame, kind: str, max_radius: float, x: str = "translation_x", y: str = "translation_y", key: tuple[str, ...] = ("track_id", "frame")) -> DataFrame:
    """(key, distance): Euclidean distance to the nearest signal of a kind, null beyond max_radius."""
    found = signal_distances(rows, signals, {kind: max_radius}, x, y, key)
    return found.withColumnRenamed(f"dist_{kind}", "distance")


def signal_distances(rows: DataFrame, signals: DataFrame, radius: dict[str, float] | None = None, x: str = "translation_x", y: str = "translation_y", key: tuple[str, ...] = ("track_id", "frame")) -> DataFrame:
    """(key, dist_NAME for each kind): distance to the nearest signal of the kind, null beyond its radius.

    Signals are gathered by grid cells as wide as the greatest radius, each into its cell's neighbourhood, so a row
    meets one array of the signals about it and no row is multiplied. A place has few signals but rows of all times:
    the signals, of a size that is checked, are broadcast; more of them are joined by cell and a salt of the rows'.
    """
    radius = radius or SIGNAL_RADIUS
    width = max(radius.values())
    cell = lambda c: F.floor(F.col(c) / width)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    s = signals.where(F.col("name").isin(*radius)).select("name", F.col("x").alias("sx"), F.col("y").alias("sy"), cell("x").alias("cx"), cell("y").alias("cy"))
    s = s.withColumn("cx", F.explode(F.transform(around, lambda k: F.col("cx") + k))).withColumn("cy", F.explode(F.transform(around, lambda k: F.col("cy") + k)))
    cells = s.groupBy("cx", "cy").agg(F.collect_list(F.struct("name", "sx", "sy")).alias("about"))
    places = rows.select(*key, F.col(x).alias("px"), F.col(y).alias("py"), cell(x).alias("cx"), cell(y).alias("cy"))
    if signals.limit(BROADCAST_SIGNALS + 1).count() <= BROADCAST_SIGNALS:
        near = places.join(F.broadcast(cells), ["cx", "cy"], "left")
    else:
        salted = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = places.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(salted, ["cx", "cy", "salt"], "left")
    least = lambda kind: F.array_min(F.transform(F.filter("about", lambda s: s["name"] == kind), lambda s: F.hypot(F.col("px") - s["sx"], F.col("py") - s["sy"])))
    near = near.select(*key, *[least(kind).alias(f"dist_{kind}") for kind in radius])
    return near.select(*key, *[F.when(F.col(f"dist_{kind}") <= r, F.col(f"dist_{kind}")).alias(f"dist_{kind}") for kind, r in radius.items()])


def basic_infrastructure(df: DataFrame, roads: DataFrame, offset_x: float = 0.0, offset_y: float = 0.0, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Tracks on their roads: absolute places, magnitudes, heading in [-pi, pi), lane columns with short gaps filled, and the heading against the lane's.

    roads: (track_id, frame, lane_type, lane_angle and other lane columns). Of several rows for one (track, frame) the
    smallest counts. `bounds` (min x, max x, min y, max y of the map, in absolute places) clips tracks to the map.
    """
    lane = [c for c in roads.columns if c not in ("track_id", "frame")]
    one = roads.groupBy("track_id", "frame").agg(F.min(F.struct(*lane)).alias("r")).select("track_id", "frame", "r.*")
    out = df.withColumns({
        "abs_x": F.col("translation_x") + offset_x, "abs_y": F.col("translation_y") + offset_y, "velocity": K.speed(F.col("velocity_x"), F.col("velocity_y")),
        "acceleration": K.acceleration(F.col("acceleration_x"), F.col("acceleration_y")), "rotation_z": K.wrap(F.col("rotation_z")),
    }).join(one, ["track_id", "frame"], "left")
    out = fill_lane_gaps(out, lane).withColumn("heading_deviation", K.heading_deviation(F.col("rotation_z"), F.col("lane_angle")))
    if bounds:
        out = out.where(F.col("abs_x").between(*bounds[:2]) & F.col("abs_y").between(*bounds[2:]))
    return out


def lane_columns(df: DataFrame) -> DataFrame:
    """Lane context beside each row: kind of lane, offset from its centre, relative place, clearances. Missing widths give nulls."""
    on = lambda *kinds: F.coalesce(F.col("lane_type").isin(*kinds), F.lit(False)).cast("int")
    inner, outer, width = (F.nanvl(c, F.lit(None).cast("double")) for c in ("inner_dist", "outer_dist", "lane_width"))
    return df.withColumns({
        "on_bikelane": on("biking"), "on_sidewalk": on("sidewalk"), "on_motorway": on("driving", "shoulder", "parking", "tram"), "offset_lane_center": inner - width / 2,
        "rel_offset_lane_center": F.abs(F.try_divide(inner - width / 2, width)), "rel_position_lane": F.try_divide(inner, width), "min_lateral_clearance": F.least(inner, outer), "max_lateral_clearance": F.greatest(inner, outer),
    })


def fill_lane_gaps(df: DataFrame, columns: list[str], most: int = 2) -> DataFrame:
    """Lane columns of one or two rows without a lane, from the nearest row of the track that has one, the earlier first."""
    w = S.ordered(["track_id"], "frame")
    around = [f(c, k).over(w) for k in range(1, most + 1) for f in (F.lag, F.lead) for c in ("lane_type",)]
    source = F.coalesce(F.when(F.col("lane_type").isNotNull(), F.lit(0)), *[F.when(x.isNotNull(), F.lit(k)) for x, k in zip(around, [s * k for k in range(1, most + 1) for s in (-1, 1)])])
    df = df.withColumn("__from", source)
    shifted = lambda c: F.coalesce(c, *[F.when(F.col("__from") == s * k, (F.lag if s < 0 else F.lead)(c, k).over(w)) for k in range(1, most + 1) for s in (-1, 1)])
    for c in [c for c in columns if c != "lane_type"] + ["lane_type"]:
        df = df.withColumn(c, shifted(c))
    return df.drop("__from")


def infrastructure_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """13 means per window of lane_columns rows with dist_TrafficLight, dist_RegulatorySign and dist_WarningSign."""
    mean = {
        "p_on_motorway": "on_motorway", "p_on_bikelane": "on_bikelane", "p_on_sidewalk": "on_sidewalk", "offset_lane_center": "offset_lane_center", "rel_offset_lane_center": "rel_offset_lane_center",
        "rel_position_lane": "rel_position_lane", "left_clearance": "inner_dist", "min_lateral_clearance": "min_lateral_clearance", "max_lateral_clearance": "max_lateral_clearance", "lane_width": "lane_width",
        "distance_traffic_light": "dist_TrafficLight", "distance_regulatory_sign": "dist_RegulatorySign", "distance_warning_sign": "dist_WarningSign",
    }
    return rows.groupBy(*keys, "w").agg(*[F.avg(c).alias(f"f_{n}") for n, c in mean.items()]).select(*keys, "w", *[F.col(f"f_{n}").alias(n) for n in mean])


def regime_map(centers: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster_id, regime): 'volatile' for the cluster of the greatest mean over the volatility columns, 'stable' for that of the smallest, null between. centers has a row per cluster."""
    named = [c for c in columns if any(k in c for k in ("std", "mad", "qcv", "cv", "var"))]
    df = centers.select("cluster_id", (sum((F.col(c) for c in named), F.lit(0.0)) / len(named)).alias("volatility"))
    ends = df.agg(F.max_by("cluster_id", F.struct("volatility", -F.col("cluster_id"))).alias("top"), F.min_by("cluster_id", F.struct("volatility", "cluster_id")).alias("low"))
    return df.crossJoin(F.broadcast(ends)).select("cluster_id", F.when(F.col("cluster_id") == F.col("top"), "volatile").when(F.col("cluster_id") == F.col("low"), "stable").alias("regime"))


def aggregate_regimes(windows: DataFrame) -> DataFrame:
    """RegimeAggregation per maneuver of windows (maneuver_id, w, volatile); windows without a regime are left out."""
    key = ["maneuver_id"]
    df = windows.where("volatile IS NOT NULL").withColumn("i", F.row_number().over(S.ordered(key, "w")) - 1)
    w = S.ordered(key, "i")
    df = df.withColumn("change", (F.lag("volatile").over(w) != F.col("volatile")).cast("int")).withColumn("run", S.island(F.col("volatile"), key, "i"))
    total = df.groupBy("maneuver_id").agg(F.count(F.lit(1)).alias("n_windows"), F.avg(F.col("volatile").cast("int")).alias("p_volatile"), F.coalesce(F.sum("change"), F.lit(0)).alias("changes"))
    runs = df.where("volatile").groupBy("maneuver_id", "run").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    runs = runs.withColumn("gap", F.col("lo") - F.lag("hi").over(S.ordered(key, "lo")) - 1)
    runs = runs.groupBy("maneuver_id").agg(F.avg(F.col("hi") - F.col("lo") + 1).alias("mean_run"), F.stddev_pop(F.col("hi") - F.col("lo") + 1).alias("std_run"), F.avg("gap").alias("gap"))
    return total.join(runs, "maneuver_id", "left").select(
        "maneuver_id", "n_windows", ((F.col("p_volatile") > 0) & (F.col("p_volatile") < 1)).alias("is_active"), "p_volatile",
        (F.col("changes") / F.greatest(F.col("n_windows") - 1, F.lit(1))).alias("transition_rate"), F.coalesce("mean_run", F.lit(0.0)).alias("mean_run_volatile"),
        F.coalesce("std_run", F.lit(0.0)).alias("std_run_volatile"), F.coalesce(F.col("gap") / F.col("n_windows"), F.lit(1.0)).alias("mean_volatile_gap"),
    )
