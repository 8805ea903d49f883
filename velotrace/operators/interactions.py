"""Proximity pairs, interactions and their filters, encounters.

A trajectory table has unique (track_id, frame). Candidate pairs come from an equi-join on (frame, grid cell): cells are
as wide as the radius, only the ego side is put into its 3 x 3 neighbourhood, so no join is on the frame alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotrace.functions import kinematics as K
from velotrace.functions import sequence as S

CAR, PEDESTRIAN, BICYCLE = 1, 2, 3
#: Seconds of a slot in the encounter join.
TIME_SLOT = 30.0
STATE = ("timestamp", "translation_x", "translation_y", "velocity_x", "velocity_y", "rotation_z")


def _cells(distance: float) -> list[Column]:
    return [F.floor(F.col(c) / distance).alias(k) for c, k in (("translation_x", "cx"), ("translation_y", "cy"))]


def proximity_rows(ego: DataFrame, other: DataFrame, distance: float) -> DataFrame:
    """(track_id, other_id, frame) wherever another track is within the distance, ends included."""
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    e = ego.select("frame", "track_id", F.col("translation_x").alias("ex"), F.col("translation_y").alias("ey"), *_cells(distance))
    e = e.withColumn("cx", F.explode(F.transform(around, lambda k: F.col("cx") + k))).withColumn("cy", F.explode(F.transform(around, lambda k: F.col("cy") + k)))
    o = other.select("frame", F.col("track_id").alias("other_id"), F.col("translation_x").alias("ox"), F.col("translation_y").alias("oy"), *_cells(distance))
    dx, dy = F.col("ex") - F.col("ox"), F.col("ey") - F.col("oy")
    return e.join(o, ["frame", "cx", "cy"]).where((F.col("track_id") != F.col("other_id")) & (dx * dx + dy * dy <= distance * distance)).select("track_id", "other_id", "frame")


def proximity_pairs(ego: DataFrame, other: DataFrame, distance: float) -> DataFrame:
    """Distinct (track_id, other_id) that come within the distance at some frame."""
    return proximity_rows(ego, other, distance).select("track_id", "other_id").distinct()


def pair_states(pairs: DataFrame, ego: DataFrame, other: DataFrame, columns: tuple[str, ...] = STATE) -> DataFrame:
    """Rows of all common frames of each pair, columns of the two tracks prefixed a_ and b_."""
    a = ego.select("track_id", "frame", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = other.select(F.col("track_id").alias("other_id"), "frame", *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, "track_id").join(b, ["other_id", "frame"])


def _span(traj: DataFrame, name: str) -> DataFrame:
    return traj.groupBy(F.col("track_id").alias(name)).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))


def interactions(
    traj: DataFrame,
    ego_category: int,
    other_category: int | None = None,
    distance: float = 10.0,
    min_duration: float = 0.0,
    fov: float = 360.0,
    min_speed: float = 0.0,
    exclude_ids: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Interactions of tracks of one category with others (of one category, or all but `exclude_ids`).

    A frame counts if the two are within the distance, the other stands in the ego's field of view (degrees, about
    its heading) and both move at `min_speed` or more. Runs of counting frames among the pair's common frames
    (missing common frames don't part a run) are interactions; runs of one frame or shorter than `min_duration` are
    dropped. `pairs` can hand in candidates of a larger radius.
    """
    ego = traj.where(F.col("category") == ego_category)
    other = traj if other_category is None else traj.where(F.col("category") == other_category)
    if exclude_ids is not None:
        other = other.join(exclude_ids.select("track_id").distinct(), "track_id", "left_anti")
    pairs = proximity_pairs(ego, other, distance) if pairs is None else pairs
    rows = _relative(pair_states(pairs, ego, other))
    dx, dy = F.col("dx"), F.col("dy")
    speed2 = lambda s: F.col(f"{s}_velocity_x") * F.col(f"{s}_velocity_x") + F.col(f"{s}_velocity_y") * F.col(f"{s}_velocity_y")
    mask = F.col("d2") <= distance * distance
    if fov < 360:
        mask &= F.abs(K.wrap(F.atan2(-dy, -dx) - F.col("a_rotation_z"))) <= math.radians(fov / 2)
    if min_speed:
        mask &= (speed2("a") >= min_speed**2) & (speed2("b") >= min_speed**2)
    keys = ["track_id", "other_id"]
    rows = rows.withColumn("mask", mask).withColumn("run", S.island(F.col("mask"), keys, "frame")).where("mask")
    return _measured(rows, keys, min_duration)


def _relative(rows: DataFrame) -> DataFrame:
    dx, dy = F.col("a_translation_x") - F.col("b_translation_x"), F.col("a_translation_y") - F.col("b_translation_y")
    return rows.withColumns({"dx": dx, "dy": dy, "d2": dx * dx + dy * dy})


def _measured(rows: DataFrame, keys: list[str], min_duration: float) -> DataFrame:
    """Interactions from the rows of runs (keys, run)."""
    side = F.signum(F.col("dx") * F.col("b_velocity_y") - F.col("dy") * F.col("b_velocity_x"))
    out = rows.groupBy(*keys, "run").agg(
        F.min("a_timestamp").alias("t_start"),
        F.max("a_timestamp").alias("t_end"),
        F.sqrt(F.min("d2")).alias("dist_min"),
        F.avg(F.sqrt("d2")).alias("dist_mean"),
        F.avg(F.hypot(F.col("a_velocity_x") - F.col("b_velocity_x"), F.col("a_velocity_y") - F.col("b_velocity_y"))).alias("rel_speed"),
        F.degrees(F.avg(K.folded_difference(F.col("a_rotation_z"), F.col("b_rotation_z")))).alias("rel_heading"),
        (F.min(side) != F.max(side)).cast("int").alias("is_crossing"),
    )
    out = out.withColumn("duration", F.col("t_end") - F.col("t_start")).where((F.col("t_end") > F.col("t_start")) & (F.col("duration") >= min_duration))
    return out.select(
        *keys, "t_start", "t_end", F.round("duration", 2).alias("duration"), F.round("dist_min", 3).alias("dist_min"), F.round("dist_mean", 3).alias("dist_mean"),
        F.round("rel_speed", 3).alias("rel_speed"), F.round("rel_heading", 2).alias("rel_heading"), "is_crossing",
    )


FAMILIES = {"bike_bike": BICYCLE, "bike_car": CAR, "bike_ped": PEDESTRIAN}


def interaction_families(traj: DataFrame, distances: tuple[float, ...] = (5.0, 10.0, 25.0)) -> DataFrame:
    """Bicycle-bicycle, bicycle-car and bicycle-pedestrian interactions at each distance, in one pass.

    Candidates are found once, at the largest distance, and their common frames joined once. A row's place in its
    pair and the number of rows so far within each distance come from one window; a row then stands once for each
    distance that it is within.
    """
    kind = F.create_map(*[x for name, code in FAMILIES.items() for x in (F.lit(code), F.lit(name))])
    known = traj.where(F.col("category").isin(*FAMILIES.values()))
    ego, other = known.where(F.col("category") == BICYCLE), known
    near = proximity_rows(ego, other, max(distances)).select("track_id", "other_id").distinct()
    rows = _relative(pair_states(near, ego, other, (*STATE, "category"))).withColumn("family", kind[F.col("b_category")])
    keys = ["family", "track_id", "other_id"]
    w = S.ordered(keys, "frame")
    within = [F.col("d2") <= d * d for d in distances]
    so_far = F.array(*[F.sum(m.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) for m in within])
    rows = rows.withColumns({"at": F.row_number().over(w), "so_far": so_far}).where(F.col("d2") <= max(distances) ** 2)
    each = F.array(*[F.struct(F.lit(float(d)).alias("radius"), (F.col("at") - F.col("so_far")[k]).alias("run"), within[k].alias("ok")) for k, d in enumerate(distances)])
    rows = rows.select("*", F.explode(F.filter(each, lambda e: e["ok"])).alias("e")).select("*", "e.radius", "e.run")
    found = _measured(rows, ["family", "radius", "track_id", "other_id"], 0.0)
    return found.select("family", "radius", *[c for c in found.columns if c not in ("family", "radius")])


def lifespans(traj: DataFrame) -> DataFrame:
    return traj.groupBy("track_id").agg(F.min("timestamp").alias("t_first"), F.max("timestamp").alias("t_last"))


def polylines(traj: DataFrame) -> DataFrame:
    """(track_id, points): each track's points (frame, x, y) in order; tracks of one point are omitted. A track is one row, as long as its recording."""
    points = F.sort_array(F.collect_list(F.struct("frame", F.col("translation_x").alias("x"), F.col("translation_y").alias("y"))))
    return traj.groupBy("track_id").agg(points.alias("points")).where(F.size("points") > 1)


def path_lengths(traj: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Length of each track's polyline; tracks of one point are omitted."""
    keys = keys or ["track_id"]
    w = S.ordered(keys, "frame")
    step = F.hypot(F.col("translation_x") - F.lag("translation_x").over(w), F.col("translation_y") - F.lag("translation_y").over(w))
    return traj.withColumn("step", step).groupBy(*keys).agg(F.sum("step").alias("length"), F.count(F.lit(1)).alias("n_points")).where("n_points > 1")


def filter_interactions(traj: DataFrame, found: DataFrame, min_distance: float = 10.0, min_overlap: float = 5.0, max_heading_diff: float = 45.0) -> DataFrame:
    """Without duplicated tracks, distant or diverging pairs, pairs whose tracks coexist for less than `min_overlap` seconds, and those in which one moves less than `min_distance` metres within the interaction."""
    some = found.where("NOT (dist_mean < 0.5 OR rel_speed = 0) AND dist_min < 20 AND dist_mean < 40").where(F.col("rel_heading") <= max_heading_diff)
    life = lifespans(traj)
    a = life.toDF("track_id", "a_first", "a_last")
    b = life.toDF("other_id", "b_first", "b_last")
    some = some.join(a, "track_id").join(b, "other_id").where(F.least("a_last", "b_last") - F.greatest("a_first", "b_first") >= min_overlap)
    keys = ["track_id", "other_id", "t_start", "t_end"]
    ids = some.select(*keys)

    def moved(side: str) -> DataFrame:
        pos = traj.select(F.col("track_id").alias("moving"), "frame", "timestamp", "translation_x", "translation_y")
        inside = ids.join(pos, F.col("moving") == F.col(side)).where("timestamp BETWEEN t_start AND t_end")
        return path_lengths(inside, keys).where(F.col("length") >= min_distance).select(*keys)

    return some.join(moved("track_id"), keys, "left_semi").join(moved("other_id"), keys, "left_semi").select(*found.columns)


def unordered_pairs(found: DataFrame) -> DataFrame:
    """One row for each unordered pair: the earliest, with the smaller track_id first among equals."""
    w = Window.partitionBy("low", "high").orderBy("t_start", "t_end", "track_id")
    return found.withColumn("low", F.least("track_id", "other_id")).withColumn("high", F.greatest("track_id", "other_id")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "low", "high")


def time_window(traj: DataFrame, t0: float, t1: float) -> DataFrame:
    return traj.where(F.col("timestamp").between(t0, t1))


def time_span(traj: DataFrame, ids: list[int]) -> DataFrame:
    return traj.where(F.col("track_id").isin(ids)).agg(F.min("timestamp").alias("t_start"), F.max("timestamp").alias("t_end"))


def filter_range(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Chained inclusive bounds; None is open."""
    for c, (lo, hi) in bounds.items():
        if lo is not None:
            df = df.where(F.col(c) >= lo)
        if hi is not None:
            df = df.where(F.col(c) <= hi)
    return df


def slice_maneuvers(traj: DataFrame, maneuvers: DataFrame, ego_only: bool = False) -> DataFrame:
    """Rows of ego and (unless `ego_only`) other within each maneuver's time, both ends included, with the maneuver's keys."""
    rows = traj.withColumnRenamed("track_id", "member_id")
    keys = ["ego_id", "other_id", "t_start", "t_end"]
    ids = maneuvers.where("t_start IS NOT NULL AND t_end IS NOT NULL").select(*keys).distinct()
    ids = ids.withColumn("member_id", F.col("ego_id") if ego_only else F.explode(F.array_distinct(F.array("ego_id", "other_id"))))
    return ids.join(rows, "member_id").where("timestamp BETWEEN t_start - 1e-9 AND t_end + 1e-9")


def encounters(traj: DataFrame, targets: DataFrame, candidate_radius: float = 20.0, reach: tuple[float, float] = (0.5, 30.0), min_relative_speed: float = 0.1, min_speed: float = 0.5) -> DataFrame:
    """Rows (ego_id, other_id, frame, category, dx, dy, vx_rel, vy_rel, distance, velocity) of tracks near each target.

    targets: (track_id, t_start, t_end). A candidate passes within `candidate_radius` of the target's path at some
    time of the window, not necessarily at the same frame; its rows with a frame in common are kept if the distance,
    the relative speed and its own speed are in reach.
    """
    window = targets.select(F.col("track_id").alias("ego_id"), "t_start", "t_end").distinct()
    inside = lambda t, name: window.join(t, F.col("ego_id") == F.col(name)).where("timestamp BETWEEN t_start AND t_end")
    ego = inside(traj.withColumnRenamed("track_id", "own_id"), "own_id")
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    path = ego.select("ego_id", "t_start", "t_end", F.col("translation_x").alias("ex"), F.col("translation_y").alias("ey"), *_cells(candidate_radius))
    path = path.withColumn("cx", F.explode(F.transform(around, lambda k: F.col("cx") + k))).withColumn("cy", F.explode(F.transform(around, lambda k: F.col("cy") + k)))
    # A slot of time is in the key too: a place sees traffic all day, a window lasts seconds.
    slot = lambda t: F.floor(F.col(t) / TIME_SLOT)
    path = path.withColumn("slot", F.explode(F.sequence(slot("t_start"), slot("t_end"))))
    near = traj.select(F.col("track_id").alias("other_id"), F.col("timestamp").alias("ot"), F.col("translation_x").alias("ox"), F.col("translation_y").alias("oy"), slot("timestamp").alias("slot"), *_cells(candidate_radius))
    close = (F.col("ex") - F.col("ox")) * (F.col("ex") - F.col("ox")) + (F.col("ey") - F.col("oy")) * (F.col("ey") - F.col("oy")) <= candidate_radius**2
    pairs = path.join(near, ["slot", "cx", "cy"]).where(close & (F.col("ego_id") != F.col("other_id")) & F.col("ot").between(F.col("t_start"), F.col("t_end"))).select("ego_id", "t_start", "t_end", "other_id").distinct()
    own = traj.select(F.col("track_id").alias("ego_id"), "frame", "timestamp", *[F.col(c).alias(f"e_{c}") for c in STATE[1:5]])
    cand = traj.select(F.col("track_id").alias("other_id"), "frame", "category", *STATE[1:5])
    rows = pairs.join(own, "ego_id").where("timestamp BETWEEN t_start AND t_end").join(cand, ["other_id", "frame"])
    minus = lambda c: F.col(c) - F.col(f"e_{c}")
    rows = rows.select("ego_id", "t_start", "t_end", "other_id", "frame", "category", minus("translation_x").alias("dx"), minus("translation_y").alias("dy"), minus("velocity_x").alias("vx_rel"), minus("velocity_y").alias("vy_rel"), K.speed(F.col("velocity_x"), F.col("velocity_y")).alias("velocity"))
    rows = rows.withColumn("distance", F.hypot("dx", "dy"))
    return rows.where(F.col("distance").between(*reach) & (F.hypot("vx_rel", "vy_rel") >= min_relative_speed) & (F.col("velocity") >= min_speed))
