"""Following and overtaking maneuvers from pair frames.

A pair frame is a row of a pair's common frames, keyed by KEYS (the interaction) and i, with a_ and b_ columns of the
two tracks; all steps are windows or aggregations on that key, so one exchange serves them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velotrace.functions import kinematics as K
from velotrace.functions import sequence as S
from velotrace.sources.storage import materialize

KEYS = ["track_id", "other_id", "t_start", "t_end"]
COLUMNS = ("translation_x", "translation_y", "velocity_x", "velocity_y", "acceleration_x", "acceleration_y", "rotation_z")


def pair_frames(traj: DataFrame, found: DataFrame, pad: float = 0.0) -> DataFrame:
    """Pair frames of interactions, within their time and `pad` seconds around, with i (from 0) and n."""
    a = traj.select("track_id", "frame", "timestamp", *[F.col(c).alias(f"a_{c}") for c in COLUMNS])
    b = traj.select(F.col("track_id").alias("other_id"), "frame", *[F.col(c).alias(f"b_{c}") for c in COLUMNS])
    rows = found.select(*KEYS).distinct().join(a, "track_id").where(F.col("timestamp").between(F.col("t_start") - pad, F.col("t_end") + pad)).join(b, ["other_id", "frame"])
    return rows.withColumn("i", F.row_number().over(S.ordered(KEYS, "frame")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))


def lateral_longitudinal(pf: DataFrame) -> DataFrame:
    """pf with a_heading, b_heading (cleaned) and, for each side's point of view, the other's place: a_lat, a_long, b_lat, b_long."""
    for s in "ab":
        pf = S.add_clean_heading(pf, f"{s}_rotation_z", f"{s}_heading", KEYS, "i")
    dx, dy = F.col("b_translation_x") - F.col("a_translation_x"), F.col("b_translation_y") - F.col("a_translation_y")
    for s, k in (("a", 1), ("b", -1)):
        h = F.col(f"{s}_heading")
        pf = pf.withColumn(f"{s}_long", K.longitudinal(dx * k, dy * k, h)).withColumn(f"{s}_lat", K.lateral(dx * k, dy * k, h))
    return pf


def smoothed(pf: DataFrame, speeds: bool = True) -> DataFrame:
    """lateral_longitudinal with smoothed columns a_lat_s, a_long_s, b_lat_s, b_long_s and the sides' speeds, accelerations and (smoothed) longitudinal speeds."""
    pf = lateral_longitudinal(pf)
    for s in "ab":
        x, y, h = F.col(f"{s}_velocity_x"), F.col(f"{s}_velocity_y"), F.col(f"{s}_rotation_z")
        pf = pf.withColumn(f"{s}_speed", K.speed(x, y)).withColumn(f"{s}_acc", K.acceleration(F.col(f"{s}_acceleration_x"), F.col(f"{s}_acceleration_y"))).withColumn(f"{s}_vlong", K.longitudinal(x, y, h))
    keep = [*KEYS, "i", "n", "frame", "timestamp", *[f"{s}_{c}" for s in "ab" for c in ("lat", "long", "heading", "speed", "acc", "vlong")]]
    signals = {f"{s}_{c}_s": (f"{s}_{c}", 0.5) for s in "ab" for c in ("lat", "long")}
    if speeds:
        signals |= {f"{s}_vlong_s": (f"{s}_vlong", 0.2) for s in "ab"}
    return S.smooth(pf.select(*keep), signals, KEYS, "i")


@dataclass
class Following:
    min_length: float = 1.0
    max_lateral: float = 1.0
    min_long: float = 1.0
    max_long: float = 30.0
    max_headway: float = 6.0
    max_heading: float = 35.0


#: As the extraction job sets them.
JOB = Following(min_length=1.0, max_lateral=2.0, min_long=1.0, max_long=35.0, max_headway=6.0, max_heading=30.0)


def following(pf: DataFrame, p: Following = Following(), compat: bool = False) -> DataFrame:
    """Following maneuvers of smoothed pair frames.

    Rows before a sign change of a's longitudinal offset are left out and part the pair into intervals; in each, the
    mean sign says who leads. Runs of rows in which lateral offset, gap, headway and relative heading hold, lasting
    min_length or more, are maneuvers; a maneuver ends on the row after its last (if there is one). With `compat`
    the last row of each interval counts for its length only, as if intervals ended before their last row.
    """
    w = S.ordered(KEYS, "i")
    rows = pf.withColumn("flip", S.flips_after(F.col("a_long_s"), KEYS, "i")).withColumn("next_t", F.coalesce(F.lead("timestamp").over(w), F.col("timestamp")))
    rows = rows.withColumn("part", F.coalesce(F.sum(F.col("flip").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("NOT flip")
    part = [*KEYS, "part"]
    whole = Window.partitionBy(*part)
    leads = F.avg("a_long_s").over(whole) > 0
    rows = rows.withColumns({"a_follows": leads, "span": F.max("timestamp").over(whole) - F.min("timestamp").over(whole), "end_i": F.max("i").over(whole)}).where(F.col("span") >= p.min_length - 1e-9)
    if compat:
        rows = rows.where("i < end_i").withColumn("a_follows", leads)
    pick = lambda c, follower: F.when(F.col("a_follows") == follower, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    rows = rows.select(
        *part, "i", "timestamp", "next_t",
        F.when(F.col("a_follows"), F.col("track_id")).otherwise(F.col("other_id")).alias("ego_id"),
        F.when(F.col("a_follows"), F.col("other_id")).otherwise(F.col("track_id")).alias("leader_id"),
        pick("long_s", True).alias("long"), pick("lat_s", True).alias("lat"), K.time_headway(pick("long_s", True), pick("vlong_s", True)).alias("thw"),
        pick("speed", True).alias("v_f"), pick("speed", False).alias("v_l"), F.abs(F.degrees(F.col("a_heading") - F.col("b_heading"))).alias("rel"),
    )
    mask = (F.abs("lat") < p.max_lateral) & (F.abs("long") > p.min_long) & (F.abs("long") < p.max_long) & (F.abs("thw") < p.max_headway) & (F.col("rel") < p.max_heading)
    runs = rows.withColumn("mask", mask).withColumn("run", S.island(F.col("mask"), part, "i")).where("mask").groupBy(*part, "run", "ego_id", "leader_id")
    out = runs.agg(
        F.min("timestamp").alias("m_start"), F.max("timestamp").alias("last"), F.max("next_t").alias("m_end"),
        F.min("long").alias("long_distance_min"), F.avg("long").alias("long_distance_mean"), F.avg(F.abs("lat")).alias("lateral_offset_mean"),
        F.avg(F.abs("thw")).alias("thw_mean"), F.min("thw").alias("thw_min"), F.avg("v_f").alias("follower_speed_mean"), F.avg("v_l").alias("leader_speed_mean"),
        F.avg(F.abs(F.col("v_f") - F.col("v_l"))).alias("speed_diff_mean"), F.stddev_pop("rel").alias("rel_heading_std"),
    )
    features = ["long_distance_min", "long_distance_mean", "lateral_offset_mean", "thw_mean", "thw_min", "follower_speed_mean", "leader_speed_mean", "speed_diff_mean", "rel_heading_std"]
    out = out.where(F.col("last") - F.col("m_start") >= p.min_length - 1e-9).select("ego_id", F.col("leader_id").alias("other_id"), F.col("m_start").alias("t_start"), F.col("m_end").alias("t_end"), (F.col("m_end") - F.col("m_start")).alias("duration"), *features)
    return first_of(out, features)


def first_of(maneuvers: DataFrame, features: list[str]) -> DataFrame:
    """One row for each identity (ego_id, other_id, t_start, t_end): of several the one with the smallest features."""
    identity = ["ego_id", "other_id", "t_start", "t_end"]
    rest = [c for c in maneuvers.columns if c not in identity]
    return maneuvers.groupBy(*identity).agg(F.min(F.struct(*rest)).alias("r")).select(*identity, "r.*")


def with_ids(maneuvers: DataFrame) -> DataFrame:
    """Maneuvers with `id`, 0 and up without gaps, in the order of (ego_id, other_id, t_start, t_end) and then of all columns.

    They are written in that order once; a row's number is its place in its partition and the rows of the partitions
    before, so that no task has all rows.
    """
    order = ["ego_id", "other_id", "t_start", "t_end"]
    placed = maneuvers.orderBy(*order, *[c for c in maneuvers.columns if c not in order]).withColumn("__place", F.monotonically_increasing_id())
    placed = materialize(placed, "ids").withColumn("__part", F.shiftright("__place", 33))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()  # a row for each partition
    before, total = [], 0
    for r in counts:
        before.append((r[0], total))
        total += r.n
    base = maneuvers.sparkSession.createDataFrame(before, "__part long, __before long")
    number = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(base), "__part").select(number.alias("id"), *maneuvers.columns)


def switch_points(hits: DataFrame, rows: DataFrame, x: str, keys: list[str], k: int = 5) -> DataFrame:
    """(keys, grp, i): of each session's crossings (keys, grp, i) the one after which the most of the next k - 1 rows have a negative x, the first of equals."""
    after = F.sum((F.col(x) < 0).cast("int")).over(S.ordered(keys, "i").rowsBetween(1, k - 1))
    scored = hits.join(rows.select(*keys, "i", F.coalesce(after, F.lit(0)).alias("score")), [*keys, "i"])
    return scored.groupBy(*keys, "grp").agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("i"))


@dataclass
class Overtaking:
    thresholds: int = 5
    min_threshold: float = 0.05
    max_threshold: float = 1.2
    max_lateral: float = 3.0
    min_lateral_cross: float = 0.3
    min_frames: int = 10
    max_frames: int = 125
    merge: int = 15
    persist: int = 25
    half: int = 31


def crossings(pf: DataFrame, p: Overtaking = Overtaking()) -> DataFrame:
    """Rows (KEYS, i, n, grp): first negative rows after positive ones in either side's smoothed longitudinal offset whose following sign persists, numbered by session."""
    for s in "ab":
        x = F.col(f"{s}_long_s")
        pf = pf.withColumn(f"{s}_cross", S.falls_through_zero(x, KEYS, "i") & S.sign_persists(x, KEYS, "i", p.persist))
    hit = pf.where("a_cross OR b_cross").select(*KEYS, "i", "n")
    return hit.withColumn("grp", F.coalesce(S.session("i", KEYS, p.merge), F.lit(0)))


def overtake_windows(pf: DataFrame, p: Overtaking = Overtaking()) -> DataFrame:
    """(KEYS, grp, z, from_i, to_i, pov): around each session's first crossing z, from the farthest point since the previous session to the farthest before the next, at most `half` rows away; pov is the side behind before z."""
    groups = crossings(pf, p).groupBy(*KEYS, "n", "grp").agg(F.min("i").alias("z"), F.max("i").alias("last"))
    w = S.ordered(KEYS, "grp")
    groups = groups.withColumn("prev", F.coalesce(F.lag("last").over(w), F.lit(0))).withColumn("next", F.coalesce(F.lead("z").over(w), (F.col("n") - 1).cast("int")))
    rows = groups.join(pf.select(*KEYS, "i", "a_long_s", "b_long_s"), KEYS).where("i BETWEEN prev AND next")
    a_behind = F.max(F.when(F.col("i") == F.col("z") - 1, (F.col("a_long_s") > 0).cast("int"))).over(Window.partitionBy(*KEYS, "grp"))
    rows = rows.withColumn("pov", F.when(a_behind == 1, "a").otherwise("b")).withColumn("far", F.abs(F.when(F.col("pov") == "a", F.col("a_long_s")).otherwise(F.col("b_long_s"))))
    top = lambda side: F.max_by(F.when(side, F.col("i")), F.when(side, F.struct("far", -F.col("i"))))
    out = rows.groupBy(*KEYS, "n", "grp", "z", "pov").agg(top(F.col("i") <= F.col("z")).alias("lo"), top(F.col("i") >= F.col("z")).alias("hi"))
    return out.select(*KEYS, "n", "grp", "z", F.greatest("lo", F.col("z") - p.half, F.lit(0)).alias("from_i"), F.least("hi", F.col("z") + p.half, (F.col("n") - 1).cast("int")).alias("to_i"), "pov")


def thresholds(lat_z, p: Overtaking = Overtaking()):
    """Ascending array of logarithmically spaced thresholds up to |lat_z| (clipped); the last is left out if |lat_z| is below the maximum."""
    top = F.least(F.greatest(F.abs(lat_z), F.lit(p.min_threshold)), F.lit(p.max_threshold))
    at = F.array(*[F.lit(k / (p.thresholds - 1)) for k in range(p.thresholds)]) if p.thresholds > 1 else F.array(F.lit(1.0))
    every = F.transform(at, lambda k: p.min_threshold * F.pow(top / p.min_threshold, k))
    return F.when((F.abs(lat_z) < p.max_threshold) & F.lit(p.thresholds > 1), F.slice(every, 1, max(1, p.thresholds - 1))).otherwise(every)


def overtaking(pf: DataFrame, p: Overtaking = Overtaking()) -> DataFrame:
    """One overtaking maneuver at most for each interaction: the first with both edges, else the first with one.

    In each overtake window the follower is the side behind at its start; its longitudinal offset must fall from
    positive to negative, and its lateral offset at the crossing be in bounds. Edges are where the lateral offset,
    at least min_frames from the crossing, comes within the lowest threshold that is met at all; they must pass the
    checks on length, lateral offset and sign.
    """
    # Smoothing is costly and four steps read its rows.
    pf = materialize(pf.select(*KEYS, "i", "n", "timestamp", *[f"{s}_{c}" for s in "ab" for c in ("long", "long_s", "lat_s", "speed", "acc")]), "pair_frames")
    win = overtake_windows(pf, p)
    at = pf.select(*KEYS, F.col("i").alias("j"), *[f"{s}_{c}" for s in "ab" for c in ("long", "long_s", "lat_s")])
    g = [*KEYS, "grp"]
    ends = win.join(at, KEYS).where("j IN (from_i, to_i, z)").groupBy(*g, "n", "z", "from_i", "to_i").agg(
        F.max(F.when(F.col("j") == F.col("from_i"), F.struct("a_long", "a_long_s", "b_long_s"))).alias("s"),
        F.max(F.when(F.col("j") == F.col("to_i"), F.struct("a_long_s", "b_long_s"))).alias("e"),
        F.max(F.when(F.col("j") == F.col("z"), F.struct("a_lat_s", "b_lat_s"))).alias("c"),
    )
    a = F.col("s.a_long") > 0
    pick = lambda s, c: F.when(F.col("a_follows"), F.col(f"{s}.a_{c}")).otherwise(F.col(f"{s}.b_{c}"))
    ends = ends.withColumn("a_follows", a).withColumn("lat_z", pick("c", "lat_s")).where((pick("s", "long_s") > 0) & (pick("e", "long_s") < 0) & F.abs("lat_z").between(p.min_lateral_cross, p.max_lateral))
    ends = ends.select(*g, "n", "z", "a_follows", "lat_z", thresholds(F.col("lat_z"), p).alias("ths"))
    side = lambda c: F.when(F.col("a_follows"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    far = lambda c: F.when(F.col("a_follows"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    rows = ends.join(pf.select(*KEYS, "i", "timestamp", *[f"{s}_{c}" for s in "ab" for c in ("long_s", "lat_s", "speed", "acc")]), KEYS).select(
        *g, "n", "z", "a_follows", "lat_z", "ths", "i", "timestamp", side("long_s").alias("long"), side("lat_s").alias("lat"), side("speed").alias("v_f"), far("speed").alias("v_l"), side("acc").alias("acc")
    )
    whole = Window.partitionBy(*g)
    back = F.col("i").between(F.greatest(F.col("z") - p.max_frames, F.lit(0)), F.col("z") - p.min_frames)
    ahead = F.col("i").between(F.col("z") + p.min_frames, F.col("z") + p.max_frames)
    lowest = lambda where: F.min(F.when(where, F.abs("lat"))).over(whole)
    first_met = lambda least: F.array_min(F.filter("ths", lambda t: t >= least))
    rows = rows.withColumn("back_th", first_met(lowest(back))).withColumn("ahead_th", first_met(lowest(ahead)))
    rows = rows.withColumn("start", F.max(F.when(back & (F.abs("lat") <= F.col("back_th")), F.col("i"))).over(whole)).withColumn("stop", F.min(F.when(ahead & (F.abs("lat") <= F.col("ahead_th")), F.col("i"))).over(whole))
    bad = lambda inside, wrong: F.coalesce(F.max((inside & ((F.abs("lat") >= p.max_lateral) | wrong)).cast("int")).over(whole), F.lit(0)) == 1
    rows = rows.withColumn("bad_start", bad(F.col("i").between(F.col("start"), F.col("z") - 2), F.col("long") <= 0) | (F.col("z") - F.col("start") <= p.min_frames))
    rows = rows.withColumn("bad_stop", bad(F.col("i").between(F.col("z") + 1, F.col("stop") - 1), F.col("long") >= 0) | (F.col("stop") - F.col("z") <= p.min_frames))
    rows = rows.withColumn("start", F.when(~F.coalesce("bad_start", F.lit(True)), F.col("start"))).withColumn("stop", F.when(~F.coalesce("bad_stop", F.lit(True)), F.col("stop"))).where("start IS NOT NULL OR stop IS NOT NULL")
    rows = rows.withColumn("lo", F.coalesce("start", "z")).withColumn("hi", F.coalesce("stop", "z")).where("i BETWEEN lo AND hi")
    when = lambda c, at: F.max(F.when(F.col("i") == F.col(at), F.col(c)))
    out = rows.groupBy(*g, "z", "start", "stop", "a_follows", "lat_z").agg(
        when("timestamp", "start").alias("m_start"), when("timestamp", "z").alias("t_cross"), when("timestamp", "stop").alias("m_end"),
        F.min("long").alias("long_distance_min"), F.max("long").alias("long_distance_max"), when("lat", "lo").alias("lateral_offset_start"), when("lat", "hi").alias("lateral_offset_end"),
        F.max(F.abs("lat")).alias("lateral_offset_max"), F.avg("v_f").alias("follower_speed_mean"), F.avg("v_l").alias("leader_speed_mean"),
        F.avg(F.abs(F.col("v_f") - F.col("v_l"))).alias("speed_diff_mean"), F.max("acc").alias("follower_acc_max"),
    )
    best = Window.partitionBy(*KEYS).orderBy(F.when(F.col("start").isNotNull() & F.col("stop").isNotNull(), 0).otherwise(1), "z")
    out = out.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return out.select(
        F.when(F.col("a_follows"), F.col("track_id")).otherwise(F.col("other_id")).alias("ego_id"), F.when(F.col("a_follows"), F.col("other_id")).otherwise(F.col("track_id")).alias("other_id"),
        F.col("m_start").alias("t_start"), "t_cross", F.col("m_end").alias("t_end"), (F.col("m_end") - F.col("m_start")).alias("duration"), (F.col("lat_z") > 0).alias("left_side"),
        "long_distance_min", "long_distance_max", "lateral_offset_start", "lateral_offset_end", "lateral_offset_max", F.col("lat_z").alias("lateral_offset_cross"),
        "follower_speed_mean", "leader_speed_mean", "speed_diff_mean", "follower_acc_max",
    )
