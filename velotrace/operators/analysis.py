"""Counts, histograms, box statistics, track simplification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotrace.functions import sequence as S


def family_counts(found: DataFrame, families: list[str]) -> DataFrame:
    """Interactions of each track by family, 0 where it has none, and in all."""
    wide = found.groupBy("track_id").pivot("family", families).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("total", sum((F.col(f) for f in families), F.lit(0)).cast("long"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n, density) of values in [lo, hi]; the last bin holds hi. Density integrates to 1."""
    by, width = by or [], (hi - lo) / bins
    at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).between(lo, hi)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))
    return joined.select(*by, "bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def box_statistics(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Quartiles, mean and whiskers (the farthest values within 1.5 interquartile ranges)."""
    q = df.groupBy(*by).agg(*[F.percentile(column, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], F.avg(column).alias("mean"), F.count(F.lit(1)).alias("n"))
    x, reach = F.col(column), 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(F.broadcast(q) if not by else q, by).where((x >= F.col("q1") - reach) & (x <= F.col("q3") + reach))
    return q.join(inside.groupBy(*by).agg(F.min(column).alias("low"), F.max(column).alias("high")), by).select(*by, "n", "mean", "low", "q1", "median", "q3", "high")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, q1, median, q3, max) of each column, nulls left out; one aggregation, the sample's deviation."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "q1": lambda c: F.percentile(c, 0.25), "median": lambda c: F.percentile(c, 0.5), "q3": lambda c: F.percentile(c, 0.75), "max": F.max}
    row = df.agg(*[F.struct(*[f(c).alias(n) for n, f in stats.items()]).alias(f"s{k}") for k, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"s{k}.{n}").cast("long" if n == "n" else "double").alias(n) for n in stats]) for k, c in enumerate(columns)])))


def scatter(df: DataFrame, x: str, y: str, by: list[str], share: float = 1.0, seed: int = 0) -> DataFrame:
    """(by, x, y) of rows that have both; with `share` below 1 a sample of about that share, chosen by a hash of the row."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    return some if share >= 1 else some.where(F.pmod(F.xxhash64(F.lit(seed), *some.columns), F.lit(1_000_000)) < int(share * 1_000_000))


def bounding_box(traj: DataFrame, margin: float) -> DataFrame:
    return traj.agg(*[(f(c) + s * margin).alias(f"{n}_{c[-1]}") for c in ("translation_x", "translation_y") for f, s, n in ((F.min, -1, "min"), (F.max, 1, "max"))])


def simplify_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Places kept of a polyline by Douglas and Peucker: a stretch is halved at its point farthest from its chord while that is beyond the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length2 = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length2, 0, 1) if length2 else np.zeros(b - a - 1)
        d2 = (px - t * dx) ** 2 + (py - t * dy) ** 2
        far = int(d2.argmax())
        if d2[far] > tolerance * tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.flatnonzero(keep)


def simplify_tracks(traj: DataFrame, tolerance: float) -> DataFrame:
    """(track_id, segment, x0, y0, x1, y1): consecutive point pairs of each simplified track of two points or more; a track is one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        x, y = rows["translation_x"].to_numpy(), rows["translation_y"].to_numpy()
        at = simplify_points(x, y, tolerance) if len(x) > 1 else np.zeros(0, int)
        n = max(0, len(at) - 1)
        return pd.DataFrame({"track_id": np.full(n, rows["track_id"].iloc[0]), "segment": np.arange(n), "x0": x[at[:-1]], "y0": y[at[:-1]], "x1": x[at[1:]], "y1": y[at[1:]]})

    return traj.select("track_id", "frame", "translation_x", "translation_y").groupBy("track_id").applyInPandas(run, "track_id long, segment long, x0 double, y0 double, x1 double, y1 double")


def simplification_sweep(traj: DataFrame, tolerances: list[float]) -> DataFrame:
    """(tolerance, segments, length): mean segments of a track and mean length of a segment."""
    out = None
    for t in tolerances:
        one = simplify_tracks(traj, t).groupBy("track_id").agg(F.count(F.lit(1)).alias("k"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("l"))
        one = one.agg(F.avg("k").alias("segments"), (F.sum("l") / F.sum("k")).alias("length")).select(F.lit(t).alias("tolerance"), "segments", "length")
        out = one if out is None else out.unionByName(one)
    return out


def heading_steps(traj: DataFrame) -> DataFrame:
    """yaw_rate per row: the heading's step over the time step; 0 on the first row, null where time stands still."""
    w = S.ordered(["track_id"], "frame")
    dt = F.col("timestamp") - F.lag("timestamp").over(w)
    return traj.withColumn("yaw_rate", F.when(F.lag("timestamp").over(w).isNull(), 0.0).otherwise(F.try_divide(F.col("rotation_z") - F.lag("rotation_z").over(w), dt)))
