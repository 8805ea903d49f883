"""Test inputs as projections of the driver's tables: trajectories, signals, lanes, regime sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One expression for each column, valid in Spark SQL and in DuckDB; f is the row's place in its user's events.
TRAJECTORY = {
    "track_id": "user_id",
    "category": "CAST(user_id % 3 + 1 AS INT)",
    "frame": "CAST(f + (user_id * 3) % 20 AS BIGINT)",
    "timestamp": "(f + (user_id * 3) % 20) * 0.08e0",
    "translation_x": "floor(user_id / 15) * 1000e0 + (user_id * 7) % 30 + (2.5e0 + (user_id % 5) * 0.9e0) * 0.08e0 * f + ((event_id % 7) - 3) * 0.01e0",
    "translation_y": "((user_id * 11) % 3) * 0.9e0 + abs(((f + user_id * 5) % 40) - 20) * 0.045e0 + ((event_id % 5) - 2) * 0.02e0",
    "velocity_x": "(2.5e0 + (user_id % 5) * 0.9e0) + ((event_id % 5) - 2) * 0.1e0",
    "velocity_y": "((event_id % 7) - 3) * 0.05e0",
    "acceleration_x": "((event_id % 9) - 4) * 0.1e0",
    "acceleration_y": "((event_id % 4) - 1.5e0) * 0.1e0",
    "rotation_z": "atan2(((event_id % 7) - 3) * 0.05e0, (2.5e0 + (user_id % 5) * 0.9e0) + ((event_id % 5) - 2) * 0.1e0)",
    "rotation_z_raw": "atan2(((event_id % 7) - 3) * 0.05e0, (2.5e0 + (user_id % 5) * 0.9e0) + ((event_id % 5) - 2) * 0.1e0) + CASE WHEN event_id % 11 = 0 THEN pi() ELSE 0e0 END",
    "event_id": "event_id",
    "f": "f",
}
_PLACE = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
SIGNAL = {
    "name": "CASE s_suppkey % 3 WHEN 0 THEN 'TrafficLight' WHEN 1 THEN 'RegulatorySign' ELSE 'WarningSign' END",
    "x": "floor(s_suppkey / 30) * 1000e0 + (s_suppkey * 13) % 60",
    "y": "((s_suppkey * 7) % 25 - 10) * 1e0",
}
#: Over rows of the trajectory.
LANE = {
    "lane_type": "CASE CAST((track_id + floor(frame / 20)) AS BIGINT) % 4 WHEN 0 THEN 'biking' WHEN 1 THEN 'sidewalk' WHEN 2 THEN 'driving' ELSE 'shoulder' END",
    "lane_width": "3.0e0",
    "inner_dist": "0.2e0 + (event_id % 20) * 0.1e0",
    "outer_dist": "3.0e0 - (0.2e0 + (event_id % 20) * 0.1e0)",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


#: Common table expressions for DuckDB.
TRAJ_SQL = f"traj AS (SELECT {_select(TRAJECTORY)} FROM (SELECT *, {_PLACE} AS f FROM events))"
SIGNAL_SQL = f"sig AS (SELECT {_select(SIGNAL)} FROM supplier)"
LANE_SQL = f"lane AS (SELECT track_id, frame, {_select(LANE)} FROM traj)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{_PLACE} AS f")
    return placed.selectExpr(*(f"{e} AS {c}" for c, e in TRAJECTORY.items()))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {c}" for c, e in SIGNAL.items()))


def lanes(traj: DataFrame) -> DataFrame:
    return traj.selectExpr("track_id", "frame", *(f"{e} AS {c}" for c, e in LANE.items()))


def regime_sequence(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """(maneuver_id, w, local_regime): windows of `size` events of a user, the regime being the parity of the first event's id."""
    placed = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{_PLACE} AS f")
    return placed.where(f"f % {size} = 0").selectExpr("user_id AS maneuver_id", f"CAST(floor(f / {size}) AS BIGINT) AS w", "CAST(event_id % 2 AS INT) AS local_regime")


REGIME_SQL = f"seq AS (SELECT user_id AS maneuver_id, CAST(floor(f / 5) AS BIGINT) AS w, CAST(event_id % 2 AS INT) AS local_regime FROM (SELECT *, {_PLACE} AS f FROM events) WHERE f % 5 = 0)"
