"""All features of all windows of maneuvers, from trajectories to window records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotrace.operators import interactions as I
from velotrace.operators import records as R
from velotrace.operators import windows as W
from velotrace.sources.storage import materialize


class WindowBuilder:
    """Slices, windows and features of maneuvers (ego_id, other_id, t_start, t_end).

    Each kind of features is optional: traffic needs nothing more, infrastructure needs `lanes` (track_id, frame and
    lane columns) and `signals` (name, x, y). For records, which have several kinds, the rows of the windows are
    computed once and written to the shared folder; one kind alone reads them as they are computed.
    """

    def __init__(self, traj: DataFrame, maneuvers: DataFrame, maneuver_type: str = "interaction", win_s: float = 1.0, overlap: float = 0.5, fps: float = 12.5, ego_only: bool = False, riding: bool = True, traffic: bool = True, lanes: DataFrame | None = None, signals: DataFrame | None = None):
        self.traj, self.maneuvers, self.maneuver_type = traj, maneuvers.select(*W.ID), maneuver_type
        self.window = (win_s, overlap, fps)
        self.ego_only, self.with_riding, self.with_traffic, self.lanes, self.signals = ego_only, riding, traffic, lanes, signals
        self._rows: DataFrame | None = None

    def slices(self) -> DataFrame:
        """Rows of the maneuvers' tracks, with the fluctuation of their rotation."""
        rows = I.slice_maneuvers(self.traj, self.maneuvers, self.ego_only).withColumnRenamed("member_id", "track_id")
        return W.rotation_fluctuation(rows, [*W.ID, "track_id"], ["frame"])

    def rows(self) -> DataFrame:
        """Slices' rows with the windows (w, f0, f1) that they fall in."""
        return W.window_rows(self.slices(), W.ID, *self.window) if self._rows is None else self._rows

    def windows(self) -> DataFrame:
        """Bounds of all windows, also of those without rows."""
        spans = self.slices().groupBy(*W.ID).agg(F.min("timestamp").alias("first_t"), F.max("timestamp").alias("last_t"))
        return W.sliding_windows(spans, W.ID, *self.window)

    def riding(self) -> DataFrame:
        return W.riding_features(self.rows(), W.ID)

    def traffic(self, compat: bool = False) -> DataFrame:
        near = I.encounters(self.traj, self.maneuvers.withColumnRenamed("ego_id", "track_id"))
        return W.traffic_features(self.rows(), W.frame_safety(near, ["ego_id", "t_start", "t_end", "frame"]), W.ID, compat=compat)

    def infrastructure(self) -> DataFrame:
        rows = self.rows().select(*W.ID, "track_id", "frame", "w", "translation_x", "translation_y")
        places = rows.select("track_id", "frame", "translation_x", "translation_y").distinct()
        near = W.signal_distances(places, self.signals)
        return W.infrastructure_features(rows.join(W.lane_columns(self.lanes), ["track_id", "frame"]).join(near, ["track_id", "frame"]), W.ID)

    def records(self) -> DataFrame:
        """One window record per window, with a struct for each kind of features, null where a kind is left out."""
        if self._rows is None:
            self._rows = materialize(self.rows(), "windows")
        infrastructure = self.infrastructure() if self.lanes is not None and self.signals is not None else None
        return R.window_records(self.windows(), self.maneuver_type, self.riding() if self.with_riding else None, self.traffic() if self.with_traffic else None, infrastructure)
