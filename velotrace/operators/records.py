"""Window records with nested features, their flat form, grouping, and matrices of maneuvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velotrace.sources import tracks as T

KEYS = ["ego_id", "other_id", "t_start", "t_end", "w"]
PREFIX = {"riding": "ride", "traffic": "env", "infrastructure": "infra"}
KINDS = {"riding": T.RIDING, "traffic": T.TRAFFIC, "infrastructure": T.INFRASTRUCTURE}


def window_records(windows: DataFrame, maneuver_type: str, riding: DataFrame | None = None, traffic: DataFrame | None = None, infrastructure: DataFrame | None = None) -> DataFrame:
    """One record per window: meta, bounds in seconds and a struct for each kind of features, null where that kind isn't given or has no row for the window."""
    out = windows.select(*KEYS, F.struct(*[F.col(k) for k in KEYS[:4]], F.lit(maneuver_type).alias("maneuver_type")).alias("meta"), (F.col("f0") / 12.5).alias("win_start"), (F.col("f1") / 12.5).alias("win_end"))
    for name, features in (("riding", riding), ("traffic", traffic), ("infrastructure", infrastructure)):
        if features is None:
            out = out.withColumn(name, F.lit(None).cast(KINDS[name]))
        else:
            out = out.join(features.select(*KEYS, F.struct(*[c for c in features.columns if c not in KEYS]).alias(name)), KEYS, "left")
    return out


def flat_records(records: DataFrame) -> DataFrame:
    """Feature structs as columns with prefixes ride_, env_ and infra_."""
    kinds = {f.name: f.dataType for f in records.schema}
    named = [F.col(n)[g].alias(f"{p}_{g}") for n, p in PREFIX.items() if hasattr(kinds[n], "names") for g in kinds[n].names]
    return records.select(*KEYS, "win_start", "win_end", *named)


def group_windows(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row per maneuver with its windows in order; a maneuver has as many windows as its time allows."""
    return records.groupBy(*KEYS[:4]).agg(F.sort_array(F.collect_list(F.struct("w", *columns))).alias("windows"))


def maneuver_matrix(maneuvers: DataFrame, regimes: DataFrame, features: list[str], exclude: tuple[str, ...] = (), on: list[str] = KEYS[:4]) -> tuple[DataFrame, list[str]]:
    """Maneuvers joined with their regime aggregation by `on`, and the active columns: features first, then those of the regimes."""
    own = [c for c in regimes.columns if c not in (*KEYS, *on)]
    return maneuvers.join(regimes, on), [c for c in (*features, *own) if c not in exclude]


def ecdf(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Distinct values of each group with the share of values at or below; counted first, so a group's window is over its distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return counts.select(*by, column, (F.sum("n").over(w.orderBy(column)) / F.sum("n").over(w)).alias("share"))
