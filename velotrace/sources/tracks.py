"""Reading and writing tracks, metadata, interactions, maneuvers and windows; materialise-once caching."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FPS = 12.5
_D, _L, _I = T.DoubleType(), T.LongType(), T.IntegerType()
_struct = lambda names, kind=_D: T.StructType([T.StructField(n, kind) for n in names])

TRACK = T.StructType([T.StructField("timestamp", _D), T.StructField("track_id", _L), T.StructField("category", _I), *_struct("translation_x translation_y velocity_x velocity_y acceleration_x acceleration_y rotation_z".split())])
DROPPED = ("dimension_z", "interpolated")
INTERACTION = T.StructType([T.StructField("track_id", _L), T.StructField("other_id", _L), *_struct("t_start t_end duration dist_min dist_mean rel_speed rel_heading".split()), T.StructField("is_crossing", _I)])
FOLLOWING_FEATURES = _struct("long_distance_min long_distance_mean lateral_offset_mean thw_mean thw_min follower_speed_mean leader_speed_mean speed_diff_mean rel_heading_std".split())
OVERTAKING_FEATURES = T.StructType([T.StructField("left_side", T.BooleanType()), *_struct("long_distance_min long_distance_max lateral_offset_start lateral_offset_end lateral_offset_max lateral_offset_cross follower_speed_mean leader_speed_mean speed_diff_mean follower_acc_max".split())])
REGIMES = T.StructType([T.StructField("maneuver_id", _L), T.StructField("n_windows", _L), T.StructField("is_active", T.BooleanType()), *_struct("p_volatile transition_rate mean_run_volatile std_run_volatile mean_volatile_gap".split())])
_MANEUVER = [T.StructField("id", _L), T.StructField("ego_id", _L), T.StructField("other_id", _L), *_struct("t_start t_end duration".split()), T.StructField("cluster_id", _I), T.StructField("regime_aggregation", REGIMES)]
FOLLOWING = T.StructType([*_MANEUVER, T.StructField("features", FOLLOWING_FEATURES)])
OVERTAKING = T.StructType([*_MANEUVER, T.StructField("t_cross", _D), T.StructField("features", OVERTAKING_FEATURES)])
RIDING = _struct("speed_max speed_min speed_mean speed_std speed_mad speed_qcv acc_max acc_min acc_mean acc_std acc_mad acc_qcv rot_fluc_mad rot_fluc_std rot_fluc_max_abs".split())
# Names of the features.
TRAFFIC = _struct(
    """
    car_count_mean car_count_max pedestrian_count_mean pedestrian_count_max bicycle_count_mean bicycle_count_max
    car_min_ttc_min car_min_ttc_p10 car_fraction_ttc_below_1_5s car_max_num_ttc_below_1_5s car_ttc_exposure_1_5s
    car_fraction_ttc_below_2s car_max_num_ttc_below_2s car_ttc_exposure_2s car_fraction_ttc_below_3s
    car_max_num_ttc_below_3s car_ttc_exposure_3s car_max_drac car_max_drac_p90 car_min_dca_min car_min_dca_p10
    car_fraction_dca_below_th pedestrian_min_ttc_min pedestrian_min_ttc_p10 pedestrian_fraction_ttc_below_1_5s
    pedestrian_max_num_ttc_below_1_5s pedestrian_ttc_exposure_1_5s pedestrian_fraction_ttc_below_2s
    pedestrian_max_num_ttc_below_2s pedestrian_ttc_exposure_2s pedestrian_fraction_ttc_below_3s
    pedestrian_max_num_ttc_below_3s pedestrian_ttc_exposure_3s pedestrian_max_drac pedestrian_max_drac_p90
    pedestrian_min_dca_min pedestrian_min_dca_p10 pedestrian_fraction_dca_below_th bicycle_min_ttc_min
    bicycle_min_ttc_p10 bicycle_fraction_ttc_below_1_5s bicycle_max_num_ttc_below_1_5s bicycle_ttc_exposure_1_5s
    bicycle_fraction_ttc_below_2s bicycle_max_num_ttc_below_2s bicycle_ttc_exposure_2s bicycle_fraction_ttc_below_3s
    bicycle_max_num_ttc_below_3s bicycle_ttc_exposure_3s bicycle_max_drac bicycle_max_drac_p90 bicycle_min_dca_min
    bicycle_min_dca_p10 bicycle_fraction_dca_below_th
    """.split()
)
INFRASTRUCTURE = _struct("p_on_motorway p_on_bikelane p_on_sidewalk offset_lane_center rel_offset_lane_center rel_position_lane left_clearance min_lateral_clearance max_lateral_clearance lane_width distance_traffic_light distance_regulatory_sign distance_warning_sign".split())
WINDOW = T.StructType([
    T.StructField("meta", T.StructType([T.StructField("maneuver_id", _L), T.StructField("maneuver_type", T.StringType()), T.StructField("ego_id", _L)])),
    T.StructField("t_start", _D), T.StructField("t_end", _D), T.StructField("riding", RIDING), T.StructField("traffic", TRAFFIC), T.StructField("infrastructure", INFRASTRUCTURE), T.StructField("local_regime", _I),
])


def read_tracks(spark: SparkSession, path: str, fps: float = FPS) -> DataFrame:
    """Tracks from a CSV file or a folder of them, columns by header name, with the whole number of the frame. Columns beyond the schema are not read; of several rows of one track and frame one stays; order is left to the writer."""
    header = spark.read.option("header", True).csv(path)
    rows = header.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in TRACK]).withColumn("frame", F.rint(F.col("timestamp") * fps).cast("long"))
    return one_row_per_frame(rows)


def one_row_per_frame(rows: DataFrame) -> DataFrame:
    """Of the rows of one (track_id, frame) the earliest, of equal times the one with the smallest values."""
    rest = [c for c in rows.columns if c not in ("track_id", "frame", "timestamp")]
    one = rows.groupBy("track_id", "frame").agg(F.min(F.struct("timestamp", *rest)).alias("r"))
    return one.select("track_id", "frame", "r.*").select(*rows.columns)


def write_tracks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_metadata(spark: SparkSession, path: str) -> dict[str, int]:
    """Category names and codes of a JSON object's "categories"."""
    rows = spark.read.option("multiLine", True).json(path).select("categories.*").first()
    return {k: int(v) for k, v in rows.asDict().items() if v is not None}


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTION).option("header", True).csv(path)


def write_interactions(df: DataFrame, path: str) -> None:
    df.select(*INTERACTION.names).write.mode("overwrite").option("header", True).csv(path)


def flatten(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Struct columns as columns named prefix_field; a null struct gives nulls."""
    out = []
    for f in df.schema:
        out += [F.col(f.name)[g.name].alias(f"{prefixes[f.name]}_{g.name}") for g in f.dataType] if f.name in prefixes else [F.col(f.name)]
    return df.select(*out)


def unflatten(df: DataFrame, structs: dict[str, tuple[str, T.StructType]]) -> DataFrame:
    """The reverse: {struct: (prefix, type)}; all fields null gives a null struct."""
    used = {f"{p}_{g.name}" for p, s in structs.values() for g in s}
    made = [F.when(F.coalesce(*[F.col(f"{p}_{g.name}").cast("string") for g in s]).isNotNull(), F.struct(*[F.col(f"{p}_{g.name}").alias(g.name) for g in s])).alias(n) for n, (p, s) in structs.items()]
    return df.select(*[c for c in df.columns if c not in used], *made)


def write_maneuvers_csv(df: DataFrame, path: str, digits: int = 3) -> None:
    """Flat CSV of distinct maneuvers, floating-point columns rounded half to even."""
    flat = flatten(df, {f.name: f.name for f in df.schema if isinstance(f.dataType, T.StructType)})
    flat.select(*[F.bround(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in flat.schema]).distinct().write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """Gzipped JSON, a record a line, nulls kept as missing keys."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_lists(df: DataFrame, path: str) -> None:
    """Gzipped JSON, one array of records for each partition, written as it comes."""

    def run(batches):
        before = "["
        for b in batches:
            text = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [("" if k else before) + t if not k else "," + t for k, t in enumerate(text)]})
            before = "," if text else before
        yield pa.RecordBatch.from_pydict({"value": ["[]" if before == "[" else "]"]})

    lines = df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string")
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType, array: bool = False) -> DataFrame:
    """Gzipped JSON records with nested optional structs; `array`: each file is one JSON array. A missing key or null gives null."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def load_or_process(spark: SparkSession, path: str, process: Callable[[], DataFrame], load: Callable[[str], DataFrame] | None = None, save: Callable[[DataFrame, str], None] | None = None, force: bool = False) -> DataFrame:
    """What is at path, or else (or if `force`) what process() gives, saved there first. Parquet unless load and save say otherwise."""
    load = load or spark.read.parquet
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if force or not there:
        (save or (lambda df, to: df.write.mode("overwrite").parquet(to)))(process(), path)
    return load(path)
