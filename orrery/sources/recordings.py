"""Views over the relational tables of a recording: decorated rows, frame numbers, velocities, splits and vehicle messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as G


def decorated_annotations(annotation: DataFrame, instance: DataFrame, category: DataFrame) -> DataFrame:
    """Annotations with category_name; the two dimension tables are joined by token."""
    names = instance.select(F.col("token").alias("instance_token"), "category_token").join(category.select(F.col("token").alias("category_token"), F.col("name").alias("category_name")), "category_token").drop("category_token")
    return annotation.join(names, "instance_token")


def decorated_data(data: DataFrame, calibrated: DataFrame, sensor: DataFrame) -> DataFrame:
    """Sensor data with channel and sensor_modality."""
    names = calibrated.select(F.col("token").alias("calibrated_sensor_token"), "sensor_token").join(sensor.select(F.col("token").alias("sensor_token"), "channel", F.col("modality").alias("sensor_modality")), "sensor_token").drop("sensor_token")
    return data.join(names, "calibrated_sensor_token")


def samples_with_contents(sample: DataFrame, data: DataFrame, annotation: DataFrame) -> DataFrame:
    """Samples with ``data`` (map of channel to the token of its keyframe) and ``anns`` (sorted annotation tokens). ``data`` is decorated."""
    keyed = data.where("is_key_frame").groupBy(F.col("sample_token").alias("token")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.col("token").alias("data_token"))))).alias("data"))
    anns = annotation.groupBy(F.col("sample_token").alias("token")).agg(F.array_sort(F.collect_list(annotation["token"])).alias("anns"))
    return sample.join(keyed, "token", "left").join(anns, "token", "left")


def frame_index(sample: DataFrame) -> DataFrame:
    """Samples with ``frame``, their number in the scene from 0."""
    return sample.withColumn("frame", F.row_number().over(Window.partitionBy("scene_token").orderBy("timestamp", "token")) - 1)


def log_of_map(maps: DataFrame) -> DataFrame:
    """log_token, map_token for every log of every map."""
    return maps.select(F.explode("log_tokens").alias("log_token"), F.col("token").alias("map_token"))


def box_velocity(annotation: DataFrame, sample: DataFrame, longest_s: float = 1.5) -> DataFrame:
    """token, vx, vy: from the neighbours along the chain, or the one that exists; NaN alone, or over more than ``longest_s`` seconds (twice that with both)."""
    at = annotation.join(sample.select(F.col("token").alias("sample_token"), "timestamp"), "sample_token").select("token", "prev", "next", "translation", "timestamp")
    end = lambda p: at.select(F.col("token").alias(f"{p}_token"), F.col("translation").alias(f"{p}_at"), F.col("timestamp").alias(f"{p}_us"))
    j = at.join(end("p"), F.col("prev") == F.col("p_token"), "left").join(end("n"), F.col("next") == F.col("n_token"), "left")
    first, last = F.coalesce("p_at", "translation"), F.coalesce("n_at", "translation")
    seconds = (F.coalesce("n_us", "timestamp") - F.coalesce("p_us", "timestamp")) * 1e-6
    limit = F.when(F.col("p_us").isNotNull() & F.col("n_us").isNotNull(), 2 * longest_s).otherwise(longest_s)
    part = lambda k: F.when((seconds > 0) & (seconds <= limit), (F.get(last, F.lit(k)) - F.get(first, F.lit(k))) / seconds).otherwise(F.lit(float("nan")))
    return j.select("token", part(0).alias("vx"), part(1).alias("vy"))


def in_ego_frame(annotation: DataFrame, sample_data: DataFrame, ego_pose: DataFrame) -> DataFrame:
    """Annotations with ex, ey: their place seen from the ego pose of one keyframe of their sample (``sample_data``: one row a sample)."""
    q = [F.get("rotation", F.lit(k)) for k in range(4)]
    pose = ego_pose.select(F.col("token").alias("ego_pose_token"), F.get("translation", F.lit(0)).alias("ox"), F.get("translation", F.lit(1)).alias("oy"), G.yaw(*q).alias("heading"))
    at = annotation.join(sample_data.select("sample_token", "ego_pose_token"), "sample_token").join(pose, "ego_pose_token")
    x, y = G.to_local(F.get("translation", F.lit(0)), F.get("translation", F.lit(1)), F.col("ox"), F.col("oy"), F.col("heading"))
    return at.withColumns({"ex": x, "ey": y}).drop("ox", "oy", "heading", "ego_pose_token")


def scenes_of_split(scene: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """The scenes of a split, from a table (split, name)."""
    return scene.join(splits.where(F.col("split") == split).select("name"), "name", "left_semi")


def read_messages(spark: SparkSession, path: str, schema: str, blocked: DataFrame | None = None) -> DataFrame:
    """Vehicle messages (JSON lists, one file for a scene) with lower-case columns and ``scene``, the first eight digits and letters before the underscore of the file name; blocked scenes (scene) go."""
    raw = spark.read.schema(schema).json(path, multiLine=True)
    rows = raw.withColumnsRenamed({c: c.lower() for c in raw.columns}).withColumn("scene", F.regexp_extract(F.input_file_name(), r"([^/_]+)_[^/]*$", 1))
    return rows if blocked is None else rows.join(blocked.select("scene"), "scene", "left_anti")


def look_back(data: DataFrame, sweeps: int) -> DataFrame:
    """Keyframes with the tokens of their last ``sweeps`` rows of the channel, oldest first: a bounded window, no chain is walked."""
    w = Window.partitionBy("scene_token", "channel").orderBy("timestamp").rowsBetween(-(sweeps - 1), 0)
    return data.withColumn("sweeps", F.collect_list("token").over(w)).where("is_key_frame")
