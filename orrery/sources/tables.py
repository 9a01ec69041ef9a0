"""Schemas and readers: token-keyed tables, submissions, scene graphs and question files, each normalised to one fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The relational tables of a recording, as DDL. Tokens are strings; times are microseconds.
SCHEMAS = {
    "attribute": "token string, name string, description string",
    "category": "token string, name string, description string, index int",
    "visibility": "token string, level string, description string",
    "sensor": "token string, channel string, modality string",
    "calibrated_sensor": "token string, sensor_token string, translation array<double>, rotation array<double>, camera_intrinsic array<array<double>>",
    "ego_pose": "token string, translation array<double>, rotation array<double>, timestamp bigint",
    "log": "token string, logfile string, vehicle string, date_captured string, location string",
    "scene": "token string, name string, description string, log_token string, nbr_samples bigint, first_sample_token string, last_sample_token string",
    "sample": "token string, timestamp bigint, scene_token string, prev string, next string",
    "sample_data": "token string, sample_token string, ego_pose_token string, calibrated_sensor_token string, filename string, fileformat string, width bigint, height bigint, timestamp bigint, is_key_frame boolean, prev string, next string",
    "sample_annotation": "token string, sample_token string, instance_token string, visibility_token string, attribute_tokens array<string>, translation array<double>, size array<double>, rotation array<double>, num_lidar_pts bigint, num_radar_pts bigint, prev string, next string",
    "instance": "token string, category_token string, nbr_annotations bigint, first_annotation_token string, last_annotation_token string",
    "map": "token string, log_tokens array<string>, category string, filename string",
}
BOX = "sample_token string, translation array<double>, size array<double>, rotation array<double>, velocity array<double>, detection_name string, detection_score double, attribute_name string, tracking_id string, tracking_name string, tracking_score double"
NODE = "unique_id string, id string, type string, category string, translation struct<x double, y double, z double>, rotation array<double>, status string, attributes array<string>, size struct<width double, length double, height double>, velocity struct<vx double, vy double, vz double>, num_lidar_pts bigint"
EDGE = "source string, src string, `from` string, target string, dst string, `to` string, predicates array<string>, direction_6 string, distance double, metrics struct<distance double, angle double>"
GRAPH = f"scene_name string, frame_idx bigint, nodes array<struct<{NODE}>>, objects array<struct<{NODE}>>, edges array<struct<{EDGE}>>, relationships array<struct<{EDGE}>>"


def read_table_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One relational table, a JSON list in a file or folder."""
    return spark.read.schema(SCHEMAS[name]).json(path, multiLine=True)


def read_submission(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """One row for each box of {meta, results: {sample: [box]}}; more than ``most`` boxes in a sample are an error."""
    raw = spark.read.schema(f"results map<string, array<struct<{BOX}>>>").json(path, multiLine=True)
    by_sample = raw.select(F.explode("results").alias("sample", "boxes"))
    checked = by_sample.withColumn("boxes", F.when(F.size("boxes") <= most, F.col("boxes")).otherwise(F.raise_error(F.format_string("too many boxes in sample %s", "sample"))))
    return checked.select(F.explode("boxes").alias("b")).select("b.*")


def read_scene_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of scene-graph files in any of the accepted spellings; of repeated edges the last stays."""
    from orrery.operators.graph import last_edge

    raw = spark.read.schema(GRAPH).json(path, multiLine=True, mode="DROPMALFORMED")
    frame = F.concat_ws("/", "scene_name", "frame_idx").alias("frame")
    n = raw.select(frame, F.explode(F.coalesce("objects", "nodes")).alias("n"))
    nodes = n.select("frame", F.coalesce("n.unique_id", "n.id").alias("id"), "n.type", "n.status", F.col("n.translation.x").alias("x"), F.col("n.translation.y").alias("y"), F.col("n.velocity.vx").alias("vx"), F.col("n.velocity.vy").alias("vy"))
    e = raw.select(frame, F.posexplode(F.coalesce("relationships", "edges")).alias("k", "e"))
    edges = e.select("frame", "k", F.coalesce("e.source", "e.src", F.col("e.`from`")).alias("src"), F.coalesce("e.target", "e.dst", F.col("e.`to`")).alias("dst"), F.coalesce(F.col("e.direction_6"), F.get("e.predicates", F.lit(0))).alias("direction"), F.coalesce("e.distance", "e.metrics.distance").alias("dist"))
    return nodes, last_edge(edges, "k").drop("k")


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """frame, fault, id: nodes without id, repeated ids, edge ends without a node."""
    missing = nodes.where("id is null").select("frame", F.lit("no id").alias("fault"), "id")
    repeated = nodes.groupBy("frame", "id").count().where("count > 1 and id is not null").select("frame", F.lit("repeated id").alias("fault"), "id")
    ends = edges.select("frame", F.explode(F.array("src", "dst")).alias("id")).distinct()
    loose = ends.join(nodes.select("frame", "id"), ["frame", "id"], "left_anti").select("frame", F.lit("dangling edge").alias("fault"), "id")
    return missing.unionByName(repeated).unionByName(loose)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """sample_token, question, answer, template_type, num_hop from a JSON object with a list, JSON lines or CSV, by suffix."""
    row = "sample_token string, question string, answer string, template_type string, num_hop int"
    if path.endswith(".csv"):
        return spark.read.schema(row).csv(path, header=True)
    if path.endswith(".jsonl"):
        return spark.read.schema(row).json(path)
    return spark.read.schema(f"questions array<struct<{row}>>").json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")


def points_of(content: Column, values: int = 5) -> Column:
    """array<array<float>> of little-endian float32 records, from the bytes of a point file.

    Built-in functions: the bit pattern of each float is taken apart.
    """
    n = F.floor(F.octet_length(content) / (4 * values)).cast("int")
    byte = lambda i: F.conv(F.hex(F.substring(content, i, F.lit(1))), 16, 10).cast("bigint")

    def number(at: Column) -> Column:
        bits = byte(at) + byte(at + 1) * 256 + byte(at + 2) * 65536 + byte(at + 3) * 16777216
        sign = F.when(bits >= 2147483648, -1.0).otherwise(1.0)
        exponent, fraction = F.floor(bits / 8388608) % 256, bits % 8388608
        return (sign * F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-149))).otherwise((1 + fraction / 8388608.0) * F.pow(F.lit(2.0), exponent - 127))).cast("float")

    record = lambda k: F.transform(F.sequence(F.lit(0), F.lit(values - 1)), lambda j: number((k * values + j) * 4 + 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), record)).otherwise(F.array().cast("array<array<float>>"))


def write_aligned(df: DataFrame, columns: list[str], path: str) -> None:
    """CSV in a fixed order of columns: unknown ones go, missing ones are empty, nested cells become JSON."""
    have = {c: t for c, t in df.dtypes}
    cell = lambda c: F.to_json(c) if have[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")
    df.select(*[(cell(c) if c in have else F.lit("")).alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
