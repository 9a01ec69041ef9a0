"""Reference boxes of a recording by split, scene list or sample list; snapshots of universes; baselines of coverage; lists of questions to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators.graph import edge_key

from .recordings import box_velocity


def split_scenes(spark: SparkSession, split: str, predefined: DataFrame, custom: str | None = None) -> DataFrame:
    """name of each scene of a split: of the table ``predefined`` (split, name), or of the file ``custom`` (a JSON object with a list of names for each split).

    A split that neither has is an error.
    """
    own = predefined.where(F.col("split") == split).select("name")
    if not own.isEmpty():
        return own
    if custom is None:
        raise ValueError(f"no split {split}")
    # whatever else the file holds, only a list of names is a split
    listed = spark.read.text(custom, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m")).select(F.element_at("m", F.lit(split)).alias("names"))
    names = listed.where("names is not null").select(F.from_json("names", "array<string>").alias("names"))
    first = names.first()
    if first is None:
        raise ValueError(f"no split {split} in {custom}")
    if first["names"] is None:
        raise ValueError(f"split {split} in {custom} is no list of names")
    return names.select(F.explode("names").alias("name"))


def samples_of(sample: DataFrame, scene: DataFrame, scenes: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """The samples of the given scenes (name), and of these those of the given tokens (token)."""
    out = sample
    if scenes is not None:
        named = scene.join(scenes.select("name"), "name", "left_semi").select(F.col("token").alias("scene_token"))
        out = out.join(named, "scene_token", "left_semi")
    return out if tokens is None else out.join(tokens.select("token"), "token", "left_semi")


def truth_boxes(samples: DataFrame, tables: dict[str, DataFrame], tracking: bool = False) -> DataFrame:
    """Annotations of ``samples`` as boxes: sample_token, token, translation, size, rotation, vx, vy, num_pts, name, score (-1: no score), and attribute_name, or tracking_id where tracked classes are asked for.

    ``tables``: sample, sample_annotation, instance, category, attribute. Categories without a class go. More than one attribute is an error where attributes are
    read; none is an empty name. Velocities come from the whole chain of an object, whatever samples are asked for.
    """
    kinds = tables["instance"].select(F.col("token").alias("instance_token"), "category_token").join(tables["category"].select(F.col("token").alias("category_token"), F.col("name").alias("category")), "category_token")
    name = (T.tracking_class if tracking else T.detection_class)(F.col("category"))
    boxes = tables["sample_annotation"].join(samples.select(F.col("token").alias("sample_token")), "sample_token", "left_semi").join(kinds.withColumn("name", name).where("name is not null"), "instance_token")
    boxes = boxes.join(box_velocity(tables["sample_annotation"], tables["sample"]), "token", "left")
    common = ["sample_token", "token", "translation", "size", "rotation", "vx", "vy", (F.col("num_lidar_pts") + F.col("num_radar_pts")).alias("num_pts"), "name", F.lit(-1.0).alias("score")]
    if tracking:
        return boxes.select(*common, F.col("instance_token").alias("tracking_id"))
    n = F.coalesce(F.size("attribute_tokens"), F.lit(0))
    only = F.when(n > 1, F.raise_error(F.concat(F.lit("more than one attribute: "), "token"))).otherwise(F.get("attribute_tokens", F.lit(0)))
    named = tables["attribute"].select(F.col("token").alias("attribute_token"), F.col("name").alias("attribute_name"))
    return boxes.withColumn("attribute_token", only).join(named, "attribute_token", "left").select(*common, F.coalesce("attribute_name", F.lit("")).alias("attribute_name"))


def read_universes(spark: SparkSession, path: str) -> DataFrame:
    """frame, level, key from the files *_universe.json of a folder, one object each; broken files, and those without scene or frame, are left out."""
    levels = ("L0", "L1", "L2A", "L2B")
    row = "scene_id string, frame_id bigint, " + ", ".join(f"{k} array<string>" for k in levels)
    raw = spark.read.schema(row).json(path, multiLine=True, mode="DROPMALFORMED", pathGlobFilter="*_universe.json").where("scene_id is not null and frame_id is not null")
    each = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in levels]), F.array(*[F.coalesce(k, F.array()) for k in levels]))).alias("level", "keys")
    return raw.select(F.concat_ws("/", "scene_id", "frame_id").alias("frame"), each).select("frame", "level", F.explode("keys").alias("key")).distinct()


BASELINE = "scene_name string, sample_token string, node_ids array<string>, edge_pairs array<array<string>>, cell_info struct<src_id:string, tgt_id:string>, path_pattern string, topology_level string"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a baseline file, a JSON object with the list ``questions`` or ``qa_pairs``."""
    raw = spark.read.schema(f"questions array<struct<{BASELINE}>>, qa_pairs array<struct<{BASELINE}>>").json(path, multiLine=True)
    return raw.select(F.explode(F.coalesce("questions", "qa_pairs")).alias("q")).select("q.*")


def baseline_hits(questions: DataFrame, scene: str | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """level, key, n: what questions (columns of ``read_baseline``) cover already, and how many times; of one scene, of the samples of ``tokens`` (token), or all.

    Nodes are given, edges are pairs or the two ends of a cell and cover their ends, too; a path pattern (a|b|c) of level L2 covers its edges and nodes.
    """
    q = questions if scene is None else questions.where(F.col("scene_name") == scene)
    if tokens is not None:
        q = q.join(tokens.select(F.col("token").alias("sample_token")), "sample_token", "left_semi")
    none: Column = F.array().cast("array<array<string>>")
    cell = F.when((F.coalesce(F.length("cell_info.src_id"), F.lit(0)) > 0) & (F.coalesce(F.length("cell_info.tgt_id"), F.lit(0)) > 0), F.array(F.array("cell_info.src_id", "cell_info.tgt_id"))).otherwise(none)
    steps = F.split("path_pattern", r"\|")
    path = F.when(F.col("topology_level").isin("L2", "L2A", "L2B") & (F.size(steps) == 3), steps)
    at = lambda c, k: F.get(c, F.lit(k))
    walked = F.when(path.isNotNull(), F.array(F.slice(path, 1, 2), F.slice(path, 2, 2))).otherwise(none)
    pairs = F.filter(F.concat(F.coalesce("edge_pairs", none), cell, walked), lambda p: F.size(p) >= 2)
    entry = lambda level, key: F.struct(F.lit(level).alias("level"), key.alias("key"))
    nodes = F.transform(F.concat(F.filter(F.coalesce("node_ids", F.array()), lambda n: F.length(n) > 0), F.flatten(F.transform(pairs, lambda p: F.slice(p, 1, 2)))), lambda n: entry("L0", n))
    edges = F.transform(pairs, lambda p: entry("L1", edge_key(at(p, 0), at(p, 1))))
    ends = F.array_sort(F.array(at(path, 0), at(path, 2)))
    paths = F.when(path.isNotNull(), F.array(entry("L2", F.concat_ws("|", at(ends, 0), at(path, 1), at(ends, 1))))).otherwise(F.array().cast("array<struct<level:string, key:string>>"))
    return q.select(F.explode(F.concat(nodes, edges, paths)).alias("h")).groupBy("h.level", "h.key").agg(F.count("*").alias("n"))


def without_skipped(questions: DataFrame, skipped: DataFrame, order: str) -> DataFrame:
    """Questions (scene, frame, ...) without those that ``skipped`` (scene, frame, ordinal) names by their place in the frame, from 1 in the order of a column."""
    placed = questions.withColumn("ordinal", F.row_number().over(Window.partitionBy("scene", "frame").orderBy(order)))
    return placed.join(skipped.select("scene", "frame", "ordinal"), ["scene", "frame", "ordinal"], "left_anti")
