"""Rule-based questions and cameras from node tables: projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G

from .relational import ranked

#: Cameras with the range of bearings (degrees, ends included) that they see.
CAMERAS = (("front", -30.0, 30.0), ("front_left", 30.0, 90.0), ("back_left", 90.0, 150.0), ("back", 150.0, -150.0), ("back_right", -150.0, -90.0), ("front_right", -90.0, -30.0))


def cameras_of(bearing: Column) -> Column:
    """array<string>: a bearing on an edge is seen by two cameras; a range whose start is larger than its end wraps around."""
    b = G.wrap_closed(bearing)
    sees = [F.when((b >= lo) & (b <= hi) if lo <= hi else (b >= lo) | (b <= hi), F.lit(n)) for n, lo, hi in CAMERAS]
    return F.array_compact(F.array(*sees))


def generated_questions(nodes: DataFrame, most: int = 5) -> DataFrame:
    """frame, kind, id, answer from five rules: distance class, sector, movement, approach and the number of objects in front (``most`` at most)."""
    d, a = F.hypot("x", "y"), F.degrees(F.atan2("y", "x"))
    each = lambda kind, answer: nodes.select("frame", F.lit(kind).alias("kind"), "id", answer.alias("answer"))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    front = nodes.groupBy("frame").agg(F.least(F.count_if(F.abs(a) <= 45), F.lit(most)).cast("string").alias("answer")).select("frame", F.lit("count").alias("kind"), F.lit(None).cast("bigint").alias("id"), "answer")
    rules = [each("distance", G.distance_class(d)), each("sector", G.sector8(a)), each("moving", yes(F.col("status") == "moving")), each("approach", yes(G.is_approaching(*[F.col(c) for c in ("x", "y", "vx", "vy")])))]
    out = front
    for r in rules:
        out = out.unionByName(r)
    return out


def boxes_for_evaluation(boxes: DataFrame, limits: dict[str, float], racks: DataFrame | None = None) -> DataFrame:
    """Boxes (sample, id, class, x, y relative to ego, num_pts) nearer than their class's limit, with points (-1 is unknown), and for two-wheelers not inside a rack (sample, x, y, length, width, yaw)."""
    most = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])[F.col("class")]
    kept = boxes.where((F.hypot("x", "y") < most) & (F.col("num_pts") != 0))
    if racks is None:
        return kept
    r = racks.select("sample", F.col("x").alias("rx"), F.col("y").alias("ry"), "length", "width", F.col("yaw").alias("ryaw"))
    inside = (kept["sample"] == r["sample"]) & F.col("class").isin("bicycle", "motorcycle") & G.point_in_box(kept["x"], kept["y"], r["rx"], r["ry"], r["length"], r["width"], r["ryaw"])
    return kept.join(r, inside, "left_anti")


def density_strata(frames: DataFrame, cuts: tuple[float, ...] = (0.2, 0.35, 0.65, 0.8)) -> DataFrame:
    """Frames (frame, objects, types) with their stratum by sorted position of the number of objects, and a score."""
    total = frames.agg(F.count("*").alias("_total"))
    placed = ranked(frames, F.struct("objects", F.expr("frame div 10000")), "objects", "frame").join(F.broadcast(total))
    stratum = sum((F.when(F.col("rank") / F.col("_total") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return placed.withColumn("stratum", stratum).withColumn("score", 10 * F.col("types") + 0.1 * F.col("objects")).drop("rank", "_total")


def representatives(strata: DataFrame) -> DataFrame:
    """stratum, frame: the frame of the highest score in each stratum, ties by frame."""
    return strata.groupBy("stratum").agg(F.min_by("frame", F.struct((-F.col("score")).alias("s"), "frame")).alias("frame"))
