"""Scene graphs as two tables, nodes and edges, keyed by frame; every pattern of bounded length is a join tree over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as G

#: Farthest distance at which an object of a type counts.
RANGES = {"car": 50.0, "truck": 50.0, "bus": 50.0, "trailer": 50.0, "construction_vehicle": 50.0, "pedestrian": 40.0, "motorcycle": 40.0, "bicycle": 40.0, "traffic_cone": 30.0, "barrier": 30.0}


def edge_key(a: Column, b: Column) -> Column:
    """Canonical key of an undirected edge."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def path_key(a: Column, pivot: Column, c: Column) -> Column:
    """Canonical key of a two-hop path through its pivot."""
    return F.concat_ws("|", F.least(a, c), pivot, F.greatest(a, c))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns with a prefix, for joins of a table with itself."""
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over all shuffle partitions: a number that is given is never lowered to fit the bytes, which tell nothing of the pairs that a row will make."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def build_edges(nodes: DataFrame, reach: float = 100.0, directed: bool = True) -> DataFrame:
    """All pairs of nodes of a frame within ``reach``: an equi-join on the frame, so work grows with the number of frames.

    nodes: frame, id, type, status, x, y, yaw, vx, vy. Edges: frame, src, dst, both types and statuses, dx, dy, dist, angle (in the source's frame), dir4, dir6, dir8, level.
    """
    nodes = spread(nodes, "frame")
    a, b = prefixed(nodes, "a_"), prefixed(nodes, "b_")
    order = F.col("a_id") != F.col("b_id") if directed else F.col("a_id") < F.col("b_id")
    met = a.join(b, (F.col("a_frame") == F.col("b_frame")) & order)
    met = met.withColumns({"dx": F.col("b_x") - F.col("a_x"), "dy": F.col("b_y") - F.col("a_y")}).withColumn("dist", G.distance(F.col("dx"), F.col("dy"))).where(F.col("dist") <= reach)
    angle = G.bearing(F.col("dx"), F.col("dy"), F.col("a_yaw"))
    return met.select(
        F.col("a_frame").alias("frame"), F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.col("a_type").alias("src_type"), F.col("b_type").alias("dst_type"), F.col("a_status").alias("src_status"), F.col("b_status").alias("dst_status"), "dx", "dy", "dist",
        angle.alias("angle"), G.dir4(angle).alias("dir4"), G.dir6(angle).alias("dir6"), G.dir8(angle).alias("dir8"), G.distance_level(F.col("dist")).alias("level"),
        G.time_to_contact(F.col("dx"), F.col("dy"), F.col("b_vx") - F.col("a_vx"), F.col("b_vy") - F.col("a_vy")).alias("ttc"),
    )


def last_edge(edges: DataFrame, ordinal: str) -> DataFrame:
    """One edge for each ordered pair: of repeated ones the last."""
    w = Window.partitionBy("frame", "src", "dst").orderBy(F.desc(ordinal))
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def removal_reason(kind: Column, dist: Column, visibility: Column, pixels: Column, least_visible: float = 0.4, least_pixels: float = 10.0) -> Column:
    """The first failing check, in order, or null: type, distance, visibility and size in the image (unknown passes)."""
    far = F.create_map(*[F.lit(v) for kv in RANGES.items() for v in kv])
    return (
        F.when(~kind.isin(list(RANGES)), "type").when(dist > far[kind], "distance")
        .when(visibility < least_visible, "visibility").when(pixels < least_pixels, "pixels")
    )


def pixel_height(height: Column, dist: Column) -> Column:
    return height * 1266.0 / F.greatest(dist, F.lit(1.0))


def induced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose both ends are kept."""
    keys = kept.select("frame", "id")
    return edges.join(keys.withColumnRenamed("id", "src"), ["frame", "src"], "left_semi").join(keys.withColumnRenamed("id", "dst"), ["frame", "dst"], "left_semi")


def two_hop_paths(edges: DataFrame) -> DataFrame:
    """frame, a, b, c for directed a to b to c with a < c, all different."""
    one = edges.select("frame", F.col("src").alias("a"), F.col("dst").alias("b"))
    two = edges.select("frame", F.col("src").alias("b"), F.col("dst").alias("c"))
    return one.join(two, ["frame", "b"]).where("a < c").select("frame", "a", "b", "c").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """frame, node, other: both directions of every edge, once."""
    return edges.select("frame", F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select("frame", F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def pivot_universe(edges: DataFrame) -> DataFrame:
    """frame, a, pivot, c: all unordered pairs of neighbours of every node."""
    near = undirected(edges)
    one = near.select("frame", F.col("node").alias("pivot"), F.col("other").alias("a"))
    two = near.select("frame", F.col("node").alias("pivot"), F.col("other").alias("c"))
    return one.join(two, ["frame", "pivot"]).where("a < c")


def converging(edges: DataFrame, a: DataFrame) -> DataFrame:
    """frame, a, c, x with edges a to x and c to x, for the given pairs (frame, a, c); directions and types come along."""
    left = edges.select("frame", F.col("src").alias("a"), F.col("dst").alias("x"), F.col("dir6").alias("dir_a"), F.col("dst_type").alias("x_type"))
    right = edges.select("frame", F.col("src").alias("c"), F.col("dst").alias("x"), F.col("dir6").alias("dir_c"))
    return a.join(left, ["frame", "a"]).join(right, ["frame", "c", "x"])


def siblings(edges: DataFrame) -> DataFrame:
    """Each edge with the number of targets that the source sees with the same type and dir8; one sibling means the pair is unique."""
    return edges.withColumn("siblings", F.count("*").over(Window.partitionBy("frame", "src", "dst_type", "dir8")))


def graph_signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """frame, signature: sorted type counts and sorted edge directions; equal for graphs that could be isomorphic."""
    types = nodes.groupBy("frame", "type").count().groupBy("frame").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "type", "count")))).alias("types"))
    dirs = edges.groupBy("frame", "dir4").count().groupBy("frame").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "dir4", "count")))).alias("dirs"))
    return types.join(dirs, "frame", "left").select("frame", F.concat_ws("#", "types", F.coalesce("dirs", F.lit(""))).alias("signature"))


def degree_motifs(edges: DataFrame) -> DataFrame:
    """frame, forks, converges, chains: two-edge motifs from degrees alone, without listing them."""
    out = edges.groupBy("frame", F.col("src").alias("node")).agg(F.count("*").alias("o"))
    into = edges.groupBy("frame", F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    both = out.join(into, ["frame", "node"], "full").fillna(0, ["o", "i"])
    return both.groupBy("frame").agg(F.sum(F.expr("o * (o - 1) div 2")).alias("forks"), F.sum(F.expr("i * (i - 1) div 2")).alias("converges"), F.sum(F.expr("o * i")).alias("chains"))


def nearest_within(points: DataFrame, others: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """Each point with the nearest other of equal ``keys`` within ``reach`` (smallest id on ties); points without one go.

    Both sides: keys, id, x, y. The range becomes equality of grid cells of side ``reach``, each point looking into nine.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    p = points.withColumn("_gx", around("x")).withColumn("_gy", around("y"))
    o = others.select(*keys, F.col("id").alias("other"), F.col("x").alias("_ox"), F.col("y").alias("_oy"), cell("x").alias("_gx"), cell("y").alias("_gy"))
    met = p.join(o, [*keys, "_gx", "_gy"]).withColumn("dist", G.distance(F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy"))).where(F.col("dist") < reach)
    best = met.groupBy(*keys, "id").agg(F.min(F.struct("dist", "other")).alias("best"))
    return best.select(*keys, "id", "best.other", "best.dist")
