"""Vector-map queries: points, polygons, lanes and routes; ranges become equality of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.session import durable


def containing_polygon(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """id, poly: the first polygon (smallest poly) that holds each point; points in none go.

    points: id, x, y. polygons: poly, ring array<struct<x,y>>. A polygon stands in every cell that its bounding box meets.
    """
    met = points.withColumns(_cells(cell)).join(_boxes(polygons, cell), ["gx", "gy"])
    return met.where(G.point_in_ring(F.col("x"), F.col("y"), F.col("ring"))).groupBy("id").agg(F.min("poly").alias("poly"))


def _cells(cell: float) -> dict[str, Column]:
    return {k: F.floor(F.col(c) / cell).cast("int") for k, c in (("gx", "x"), ("gy", "y"))}


def _boxes(polygons: DataFrame, cell: float) -> DataFrame:
    """polygons with gx, gy: a row for each cell that the bounding box of one meets."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    c = lambda v: F.floor(v / cell).cast("int")
    return polygons.withColumn("gx", F.explode(F.sequence(c(F.array_min(xs)), c(F.array_max(xs))))).withColumn("gy", F.explode(F.sequence(c(F.array_min(ys)), c(F.array_max(ys)))))


def records_in_patch(boxes: DataFrame, patch: tuple[float, float, float, float], within: bool) -> DataFrame:
    """Records (x0, y0, x1, y1) that lie within a rectangle, or meet it."""
    a, b, c, d = patch
    if within:
        return boxes.where((F.col("x0") >= a) & (F.col("y0") >= b) & (F.col("x1") <= c) & (F.col("y1") <= d))
    return boxes.where((F.col("x0") <= c) & (F.col("x1") >= a) & (F.col("y0") <= d) & (F.col("y1") >= b))


def sharing_nodes(records: DataFrame, others: DataFrame, every: bool = False) -> DataFrame:
    """id, other, shared: pairs of records of both tables (id, nodes: an array) with exterior nodes in common: any, or all of the first one's.

    The nodes are the join keys, so only records that meet are paired.
    """
    each = records.select("id", F.size(F.array_distinct("nodes")).alias("_n"), F.explode(F.array_distinct("nodes")).alias("node"))
    met = each.join(others.select(F.col("id").alias("other"), F.explode(F.array_distinct("nodes")).alias("node")), "node")
    pairs = met.groupBy("id", "other").agg(F.count("*").alias("shared"), F.first("_n").alias("_n"))
    return (pairs.where("shared = _n") if every else pairs).drop("_n")


def sharing_counts(records: DataFrame) -> DataFrame:
    """kind (any, all), shared, n: how many ordered pairs of different records (id, one row each; nodes, an array) :func:`sharing_nodes` would list, by the number of nodes they share.

    Pairs that share one node are not listed but counted from the records at each node; those that share more meet at pairs of nodes, of which a record (a bounded list) has few.
    Records with equal nodes are one record with a weight, so copies make no pairs either.
    """
    same = records.where("id is not null").select("id", F.array_sort(F.array_distinct("nodes")).alias("nodes")).groupBy("nodes").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    known = F.array_compact("nodes")
    kinds = durable(same.select("id", "m", F.size("nodes").alias("n"), F.size(known).alias("k"), known.alias("nodes")).where("k > 0"), "kinds")
    # of records with equal nodes, and of those with one node, whoever else is there
    equal = kinds.select(F.col("k").alias("shared"), (F.col("m") * (F.col("m") - 1)).alias("any"), F.when(F.col("k") == F.col("n"), F.col("m") * (F.col("m") - 1)).otherwise(0).alias("all"), F.lit(True).alias("equal"))
    each = kinds.select("m", (F.col("n") == 1).alias("single"), F.explode("nodes").alias("node")).groupBy("node").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("single"), F.col("m")).otherwise(0)).alias("single"))
    met = each.select((F.col("m") * (F.col("m") - 1)).alias("any"), (F.col("single") * (F.col("m") - F.col("single"))).alias("all"))
    two = F.flatten(F.transform("nodes", lambda p, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    pairs = kinds.where("k > 1").select("id", "m", "n", F.explode(two).alias("e")).select("e.p", "e.q", "id", "m", "n")
    a, b = (pairs.select("p", "q", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "m", "n")]) for k in ("a", "b"))
    both = a.join(b, ["p", "q"]).where("id_a < id_b").groupBy("id_a", "id_b", "m_a", "m_b", "n_a", "n_b").agg(F.count("*").alias("c"))
    # c pairs of nodes are those of s nodes
    s = F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("int")
    w = F.col("m_a") * F.col("m_b")
    more = both.select(s.alias("shared"), (2 * w).alias("any"), (F.when(s == F.col("n_a"), w).otherwise(0) + F.when(s == F.col("n_b"), w).otherwise(0)).alias("all"), F.lit(False).alias("equal"))
    listed = equal.unionByName(more).groupBy("shared", "equal").agg(F.sum("any").alias("any"), F.sum("all").alias("all"))
    # of all meetings at nodes, those of pairs that share more
    one = met.agg(F.sum("any").alias("any"), F.sum("all").alias("all")).select(F.lit(1).alias("shared"), "any", "all")
    taken = listed.where("not equal or shared > 1").select(F.lit(1).alias("shared"), (-F.col("shared") * F.col("any")).alias("any"), F.lit(0).cast("bigint").alias("all"))
    alone = listed.where("equal and shared = 1").select("shared", F.lit(0).cast("bigint").alias("any"), "all")
    rest = listed.where("shared > 1").select("shared", "any", "all")
    by = one.unionByName(taken).unionByName(alone).unionByName(rest).groupBy("shared").agg(F.sum("any").alias("any"), F.sum("all").alias("all"))
    return by.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("shared").cast("bigint").alias("shared"), F.col(k).alias("n")) for k in ("any", "all")])).alias("r")).select("r.*").where("n > 0")


def nearest_lane(poses: DataFrame, lane_points: DataFrame, reach: float) -> DataFrame:
    """id, lane, dist: the lane with the nearest point within ``reach``; the last lane on ties."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    p = poses.withColumn("gx", around("x")).withColumn("gy", around("y"))
    q = lane_points.select("lane", F.col("x").alias("lx"), F.col("y").alias("ly"), cell("x").alias("gx"), cell("y").alias("gy"))
    met = p.join(q, ["gx", "gy"]).withColumn("dist", F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))).where(F.col("dist") <= reach)
    best = met.groupBy("id").agg(F.min(F.struct("dist", (-F.col("lane")).alias("back"))).alias("b"))
    return best.select("id", (-F.col("b.back")).alias("lane"), F.col("b.dist").alias("dist"))


def discretised(paths: DataFrame, step: float) -> DataFrame:
    """lane, k, x, y, yaw: poses along arcline paths (lane, x, y, yaw in radians, three lengths and curvatures as arrays), by closed forms.

    Evenly many poses: int(max(ceil(length / step) + 1.5, 2)).
    """
    total = F.aggregate("lengths", F.lit(0.0), lambda a, b: a + b)
    n = F.greatest(F.ceil(total / step) + 1, F.lit(2)).cast("int")
    at = paths.withColumn("total", total).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("s", F.col("k") / (n - 1) * F.col("total"))
    x, y, yaw, left = F.col("x"), F.col("y"), F.col("yaw"), F.col("s")
    for i in range(3):
        go = F.greatest(F.lit(0.0), F.least(left, F.get("lengths", F.lit(i))))
        bend = F.get("curvatures", F.lit(i))
        turned = yaw + bend * go
        x, y = (
            x + F.when(bend == 0, go * F.cos(yaw)).otherwise(F.try_divide(F.sin(turned) - F.sin(yaw), bend)),
            y + F.when(bend == 0, go * F.sin(yaw)).otherwise(F.try_divide(F.cos(yaw) - F.cos(turned), bend)),
        )
        yaw, left = turned, left - go
    return at.select("lane", "k", x.alias("x"), y.alias("y"), yaw.alias("yaw"))


def lane_poses(paths: DataFrame, step: float) -> DataFrame:
    """lane, i, x, y, yaw: poses along lanes of several arcline paths (lane, part and what :func:`discretised` reads), numbered from 0 over the parts."""
    each = discretised(paths.withColumn("lane", F.struct("lane", "part")), step)
    order = Window.partitionBy("lane.lane").orderBy("lane.part", "k")
    return each.select(F.col("lane.lane").alias("lane"), (F.row_number().over(order) - 1).alias("i"), "x", "y", "yaw")


def projected_on_lanes(poses: DataFrame, paths: DataFrame, step: float = 0.5) -> DataFrame:
    """id, lane, x, y, yaw, along, distance: the pose of its lane (a bounded list) that is nearest to each of ``poses`` (id, lane, x, y), the first of equally near ones; along counts ``step`` a pose."""
    lanes = lane_poses(paths, step).groupBy("lane").agg(F.collect_list(F.struct("i", "x", "y", "yaw")).alias("_poses"))
    far = F.transform("_poses", lambda q: F.struct(F.hypot(F.col("x") - q["x"], F.col("y") - q["y"]).alias("distance"), q["i"].alias("i"), q["x"].alias("x"), q["y"].alias("y"), q["yaw"].alias("yaw")))
    best = poses.join(lanes, "lane").select("id", "lane", F.array_min(far).alias("b"))
    return best.select("id", "lane", "b.x", "b.y", "b.yaw", (F.col("b.i") * step).alias("along"), "b.distance")


def curvature_along(places: DataFrame, paths: DataFrame) -> DataFrame:
    """``places`` (lane, along) with ``curvature``, unsigned, of the segment that they lie in, the earlier one at a joint; null beyond the end."""
    parts = paths.select("lane", F.struct("part", "lengths", "curvatures").alias("p")).groupBy("lane").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    segments = F.flatten(F.transform("_p", lambda p: F.arrays_zip(p["lengths"].alias("n"), p["curvatures"].alias("c"))))
    # lengths summed up to each segment
    ends = F.transform("_s", lambda s, i: F.struct(F.aggregate(F.slice("_s", 1, i + 1), F.lit(0.0), lambda a, x: a + x["n"]).alias("end"), F.abs(s["c"]).alias("c")))
    first = F.get(F.filter("_e", lambda e: F.col("along") <= e["end"]), F.lit(0))
    return places.join(parts.withColumn("_s", segments).withColumn("_e", ends).select("lane", "_e"), "lane", "left").withColumn("curvature", first["c"]).drop("_e")


def off_road_rate(modes: DataFrame, polygons: DataFrame, size: float, between: int = 8) -> DataFrame:
    """id, modes, rate: the share of a prediction's modes (id, mode, t, x, y) that leave the drivable area, the union of ``polygons`` (poly, ring).

    A mode is the line through its points in time order, looked at in ``between`` places of each step; one of them outside makes it a violation.
    """
    w = Window.partitionBy("id", "mode").orderBy("t")
    steps = modes.select("id", "mode", "t", "x", "y", F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))
    at = steps.withColumn("j", F.explode(F.when(F.col("nx").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(between - 1)))))
    share = F.col("j") / between
    spots = at.select("id", "mode", (F.col("x") + (F.coalesce("nx", "x") - F.col("x")) * share).alias("x"), (F.col("y") + (F.coalesce("ny", "y") - F.col("y")) * share).alias("y"))
    # one row for each cell, so that places meet their polygons where they stand
    rings = _boxes(polygons, size).groupBy("gx", "gy").agg(F.collect_list("ring").alias("_rings"))
    on = F.coalesce(F.exists("_rings", lambda r: G.point_in_ring(F.col("x"), F.col("y"), r)), F.lit(False))
    told = spots.withColumns(_cells(size)).join(rings, ["gx", "gy"], "left").groupBy("id", "mode").agg(F.bool_or(~on).alias("left"))
    return told.groupBy("id").agg(F.count("*").alias("modes"), F.avg(F.col("left").cast("double")).alias("rate"))


def route_distance(poses: DataFrame, route: DataFrame, by: str) -> DataFrame:
    """by, distance: the largest distance of a pose from the nearest point of its route (one route for each ``by``, a bounded list of points)."""
    r = route.groupBy(by).agg(F.collect_list(F.struct("x", "y")).alias("route"))
    nearest = F.array_min(F.transform("route", lambda q: F.hypot(F.col("x") - q["x"], F.col("y") - q["y"])))
    return poses.join(r, by).groupBy(by).agg(F.max(nearest).alias("distance"))


def connected_lanes(links: DataFrame) -> DataFrame:
    """lane, group: lanes joined by links (a, b), by rounds of least neighbours until nothing changes; each round is checkpointed."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    label = both.select(F.col("a").alias("lane")).distinct().withColumn("group", F.col("lane"))
    while True:
        near = both.join(label.withColumnRenamed("lane", "b"), "b").groupBy(F.col("a").alias("lane")).agg(F.min("group").alias("near"))
        new = label.join(near, "lane").select("lane", F.least("group", "near").alias("group"), (F.col("near") < F.col("group")).alias("moved")).checkpoint()
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query, id, cosine, rank: the k vectors of the same group with the largest cosine (a group is bounded, as a frame is)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = queries.select("frame", F.col("id").alias("query"), F.col("vec").alias("q"))
    met = q.join(vectors.select("frame", "id", "vec"), "frame").where("id <> query")
    met = met.withColumn("cosine", dot("q", "vec") / F.sqrt(dot("q", "q") * dot("vec", "vec")))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id")))
    return ranked.where(F.col("rank") <= k).select("query", "id", "cosine", "rank")
