"""Questions over scene graphs: a small plan of node and edge conditions, compiled to joins for all frames at once.

An object expression names conditions on a node and up to two relations to other expressions; a question asks for existence,
count, status, type or a comparison. Nothing is collected: each answer table has one row for each frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """The object stands in ``direction`` (of convention ``column``) seen from ``ref``; ``within`` bounds the distance."""

    ref: "Obj"
    direction: str | None = None
    column: str = "dir6"
    within: float | None = None


@dataclass(frozen=True)
class Obj:
    """A node: wildcards where a condition is None."""

    type: str | None = None
    status: str | None = None
    id: int | None = None
    relations: tuple[Relation, ...] = field(default=())


def matches(nodes: DataFrame, edges: DataFrame, obj: Obj) -> DataFrame:
    """frame, id, type, status of the nodes that fit; a row for each way to fit, as in a graph match."""
    out = nodes.select("frame", "id", "type", "status", "x", "y", "vx", "vy")
    for value, column in ((obj.type, "type"), (obj.status, "status"), (obj.id, "id")):
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    for rel in obj.relations:
        way = edges
        if rel.direction is not None:
            way = way.where(F.col(rel.column) == rel.direction)
        if rel.within is not None:
            way = way.where(F.col("dist") <= rel.within)
        refs = matches(nodes, edges, rel.ref).select("frame", F.col("id").alias("src"))
        out = out.join(way.select("frame", "src", F.col("dst").alias("id")), ["frame", "id"]).join(refs, ["frame", "src"]).drop("src")
    return out


def _per_frame(nodes: DataFrame, found: DataFrame, answer: Column, default) -> DataFrame:
    got = found.groupBy("frame").agg(answer.alias("answer"))
    return nodes.select("frame").distinct().join(got, "frame", "left").fillna({"answer": default} if default is not None else {})


def count_query(nodes: DataFrame, edges: DataFrame, obj: Obj, distinct: bool = True) -> DataFrame:
    """frame, answer: matching nodes, or rows of the match."""
    return _per_frame(nodes, matches(nodes, edges, obj), F.count_distinct("id") if distinct else F.count("*"), 0)


def exist_query(nodes: DataFrame, edges: DataFrame, obj: Obj) -> DataFrame:
    """frame, answer: yes or no."""
    return count_query(nodes, edges, obj).select("frame", F.when(F.col("answer") > 0, "yes").otherwise("no").alias("answer"))


def first_query(nodes: DataFrame, edges: DataFrame, obj: Obj, prop: str) -> DataFrame:
    """frame, answer: status or type of the matching node of smallest id; null without one."""
    return _per_frame(nodes, matches(nodes, edges, obj), F.min_by(prop, "id"), None)


def comparison_query(nodes: DataFrame, edges: DataFrame, one: Obj, other: Obj, prop: str = "status") -> DataFrame:
    """frame, answer: yes if any pair of different matches agrees in ``prop``."""
    a = matches(nodes, edges, one).select("frame", F.col(prop).alias("p"), F.col("id").alias("i")).distinct()
    b = matches(nodes, edges, other).select("frame", F.col(prop).alias("p"), F.col("id").alias("j")).distinct()
    hit = a.join(b, ["frame", "p"]).where("i <> j").select("frame").distinct().withColumn("hit", F.lit(True))
    return nodes.select("frame").distinct().join(hit, "frame", "left").select("frame", F.when(F.col("hit"), "yes").otherwise("no").alias("answer"))


def same_status_query(nodes: DataFrame, edges: DataFrame, ref: Obj, kind: str | None = None, other_type: bool = False) -> DataFrame:
    """frame, answer: other nodes of the reference's status (the match of smallest id), of a type or of any other type."""
    anchor = matches(nodes, edges, ref).groupBy("frame").agg(F.min(F.struct("id", "status", "type")).alias("r"))
    met = nodes.join(anchor, "frame").where((F.col("status") == F.col("r.status")) & (F.col("id") != F.col("r.id")))
    if kind is not None:
        met = met.where(F.col("type") == kind)
    if other_type:
        met = met.where(F.col("type") != F.col("r.type"))
    return _per_frame(nodes, met, F.count("*"), 0)


def count_comparison(nodes: DataFrame, edges: DataFrame, one: Obj, other: Obj) -> DataFrame:
    """frame, first, second, answer: which is more (first on ties)."""
    a = count_query(nodes, edges, one).withColumnRenamed("answer", "first")
    b = count_query(nodes, edges, other).withColumnRenamed("answer", "second")
    return a.join(b, "frame").withColumn("answer", F.when(F.col("second") > F.col("first"), "second").otherwise("first"))


def extreme_query(nodes: DataFrame, edges: DataFrame, obj: Obj, prop: str = "id", farthest: bool = False) -> DataFrame:
    """frame, answer: a property of the match nearest to (or farthest from) the origin; ties go to the smaller id."""
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    order = F.struct((-d if farthest else d).alias("d"), F.col("id").alias("i"))
    return _per_frame(nodes, matches(nodes, edges, obj), F.min_by(prop, order), None)


def types_present(nodes: DataFrame) -> DataFrame:
    """frame, n_types, types (sorted, joined by |)."""
    return nodes.groupBy("frame").agg(F.count_distinct("type").alias("n_types"), F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))


def between_query(nodes: DataFrame, one: int, other: int, kind: str, least_radius: float = 0.1) -> DataFrame:
    """frame, answer: whether a node of the type lies in the circle whose diameter joins the two nodes with these places in their frame (from 0)."""
    placed = nodes.withColumn("k", F.row_number().over(Window.partitionBy("frame").orderBy("id")) - 1)
    a = placed.where(F.col("k") == one).select("frame", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("id").alias("ai"))
    b = placed.where(F.col("k") == other).select("frame", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("id").alias("bi"))
    circle = a.join(b, "frame").select("frame", "ai", "bi", ((F.col("ax") + F.col("bx")) / 2).alias("cx"), ((F.col("ay") + F.col("by")) / 2).alias("cy"), (F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) / 2).alias("r"))
    hit = nodes.where(F.col("type") == kind).join(circle, "frame").where((F.col("r") >= least_radius) & ~F.col("id").isin(F.col("ai"), F.col("bi")) & (F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("r")))
    return _per_frame(nodes, hit, F.count("*"), 0).select("frame", F.when(F.col("answer") > 0, "yes").otherwise("no").alias("answer"))


def verify_unique(matched: DataFrame, expected: DataFrame) -> DataFrame:
    """frame, n, verdict: whether exactly the expected node (frame, id) remains: ok, empty, many or wrong."""
    got = matched.groupBy("frame").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only"))
    both = expected.join(got, "frame", "left").fillna({"n": 0})
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("n") > 1, "many").when(F.col("only") != F.col("id"), "wrong").otherwise("ok")
    return both.select("frame", "n", verdict.alias("verdict"))
