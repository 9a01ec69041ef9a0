"""Answers with what supports them: the nodes and edges of every match behind an aggregate, kept through the joins of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coverage import question_footprint
from .patterns import Obj

NO_EDGES = "array<struct<src:bigint,dst:bigint>>"


def supported_matches(nodes: DataFrame, edges: DataFrame, obj: Obj) -> DataFrame:
    """frame, id, type, status, support: as ``patterns.matches``, with the edges of the way that each row fits."""
    out = nodes.select("frame", "id", "type", "status", F.array().cast(NO_EDGES).alias("support"))
    for value, column in ((obj.type, "type"), (obj.status, "status"), (obj.id, "id")):
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    for rel in obj.relations:
        way = edges if rel.direction is None else edges.where(F.col(rel.column) == rel.direction)
        if rel.within is not None:
            way = way.where(F.col("dist") <= rel.within)
        refs = supported_matches(nodes, edges, rel.ref).select("frame", F.col("id").alias("src"), F.col("support").alias("_of_ref"))
        met = out.join(way.select("frame", "src", F.col("dst").alias("id")), ["frame", "id"]).join(refs, ["frame", "src"])
        edge = F.array(F.struct(F.col("src").cast("bigint").alias("src"), F.col("id").cast("bigint").alias("dst"))).cast(NO_EDGES)
        out = met.withColumn("support", F.concat("support", "_of_ref", edge)).drop("src", "_of_ref")
    return out


def answers_with_support(nodes: DataFrame, edges: DataFrame, obj: Obj, kind: str = "count") -> DataFrame:
    """frame, answer (as text), ids, support: the answer of a question (count, exist, status or object) with the matched nodes and all edges behind it, sorted; for status and object those of the match that answers.

    A frame without a match has the answer of none, and nothing that supports it.
    """
    found = supported_matches(nodes, edges, obj)
    if kind in ("status", "object"):
        first = found.groupBy("frame").agg(F.min("id").alias("id"))
        found = found.join(first, ["frame", "id"])
    answer: dict[str, Column] = {"count": F.count_distinct("id").cast("string"), "exist": F.lit("yes"), "status": F.first("status"), "object": F.first("type")}
    none = {"count": F.lit("0"), "exist": F.lit("no")}.get(kind, F.lit(None).cast("string"))
    support = F.array_sort(F.array_distinct(F.flatten(F.collect_set("support"))))
    got = found.groupBy("frame").agg(answer[kind].alias("answer"), F.array_sort(F.collect_set("id")).alias("ids"), support.alias("support"))
    return nodes.select("frame").distinct().join(got, "frame", "left").select("frame", F.coalesce("answer", none).alias("answer"), F.coalesce("ids", F.array()).alias("ids"), F.coalesce("support", F.array()).alias("support"))


def support_footprint(answers: DataFrame) -> DataFrame:
    """frame, level, key: what an answer covers, as the footprint of the graph of its supporting edges."""
    text = lambda c: F.col(f"e.{c}").cast("string").alias(c)
    edges = answers.select(F.col("frame").alias("qid"), F.explode("support").alias("e")).select("qid", text("src"), text("dst"))
    return question_footprint(edges).withColumnRenamed("qid", "frame")
