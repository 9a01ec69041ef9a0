"""Questions as text, answered by joins: regular expressions give the conditions of each question as columns, and one join tree answers all questions of all frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T

#: What questions name. Directions of two words come first, so that they are not read as one.
TYPES = ("construction vehicle", "traffic cone", "car", "truck", "bus", "trailer", "pedestrian", "motorcycle", "bicycle", "barrier", "thing", "object")
STATUSES = ("without rider", "with rider", "not standing", "moving", "stopped", "parked", "standing", "sitting")
DIRECTIONS = ("front left", "front right", "back left", "back right", "front", "back")
_NOUN = rf"(?:({'|'.join(STATUSES)}) )?({'|'.join(TYPES)})(?:es|s)?\b"
_TO = rf"(?:(?:to )?the )?({'|'.join(DIRECTIONS)}) of (?:the |a |an |another )?{_NOUN}"


def parsed(questions: DataFrame) -> DataFrame:
    """``questions`` (text) with family, status, type, direction, ref_status, ref_type, direction2, ref2_status, ref2_type, same (type and status of what a status is compared with); nulls where nothing is named.

    The first noun is what is asked for, in questions "There is a ...; what ... of it" the one after the semicolon.
    """
    # columns of their own, so that each is computed once and not at each place that names it
    told = questions.withColumn("_told", T.normalised_question(F.col("text"))).withColumn("_low", F.lower("_told"))
    q = F.col("_low")
    part = lambda p, k, of=q: F.nullif(F.regexp_extract(of, p, k), F.lit(""))
    # what the questions says before a comparison and after it
    told = told.withColumn("_left", F.substring_index(q, "same status as", 1))
    left = F.col("_left")
    right = F.when(q.contains("same status as"), F.substring_index(q, "same status as", -1))
    second = rf"{_TO}.* and {_TO}"
    both = left.rlike(second)
    return told.withColumns({
        "family": T.question_family(F.col("_told")),
        "status": part(_NOUN, 1, left), "type": part(_NOUN, 2, left), "direction": part(_TO, 1, left), "ref_status": part(_TO, 2, left), "ref_type": part(_TO, 3, left),
        "direction2": F.when(both, part(second, 4, left)), "ref2_status": F.when(both, part(second, 5, left)), "ref2_type": F.when(both, part(second, 6, left)),
        "same_status": part(_NOUN, 1, right), "same_type": part(_NOUN, 2, right),
    }).drop("_told", "_low", "_left")


def _fits(kind: Column, status: Column, asked_kind: Column, asked_status: Column) -> Column:
    return (asked_kind.isNull() | T.type_matches(kind, asked_kind)) & (asked_status.isNull() | T.status_matches(status, asked_status, kind))


def answered(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """frame, qid, family, answer of questions (frame, qid, text): yes or no, a count, or the status or type of the fitting node of smallest id; null where nothing fits or the family is general.

    A comparison asks whether a fitting node and another one that fits the right side have the same status.
    """
    q = parsed(questions)
    met = q.join(nodes.select("frame", "id", F.col("type").alias("kind"), F.col("status").alias("state")), "frame").where(_fits(F.col("kind"), F.col("state"), F.col("type"), F.col("status")))
    for way, ref in (("direction", "ref"), ("direction2", "ref2")):
        seen = edges.select("frame", F.col("dst").alias("id"), F.replace("dir6", F.lit("_"), F.lit(" ")).alias("_way"), F.col("src_type").alias("_kind"), F.col("src_status").alias("_state"))
        asked = met.where(F.col(way).isNotNull())
        fits = asked.join(seen, ["frame", "id"]).where((F.col("_way") == F.col(way)) & _fits(F.col("_kind"), F.col("_state"), F.col(f"{ref}_type"), F.col(f"{ref}_status"))).drop("_way", "_kind", "_state").dropDuplicates(["frame", "qid", "id"])
        met = met.where(F.col(way).isNull()).unionByName(fits)
    other = nodes.select("frame", F.col("id").alias("_id"), F.col("type").alias("_kind"), F.col("status").alias("state"))
    same = met.where("same_type is not null").join(other, ["frame", "state"]).where((F.col("id") != F.col("_id")) & _fits(F.col("_kind"), F.col("state"), F.col("same_type"), F.col("same_status")))
    agree = same.select("frame", "qid").distinct().withColumn("_agree", F.lit(True))
    found = met.groupBy("frame", "qid").agg(F.count("*").alias("n"), F.min_by("state", "id").alias("state"), F.min_by("kind", "id").alias("kind"))
    out = q.select("frame", "qid", "family").join(found, ["frame", "qid"], "left").join(agree, ["frame", "qid"], "left")
    n, yes = F.coalesce("n", F.lit(0)), lambda c: F.when(c, "yes").otherwise("no")
    answers = {"exist": yes(n > 0), "count": n.cast("string"), "status": F.col("state"), "object": F.col("kind"), "comparison": yes(F.coalesce("_agree", F.lit(False)))}
    answer = reduce(lambda acc, kv: F.when(F.col("family") == kv[0], kv[1]).otherwise(acc), answers.items(), F.lit(None).cast("string"))
    return out.select("frame", "qid", "family", answer.alias("answer"))
