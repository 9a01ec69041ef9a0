"""Graphs are built by all tasks, whatever the bytes of their nodes, and once for a family of kinds."""

from pyspark.sql import functions as F

from orrery import plans
from orrery.operators import graph

SF = "/root/testdata/sf0.001"


def test_edges_use_all_partitions(spark):
    n = spark.range(400).select(F.expr("id div 25").alias("frame"), "id", F.lit("car").alias("type"), F.lit("moving").alias("status"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), *[F.lit(0.0).alias(c) for c in ("yaw", "vx", "vy")])
    e = graph.build_edges(n.coalesce(1)).cache()
    try:
        assert e.count() == 16 * 25 * 24
        assert e.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        e.unpersist()


def test_kinds_read_one_graph(spark):
    q = plans.QUERIES["kinds_existence"](spark, SF)
    assert "embedding" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_stored_questions_are_parsed_once(spark):
    for name in ("grounded_questions", "grounded_coverage"):
        assert "regexp_extract" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
