"""Every question kind answers for every frame; some answers by hand."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.operators import generate, graph
from orrery.operators.kinds import KINDS, Ask, answer
from orrery.operators.patterns import Obj


@pytest.fixture(scope="module")
def scene(spark):
    rows = [(0, 0, "ego", "moving", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    rows += [(0, 1, "car", "moving", 5.0, 0.0, 180.0, -2.0, 0.0, 1.5), (0, 2, "car", "parked", -8.0, 1.0, 0.0, 0.0, 0.0, 2.0), (0, 3, "truck", "parked", 9.0, 9.0, 45.0, 1.0, 1.0, 4.0), (0, 4, "bus", "moving", 20.0, 0.0, 0.0, 3.0, 0.0, 5.0)]
    rows += [(1, 7, "ego", "moving", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 8, "bus", "parked", 0.0, 30.0, 90.0, 0.0, 0.0, 3.0)]
    nodes = spark.createDataFrame(rows, "frame bigint, id bigint, type string, status string, x double, y double, yaw double, vx double, vy double, height double").coalesce(1).cache()
    return nodes, graph.build_edges(nodes, 100.0).coalesce(1).cache()


ASK = Ask(type="car", type2="truck", status="moving", status2="parked", direction="front", direction2="front", ref=Obj("ego"), ref2=Obj("car", "moving"), one=Obj(id=1), two=Obj(id=3), within=6.0)


@pytest.mark.parametrize("kind,want", [
    ("exists_type", "yes"), ("count_type", "2"), ("count_all_objects", "5"), ("count_distinct_types", "4"), ("exists_direction_from_ego", "yes"), ("count_any_direction_from_ego", "2"), ("node_status_by_id", "moving"), ("nearest_of_type", "1"), ("farthest_of_type", "2"),
    ("compare_distance_two_ids", "yes"), ("compare_speed_two_ids_which", "first"), ("compare_status_two", "no"), ("compare_count_two_types_which", "first"), ("is_facing_ego", "yes"), ("is_facing_away", "no"), ("is_approaching_id", "yes"), ("direction_of_id_from_ego", "front"),
    ("moving_direction_of_id", "back"), ("count_within_distance", "1"), ("verify_status_by_id", "yes"), ("what_same_status_other", "car"), ("list_all_types", "bus|car|ego|truck"), ("distance_to_obj_id", "5.0"), ("largest_of_type", "2"), ("exists_between_two", "no"),
])
def test_by_hand(scene, kind, want):
    assert {r.frame: r.answer for r in answer(kind, *scene, ASK).collect()}[0] == want


def test_catalogue(scene):
    assert len(KINDS) >= 98
    for kind in KINDS:
        got = answer(kind, *scene, ASK)
        assert got.columns == ["frame", "answer"] and got.schema["answer"].dataType.simpleString() == "string", kind
    with pytest.raises(ValueError):
        answer("nothing", *scene, ASK)


def test_cameras_and_questions(spark, scene):
    got = spark.createDataFrame([(0.0,), (30.0,), (180.0,), (-170.0,), (-150.0,)], "b double").select(generate.cameras_of(F.col("b")).alias("c")).collect()
    assert [r.c for r in got] == [["front"], ["front", "front_left"], ["back"], ["back"], ["back", "back_right"]]
    q = generate.generated_questions(scene[0])
    assert q.count() == 4 * 7 + 2 and q.where("kind = 'count' and frame = 0").first().answer == "4"


def test_evaluation_boxes(spark):
    boxes = spark.createDataFrame([("s", 0, "car", 49.0, 0.0, 5), ("s", 1, "car", 50.0, 0.0, 5), ("s", 2, "car", 1.0, 0.0, 0), ("s", 3, "bicycle", 5.0, 5.0, -1), ("s", 4, "bicycle", 9.0, 5.0, -1)], "sample string, id int, class string, x double, y double, num_pts int")
    racks = spark.createDataFrame([("s", 5.0, 5.0, 2.0, 2.0, 30.0)], "sample string, x double, y double, length double, width double, yaw double")
    assert sorted(r.id for r in generate.boxes_for_evaluation(boxes, {"car": 50.0, "bicycle": 40.0}, racks).collect()) == [0, 4]
    assert math.isclose(generate.density_strata(spark.createDataFrame([(i, i, 2) for i in range(10)], "frame int, objects int, types int")).agg(F.sum("stratum")).first()[0], 21)
