"""Directions at every boundary, angles, boxes and text rules."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions import text as T


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


ANGLES = sorted({float(a) for a in range(-180, 181, 15)} | {s * (b + d) for b in (22.5, 30, 45, 67.5, 90, 112.5, 135, 150, 157.5) for s in (1, -1) for d in (0, 1e-9, -1e-9)})


def expect(angle, names, closed_above):
    width = 360 / len(names)
    a = (angle + width / 2) % 360
    return names[((math.ceil(a / width) - 1) if closed_above else math.floor(a / width)) % len(names)]


def test_directions(spark):
    rows = spark.createDataFrame([(a,) for a in ANGLES], "a double").select("a", G.dir4(F.col("a")).alias("d4"), G.dir8(F.col("a")).alias("d8"), G.dir6(F.col("a")).alias("d6"), G.sector8(F.col("a")).alias("s8"), G.dir6(F.col("a"), 5).alias("m6")).collect()
    for r in rows:
        assert (r.d4, r.d8, r.d6, r.s8) == (expect(r.a, G.DIR4, False), expect(r.a, G.DIR8, False), expect(r.a, G.DIR6, True), expect(r.a, G.DIR8, True)), r.a
        assert r.m6 in (None, r.d6) and (r.m6 is None) == (min((r.a + 30) % 60, 60 - (r.a + 30) % 60) < 5)


def test_direction_edges_by_hand(spark):
    got = one(spark, *[G.dir6(F.lit(a)) for a in (30.0, 30.5, -30.0, 180.0, 90.0)], G.dir4(F.lit(45.0)), G.dir4(F.lit(-45.0)), G.dir8(F.lit(22.5)), G.sector8(F.lit(22.5)))
    assert tuple(got) == ("front", "front left", "front right", "back", "front left", "left", "front", "front_left", "front")


def test_wrap(spark):
    assert tuple(one(spark, G.wrap(F.lit(180.0)), G.wrap(F.lit(-540.0)), G.wrap_closed(F.lit(-180.0)), G.wrap(F.lit(725.0)), G.angle_difference(F.lit(350.0), F.lit(10.0)), G.angle_difference(F.lit(170.0), F.lit(10.0), 180.0))) == (-180.0, -180.0, 180.0, 5.0, -20.0, -20.0)


@pytest.mark.parametrize("angle,words", [(0.0, {"front", "front_left", "front_right"}), (90.0, {"front", "back", "left", "front_left", "back_left"}), (45.0, {"front", "left", "front_left"}), (180.0, {"back", "back_left", "back_right"})])
def test_loose(spark, angle, words):
    got = set(one(spark, G.loose_directions(F.lit(angle))).c0)
    assert words <= got <= words | {"left", "right"}


def test_yaw_and_frames(spark):
    h = math.radians(70) / 2
    q = [F.lit(math.cos(h)), F.lit(0.0), F.lit(0.0), F.lit(math.sin(h))]
    u, v = G.to_local(F.lit(3.0), F.lit(4.0), F.lit(1.0), F.lit(1.0), F.lit(70.0))
    x, y = G.to_global(u, v, F.lit(1.0), F.lit(1.0), F.lit(70.0))
    r = one(spark, G.yaw(*q), x, y, F.get(G.rotation(*q), F.lit(0)))
    assert [round(a, 9) for a in r] == [70.0, 3.0, 4.0, round(math.cos(math.radians(70)), 9)]


def test_boxes_and_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    p = lambda x, y: G.point_in_ring(F.lit(x), F.lit(y), ring)
    b = lambda x, y: G.point_in_box(F.lit(x), F.lit(y), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0), F.lit(90.0))
    assert tuple(one(spark, p(1.0, 1.0), p(2.0, 3.0), p(5.0, 1.0), p(3.5, 3.0), b(1.0, 2.0), b(2.0, 1.0))) == (True, False, False, True, True, False)
    assert round(one(spark, G.scale_iou([F.lit(2.0)] * 3, [F.lit(1.0), F.lit(2.0), F.lit(2.0)])).c0, 6) == 0.5


def test_contact_and_sides(spark):
    r = one(spark, G.time_to_contact(F.lit(10.0), F.lit(0.0), F.lit(-2.0), F.lit(0.0)), G.time_to_contact(F.lit(10.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)), G.side_of(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 1.0, 1.0)]), G.side_of(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 1.0, -1.0)]), G.side_of(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 9.0, 0.1)]))
    assert tuple(r) == (5.0, None, "left", "right", None)


def test_distance_words(spark):
    d = spark.createDataFrame([(0.0,), (2.0,), (10.0,), (10.1,), (25.0,), (30.0,), (51.0,)], "d double")
    got = [tuple(r) for r in d.select(G.distance_level(F.col("d")), G.distance_class(F.col("d")), G.safety_bin(F.col("d"))).collect()]
    assert got == [("near", "very_close", 0), ("near", "close", 0), ("near", "medium", 2), ("mid", "medium", 3), ("mid", "medium", 5), ("far", "far", 5), ("far", "far", None)]


def test_text_rules(spark):
    asked = [
        ("Are any cars visible?", "exist"), ("Does a moving car exist?", "exist"), ("can you see a bus?", "exist"), ("How many cars are moving?", "count"), ("What number of things are there?", "count"), ("What status is the car?", "status"), ("To the left, what is the bus status", "status"),
        ("What is the moving thing?", "object"), ("What is the thing that is ahead?", "object"), ("The bus is what?", "object"), ("There is a bus; what is it?", "object"), ("Is the car the same status as the bus?", "comparison"), ("Is its status the same?", "comparison"), ("What is the thing?", "general"), ("Hm", "general"),
    ]
    got = spark.createDataFrame(asked, "q string, family string").select("q", "family", T.question_family(T.normalised_question(F.col("q"))).alias("got")).collect()
    assert [(r.q, r.got) for r in got] == asked
    assert one(spark, T.normalised_question(F.lit("The  construction vehicle in front of a stationary Vehicle, behind it"))).c0 == "The truck to the front of a stopped car, to the back of it"
    names = [("bus", "buses", True), ("construction_vehicle", "construction vehicle", True), ("construction_vehicle", "construction vehicles", True), ("traffic_cone", "traffic cones", True), ("car", "things", True), ("ego", "objects", False), ("car", "trucks", False), ("bus", "busses", True), ("truck", "car", False)]
    got = spark.createDataFrame(names, "k string, a string, want boolean").select("k", "a", T.type_matches(F.col("k"), F.col("a")).alias("got")).collect()
    assert [(r.k, r.a, r.got) for r in got] == names
    assert one(spark, T.tokens(F.lit(" The front-left car's, (big)/small? "))).c0 == ["the", "front", "left", "cars", "big", "small"]
    assert one(spark, T.padded(F.array(F.lit(3), F.lit(4)), 4)).c0 == [3, 4, 0, 0]
    s = lambda a, v: T.inferred_status(F.lit(a), F.lit(v))
    assert tuple(one(spark, s("vehicle.parked", 3.0), s("cycle.with_rider", 0.0), s("cycle.without_rider", 0.0), s("", 0.2), s("", 2.0))) == ("stopped", "with_rider", "without_rider", "stopped", "moving")
    m = lambda a, b, k: T.status_matches(F.lit(a), F.lit(b), F.lit(k))
    assert tuple(one(spark, m("with_rider", "with rider", "bicycle"), m("moving", "not standing", "pedestrian"), m("moving", "not standing", "car"))) == (True, True, False)
    assert tuple(one(spark, T.same_answer(F.lit("Parked"), F.lit("stopped ")), T.same_answer(F.lit("front_left"), F.lit("front left")), T.same_answer(F.lit("1"), F.lit("2")))) == (True, True, False)
    assert one(spark, T.json_list(F.lit('["a","b"]')), T.json_list(F.lit("nope")), T.json_list(F.lit(None).cast("string"))) == (["a", "b"], [], [])
    assert one(spark, T.squeeze(F.lit("  a \n b "))).c0 == "a b"


def test_answers_and_phrases(spark):
    a = lambda f, t: T.formatted_answer(F.lit(f), F.lit(t))
    assert tuple(one(spark, a("exist", "Yes, one is."), a("exist", "None."), a("count", "There are 12 or 13."), a("count", "many"), a("status", "It is driving"), a("status", " odd "), a("object", "A big Truck"), a("general", " so "))) == ("yes", "no", "12", "0", "moving", "odd", "truck", "so")
    assert tuple(one(spark, T.plural(F.lit("bus")), T.plural(F.lit("car")), T.plural(F.lit("lorry")), T.plural(F.lit("day")), T.with_article(F.lit("animal")), T.with_article(F.lit("car")))) == ("buses", "cars", "lorries", "days", "an animal", "a car")
    assert tuple(one(spark, T.first_object(F.lit('x {"a": 1} {"b": 2}')), T.first_object(F.lit("none")), T.canonical_name(F.lit(" Total (L2) rate% ")))) == ('{"a": 1}', None, "total_l2_rate")
    assert tuple(one(spark, T.detection_class(F.lit("vehicle.bus.bendy")), T.detection_class(F.lit("animal")), T.tracking_class(F.lit("movable_object.barrier")), T.tracking_class(F.lit("human.pedestrian.child")))) == ("bus", None, None, "pedestrian")


def test_turns(spark):
    quarter = [math.cos(math.radians(45)), 0.0, 0.0, math.sin(math.radians(45))]
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    half, back, near = one(spark, G.slerp(arr([1, 0, 0, 0]), arr(quarter), F.lit(0.5)), G.slerp(arr([1, 0, 0, 0]), arr([-x for x in quarter]), F.lit(0.5)), G.slerp(arr([1, 0, 0, 0]), arr([1, 0, 0, 0]), F.lit(0.3)))
    want = [math.cos(math.radians(22.5)), 0.0, 0.0, math.sin(math.radians(22.5))]
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(half, want)) and all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(back, want)) and near[0] == 1.0
    assert round(one(spark, G.turned_between(F.lit(170.0), F.lit(-170.0), F.lit(0.25))).c0, 9) == 175.0


def test_boxes_in_an_image(spark):
    """Corner for corner against numpy."""
    import numpy as np

    args = (10.0, 1.0, 0.5, 4.0, 2.0, 1.5, 30.0)
    corners = G.box_corners(*[F.lit(v) for v in args])
    camera = F.transform(corners, lambda c: F.struct((-c["y"]).alias("x"), (-c["z"]).alias("y"), c["x"].alias("z")))
    seen = G.view_points(camera, 1266.0, 800.0, 450.0)
    got = one(spark, corners, seen, G.box_in_image(seen, 1600, 900), G.box_in_image(seen, 1600, 900, True), G.image_box(seen, 1600.0, 900.0))
    h = math.radians(30)
    turn = np.array([[math.cos(h), -math.sin(h)], [math.sin(h), math.cos(h)]])
    want = {(tuple(np.round(turn @ [2 * u, v] + [10, 1], 9)), round(0.5 + 0.75 * w, 9)) for u in (1, -1) for v in (1, -1) for w in (1, -1)}
    assert {((round(c.x, 9), round(c.y, 9)), round(c.z, 9)) for c in got[0]} == want
    pixels = sorted((round(1266 * -y / x + 800, 6), round(1266 * -z / x + 450, 6)) for (x, y), z in want)
    assert np.allclose(sorted((round(p.u, 6), round(p.v, 6)) for p in got[1]), pixels) and got[2] and got[3]
    assert np.allclose(tuple(got[4]), (min(p[0] for p in pixels), min(p[1] for p in pixels), max(p[0] for p in pixels), max(p[1] for p in pixels)), atol=1e-5)


def test_destination(spark):
    lat, lon = G.destination(F.lit(0.0), F.lit(10.0), F.lit(90.0), F.lit(math.pi * 6_378_137.0 / 180))
    got = one(spark, lat, lon)
    assert abs(got[0]) < 1e-9 and math.isclose(got[1], 11.0)


def test_question_family_reads_the_text_once(spark):
    """The plan holds the expression of the text once, and no pattern takes time in the square of the text's length."""
    import time

    long = spark.createDataFrame([("word " * 20_000,), ("word " * 20_000 + " is what?",), (" is what?",), ("a is what?",), (None,)], "q string")
    family = T.question_family(T.normalised_question(F.col("q")))
    told = long.select(family.alias("f"))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("construction vehicles") == 1
    began = time.perf_counter()
    assert [r.f for r in told.collect()] == ["general", "object", "general", "object", "general"]
    assert time.perf_counter() - began < 20
