"""Loaders of reference boxes, universes and baselines, label lines, grounding and plan checks on small hand-made inputs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import realise
from orrery.operators import grounding
from orrery.sources import exports, truth


def boxes(spark, attributes):
    rows = [("a1", "s1", "i1", attributes, "", "a2"), ("a2", "s2", "i1", [], "a1", ""), ("b1", "s1", "i2", [], "", "")]
    ann = spark.createDataFrame([(t, s, i, at, [10.0 * k, 0.0, 0.0], [1.0, 2.0, 1.5], [1.0, 0.0, 0.0, 0.0], 3, 1, p, n) for k, (t, s, i, at, p, n) in enumerate(rows)], "token string, sample_token string, instance_token string, attribute_tokens array<string>, translation array<double>, size array<double>, rotation array<double>, num_lidar_pts bigint, num_radar_pts bigint, prev string, next string")
    return {
        "sample": spark.createDataFrame([("s1", 0, "n1"), ("s2", 500000, "n2")], "token string, timestamp bigint, scene_token string"),
        "scene": spark.createDataFrame([("n1", "one"), ("n2", "two")], "token string, name string"), "sample_annotation": ann,
        "instance": spark.createDataFrame([("i1", "c1"), ("i2", "c2")], "token string, category_token string"), "category": spark.createDataFrame([("c1", "vehicle.car"), ("c2", "animal")], "token string, name string"),
        "attribute": spark.createDataFrame([("x", "vehicle.moving")], "token string, name string"),
    }


def test_reference_boxes_by_scene_and_sample(spark):
    t = boxes(spark, ["x"])
    one = truth.truth_boxes(truth.samples_of(t["sample"], t["scene"], scenes=spark.createDataFrame([("one",)], "name string")), t).collect()
    assert [(r.token, r.name, r.attribute_name, r.num_pts, r.score, r.vx) for r in one] == [("a1", "car", "vehicle.moving", 4, -1.0, 20.0)]
    by_token = truth.samples_of(t["sample"], t["scene"], tokens=spark.createDataFrame([("s2",)], "token string"))
    assert [(r.token, r.tracking_id, r.vx) for r in truth.truth_boxes(by_token, t, tracking=True).collect()] == [("a2", "i1", 20.0)]
    assert [r.attribute_name for r in truth.truth_boxes(by_token, t).collect()] == [""]


def test_more_than_one_attribute_is_an_error(spark):
    t = boxes(spark, ["x", "y"])
    with pytest.raises(Exception, match="more than one attribute: a1"):
        truth.truth_boxes(t["sample"], t).collect()
    assert truth.truth_boxes(t["sample"], t, tracking=True).count() == 2


def test_splits(spark, tmp_path):
    known = spark.createDataFrame([("train", "one"), ("val", "two")], "split string, name string")
    path = tmp_path / "splits.json"
    path.write_text(json.dumps({"mine": ["one", "three"], "odd": "one"}))
    assert [r.name for r in truth.split_scenes(spark, "val", known).collect()] == ["two"]
    assert sorted(r.name for r in truth.split_scenes(spark, "mine", known, str(path)).collect()) == ["one", "three"]
    for name, custom in (("other", None), ("other", str(path)), ("odd", str(path))):
        with pytest.raises(ValueError, match="split"):
            truth.split_scenes(spark, name, known, custom)


def test_universes_and_baselines(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a_universe.json").write_text(json.dumps({"scene_id": "s", "frame_id": 3, "L0": ["a", "b", "a"], "L2A": ["a|b|c"]}))
    (tmp_path / "u" / "b_universe.json").write_text("{broken")
    (tmp_path / "u" / "c_other.json").write_text(json.dumps({"scene_id": "s", "frame_id": 4, "L0": ["z"]}))
    assert sorted(map(tuple, truth.read_universes(spark, str(tmp_path / "u")).collect())) == [("s/3", "L0", "a"), ("s/3", "L0", "b"), ("s/3", "L2A", "a|b|c")]
    q = [
        {"scene_name": "s", "sample_token": "t", "node_ids": ["a", ""], "edge_pairs": [["b", "a"], ["c"]]}, {"scene_name": "s", "sample_token": "u", "cell_info": {"src_id": "a", "tgt_id": "d"}},
        {"scene_name": "s", "sample_token": "t", "path_pattern": "z|m|k", "topology_level": "L2A"}, {"scene_name": "other", "sample_token": "t", "node_ids": ["q"]},
    ]
    (tmp_path / "base.json").write_text(json.dumps({"qa_pairs": q}))
    read = truth.read_baseline(spark, str(tmp_path / "base.json"))
    got = {(r.level, r.key): r.n for r in truth.baseline_hits(read, "s", spark.createDataFrame([("t",)], "token string")).collect()}
    assert got == {("L0", "a"): 2, ("L0", "b"): 1, ("L1", "a|b"): 1, ("L0", "z"): 1, ("L0", "m"): 2, ("L0", "k"): 1, ("L1", "m|z"): 1, ("L1", "k|m"): 1, ("L2", "k|m|z"): 1}
    every = {(r.level, r.key): r.n for r in truth.baseline_hits(read).collect()}
    assert every[("L0", "q")] == 1 and every[("L1", "a|d")] == 1 and every[("L0", "a")] == 3


def test_skipped_questions(spark):
    q = spark.createDataFrame([("s", 1, k, f"q{k}") for k in (5, 7, 9)] + [("s", 2, 1, "r")], "scene string, frame int, at int, text string")
    skip = spark.createDataFrame([("s", 1, 2), ("t", 2, 1)], "scene string, frame int, ordinal int")
    assert sorted(r.text for r in truth.without_skipped(q, skip, "at").collect()) == ["q5", "q9", "r"]


def test_label_lines_equal_numpy(spark):
    def matrix(q):
        w, x, y, z = q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])

    rng = np.random.default_rng(4)
    for _ in range(5):
        cam, rect = (q / np.linalg.norm(q) for q in rng.normal(size=(2, 4)))
        x, y, z, w, le, h, yaw = rng.uniform(1, 9, 7).tolist()
        off = rng.normal(size=3)
        back = matrix((math.sqrt(0.5), 0, 0, -math.sqrt(0.5)))
        centre = matrix(rect) @ (matrix(cam) @ back @ [x, y, z] + off) + [0, h / 2, 0]
        v = matrix(rect) @ matrix(cam) @ back @ [math.cos(math.radians(yaw * 30)), math.sin(math.radians(yaw * 30)), 0]
        cells = [float(f"{h:.2}"), w, le, *centre, -math.atan2(v[2], v[0])]
        row = spark.range(1).select(exports.label_line(F.lit("Car"), *[F.lit(k) for k in (x, y, z, w, le, h, yaw * 30)], tuple(cam.tolist()), tuple(off.tolist()), tuple(rect.tolist()), F.lit(0.25)).alias("t")).first()
        parts = row.t.split(" ")
        assert parts[:8] == ["Car", "-1.00", "-1", "-10.00", "-1.00", "-1.00", "-1.00", "-1.00"] and parts[-1] == "0.2500"
        assert np.allclose([float(p) for p in parts[8:-1]], cells, atol=0.0051)


def graph(spark):
    nodes = spark.createDataFrame([("f", 1, "car", "moving", 0.0, 0.0, 0.0), ("f", 2, "truck", "parked", 5.0, 0.0, 90.0), ("f", 3, "bus", "parked", 6.0, 0.5, 0.0), ("f", 4, "car", "standing", -4.0, 0.0, 0.0)], "frame string, id bigint, type string, status string, x double, y double, yaw double")
    e = [(1, 2, "front"), (1, 3, "front"), (1, 4, "back"), (2, 3, "front right"), (3, 2, "back"), (4, 1, "front")]
    kind = {r.id: (r.type, r.status) for r in nodes.collect()}
    edges = spark.createDataFrame([("f", a, b, *kind[a], *kind[b], d) for a, b, d in e], "frame string, src bigint, dst bigint, src_type string, src_status string, dst_type string, dst_status string, dir6 string")
    return nodes, edges


def test_grounding(spark):
    nodes, edges = graph(spark)
    own = spark.createDataFrame([("f", 1)], "frame string, id bigint")
    asked = [
        ("Are there any trucks to the front of me?", "yes"), ("Are there any buses to the back of me?", "no"), ("Are there any trucks to the front of me?", "no"), ("How many parked things are to the front of me?", "2"),
        ("There is a thing to the front of the standing car; what is it?", "car"), ("There is a thing to the front of the standing car; what is it?", "bus"), ("What is the status of the truck to the front of the moving car?", "parked"),
        ("How many cars are there?", "2"), ("How many cars are there?", "3"), ("Are there any cars to the front of the trailer?", "no"), ("What is the status of the truck?", "parked"),
    ]
    q = spark.createDataFrame([("f", k, t, a) for k, (t, a) in enumerate(asked)], "frame string, qid bigint, text string, answer string")
    got = {r.qid: (r.verdict, r.ids, [tuple(p) for p in r.pairs]) for r in grounding.grounded(q, nodes, edges, own).collect()}
    assert got[0] == ("match", [1, 2], [(1, 2)]) and got[1] == ("match", [1], []) and got[2] == ("mismatch", [1], [])
    assert got[3] == ("match", [1, 2, 3], [(1, 2), (1, 3)]) and got[4] == ("match", [4, 1], [(4, 1)]) and got[5] == ("partial", [4, 1], [(4, 1)])
    assert got[6] == ("match", [1, 2], [(1, 2)]) and got[7] == ("match", [1, 4], []) and got[8] == ("mismatch", [], []) and got[9] == ("unparsed", [], []) and got[10] == ("unparsed", [], [])
    hits = {tuple(r) for r in grounding.grounded_hits(grounding.grounded(q.where("qid in (0, 5)"), nodes, edges, own)).collect()}
    assert hits == {("f", "L0", "1"), ("f", "L0", "2"), ("f", "L1", "1|2")}


def test_direction_frames(spark):
    nodes, _ = graph(spark)
    own = spark.createDataFrame([("f", 2)], "frame string, id bigint")
    q = spark.createDataFrame([("f", 1, "exist", 1, "truck", None, "front", "yes"), ("f", 2, "comparison", 2, None, None, "front right", "yes"), ("f", 3, "count", 1, None, None, "back", "1")], "frame string, qid bigint, family string, src bigint, type string, status string, direction string, answer string")
    got = {(r.qid, r.method): r.answers for r in grounding.direction_answers(nodes, q, own).collect()}
    assert got[(1, "source")] == ["yes"] and got[(1, "world")] == ["yes"] and got[(1, "ego")] == ["no"]
    assert got[(2, "source")] == ["yes"] and got[(2, "world")] == []
    assert got[(3, "source")] == ["1"]
    rate = {(r.method, r.family): (r.n, r.answered, r.correct, r.rate) for r in grounding.accuracy_by_method(grounding.direction_answers(nodes, q, own)).collect()}
    assert rate[("ego", "exist")] == (1, 1, 0, 0.0) and rate[("source", "comparison")] == (1, 1, 1, 1.0) and rate[("world", "comparison")] == (1, 0, 0, 0.0)


def test_plan_checks(spark):
    columns = "a bigint, b bigint, c bigint, n_a bigint, found_a bigint, n_b bigint, found_b bigint, n_c bigint, found_c bigint, d_ab double, d_bc double, dir_ab string, dir_bc string, family string, answer string, want boolean"
    rows = [
        (1, 2, 3, None, None, 1, 2, None, None, None, None, None, None, "converge", None, True), (1, 2, 3, None, None, 1, 9, None, None, None, None, None, None, "converge", None, False), (1, 2, 3, None, None, 2, 2, None, None, None, None, None, None, "converge", None, False),
        (1, 2, 3, 1, 1, None, None, 1, 3, None, None, None, None, "diverge_compare", None, True), (1, 2, 3, 1, 1, None, None, 2, 3, None, None, None, None, "diverge_compare", None, False), (1, 2, 3, None, None, None, None, None, None, 1.0, 1.0, None, None, "distance_chain", None, False),
        (1, 2, 3, None, None, None, None, None, None, 1.0, None, None, None, "distance_chain", None, False), (1, 2, 3, None, None, None, None, None, None, 1.0, 2.0, None, None, "distance_chain", None, True), (1, 2, 3, None, None, None, None, None, None, None, None, "front", None, "direction_chain", None, False),
        (1, 2, 3, None, None, None, None, None, None, None, None, "front", "back", "direction_chain", None, True), (1, 2, 3, None, None, None, None, None, None, None, None, None, None, "viewpoint_transfer", "left", True), (1, 2, 3, None, None, None, None, None, None, None, None, None, None, "viewpoint_transfer", None, False),
    ]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, columns).withColumn("got", grounding.valid_plan(F.col("family"), F.col("answer"))).collect())
    text = [F.lit(x) for x in "abc"]
    graphs = spark.range(1).select(*[grounding.plan_graph(F.lit(f), *text, F.array(F.lit("r")), F.array(F.lit("s"))).alias(f) for f in ("converge", "diverge_compare", "viewpoint_transfer")]).first()
    assert [tuple(e) for e in graphs.converge] == [("a", "b", "template"), ("c", "b", "template"), ("r", "b", "constraint")]
    assert [tuple(e) for e in graphs.diverge_compare] == [("a", "b", "template"), ("b", "c", "template"), ("r", "a", "constraint"), ("s", "c", "constraint")]
    assert [tuple(e) for e in graphs.viewpoint_transfer] == [("a", "b", "template"), ("b", "c", "template")]


def test_texts_touch_edges(spark):
    e = spark.createDataFrame([("f", "ego", "car1"), ("f", "car1", "bus2"), ("f", "bus2", "car12"), ("g", "ego", "Truck3")], "frame string, source string, target string")
    q = spark.createDataFrame([("f", "MATCH (n) WHERE n.unique_id = 'car1' RETURN n"), ("f", ""), ("g", 'MATCH (n {type: "truck"})')], "frame string, text string")
    assert {tuple(r) for r in grounding.text_coverage(q, e).collect()} == {("f", 3, 3, 100.0), ("g", 1, 1, 100.0)}
    assert {tuple(r) for r in grounding.text_coverage(q.where("text = ''"), e).collect()} == {("f", 0, 3, 0.0), ("g", 0, 1, 0.0)}


def test_templates_and_errors(spark):
    names = ("src_id", "tgt_status", "src_status", "anc_status", "beyond_status", "dist_level", "anc_id", "beyond_id")
    c = spark.createDataFrame([("ego", "moving", "unknown", None, "", "near", "", "b")], ", ".join(f"{x} string" for x in names))
    got = c.select(grounding.applicable_templates({"t1": ("ego_src", "tgt_status"), "t2": ("src_status",), "t3": ("beyond", "dist"), "t4": ("anc",), "t5": ()}).alias("t"), grounding.filled(F.lit("{a} and {b}"), {"a": F.col("src_id"), "b": F.col("src_status")}).alias("f"), grounding.filled(F.lit("{a}"), {"a": F.col("src_id"), "b": F.col("src_status")}).alias("g")).first()
    assert got.t == ["t1", "t3", "t5"] and got.f is None and got.g == "ego"
    runs = spark.createDataFrame([(30000.0, False, 0, True, "m", 0, "q", "Timeout"), (10.0, True, 0, True, "m", 0, "q", "QueryError"), (10.0, True, 2, False, "yesno_fallback", 4, "q", "LockFailed"), (10.0, True, 2, True, "m", 0, "the car Car is?", "SemanticRedundant"), (None, None, None, True, None, None, None, "OK")], "ms double, used boolean, depth int, unique boolean, method string, fails int, question string, want string")
    assert all(r.e.error_type == r.want for r in runs.withColumn("e", grounding.run_error(*[F.col(k) for k in ("ms", "used", "depth", "unique", "method", "fails", "question")])).collect())


def test_wordings_are_repeatable_and_fill_every_place(spark):
    none = F.array().cast("array<struct<kind:string,value:string,ref:string>>")
    parts = {k: F.lit(k.upper()) for k in ("one", "many", "label", "dir", "dir2", "a", "b", "c", "x", "y", "extra")}
    rows = spark.range(40).select(*[realise.realised(f, F.col("id").cast("string"), s, **parts).alias(f"{f}_{s}") for f in realise.FORMS for s in (0, 1)])
    got, again = rows.collect(), rows.collect()
    assert got == again
    for f, (family, kind, wordings) in realise.FORMS.items():
        assert {r[f"{f}_0"].template_family for r in got} == {family} and {r[f"{f}_0"].answer_type for r in got} == {kind}
        assert len({r[f"{f}_0"].question for r in got}) == len(wordings) and not any("{" in r[f"{f}_0"].question for r in got)
    assert any(r.viewpoint_0 != r.viewpoint_1 for r in got)
    words = spark.range(1).select(realise.many(F.lit("bus")).alias("a"), realise.many(F.lit("lorry")).alias("b"), realise.many(F.lit("")).alias("c"), realise.description(F.lit("ego"), F.lit("front_left"), F.lit("car1"), none).alias("d")).first()
    assert tuple(words) == ("bus", "lorries", "objects", "the ego vehicle to the front left of car1")
