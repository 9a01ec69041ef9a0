"""Graphs, coverage, constraints, metrics, maps, sources and streams on small fixtures with known answers."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import constraints, coverage, graph, metrics, patterns, relational, spatial
from orrery.sources import tables
from orrery.streaming import coverage as streaming


@pytest.fixture(scope="module")
def ring(spark):
    """Eight nodes on a circle: a complete graph."""
    rows = [(0, i, ("car", "truck")[i % 2], ("moving", "parked", "standing")[i % 3], 5 * math.cos(i * math.pi / 4), 5 * math.sin(i * math.pi / 4), 0.0, -1.0, 0.0) for i in range(8)]
    return spark.createDataFrame(rows, "frame bigint, id bigint, type string, status string, x double, y double, yaw double, vx double, vy double").cache()


def test_complete_graph(ring):
    e = graph.build_edges(ring, 100.0)
    assert e.count() == 56 and graph.build_edges(ring, 100.0, directed=False).count() == 28
    assert graph.pivot_universe(e).count() == 8 * 7 * 6 // 2 == graph.two_hop_paths(e).count()
    stats = {r.level: r for r in coverage.coverage_stats(coverage.universe(ring, e), coverage.cascade(ring.sparkSession.createDataFrame([(0, "q", 1, "0", "1", "2")], "frame bigint, qid string, ord int, a string, b string, c string"))).collect()}
    assert (stats["L0"].total, stats["L1"].total, stats["L2"].total) == (8, 28, 168) and (stats["L0"].covered, stats["L1"].covered, stats["L2"].covered) == (3, 2, 1)


def test_curve_is_monotone_and_ignores_unknown_keys(ring, spark):
    hits = coverage.cascade(spark.createDataFrame([(0, f"q{k}", k, str(k), str(k + 1), str(k + 2)) for k in range(9)], "frame bigint, qid string, ord int, a string, b string, c string"))
    curve = coverage.coverage_curve(coverage.universe(ring, graph.build_edges(ring, 100.0)), hits).where("level = 'L2'").orderBy("ord").collect()
    assert [r.covered for r in curve] == [1, 2, 3, 4, 5, 6, 6, 6, 6] and sum(r.new_keys for r in curve) == 6


def test_last_edge_wins(spark):
    e = spark.createDataFrame([(0, 1, 2, 0, "a"), (0, 1, 2, 1, "b"), (0, 2, 1, 0, "c")], "frame int, src int, dst int, k int, v string")
    assert sorted(r.v for r in graph.last_edge(e, "k").collect()) == ["b", "c"]


def test_first_failing_reason(spark):
    d = spark.createDataFrame([("dog", 1.0, 1.0, 50.0), ("car", 51.0, 0.1, 1.0), ("car", 50.0, 0.1, 1.0), ("car", 5.0, None, 9.0), ("car", 5.0, None, None), ("barrier", 31.0, 1.0, 99.0)], "t string, d double, v double, p double")
    assert [r[0] for r in d.select(graph.removal_reason(*[F.col(c) for c in "tdvp"])).collect()] == ["type", "distance", "visibility", "pixels", None, "distance"]


def test_nearest_within_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    a = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, 20, (40, 2)))]
    b = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, 20, (30, 2)))]
    got = {r.id: r.other for r in graph.nearest_within(spark.createDataFrame(a, "k int, id int, x double, y double"), spark.createDataFrame(b, "k int, id int, x double, y double"), 3.0, ["k"]).collect()}
    want = {i: min((math.hypot(x - u, y - v), j) for _, j, u, v in b) for _, i, x, y in a}
    assert got == {i: j for i, (d, j) in want.items() if d < 3}


def test_patterns(ring):
    e = graph.build_edges(ring, 100.0)
    ask = patterns.Obj("truck", relations=(patterns.Relation(patterns.Obj(id=0), within=4.0),))
    assert {r.id for r in patterns.matches(ring, e, ask).collect()} == {1, 7}
    assert patterns.count_query(ring, e, ask).first().answer == 2 and patterns.exist_query(ring, e, patterns.Obj("bus")).first().answer == "no"
    assert patterns.first_query(ring, e, ask, "status").first().answer == "parked" and patterns.first_query(ring, e, patterns.Obj("bus"), "type").first().answer is None
    assert patterns.same_status_query(ring, e, patterns.Obj(id=0)).first().answer == 2
    assert patterns.comparison_query(ring, e, patterns.Obj(id=0), patterns.Obj(id=3)).first().answer == "yes"
    assert patterns.extreme_query(ring, e, patterns.Obj("truck"), farthest=True).first().answer in (1, 3, 5, 7)
    twice = patterns.Obj(id=3, relations=(patterns.Relation(patterns.Obj("car")),))
    assert (patterns.count_query(ring, e, twice).first().answer, patterns.count_query(ring, e, twice, distinct=False).first().answer) == (1, 4)
    assert patterns.verify_unique(patterns.matches(ring, e, ask), ring.where("id = 1").select("frame", "id")).first().verdict == "many"


def test_two_references(spark):
    rows = [(0, s, d, "car", dirs) for s, ds in ((10, {1: "front", 2: "front", 3: "back"}), (11, {1: "front", 2: "back", 3: "front"})) for d, dirs in ds.items()]
    got = constraints.two_references(spark.createDataFrame(rows, "frame int, src int, dst int, dst_type string, dir6 string")).collect()
    assert [(r.dst, r.refs) for r in got] == [(1, 1)]


def test_greedy_references(spark):
    rows = [(0, 1, ref, c, c in keep) for ref, keep in ((7, {1, 2}), (8, {1, 3, 4}), (9, {1, 2, 3, 4})) for c in (1, 2, 3, 4)]
    r = constraints.greedy_references(spark.createDataFrame(rows, "frame bigint, target bigint, ref bigint, candidate bigint, agrees boolean")).first()
    assert (r.rounds, r.left, r.refs) == (2, 1, "7|8")


def test_greedy_gaps(spark):
    gaps = [(0, "1|2|3", "1", "2", "3"), (0, "1|2|4", "1", "2", "4"), (0, "5|6|7", "5", "6", "7")]
    got = constraints.select_gaps(spark.createDataFrame(gaps, "frame bigint, key string, a string, b string, c string"), 2).orderBy("step").collect()
    assert [(r.key, r.score) for r in got] == [("1|2|3", 321), ("5|6|7", 321)]


def test_quotas():
    q = coverage.family_quotas(101, {"a": 0.4, "b": 0.35, "c": 0.08, "d": 0.08, "e": 0.09})
    assert sum(q.values()) == 101 and q["a"] in (40, 41)


def ap_of(spark, rows):
    scored = spark.createDataFrame([("c", i, s, h) for i, (s, h) in enumerate(rows)], "class string, i int, score double, hit boolean")
    return metrics.average_precision(metrics.precision_recall(scored, "class", "score", "i", "hit"), "class").first().ap


def test_average_precision(spark):
    assert ap_of(spark, [(0.9, True), (0.8, True)]) == 1.0
    assert ap_of(spark, [(0.9, False)]) == 0.0
    rows = [(0.9, False), (0.8, True)]
    assert abs(ap_of(spark, rows) - (0.8 * 0.4 / 2) / (0.9 * 0.9)) < 0.01


def test_iou_and_panoptic(spark):
    m = metrics.class_iou(metrics.confusion(spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "t int, g int"), "t", "g"))
    assert {r["class"]: r.iou for r in m.collect()} == {1: 0.5, 2: round(2 / 3, 6)}
    half = [(0, "car", 1, 1)] * 2 + [(0, "car", 1, 0)] * 1 + [(0, "car", 0, 1)] * 1  # overlap of exactly one half is no match
    good = [(0, "bus", 1, 1)] * 3 + [(0, "bus", 1, 0)] * 2
    got = {r["class"]: r for r in metrics.panoptic_quality(spark.createDataFrame(half + good, "frame int, class string, truth int, guess int")).collect()}
    assert (got["car"].tp, got["car"].fp, got["car"].fn, got["car"].pq) == (0, 1, 1, 0.0) and (got["bus"].tp, got["bus"].sq, got["bus"].pq) == (1, 0.6, 0.6)


def test_optimal_match():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(30):
        cost = rng.uniform(0, 9, (3, 4))
        best = min(sum(cost[i, p[i]] for i in range(3)) for p in permutations(range(4), 3))
        assert abs(sum(cost[i, j] for i, j in metrics.optimal_match(cost)) - best) < 1e-9


def test_tracks(spark):
    gt = [(0, t, "gt", 1, float(t), 0.0) for t in range(6)] + [(0, t, "gt", 2, float(t), 9.0) for t in range(6)]
    pred = [(0, t, "pred", 5 if t < 3 else 6, float(t), 0.5) for t in range(6)] + [(0, t, "pred", 8, float(t), 9.0) for t in range(4)] + [(0, 5, "pred", 9, 50.0, 50.0)]
    r = metrics.track_events(spark.createDataFrame(gt + pred, "scene bigint, t bigint, kind string, id bigint, x double, y double"), 2.0).first()
    assert (r.tp, r.fp, r.fn, r.switches, r.distance) == (10, 1, 2, 1, 3.0)
    assert round(metrics.mot_summary(spark.createDataFrame([r])).first().mota, 6) == round(1 - 4 / 12, 6)


def test_greedy_match(spark):
    pairs = [(0, 1, 0.9, 7, 1.0), (0, 1, 0.9, 8, 1.5), (0, 2, 0.8, 7, 0.1), (0, 2, 0.8, 8, 3.0), (0, 3, 0.7, 8, 1.0)]
    got = metrics.greedy_match(spark.createDataFrame(pairs, "`group` bigint, pred bigint, score double, gt bigint, dist double"), 2.0).collect()
    assert {(r.pred, r.gt) for r in got} == {(1, 7), (3, 8)}


def test_displacement(spark):
    rows = [(0, m, p, t, d) for m, p, ds in ((0, 0.6, (1.0, 3.0)), (1, 0.3, (0.5, 0.5)), (2, 0.1, (0.0, 0.0))) for t, d in enumerate(ds)]
    r = metrics.displacement_errors(spark.createDataFrame(rows, "id int, mode int, p double, t int, dist double"), 2).first()
    assert (r.min_ade, r.min_fde, r.missed) == (0.5, 0.5, False)


def test_rates_and_islands(spark):
    s = 1_000_000
    rows = spark.createDataFrame([("a", 0, 0.0), ("a", s, 2.0), ("a", 3 * s, 2.0), ("b", 0, 1.0), ("c", 0, 0.0), ("c", 2 * s, 9.0)], "k string, us bigint, v double")
    got = {(r.k, r.us): r.rate for r in relational.central_difference(rows, "k", "us", "v").collect()}
    assert got == {("a", 0): 2.0, ("a", s): 2 / 3, ("a", 3 * s): None, ("b", 0): None, ("c", 0): None, ("c", 2 * s): None}
    runs = relational.islands(spark.createDataFrame([("a", i, f) for i, f in enumerate([1, 1, 0, 1, 0, 1, 1, 1])], "k string, i int, f int"), "k", "i", F.col("f") == 1)
    assert sorted((r.start, r.n) for r in runs.collect()) == [(1, 2), (4, 1), (6, 3)]


def test_bracketed(spark):
    got = relational.bracketed(spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 4, 5.0), ("a", 5, None)], "k string, t int, v double"), "k", "t", "v").orderBy("t").collect()
    assert [r.filled for r in got] == [1.0, 2.0, 5.0, None]


def test_maps(spark):
    lanes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 2.0)], "lane int, x double, y double")
    got = {r.id: r.lane for r in spatial.nearest_lane(spark.createDataFrame([(0, 0.0, 1.0), (1, 0.0, 0.4), (2, 90.0, 0.0)], "id int, x double, y double"), lanes, 5.0).collect()}
    assert got == {0: 2, 1: 1}  # the last lane on ties
    path = spark.createDataFrame([(1, 0.0, 0.0, 0.0, [2.0, math.pi, 1.0], [0.0, 1.0, 0.0])], "lane int, x double, y double, yaw double, lengths array<double>, curvatures array<double>")
    end = spatial.discretised(path, 0.5).orderBy(F.desc("k")).first()
    assert (round(end.x, 6), round(end.y, 6), round(end.yaw, 6)) == (1.0, 2.0, round(math.pi, 6))
    d = spatial.route_distance(spark.createDataFrame([(0, 0.0, 3.0), (0, 1.0, 1.0)], "s int, x double, y double"), spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 0.0)], "s int, x double, y double"), "s").first()
    assert d.distance == 3.0
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.5, 0.5, 3.0, 3.0), (5.0, 5.0, 6.0, 6.0)], "x0 double, y0 double, x1 double, y1 double")
    assert (spatial.records_in_patch(boxes, (0, 0, 2, 2), True).count(), spatial.records_in_patch(boxes, (0, 0, 2, 2), False).count()) == (1, 2)


def test_readers(spark, tmp_path):
    box = {"sample_token": "s", "translation": [1.0, 2.0, 3.0], "detection_name": "car", "detection_score": 0.5}
    (tmp_path / "sub.json").write_text(json.dumps({"meta": {}, "results": {"s": [box, box], "t": []}}))
    assert tables.read_submission(spark, str(tmp_path / "sub.json")).count() == 2
    with pytest.raises(Exception, match="too many boxes"):
        tables.read_submission(spark, str(tmp_path / "sub.json"), 1).collect()
    node = lambda i: {"unique_id": i, "type": "car", "translation": {"x": 1.0, "y": 2.0, "z": 0.0}}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.json").write_text(json.dumps({"scene_name": "s", "frame_idx": 0, "nodes": [node("a"), node("b")], "edges": [{"source": "a", "target": "b", "predicates": ["front"], "metrics": {"distance": 4.0}}, {"source": "a", "target": "b", "predicates": ["left"], "distance": 5.0}]}))
    (tmp_path / "g/b.json").write_text(json.dumps({"scene_name": "s", "frame_idx": 1, "objects": [{"id": "a"}, {"id": "a"}, {"type": "x"}], "relationships": [{"from": "a", "to": "z", "direction_6": "back"}]}))
    nodes, edges = tables.read_scene_graphs(spark, str(tmp_path / "g"))
    assert nodes.count() == 5 and sorted((r.src, r.dst, r.direction, r.dist) for r in edges.collect() if r.dist) == [("a", "b", "left", 5.0)]
    assert sorted(r.fault for r in tables.graph_faults(nodes, edges).collect()) == ["dangling edge", "no id", "repeated id"]
    raw = struct.pack("<5f", 1.5, -2.25, 0.0, 1e-3, 1e6) + struct.pack("<5f", *range(5))
    got = spark.createDataFrame([(bytearray(raw),), (bytearray(),)], "b binary").select(tables.points_of(F.col("b")).alias("p")).collect()
    assert np.allclose(got[0].p, np.frombuffer(raw, "<f4").reshape(2, 5)) and got[1].p == []
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", e, 1.0, u) for h, m, e, u in ((0, 0, "a", 1), (0, 30, "a", 1), (1, 10, "b", 2), (5, 0, "a", 1))]
    table = spark.createDataFrame(rows, "t string, event_type string, value double, user_id int").withColumn("ts", F.to_timestamp("t"))
    assert {(r.event_type, r.n) for r in streaming.windowed_counts(table).collect()} == {("a", 2), ("b", 1), ("a", 1)}
    assert sorted(r.n for r in streaming.session_counts(table, "40 minutes").collect()) == [1, 1, 2]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "frame bigint, level string, key string"
    want = []
    for k, rows in enumerate(([(0, "L0", "a"), (0, "L0", "b\nc"), (0, "L0", "a"), (1, "L0", "a")], [(0, "L0", "b"), (0, "L0", "a"), (1, "L0", "a"), (2, "L1", "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.running_coverage(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(f"cov{k}").outputMode("update").option("checkpointLocation", str(tmp_path / f"cp{k}")).start()
        q.processAllAvailable()
        q.stop()
        want.append({(r.frame, r.covered) for r in spark.table(f"cov{k}").collect()})
    assert want[0] == {(0, 2), (1, 1)} and {(0, 3), (1, 1), (2, 1)} <= want[1]


def test_majority_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "z", 9), (2, "y", 8)], "k int, v string, t int")
    assert sorted(tuple(r) for r in relational.majority(rows, "k", "v", "t").collect()) == [(1, "b", 2), (2, "y", 1)]


def test_ranks_and_tiles(spark):
    rows = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "v int").repartition(5)
    got = relational.ranked(rows, F.expr("v div 7"), "v").collect()
    assert all(r["rank"] == r.v + 1 for r in got) and len(got) == 101
    for n in (4, 200):
        sizes = [r["count"] for r in relational.tiles(rows, n, F.expr("v div 7"), "v").groupBy("part").count().orderBy("part").collect()]
        assert sizes == [len(x) for x in __import__("numpy").array_split(range(101), n) if len(x)]


def _tracked(spark, frames):
    """Events of one scene, from (t, truths, predictions) with places by id."""
    rows = [(0, t, kind, i, float(x), 0.0) for t, g, p in frames for kind, d in (("gt", g), ("pred", p)) for i, x in d.items()]
    return metrics.track_events(spark.createDataFrame(rows, "scene bigint, t bigint, kind string, id bigint, x double, y double"), 2.0).first()


def test_a_prediction_is_used_once(spark):
    """A truth that comes back next to another one finds its old partner taken."""
    r = _tracked(spark, [(0, {1: 0}, {7: 0}), (1, {2: 0.5}, {7: 0.5}), (2, {1: 0.4, 2: 0.5}, {7: 0.5})])
    assert (r.tp, r.fp, r.fn, r.switches) == (3, 0, 1, 0)


def test_track_scenarios(spark):
    gone = _tracked(spark, [(t, {1: t}, {} if t in (1, 2) else {9: t}) for t in range(5)])
    assert (gone.tp, gone.fp, gone.fn, gone.switches) == (3, 0, 2, 0)
    swapped = _tracked(spark, [(t, {1: 0, 2: 10}, {5: 0, 6: 10} if t < 2 else {6: 0, 5: 10}) for t in range(4)])
    assert (swapped.tp, swapped.fp, swapped.fn, swapped.switches) == (8, 0, 0, 2)
    extra = _tracked(spark, [(t, {1: 0}, {5: 0, 6: 30}) for t in range(3)])
    assert (extra.tp, extra.fp, extra.fn) == (3, 3, 0)
    far = _tracked(spark, [(t, {1: 0}, {5: 5}) for t in range(3)])
    assert (far.tp, far.fp, far.fn) == (0, 3, 3)


def test_ties_single_out_none(spark):
    rows = [(0, 1, d, "car", "moving", "front", "near", x) for d, x in ((2, 3.0), (3, 3.0), (4, 5.0), (5, 9.0))]
    edges = spark.createDataFrame(rows, "frame int, src int, dst int, dst_type string, dst_status string, dir8 string, level string, dist double")
    assert {r.dst: r.method for r in constraints.uniqueness(edges).collect()} == {2: "ordinal", 3: "ordinal", 4: "ordinal", 5: "farthest"}


def test_interpolation_at_recalls(spark):
    """Against numpy's interpolation, where several points share a recall."""
    np = __import__("numpy")
    rng = __import__("random").Random(4)
    rows = [(c, i, rng.random(), rng.random() < 0.3, rng.random()) for c in range(3) for i in range(60)] + [(3, 0, 0.5, False, 0.1), (4, 0, 0.9, True, 0.2), (4, 1, 0.8, False, 0.2)]
    curve = metrics.precision_recall(spark.createDataFrame(rows, "c int, i int, s double, h boolean, e double"), "c", "s", "i", "h")
    ap = {r.c: r.ap for r in metrics.average_precision(curve, "c").collect()}
    error = {r.c: r.error for r in metrics.true_positive_error(curve, "c", "s", "e", "h").collect()}
    for c in range(5):
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], -x[1]))
        hit = np.array([x[3] for x in mine])
        if not hit.any():
            assert ap[c] == 0 and error[c] == 1
            continue
        tp = np.cumsum(hit)
        at = np.linspace(0, 1, 101)
        precision = np.interp(at, tp / tp[-1], tp / np.arange(1, len(tp) + 1), right=0)
        conf = np.interp(at, tp / tp[-1], [x[2] for x in mine], right=0)
        assert math.isclose(ap[c], np.maximum(precision[11:] - 0.1, 0).mean() / 0.9, abs_tol=1e-6)
        errors = np.array([x[4] for x in mine if x[3]])
        mean = np.interp(conf[::-1], [x[2] for x in mine if x[3]][::-1], (np.cumsum(errors) / np.arange(1, len(errors) + 1))[::-1])[::-1]
        assert math.isclose(error[c], mean[11 : np.flatnonzero(conf)[-1] + 1].mean(), abs_tol=1e-6)


def test_mot_summary(spark):
    events = spark.createDataFrame([(0, 10, 6, 2, 2, 1, 3.0), (1, 10, 2, 0, 0, 0, 1.0)], "scene int, frames int, tp int, fp int, fn int, switches int, distance double")
    r = metrics.mot_summary(events).first()
    assert [round(x, 9) for x in r] == [0.5, 0.625, 0.5, 0.8, 10.0]


def test_plan_alternatives(spark):
    """Reference 5 removes most; without it 6 and 7 tie, and 6 remains a candidate; then 7 alone."""
    sees = {5: {1, 2}, 6: {1, 3, 6}, 7: {1, 4, 2}, 8: {1, 2, 3, 4, 6}}
    views = spark.createDataFrame([(0, 1, r, c, c in s) for r, s in sees.items() for c in (1, 2, 3, 4, 6)], "frame bigint, target bigint, ref bigint, candidate bigint, agrees boolean")
    got = {r.plan: (r.refs, r.left) for r in constraints.plan_alternatives(views, 2).collect()}
    assert got == {0: ("5|6", 1), 1: ("6|7", 1), 2: ("7", 3)}
    assert constraints.greedy_references(views, 2).first().refs == "5|6"


def test_text_questions(spark):
    from orrery.operators import questions

    asked = [("There is a stopped trailer; are there any with rider bicycles to the front left of it?", None), ("Is there another truck of the same status as the truck to the front left of the with rider thing?", None)]
    rows = spark.createDataFrame([(0, k, t) for k, (t, _) in enumerate(asked)], "frame int, qid int, text string")
    got = {r.qid: r for r in questions.parsed(rows).collect()}
    assert (got[1].same_type, got[1]["type"], got[1].status) == ("truck", "truck", None)
    nodes = spark.createDataFrame([(0, 1, "car", "moving"), (0, 2, "construction_vehicle", "parked"), (0, 3, "bus", "parked"), (0, 4, "ego", "moving")], "frame int, id int, type string, status string")
    edges = spark.createDataFrame([(0, 1, 2, "car", "moving", "front left"), (0, 1, 3, "car", "moving", "back")], "frame int, src int, dst int, src_type string, src_status string, dir6 string")
    texts = ["How many things are to the front left of the moving car?", "Is the bus the same status as the truck?", "What status is the thing to the back of the car?", "How many objects are there?"]
    q = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "frame int, qid int, text string")
    assert [r.answer for r in questions.answered(q, nodes, edges).orderBy("qid").collect()] == ["1", "no", "parked", "3"]


def test_groups_go_on_over_batches(spark):
    from orrery.operators import metrics

    rows = spark.range(5000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"), (F.col("id") * 7 % 5000).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = metrics.by_groups(rows, ["a", "b"], ["v"], lambda key, of: [(*key, len(of["v"]), bool((of["v"][1:] > of["v"][:-1]).all()) * 1, int(of["v"].sum()))], {"a": "bigint", "b": "string", "n": "bigint", "sorted": "bigint", "sum": "bigint"}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.lit(1).cast("bigint").alias("sorted"), F.sum("v").alias("sum")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 6


def test_references_are_chosen_a_batch_at_a_time(spark):
    """Many small targets: rows of a batch, not a pandas frame for each."""
    import random

    rng = random.Random(4)
    rows = [(t // 8, t, r, c, rng.random() < 0.5) for t in range(600) for r in range(100, 100 + rng.randint(1, 5)) for c in range(rng.randint(1, 6))]
    views = spark.createDataFrame(rows, "frame bigint, target bigint, ref bigint, candidate bigint, agrees boolean")
    got = constraints.greedy_references(views)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for t in range(600):
        own = [r for r in rows if r[1] == t]
        kept = {r[2]: {x[3] for x in own if x[2] == r[2] and x[4]} for r in own}
        refs, left = constraints._chosen({r[3] for r in own}, kept, 3, set())
        want.append((t // 8, t, len(refs), len(left), "|".join(map(str, refs))))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_dry_runs_choose_once(spark):
    """No filter repeats the fold over references, and both branches of a gap come from one computation."""
    from orrery.operators import dryrun

    nodes = spark.createDataFrame([], "frame bigint, id bigint, type string, status string")
    edges = spark.createDataFrame([], "frame bigint, src bigint, dst bigint, dst_type string, dir6 string, dist double")
    gaps = spark.createDataFrame([], "frame bigint, a bigint, b bigint, c bigint")
    seen = []
    original = dryrun.candidate_rows
    try:
        dryrun.candidate_rows = lambda t, e: seen.append(1) or original(t, e)
        plan = dryrun.diverge_plans(gaps, nodes, edges)._jdf.queryExecution().analyzed().toString()
    finally:
        dryrun.candidate_rows = original
    assert len(seen) == 1 and plan.count("aggregate(") == 1
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambdafunction(" in line]


def test_selection_reads_frames_as_arrow(spark):
    """Nested plans of a frame are not made pandas objects one by one."""
    gaps = spark.createDataFrame([(1, "x", 5, [("A", ["x", "y"]), ("A", ["z"])]), (1, "y", 4, [("B", ["y"])]), (1, "z", 3, [("B", ["z"]), ("A", ["q"])]), (2, "k", 1, [])], "frame bigint, key string, score int, plans array<struct<slot:string,covers:array<string>>>")
    got = constraints.two_phase_selection(gaps)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, "x", "A", 2, "share"), (1, 2, 2, "z", "B", 1, "share")]
