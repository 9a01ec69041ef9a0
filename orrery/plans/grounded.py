"""Grounded questions, plans held against graphs, questions in words, reference boxes and label lines over the stand-in data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions import realise as R
from orrery.operators import grounding
from orrery.session import read_table
from orrery.sources import exports, truth

from .scene import EDGES, NODES, edges_of, nodes_of

SIX = ("front", "front left", "back left", "back", "back right", "front right")
#: Questions about an edge that are stored with an answer, by k.
STORED = (
    "Are there any {s} {t}s to the {d} of the {us} {u}?", "How many {t}s are to the {d} of me?", "There is a {s} thing to the {d} of the {us} {u}; what is it?",
    "What is the status of the {t} to the {d} of me?", "How many {s} {t}s are there?", "Is the {t} to the {d} of the {us} {u} the same status as the {us} {u}?",
)


def own_of(nodes: DataFrame) -> DataFrame:
    """Stand-in for the own vehicle of a frame."""
    return nodes.groupBy("frame").agg(F.min("id").alias("id"))


def _stored(edges: DataFrame) -> DataFrame:
    k = ((F.col("src") * 7 + F.col("dst")) % 6).cast("int")
    spaced = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    text = F.element_at(F.array(*[F.lit(t) for t in STORED]), k + 1)
    for mark, value in (("{s}", F.col("dst_status")), ("{t}", spaced("dst_type")), ("{us}", F.col("src_status")), ("{u}", spaced("src_type")), ("{d}", spaced("dir6"))):
        text = F.replace(text, F.lit(mark), value)
    answers = F.array(F.when((F.col("src") + F.col("dst")) % 3 > 0, "yes").otherwise("no"), F.lit("1"), spaced("dst_type"), F.col("dst_status"), F.lit("2"), F.lit("yes"))
    return edges.select("frame", (F.col("src") * 1000000 + F.col("dst")).alias("qid"), text.alias("text"), F.element_at(answers, k + 1).alias("answer"))


def grounded_questions(spark, sf_dir):
    """What stored questions about every edge stand on."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    found = grounding.grounded(_stored(e), n, e, own_of(n))
    return found.select("frame", "qid", "family", "verdict", F.size("ids").alias("n_ids"), F.size("pairs").alias("n_pairs"))


def grounded_coverage(spark, sf_dir):
    """Nodes and edges that the stored questions cover, of all of a frame."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    return grounding.grounded_hits(grounding.grounded(_stored(e), n, e, own_of(n))).groupBy("frame", "level").agg(F.count("*").alias("covered"))


def direction_methods(spark, sf_dir):
    """Right answers under three frames of direction, for questions about every edge with answers from the reference's frame."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    k = ((F.col("src") * 7 + F.col("dst")) % 5).cast("int")
    family = F.element_at(F.array(*[F.lit(f) for f in ("exist", "count", "object", "status", "comparison")]), k + 1)
    told = F.element_at(F.array(F.lit("yes"), F.lit("1"), F.col("dst_type"), F.col("dst_status"), F.when(F.col("src_status") == F.col("dst_status"), "yes").otherwise("no")), k + 1)
    q = e.select("frame", (F.col("src") * 1000000 + F.col("dst")).alias("qid"), family.alias("family"), "src", F.when(k != 2, F.col("dst_type")).alias("type"), F.when(k < 2, F.col("dst_status")).alias("status"), F.col("dir6").alias("direction"), told.alias("answer"))
    return grounding.accuracy_by_method(grounding.direction_answers(n, q, own_of(n)))


FAMILIES = ("converge", "diverge_compare", "distance_chain", "direction_chain", "viewpoint_transfer")


def _plans(spark, sf_dir) -> DataFrame:
    """A plan for every pair of neighbours of every node: frame, qid, a, b, c, types, directions both ways, distances."""
    e = edges_of(spark, sf_dir)
    there = e.select("frame", F.col("src").alias("b"), F.col("dst").alias("end"), F.col("src_type").alias("b_type"), F.col("dst_type").alias("type"), F.col("dst_status").alias("status"), F.col("dir6").alias("out"), "dist")
    legs = there.join(e.select("frame", F.col("dst").alias("b"), F.col("src").alias("end"), F.col("dir6").alias("in")), ["frame", "b", "end"])
    side = lambda k: legs.select("frame", "b", *(["b_type"] if k == "a" else []), F.col("end").alias(k), F.col("type").alias(f"{k}_type"), F.col("status").alias(f"{k}_status"), F.col("out").alias(f"out_{k}"), F.col("in").alias(f"in_{k}"), F.col("dist").alias(f"d_{k}"))
    met = side("a").join(side("c"), ["frame", "b"]).where("a < c")
    return met.withColumns({"qid": F.concat_ws("-", "a", "b", "c"), "family": F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), ((F.col("a") + F.col("b") + F.col("c")) % 5 + 1).cast("int"))})


def plan_verification(spark, sf_dir):
    """Plans that their graph bears out, by family."""
    p = _plans(spark, sf_dir)
    places = nodes_of(spark, sf_dir).select("frame", "id", "x", "y")
    for k in ("a", "b", "c"):
        p = p.join(places.select("frame", F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")), ["frame", k])
    side = G.side_of(*[F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")])
    found = grounding.found_by_plans(p, edges_of(spark, sf_dir)).withColumns({"d_ab": F.round("d_a", 3), "d_bc": F.round("d_c", 3), "dir_ab": F.col("in_a"), "dir_bc": F.col("out_c")})
    return found.groupBy("family", grounding.valid_plan(F.col("family"), side).alias("valid")).agg(F.count("*").alias("n"))


def diverge_pairs(spark, sf_dir):
    """Pairs of branches as planned, where every fourth plan has the directions of its branches exchanged: how many hold, and how many of these agree in status."""
    p = _plans(spark, sf_dir)
    wrong = (F.col("a") + F.col("c")) % 4 == 0
    plans = p.select("frame", "a", "b", "c", "a_type", "c_type", F.when(wrong, F.col("out_c")).otherwise(F.col("out_a")).alias("dir_to_a"), F.when(wrong, F.col("out_a")).otherwise(F.col("out_c")).alias("dir_to_c"))
    holds = grounding.pair_holds(plans, edges_of(spark, sf_dir)).groupBy("frame").agg(F.count("*").alias("held"), F.count_if(F.col("a_status") == F.col("c_status")).alias("same"))
    return plans.groupBy("frame").agg(F.count("*").alias("n")).join(holds, "frame", "left").select("frame", "n", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("same", F.lit(0)).alias("same"))


def plan_graphs(spark, sf_dir):
    """Edges of plans, by family, whence they come and how many plans share them; a plan's reference is its pivot's smallest neighbour but for the plan's own."""
    p = _plans(spark, sf_dir)
    least = edges_of(spark, sf_dir).groupBy("frame", F.col("src").alias("b")).agg(F.min("dst").alias("ref"))
    text = {k: F.col(k).cast("string") for k in ("a", "b", "c", "ref")}
    refs = F.when(~F.col("ref").isin(F.col("a"), F.col("c")), F.array(text["ref"])).otherwise(F.array().cast("array<string>"))
    e = p.join(least, ["frame", "b"]).select("frame", "family", F.explode(grounding.plan_graph(F.col("family"), text["a"], text["b"], text["c"], refs)).alias("e")).select("frame", "family", "e.*")
    return e.groupBy("family", "source", "src", "dst").agg(F.count("*").alias("plans")).groupBy("family", "source", "plans").agg(F.count("*").alias("edges"))


def realised_questions(spark, sf_dir):
    """Every plan in words, the forms in turn; where a is even its first branch has a further clause, where c is a multiple of three a rank."""
    p = _plans(spark, sf_dir)
    name = lambda kind, k: F.concat(F.replace(F.col(kind), F.lit("_"), F.lit(" ")), F.lit(" "), F.col(k).cast("string"))
    clause = lambda kind, value, ref: F.struct(F.lit(kind).alias("kind"), value.alias("value"), ref.alias("ref"))
    clauses = F.array_compact(F.array(F.when(F.col("a") % 2 == 0, clause("ref_dir", F.col("in_c"), name("c_type", "c"))), F.when(F.col("c") % 3 == 0, clause("dist_rank", F.lit("second-closest"), F.lit("")))))
    none = F.slice(clauses, 1, 0)
    spaced = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    ends = {"a": name("a_type", "a"), "b": name("b_type", "b"), "c": name("c_type", "c")}

    def parts(kind: str, way: str) -> dict:
        return {"one": R.one(spaced(kind)), "many": R.many(spaced(kind)), "label": R.label(spaced(kind), clauses), "dir": spaced(way), "dir2": spaced("in_c"), "extra": R.extra_words(clauses), **ends}

    branches = {"x": R.description(spaced("a_type"), F.col("out_a"), ends["b"], clauses), "y": R.description(spaced("c_type"), F.col("out_c"), ends["b"], none)}
    told = None
    k = (F.col("a") + F.col("b") + F.col("c")) % len(R.FORMS)
    for i, form in enumerate(R.FORMS):
        own = parts("b_type", "in_a") if form.startswith("converge") else parts("a_type", "out_a")
        this = R.realised(form, F.col("qid"), 7, **own, **branches)
        told = F.when(k == i, this) if told is None else told.when(k == i, this)
    return p.select("frame", "qid", told.alias("q")).select("frame", "qid", "q.*")


def text_edge_coverage(spark, sf_dir):
    """Edges that texts of queries about every node touch: moving ones by id, parked ones by type, and one about the own vehicle where something stands."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    own = own_of(n).withColumnRenamed("id", "own")
    name = lambda kind, k: F.when(F.col(k) == F.col("own"), "ego").otherwise(F.concat(F.col(kind), F.col(k).cast("string")))
    ask = {"moving": F.concat(F.lit("MATCH (n) WHERE n.unique_id = '"), "type", F.col("id").cast("string"), F.lit("' RETURN n")), "parked": F.concat(F.lit("MATCH (n {type: \""), F.col("type"), F.lit("\"}) RETURN count(n)"))}
    text = F.when(F.col("status") == "moving", ask["moving"]).when((F.col("status") == "parked") & (F.col("type") == "bus"), ask["parked"]).when(F.col("status") == "standing", "MATCH (Ego)-[r]->(n) RETURN n").otherwise("")
    return grounding.text_coverage(n.select("frame", text.alias("text")), e.join(own, "frame").select("frame", name("src_type", "src").alias("source"), name("dst_type", "dst").alias("target")))


#: Templates and what they require.
TEMPLATES = {"seen": (), "own_status": ("ego_src", "tgt_status"), "both_statuses": ("src_status", "tgt_status"), "how_far": ("dist",), "by_anchor": ("anc", "anc_status"), "beyond": ("beyond", "beyond_status")}


def template_matches(spark, sf_dir):
    """Templates that fit every edge, and those of which a text comes out; the anchor is known for odd targets, a parked status is not."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    own = own_of(n).withColumnRenamed("id", "own")
    state = lambda c: F.when(F.col(c) == "parked", "unknown").otherwise(F.col(c))
    anchor = F.when(F.col("dst") % 2 == 1, F.col("own").cast("string"))
    c = e.join(own, "frame").select("frame", F.when(F.col("src") == F.col("own"), "ego").otherwise(F.col("src").cast("string")).alias("src_id"), state("dst_status").alias("tgt_status"), state("src_status").alias("src_status"), F.col("level").alias("dist_level"), anchor.alias("anc_id"), state("src_status").alias("anc_status"), F.lit("").alias("beyond_id"), F.lit(None).cast("string").alias("beyond_status"))
    text = grounding.filled(F.concat(F.lit("{src} sees a {status} thing, "), F.col("t")), {"src": F.col("src_id"), "status": F.col("tgt_status")})
    t = c.withColumn("t", F.explode(grounding.applicable_templates(TEMPLATES)))
    return t.groupBy("frame", F.col("t").alias("template")).agg(F.count("*").alias("fits"), F.count(text).alias("filled"))


#: Full categories of the stand-in's types; the last has no class.
CATEGORIES = {
    "car": "vehicle.car", "truck": "vehicle.truck", "bus": "vehicle.bus.rigid", "trailer": "vehicle.trailer", "construction_vehicle": "vehicle.construction", "pedestrian": "human.pedestrian.adult",
    "motorcycle": "vehicle.motorcycle", "bicycle": "vehicle.bicycle", "traffic_cone": "movable_object.trafficcone", "barrier": "static_object.bicycle_rack",
}


def _recording(spark, sf_dir) -> dict[str, DataFrame]:
    """Stand-in: four frames are a scene, half a second apart; a place in the frame is an object's chain."""
    n = nodes_of(spark, sf_dir).withColumn("scene", F.expr("frame div 4"))
    s = n.select("frame", "scene").distinct()
    near = lambda d: F.when((F.expr(f"(frame + {d}) div 4") == F.col("scene")) & (F.col("id") + 25 * d >= 0), (F.col("id") + 25 * d).cast("string")).otherwise("")
    object_ = F.concat_ws("-", "scene", F.col("id") % 25, "type")
    here = F.array("x", "y", F.lit(0.0))
    ann = n.select(F.col("id").cast("string").alias("token"), F.col("frame").cast("string").alias("sample_token"), object_.alias("instance_token"), F.when(F.col("id") % 3 > 0, F.array("status")).otherwise(F.array().cast("array<string>")).alias("attribute_tokens"), here.alias("translation"), F.array(F.lit(2.0), F.lit(4.0), "height").alias("size"), F.array(F.cos(F.radians("yaw") / 2), F.lit(0.0), F.lit(0.0), F.sin(F.radians("yaw") / 2)).alias("rotation"), (F.col("id") % 7).alias("num_lidar_pts"), (F.col("id") % 2).alias("num_radar_pts"), near(-1).alias("prev"), near(1).alias("next"))
    return {
        "sample": s.select(F.col("frame").cast("string").alias("token"), (F.col("frame") * 500000).alias("timestamp"), F.col("scene").cast("string").alias("scene_token")),
        "scene": s.select(F.col("scene").cast("string").alias("token"), F.concat(F.lit("scene-"), F.col("scene")).alias("name")).distinct(),
        "sample_annotation": ann, "instance": n.select(object_.alias("token"), F.col("type").alias("category_token")).distinct(),
        "category": n.select(F.col("type").alias("token"), F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[F.col("type")].alias("name")).distinct(),
        "attribute": n.select(F.col("status").alias("token"), F.concat(F.lit("state."), "status").alias("name")).distinct(),
    }


def _boxes(spark, sf_dir, tracking: bool) -> DataFrame:
    t = _recording(spark, sf_dir)
    boxes = truth.truth_boxes(truth.samples_of(t["sample"], t["scene"], scenes=t["scene"]), t, tracking)
    speed = lambda c: F.when(~F.isnan(c), F.round(c, 4)).alias(c)
    return boxes.select("sample_token", "token", "name", "tracking_id" if tracking else "attribute_name", "num_pts", "score", speed("vx"), speed("vy"))


def truth_detections(spark, sf_dir):
    """Reference boxes of all scenes with class and attribute."""
    return _boxes(spark, sf_dir, False)


def truth_tracks(spark, sf_dir):
    """Reference boxes of all scenes with tracked class and track."""
    return _boxes(spark, sf_dir, True)


def label_lines(spark, sf_dir):
    """A line of a label file for every box, seen from a camera that looks ahead."""
    n = nodes_of(spark, sf_dir)
    line = exports.label_line(F.initcap("type"), F.col("x"), F.col("y"), F.lit(0.5), F.lit(2.0), F.lit(4.5), F.col("height"), F.col("yaw"), (0.5, 0.5, -0.5, 0.5), (0.1, -0.2, 0.3), score=F.col("visibility"))
    return n.select("frame", "id", line.alias("line"))


def pose_coordinates(spark, sf_dir):
    """Latitude and longitude of every supplier's pose."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("timestamp"), F.col("s_suppkey").alias("ordinal"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_suppkey") % 500).cast("double").alias("y"))
    return exports.pose_places(s, 42.3368, -71.0578).select("scene", "timestamp", F.round("latitude", 8).alias("latitude"), F.round("longitude", 8).alias("longitude"))


QUERIES = {
    f.__name__: f
    for f in (grounded_questions, grounded_coverage, direction_methods, plan_verification, diverge_pairs, plan_graphs, realised_questions, text_edge_coverage, template_matches, truth_detections, truth_tracks, label_lines, pose_coordinates)
}

_OWN = "own AS (SELECT frame, min(id) AS own FROM nodes GROUP BY 1)"
# a question names a construction vehicle truck
_NAME = "CASE {0} WHEN 'construction_vehicle' THEN 'truck' ELSE {0} END"
_GROUNDED = f"""WITH {EDGES}, {_OWN}, q AS (SELECT frame, src * 1000000 + dst AS qid, (src * 7 + dst) % 6 AS k, {_NAME.format('dst_type')} AS t, dst_type, dst_status AS s, dir6 AS d, src_status AS us, {_NAME.format('src_type')} AS u, (src + dst) % 3 > 0 AS yes FROM edges),
  f AS (SELECT frame, type AS u, status AS us, min(id) AS id, count(*) AS n FROM nodes GROUP BY 1, 2, 3),
  a AS (SELECT q.*, CASE WHEN k IN (1, 3) THEN own WHEN k <> 4 THEN f.id END AS anchor, coalesce(z.n, 0) AS alone FROM q JOIN own USING (frame) LEFT JOIN f USING (frame, u, us) LEFT JOIN f z ON z.frame = q.frame AND z.u = q.t AND z.us = q.s),
  h AS (SELECT a.frame, a.qid, a.k, a.s, a.t, a.anchor, a.alone, a.yes, list(e.dst) FILTER (e.dst IS NOT NULL) AS hits, list(e.dst) FILTER (CASE WHEN k = 2 THEN e.dst_type = a.dst_type ELSE e.dst_status = a.s END) AS fit
        FROM a LEFT JOIN edges e ON e.frame = a.frame AND e.src = a.anchor AND e.dir6 = a.d AND (k IN (2, 5) OR e.dst_type = a.t) AND (k NOT IN (0, 2) OR e.dst_status = a.s) GROUP BY ALL),
  c AS (SELECT *, coalesce(len(hits), 0) AS n, coalesce(len(fit), 0) AS m FROM h),
  v AS (SELECT *, CASE WHEN k <> 4 AND anchor IS NULL THEN 'unparsed' WHEN k = 0 AND (n > 0) = yes OR k = 1 AND n = 1 OR k IN (2, 3) AND m > 0 OR k = 4 AND alone = 2 THEN 'match' WHEN k IN (2, 3) AND n > 0 THEN 'partial' WHEN k = 5 AND n > 0 THEN 'grounded' ELSE 'mismatch' END AS verdict FROM c),
  g AS (SELECT *, CASE WHEN verdict IN ('unparsed', 'mismatch') THEN [] WHEN k IN (2, 3) AND verdict = 'match' THEN fit ELSE coalesce(hits, []) END AS stands FROM v)"""
_TURN = "(['front','front left','back left','back','back right','front right'])[((ceil((((((degrees(atan2(dy, dx)) - {0}) + 180) % 360 + 360) % 360 - 180 + 30 + 360) % 360) / 60))::INT + 5) % 6 + 1]"
_PLANS = f"""WITH {EDGES}, legs AS (SELECT e.frame, e.src AS b, e.dst AS n, e.src_type AS b_type, e.dst_type AS type, e.dst_status AS status, e.dir6 AS o, r.dir6 AS i, e.dist FROM edges e JOIN edges r ON r.frame = e.frame AND r.src = e.dst AND r.dst = e.src),
  p AS (SELECT x.frame, x.n AS a, x.b, y.n AS c, x.n || '-' || x.b || '-' || y.n AS qid, x.type AS a_type, x.b_type, y.type AS c_type, x.status AS a_status, y.status AS c_status, x.o AS out_a, y.o AS out_c, x.i AS in_a, y.i AS in_c, x.dist AS d_a, y.dist AS d_c, ({list(FAMILIES)})[(x.n + x.b + y.n) % 5 + 1] AS family
        FROM legs x JOIN legs y ON x.frame = y.frame AND x.b = y.b AND x.n < y.n)"""


def _told() -> str:
    """The wordings as SQL."""
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {i} THEN ([{', '.join(map(quote, w))}])[('0x' || substr(md5('7:' || qid), 1, 7))::BIGINT % {len(w)} + 1]" for i, (_, _, w) in enumerate(R.FORMS.values()))
    text = f"CASE k {cases} END"
    noun = "CASE WHEN k < 4 THEN bt ELSE ta END"
    label = f"CASE WHEN c % 3 = 0 THEN 'second closest ' ELSE '' END || {noun}"
    extra = "CASE WHEN a % 2 = 0 THEN ', and to the ' || in_c || ' of ' || ct || ' ' || c ELSE '' END"
    parts = {
        "one": f"CASE WHEN regexp_matches({noun}, '^[aeiou]') THEN 'an ' ELSE 'a ' END || {noun}", "many": f"CASE WHEN {noun} LIKE '%s' THEN {noun} ELSE {noun} || 's' END", "label": label, "dir": "CASE WHEN k < 4 THEN in_a ELSE out_a END", "dir2": "in_c", "extra": extra,
        "a": "ta || ' ' || a", "b": "bt || ' ' || b", "c": "ct || ' ' || c",
        "x": f"'the ' || CASE WHEN c % 3 = 0 THEN 'second closest ' ELSE '' END || ta || ' to the ' || out_a || ' of ' || bt || ' ' || b || {extra}", "y": "'the ' || ct || ' to the ' || out_c || ' of ' || bt || ' ' || b",
    }
    for name, value in parts.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


_CAMERA = "(CASE WHEN -height < -9.95 THEN NULL WHEN height >= 1 THEN round_even(height, 1) ELSE round_even(height, 2) END)::VARCHAR"
ORACLE = {
    "grounded_questions": f"""{_GROUNDED} SELECT frame, qid, (['exist', 'count', 'object', 'status', 'count', 'comparison'])[k + 1] AS family, verdict, (CASE WHEN verdict <> 'unparsed' AND anchor IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN k = 4 AND verdict = 'match' THEN 2 ELSE len(stands) END)::INT AS n_ids, (CASE WHEN anchor IS NULL THEN 0 ELSE len(stands) END)::INT AS n_pairs FROM g""",
    "grounded_coverage": f"""{_GROUNDED}, s AS (SELECT * FROM g WHERE verdict IN ('match', 'grounded')), x AS (SELECT frame, 'L0' AS level, anchor::VARCHAR AS key FROM s WHERE anchor IS NOT NULL UNION SELECT frame, 'L0', unnest(stands)::VARCHAR FROM s UNION SELECT s.frame, 'L0', n.id::VARCHAR FROM s JOIN nodes n ON n.frame = s.frame AND n.type = s.t AND n.status = s.s WHERE k = 4
        UNION SELECT frame, 'L1', least(anchor::VARCHAR, n::VARCHAR) || '|' || greatest(anchor::VARCHAR, n::VARCHAR) FROM (SELECT frame, anchor, unnest(stands) AS n FROM s WHERE anchor IS NOT NULL)) SELECT frame, level, count(*) AS covered FROM x GROUP BY 1, 2""",
    "direction_methods": f"""WITH {EDGES}, {_OWN}, h AS (SELECT o.frame, n.yaw AS own_yaw FROM own o JOIN nodes n ON n.frame = o.frame AND n.id = o.own), m AS (SELECT r.*, method, CASE method WHEN 'ego' THEN {_TURN.format('own_yaw')} WHEN 'source' THEN {_TURN.format('yaw')} ELSE {_TURN.format('0')} END AS way FROM raw r JOIN h USING (frame), (VALUES ('ego'), ('source'), ('world')) w(method)),
        q AS (SELECT frame, src, dst, (src * 7 + dst) % 5 AS k, dst_type AS t, dst_status AS s, src_status AS us, dir6 AS d, method FROM edges, (VALUES ('ego'), ('source'), ('world')) w(method)),
        a AS (SELECT q.frame, q.src, q.dst, q.k, q.t, q.s, q.us, q.method, count(m.dst) AS n, coalesce(bool_or(m.dst_type = q.t), false) AS kind, coalesce(bool_or(m.dst_status = q.s), false) AS state, coalesce(bool_or((m.dst_status = q.us) = (q.s = q.us)), false) AS same FROM q LEFT JOIN m ON m.frame = q.frame AND m.src = q.src AND m.method = q.method AND m.way = q.d AND (q.k = 2 OR m.dst_type = q.t) AND (q.k > 1 OR m.dst_status = q.s) GROUP BY ALL),
        b AS (SELECT method, (['exist', 'count', 'object', 'status', 'comparison'])[k + 1] AS family, k < 2 OR n > 0 AS answered, CASE k WHEN 0 THEN n > 0 WHEN 1 THEN n = 1 WHEN 2 THEN kind WHEN 3 THEN state ELSE same END AS correct FROM a)
        SELECT method, family, count(*) AS n, count(*) FILTER (answered) AS answered, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 6) AS rate FROM b GROUP BY 1, 2""",
    "plan_verification": f"""{_PLANS}, z AS (SELECT p.frame, p.qid, count(*) AS n, min(e.dst) AS x FROM p JOIN edges e ON e.frame = p.frame AND e.src = p.a AND e.dst_type = p.b_type AND e.dir6 = p.in_a JOIN edges f ON f.frame = p.frame AND f.src = p.c AND f.dst = e.dst AND f.dir6 = p.in_c GROUP BY 1, 2),
        g AS (SELECT frame, src, dst_type, dir6, count(*) AS n FROM edges GROUP BY ALL), w AS (SELECT p.family, z.n AS nb, ga.n AS na, gc.n AS nc, round(p.d_a, 3) <> round(p.d_c, 3) AS far, (((degrees(atan2(pc.y - pa.y, pc.x - pa.x)) - degrees(atan2(pb.y - pa.y, pb.x - pa.x))) + 180) % 360 + 360) % 360 - 180 AS turn
          FROM p LEFT JOIN z USING (frame, qid) LEFT JOIN g ga ON ga.frame = p.frame AND ga.src = p.b AND ga.dst_type = p.a_type AND ga.dir6 = p.out_a LEFT JOIN g gc ON gc.frame = p.frame AND gc.src = p.b AND gc.dst_type = p.c_type AND gc.dir6 = p.out_c JOIN nodes pa ON pa.id = p.a JOIN nodes pb ON pb.id = p.b JOIN nodes pc ON pc.id = p.c)
        SELECT family, coalesce(CASE family WHEN 'converge' THEN nb = 1 WHEN 'diverge_compare' THEN na = 1 AND nc = 1 WHEN 'distance_chain' THEN far WHEN 'direction_chain' THEN true ELSE abs(turn) > 10 AND abs(turn) < 170 END, false) AS valid, count(*) AS n FROM w GROUP BY 1, 2""",
    "diverge_pairs": f"""{_PLANS} SELECT frame, count(*) AS n, count(*) FILTER ((a + c) % 4 > 0 OR out_a = out_c) AS held, count(*) FILTER (((a + c) % 4 > 0 OR out_a = out_c) AND a_status = c_status) AS same FROM p GROUP BY 1""",
    "plan_graphs": f"""{_PLANS}, m AS (SELECT frame, src AS b, min(dst) AS ref FROM edges GROUP BY 1, 2), r AS (SELECT p.*, CASE WHEN ref NOT IN (a, c) THEN ref END AS ref FROM p JOIN m USING (frame, b)),
        e AS (SELECT family, 'template' AS source, a AS src, b AS dst FROM r UNION ALL SELECT family, 'template', CASE family WHEN 'converge' THEN c ELSE b END, CASE family WHEN 'converge' THEN b ELSE c END FROM r UNION ALL SELECT family, 'constraint', ref, CASE family WHEN 'converge' THEN b ELSE a END FROM r WHERE ref IS NOT NULL AND family IN ('converge', 'diverge_compare')),
        g AS (SELECT family, source, src, dst, count(*) AS plans FROM e GROUP BY ALL) SELECT family, source, plans, count(*) AS edges FROM g GROUP BY 1, 2, 3""",
    "realised_questions": f"""{_PLANS}, t AS (SELECT *, (a + b + c) % {len(R.FORMS)} AS k, replace(a_type, '_', ' ') AS ta, replace(b_type, '_', ' ') AS bt, replace(c_type, '_', ' ') AS ct FROM p)
        SELECT frame, qid, {_told()} AS question, ({[f[1] for f in R.FORMS.values()]})[k + 1] AS answer_type, ({[f[0] for f in R.FORMS.values()]})[k + 1] AS template_family FROM t""",
    "text_edge_coverage": f"""WITH {EDGES}, {_OWN}, e AS (SELECT frame, CASE src WHEN own THEN 'ego' ELSE src_type || src END AS s, CASE dst WHEN own THEN 'ego' ELSE dst_type || dst END AS t FROM edges JOIN own USING (frame)),
        c AS (SELECT DISTINCT e.frame, s, t FROM e JOIN nodes n ON n.frame = e.frame AND CASE WHEN n.status = 'moving' THEN contains(s, n.type || n.id) OR contains(t, n.type || n.id) WHEN n.status = 'parked' AND n.type = 'bus' THEN contains(s, 'bus') OR contains(t, 'bus') WHEN n.status = 'standing' THEN s = 'ego' ELSE false END),
        k AS (SELECT frame, count(*) AS covered FROM c GROUP BY 1) SELECT frame, coalesce(any_value(covered), 0)::BIGINT AS covered, count(*) AS total, round(100.0 * coalesce(any_value(covered), 0) / count(*), 2)::DOUBLE AS rate FROM e LEFT JOIN k USING (frame) GROUP BY 1""",
    "template_matches": f"""WITH {EDGES}, {_OWN}, c AS (SELECT frame, src = own AS ego, dst_status <> 'parked' AS ts, src_status <> 'parked' AS ss, dst % 2 = 1 AS anc FROM edges JOIN own USING (frame)),
        t AS (SELECT frame, ts, unnest(list_filter([CASE WHEN true THEN 'seen' END, CASE WHEN ego AND ts THEN 'own_status' END, CASE WHEN ss AND ts THEN 'both_statuses' END, 'how_far', CASE WHEN anc AND ss THEN 'by_anchor' END], lambda x: x IS NOT NULL)) AS template FROM c)
        SELECT frame, template, count(*) AS fits, count(*) FILTER (ts) AS filled FROM t GROUP BY 1, 2""",
    **{
        f"truth_{kind}": f"""WITH {NODES}, v AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(frame) OVER w AS pf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(frame) OVER w AS nf FROM nodes WINDOW w AS (PARTITION BY frame // 4, id % 25 ORDER BY frame))
        SELECT frame::VARCHAR AS sample_token, id::VARCHAR AS token, type AS name, {extra}, id % 7 + id % 2 AS num_pts, -1.0::DOUBLE AS score, round((coalesce(nx, x) - coalesce(px, x)) / nullif((coalesce(nf, frame) - coalesce(pf, frame)) * 0.5, 0), 4) AS vx, round((coalesce(ny, y) - coalesce(py, y)) / nullif((coalesce(nf, frame) - coalesce(pf, frame)) * 0.5, 0), 4) AS vy
        FROM v WHERE type NOT IN ({gone})"""
        for kind, extra, gone in (("detections", "CASE WHEN id % 3 > 0 THEN 'state.' || status ELSE '' END AS attribute_name", "'barrier'"), ("tracks", "frame // 4 || '-' || id % 25 || '-' || type AS tracking_id", "'barrier', 'construction_vehicle', 'traffic_cone'"))
    },
    "label_lines": f"""WITH {NODES}, c AS (SELECT *, {_CAMERA} AS tall, -atan2(sin(radians(yaw)), cos(radians(yaw))) AS turn FROM nodes)
        SELECT frame, id, upper(type[1]) || type[2:] || ' -1.00 -1 -10.00 -1.00 -1.00 -1.00 -1.00 ' || tall || printf(' 2.00 4.50 %.2f %.2f %.2f %.2f', x + 0.1, -0.5 - 0.2 + height / 2, y + 0.3, turn) || CASE WHEN visibility IS NOT NULL THEN printf(' %.4f', visibility) ELSE '' END AS line FROM c""",
    "pose_coordinates": """WITH s AS (SELECT s_nationkey AS scene, s_suppkey AS timestamp, s_acctbal / 10 AS x, (s_suppkey % 500)::DOUBLE AS y FROM supplier), d AS (SELECT *, sqrt(x * x + y * y) / 6378137.0 AS w, atan2(x, y) AS t, radians(42.3368) AS f FROM s), l AS (SELECT *, asin(sin(f) * cos(w) + cos(f) * sin(w) * cos(t)) AS g FROM d)
        SELECT scene, timestamp, round(degrees(g), 8) AS latitude, round(-71.0578 + degrees(atan2(sin(t) * sin(w) * cos(f), cos(w) - sin(f) * sin(g))), 8) AS longitude FROM l""",
}
