"""Queries over scene graphs. Stand-in: a frame is 25 consecutive embeddings; position, heading, speed and size are their components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.operators import constraints, coverage, generate, graph, kinds, patterns, relational, spatial
from orrery.session import read_table

#: The type of each label of the stand-in, and the statuses.
TYPES = ("car", "truck", "bus", "trailer", "construction_vehicle", "pedestrian", "motorcycle", "bicycle", "traffic_cone", "barrier")
STATUSES = ("moving", "parked", "standing")
REACH = 12.0


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    status = F.when(e(6) > 0.05, "moving").when(e(6) < -0.05, "parked").otherwise("standing")
    return read_table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 25").alias("frame"), F.col("vec_id").alias("id"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("label") + 1).alias("type"), status.alias("status"),
        (e(0) * 100).alias("x"), (e(1) * 100).alias("y"), F.degrees(F.atan2(e(3), e(2))).alias("yaw"), (e(4) * 20).alias("vx"), (e(5) * 20).alias("vy"),
        (1 + F.abs(e(7)) * 5).alias("height"), F.when(F.col("vec_id") % 5 > 0, (F.col("vec_id") % 5) / 5.0).alias("visibility"), F.col("embedding").alias("vec"),
    )


def edges_of(spark: SparkSession, sf_dir: str, reach: float = REACH) -> DataFrame:
    return graph.build_edges(nodes_of(spark, sf_dir), reach)


NODES = """nodes AS (
  SELECT vec_id // 25 AS frame, vec_id AS id, (['car','truck','bus','trailer','construction_vehicle','pedestrian','motorcycle','bicycle','traffic_cone','barrier'])[label + 1] AS type,
         CASE WHEN embedding[7]::DOUBLE > 0.05 THEN 'moving' WHEN embedding[7]::DOUBLE < -0.05 THEN 'parked' ELSE 'standing' END AS status,
         embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, degrees(atan2(embedding[4]::DOUBLE, embedding[3]::DOUBLE)) AS yaw,
         embedding[5]::DOUBLE * 20 AS vx, embedding[6]::DOUBLE * 20 AS vy, 1 + abs(embedding[8]::DOUBLE) * 5 AS height,
         CASE WHEN vec_id % 5 > 0 THEN (vec_id % 5) / 5.0 END AS visibility, embedding AS vec
  FROM embeddings)"""
EDGES = NODES + """, raw AS (
  SELECT a.frame, a.id AS src, b.id AS dst, a.type AS src_type, b.type AS dst_type, a.status AS src_status, b.status AS dst_status, b.x - a.x AS dx, b.y - a.y AS dy, b.vx - a.vx AS dvx, b.vy - a.vy AS dvy,
         sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS dist, a.yaw FROM nodes a JOIN nodes b ON a.frame = b.frame AND a.id <> b.id),
turned AS (SELECT *, ((((degrees(atan2(dy, dx)) - yaw) + 180) % 360) + 360) % 360 - 180 AS angle FROM raw WHERE dist <= 12),
edges AS (
  SELECT *, (['front','left','back','right'])[(floor(((angle + 45 + 360) % 360) / 90))::INT + 1] AS dir4,
         (['front','front_left','left','back_left','back','back_right','right','front_right'])[(floor(((angle + 22.5 + 360) % 360) / 45))::INT + 1] AS dir8,
         (['front','front left','back left','back','back right','front right'])[((ceil(((angle + 30 + 360) % 360) / 60))::INT + 5) % 6 + 1] AS dir6,
         CASE WHEN dist <= 10 THEN 'near' WHEN dist <= 25 THEN 'mid' ELSE 'far' END AS level FROM turned)"""
UNIVERSE = EDGES + """, near AS (SELECT frame, src AS n, dst AS o FROM edges UNION SELECT frame, dst, src FROM edges),
pivots AS (SELECT p.frame, p.o AS a, p.n AS mid, q.o AS c FROM near p JOIN near q ON p.frame = q.frame AND p.n = q.n AND p.o < q.o),
universe AS (
  SELECT frame, 'L0' AS level, id::VARCHAR AS key FROM nodes
  UNION ALL SELECT DISTINCT frame, 'L1', least(src::VARCHAR, dst::VARCHAR) || '|' || greatest(src::VARCHAR, dst::VARCHAR) FROM edges
  UNION ALL SELECT frame, 'L2', least(a::VARCHAR, c::VARCHAR) || '|' || mid || '|' || greatest(a::VARCHAR, c::VARCHAR) FROM pivots),
asked AS (
  SELECT p.frame, p.a::VARCHAR AS a, p.mid::VARCHAR AS b, p.c::VARCHAR AS c, CASE m.status WHEN 'moving' THEN 0 WHEN 'parked' THEN 1 ELSE 2 END AS ord
  FROM pivots p JOIN nodes m ON m.id = p.mid JOIN nodes x ON x.id = p.a JOIN nodes y ON y.id = p.c WHERE x.status = m.status AND y.status = m.status),
hits AS (
  SELECT frame, ord, 'L0' AS level, unnest([a, b, c]) AS key FROM asked
  UNION ALL SELECT frame, ord, 'L1', unnest([least(a, b) || '|' || greatest(a, b), least(b, c) || '|' || greatest(b, c)]) FROM asked
  UNION ALL SELECT frame, ord, 'L2', least(a, c) || '|' || b || '|' || greatest(a, c) FROM asked)"""


def _asked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stand-in for answered questions: the paths whose three nodes share a status, one round of questions for each status."""
    same = edges.where("src_status = dst_status")
    ends = lambda p, q: same.select("frame", F.col("src_status").alias("status"), F.col(p).alias("b"), F.col(q).alias("end"))
    near = ends("src", "dst").unionByName(ends("dst", "src")).distinct()
    # the status is part of the key, so paths of mixed status never arise
    paths = near.withColumnRenamed("end", "a").join(near.withColumnRenamed("end", "c"), ["frame", "status", "b"]).where("a < c")
    order = F.array_position(F.array(*[F.lit(x) for x in STATUSES]), F.col("status")) - 1
    text = lambda c: F.col(c).cast("string")
    return paths.select("frame", order.alias("ord"), F.concat_ws("|", "a", "b", "c").alias("qid"), text("a").alias("a"), text("b").alias("b"), text("c").alias("c"))


def scene_edges(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return e.select("frame", "src", "dst", F.round("dist", 6).alias("dist"), F.round("angle", 6).alias("angle"), "dir4", "dir6", "dir8", "level")


def scene_ttc(spark, sf_dir):
    return edges_of(spark, sf_dir).where("ttc is not null").groupBy("src_type").agg(F.count("*").alias("n"), F.round(F.min("ttc"), 6).alias("least"))


def scene_filter(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    d = G.distance(F.col("x"), F.col("y"))
    reason = graph.removal_reason(F.col("type"), d * 3, F.col("visibility"), graph.pixel_height(F.col("height"), d * 3))
    return n.groupBy("frame", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def scene_induced(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    kept = n.where((F.col("visibility") >= 0.4) | F.col("visibility").isNull())
    return graph.induced_edges(graph.build_edges(n, REACH), kept).groupBy("frame").agg(F.count("*").alias("n"))


def scene_two_hop(spark, sf_dir):
    return graph.two_hop_paths(edges_of(spark, sf_dir)).groupBy("frame", "b").agg(F.count("*").alias("paths"))


def scene_pivots(spark, sf_dir):
    """The flagship: two-hop paths by the type of their pivot."""
    n = nodes_of(spark, sf_dir)
    paths = graph.pivot_universe(graph.build_edges(n, REACH))
    return paths.join(n.select("frame", F.col("id").alias("pivot"), "type"), ["frame", "pivot"]).groupBy("type").agg(F.count("*").alias("paths"))


def scene_motifs(spark, sf_dir):
    return graph.degree_motifs(edges_of(spark, sf_dir).where("dir4 = 'front'"))


def scene_signature(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    return graph.graph_signature(n, graph.build_edges(n, REACH))


def scene_siblings(spark, sf_dir):
    return graph.siblings(edges_of(spark, sf_dir)).groupBy("siblings").agg(F.count("*").alias("n"))


def scene_converge(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    pairs = graph.undirected(e.where("dir4 = 'front'")).where("node < other").select("frame", F.col("node").alias("a"), F.col("other").alias("c"))
    return graph.converging(e, pairs).groupBy("dir_a", "dir_c").agg(F.count("*").alias("n"))


def scene_nearest(spark, sf_dir):
    n = nodes_of(spark, sf_dir).select("frame", "id", "type", "x", "y")
    got = graph.nearest_within(n.where("type in ('pedestrian','bicycle')"), n.where("type in ('car','truck','bus')"), 8.0, ["frame"])
    return got.select("frame", "id", "other", F.round("dist", 6).alias("dist"))


def scene_heat_map(spark, sf_dir):
    return edges_of(spark, sf_dir).groupBy("level").pivot("dir4", list(G.DIR4)).count().fillna(0).select("level", *G.DIR4)


def scene_groupings(spark, sf_dir):
    return edges_of(spark, sf_dir).cube("src_type", "dir4").agg(F.count("*").alias("n"))


def scene_loose(spark, sf_dir):
    return edges_of(spark, sf_dir).select(F.explode(G.loose_directions(F.col("angle"))).alias("direction")).groupBy("direction").agg(F.count("*").alias("n"))


def scene_sides(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    n = nodes_of(spark, sf_dir)
    a, b, c = (graph.prefixed(n.select("frame", "id", "x", "y"), p) for p in ("a_", "b_", "c_"))
    p = graph.pivot_universe(e).join(a, (F.col("frame") == F.col("a_frame")) & (F.col("a") == F.col("a_id"))).join(b, (F.col("frame") == F.col("b_frame")) & (F.col("pivot") == F.col("b_id"))).join(c, (F.col("frame") == F.col("c_frame")) & (F.col("c") == F.col("c_id")))
    side = G.side_of(*[F.col(k) for k in ("a_x", "a_y", "b_x", "b_y", "c_x", "c_y")])
    return p.groupBy(F.coalesce(side, F.lit("none")).alias("side")).agg(F.count("*").alias("n"))


def coverage_totals(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return coverage.coverage_stats(coverage.universe(nodes_of(spark, sf_dir), e), coverage.cascade(_asked(nodes_of(spark, sf_dir), e)))


def coverage_gaps(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return coverage.uncovered(coverage.universe(nodes_of(spark, sf_dir), e), coverage.cascade(_asked(nodes_of(spark, sf_dir), e))).groupBy("frame", "level").agg(F.count("*").alias("n"))


def coverage_curve(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return coverage.coverage_curve(coverage.universe(nodes_of(spark, sf_dir), e), coverage.cascade(_asked(nodes_of(spark, sf_dir), e)))


def gap_ranks(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    gaps = graph.pivot_universe(e).select("frame", text("a").alias("a"), text("pivot").alias("b"), text("c").alias("c"))
    n = coverage.new_counts(gaps, coverage.cascade(_asked(nodes_of(spark, sf_dir), e).where("ord = 0")))
    c = F.col
    return n.groupBy(coverage.gap_tier(c("new_l0"), c("new_l1")).alias("tier"), coverage.gap_level(c("new_l0"), c("new_l1"), c("new_l2")).alias("level"), coverage.gap_score(c("new_l0"), c("new_l1")).alias("score")).agg(F.count("*").alias("n"))


def question_footprint(spark, sf_dir):
    e = edges_of(spark, sf_dir).where("dir4 = 'front'").select(F.concat_ws(":", "frame", "src_type").alias("qid"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return coverage.question_footprint(e).groupBy("qid", "level").agg(F.count("*").alias("n"))


def unique_methods(spark, sf_dir):
    u = constraints.uniqueness(edges_of(spark, sf_dir))
    return u.groupBy("method").agg(F.count("*").alias("n"), *[F.count_if(f"unique_{m}").alias(f"by_{m}") for m, _ in constraints.METHODS])


def two_references(spark, sf_dir):
    return constraints.two_references(edges_of(spark, sf_dir))


def _views(spark, sf_dir):
    e = edges_of(spark, sf_dir).select("frame", "src", "dst", "dst_type", "dir6")
    target = e.select("frame", F.col("src").alias("ref"), F.col("dst").alias("target"), F.col("dst_type").alias("t"), F.col("dir6").alias("d"))
    peers = nodes_of(spark, sf_dir).select("frame", F.col("id").alias("candidate"), F.col("type").alias("t"))
    seen = e.select("frame", F.col("src").alias("ref"), F.col("dst").alias("candidate"), F.col("dir6").alias("seen"))
    views = target.join(peers, ["frame", "t"]).where("ref <> candidate").join(seen, ["frame", "ref", "candidate"], "left").withColumn("agrees", F.coalesce(F.col("seen") == F.col("d"), F.lit(False)))
    return views.select("frame", "target", "ref", "candidate", "agrees")


def greedy_references(spark, sf_dir):
    return constraints.greedy_references(_views(spark, sf_dir))


def plan_alternatives(spark, sf_dir):
    return constraints.plan_alternatives(_views(spark, sf_dir))


def greedy_gaps(spark, sf_dir):
    p = graph.pivot_universe(edges_of(spark, sf_dir, 8.0))
    text = lambda c: F.col(c).cast("string")
    return constraints.select_gaps(p.select("frame", graph.path_key(text("a"), text("pivot"), text("c")).alias("key"), text("a").alias("a"), text("pivot").alias("b"), text("c").alias("c")), 10)


def vector_neighbours(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    return spatial.nearest_vectors(n, n, 3).select("query", "id", F.round("cosine", 6).alias("cosine"), "rank")


CAR, PED = patterns.Obj("car"), patterns.Obj("pedestrian")
AHEAD = patterns.Obj(None, None, None, (patterns.Relation(CAR, "front"),))
BOTH = patterns.Obj("pedestrian", None, None, (patterns.Relation(CAR, "front", "dir4"), patterns.Relation(patterns.Obj("truck"), "back", "dir4")))
CHAIN = patterns.Obj(None, None, None, (patterns.Relation(patterns.Obj("bus", None, None, (patterns.Relation(CAR, "front", "dir4"),)), "left", "dir4"),))


def _graph(spark, sf_dir):
    return nodes_of(spark, sf_dir), edges_of(spark, sf_dir)


def ask_exist(spark, sf_dir):
    return patterns.exist_query(*_graph(spark, sf_dir), AHEAD)


def ask_count(spark, sf_dir):
    return patterns.count_query(*_graph(spark, sf_dir), AHEAD)


def ask_count_rows(spark, sf_dir):
    return patterns.count_query(*_graph(spark, sf_dir), AHEAD, distinct=False)


def ask_both_directions(spark, sf_dir):
    return patterns.count_query(*_graph(spark, sf_dir), BOTH)


def ask_chain(spark, sf_dir):
    return patterns.count_query(*_graph(spark, sf_dir), CHAIN)


def ask_status(spark, sf_dir):
    return patterns.first_query(*_graph(spark, sf_dir), AHEAD, "status")


def ask_object(spark, sf_dir):
    return patterns.first_query(*_graph(spark, sf_dir), AHEAD, "type")


def ask_comparison(spark, sf_dir):
    return patterns.comparison_query(*_graph(spark, sf_dir), CAR, PED)


def ask_same_status(spark, sf_dir):
    return patterns.same_status_query(*_graph(spark, sf_dir), CAR, "truck")


def ask_other_type_same_status(spark, sf_dir):
    return patterns.same_status_query(*_graph(spark, sf_dir), CAR, other_type=True)


def ask_more(spark, sf_dir):
    return patterns.count_comparison(*_graph(spark, sf_dir), CAR, PED)


def ask_nearest(spark, sf_dir):
    return patterns.extreme_query(*_graph(spark, sf_dir), CAR, "status")


def ask_farthest(spark, sf_dir):
    return patterns.extreme_query(*_graph(spark, sf_dir), CAR, "id", farthest=True)


def ask_types(spark, sf_dir):
    return patterns.types_present(nodes_of(spark, sf_dir))


def ask_between(spark, sf_dir):
    return patterns.between_query(nodes_of(spark, sf_dir), 0, 1, "car")


def ask_verified(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return patterns.verify_unique(patterns.matches(n, e, AHEAD), n.where("type = 'bus'").groupBy("frame").agg(F.min("id").alias("id")))


def ask_approaching(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    return n.where(G.is_approaching(*[F.col(c) for c in ("x", "y", "vx", "vy")])).groupBy("frame").agg(F.count("*").alias("n"))


ASK = kinds.Ask(type="car", type2="truck", status="moving", status2="parked", direction="front", direction2="back", ref=CAR, ref2=PED, ego=patterns.Obj("bus"), one=patterns.Obj("trailer"), two=PED, within=8.0)


def _kind(name: str):
    def ask(spark, sf_dir):
        return kinds.answer(name, *_graph(spark, sf_dir), ASK)

    ask.__name__ = f"kind_{name}"
    return ask


def rank_labels(spark, sf_dir):
    """How often each distance rank among the targets of one type occurs."""
    u = edges_of(spark, sf_dir)
    kind = Window.partitionBy("frame", "src", "dst_type")
    ranked = u.select(F.row_number().over(kind.orderBy("dist", "dst")).alias("r"), F.count("*").over(kind).alias("k"))
    return ranked.groupBy(constraints.rank_label(F.col("r"), F.col("k")).alias("label")).agg(F.count("*").alias("n"))


def signature_clusters(spark, sf_dir):
    """Frames by the set of (type, direction) that they show."""
    e = edges_of(spark, sf_dir)
    signature = e.groupBy("frame").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("-", "dst_type", "dir4"))), "|").alias("signature"))
    return signature.groupBy("signature").agg(F.count("*").alias("n"))


def generated_questions(spark, sf_dir):
    return generate.generated_questions(nodes_of(spark, sf_dir)).groupBy("kind", "answer").agg(F.count("*").alias("n"))


def camera_counts(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    return relational.frequency(n.select(F.explode(generate.cameras_of(F.degrees(F.atan2("y", "x")))).alias("camera"), "type"), "camera", "type")


_FRAMES = ", frames AS (SELECT DISTINCT frame FROM nodes)"
_AHEAD = EDGES + _FRAMES + ", ahead AS (SELECT e.frame, n.id, n.type, n.status FROM edges e JOIN nodes n ON n.frame = e.frame AND n.id = e.dst WHERE e.src_type = 'car' AND e.dir6 = 'front')"

QUERIES = {
    f.__name__: f
    for f in (
        scene_edges, scene_ttc, scene_filter, scene_induced, scene_two_hop, scene_pivots, scene_motifs, scene_signature, scene_siblings, scene_converge, scene_nearest, scene_heat_map, scene_groupings,
        scene_loose, scene_sides, coverage_totals, coverage_gaps, coverage_curve, gap_ranks, question_footprint, unique_methods, two_references, greedy_references, plan_alternatives, greedy_gaps, vector_neighbours, ask_exist, ask_count,
        ask_count_rows, ask_both_directions, ask_chain, ask_status, ask_object, ask_comparison, ask_same_status, ask_other_type_same_status, ask_more, ask_nearest, ask_farthest, ask_types, ask_between, ask_verified, ask_approaching, rank_labels, signature_clusters, generated_questions, camera_counts,
        *(_kind(k) for k in ("exists_direction_from_ref", "count_status_type", "count_within_distance", "compare_count_two_types_which", "compare_nearest_farthest_status", "is_facing_ego", "count_approaching", "distance_to_nearest_type")),
    )
}

ORACLE = {
    "scene_edges": f"WITH {EDGES} SELECT frame, src, dst, round(dist, 6) AS dist, round(angle, 6) AS angle, dir4, dir6, dir8, level FROM edges",
    "scene_ttc": f"WITH {EDGES}, t AS (SELECT src_type, dist / (-(dx * dvx + dy * dvy) / dist) AS ttc FROM edges WHERE dist > 0.1 AND -(dx * dvx + dy * dvy) / dist > 0.1) SELECT src_type, count(*) AS n, round(min(ttc), 6) AS least FROM t GROUP BY 1",
    "scene_filter": f"""WITH {NODES}, d AS (SELECT *, 3 * sqrt(x * x + y * y) AS d FROM nodes) SELECT frame, CASE
        WHEN d > CASE WHEN type IN ('pedestrian', 'motorcycle', 'bicycle') THEN 40 WHEN type IN ('traffic_cone', 'barrier') THEN 30 ELSE 50 END THEN 'distance'
        WHEN visibility < 0.4 THEN 'visibility' WHEN height * 1266.0 / greatest(d, 1) < 10 THEN 'pixels' ELSE 'kept' END AS reason, count(*) AS n FROM d GROUP BY 1, 2""",
    "scene_induced": f"WITH {EDGES}, k AS (SELECT id FROM nodes WHERE visibility >= 0.4 OR visibility IS NULL) SELECT frame, count(*) AS n FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY 1",
    "scene_two_hop": f"WITH {EDGES}, p AS (SELECT DISTINCT e.frame, e.src AS a, e.dst AS b, f.dst AS c FROM edges e JOIN edges f ON e.frame = f.frame AND e.dst = f.src AND e.src < f.dst) SELECT frame, b, count(*) AS paths FROM p GROUP BY 1, 2",
    "scene_pivots": f"WITH {UNIVERSE} SELECT type, count(*) AS paths FROM pivots p JOIN nodes n ON n.frame = p.frame AND n.id = p.mid GROUP BY 1",
    "scene_motifs": f"""WITH {EDGES}, f AS (SELECT * FROM edges WHERE dir4 = 'front'), o AS (SELECT frame, src AS n, count(*) AS o FROM f GROUP BY 1, 2), i AS (SELECT frame, dst AS n, count(*) AS i FROM f GROUP BY 1, 2),
        b AS (SELECT coalesce(o.frame, i.frame) AS frame, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM o FULL JOIN i ON o.frame = i.frame AND o.n = i.n)
        SELECT frame, sum(o * (o - 1) // 2)::BIGINT AS forks, sum(i * (i - 1) // 2)::BIGINT AS converges, sum(o * i)::BIGINT AS chains FROM b GROUP BY 1""",
    "scene_signature": f"""WITH {EDGES}, t AS (SELECT frame, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT frame, type || ':' || count(*) AS x FROM nodes GROUP BY frame, type) GROUP BY 1),
        d AS (SELECT frame, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT frame, dir4 || ':' || count(*) AS x FROM edges GROUP BY frame, dir4) GROUP BY 1)
        SELECT t.frame, t.s || '#' || coalesce(d.s, '') AS signature FROM t LEFT JOIN d ON t.frame = d.frame""",
    "scene_siblings": f"WITH {EDGES} SELECT siblings, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY frame, src, dst_type, dir8) AS siblings FROM edges) GROUP BY 1",
    "scene_converge": f"""WITH {EDGES}, p AS (SELECT DISTINCT frame, least(src, dst) AS a, greatest(src, dst) AS c FROM edges WHERE dir4 = 'front')
        SELECT l.dir6 AS dir_a, r.dir6 AS dir_c, count(*) AS n FROM p JOIN edges l ON l.frame = p.frame AND l.src = p.a JOIN edges r ON r.frame = p.frame AND r.src = p.c AND r.dst = l.dst GROUP BY 1, 2""",
    "scene_nearest": f"""WITH {NODES}, m AS (SELECT a.frame, a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM nodes a JOIN nodes b ON a.frame = b.frame
        WHERE a.type IN ('pedestrian', 'bicycle') AND b.type IN ('car', 'truck', 'bus')) SELECT frame, id, other, round(dist, 6) AS dist FROM m WHERE dist < 8 QUALIFY row_number() OVER (PARTITION BY frame, id ORDER BY dist, other) = 1""",
    "scene_heat_map": f"WITH {EDGES} SELECT level, count(*) FILTER (dir4 = 'front') AS front, count(*) FILTER (dir4 = 'left') AS \"left\", count(*) FILTER (dir4 = 'back') AS back, count(*) FILTER (dir4 = 'right') AS \"right\" FROM edges GROUP BY 1",
    "scene_groupings": f"WITH {EDGES} SELECT src_type, dir4, count(*) AS n FROM edges GROUP BY CUBE (src_type, dir4)",
    "scene_loose": f"""WITH {EDGES}, l(direction, c, h) AS (VALUES ('front', 0, 90), ('left', 90, 90), ('back', 180, 90), ('right', -90, 90), ('front_left', 45, 45), ('back_left', 135, 45), ('back_right', -135, 45), ('front_right', -45, 45))
        SELECT direction, count(*) AS n FROM edges, l WHERE abs(((angle - c + 180) % 360 + 360) % 360 - 180) <= h GROUP BY 1""",
    "scene_sides": f"""WITH {UNIVERSE}, o AS (SELECT ((degrees(atan2(c.y - a.y, c.x - a.x)) - degrees(atan2(b.y - a.y, b.x - a.x)) + 180) % 360 + 360) % 360 - 180 AS off
        FROM pivots p JOIN nodes a ON a.id = p.a JOIN nodes b ON b.id = p.mid JOIN nodes c ON c.id = p.c)
        SELECT CASE WHEN abs(off) > 10 AND abs(off) < 170 AND off > 0 THEN 'left' WHEN abs(off) > 10 AND abs(off) < 170 THEN 'right' ELSE 'none' END AS side, count(*) AS n FROM o GROUP BY 1""",
    "coverage_totals": f"""WITH {UNIVERSE}, s AS (SELECT DISTINCT frame, level, key FROM hits) SELECT u.level, count(*) AS total, count(s.key) AS covered, count(*) - count(s.key) AS gap, round(count(s.key) * 100.0 / count(*), 2) AS rate
        FROM universe u LEFT JOIN s ON u.frame = s.frame AND u.level = s.level AND u.key = s.key GROUP BY 1""",
    "coverage_gaps": f"WITH {UNIVERSE} SELECT frame, level, count(*) AS n FROM (SELECT frame, level, key FROM universe EXCEPT SELECT frame, level, key FROM hits) GROUP BY 1, 2",
    "coverage_curve": f"""WITH {UNIVERSE}, f AS (SELECT h.frame, h.level, h.key, min(ord) AS ord FROM hits h JOIN universe u ON u.frame = h.frame AND u.level = h.level AND u.key = h.key GROUP BY 1, 2, 3),
        n AS (SELECT frame, level, ord, count(*) AS k FROM f GROUP BY 1, 2, 3), s AS (SELECT DISTINCT frame, level, ord FROM hits), t AS (SELECT frame, level, count(*) AS total FROM universe GROUP BY 1, 2)
        SELECT frame, level, ord, coalesce(k, 0) AS new_keys, (sum(coalesce(k, 0)) OVER (PARTITION BY frame, level ORDER BY ord))::BIGINT AS covered, round(sum(coalesce(k, 0)) OVER (PARTITION BY frame, level ORDER BY ord) / total, 6) AS rate
        FROM s LEFT JOIN n USING (frame, level, ord) JOIN t USING (frame, level)""",
    "gap_ranks": f"""WITH {UNIVERSE}, s AS (SELECT DISTINCT frame, level, key FROM hits WHERE ord = 0), g AS (SELECT frame, a::VARCHAR AS a, mid::VARCHAR AS b, c::VARCHAR AS c FROM pivots),
        parts AS (SELECT frame, a || '|' || b || '|' || c AS q, 'L0' AS level, unnest([a, b, c]) AS key FROM g
          UNION ALL SELECT frame, a || '|' || b || '|' || c, 'L1', unnest([least(a, b) || '|' || greatest(a, b), least(b, c) || '|' || greatest(b, c)]) FROM g
          UNION ALL SELECT frame, a || '|' || b || '|' || c, 'L2', least(a, c) || '|' || b || '|' || greatest(a, c) FROM g),
        m AS (SELECT p.frame, q, count(*) FILTER (p.level = 'L0' AND s.key IS NULL) AS n0, count(*) FILTER (p.level = 'L1' AND s.key IS NULL) AS n1, count(*) FILTER (p.level = 'L2' AND s.key IS NULL) AS n2
          FROM parts p LEFT JOIN s ON s.frame = p.frame AND s.level = p.level AND s.key = p.key GROUP BY 1, 2)
        SELECT CASE WHEN n0 >= 2 AND n1 >= 2 THEN 5 WHEN n0 >= 1 AND n1 >= 2 THEN 4 WHEN n1 >= 2 THEN 3 WHEN n0 >= 1 AND n1 >= 1 THEN 2 WHEN n1 >= 1 THEN 1 ELSE 0 END AS tier,
          CASE WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 WHEN n0 > 0 THEN 0 ELSE -1 END AS level, 100 * n0 + 10 * n1 + 1 AS score, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "question_footprint": f"""WITH {EDGES}, e AS (SELECT frame || ':' || src_type AS qid, src::VARCHAR AS s, dst::VARCHAR AS d FROM edges WHERE dir4 = 'front'), near AS (SELECT qid, s AS n, d AS o FROM e UNION SELECT qid, d, s FROM e),
        f AS (SELECT qid, 'L0' AS level, n AS key FROM near UNION SELECT qid, 'L1', least(n, o) || '|' || greatest(n, o) FROM near UNION SELECT p.qid, 'L2', p.o || '|' || p.n || '|' || q.o FROM near p JOIN near q ON p.qid = q.qid AND p.n = q.n AND p.o < q.o)
        SELECT qid, level, count(*) AS n FROM f GROUP BY 1, 2""",
    "unique_methods": f"""WITH {EDGES}, u AS (SELECT count(*) OVER (PARTITION BY frame, src, dst_type) = 1 AS a, count(*) OVER (PARTITION BY frame, src, dst_type, dst_status) = 1 AS b, count(*) OVER (PARTITION BY frame, src, dir8) = 1 AS c,
          count(*) OVER (PARTITION BY frame, src, dst_type, level) = 1 AS d, count(*) OVER (PARTITION BY frame, src, dst_type, dir8, level) = 1 AS e, count(*) OVER (PARTITION BY frame, src, dst_type, dst_status, dir8, level) = 1 AS f,
          count(*) OVER (PARTITION BY frame, src, dst_type, dist) = 1 AND dist = min(dist) OVER (PARTITION BY frame, src, dst_type) AS lo, count(*) OVER (PARTITION BY frame, src, dst_type, dist) = 1 AND dist = max(dist) OVER (PARTITION BY frame, src, dst_type) AS hi FROM edges)
        SELECT CASE WHEN a THEN 'type' WHEN b THEN 'type_status' WHEN c THEN 'direction' WHEN d THEN 'type_level' WHEN e THEN 'type_direction_level' WHEN f THEN 'all' WHEN lo THEN 'nearest' WHEN hi THEN 'farthest' ELSE 'ordinal' END AS method,
          count(*) AS n, count(*) FILTER (a) AS by_type, count(*) FILTER (b) AS by_type_status, count(*) FILTER (c) AS by_direction, count(*) FILTER (d) AS by_type_level, count(*) FILTER (e) AS by_type_direction_level, count(*) FILTER (f) AS by_all FROM u GROUP BY 1""",
    "two_references": f"""WITH {EDGES}, v AS (SELECT frame, src, dst, dst_type AS t, dir6 AS d, count(*) OVER (PARTITION BY frame, src, dst_type, dir6) AS n FROM edges), h AS (SELECT * FROM v WHERE n > 1),
        p AS (SELECT a.frame, a.dst, a.src AS s1, a.t, a.d AS d1, b.src AS s2, b.d AS d2 FROM h a JOIN h b ON a.frame = b.frame AND a.dst = b.dst AND a.src < b.src),
        c AS (SELECT p.frame, p.dst, p.s1, p.s2, count(*) AS n FROM p JOIN v x ON x.frame = p.frame AND x.src = s1 AND x.t = p.t AND x.d = d1 JOIN v y ON y.frame = p.frame AND y.src = s2 AND y.t = p.t AND y.d = d2 AND y.dst = x.dst GROUP BY 1, 2, 3, 4)
        SELECT frame, dst, count(*) AS refs FROM c WHERE n = 1 GROUP BY 1, 2""",
    "vector_neighbours": f"""WITH {NODES}, m AS (SELECT q.id AS query, v.id, list_sum(list_transform(list_zip(q.vec, v.vec), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(q.vec, lambda z: z::DOUBLE * z::DOUBLE)) * list_sum(list_transform(v.vec, lambda z: z::DOUBLE * z::DOUBLE))) AS cosine
        FROM nodes q JOIN nodes v ON q.frame = v.frame AND q.id <> v.id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM m) SELECT query, id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 3""",
    "ask_exist": f"WITH {_AHEAD} SELECT frame, CASE WHEN frame IN (SELECT frame FROM ahead) THEN 'yes' ELSE 'no' END AS answer FROM frames",
    "ask_count": f"WITH {_AHEAD} SELECT f.frame, count(DISTINCT id) AS answer FROM frames f LEFT JOIN ahead a ON a.frame = f.frame GROUP BY 1",
    "ask_count_rows": f"WITH {_AHEAD} SELECT f.frame, count(id) AS answer FROM frames f LEFT JOIN ahead a ON a.frame = f.frame GROUP BY 1",
    "ask_both_directions": f"""WITH {EDGES}{_FRAMES}, m AS (SELECT e.frame, e.dst FROM edges e JOIN edges g ON e.frame = g.frame AND e.dst = g.dst WHERE e.dst_type = 'pedestrian' AND e.src_type = 'car' AND e.dir4 = 'front' AND g.src_type = 'truck' AND g.dir4 = 'back')
        SELECT f.frame, count(DISTINCT dst) AS answer FROM frames f LEFT JOIN m ON m.frame = f.frame GROUP BY 1""",
    "ask_chain": f"""WITH {EDGES}{_FRAMES}, m AS (SELECT g.frame, g.dst FROM edges e JOIN edges g ON e.frame = g.frame AND e.dst = g.src WHERE e.src_type = 'car' AND e.dst_type = 'bus' AND e.dir4 = 'front' AND g.dir4 = 'left')
        SELECT f.frame, count(DISTINCT dst) AS answer FROM frames f LEFT JOIN m ON m.frame = f.frame GROUP BY 1""",
    "ask_status": f"WITH {_AHEAD} SELECT f.frame, arg_min(status, id) AS answer FROM frames f LEFT JOIN ahead a ON a.frame = f.frame GROUP BY 1",
    "ask_object": f"WITH {_AHEAD} SELECT f.frame, arg_min(type, id) AS answer FROM frames f LEFT JOIN ahead a ON a.frame = f.frame GROUP BY 1",
    "ask_comparison": f"WITH {NODES}{_FRAMES} SELECT frame, CASE WHEN EXISTS (SELECT 1 FROM nodes a JOIN nodes b ON a.frame = b.frame AND a.status = b.status WHERE a.frame = f.frame AND a.type = 'car' AND b.type = 'pedestrian') THEN 'yes' ELSE 'no' END AS answer FROM frames f",
    "ask_same_status": f"WITH {NODES}{_FRAMES}, r AS (SELECT frame, min(id) AS id, arg_min(status, id) AS status FROM nodes WHERE type = 'car' GROUP BY 1) SELECT f.frame, count(n.id) AS answer FROM frames f LEFT JOIN r ON r.frame = f.frame LEFT JOIN nodes n ON n.frame = f.frame AND n.status = r.status AND n.id <> r.id AND n.type = 'truck' GROUP BY 1",
    "ask_other_type_same_status": f"WITH {NODES}{_FRAMES}, r AS (SELECT frame, min(id) AS id, arg_min(status, id) AS status FROM nodes WHERE type = 'car' GROUP BY 1) SELECT f.frame, count(n.id) AS answer FROM frames f LEFT JOIN r ON r.frame = f.frame LEFT JOIN nodes n ON n.frame = f.frame AND n.status = r.status AND n.type <> 'car' GROUP BY 1",
    "ask_more": f"WITH {NODES} SELECT frame, count(*) FILTER (type = 'car') AS \"first\", count(*) FILTER (type = 'pedestrian') AS \"second\", CASE WHEN count(*) FILTER (type = 'pedestrian') > count(*) FILTER (type = 'car') THEN 'second' ELSE 'first' END AS answer FROM nodes GROUP BY 1",
    "ask_nearest": f"WITH {NODES}{_FRAMES}, m AS (SELECT frame, status FROM nodes WHERE type = 'car' QUALIFY row_number() OVER (PARTITION BY frame ORDER BY sqrt(x * x + y * y), id) = 1) SELECT f.frame, status AS answer FROM frames f LEFT JOIN m ON m.frame = f.frame",
    "ask_farthest": f"WITH {NODES}{_FRAMES}, m AS (SELECT frame, id FROM nodes WHERE type = 'car' QUALIFY row_number() OVER (PARTITION BY frame ORDER BY sqrt(x * x + y * y) DESC, id) = 1) SELECT f.frame, id AS answer FROM frames f LEFT JOIN m ON m.frame = f.frame",
    "ask_types": f"WITH {NODES} SELECT frame, count(DISTINCT type) AS n_types, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM nodes GROUP BY 1",
    "ask_between": f"""WITH {NODES}{_FRAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS k FROM nodes), c AS (SELECT a.frame, a.id AS ai, b.id AS bi, (a.x + b.x) / 2 AS cx, (a.y + b.y) / 2 AS cy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2 AS r FROM k a JOIN k b ON a.frame = b.frame WHERE a.k = 0 AND b.k = 1),
        h AS (SELECT DISTINCT n.frame FROM nodes n JOIN c ON n.frame = c.frame WHERE type = 'car' AND r >= 0.1 AND id NOT IN (ai, bi) AND sqrt((x - cx) ** 2 + (y - cy) ** 2) <= r) SELECT frame, CASE WHEN frame IN (SELECT frame FROM h) THEN 'yes' ELSE 'no' END AS answer FROM frames""",
    "ask_verified": f"""WITH {_AHEAD}, x AS (SELECT frame, min(id) AS id FROM nodes WHERE type = 'bus' GROUP BY 1), g AS (SELECT frame, count(DISTINCT id) AS n, min(id) AS i FROM ahead GROUP BY 1)
        SELECT x.frame, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n > 1 THEN 'many' WHEN i <> x.id THEN 'wrong' ELSE 'ok' END AS verdict FROM x LEFT JOIN g ON g.frame = x.frame""",
    "ask_approaching": f"WITH {NODES} SELECT frame, count(*) AS n FROM nodes WHERE -(x * vx + y * vy) > 0 GROUP BY 1",
    "rank_labels": f"""WITH {EDGES}, r AS (SELECT row_number() OVER (PARTITION BY frame, src, dst_type ORDER BY dist, dst) AS r, count(*) OVER (PARTITION BY frame, src, dst_type) AS k FROM edges)
        SELECT CASE WHEN r = 1 THEN 'nearest' WHEN r = k THEN 'farthest' WHEN r = 2 THEN '2nd-nearest' WHEN r = k - 1 THEN '2nd-farthest' ELSE r || '-th' END AS label, count(*) AS n FROM r GROUP BY 1""",
    "signature_clusters": f"WITH {EDGES}, s AS (SELECT frame, string_agg(DISTINCT dst_type || '-' || dir4, '|' ORDER BY dst_type || '-' || dir4) AS signature FROM edges GROUP BY 1) SELECT signature, count(*) AS n FROM s GROUP BY 1",
    "generated_questions": f"""WITH {NODES}, a AS (SELECT *, sqrt(x * x + y * y) AS d, degrees(atan2(y, x)) AS b FROM nodes), q AS (
        SELECT 'distance' AS kind, CASE WHEN d < 2 THEN 'very_close' WHEN d < 10 THEN 'close' WHEN d < 30 THEN 'medium' ELSE 'far' END AS answer FROM a
        UNION ALL SELECT 'sector', (['front','front_left','left','back_left','back','back_right','right','front_right'])[((ceil(((b + 22.5 + 360) % 360) / 45))::INT + 7) % 8 + 1] FROM a
        UNION ALL SELECT 'moving', CASE WHEN status = 'moving' THEN 'yes' ELSE 'no' END FROM a UNION ALL SELECT 'approach', CASE WHEN -(x * vx + y * vy) > 0 THEN 'yes' ELSE 'no' END FROM a
        UNION ALL SELECT 'count', least(count(*) FILTER (abs(b) <= 45), 5)::VARCHAR FROM a GROUP BY frame) SELECT kind, answer, count(*) AS n FROM q GROUP BY 1, 2""",
    "camera_counts": f"""WITH {NODES}, b AS (SELECT type, degrees(atan2(y, x)) AS b FROM nodes), c(camera, lo, hi) AS (VALUES ('front', -30, 30), ('front_left', 30, 90), ('back_left', 90, 150), ('back', 150, -150), ('back_right', -150, -90), ('front_right', -90, -30))
        SELECT camera, type, count(*) AS n FROM b, c WHERE CASE WHEN lo <= hi THEN b BETWEEN lo AND hi ELSE b >= lo OR b <= hi END GROUP BY 1, 2""",
    "kind_exists_direction_from_ref": f"WITH {EDGES}{_FRAMES} SELECT frame, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.frame = f.frame AND src_type = 'car' AND dst_type = 'car' AND dir6 = 'front') THEN 'yes' ELSE 'no' END AS answer FROM frames f",
    "kind_count_status_type": f"WITH {NODES} SELECT frame, (count(*) FILTER (type = 'car' AND status = 'moving'))::VARCHAR AS answer FROM nodes GROUP BY 1",
    "kind_count_within_distance": f"WITH {NODES} SELECT frame, (count(*) FILTER (type = 'car' AND sqrt(x * x + y * y) <= 8))::VARCHAR AS answer FROM nodes GROUP BY 1",
    "kind_compare_count_two_types_which": f"WITH {NODES} SELECT frame, CASE WHEN count(*) FILTER (type = 'truck') > count(*) FILTER (type = 'car') THEN 'second' ELSE 'first' END AS answer FROM nodes GROUP BY 1",
    "kind_compare_nearest_farthest_status": f"""WITH {NODES}{_FRAMES}, m AS (SELECT frame, status, row_number() OVER (PARTITION BY frame ORDER BY sqrt(x * x + y * y), id) AS a, row_number() OVER (PARTITION BY frame ORDER BY sqrt(x * x + y * y) DESC, id) AS b FROM nodes WHERE type = 'car')
        SELECT f.frame, CASE WHEN p.status IS NOT NULL THEN CASE WHEN p.status = q.status THEN 'yes' ELSE 'no' END END AS answer FROM frames f LEFT JOIN m p ON p.frame = f.frame AND p.a = 1 LEFT JOIN m q ON q.frame = f.frame AND q.b = 1""",
    "kind_is_facing_ego": f"WITH {NODES} SELECT frame, CASE WHEN count(*) FILTER (type = 'trailer' AND abs(((yaw - degrees(atan2(-y, -x)) + 180) % 360 + 360) % 360 - 180) <= 45) > 0 THEN 'yes' ELSE 'no' END AS answer FROM nodes GROUP BY 1",
    "kind_count_approaching": f"WITH {NODES} SELECT frame, (count(*) FILTER (type = 'car' AND -(x * vx + y * vy) > 0))::VARCHAR AS answer FROM nodes GROUP BY 1",
    "kind_distance_to_nearest_type": f"WITH {NODES} SELECT frame, round(min(sqrt(x * x + y * y)) FILTER (type = 'car'), 4)::VARCHAR AS answer FROM nodes GROUP BY 1",
}
