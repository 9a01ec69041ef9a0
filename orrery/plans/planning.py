"""Queries that plan questions over the scene graphs of the stand-in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import coverage, graph, planning, questions
from orrery.operators.relational import neighbours

from .scene import EDGES, NODES, TYPES, UNIVERSE, _asked, edges_of, nodes_of


def _marked_edges(spark, sf_dir):
    """Edges with the direction of the target from the first node of its frame, which stands for the own vehicle."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    own = n.groupBy("frame").agg(F.min("id").alias("src"))
    seen = e.join(own, ["frame", "src"]).select("frame", "dst", F.col("dir8").alias("own_dir8"))
    return e.join(seen, ["frame", "dst"], "left").withColumn("own_dir8", F.coalesce("own_dir8", F.lit("none")))


def constraint_methods(spark, sf_dir):
    m = planning.constraint_methods(_marked_edges(spark, sf_dir))
    return m.groupBy("method").agg(F.count("*").alias("n"), *[F.count_if(f"by_{k}").alias(f"by_{k}") for k in planning.ORDER[:12]])


def smallest_subsets(spark, sf_dir):
    return planning.smallest_subsets(planning.constraint_methods(_marked_edges(spark, sf_dir))).groupBy("subset").agg(F.count("*").alias("n"))


def _placed_paths(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    paths = graph.pivot_universe(edges_of(spark, sf_dir)).withColumnRenamed("pivot", "b")
    for p in "abc":
        paths = paths.join(n.select("frame", F.col("id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), F.col("yaw").alias(f"{p}yaw")), ["frame", p])
    return paths


def dry_distance_chain(spark, sf_dir):
    return planning.chain_answers(_placed_paths(spark, sf_dir)).groupBy("frame", F.coalesce("closer", F.lit("ambiguous")).alias("closer")).agg(F.count("*").alias("n"))


def dry_direction_chain(spark, sf_dir):
    return planning.chain_answers(_placed_paths(spark, sf_dir)).groupBy("frame", "same_direction").agg(F.count("*").alias("n"))


def inferred_paths(spark, sf_dir):
    """Paths that the covered pairs of the asked questions imply, and how many of them were not asked."""
    hits = coverage.cascade(_asked(nodes_of(spark, sf_dir), edges_of(spark, sf_dir)))
    pairs = hits.where("level = 'L1'").select("frame", F.split("key", "[|]").alias("k")).select("frame", F.get("k", F.lit(0)).alias("u"), F.get("k", F.lit(1)).alias("v"))
    asked = hits.where("level = 'L2'").select("frame", "key").distinct().withColumn("asked", F.lit(1))
    return planning.inferred_paths(pairs).join(asked, ["frame", "key"], "left").groupBy("frame").agg(F.count("*").alias("paths"), F.count_if(F.col("asked").isNull()).alias("fresh"))


def branch_candidates(spark, sf_dir):
    return planning.branch_candidates(edges_of(spark, sf_dir)).groupBy("dst_type", "branch").agg(F.count("*").alias("n"))


def converge_candidates(spark, sf_dir):
    e = edges_of(spark, sf_dir, 8.0)
    pairs = graph.undirected(e).where("node < other").select("frame", F.col("node").alias("a"), F.col("other").alias("c"))
    return planning.converge_candidates(e, pairs).groupBy("candidates").agg(F.count("*").alias("n"))


def missing_types(spark, sf_dir):
    return planning.missing_types(nodes_of(spark, sf_dir), TYPES)


def type_sets(spark, sf_dir):
    """Whether a frame has all of three types, or any of two."""
    have = nodes_of(spark, sf_dir).groupBy("frame").agg(F.collect_set("type").alias("have"))
    want = lambda *t: F.array(*[F.lit(x) for x in t])
    return have.select("frame", (F.size(F.array_except(want("car", "bus", "truck"), F.col("have"))) == 0).alias("all_of"), F.arrays_overlap(want("trailer", "barrier"), F.col("have")).alias("any_of"))


def _earlier(spark, sf_dir):
    """Stand-in for earlier questions: the asked paths, of which two thirds passed and half name their target."""
    q = _asked(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))
    k = F.col("b").cast("bigint") + F.col("a").cast("bigint")
    return q.select("frame", (k % 3 > 0).alias("passed"), F.concat_ws(" ", F.lit("from"), "a", F.lit("by"), F.when(k % 2 == 0, F.col("b")).otherwise("it"), F.lit("to"), "c").alias("text"), "a", "b", "c")


def restored_coverage(spark, sf_dir):
    return planning.restored(_earlier(spark, sf_dir)).groupBy("frame", "level").agg(F.count("*").alias("n"))


def authentic_rows(spark, sf_dir):
    rows = _earlier(spark, sf_dir).select("frame", F.array("a", "b", "c").alias("ids"), "text", F.array(F.array("a", "c"), F.when(F.col("passed"), F.array("c", "b", "a")).otherwise(F.array("b"))).alias("results"))
    return planning.authentic(rows).groupBy("frame").agg(F.count("*").alias("n"))


def coverage_plateau(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    n = nodes_of(spark, sf_dir)
    return planning.plateau(coverage.coverage_curve(coverage.universe(n, e), coverage.cascade(_asked(n, e))))


def gap_leaders(spark, sf_dir):
    """The three gaps of each frame with the highest score (ties by key), and their tier."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    gaps = graph.pivot_universe(e).select("frame", text("a").alias("a"), text("pivot").alias("b"), text("c").alias("c"))
    c = coverage.new_counts(gaps, coverage.cascade(_asked(n, e).where("ord = 0")))
    scored = c.select("frame", "qid", coverage.gap_score(F.col("new_l0"), F.col("new_l1")).alias("score"), coverage.gap_tier(F.col("new_l0"), F.col("new_l1")).alias("tier"))
    first = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("tier"), F.desc("score"), "qid"))
    return scored.withColumn("rank", first).where("rank <= 3").select("frame", "rank", "qid", "score", "tier")


def type_ordinals(spark, sf_dir):
    """Each node's number among those of its type in the frame."""
    w = Window.partitionBy("frame", "type").orderBy("id")
    return nodes_of(spark, sf_dir).select("frame", "id", F.concat("type", F.row_number().over(w).cast("string")).alias("name"))


def radius_pairs(spark, sf_dir):
    """Pedestrians with how many cars of their frame lie within eight metres: a range join by grid cells."""
    n = nodes_of(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / 8)
    p = n.where("type = 'pedestrian'").select("frame", "id", "x", "y")
    near = p.withColumn("gx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("gy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
    cars = n.where("type = 'car'").select("frame", F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("gx"), cell("y").alias("gy"))
    met = near.join(cars, ["frame", "gx", "gy"]).where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= 8).groupBy("frame", "id").agg(F.count("*").alias("n"))
    return p.select("frame", "id").join(met, ["frame", "id"], "left").fillna(0, ["n"])


def undirected_edges(spark, sf_dir):
    """Unordered pairs within reach in three dimensions, by level of distance."""
    n = nodes_of(spark, sf_dir).withColumn("z", F.get("vec", F.lit(8)).cast("double") * 100)
    a, b = graph.prefixed(n.select("frame", "id", "x", "y", "z"), "a_"), graph.prefixed(n.select("frame", "id", "x", "y", "z"), "b_")
    met = a.join(b, (F.col("a_frame") == F.col("b_frame")) & (F.col("a_id") < F.col("b_id")))
    d = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return met.select(F.col("a_frame").alias("frame"), d.alias("d")).where("d <= 15").groupBy("frame").agg(F.count("*").alias("n"), F.round(F.min("d"), 6).alias("least"))


def lag_two(spark, sf_dir):
    """Change of the speed of the nodes of a frame, in order, over two steps."""
    n = nodes_of(spark, sf_dir).withColumn("speed", F.hypot("vx", "vy"))
    back = F.lag("speed", 2).over(Window.partitionBy("frame").orderBy("id"))
    return neighbours(n, "frame", ["id"], "id").select("frame", "id", "prev_id", F.round(F.col("speed") - back, 6).alias("change"))


QUERIES = {
    f.__name__: f
    for f in (
        constraint_methods, smallest_subsets, dry_distance_chain, dry_direction_chain, inferred_paths, branch_candidates, converge_candidates, missing_types, type_sets, restored_coverage, authentic_rows,
        coverage_plateau, gap_leaders, type_ordinals, radius_pairs, undirected_edges, lag_two,
    )
}

_CELL = "frame, src, dir4"
_MARKED = EDGES + f""", own AS (SELECT frame, min(id) AS me FROM nodes GROUP BY 1), base AS (SELECT e.frame, e.src, e.dst, e.dir4, e.dir8, e.dist, e.level, e.dst_type, e.dst_status, e.src_status, coalesce(o.dir8, 'none') AS own_dir8, list_position(['near', 'mid', 'far'], e.level) AS lr
    FROM edges e JOIN own ON own.frame = e.frame LEFT JOIN edges o ON o.frame = e.frame AND o.src = me AND o.dst = e.dst),
  sib AS (SELECT frame, src AS ref, dst_type, dir8, list(dst) AS ids FROM edges GROUP BY 1, 2, 3, 4),
  refs AS (SELECT e.frame, e.dst, e.src AS ref, s.ids, len(s.ids) AS k, row_number() OVER (PARTITION BY e.frame, e.dst ORDER BY len(s.ids), e.dist, e.src) AS r FROM edges e JOIN sib s ON s.frame = e.frame AND s.ref = e.src AND s.dst_type = e.dst_type AND s.dir8 = e.dir8),
  dual AS (SELECT DISTINCT p.frame, p.dst FROM refs p JOIN refs q ON p.frame = q.frame AND p.dst = q.dst AND p.r < q.r AND q.r <= 6 WHERE len(list_intersect(p.ids, q.ids)) = 1),
  marked AS (SELECT b.*, count(*) OVER (PARTITION BY {_CELL}, dst_type) = 1 AS m_type, count(*) OVER (PARTITION BY {_CELL}, dst_status) = 1 AS m_status, count(*) OVER (PARTITION BY {_CELL}, dst_type, dst_status) = 1 AS m_type_status, count(*) OVER (PARTITION BY {_CELL}, dir8) = 1 AS m_dir8,
    count(*) OVER (PARTITION BY {_CELL}, dir8, own_dir8) = 1 AS m_dual_reference, count(*) OVER (PARTITION BY {_CELL}, dst_type, level) = 1 AS m_type_level, count(*) OVER (PARTITION BY {_CELL}, dst_type, dir8, level) = 1 AS m_type_dir8_level, count(*) OVER (PARTITION BY {_CELL}, dst_type, dir8, dst_status, level) = 1 AS m_all,
    count(*) OVER g > 1 AND count(*) OVER (PARTITION BY {_CELL}, dst_type, dir8, lr) = 1 AND (lr = min(lr) OVER g OR lr = max(lr) OVER g) AS m_level_order, dist > 0 AND count(*) OVER g > 1 AND count(*) OVER (PARTITION BY {_CELL}, dst_type, dir8, dist) = 1 AND (dist = min(dist) OVER g OR dist = max(dist) OVER g) AS m_distance_order,
    EXISTS (SELECT 1 FROM refs r WHERE r.frame = b.frame AND r.dst = b.dst AND r.ref <> b.src AND r.k = 1) AS m_two_hop, EXISTS (SELECT 1 FROM dual d WHERE d.frame = b.frame AND d.dst = b.dst) AS m_dual_hop
    FROM base b WINDOW g AS (PARTITION BY {_CELL}, dst_type, dir8))"""
_FIRST = ("type", "status", "type_status", "dir8", "dual_reference", "level_order", "type_level", "type_dir8_level", "all", "distance_order", "two_hop", "dual_hop")
_PLACED = UNIVERSE + """, paths AS (SELECT p.frame, a.x AS a_x, a.y AS a_y, a.yaw AS a_yaw, b.x AS b_x, b.y AS b_y, b.yaw AS b_yaw, c.x AS c_x, c.y AS c_y FROM pivots p JOIN nodes a ON a.id = p.a JOIN nodes b ON b.id = p.mid JOIN nodes c ON c.id = p.c)"""
_DIR6 = "(['front','front left','back left','back','back right','front right'])[((ceil(((({0} + 30) % 360 + 360) % 360) / 60))::INT + 5) % 6 + 1]"
_LOCAL = "(((degrees(atan2({1}_y - {0}_y, {1}_x - {0}_x)) - {0}_yaw + 180) % 360 + 360) % 360 - 180)"
_WINDOW = "count(*) OVER (PARTITION BY frame, src, dir4, {}) = 1"
_SUBSETS = sorted((s for bits in range(1, 16) if (s := [c for k, c in enumerate(("dst_type", "dst_status", "dir8", "level")) if bits >> k & 1])), key=lambda s: (len(s), [("dst_type", "dst_status", "dir8", "level").index(c) for c in s]))
_WHEN = lambda sizes: " ".join(f"WHEN {_WINDOW.format(', '.join(s))} THEN '{'+'.join(s)}'" for s in _SUBSETS if len(s) in sizes)
_EARLIER = UNIVERSE + """, earlier AS (SELECT frame, a, b, c, (a::BIGINT + b::BIGINT) % 3 > 0 AS passed, 'from ' || a || ' by ' || CASE WHEN (a::BIGINT + b::BIGINT) % 2 = 0 THEN b ELSE 'it' END || ' to ' || c AS text FROM asked)"""

ORACLE = {
    "constraint_methods": f"WITH {_MARKED} SELECT CASE {' '.join(f"WHEN m_{k} THEN '{k}'" for k in _FIRST)} ELSE 'anchor' END AS method, count(*) AS n, {', '.join(f'count(*) FILTER (m_{k}) AS by_{k}' for k in _FIRST)} FROM marked GROUP BY 1",
    "smallest_subsets": f"WITH {_MARKED}, s AS (SELECT CASE {_WHEN((1, 2))} WHEN m_two_hop THEN 'two_hop' {_WHEN((3, 4))} WHEN m_dual_hop THEN 'dual_hop' ELSE 'anchor' END AS subset FROM marked) SELECT subset, count(*) AS n FROM s GROUP BY 1",
    "dry_distance_chain": f"WITH {_PLACED}, d AS (SELECT frame, sqrt((a_x - b_x) ** 2 + (a_y - b_y) ** 2) AS p, sqrt((b_x - c_x) ** 2 + (b_y - c_y) ** 2) AS q FROM paths) SELECT frame, CASE WHEN abs(p - q) < 0.5 THEN 'ambiguous' WHEN p < q THEN 'a' ELSE 'c' END AS closer, count(*) AS n FROM d GROUP BY 1, 2",
    "dry_direction_chain": f"WITH {_PLACED} SELECT frame, {_DIR6.format(_LOCAL.format('a', 'b'))} = {_DIR6.format(_LOCAL.format('b', 'c'))} AS same_direction, count(*) AS n FROM paths GROUP BY 1, 2",
    "inferred_paths": f"""WITH {UNIVERSE}, p AS (SELECT DISTINCT frame, string_split(key, '|') AS k FROM hits WHERE level = 'L1'), b AS (SELECT frame, k[1] AS m, k[2] AS n FROM p UNION SELECT frame, k[2], k[1] FROM p),
        i AS (SELECT x.frame, x.n || '|' || x.m || '|' || y.n AS key FROM b x JOIN b y ON x.frame = y.frame AND x.m = y.m AND x.n < y.n), q AS (SELECT DISTINCT frame, key, 1 AS was FROM hits WHERE level = 'L2')
        SELECT frame, count(*) AS paths, count(*) FILTER (was IS NULL) AS fresh FROM i LEFT JOIN q USING (frame, key) GROUP BY 1""",
    "branch_candidates": f"WITH {EDGES}, b AS (SELECT dst_type, count(*) OVER (PARTITION BY frame, src, dst_type, dir6) AS branch FROM edges) SELECT dst_type, branch, count(*) AS n FROM b GROUP BY 1, 2",
    "converge_candidates": f"""WITH {EDGES}, near AS (SELECT * FROM edges WHERE dist <= 8), p AS (SELECT DISTINCT frame, least(src, dst) AS a, greatest(src, dst) AS c FROM near),
        s AS (SELECT p.frame, p.a, p.c, l.dst AS b, l.dst_type AS kind, l.dir6 AS da, r.dir6 AS dc FROM p JOIN near l ON l.frame = p.frame AND l.src = p.a JOIN near r ON r.frame = p.frame AND r.src = p.c AND r.dst = l.dst),
        k AS (SELECT (SELECT count(*) FROM s t WHERE t.frame = s.frame AND t.a = s.a AND t.c = s.c AND t.kind = s.kind AND t.da = s.da AND t.dc = s.dc) AS candidates FROM s) SELECT candidates, count(*) AS n FROM k GROUP BY 1""",
    "missing_types": f"WITH {NODES}, t AS (SELECT unnest(range(10)) AS i, unnest(['car','truck','bus','trailer','construction_vehicle','pedestrian','motorcycle','bicycle','traffic_cone','barrier']) AS type), f AS (SELECT DISTINCT frame FROM nodes), m AS (SELECT frame, type, i FROM f, t WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.frame = f.frame AND n.type = t.type)) SELECT f.frame, coalesce(string_agg(type, '|' ORDER BY i), '') AS missing FROM f LEFT JOIN m ON m.frame = f.frame GROUP BY 1",
    "type_sets": f"WITH {NODES} SELECT frame, bool_or(type = 'car') AND bool_or(type = 'bus') AND bool_or(type = 'truck') AS all_of, bool_or(type IN ('trailer', 'barrier')) AS any_of FROM nodes GROUP BY 1",
    "restored_coverage": f"""WITH {_EARLIER}, g AS (SELECT * FROM earlier WHERE passed AND contains(text, b)), k AS (SELECT frame, 'L0' AS level, unnest([a, b, c]) AS key FROM g UNION SELECT frame, 'L1', unnest([least(a, b) || '|' || greatest(a, b), least(b, c) || '|' || greatest(b, c)]) FROM g UNION SELECT frame, 'L2', least(a, c) || '|' || b || '|' || greatest(a, c) FROM g)
        SELECT frame, level, count(*) AS n FROM k GROUP BY 1, 2""",
    "authentic_rows": f"WITH {_EARLIER} SELECT frame, count(*) AS n FROM earlier WHERE passed AND contains(text, a) AND contains(text, b) AND contains(text, c) GROUP BY 1",
    "coverage_plateau": f"""WITH {UNIVERSE}, f AS (SELECT h.frame, h.level, h.key, min(ord) AS ord FROM hits h JOIN universe u ON u.frame = h.frame AND u.level = h.level AND u.key = h.key GROUP BY 1, 2, 3), n AS (SELECT frame, level, ord, count(*) AS k FROM f GROUP BY 1, 2, 3), s AS (SELECT DISTINCT frame, level, ord FROM hits),
        t AS (SELECT frame, level, count(*) AS total FROM universe GROUP BY 1, 2), c AS (SELECT frame, level, ord, round(sum(coalesce(k, 0)) OVER (PARTITION BY frame, level ORDER BY ord) / total, 6) AS rate FROM s LEFT JOIN n USING (frame, level, ord) JOIN t USING (frame, level)),
        o AS (SELECT *, abs(rate - last_value(rate) OVER (PARTITION BY frame, level ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) > 0.01 AS off FROM c)
        SELECT frame, level, min(ord) FILTER (ord > coalesce(late, -1)) AS ord FROM (SELECT *, max(CASE WHEN off THEN ord END) OVER (PARTITION BY frame, level) AS late FROM o) GROUP BY 1, 2""",
    "gap_leaders": f"""WITH {UNIVERSE}, s AS (SELECT DISTINCT frame, level, key FROM hits WHERE ord = 0), g AS (SELECT frame, a::VARCHAR AS a, mid::VARCHAR AS b, c::VARCHAR AS c FROM pivots),
        parts AS (SELECT frame, least(a, c) || '|' || b || '|' || greatest(a, c) AS qid, 0 AS l, unnest([a, b, c]) AS key FROM g UNION ALL SELECT frame, least(a, c) || '|' || b || '|' || greatest(a, c), 1, unnest([least(a, b) || '|' || greatest(a, b), least(b, c) || '|' || greatest(b, c)]) FROM g),
        m AS (SELECT p.frame, qid, count(*) FILTER (l = 0 AND s.key IS NULL) AS n0, count(*) FILTER (l = 1 AND s.key IS NULL) AS n1 FROM parts p LEFT JOIN s ON s.frame = p.frame AND s.level = 'L' || l AND s.key = p.key GROUP BY 1, 2),
        k AS (SELECT frame, qid, 100 * n0 + 10 * n1 + 1 AS score, CASE WHEN n0 >= 2 AND n1 >= 2 THEN 5 WHEN n0 >= 1 AND n1 >= 2 THEN 4 WHEN n1 >= 2 THEN 3 WHEN n0 >= 1 AND n1 >= 1 THEN 2 WHEN n1 >= 1 THEN 1 ELSE 0 END AS tier FROM m)
        SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY tier DESC, score DESC, qid) AS rank, qid, score, tier FROM k QUALIFY rank <= 3""",
    "type_ordinals": f"WITH {NODES} SELECT frame, id, type || row_number() OVER (PARTITION BY frame, type ORDER BY id) AS name FROM nodes",
    "radius_pairs": f"WITH {NODES} SELECT p.frame, p.id, count(c.id) AS n FROM nodes p LEFT JOIN nodes c ON c.frame = p.frame AND c.type = 'car' AND sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2) <= 8 WHERE p.type = 'pedestrian' GROUP BY 1, 2",
    "undirected_edges": f"WITH {NODES}, n AS (SELECT frame, id, x, y, vec[9]::DOUBLE * 100 AS z FROM nodes), d AS (SELECT a.frame, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM n a JOIN n b ON a.frame = b.frame AND a.id < b.id) SELECT frame, count(*) AS n, round(min(d), 6) AS least FROM d WHERE d <= 15 GROUP BY 1",
    "lag_two": f"WITH {NODES}, s AS (SELECT frame, id, sqrt(vx * vx + vy * vy) AS speed FROM nodes) SELECT frame, id, lag(id) OVER w AS prev_id, round(speed - lag(speed, 2) OVER w, 6) AS change FROM s WINDOW w AS (PARTITION BY frame ORDER BY id)",
}


#: Question texts that are asked in every frame, with their meaning for the twin: family, type, status, direction, type and status of the reference, the same again, type and status on the right of a comparison.
ASKED = (
    ("Are there any moving cars?", "exist", "car", "moving"), ("Is there a parked bus?", "exist", "bus", "parked"), ("How many things are there?", "count", "thing", None), ("How many parked traffic cones are there?", "count", "traffic cone", "parked"),
    ("How many pedestrians are to the back left of the car?", "count", "pedestrian", None, "back left", "car", None), ("Are there any  cars in front of the moving truck?", "exist", "car", None, "front", "truck", "moving"), ("What status is the trailer?", "status", "trailer", None),
    ("What status is the bus to the front right of the parked construction vehicle?", "status", "bus", None, "front right", "truck", "parked"), ("What is the moving thing that is behind the bicycle?", "object", "thing", "moving", "back", "bicycle", None),
    ("What is the thing that is to the front of the car and the back of the pedestrian?", "object", "thing", None, "front", "car", None, "back", "pedestrian", None), ("There is a barrier; what is it?", "object", "barrier", None), ("Is the moving car the same status as the bus?", "comparison", "car", "moving", None, None, None, None, None, None, "bus", None),
    ("Is the motorcycle to the back of the truck of the same status as the standing pedestrian?", "comparison", "motorcycle", None, "back", "truck", None, None, None, None, "pedestrian", "standing"), ("Does a not standing pedestrian exist?", "exist", "pedestrian", "not standing"), ("Which way is it?", "general"),
)


def text_questions(spark, sf_dir):
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    asked = spark.createDataFrame([(k, row[0]) for k, row in enumerate(ASKED)], "qid int, text string")
    return questions.answered(n.select("frame").distinct().join(F.broadcast(asked)), n, e)


def _meanings() -> str:
    quoted = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'"
    return ", ".join(f"({k}, {', '.join(quoted(v) for v in (*row[1:], *[None] * 12)[:11])})" for k, row in enumerate(ASKED))


def _fit(kind: str, state: str, asked: str, status: str) -> str:
    return f"({asked} IS NULL OR {asked} = 'thing' OR contains(replace({kind}, '_', ' '), {asked})) AND ({status} IS NULL OR CASE WHEN {status} = 'not standing' THEN {kind} = 'pedestrian' AND {state} <> 'standing' ELSE {state} = {status} END)"


_SEEN = "({way} IS NULL OR EXISTS (SELECT 1 FROM edges e WHERE e.frame = n.frame AND e.dst = n.id AND replace(e.dir6, '_', ' ') = {way} AND {fit}))"
QUERIES["text_questions"] = text_questions
ORACLE["text_questions"] = f"""WITH {EDGES}, q(qid, family, t, s, w, rt, rs, w2, rt2, rs2, ct, cs) AS (VALUES {_meanings()}), f AS (SELECT DISTINCT frame FROM nodes),
  m AS (SELECT n.frame, q.qid, n.id, n.type, n.status, ct, cs FROM q, nodes n WHERE {_fit('n.type', 'n.status', 't', 's')} AND {_SEEN.format(way='w', fit=_fit('e.src_type', 'e.src_status', 'rt', 'rs'))} AND {_SEEN.format(way='w2', fit=_fit('e.src_type', 'e.src_status', 'rt2', 'rs2'))}),
  g AS (SELECT frame, qid, count(*) AS n, arg_min(status, id) AS st, arg_min(type, id) AS ty FROM m GROUP BY 1, 2),
  c AS (SELECT DISTINCT m.frame, m.qid FROM m JOIN nodes o ON o.frame = m.frame AND o.id <> m.id AND o.status = m.status WHERE m.ct IS NOT NULL AND {_fit('o.type', 'o.status', 'ct', 'cs')})
  SELECT f.frame, q.qid, family, CASE family WHEN 'exist' THEN CASE WHEN coalesce(n, 0) > 0 THEN 'yes' ELSE 'no' END WHEN 'count' THEN coalesce(n, 0)::VARCHAR WHEN 'status' THEN st WHEN 'object' THEN ty WHEN 'comparison' THEN CASE WHEN c.qid IS NOT NULL THEN 'yes' ELSE 'no' END END AS answer
  FROM f, q LEFT JOIN g ON g.frame = f.frame AND g.qid = q.qid LEFT JOIN c ON c.frame = f.frame AND c.qid = q.qid"""
