"""Dry runs and selection of questions over the gaps of the stand-in scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import constraints, coverage, dryrun, graph, isomorphism, planning, provenance
from orrery.session import durable

from .scene import CHAIN, UNIVERSE, _asked, edges_of, nodes_of


def _gaps(edges):
    return graph.pivot_universe(edges).withColumnRenamed("pivot", "b")


def dry_runs(spark, sf_dir):
    """Every question of both families over every gap."""
    n, e = nodes_of(spark, sf_dir), durable(edges_of(spark, sf_dir), "edges")
    return dryrun.dry_runs(durable(_gaps(e), "gaps"), n, e)


def balanced_selection(spark, sf_dir):
    """Two phases over all gaps: converging plans and what they cover, then slots by distance, direction and viewpoint."""
    n, e = nodes_of(spark, sf_dir), durable(edges_of(spark, sf_dir), "edges")
    gaps = durable(_gaps(e).withColumn("key", coverage.path_key(*[F.col(p).cast("string") for p in "abc"])), "gaps")
    plans = durable(dryrun.converge_plans(gaps.drop("key"), n, e, most=1).where("plan = 0 and mode = 'object'").select("frame", "key", "refs"), "plans")
    both = gaps.join(plans, ["frame", "key"], "left")
    ends = F.array_distinct(F.concat(F.array(F.col("a").cast("string"), F.col("c").cast("string")), F.filter(F.split("refs", "[|]"), lambda r: r != "")))
    # all paths through the pivot between the ends of the question's graph
    covers = F.flatten(F.transform(ends, lambda x, i: F.transform(F.slice(ends, i + 2, F.size(ends)), lambda y: coverage.path_key(x, F.col("b").cast("string"), y))))
    own = F.array(F.col("key"))
    slot = lambda s, c, ok: F.when(ok, F.struct(F.lit(s).alias("slot"), c.alias("covers")))
    k = F.col("a") + F.col("b") + F.col("c")
    options = F.filter(F.array(slot("A", covers, F.col("refs").isNotNull()), slot("B", own, k % 2 == 0), slot("C", own, k % 3 > 0), slot("D", own, k % 5 > 0)), lambda x: x.isNotNull())
    return constraints.two_phase_selection(both.select("frame", "key", (100 - k % 7).cast("int").alias("score"), options.alias("plans")))


def coverage_exit(spark, sf_dir):
    """The step of each frame and level after which ten steps in a row added one key or none."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    return planning.plateau_step(coverage.coverage_curve(coverage.universe(n, e), coverage.cascade(_asked(n, e))))


def node_views(spark, sf_dir):
    """Nodes by the shape of what is near them: isomorphism classes of the graphs of a node and those it sees close by."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir, 9.0)
    star = e.select(F.col("src").alias("graph"), F.col("dst").alias("id")).unionByName(n.select(F.col("id").alias("graph"), "id"))
    kind = F.when(F.col("type").isin("car", "truck", "bus", "trailer", "construction_vehicle"), "vehicle").otherwise("other")
    nodes = star.join(n.select("id", kind.alias("type")), "id")
    inner = star.alias("p").join(star.alias("q"), "graph").select("graph", F.col("p.id").alias("src"), F.col("q.id").alias("dst")).join(e.select("src", "dst", F.when(F.col("dir4").isin("front", "back"), "along").otherwise("across").alias("label")), ["src", "dst"])
    return isomorphism.isomorphism_classes(nodes, inner)


def answer_support(spark, sf_dir):
    """How many things stand to the left of a bus in front of a car, and the edges that say so."""
    a = provenance.answers_with_support(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), CHAIN)
    return a.select("frame", "answer", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.array_join(F.transform("support", lambda e: F.concat_ws(">", e["src"], e["dst"])), ",").alias("support"))


def support_coverage(spark, sf_dir):
    """What these answers cover."""
    a = provenance.answers_with_support(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), CHAIN)
    return provenance.support_footprint(a).groupBy("frame", "level").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (dry_runs, balanced_selection, coverage_exit, node_views, answer_support, support_coverage)}


def _rounds(p: str, c: str, v: str, without: str) -> str:
    """CTEs of three greedy rounds: candidates {p}c3 that are left, references {p}b1 to {p}b3."""
    out = [f"{p}c0 AS MATERIALIZED (SELECT frame, g, x FROM {c}), {p}u0 AS MATERIALIZED (SELECT frame, g, ref FROM {without})"]
    for k in (1, 2, 3):
        o = k - 1
        out.append(
            f"{p}z{k} AS MATERIALIZED (SELECT frame, g, count(*) AS size FROM {p}c{o} GROUP BY 1, 2), {p}s{k} AS MATERIALIZED (SELECT frame, g, ref, count(*) AS n FROM {v} JOIN {p}c{o} USING (frame, g, x) ANTI JOIN {p}u{o} USING (frame, g, ref) GROUP BY 1, 2, 3), "
            f"{p}b{k} AS MATERIALIZED (SELECT s.frame, s.g, s.ref FROM {p}s{k} s JOIN {p}z{k} z ON z.frame = s.frame AND z.g = s.g LEFT JOIN {p}c{o} l ON l.frame = s.frame AND l.g = s.g AND l.x = s.ref LEFT JOIN {c} o ON o.frame = s.frame AND o.g = s.g AND o.x = s.ref "
            f"WHERE n < size QUALIFY row_number() OVER (PARTITION BY s.frame, s.g ORDER BY n, l.x IS NULL, o.x IS NULL, s.ref) = 1), "
            f"{p}c{k} AS MATERIALIZED (SELECT y.frame, y.g, y.x FROM {p}c{o} y LEFT JOIN {p}b{k} b ON b.frame = y.frame AND b.g = y.g LEFT JOIN {v} w ON w.frame = y.frame AND w.g = y.g AND w.ref = b.ref AND w.x = y.x WHERE b.ref IS NULL OR w.x IS NOT NULL), "
            f"{p}u{k} AS MATERIALIZED (FROM {p}u{o} UNION ALL SELECT frame, g, ref FROM {p}b{k})"
        )
    out.append(
        f"{p}l AS (SELECT frame, g, x, target, dist, count(*) OVER h AS size, count(*) OVER (PARTITION BY frame, g, dist) AS tied, rank() OVER (PARTITION BY frame, g ORDER BY dist) AS near, rank() OVER (PARTITION BY frame, g ORDER BY dist DESC) AS far FROM {p}c3 JOIN {c} USING (frame, g, x) WINDOW h AS (PARTITION BY frame, g)), "
        f"{p} AS MATERIALIZED (SELECT l.frame, l.g, b1.ref AS first, concat_ws('|', b1.ref, b2.ref, b3.ref) AS refs, CASE WHEN size > 1 AND tied = 1 THEN CASE WHEN near = 1 THEN 'nearest' WHEN near = 2 THEN '2nd-nearest' WHEN far = 1 THEN 'farthest' WHEN far = 2 THEN '2nd-farthest' END END AS place, size "
        f"FROM {p}l l LEFT JOIN {p}b1 b1 ON b1.frame = l.frame AND b1.g = l.g LEFT JOIN {p}b2 b2 ON b2.frame = l.frame AND b2.g = l.g LEFT JOIN {p}b3 b3 ON b3.frame = l.frame AND b3.g = l.g WHERE x = target AND (size = 1 OR place IS NOT NULL))"
    )
    return ", ".join(out)


def _views(name: str, c: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT k.frame, k.g, e.src AS ref, k.x FROM {c} k JOIN edges e ON e.frame = k.frame AND e.dst = k.x JOIN edges t ON t.frame = k.frame AND t.dst = k.target AND t.src = e.src AND t.dir6 = e.dir6 WHERE e.src <> k.target)"


_GAPS = f"""{UNIVERSE}, pv AS (SELECT frame, least(src, dst) AS u, greatest(src, dst) AS v FROM edges), nb AS (SELECT DISTINCT frame, u AS b, v AS o FROM pv UNION SELECT DISTINCT frame, v, u FROM pv),
  ga AS MATERIALIZED (SELECT p.frame, p.o AS a, p.b, q.o AS c, least(p.o::VARCHAR, q.o::VARCHAR) || '|' || p.b || '|' || greatest(p.o::VARCHAR, q.o::VARCHAR) AS key FROM nb p JOIN nb q ON p.frame = q.frame AND p.b = q.b AND p.o < q.o),
  na AS MATERIALIZED (SELECT ga.*, row_number() OVER (PARTITION BY ga.frame ORDER BY key) - 1 AS turn, x.type AS ta, y.type AS tb, z.type AS tc, x.status AS ast, y.status AS bst, z.status AS cst FROM ga JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b JOIN nodes z ON z.id = c),
  cc AS MATERIALIZED (SELECT na.frame, key AS g, b AS target, e.dst AS x, e.dist FROM na JOIN edges f ON f.frame = na.frame AND f.src = a AND f.dst = b JOIN edges h ON h.frame = na.frame AND h.src = c AND h.dst = b
    JOIN edges e ON e.frame = na.frame AND e.src = a AND e.dst_type = tb AND e.dir6 = f.dir6 JOIN edges k ON k.frame = na.frame AND k.src = c AND k.dst = e.dst AND k.dir6 = h.dir6),
  dd AS MATERIALIZED (SELECT na.frame, key || '#' || w AS g, t AS target, e.dst AS x, e.dist, f.dir6 FROM (SELECT frame, key, b, 'a' AS w, a AS t FROM na UNION ALL SELECT frame, key, b, 'c', c FROM na) na JOIN edges f ON f.frame = na.frame AND f.src = b AND f.dst = t
    JOIN edges e ON e.frame = na.frame AND e.src = b AND e.dst_type = f.dst_type AND e.dir6 = f.dir6)"""
_NONE = "(SELECT 0 AS frame, '' AS g, 0 AS ref WHERE false)"
_MODE = "SELECT frame, key, family, plan, list_filter(ms, lambda m: m IS NOT NULL) AS ms, turn, base, discount, refs, place"

_CHAIN = f"""{UNIVERSE}, m AS (SELECT f.frame, f.src AS a, f.dst AS b, g.dst AS x FROM edges f JOIN edges g ON g.frame = f.frame AND g.src = f.dst WHERE f.src_type = 'car' AND f.dst_type = 'bus' AND f.dir4 = 'front' AND g.dir4 = 'left'),
  sp AS (SELECT frame, a AS s, b AS d FROM m UNION SELECT frame, b, x FROM m)"""

ORACLE = {
    "answer_support": f"""WITH {_CHAIN}, c AS (SELECT frame, count(DISTINCT x) AS n, string_agg(DISTINCT x::VARCHAR, ',' ORDER BY x::VARCHAR) AS skip, list_sort(list(DISTINCT x)) AS xs FROM m GROUP BY 1), t AS (SELECT frame, string_agg(s || '>' || d, ',' ORDER BY s, d) AS support FROM sp GROUP BY 1)
        SELECT n.frame, coalesce(c.n, 0)::VARCHAR AS answer, coalesce(array_to_string(xs, ','), '') AS ids, coalesce(support, '') AS support FROM (SELECT DISTINCT frame FROM nodes) n LEFT JOIN c USING (frame) LEFT JOIN t USING (frame)""",
    "support_coverage": f"""WITH {_CHAIN}, w AS (SELECT frame, s AS n, d AS o FROM sp UNION SELECT frame, d, s FROM sp), k AS (SELECT DISTINCT frame, 'L0' AS level, n::VARCHAR AS key FROM w UNION SELECT frame, 'L1', least(n, o) || '|' || greatest(n, o) FROM w UNION SELECT p.frame, 'L2', p.o || '|' || p.n || '|' || q.o FROM w p JOIN w q ON p.frame = q.frame AND p.n = q.n AND p.o < q.o)
        SELECT frame, level, count(*) AS n FROM k GROUP BY 1, 2""",
    "coverage_exit": f"""WITH {UNIVERSE}, f AS (SELECT frame, level, key, min(ord) AS ord FROM hits SEMI JOIN universe USING (frame, level, key) GROUP BY 1, 2, 3), s AS (SELECT DISTINCT frame, level, ord FROM hits),
        c AS (SELECT s.frame, s.level, s.ord, count(f.key) AS k FROM s LEFT JOIN f ON f.frame = s.frame AND f.level = s.level AND f.ord = s.ord GROUP BY 1, 2, 3), r AS (SELECT *, sum(k) OVER (PARTITION BY frame, level ORDER BY ord ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS t, max(k) OVER (PARTITION BY frame, level ORDER BY ord ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY frame, level ORDER BY ord) AS i FROM c)
        SELECT frame, level, min(ord) FILTER (m <= 1 AND i >= 10) AS ord FROM r GROUP BY 1, 2""",
    "dry_runs": f"""WITH {_GAPS}, {_views('cv', 'cc')}, {_views('dv', 'dd')}, {_rounds('p0', 'cc', 'cv', _NONE)},
  q1 AS MATERIALIZED (SELECT cc.* FROM cc JOIN p0 USING (frame, g) WHERE first IS NOT NULL), w1 AS (SELECT frame, g, first AS ref FROM p0 WHERE first IS NOT NULL), {_rounds('p1', 'q1', 'cv', 'w1')},
  q2 AS MATERIALIZED (SELECT q1.* FROM q1 JOIN p1 USING (frame, g) WHERE first IS NOT NULL), w2 AS (FROM w1 UNION ALL SELECT frame, g, first FROM p1 WHERE first IS NOT NULL), {_rounds('p2', 'q2', 'cv', 'w2')}, {_rounds('pd', 'dd', 'dv', _NONE)},
  cp AS (SELECT 0 AS plan, frame, g, refs, place FROM p0 UNION ALL SELECT 1, frame, g, refs, place FROM p1 UNION ALL SELECT 2, frame, g, refs, place FROM p2),
  cm AS (SELECT na.frame, key, 'converge' AS family, plan, turn, 0.5 AS base, CASE WHEN plan = 0 THEN 1.0 ELSE 0.95 END AS discount, refs, place, [{{'mode': 'object', 'answer': b::VARCHAR}}, CASE WHEN bst IS NOT NULL THEN {{'mode': 'status', 'answer': bst}} END, {{'mode': 'count', 'answer': '1'}}] AS ms FROM na JOIN cp ON cp.frame = na.frame AND g = key),
  br AS MATERIALIZED (SELECT pd.*, n, dir6 FROM pd JOIN (SELECT frame, g, count(*) AS n, any_value(dir6) AS dir6 FROM dd GROUP BY 1, 2) USING (frame, g)), th AS (SELECT frame, src, dir6, list(DISTINCT dst_type) AS there FROM edges GROUP BY 1, 2, 3),
  db AS (SELECT na.*, l.refs || '/' || r.refs AS refs, coalesce(l.place, '') || '/' || coalesce(r.place, '') AS place, l.n AS an, list_filter([{', '.join(f"'{t}'" for t in dryrun.TYPES)}], lambda t: NOT list_contains(there, t)) AS absent FROM na JOIN br l ON l.frame = na.frame AND l.g = key || '#a' JOIN br r ON r.frame = na.frame AND r.g = key || '#c' JOIN th ON th.frame = na.frame AND th.src = b AND th.dir6 = l.dir6),
  dm AS (SELECT frame, key, 'diverge' AS family, 0 AS plan, turn, 0.1 AS base, 1.0 AS discount, refs, place, [CASE WHEN ast IS NOT NULL AND cst IS NOT NULL THEN {{'mode': 'compare_status', 'answer': CASE WHEN ast = cst THEN 'Yes' ELSE 'No' END}} END, {{'mode': 'compare_type', 'answer': CASE WHEN ta = tc THEN 'Yes' ELSE 'No' END}}, CASE WHEN ast IS NOT NULL THEN {{'mode': 'branch_status', 'answer': ast}} END,
    {{'mode': 'branch_a_object', 'answer': a::VARCHAR}}, {{'mode': 'branch_c_object', 'answer': c::VARCHAR}}, {{'mode': 'branch_count', 'answer': an::VARCHAR}}, CASE WHEN len(absent) > 0 THEN {{'mode': 'counterfactual_exist', 'answer': 'No ' || absent[turn % len(absent) + 1]}} END] AS ms FROM db),
  am AS ({_MODE} FROM cm UNION ALL {_MODE} FROM dm), ex AS (SELECT *, unnest(range(len(ms))) AS i FROM am)
SELECT frame, key, family, plan, ms[i + 1].mode AS mode, round((base + CASE WHEN i = turn % len(ms) THEN 0.02 ELSE 0.0 END) * discount, 6)::DOUBLE AS weight, ms[i + 1].answer AS answer, refs, place FROM ex""",
}
