"""Measures over scenes, gaps, tracks and instances of the stand-in, and the scalar functions that no other query reaches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions import text as T
from orrery.operators import coverage, graph, planning, relational
from orrery.session import read_table

from .scene import EDGES, NODES, UNIVERSE, _asked, edges_of, nodes_of

#: Wanted coverage and weight of a missing share by level; paths weigh the same whatever they miss, and only while next to nothing is covered.
TARGETS = (("L0", 80.0, 1.0), ("L1", 50.0, 0.8), ("L2", 10.0, 0.5))


def _us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def instance_stats(spark, sf_dir):
    """Instances of each class: how many, and their points on average and at most."""
    li = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("class"), (F.col("l_suppkey") % 20).alias("frame"), (F.col("l_partkey") % 9).alias("instance")).agg(F.count("*").alias("points"))
    return li.groupBy("class").agg(F.count("*").alias("instances"), F.round(F.avg("points"), 6).alias("mean"), F.max("points").alias("most"))


def track_delays(spark, sf_dir):
    """Seconds until a track (the events of a user) is first found (by a purchase), and the longest time that it is lost."""
    w = Window.partitionBy("user_id").orderBy("us")
    e = read_table(spark, sf_dir, "events").withColumn("us", _us("ts"))
    e = e.withColumn("found", F.when(F.col("event_type") == "purchase", F.col("us"))).withColumn("last", F.coalesce(F.last("found", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min("us").over(Window.partitionBy("user_id"))))
    return e.groupBy("user_id").agg(F.round((F.min("found") - F.min("us")) / 1e6, 3).alias("initial"), F.round(F.max(F.col("us") - F.col("last")) / 1e6, 3).alias("longest_gap"))


def sampler_weights(spark, sf_dir):
    """The three gaps of each frame with the largest weight: score times one plus a quarter of the rarity of the pivot's type."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    kinds = n.withColumn("rarity", 1.0 / F.count("*").over(Window.partitionBy("frame", "type"))).select("frame", F.col("id").alias("pivot"), "rarity")
    gaps = graph.pivot_universe(e).join(kinds, ["frame", "pivot"])
    text = lambda c: F.col(c).cast("string")
    scored = coverage.new_counts(gaps.select("frame", "rarity", text("a").alias("a"), text("pivot").alias("b"), text("c").alias("c")), coverage.cascade(_asked(n, e).where("ord = 0")))
    weight = F.round(coverage.gap_score(F.col("new_l0"), F.col("new_l1")) * (1 + 0.25 * F.col("rarity")), 6)
    first = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("weight"), "qid"))
    return scored.select("frame", "qid", weight.alias("weight")).withColumn("rank", first).where("rank <= 3")


def coverage_priorities(spark, sf_dir):
    """How far each level is from its wanted coverage, and the priority of its gaps."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    c = coverage.coverage_stats(coverage.universe(n, e), coverage.cascade(_asked(n, e)))
    wanted = spark.createDataFrame(TARGETS, "level string, target double, weight double")
    missing = (100 - F.col("rate")) / 100
    priority = F.when(F.col("level") == "L2", F.when(F.col("rate") < 1, F.col("weight")).otherwise(0.0)).otherwise(missing * F.col("weight"))
    return c.join(F.broadcast(wanted), "level").select("level", F.round(F.greatest(F.lit(0.0), F.col("target") - F.col("rate")), 4).alias("short_by"), F.round(priority, 6).alias("priority"))


def coverage_areas(spark, sf_dir):
    """Coverage of each level over all frames: of all keys together, as a mean over frames, and the mean over the steps of the curve."""
    n, e = nodes_of(spark, sf_dir), edges_of(spark, sf_dir)
    u, h = coverage.universe(n, e), coverage.cascade(_asked(n, e))
    curve = coverage.coverage_curve(u, h).join(u.groupBy("frame", "level").agg(F.count("*").alias("total")), ["frame", "level"])
    last = curve.groupBy("frame", "level").agg(F.max("covered").alias("covered"), F.max("total").alias("total"), F.max("rate").alias("rate"), F.avg("rate").alias("area"))
    return last.groupBy("level").agg(F.round(F.sum("covered") / F.sum("total"), 6).alias("micro"), F.round(F.avg("rate"), 5).alias("macro"), F.round(F.avg("area"), 5).alias("area"))


def direction_agreement(spark, sf_dir):
    """How the three conventions name the same edges."""
    return edges_of(spark, sf_dir).groupBy("dir4", "dir6", "dir8").agg(F.count("*").alias("n"))


def soft_directions(spark, sf_dir):
    """Edges whose loose range holds a direction that is not their own name, by both."""
    e = edges_of(spark, sf_dir).select("dir8", F.explode(G.loose_directions(F.col("angle"))).alias("loose"))
    return e.where("dir8 <> loose").groupBy("dir8", "loose").agg(F.count("*").alias("n"))


def referent_list(spark, sf_dir):
    """The ten best referents of each of the first five targets of a frame, with all that they see alike."""
    e = edges_of(spark, sf_dir)
    targets = nodes_of(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("frame").orderBy("id"))).where("k <= 5").select("frame", F.col("id").alias("dst"))
    r = planning.referents(e).join(targets, ["frame", "dst"], "left_semi").where("rank <= 10")
    return r.select("frame", "dst", "rank", "ref", "n", F.concat_ws("|", F.col("siblings").cast("array<string>")).alias("siblings"))


def random_nodes(spark, sf_dir):
    """Three nodes of each frame by a seeded order."""
    h = relational.seeded_order(F.col("id"), 7)
    w = Window.partitionBy("frame").orderBy(h, "id")
    return nodes_of(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("frame", "rank", "id")


def edge_cube(spark, sf_dir):
    """Distinct combinations in every subset of six attributes of an edge."""
    keys = ["src_type", "dst_type", "src_status", "dst_status", "dir4", "level"]
    c = edges_of(spark, sf_dir).cube(*keys).agg(F.grouping_id().alias("subset"), F.count("*").alias("n"))
    return c.groupBy("subset").agg(F.count("*").alias("groups"), F.max("n").alias("largest"))


def safety_bins(spark, sf_dir):
    """Edges by how near they are, in bins of growing width."""
    return edges_of(spark, sf_dir).groupBy("src_type", G.safety_bin(F.col("dist")).alias("bin")).agg(F.count("*").alias("n"))


def size_overlaps(spark, sf_dir):
    """Overlap of the sizes of linked nodes, and the difference of their headings with a half turn alike."""
    n = nodes_of(spark, sf_dir).select("frame", "id", "height", "yaw")
    e = edges_of(spark, sf_dir, 6.0).select("frame", "src", "dst").where("src < dst")
    a, b = (n.select("frame", F.col("id").alias(k), F.col("height").alias(f"{k}_h"), F.col("yaw").alias(f"{k}_yaw")) for k in ("src", "dst"))
    met = e.join(a, ["frame", "src"]).join(b, ["frame", "dst"])
    sizes = lambda k: [F.col(f"{k}_h"), F.col(f"{k}_h") * 2, F.lit(2.0)]
    return met.select("src", "dst", F.round(G.scale_iou(sizes("src"), sizes("dst")), 6).alias("overlap"), F.round(F.abs(G.angle_difference(F.col("src_yaw"), F.col("dst_yaw"), 180.0)), 6).alias("turn"))


def local_views(spark, sf_dir):
    """Each node seen from the first of its frame: local place, bearing from north, heading by a quaternion."""
    n = nodes_of(spark, sf_dir)
    me = n.groupBy("frame").agg(F.min_by(F.struct("x", "y", "yaw"), "id").alias("me"))
    u, v = G.to_local(F.col("x"), F.col("y"), F.col("me.x"), F.col("me.y"), F.col("me.yaw"))
    half = F.radians(F.col("yaw")) / 2
    heading = G.yaw(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    return n.join(me, "frame").select("id", F.round(u, 6).alias("ahead"), F.round(v, 6).alias("aside"), F.round(G.north_bearing(F.col("x"), F.col("y")), 6).alias("bearing"), F.round(heading, 6).alias("heading"))


def plan_marks(spark, sf_dir):
    """A short fingerprint and the difficulty of each gap's plan."""
    p = graph.pivot_universe(edges_of(spark, sf_dir, 6.0))
    k = (F.col("a") % 4).cast("int")
    return p.select("frame", "a", "pivot", "c", T.fingerprint16(F.col("a"), F.col("pivot"), F.col("c")).alias("mark"), T.difficulty((F.col("c") % 7).cast("int"), k, F.lit(1)).alias("difficulty"))


def any_times(spark, sf_dir):
    """Times written in three ways, read back."""
    t = F.col("ts").cast("timestamp")
    forms = [F.date_format(t, f) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss")]
    written = F.element_at(F.array(*forms), (F.col("event_id") % 3 + 1).cast("int"))
    return read_table(spark, sf_dir, "events").select("event_id", F.unix_seconds(T.any_timestamp(written)).alias("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        instance_stats, track_delays, sampler_weights, coverage_priorities, coverage_areas, direction_agreement, soft_directions, referent_list, random_nodes, edge_cube, safety_bins, size_overlaps, local_views, plan_marks, any_times,
    )
}

_CURVE = f"""{UNIVERSE}, f AS (SELECT h.frame, h.level, h.key, min(ord) AS ord FROM hits h JOIN universe u ON u.frame = h.frame AND u.level = h.level AND u.key = h.key GROUP BY 1, 2, 3), k AS (SELECT frame, level, ord, count(*) AS k FROM f GROUP BY 1, 2, 3), st AS (SELECT DISTINCT frame, level, ord FROM hits),
  tot AS (SELECT frame, level, count(*) AS total FROM universe GROUP BY 1, 2), curve AS (SELECT frame, level, ord, total, sum(coalesce(k, 0)) OVER (PARTITION BY frame, level ORDER BY ord) AS covered, round(sum(coalesce(k, 0)) OVER (PARTITION BY frame, level ORDER BY ord) / total, 6) AS rate FROM st LEFT JOIN k USING (frame, level, ord) JOIN tot USING (frame, level))"""
_GAPS = f"""{UNIVERSE}, s AS (SELECT DISTINCT frame, level, key FROM hits WHERE ord = 0), g AS (SELECT frame, a::VARCHAR AS a, mid::VARCHAR AS b, c::VARCHAR AS c, mid FROM pivots),
  parts AS (SELECT frame, mid, least(a, c) || '|' || b || '|' || greatest(a, c) AS qid, 0 AS l, unnest([a, b, c]) AS key FROM g UNION ALL SELECT frame, mid, least(a, c) || '|' || b || '|' || greatest(a, c), 1, unnest([least(a, b) || '|' || greatest(a, b), least(b, c) || '|' || greatest(b, c)]) FROM g),
  m AS (SELECT p.frame, mid, qid, 100 * count(*) FILTER (l = 0 AND s.key IS NULL) + 10 * count(*) FILTER (l = 1 AND s.key IS NULL) + 1 AS score FROM parts p LEFT JOIN s ON s.frame = p.frame AND s.level = 'L' || l AND s.key = p.key GROUP BY 1, 2, 3)"""
_CUBE = "src_type, dst_type, src_status, dst_status, dir4, level"

ORACLE = {
    "instance_stats": "WITH i AS (SELECT l_returnflag AS class, count(*) AS p FROM lineitem GROUP BY l_returnflag, l_suppkey % 20, l_partkey % 9) SELECT class, count(*) AS instances, round(avg(p), 6) AS mean, max(p) AS most FROM i GROUP BY 1",
    "track_delays": """WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END AS f FROM events), l AS (SELECT *, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(us) OVER (PARTITION BY user_id)) AS last FROM e)
        SELECT user_id, round((min(f) - min(us)) / 1e6, 3) AS initial, round(max(us - last) / 1e6, 3) AS longest_gap FROM l GROUP BY 1""",
    "sampler_weights": f"""WITH {_GAPS}, r AS (SELECT id, 1.0::DOUBLE / count(*) OVER (PARTITION BY frame, type) AS rarity FROM nodes), w AS (SELECT m.frame, qid, round(score * (1 + 0.25::DOUBLE * rarity), 6) AS weight FROM m JOIN r ON r.id = mid)
        SELECT frame, qid, weight, row_number() OVER (PARTITION BY frame ORDER BY weight DESC, qid) AS rank FROM w QUALIFY rank <= 3""",
    "coverage_priorities": f"""WITH {UNIVERSE}, s AS (SELECT DISTINCT frame, level, key FROM hits), c AS (SELECT u.level, round(count(s.key) * 100.0 / count(*), 2) AS rate FROM universe u LEFT JOIN s ON u.frame = s.frame AND u.level = s.level AND u.key = s.key GROUP BY 1)
        SELECT level, round(greatest(0, CASE level WHEN 'L0' THEN 80 WHEN 'L1' THEN 50 ELSE 10 END - rate), 4) AS short_by, round(CASE level WHEN 'L2' THEN CASE WHEN rate < 1 THEN 0.5 ELSE 0 END WHEN 'L1' THEN (100 - rate) / 100 * 0.8 ELSE (100 - rate) / 100 END, 6) AS priority FROM c""",
    "coverage_areas": f"WITH {_CURVE}, x AS (SELECT frame, level, max(covered) AS covered, max(total) AS total, max(rate) AS rate, avg(rate) AS area FROM curve GROUP BY 1, 2) SELECT level, round(sum(covered) / sum(total), 6) AS micro, round(avg(rate), 5) AS macro, round(avg(area), 5) AS area FROM x GROUP BY 1",
    "direction_agreement": f"WITH {EDGES} SELECT dir4, dir6, dir8, count(*) AS n FROM edges GROUP BY 1, 2, 3",
    "soft_directions": f"""WITH {EDGES}, l(loose, c, h) AS (VALUES ('front', 0, 90), ('left', 90, 90), ('back', 180, 90), ('right', -90, 90), ('front_left', 45, 45), ('back_left', 135, 45), ('back_right', -135, 45), ('front_right', -45, 45))
        SELECT dir8, loose, count(*) AS n FROM edges, l WHERE abs(((angle - c + 180) % 360 + 360) % 360 - 180) <= h AND dir8 <> loose GROUP BY 1, 2""",
    "referent_list": f"""WITH {EDGES}, b AS (SELECT frame, src AS ref, dst_type, dir8, list(dst ORDER BY dst) AS ids FROM edges GROUP BY 1, 2, 3, 4), t AS (SELECT frame, id FROM nodes QUALIFY row_number() OVER (PARTITION BY frame ORDER BY id) <= 5),
        r AS (SELECT e.frame, e.dst, e.src AS ref, len(ids) AS n, array_to_string(ids, '|') AS siblings, row_number() OVER (PARTITION BY e.frame, e.dst ORDER BY len(ids), e.dist, e.src) AS rank FROM edges e JOIN b ON b.frame = e.frame AND b.ref = e.src AND b.dst_type = e.dst_type AND b.dir8 = e.dir8)
        SELECT r.frame, dst, rank, ref, n::INT AS n, siblings FROM r JOIN t ON t.frame = r.frame AND t.id = dst WHERE rank <= 10""",
    "random_nodes": f"WITH {NODES} SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY md5('7:' || id), id) AS rank, id FROM nodes QUALIFY rank <= 3",
    "edge_cube": f"WITH {EDGES}, c AS (SELECT grouping_id({_CUBE}) AS subset, count(*) AS n FROM edges GROUP BY CUBE ({_CUBE})) SELECT subset, count(*) AS groups, max(n) AS largest FROM c GROUP BY 1",
    "safety_bins": f"WITH {EDGES} SELECT src_type, CASE WHEN dist <= 2 THEN 0 WHEN dist <= 5 THEN 1 WHEN dist <= 10 THEN 2 WHEN dist <= 15 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM edges GROUP BY 1, 2",
    "size_overlaps": f"""WITH {EDGES}, p AS (SELECT src, dst, a.height AS g, b.height AS h, a.yaw - b.yaw AS d FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src < dst AND dist <= 6)
        SELECT src, dst, round(4 * least(g, h) ** 2 / (4 * g * g + 4 * h * h - 4 * least(g, h) ** 2), 6) AS overlap, round(abs(((d + 90) % 180 + 180) % 180 - 90), 6) AS turn FROM p""",
    "local_views": f"""WITH {NODES}, m AS (SELECT frame, arg_min(x, id) AS mx, arg_min(y, id) AS my, radians(arg_min(yaw, id)) AS mh FROM nodes GROUP BY 1)
        SELECT id, round((x - mx) * cos(mh) + (y - my) * sin(mh), 6) + 0.0 AS ahead, round((y - my) * cos(mh) - (x - mx) * sin(mh), 6) + 0.0 AS aside, round((degrees(atan2(x, y)) % 360 + 360) % 360, 6) AS bearing, round(yaw, 6) AS heading FROM nodes n JOIN m ON m.frame = n.frame""",
    "plan_marks": f"""WITH {EDGES}, e6 AS (SELECT * FROM edges WHERE dist <= 6), near AS (SELECT frame, src AS n, dst AS o FROM e6 UNION SELECT frame, dst, src FROM e6), p AS (SELECT p.frame, p.o AS a, p.n AS mid, q.o AS c FROM near p JOIN near q ON p.frame = q.frame AND p.n = q.n AND p.o < q.o)
        SELECT frame, a, mid AS "pivot", c, substr(sha1('{{"a":' || a || ',"pivot":' || mid || ',"c":' || c || '}}'), 1, 16) AS mark, ((c % 7) * greatest(a % 4, 1) + 2)::INT AS difficulty FROM p""",
    "any_times": "SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events",
}
