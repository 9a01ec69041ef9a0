"""Evaluation, camera and text queries over the stand-in data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions import text as T
from orrery.operators import generate, metrics, relational
from orrery.session import durable, read_table

from .scene import NODES, nodes_of
from .tables import _FAMILY, _NORMALISED

WIDTH, HEIGHT, FOCAL = 1600.0, 900.0, 1266.0
CATEGORIES = (*T.DETECTION_CLASSES, "animal", "static_object.bicycle_rack", "human.pedestrian.stroller")


def _scored(spark, sf_dir):
    """Scored candidates of ten classes; an error belongs to each hit, unknown for every eleventh."""
    e = F.when(F.col("event_id") % 11 > 0, (F.col("event_id") * 37 % 100) / 100.0)
    return read_table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("class"), "event_id", F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("hit"), e.alias("error"))


def _curve(spark, sf_dir):
    return metrics.precision_recall(_scored(spark, sf_dir), "class", "score", "event_id", "hit")


def detection_errors(spark, sf_dir):
    return metrics.true_positive_error(_curve(spark, sf_dir), "class", "score", "error", "hit")


def detection_summary(spark, sf_dir):
    """Mean average precision, mean error, and the score of both."""
    both = metrics.precision_and_errors(durable(_curve(spark, sf_dir), "curve"), "class", "score", ["error"], "hit")
    means = both.agg(F.avg("ap").alias("mean_ap"), F.avg("error").alias("mean_error"))
    return means.select(F.round("mean_ap", 5).alias("mean_ap"), F.round("mean_error", 5).alias("mean_error"), F.round(metrics.detection_score(F.col("mean_ap"), F.col("mean_error")), 5).alias("score"))


def recall_thresholds(spark, sf_dir):
    s = _scored(spark, sf_dir)
    positives = s.groupBy("class").agg((F.count_if("hit") + 5).alias("n"))
    t = metrics.recall_thresholds(s, "class", "score", "event_id", "hit", positives)
    return t.select("class", F.round("recall", 6).alias("recall"), F.round("threshold", 6).alias("threshold"))


def tracking_summary(spark, sf_dir):
    """One row for each class and threshold is made of sums over part and discount; averages over thresholds follow."""
    li = read_table(spark, sf_dir, "lineitem")
    rows = li.groupBy((F.col("l_suppkey") % 7).alias("class"), F.col("l_discount").alias("threshold")).agg(F.count("*").alias("tp"), F.expr("count_if(l_returnflag = 'R')").alias("fp"), F.expr("count_if(l_returnflag = 'A')").alias("fn"), F.expr("count_if(l_linenumber = 7)").alias("switches"), F.avg(F.col("l_quantity") / 50).alias("motp"))
    mota = F.greatest(F.lit(0.0), 1 - (F.col("fp") + F.col("fn") + F.col("switches")) / (F.col("tp") + F.col("fn")))
    reached = F.col("threshold") < 0.095
    full = rows.withColumns({"mota": F.when(reached, F.round(mota, 9)), "motar": F.when(reached, mota / 2), "motp": F.when(reached, F.col("motp"))})
    return metrics.tracking_summary(full).select("class", "amota", "amotp", "mota")


def panoptic_tracking(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    points = li.select((F.col("l_suppkey") % 5).alias("scene"), (F.col("l_orderkey") % 12).alias("frame"), F.col("l_returnflag").alias("class"), (F.col("l_partkey") % 4).alias("truth"), F.when(F.col("l_orderkey") % 5 == 0, F.lit(3)).otherwise((F.col("l_partkey") + F.expr("(l_orderkey % 12) div 7")) % 4).alias("guess"))
    return metrics.panoptic_tracking(points)


def label_stats(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("frame"), F.col("l_linenumber").alias("label"))
    return metrics.label_stats(li, "frame", "label")


def iou_by_stratum(spark, sf_dir):
    """Mean overlap for each group of frames."""
    li = read_table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("truth"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber")).otherwise((F.col("l_partkey") % 7 + 1).cast("int")).alias("guess"))
    hit = F.col("truth") == F.col("guess")
    cells = li.select("l_returnflag", F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("g"), hit.cast("int").alias("h")), F.struct(F.col("guess").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("h")))).alias("r")).select("l_returnflag", "r.*")
    by = cells.groupBy("l_returnflag", "class").agg(*[F.sum(c).alias(c) for c in "tgh"])
    return by.groupBy("l_returnflag").agg(F.round(F.avg(F.col("h") / (F.col("t") + F.col("g") - F.col("h"))), 6).alias("miou"))


def least_errors(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return metrics.running_least(li.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 3).alias("mode"), (1.0 / (1 + F.col("l_partkey") % 3)).alias("p"), F.col("l_linenumber").alias("t"), (F.col("l_quantity") / 10).alias("dist")))


def running_mean(spark, sf_dir):
    """Mean of a user's values so far; errors do not count."""
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return read_table(spark, sf_dir, "events").select("event_id", F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))).over(w), 6).alias("mean"))


def track_scores(spark, sf_dir):
    """A track has the mean of its rows' scores; the ten best of each class."""
    t = read_table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("score"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("score"), "user_id"))).where("rank <= 10")


def user_log(spark, sf_dir):
    """The log of each user: events, first and last, seconds between."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.round((F.max(us) - F.min(us)) / 1e6, 3).alias("seconds"))


def density_strata(spark, sf_dir):
    """Frames by how many moving nodes they hold, and the leading frame of each stratum."""
    f = nodes_of(spark, sf_dir).groupBy("frame").agg(F.expr("count_if(status = 'moving')").alias("objects"), F.count_distinct("type").alias("types"))
    s = generate.density_strata(f)
    lead = generate.representatives(s).withColumn("leads", F.lit(True))
    return s.join(lead, ["stratum", "frame"], "left").select("frame", "stratum", F.round("score", 6).alias("score"), F.coalesce("leads", F.lit(False)).alias("leads"))


def class_names(spark, sf_dir):
    """Categories with their detection and tracking class; nodes stand for annotations."""
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("id") % len(CATEGORIES) + 1).cast("int"))
    n = nodes_of(spark, sf_dir).select(category.alias("category"))
    return n.groupBy("category", T.detection_class(F.col("category")).alias("detection"), T.tracking_class(F.col("category")).alias("tracking")).agg(F.count("*").alias("n"))


def projected_boxes(spark, sf_dir):
    """Boxes in a forward camera: visible in part, visible whole, and the rectangle in the image."""
    n = nodes_of(spark, sf_dir)
    size = F.col("height")
    # camera axes: x to the right, y down, z ahead
    corners = G.box_corners(F.col("x") + 12, F.col("y"), F.lit(0.0), size * 2, size, size, F.col("yaw"))
    camera = F.transform(corners, lambda c: F.struct((-c["y"]).alias("x"), (-c["z"]).alias("y"), c["x"].alias("z")))
    seen = n.withColumn("corners", G.view_points(camera, FOCAL, WIDTH / 2, HEIGHT / 2))
    box = G.image_box(F.col("corners"), WIDTH, HEIGHT)
    out = seen.select("id", G.box_in_image(F.col("corners"), WIDTH, HEIGHT).alias("in_part"), G.box_in_image(F.col("corners"), WIDTH, HEIGHT, True).alias("whole"), box.alias("b"))
    return out.where("in_part").select("id", "whole", *[F.round(f"b.{c}", 4).alias(c) for c in ("u0", "v0", "u1", "v1")])


def destinations(spark, sf_dir):
    """Where each node lies on a globe, from a fixed origin by bearing and distance."""
    n = nodes_of(spark, sf_dir)
    lat, lon = G.destination(F.lit(42.336849), F.lit(-71.057854), G.north_bearing(F.col("x"), F.col("y")), F.hypot("x", "y"))
    return n.select("id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


def turned_headings(spark, sf_dir):
    """Heading a third of the way to the next node's, the shorter way round."""
    after = F.lead("yaw").over(Window.partitionBy("frame").orderBy("id"))
    return nodes_of(spark, sf_dir).select("id", F.round(G.turned_between(F.col("yaw"), after, F.lit(1 / 3)), 6).alias("yaw"))


def bare_answers(spark, sf_dir):
    """The bare answer in each turn, read by the family of its own text."""
    c = read_table(spark, sf_dir, "conversations")
    family = T.question_family(T.normalised_question(F.col("text")))
    return c.groupBy(family.alias("family"), F.when(family != "general", T.formatted_answer(family, F.col("text"))).alias("answer")).agg(F.count("*").alias("n"))


def phrases(spark, sf_dir):
    """Types as a question names them."""
    n = nodes_of(spark, sf_dir).select(F.replace("type", F.lit("_"), F.lit(" ")).alias("kind"), "type")
    return n.groupBy("type", T.plural(F.col("kind")).alias("many"), T.with_article(F.col("kind")).alias("one"), T.canonical_name(F.concat(F.lit(" "), F.col("kind"), F.lit("--Count "))).alias("name")).agg(F.count("*").alias("n"))


def inner_objects(spark, sf_dir):
    """The first object in a noisy text around the properties of an event."""
    noisy = F.concat(F.lit("answer: "), F.col("props"), F.lit(' {"k": 0}'))
    return read_table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.first_object(noisy), "$.k").cast("bigint").alias("k"))


def point_lookup(spark, sf_dir):
    """One part by its key, and the parts of one brand that equal it in size."""
    p = read_table(spark, sf_dir, "part")
    one = p.where("p_partkey = 17").select("p_brand", "p_size")
    return p.join(F.broadcast(one), ["p_brand", "p_size"], "left_semi").select("p_partkey", "p_name")


def two_fact_frequency(spark, sf_dir):
    """How often each nation occurs among customers and among suppliers."""
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    both = relational.frequency(c.select(F.col("c_nationkey").alias("nation")), "nation").withColumnRenamed("n", "customers").join(relational.frequency(s.select(F.col("s_nationkey").alias("nation")), "nation").withColumnRenamed("n", "suppliers"), "nation", "full")
    return both.fillna(0, ["customers", "suppliers"])


QUERIES = {
    f.__name__: f
    for f in (
        detection_errors, detection_summary, recall_thresholds, tracking_summary, panoptic_tracking, label_stats, iou_by_stratum, least_errors, running_mean, track_scores, user_log, density_strata, class_names,
        projected_boxes, destinations, turned_headings, bare_answers, phrases, inner_objects, point_lookup, two_fact_frequency,
    )
}

_CURVE = """s AS (SELECT user_id % 10 AS class, event_id, value AS score, (event_type = 'purchase')::INT AS hit, CASE WHEN event_id % 11 > 0 THEN (event_id * 37 % 100) / 100.0::DOUBLE END AS err FROM events),
  c AS (SELECT *, count(*) OVER w AS k, sum(hit) OVER w / count(*) OVER w AS p, sum(hit) OVER w / nullif(sum(hit) OVER (PARTITION BY class), 0) AS r FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  q AS (SELECT class, r, arg_min(p, k) AS p_first, arg_max(p, k) AS p_last, arg_min(score, k) AS s_first, arg_max(score, k) AS s_last FROM c GROUP BY 1, 2), b AS (SELECT class, x / 100.0::DOUBLE AS pos, x FROM (SELECT DISTINCT class FROM s), range(0, 101) t(x)),
  lo AS (SELECT b.class, b.x, b.pos, max(q.r) AS r0, arg_max(q.p_last, q.r) AS p0, arg_max(q.s_last, q.r) AS s0 FROM b LEFT JOIN q ON q.class = b.class AND q.r <= b.pos + 1e-11 GROUP BY 1, 2, 3),
  hi AS (SELECT b.class, b.x, min(q.r) AS r1, arg_min(q.p_first, q.r) AS p1, arg_min(q.s_first, q.r) AS s1 FROM b JOIN q ON q.class = b.class AND q.r > b.pos + 1e-11 GROUP BY 1, 2),
  v AS (SELECT lo.class, lo.x, CASE WHEN r0 IS NULL THEN p1 WHEN abs(pos - r0) < 1e-11 THEN p0 WHEN r1 IS NULL THEN 0 ELSE p0 + (p1 - p0) * (pos - r0) / (r1 - r0) END AS p,
    CASE WHEN r0 IS NULL THEN s1 WHEN abs(pos - r0) < 1e-11 THEN s0 WHEN r1 IS NULL THEN 0 ELSE s0 + (s1 - s0) * (pos - r0) / (r1 - r0) END AS conf FROM lo LEFT JOIN hi ON lo.class = hi.class AND lo.x = hi.x),
  ap AS (SELECT class, round(sum(greatest(p - 0.1, 0)) FILTER (x >= 11) / 90 / 0.9, 6) AS ap FROM v GROUP BY 1),
  h AS (SELECT class, score, k, CASE WHEN count(err) OVER (PARTITION BY class) = 0 THEN 1 ELSE coalesce(avg(err) OVER (PARTITION BY class ORDER BY score DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS m FROM c WHERE hit = 1),
  f AS (SELECT v.class, v.x, v.conf, max(h.score) AS c0, arg_max(h.m, (h.score, -h.k)) AS m0 FROM v LEFT JOIN h ON h.class = v.class AND h.score <= v.conf WHERE v.conf <> 0 AND v.x >= 11 GROUP BY 1, 2, 3),
  g AS (SELECT f.*, min(h.score) AS c1, arg_min(h.m, (h.score, -h.k)) AS m1 FROM f LEFT JOIN h ON h.class = f.class AND h.score > f.conf GROUP BY ALL),
  e AS (SELECT class, avg(CASE WHEN c0 IS NULL THEN m1 WHEN c1 IS NULL OR conf <= c0 THEN m0 ELSE m0 + (m1 - m0) * (conf - c0) / (c1 - c0) END) AS e FROM g GROUP BY 1),
  tp AS (SELECT d.class, round(coalesce(e, 1.0), 6) AS error FROM (SELECT DISTINCT class FROM s) d LEFT JOIN e ON e.class = d.class)"""
_CAT = ", ".join(f"'{c}'" for c in CATEGORIES)
_DET = "CASE category WHEN 'movable_object.barrier' THEN 'barrier' WHEN 'movable_object.trafficcone' THEN 'traffic_cone' WHEN 'vehicle.construction' THEN 'construction_vehicle' WHEN 'animal' THEN NULL WHEN 'static_object.bicycle_rack' THEN NULL WHEN 'human.pedestrian.stroller' THEN NULL ELSE string_split(category, '.')[2] END"
_TURN = "(((({1}) - ({0}) + 180) % 360 + 360) % 360 - 180)"

ORACLE = {
    "detection_errors": f"WITH {_CURVE} SELECT * FROM tp",
    "detection_summary": f"WITH {_CURVE}, m AS (SELECT avg(ap) AS a, avg(error) AS e FROM ap JOIN tp USING (class)) SELECT round(a, 5) AS mean_ap, round(e, 5) AS mean_error, round((5 * a + greatest(0, 1 - e)) / 6, 5) AS score FROM m",
    "recall_thresholds": """WITH s AS (SELECT user_id % 10 AS class, event_id, value AS score, (event_type = 'purchase')::INT AS hit FROM events), n AS (SELECT class, sum(hit) + 5 AS n FROM s GROUP BY 1),
        c AS (SELECT s.class, score, sum(hit) OVER (PARTITION BY s.class ORDER BY score DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / n AS r FROM s JOIN n ON n.class = s.class), w AS (SELECT class, round(0.1 + x * 0.9 / 39, 12) AS recall FROM n, range(40) t(x))
        SELECT w.class, round(recall, 6) AS recall, round(max(score), 6) AS threshold FROM w LEFT JOIN c ON c.class = w.class AND c.r >= recall - 1e-12 GROUP BY w.class, recall""",
    "tracking_summary": """WITH r AS (SELECT l_suppkey % 7 AS class, l_discount AS th, count(*) AS tp, count(*) FILTER (l_returnflag = 'R') AS fp, count(*) FILTER (l_returnflag = 'A') AS fn, count(*) FILTER (l_linenumber = 7) AS sw, avg(l_quantity / 50) AS motp FROM lineitem GROUP BY 1, 2),
        m AS (SELECT *, CASE WHEN th < 0.095 THEN greatest(0, 1 - (fp + fn + sw) / (tp + fn)) END AS mota FROM r) SELECT class, round(avg(coalesce(mota / 2, 0)), 6) AS amota, round(avg(CASE WHEN th < 0.095 THEN motp ELSE 2.0 END), 6) AS amotp, round(max(mota), 6) AS mota FROM m GROUP BY 1""",
    "panoptic_tracking": """WITH p AS (SELECT l_suppkey % 5 AS scene, l_orderkey % 12 AS frame, l_returnflag AS class, l_partkey % 4 AS truth, CASE WHEN l_orderkey % 5 = 0 THEN 3 ELSE (l_partkey + (l_orderkey % 12) // 7) % 4 END AS guess FROM lineitem),
        b AS (SELECT scene, frame, class, truth, guess, count(*) AS k FROM p WHERE truth <> 0 AND guess <> 0 GROUP BY ALL), t AS (SELECT scene, frame, class, truth, count(*) AS nt FROM p WHERE truth <> 0 GROUP BY ALL), g AS (SELECT scene, frame, class, guess, count(*) AS ng FROM p WHERE guess <> 0 GROUP BY ALL),
        m AS (SELECT *, k / (nt + ng - k) AS iou FROM b JOIN t USING (scene, frame, class, truth) JOIN g USING (scene, frame, class, guess) WHERE k / (nt + ng - k) > 0.5), w AS (SELECT *, coalesce(lag(guess) OVER (PARTITION BY scene, class, truth ORDER BY frame) <> guess, false) AS sw FROM m),
        c AS (SELECT class, count(*) AS tp, sum(iou) AS s, count(*) FILTER (sw) AS sw, coalesce(sum(iou) FILTER (sw), 0) AS lost FROM w GROUP BY 1), a AS (SELECT x.class, coalesce(tp, 0) AS tp, (SELECT count(*) FROM g WHERE g.class = x.class) - coalesce(tp, 0) AS fp, (SELECT count(*) FROM t WHERE t.class = x.class) - coalesce(tp, 0) AS fn, coalesce(s, 0) AS s, coalesce(sw, 0) AS sw, coalesce(lost, 0) AS lost FROM (SELECT DISTINCT class FROM p) x LEFT JOIN c ON c.class = x.class)
        SELECT class, sw AS switches, round(coalesce(greatest(0, s - sw) / nullif(tp + 0.5 * fp + 0.5 * fn, 0), 0), 6) AS ptq, round(coalesce(greatest(0, s - lost) / nullif(tp + 0.5 * fp + 0.5 * fn, 0), 0), 6) AS sptq FROM a""",
    "label_stats": "SELECT l_orderkey % 50 AS frame, l_linenumber AS label, count(*) AS points, round(count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey % 50), 6) AS share FROM lineitem GROUP BY 1, 2",
    "iou_by_stratum": """WITH p AS (SELECT l_returnflag, l_linenumber AS t, CASE WHEN l_partkey % 3 > 0 THEN l_linenumber ELSE (l_partkey % 7 + 1)::INT END AS g FROM lineitem), c AS (SELECT DISTINCT l_returnflag, t AS k FROM p UNION SELECT DISTINCT l_returnflag, g FROM p),
        i AS (SELECT c.l_returnflag, k, count(*) FILTER (t = k AND g = k) / count(*) FILTER (t = k OR g = k) AS iou FROM c JOIN p ON p.l_returnflag = c.l_returnflag GROUP BY 1, 2) SELECT l_returnflag, round(avg(iou), 6) AS miou FROM i GROUP BY 1""",
    "least_errors": """WITH m AS (SELECT l_orderkey AS id, l_partkey % 3 AS mode, 1.0 / (1 + l_partkey % 3) AS p, l_linenumber AS t, l_quantity / 10 AS dist FROM lineitem), b AS (SELECT id, mode, max(p) AS p, avg(dist) AS ade, arg_max(dist, t * 1000 + dist) AS fde FROM m GROUP BY 1, 2)
        SELECT id, row_number() OVER w AS k, round(min(ade) OVER w, 6) AS min_ade, round(min(fde) OVER w, 6) AS min_fde FROM b WINDOW w AS (PARTITION BY id ORDER BY p DESC, mode ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "running_mean": "SELECT event_id, round(avg(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mean FROM events",
    "track_scores": "WITH t AS (SELECT event_type, user_id, round(avg(value), 6) AS score FROM events GROUP BY 1, 2) SELECT event_type, user_id, score, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id) AS rank FROM t QUALIFY rank <= 10",
    "user_log": "SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS seconds FROM events GROUP BY 1",
    "density_strata": f"""WITH {NODES}, f AS (SELECT frame, count(*) FILTER (status = 'moving') AS objects, count(DISTINCT type) AS types FROM nodes GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY objects, frame) / count(*) OVER () AS place, 10 * types + 0.1 * objects AS score FROM f),
        s AS (SELECT frame, (place > 0.2)::INT + (place > 0.35)::INT + (place > 0.65)::INT + (place > 0.8)::INT AS stratum, score FROM r) SELECT frame, stratum, round(score, 6) AS score, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, frame) = 1 AS leads FROM s""",
    "class_names": f"WITH {NODES}, c AS (SELECT ([{_CAT}])[id % {len(CATEGORIES)} + 1] AS category FROM nodes), d AS (SELECT category, {_DET} AS detection FROM c) SELECT category, detection, CASE WHEN detection NOT IN ('barrier', 'traffic_cone', 'construction_vehicle') THEN detection END AS tracking, count(*) AS n FROM d GROUP BY 1, 2, 3",
    "projected_boxes": f"""WITH {NODES}, k AS (SELECT unnest([[1, 1, 1], [1, -1, 1], [1, -1, -1], [1, 1, -1], [-1, 1, 1], [-1, -1, 1], [-1, -1, -1], [-1, 1, -1]]) AS s), c AS (SELECT id, x + 12 + height * s[1] * cos(radians(yaw)) - height / 2 * s[2] * sin(radians(yaw)) AS z, -(y + height * s[1] * sin(radians(yaw)) + height / 2 * s[2] * cos(radians(yaw))) AS x, -height / 2 * s[3] AS y FROM nodes, k),
        i AS (SELECT id, x / z * 1266 + 800 AS u, y / z * 1266 + 450 AS v, z FROM c), b AS (SELECT id, bool_or(u > 0 AND u < 1600 AND v > 0 AND v < 900 AND z > 1) AS a, bool_and(u > 0 AND u < 1600 AND v > 0 AND v < 900 AND z > 1) AS w, bool_and(z > 0.1) AS f, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM i GROUP BY 1)
        SELECT id, w AND f AS whole, round(greatest(u0, 0), 4) AS u0, round(greatest(v0, 0), 4) AS v0, round(least(u1, 1600), 4) AS u1, round(least(v1, 900), 4) AS v1 FROM b WHERE a AND f""",
    "destinations": f"""WITH {NODES}, d AS (SELECT id, radians(42.336849) AS p, radians(((degrees(atan2(x, y)) % 360) + 360) % 360) AS b, sqrt(x * x + y * y) / 6378137 AS d FROM nodes), q AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS q FROM d)
        SELECT id, round(degrees(q), 9) AS lat, round(-71.057854 + degrees(atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))), 9) AS lon FROM q""",
    "turned_headings": f"WITH {NODES}, n AS (SELECT id, yaw, lead(yaw) OVER (PARTITION BY frame ORDER BY id) AS after FROM nodes), t AS (SELECT id, yaw + {_TURN.format('yaw', 'after')} / 3 AS a FROM n) SELECT id, round(((a + 180) % 360 + 360) % 360 - 180, 6) AS yaw FROM t",
    "bare_answers": f"""WITH q AS (SELECT text, lower(text) AS l, {_NORMALISED} AS q FROM conversations), f AS (SELECT text, l, CASE {_FAMILY} ELSE 'general' END AS family FROM q)
        SELECT family, CASE WHEN family IN ('exist', 'comparison') THEN CASE WHEN contains(l, 'yes') OR contains(l, 'visible') OR contains(l, 'found') THEN 'yes' ELSE 'no' END WHEN family = 'count' THEN coalesce(nullif(regexp_extract(text, '\\b(\\d+)\\b', 1), ''), '0')
          WHEN family = 'status' THEN CASE WHEN contains(l, 'stopped') OR contains(l, 'stationary') OR contains(l, 'not moving') THEN 'stopped' WHEN contains(l, 'parked') THEN 'parked' WHEN contains(l, 'moving') OR contains(l, 'driving') OR contains(l, 'running') THEN 'moving' WHEN contains(l, 'with rider') OR contains(l, 'with_rider') THEN 'with rider' WHEN contains(l, 'without rider') OR contains(l, 'without_rider') THEN 'without rider' WHEN contains(l, 'standing') THEN 'standing' ELSE trim(text) END
          WHEN family = 'object' THEN CASE WHEN contains(l, 'car') THEN 'car' WHEN contains(l, 'truck') THEN 'truck' WHEN contains(l, 'bus') THEN 'bus' WHEN contains(l, 'bicycle') THEN 'bicycle' WHEN contains(l, 'pedestrian') THEN 'pedestrian' WHEN contains(l, 'ego') THEN 'ego' WHEN contains(l, 'barrier') THEN 'barrier' WHEN contains(l, 'motorcycle') THEN 'motorcycle' WHEN contains(l, 'trailer') THEN 'trailer' ELSE trim(text) END END AS answer, count(*) AS n FROM f GROUP BY 1, 2""",
    "phrases": f"""WITH {NODES}, n AS (SELECT type, replace(type, '_', ' ') AS k FROM nodes) SELECT type, CASE WHEN k = 'bus' THEN 'buses' ELSE k || 's' END AS many, 'a ' || k AS one, type || '_count' AS name, count(*) AS n FROM n GROUP BY ALL""",
    "inner_objects": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "point_lookup": "SELECT p_partkey, p_name FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part WHERE p_partkey = 17)",
    "two_fact_frequency": "WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM c FULL JOIN s USING (nation)",
}
