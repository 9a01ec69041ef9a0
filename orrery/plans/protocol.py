"""Whole evaluations, from boxes and tracks that Spark derives from lines and events, to the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import detection, panoptic, tracking
from orrery.session import read_table

#: The ten classes that are evaluated.
DETECTED = tuple(dict.fromkeys(T.DETECTION_CLASSES.values()))


def _boxes(spark, sf_dir):
    """Lines as boxes of ten classes in samples of eight orders, and noisy, partly missing and partly false detections of them: one table, see ``detection.together``."""
    # lines are dealt once, by sample: what is grouped below stays where it is, and truths and detections are made of the same row
    li = read_table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 8").alias("sample"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    li = li.repartition("sample").groupBy("sample", "l_orderkey", "l_linenumber")
    li = li.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"), F.round(F.max("l_extendedprice") * 100).cast("bigint").alias("e"), F.min("l_discount").alias("d"), F.min("l_returnflag").alias("f"))
    base = li.select("sample", F.element_at(F.array(*[F.lit(c) for c in DETECTED]), (F.col("p") % 10 + 1).cast("int")).alias("class"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box"), "p", "s", "q", "e", "d", "f", "l_linenumber")
    base = base.withColumns({"x": F.col("p") % 31 + F.col("q") / 100, "y": F.col("s") % 13 + F.col("d") * 3, "length": 1 + F.col("q") / 10, "width": 1 + F.col("p") % 5 / 4, "height": F.lit(1.5), "yaw": (F.col("p") * 7 % 360 - 180).cast("double")})
    columns = {c: F.col(c) for c in detection.BOX[:7]}
    truth = columns | {"vx": F.when(F.col("p") % 11 > 0, F.col("q") / 10), "vy": F.col("d") * 10, "attribute": F.when(F.col("p") % 4 == 1, "moving").when(F.col("p") % 4 > 1, "stopped"), "score": F.lit(None).cast("double"), "is_truth": F.lit(True)}
    noisy = columns | {
        "x": F.col("x") + (F.col("q") % 9 - 4) * 0.3, "y": F.col("y") + (F.col("e") % 7 - 3) * 0.25, "length": F.col("length") * 1.1, "width": F.col("width") * (1 + F.col("s") % 3 / 10),
        "yaw": F.col("yaw") + (F.col("e") % 40 - 20) * 3, "vx": F.col("q") / 10 + F.col("s") % 5 / 10, "vy": F.col("d") * 10, "attribute": F.when(F.col("s") % 3 == 0, "moving").otherwise("stopped"), "score": F.col("e") % 997 / 1000, "is_truth": F.lit(False),
    }
    kept = noisy | {"box": F.col("box") * 2}
    false = noisy | {"box": F.col("box") * 2 + 1, "x": noisy["x"] + 6, "score": F.col("e") % 613 / 1000}
    made = lambda of: F.struct(*[c.alias(n) for n, c in of.items()])
    boxes = F.array(made(truth), F.when(F.expr("f <> 'A' or p % 3 = 0"), made(kept)), F.when(F.col("l_linenumber") == 1, made(false)))
    return base.select("sample", "class", F.explode(boxes).alias("b")).where("b is not null").select("sample", "class", "b.*")


def detection_protocol(spark, sf_dir):
    """AP at four distances and five errors of each class, and the score of all."""
    return detection.report_of(_boxes(spark, sf_dir), DETECTED)


def detection_matches(spark, sf_dir):
    """Matches of every class at every threshold."""
    m = detection.matched_boxes(_boxes(spark, sf_dir)).where("hit")
    return m.select("class", "threshold", "sample", "box", "gt", *[F.round(e, 6).alias(e) for e in detection.ERRORS])


def _tracks(spark, sf_dir):
    """Events as ten tracks a scene, 40 frames long, with gaps; guesses lose frames, swap ids half way and have false tracks."""
    e = read_table(spark, sf_dir, "events").select(F.expr("event_id div 400").alias("scene"), F.expr("event_id % 400 div 10").alias("t"), (F.col("event_id") % 10).alias("track"), "event_type", "value", "event_id")
    places = e.withColumns({"x": F.col("track") * 3.0 + F.col("t") * 0.2, "y": F.col("t") * 0.5, "class": F.element_at(F.array(*[F.lit(c) for c in TRACKED]), (F.col("track") % 3 + 1).cast("int"))})
    frames = e.select("scene", "t").distinct()
    truth = places.where("event_type <> 'error'")
    noise = (F.col("value") * 100).cast("bigint") % 11 / 10 - 0.5
    seen = places.where("event_type not in ('purchase', 'error') or track = 4").withColumns({"x": F.col("x") + noise, "y": F.col("y") + noise / 2, "score": (F.col("event_id") * 7919 % 1000) / 1000})
    swapped = seen.withColumn("track", F.when(F.col("t") < 20, F.col("track")).otherwise((F.col("track") + 3) % 10 + 100))
    false = seen.where("track < 2").withColumns({"track": F.col("track") + 200, "x": F.col("x") + 40, "score": F.col("score") / 2})
    columns = ["scene", "t", "class", "track", "x", "y"]
    return truth.select(*columns), swapped.unionByName(false).select(*columns, "score"), frames


#: Of the three classes of the stand-in tracks, and one that has none.
TRACKED = ("car", "pedestrian", "bus")


def tracking_protocol(spark, sf_dir):
    """AMOTA, AMOTP and the counts at the best threshold."""
    truth, guess, frames = _tracks(spark, sf_dir)
    return tracking.track_report(truth, guess, frames, (*TRACKED, "trailer"))


def track_filling(spark, sf_dir):
    """True tracks with their missing frames filled."""
    truth, _, frames = _tracks(spark, sf_dir)
    return tracking.filled_tracks(truth, frames).select("scene", "i", "class", "track", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def mot_counts(spark, sf_dir):
    """CLEAR-MOT measures of all guesses, by class, without a threshold."""
    truth, guess, frames = _tracks(spark, sf_dir)
    boxes = tracking.filled_tracks(truth, frames).withColumn("gt", F.lit(True)).unionByName(tracking.filled_tracks(guess, frames).withColumn("gt", F.lit(False)))
    by = tracking.threshold_measures(tracking.associated(boxes, None))
    return by.drop("threshold").select("class", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in tracking.MEASURES])


QUERIES = {f.__name__: f for f in (detection_protocol, detection_matches, tracking_protocol, track_filling, mot_counts)}

_LIST = ", ".join(f"'{c}'" for c in DETECTED)
_MATCH = f"""li AS (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q, round(max(l_extendedprice) * 100)::BIGINT AS e, min(l_discount) AS d, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
  b AS (SELECT *, o // 8 AS sample, ([{_LIST}])[p % 10 + 1] AS class, o * 10 + l AS box, p % 31 + q / 100 AS x, s % 13 + d * 3 AS y, 1 + q / 10 AS len, 1 + p % 5 / 4 AS wid, (p * 7 % 360 - 180)::DOUBLE AS yaw FROM li),
  tr AS (SELECT sample, class, box, x, y, len, wid, yaw, CASE WHEN p % 11 > 0 THEN q / 10 END AS vx, d * 10 AS vy, CASE WHEN p % 4 = 1 THEN 'moving' WHEN p % 4 > 1 THEN 'stopped' END AS att FROM b),
  no AS (SELECT *, x + (q % 9 - 4) * 0.3 AS nx, y + (e % 7 - 3) * 0.25 AS ny, len * 1.1 AS nlen, wid * (1 + s % 3 / 10) AS nwid, yaw + (e % 40 - 20) * 3 AS nyaw, q / 10 + s % 5 / 10 AS nvx, d * 10 AS nvy, CASE WHEN s % 3 = 0 THEN 'moving' ELSE 'stopped' END AS natt FROM b),
  gu AS (SELECT sample, class, box * 2 AS box, nx, ny, nlen, nwid, nyaw, nvx, nvy, natt, e % 997 / 1000 AS score FROM no WHERE f <> 'A' OR p % 3 = 0
    UNION ALL SELECT sample, class, box * 2 + 1, nx + 6, ny, nlen, nwid, nyaw, nvx, nvy, natt, e % 613 / 1000 FROM no WHERE l = 1),
  th(th) AS (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)),
  od AS (SELECT *, row_number() OVER (PARTITION BY sample, class ORDER BY score DESC, box DESC) AS i FROM gu),
  nr AS (SELECT od.sample, od.class, od.i, th, list(tr.box ORDER BY sqrt((x - nx) ** 2 + (y - ny) ** 2), tr.box) FILTER (sqrt((x - nx) ** 2 + (y - ny) ** 2) < th) AS near
    FROM od CROSS JOIN th LEFT JOIN tr ON tr.sample = od.sample AND tr.class = od.class GROUP BY 1, 2, 3, 4),
  go AS (SELECT sample, class, th, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS got FROM (SELECT DISTINCT sample, class FROM gu), th
    UNION ALL SELECT sample, class, th, i, list_append(taken, got), got FROM (SELECT go.sample, go.class, go.th, nr.i, go.taken, (list_filter(nr.near, lambda v: NOT list_contains(go.taken, v)))[1] AS got FROM go JOIN nr ON nr.sample = go.sample AND nr.class = go.class AND nr.th = go.th AND nr.i = go.i + 1)),
  m AS (SELECT od.*, th, got, CASE WHEN got IS NULL THEN 0 ELSE 1 END AS hit, sqrt((x - nx) ** 2 + (y - ny) ** 2) AS translation, 1 - least(len, nlen) * least(wid, nwid) / (len * wid + nlen * nwid - least(len, nlen) * least(wid, nwid)) AS scale,
    radians(abs(CASE WHEN od.class = 'barrier' THEN ((yaw - nyaw + 90) % 180 + 180) % 180 - 90 ELSE ((yaw - nyaw + 180) % 360 + 360) % 360 - 180 END)) AS orientation, sqrt((vx - nvx) ** 2 + (vy - nvy) ** 2) AS velocity, CASE WHEN att IS NOT NULL THEN (att <> natt)::INT::DOUBLE END AS attribute
    FROM od JOIN go USING (sample, class, i) LEFT JOIN tr ON tr.sample = od.sample AND tr.class = od.class AND tr.box = got)"""
_E = detection.ERRORS
_W = "PARTITION BY class, th ORDER BY score DESC, box DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_POINT = ", ".join(f"round(avg(CASE WHEN c0 IS NULL THEN m1_{e} WHEN c1 IS NULL OR conf <= c0 THEN m0_{e} ELSE m0_{e} + (m1_{e} - m0_{e}) * (conf - c0) / (c1 - c0) END), 6) AS {e}" for e in _E)
_UNDEFINED = {e: [c for c, x in detection.UNDEFINED.items() if e in x] for e in _E}
_SHOWN = ", ".join(f"CASE WHEN class IN ({', '.join(repr(c) for c in _UNDEFINED[e])}) THEN NULL ELSE coalesce({e}, 1.0) END AS {e}" if _UNDEFINED[e] else f"coalesce({e}, 1.0) AS {e}" for e in _E)

ORACLE = {
    "detection_matches": f"WITH RECURSIVE {_MATCH} SELECT class, th AS threshold, sample, box, got AS gt, {', '.join(f'round({e}, 6) AS {e}' for e in _E)} FROM m WHERE hit = 1",
    "detection_protocol": f"""WITH RECURSIVE {_MATCH},
  n AS (SELECT class, count(*) AS n FROM tr GROUP BY 1), c AS (SELECT m.*, count(*) OVER w AS k, sum(hit) OVER w / count(*) OVER w AS pr, sum(hit) OVER w / n AS r FROM m JOIN n USING (class) WINDOW w AS ({_W})),
  q AS (SELECT class, th, r, arg_min(pr, k) AS p_first, arg_max(pr, k) AS p_last, arg_min(score, k) AS s_first, arg_max(score, k) AS s_last FROM c GROUP BY 1, 2, 3), bin AS (SELECT class, th, z, z / 100.0::DOUBLE AS pos FROM n, th, range(0, 101) t(z)),
  lo AS (SELECT bin.class, bin.th, z, pos, max(r) AS r0, arg_max(p_last, r) AS p0, arg_max(s_last, r) AS s0 FROM bin LEFT JOIN q ON q.class = bin.class AND q.th = bin.th AND r <= pos + 1e-11 GROUP BY 1, 2, 3, 4),
  hi AS (SELECT bin.class, bin.th, z, min(r) AS r1, arg_min(p_first, r) AS p1, arg_min(s_first, r) AS s1 FROM bin JOIN q ON q.class = bin.class AND q.th = bin.th AND r > pos + 1e-11 GROUP BY 1, 2, 3),
  v AS (SELECT class, th, z, CASE WHEN r0 IS NULL THEN p1 WHEN abs(pos - r0) < 1e-11 THEN p0 WHEN r1 IS NULL THEN 0 ELSE p0 + (p1 - p0) * (pos - r0) / (r1 - r0) END AS pr,
    CASE WHEN r0 IS NULL THEN s1 WHEN abs(pos - r0) < 1e-11 THEN s0 WHEN r1 IS NULL THEN 0 ELSE s0 + (s1 - s0) * (pos - r0) / (r1 - r0) END AS conf FROM lo LEFT JOIN hi USING (class, th, z)),
  ap AS (SELECT class, th, round(sum(greatest(pr - 0.1, 0)) FILTER (z >= 11) / 90 / 0.9, 6) AS ap FROM v GROUP BY 1, 2),
  h AS (SELECT class, score, k, {', '.join(f'CASE WHEN count({e}) OVER (PARTITION BY class) = 0 THEN 1 ELSE coalesce(avg({e}) OVER w, 0) END AS m_{e}' for e in _E)} FROM c WHERE hit = 1 AND th = 2.0 WINDOW w AS (PARTITION BY class ORDER BY score DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  f AS (SELECT v.class, z, conf, max(h.score) AS c0, {', '.join(f'arg_max(m_{e}, (h.score, -h.k)) AS m0_{e}' for e in _E)} FROM v LEFT JOIN h ON h.class = v.class AND h.score <= conf WHERE conf <> 0 AND z >= 11 AND th = 2.0 GROUP BY 1, 2, 3),
  g AS (SELECT f.*, min(h.score) AS c1, {', '.join(f'arg_min(m_{e}, (h.score, -h.k)) AS m1_{e}' for e in _E)} FROM f LEFT JOIN h ON h.class = f.class AND h.score > conf GROUP BY ALL),
  er AS (SELECT class, {_POINT} FROM g GROUP BY 1),
  wide AS (SELECT class, coalesce(max(ap) FILTER (th = 0.5), 0) AS ap_0_5, coalesce(max(ap) FILTER (th = 1.0), 0) AS ap_1, coalesce(max(ap) FILTER (th = 2.0), 0) AS ap_2, coalesce(max(ap) FILTER (th = 4.0), 0) AS ap_4 FROM (SELECT unnest([{_LIST}]) AS class) LEFT JOIN ap USING (class) GROUP BY 1),
  rows AS (SELECT class, (ap_0_5 + ap_1 + ap_2 + ap_4) / 4 AS ap, ap_0_5, ap_1, ap_2, ap_4, {_SHOWN} FROM wide LEFT JOIN er USING (class)),
  total AS (SELECT avg(ap) AS ap, avg(ap_0_5) AS ap_0_5, avg(ap_1) AS ap_1, avg(ap_2) AS ap_2, avg(ap_4) AS ap_4, {', '.join(f'avg({e}) AS {e}' for e in _E)} FROM rows)
SELECT class, round(ap, 6) AS ap, ap_0_5, ap_1, ap_2, ap_4, {', '.join(f'round({e}, 6) AS {e}' for e in _E)}, NULL::DOUBLE AS score FROM rows
UNION ALL SELECT NULL, round(ap, 4), round(ap_0_5, 4), round(ap_1, 4), round(ap_2, 4), round(ap_4, 4), {', '.join(f'round({e}, 4)' for e in _E)}, round((5 * ap + {' + '.join(f'greatest(0, 1 - {e})' for e in _E)}) / 10, 4) FROM total""",
    "track_filling": """WITH e AS (SELECT event_id // 400 AS scene, event_id % 400 // 10 AS t, event_id % 10 AS track, event_type FROM events), fr AS (SELECT scene, t, row_number() OVER (PARTITION BY scene ORDER BY t) AS i FROM (SELECT DISTINCT scene, t FROM e)),
  b AS (SELECT e.scene, e.t, i, track, track * 3.0 + e.t * 0.2::DOUBLE AS x, e.t * 0.5::DOUBLE AS y FROM e JOIN fr ON fr.scene = e.scene AND fr.t = e.t WHERE event_type <> 'error'),
  s AS (SELECT scene, track, min(i) AS a, max(i) AS z FROM b GROUP BY 1, 2), g AS (SELECT s.scene, s.track, fr.i, fr.t FROM s JOIN fr ON fr.scene = s.scene AND fr.i BETWEEN a AND z),
  j AS (SELECT g.*, b.x, b.y, lag(CASE WHEN b.t IS NOT NULL THEN {'t': b.t, 'x': b.x, 'y': b.y} END IGNORE NULLS) OVER w AS l, lead(CASE WHEN b.t IS NOT NULL THEN {'t': b.t, 'x': b.x, 'y': b.y} END IGNORE NULLS) OVER w AS r FROM g LEFT JOIN b USING (scene, track, i) WINDOW w AS (PARTITION BY g.scene, g.track ORDER BY g.i)),
  k AS (SELECT *, (r.t - t) / (r.t - l.t) AS u FROM j)
SELECT scene, i, (['car', 'pedestrian', 'bus'])[track % 3 + 1] AS class, track, round(coalesce(x, (1 - u) * l.x + u * r.x), 6) AS x, round(coalesce(y, (1 - u) * l.y + u * r.y), 6) AS y FROM k""",
}

# --- panoptic tracking

CLASSES, THINGS, FEW = [1, 2, 3, 4, 5], [1, 2, 3], 2


def _points(spark, sf_dir):
    """Lines as points of six scenes with twelve frames; class 0 is ignored, 4 and 5 are stuff."""
    li = read_table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 6).alias("scene"), (F.col("l_orderkey") % 12).alias("frame"), (F.col("l_partkey") % 6).cast("int").alias("truth_class"), F.expr("(l_partkey div 6) % 3 + 1").alias("k"), "l_linenumber", "l_quantity", "l_orderkey")
    inst = F.when(F.col("truth_class").between(1, 3), F.col("truth_class") * 10 + F.col("k")).otherwise(0)
    rows = li.withColumn("truth", inst.cast("bigint"))
    guess_class = F.when(F.col("l_linenumber") == 7, (F.col("truth_class") + 1) % 6).otherwise(F.col("truth_class")).cast("int")
    moved = F.when((F.col("frame") > 5) & (F.col("k") == 2), F.col("truth") + 100).otherwise(F.col("truth"))
    guess = F.when(F.col("truth") == 0, 0).when(F.col("l_quantity") > 42, F.lit(7)).when((F.col("frame") == 3) & (F.col("k") == 1), 0).otherwise(moved)
    return rows.select("scene", "frame", "truth_class", "truth", guess_class.alias("guess_class"), guess.cast("bigint").alias("guess"))


def panoptic_report(spark, sf_dir):
    return panoptic.panoptic_report(_points(spark, sf_dir), CLASSES, THINGS, least_points=FEW)


def panoptic_classes(spark, sf_dir):
    by = panoptic.class_tracking(panoptic.segment_counts(_points(spark, sf_dir)), CLASSES, THINGS, FEW)
    return by.select("class", "tp", "fp", "fn", "ids", *[F.round(c, 6).alias(c) for c in ("iou", "pq", "ptq", "sptq", "motsa", "smotsa", "motsp")])


def tube_association(spark, sf_dir):
    t = panoptic.tube_association(panoptic.segment_counts(_points(spark, sf_dir)), THINGS, FEW)
    return t.withColumn("association", F.round("association", 6))


def track_quality(spark, sf_dir):
    t = panoptic.track_quality(panoptic.segment_counts(_points(spark, sf_dir)), THINGS, least_points=FEW)
    return t.select("scene", "class", "truth", "frames", *[F.round(c, 6).alias(c) for c in ("association", "identity", "quality")])


QUERIES |= {f.__name__: f for f in (panoptic_report, panoptic_classes, tube_association, track_quality)}

_POINTS = f"""li AS (SELECT l_suppkey % 6 AS scene, l_orderkey % 12 AS frame, (l_partkey % 6)::INT AS tc, (l_partkey // 6) % 3 + 1 AS k, l_linenumber AS l, l_quantity AS q FROM lineitem),
  li2 AS (SELECT *, CASE WHEN tc BETWEEN 1 AND 3 THEN tc * 10 + k ELSE 0 END AS tr, CASE WHEN l = 7 THEN (tc + 1) % 6 ELSE tc END AS gc FROM li),
  p AS (SELECT scene, dense_rank() OVER (PARTITION BY scene ORDER BY frame) AS i, tc, tr, gc, CASE WHEN tr = 0 THEN 0 WHEN q > 42 THEN 7 WHEN frame = 3 AND k = 1 THEN 0 WHEN frame > 5 AND k = 2 THEN tr + 100 ELSE tr END AS gu FROM li2),
  s AS (SELECT scene, i, tc, tr, gc, gu, count(*) AS n FROM p WHERE tc <> 0 GROUP BY ALL),
  a AS (SELECT scene, i, tc AS class, tr, sum(n) AS na FROM s GROUP BY 1, 2, 3, 4), b AS (SELECT scene, i, gc AS class, gu, sum(n) AS nb FROM s GROUP BY 1, 2, 3, 4),
  m AS (SELECT scene, i, tc AS class, tr, gu, sum(n) AS n FROM s WHERE tc = gc GROUP BY 1, 2, 3, 4, 5),
  h AS (SELECT m.*, n / (na + nb - n) AS iou FROM m JOIN a USING (scene, i, class, tr) JOIN b USING (scene, i, class, gu) WHERE n / (na + nb - n) > 0.5),
  w AS (SELECT h.*, coalesce(h.class <= 3 AND z.gu <> h.gu, false) AS sw FROM h LEFT JOIN h z ON z.scene = h.scene AND z.class = h.class AND z.tr = h.tr AND z.i = h.i - 1),
  c AS (SELECT class, count(*) AS tp, sum(iou) AS iou, count(*) FILTER (sw) AS ids, coalesce(sum(iou) FILTER (sw), 0) AS soft FROM w GROUP BY 1),
  fn AS (SELECT class, count(*) AS fn FROM a WHERE na >= {FEW} AND NOT EXISTS (FROM h WHERE h.scene = a.scene AND h.i = a.i AND h.class = a.class AND h.tr = a.tr) GROUP BY 1),
  fp AS (SELECT class, count(*) AS fp FROM b WHERE nb >= {FEW} AND NOT EXISTS (FROM h WHERE h.scene = b.scene AND h.i = b.i AND h.class = b.class AND h.gu = b.gu) GROUP BY 1),
  k AS (SELECT x.class, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(ids, 0) AS ids, coalesce(iou, 0) AS iou, coalesce(soft, 0) AS soft FROM (SELECT unnest([1, 2, 3, 4, 5])::INT AS class) x LEFT JOIN c USING (class) LEFT JOIN fn USING (class) LEFT JOIN fp USING (class)),
  e AS (SELECT *, coalesce(iou / nullif(tp + 0.5 * fp + 0.5 * fn, 0), 0) AS pq, coalesce((iou - ids) / nullif(tp + 0.5 * fp + 0.5 * fn, 0), 0) AS ptq, coalesce((iou - soft) / nullif(tp + 0.5 * fp + 0.5 * fn, 0), 0) AS sptq,
    CASE WHEN class <= 3 AND tp + fn > 0 THEN (tp - fp - ids) / (tp + fn) END AS motsa, CASE WHEN class <= 3 AND tp + fn > 0 THEN (iou - fp - ids) / (tp + fn) END AS smotsa, CASE WHEN class <= 3 AND tp + fn > 0 THEN coalesce(iou / nullif(tp, 0), 0) END AS motsp FROM k),
  big AS (SELECT scene, i, class AS tc, tr, na FROM a WHERE class <= 3 AND na > {FEW}), tube AS (SELECT scene, tc, tr, sum(na) AS points FROM big GROUP BY 1, 2, 3),
  gt AS (SELECT scene, gu, sum(nb) AS nb FROM b WHERE class BETWEEN 1 AND 3 AND nb > {FEW} GROUP BY 1, 2), bo AS (SELECT scene, tc, tr, gu, sum(n) AS n FROM s SEMI JOIN big USING (scene, i, tc, tr) GROUP BY 1, 2, 3, 4),
  tu AS (SELECT scene, tc AS class, tr AS truth, points, coalesce(sum(n * n / (points + nb - n)), 0) / points AS association FROM tube LEFT JOIN (bo JOIN gt USING (scene, gu)) USING (scene, tc, tr) GROUP BY 1, 2, 3, 4),
  al AS (SELECT scene, i, gu, sum(n) AS n FROM s GROUP BY 1, 2, 3), pr AS (SELECT s.scene, s.i, s.tc, s.tr, s.gu, na, sum(s.n) AS n FROM s JOIN big USING (scene, i, tc, tr) GROUP BY 1, 2, 3, 4, 5, 6),
  me AS (SELECT pr.scene, pr.i, pr.tc, pr.tr, nullif(pr.gu, 0) AS gu FROM pr JOIN al USING (scene, i, gu) WHERE pr.n / (na + al.n - pr.n) > 0.5),
  st AS (SELECT scene, i, tc, tr, gu, row_number() OVER o AS r, lag(gu) OVER o AS was FROM big LEFT JOIN me USING (scene, i, tc, tr) WINDOW o AS (PARTITION BY scene, tc, tr ORDER BY i)),
  tk AS (SELECT scene, tc, tr, count(*) AS frames, count(*) FILTER (r > 1 AND (was IS NULL OR gu IS DISTINCT FROM was)) AS lost FROM st GROUP BY 1, 2, 3),
  ia AS (SELECT scene, gu, count(*) AS k FROM al WHERE n > {FEW} GROUP BY 1, 2), hd AS (SELECT scene, tc, tr, gu, count(*) AS c FROM st WHERE gu IS NOT NULL GROUP BY 1, 2, 3, 4),
  tq AS (SELECT scene, tc AS class, tr AS truth, frames, coalesce(sum(c * c / (frames + coalesce(k - c, 0))), 0) / frames AS association, CASE WHEN frames = 1 THEN 1.0 ELSE 1 - lost / (frames - 1) END AS identity FROM tk LEFT JOIN (hd LEFT JOIN ia USING (scene, gu)) USING (scene, tc, tr) GROUP BY scene, tc, tr, frames, lost),
  ov AS (SELECT x.class, coalesce(sum(n) FILTER (tc = gc) / sum(n), 0) AS iou FROM (SELECT unnest([1, 2, 3, 4, 5])::INT AS class) x LEFT JOIN s ON tc = x.class OR gc = x.class GROUP BY 1)"""
ORACLE |= {
    "panoptic_classes": f"WITH {_POINTS} SELECT class, tp, fp, fn, ids, {', '.join(f'round({c}, 6) AS {c}' for c in ('iou', 'pq', 'ptq', 'sptq', 'motsa', 'smotsa', 'motsp'))} FROM e",
    "tube_association": f"WITH {_POINTS} SELECT scene, class, truth, points::BIGINT AS points, round(association, 6) AS association FROM tu",
    "track_quality": f"WITH {_POINTS} SELECT scene, class, truth, frames, round(association, 6) AS association, round(identity, 6) AS identity, round(sqrt(association * identity), 6) AS quality FROM tq",
    "panoptic_report": f"""WITH {_POINTS}, r AS (SELECT avg(ptq) FILTER (tp + fn > 0) AS ptq, avg(sptq) FILTER (tp + fn > 0) AS sptq, avg(motsa) AS motsa, avg(smotsa) AS smotsa, avg(motsp) AS motsp, avg(pq) AS pq, (SELECT avg(association) FROM tu) AS association, (SELECT avg(iou) FROM ov) AS class_iou, (SELECT avg(sqrt(association * identity)) FROM tq) AS tq FROM e)
SELECT round(ptq, 6) AS ptq, round(sptq, 6) AS sptq, round(motsa, 6) AS motsa, round(smotsa, 6) AS smotsa, round(motsp, 6) AS motsp, round(association, 6) AS association, round(class_iou, 6) AS class_iou, round(sqrt(association * class_iou), 6) AS lstq, round(pq, 6) AS pq, round(tq, 6) AS tq, round(2 * pq * tq / (pq + tq), 6) AS pat FROM r""",
}
