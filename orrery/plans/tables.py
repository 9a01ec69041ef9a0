"""Queries over tables, time chains, texts and predictions of the stand-in data."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import metrics, relational, spatial
from orrery.session import read_table, shared_dir
from orrery.streaming import coverage as streaming


def _t(spark, sf_dir, *names):
    return [read_table(spark, sf_dir, n) for n in names]


# --- foreign keys, closures, statistics


def fk_integrity(spark, sf_dir):
    """Rows without a parent, for every foreign key."""
    n, c, s, p, o, li = _t(spark, sf_dir, "nation", "customer", "supplier", "part", "orders", "lineitem")
    checks = [("customer.nation", c, "c_nationkey", n, "n_nationkey"), ("supplier.nation", s, "s_nationkey", n, "n_nationkey"), ("orders.customer", o, "o_custkey", c, "c_custkey"), ("lineitem.orders", li, "l_orderkey", o, "o_orderkey"), ("lineitem.part", li, "l_partkey", p, "p_partkey"), ("lineitem.supplier", li, "l_suppkey", s, "s_suppkey")]
    out = None
    for name, child, key, parent, parent_key in checks:
        one = relational.dangling(child, key, parent, parent_key).agg(F.count("*").alias("n")).select(F.lit(name).alias("fk"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def shortcut_join(spark, sf_dir):
    """Two-hop shortcut: lineitem to region of its customer."""
    r, n, c, o, li = _t(spark, sf_dir, "region", "nation", "customer", "orders", "lineitem")
    # lines are summed by order first, so the fact table shuffles once and narrow
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    by = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy("o_custkey").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))
    j = by.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey").join(n, "n_nationkey").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


def subset_closure(spark, sf_dir):
    """Rows that a subset of customers needs in each dependent table."""
    c, o, li, p = _t(spark, sf_dir, "customer", "orders", "lineitem", "part")
    got = relational.closure(c.where("c_mktsegment = 'BUILDING'"), [(o, "o_custkey", "c_custkey"), (li, "l_orderkey", "o_orderkey"), (p, "p_partkey", "l_partkey")])
    out = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in zip(("customer", "orders", "lineitem", "part"), got, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def category_stats(spark, sf_dir):
    s = relational.category_stats(read_table(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice")
    return s.select("p_brand", "n", *[F.round(c, 4).alias(c) for c in s.columns[2:]])


def decorated_orders(spark, sf_dir):
    """Reverse index: the sorted line numbers and return flags of each order of the first priority."""
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    agg = li.groupBy("l_orderkey").agg(F.concat_ws("|", F.array_sort(F.collect_list("l_linenumber"))).alias("lines"), F.concat_ws("|", F.array_sort(F.collect_set("l_returnflag"))).alias("flags"))
    return o.where("o_orderpriority = '1-URGENT'").join(agg, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines", "flags")


def grouping_levels(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def pricing_summary(spark, sf_dir):
    price, disc = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return read_table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(price * disc), 2).alias("discounted"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def top_orders(spark, sf_dir):
    """The three largest orders of each customer segment, ties by key."""
    o, c = _t(spark, sf_dir, "orders", "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_mktsegment", "rank", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


def split_frames(spark, sf_dir):
    """A reproducible shuffle of suppliers, cut into four even parts."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", relational.seeded_order(F.col("s_suppkey"), 42).alias("h"))
    return relational.tiles(s, 4, F.substring("h", 1, 3), "h", "s_suppkey").select("s_suppkey", "part")


def set_operations(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    a, b = c.select(F.col("c_nationkey").alias("k")).distinct(), s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    kinds = [("both", a.intersect(b)), ("only customers", a.exceptAll(b)), ("either", a.union(b).distinct())]
    out = [d.agg(F.count("*").alias("n"), F.sum("k").alias("s")).select(F.lit(n).alias("kind"), "n", F.col("s").cast("bigint").alias("s")) for n, d in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- time chains


def _us(column: str):
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").withColumn("us", _us("ts"))


def prev_next(spark, sf_dir):
    return relational.neighbours(_events(spark, sf_dir), "user_id", ["us"], "event_id").select("event_id", "prev_event_id", "next_event_id")


def velocity(spark, sf_dir):
    v = relational.central_difference(_events(spark, sf_dir), "user_id", "us", "value", 86400.0)
    return v.select("event_id", F.round(F.col("rate") * 1e6, 3).alias("rate"))


def fragments(spark, sf_dir):
    """Runs of consecutive errors of a user: how many and how long."""
    runs = relational.islands(_events(spark, sf_dir), "user_id", "us", F.col("event_type") == "error")
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def session_rows(spark, sf_dir):
    s = relational.sessions(_events(spark, sf_dir), "user_id", "us", 7200.0)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def as_of_join(spark, sf_dir):
    """Each purchase with the user's latest click at or before it."""
    e = _events(spark, sf_dir).select("user_id", "us", "event_id", "event_type", "value")
    left = e.where("event_type = 'purchase'").select("user_id", "us", "event_id")
    right = e.where("event_type = 'click'").select("user_id", "us", "value")
    return relational.as_of(left, right, "user_id", "us", "value").select("event_id", F.round("asof_value", 6).alias("value"))


def interpolated(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return relational.bracketed(e, "user_id", "us", "value").where("event_type = 'error'").select("event_id", F.round("filled", 4).alias("filled"))


def past_slice(spark, sf_dir):
    """Up to three earlier events of a user within a day."""
    w = Window.partitionBy("user_id").orderBy("us").rowsBetween(-3, -1)
    e = _events(spark, sf_dir).withColumn("past", F.collect_list(F.struct("us", "event_id")).over(w))
    ids = F.transform(F.filter("past", lambda p: F.col("us") - p["us"] <= 86_400_000_000), lambda p: p["event_id"])
    return e.select("event_id", F.concat_ws("|", ids).alias("past"))


def windows_tumbling(spark, sf_dir):
    w = streaming.windowed_counts(read_table(spark, sf_dir, "events"), "6 hours")
    return w.select(_us("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def windows_session(spark, sf_dir):
    w = streaming.session_counts(read_table(spark, sf_dir, "events"), "2 hours")
    return w.select("user_id", _us("start").alias("start_us"), "n")


def props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


def timing_stats(spark, sf_dir):
    p = F.percentile("value", F.lit(0.95))
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.round(F.min("value"), 6).alias("least"), F.round(p, 6).alias("p95"))


def majority_type(spark, sf_dir):
    return relational.majority(_events(spark, sf_dir), "user_id", "event_type", "us")


# --- texts and answers


def question_families(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.groupBy("role", T.question_family(T.normalised_question(F.col("text"))).alias("family")).agg(F.count("*").alias("n"))


def token_counts(spark, sf_dir):
    words = read_table(spark, sf_dir, "conversations").select("role", F.explode(T.tokens(F.col("text"))).alias("word"))
    counted = words.groupBy("role", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("role").orderBy(F.desc("n"), "word")
    return counted.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("role", "word", "n", "rank")


def vocabulary(spark, sf_dir):
    """Word ids in the order of first appearance, after three reserved ids."""
    return _vocabulary(_benchmark_words(spark, sf_dir))


def _benchmark_words(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))


def _vocabulary(words):
    first = words.groupBy("word").agg(F.min(F.struct("item_id", "pos")).alias("at")).select("word", "at.*")
    return relational.ranked(first, F.expr("item_id div 1000"), "item_id", "pos").select("word", (F.col("rank") + 2).alias("id"))


def encoded_items(spark, sf_dir):
    """The items as ids of the vocabulary, cut or padded with zeros to thirty."""
    words = _benchmark_words(spark, sf_dir)
    ids = words.join(_vocabulary(words), "word").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("w"))
    padded = T.padded(F.transform("w", lambda x: x["id"]), 30, 0)
    return ids.select("item_id", F.concat_ws("|", padded.cast("array<string>")).alias("ids"))


def accuracy_levels(spark, sf_dir):
    """Accuracy of a guess (long turns are the assistant's) by role and turn."""
    c = read_table(spark, sf_dir, "conversations")
    guess = F.when(F.char_length("text") > 200, "assistant").otherwise("user")
    return metrics.accuracy(c, T.same_answer(guess, F.col("role")), "role", "turn")


def status_inference(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    attribute = F.concat(F.lit("vehicle."), F.element_at(F.array(*[F.lit(a) for a in ("moving", "parked", "x", "with_rider", "without_rider", "standing")]), (F.col("event_id") % 6 + 1).cast("int")))
    return e.groupBy(T.inferred_status(attribute, F.col("value") / 100).alias("status")).agg(F.count("*").alias("n"))


def page_fields(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return p.groupBy(F.substring_index(host, ".", -1).alias("suffix"), F.regexp_extract("url", r"^([a-z]+):", 1).alias("scheme")).agg(F.count("*").alias("n"), F.count_distinct(host).alias("hosts"), F.sum(F.octet_length("html").cast("bigint")).alias("bytes"))


# --- metrics


def _scored(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("class"), "event_id", F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("hit"))


def pr_curve(spark, sf_dir):
    c = metrics.precision_recall(_scored(spark, sf_dir), "class", "score", "event_id", "hit")
    return c.select("class", "event_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def average_precision(spark, sf_dir):
    return metrics.average_precision(metrics.precision_recall(_scored(spark, sf_dir), "class", "score", "event_id", "hit"), "class")


def confusion_iou(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("truth"), (F.col("l_partkey") % 7 + 1).cast("int").alias("guess"))
    return metrics.class_iou(metrics.confusion(rows, "truth", "guess", F.col("truth") == 7))


def mean_iou(spark, sf_dir):
    return metrics.mean_iou(confusion_iou(spark, sf_dir))


def panoptic(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    points = li.select((F.col("l_suppkey") % 20).alias("frame"), F.col("l_returnflag").alias("class"), (F.col("l_partkey") % 4).alias("truth"), F.when(F.col("l_orderkey") % 5 == 0, (F.col("l_orderkey") % 4)).otherwise(F.col("l_partkey") % 4).alias("guess"))
    return metrics.panoptic_quality(points)


def displacement(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    modes = li.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 3).alias("mode"), (1.0 / (1 + F.col("l_partkey") % 3)).alias("p"), F.col("l_linenumber").alias("t"), (F.col("l_quantity") / 10).alias("dist"))
    return metrics.displacement_errors(modes, 2)


def greedy_detection(spark, sf_dir):
    """Predictions (clicks) matched to truths (purchases) of the same user by closeness in value; sequential by score within a user."""
    e = read_table(spark, sf_dir, "events")
    p = e.where("event_type = 'click'").select(F.col("user_id").alias("group"), F.col("event_id").alias("pred"), F.col("value").alias("score"))
    g = e.where("event_type = 'purchase'").select(F.col("user_id").alias("group"), F.col("event_id").alias("gt"), F.col("value").alias("gv"))
    # a range join: values meet in cells of the threshold's width
    p = p.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("score") / 5) + k)))
    near = p.join(g.withColumn("cell", F.floor(F.col("gv") / 5)), ["group", "cell"]).withColumn("dist", F.abs(F.col("score") - F.col("gv"))).where("dist < 5")
    return metrics.greedy_match(near.drop("gv", "cell"), 5.0)


def track_counts(spark, sf_dir):
    """CLEAR-MOT counts of noisy copies of ten tracks a scene; a scene is 100 consecutive steps, so scenes grow in number, not in length."""
    e = read_table(spark, sf_dir, "events").withColumn("t", F.expr("event_id div 10"))
    gt = e.select(F.expr("t div 100").alias("scene"), "t", F.lit("gt").alias("kind"), "event_type", (F.col("event_id") % 10).alias("id"), (F.col("event_id") % 10 * 5.0).alias("x"), (F.col("t") * 0.1).alias("y"))
    pred = gt.where("event_type <> 'error'").select("scene", "t", F.lit("pred").alias("kind"), ((F.col("id") + F.expr("t div 200")) % 10 + 100).alias("id"), (F.col("x") + 0.3).alias("x"), "y")
    return metrics.track_events(gt.drop("event_type").unionByName(pred), 2.0).select("scene", "tp", "fp", "fn", "switches", F.round("distance", 4).alias("distance"))


# --- maps


def point_in_polygon(spark, sf_dir):
    """Suppliers by account and key in a row of overlapping diamonds."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 40).cast("double").alias("y"))
    c = F.col("poly") * 8.0
    corner = lambda dx, dy: F.struct((c + dx).alias("x"), F.lit(20.0 + dy).alias("y"))
    polygons = spark.range(12).select(F.col("id").alias("poly")).select("poly", F.array(corner(-9.5, 0.25), corner(0.0, -18.5), corner(9.5, 0.25), corner(0.0, 18.5)).alias("ring"))
    return spatial.containing_polygon(s, polygons, 10.0)


def lane_groups(spark, sf_dir):
    """Suppliers joined by lines of the same part of the largest size, as lanes by connectors."""
    li, p = _t(spark, sf_dir, "lineitem", "part")
    return _lanes(spark, li.join(p.where("p_size = 50"), F.col("l_partkey") == F.col("p_partkey")))


def lane_groups_all(spark, sf_dir):
    """Suppliers joined by lines of the same part, over all lines; recursive SQL is too slow for a twin."""
    return _lanes(spark, read_table(spark, sf_dir, "lineitem"))


def _lanes(spark, li):
    """Components of the suppliers that lines of one part link."""
    li = li.select("l_partkey", "l_suppkey").distinct()
    first = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"))
    links = li.join(first, "l_partkey").where("l_suppkey <> a").select("a", F.col("l_suppkey").alias("b"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spatial.connected_lanes(links)


_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"

QUERIES = {
    f.__name__: f
    for f in (
        fk_integrity, shortcut_join, subset_closure, category_stats, decorated_orders, grouping_levels, pricing_summary, top_orders, split_frames, set_operations, prev_next, velocity, fragments, session_rows, as_of_join, interpolated,
        past_slice, windows_tumbling, windows_session, props_json, timing_stats, majority_type, question_families, token_counts, vocabulary, encoded_items, accuracy_levels, status_inference, page_fields, pr_curve, average_precision, confusion_iou, mean_iou,
        panoptic, displacement, greedy_detection, track_counts, point_in_polygon, lane_groups, lane_groups_all,
    )
}

_TOKENS = r"string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[.,''!?\"()*#:;]', '', 'g'), '[-/]', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '\s+')"
_IOU = """m AS (SELECT l_linenumber AS truth, (l_partkey % 7 + 1)::INT AS guess, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2),
  k AS (SELECT class, sum(t) AS t, sum(g) AS g, sum(h) AS tp FROM (SELECT truth AS class, n AS t, 0 AS g, CASE WHEN truth = guess THEN n ELSE 0 END AS h FROM m UNION ALL SELECT guess, 0, n, 0 FROM m) GROUP BY 1),
  i AS (SELECT class, tp::BIGINT AS tp, (g - tp)::BIGINT AS fp, (t - tp)::BIGINT AS fn, round(tp / nullif(t + g - tp, 0), 6) AS iou FROM k)"""

# What the questions are freed of, and how they are told, in DuckDB's words.
_NORMALISED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
for _old, _new in (
    (r"\bconstruction vehicle\b", "truck"), (r"\bconstruction vehicles\b", "trucks"), (r"\bvehicle\b", "car"), (r"\bvehicles\b", "cars"), (r"\bstationary\b", "stopped"), (r"\bnot moving\b", "stopped"), (r"\bdriving\b", "moving"), (r"\brunning\b", "moving"),
    ("in front of", "to the front of"), ("in the front of", "to the front of"), ("behind", "to the back of"), ("in the back of", "to the back of"), ("to the rear of", "to the back of"), ("on the left of", "to the left of"), ("on the right of", "to the right of"),
):
    _NORMALISED = f"regexp_replace({_NORMALISED}, '{_old}', '{_new}', 'gi')"
_FAMILY = r"""
    WHEN regexp_matches(q, '^(Are|Is) (there|any)', 'i') OR regexp_matches(q, '^(Do|Does) .+ exist', 'i') OR regexp_matches(q, '^Can you see', 'i') THEN 'exist'
    WHEN regexp_matches(q, '^(How many|What number of|What is the number of)', 'i') THEN 'count'
    WHEN regexp_matches(q, '^What (is|are) the status', 'i') OR regexp_matches(q, '^What status (is|are)', 'i') OR regexp_matches(q, 'what (is|are) .+ status', 'i') THEN 'status'
    WHEN regexp_matches(q, '^What (is|are) (the .+ thing|.+ that)', 'i') OR regexp_matches(q, '^The .+ (is|are) what', 'i') OR regexp_matches(q, '(.+ is what\?|what is it\??)$', 'i') THEN 'object'
    WHEN regexp_matches(q, 'same (status |type )?as', 'i') OR regexp_matches(q, '(is|are) .+ the same', 'i') THEN 'comparison'"""

ORACLE = {
    "fk_integrity": """SELECT 'customer.nation' AS fk, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'supplier.nation', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
        UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'lineitem.supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "shortcut_join": "SELECT r_name, n_name, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "subset_closure": """WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l))
        SELECT 'customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'part', count(*) FROM p""",
    "category_stats": "SELECT p_brand, count(*) AS n, round(avg(p_size), 4) AS mean_p_size, round(stddev_pop(p_size), 4) AS std_p_size, round(avg(p_retailprice), 4) AS mean_p_retailprice, round(stddev_pop(p_retailprice), 4) AS std_p_retailprice FROM part GROUP BY 1",
    "decorated_orders": "SELECT o_orderkey, string_agg(l_linenumber::VARCHAR, '|' ORDER BY l_linenumber) AS lines, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
    "grouping_levels": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS discounted, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "top_orders": "SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY rank <= 3",
    "split_frames": "SELECT s_suppkey, ntile(4) OVER (ORDER BY md5('42:' || s_suppkey), s_suppkey) AS part FROM supplier",
    "set_operations": """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
        SELECT 'both' AS kind, count(*) AS n, sum(k)::BIGINT AS s FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only customers', count(*), sum(k)::BIGINT FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*), sum(k)::BIGINT FROM (SELECT k FROM a UNION SELECT k FROM b)""",
    "prev_next": f"WITH {_E} SELECT event_id, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)",
    "velocity": f"""WITH {_E}, n AS (SELECT event_id, lag(us) OVER w AS t0, lead(us) OVER w AS t1, us, lag(value) OVER w AS v0, lead(value) OVER w AS v1, value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
        d AS (SELECT event_id, (coalesce(t1, us) - coalesce(t0, us)) * 1e-6 AS s, coalesce(v1, value) - coalesce(v0, value) AS dv, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN 172800 ELSE 86400 END AS most FROM n)
        SELECT event_id, CASE WHEN s <= most AND s > 0 THEN round(dv / s * 1e6, 3) END AS rate FROM d""",
    "fragments": f"""WITH {_E}, a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e), g AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM a WHERE event_type = 'error'),
        r AS (SELECT user_id, count(*) AS n FROM g GROUP BY user_id, g) SELECT user_id, count(*) AS runs, max(n) AS longest FROM r GROUP BY 1""",
    "session_rows": f"""WITH {_E}, n AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)), s AS (SELECT user_id, us, sum(b) OVER (PARTITION BY user_id ORDER BY us) AS session FROM n)
        SELECT user_id, session::BIGINT AS session, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY 1, 2""",
    "as_of_join": f"WITH {_E} SELECT p.event_id, round(c.value, 6) AS value FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.us >= c.us",
    "interpolated": f"""WITH {_E}, k AS (SELECT event_id, event_type, user_id, us, CASE WHEN event_type <> 'error' THEN value END AS v FROM e),
        b AS (SELECT k.*, last_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1 FROM k
          WINDOW p AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(v0 + (v1 - v0) * ((us - t0) / (t1 - t0)), 4) AS filled FROM b WHERE event_type = 'error'""",
    "past_slice": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e) SELECT a.event_id, coalesce(string_agg(b.event_id::VARCHAR, '|' ORDER BY b.us), '') AS past
        FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 3 AND a.i - 1 AND a.us - b.us <= 86400000000 GROUP BY 1""",
    "windows_tumbling": "SELECT (epoch_us(ts) // 21600000000) * 21600000000 AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "windows_session": f"""WITH {_E}, n AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w >= 7200000000 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)), s AS (SELECT user_id, us, sum(b) OVER (PARTITION BY user_id ORDER BY us) AS g FROM n)
        SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, g""",
    "props_json": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS largest FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1",
    "timing_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most, round(min(value), 6) AS least, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "majority_type": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_ts) = 1",
    "question_families": f"WITH q AS (SELECT role, {_NORMALISED} AS q FROM conversations) SELECT role, CASE {_FAMILY} ELSE 'general' END AS family, count(*) AS n FROM q GROUP BY 1, 2",
    "encoded_items": f"""WITH t AS (SELECT item_id, list_filter({_TOKENS}, lambda x: x <> '') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t), f AS (SELECT word, min(item_id * 1000000 + pos) AS place FROM u GROUP BY 1),
        v AS (SELECT word, row_number() OVER (ORDER BY place) + 2 AS id FROM f), i AS (SELECT item_id, list(id ORDER BY pos) AS ids FROM u JOIN v USING (word) GROUP BY 1)
        SELECT item_id, array_to_string(list_concat(ids, list_transform(range(30), lambda x: 0))[1:30], '|') AS ids FROM i""",
    "token_counts": f"WITH w AS (SELECT role, unnest({_TOKENS}) AS word FROM conversations), k AS (SELECT role, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2) SELECT role, word, n, row_number() OVER (PARTITION BY role ORDER BY n DESC, word) AS rank FROM k QUALIFY rank <= 20",
    "vocabulary": f"""WITH t AS (SELECT item_id, list_filter({_TOKENS}, lambda x: x <> '') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t), f AS (SELECT word, min(item_id * 1000000 + pos) AS place FROM u GROUP BY 1)
        SELECT word, row_number() OVER (ORDER BY place) + 2 AS id FROM f""",
    "accuracy_levels": """WITH c AS (SELECT role, turn, (CASE WHEN length(text) > 200 THEN 'assistant' ELSE 'user' END = role)::INT AS h FROM conversations) SELECT role, turn, count(*) AS n, sum(h)::BIGINT AS hits, round(sum(h) * 100.0 / count(*), 2) AS accuracy FROM c GROUP BY ROLLUP (role, turn)""",
    "status_inference": "SELECT CASE event_id % 6 WHEN 0 THEN 'moving' WHEN 1 THEN 'stopped' WHEN 2 THEN CASE WHEN value / 100 < 0.5 THEN 'stopped' ELSE 'moving' END WHEN 3 THEN 'with_rider' WHEN 4 THEN 'without_rider' ELSE 'standing' END AS status, count(*) AS n FROM events GROUP BY 1",
    "page_fields": "WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme, html FROM pages) SELECT list_extract(string_split(host, '.'), -1) AS suffix, scheme, count(*) AS n, count(DISTINCT host) AS hosts, sum(strlen(html))::BIGINT AS bytes FROM p GROUP BY 1, 2",
    "pr_curve": """WITH s AS (SELECT user_id % 10 AS class, event_id, value AS score, (event_type = 'purchase')::INT AS hit FROM events) SELECT class, event_id, round(sum(hit) OVER w / count(*) OVER w, 6) AS precision, round(sum(hit) OVER w / nullif(sum(hit) OVER (PARTITION BY class), 0), 6) AS recall
        FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "average_precision": """WITH s AS (SELECT user_id % 10 AS class, event_id, value AS score, (event_type = 'purchase')::INT AS hit FROM events),
        c AS (SELECT class, count(*) OVER w AS k, sum(hit) OVER w / count(*) OVER w AS p, sum(hit) OVER w / nullif(sum(hit) OVER (PARTITION BY class), 0) AS r FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        q AS (SELECT class, r, arg_min(p, k) AS p_first, arg_max(p, k) AS p_last FROM c GROUP BY 1, 2), b AS (SELECT class, x / 100.0::DOUBLE AS pos, x FROM (SELECT DISTINCT class FROM s), range(11, 101) t(x)),
        lo AS (SELECT b.class, b.x, b.pos, max(q.r) AS r0, arg_max(q.p_last, q.r) AS p0 FROM b LEFT JOIN q ON q.class = b.class AND q.r <= b.pos + 1e-11 GROUP BY 1, 2, 3), hi AS (SELECT b.class, b.x, min(q.r) AS r1, arg_min(q.p_first, q.r) AS p1 FROM b JOIN q ON q.class = b.class AND q.r > b.pos + 1e-11 GROUP BY 1, 2),
        v AS (SELECT lo.class, CASE WHEN r0 IS NULL THEN p1 WHEN abs(pos - r0) < 1e-11 THEN p0 WHEN r1 IS NULL THEN 0 ELSE p0 + (p1 - p0) * (pos - r0) / (r1 - r0) END AS v FROM lo LEFT JOIN hi ON lo.class = hi.class AND lo.x = hi.x)
        SELECT class, round(sum(greatest(v - 0.1, 0)) / 90 / 0.9, 6) AS ap FROM v GROUP BY 1""",
    "confusion_iou": f"WITH {_IOU} SELECT * FROM i",
    "mean_iou": f"WITH {_IOU} SELECT round(avg(iou), 6) AS miou, round(sum(iou * (tp + fn)) / sum(tp + fn), 6) AS fwiou FROM i",
    "panoptic": """WITH p AS (SELECT l_suppkey % 20 AS frame, l_returnflag AS class, l_partkey % 4 AS truth, CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 4 ELSE l_partkey % 4 END AS guess FROM lineitem),
        b AS (SELECT frame, class, truth, guess, count(*) AS k FROM p WHERE truth <> 0 AND guess <> 0 GROUP BY ALL), t AS (SELECT frame, class, truth, count(*) AS nt FROM p WHERE truth <> 0 GROUP BY ALL), g AS (SELECT frame, class, guess, count(*) AS ng FROM p WHERE guess <> 0 GROUP BY ALL),
        m AS (SELECT *, k / (nt + ng - k) AS iou FROM b JOIN t USING (frame, class, truth) JOIN g USING (frame, class, guess) WHERE k / (nt + ng - k) > 0.5),
        c AS (SELECT class, (SELECT count(*) FROM m WHERE m.class = x.class) AS tp, (SELECT count(*) FROM g WHERE g.class = x.class) AS ng, (SELECT count(*) FROM t WHERE t.class = x.class) AS nt, (SELECT coalesce(sum(iou), 0) FROM m WHERE m.class = x.class) AS s FROM (SELECT DISTINCT class FROM p) x)
        SELECT class, tp, ng - tp AS fp, nt - tp AS fn, round(coalesce(s / nullif(tp, 0), 0), 6) AS sq, round(coalesce(tp / nullif(tp + 0.5 * (ng - tp) + 0.5 * (nt - tp), 0), 0), 6) AS rq,
          round(coalesce(s / nullif(tp, 0), 0) * coalesce(tp / nullif(tp + 0.5 * (ng - tp) + 0.5 * (nt - tp), 0), 0), 6) AS pq FROM c""",
    "displacement": """WITH m AS (SELECT l_orderkey AS id, l_partkey % 3 AS mode, 1.0 / (1 + l_partkey % 3) AS p, l_linenumber AS t, l_quantity / 10 AS dist FROM lineitem), b AS (SELECT id, mode, max(p) AS p, avg(dist) AS ade, arg_max(dist, t * 1000 + dist) AS fde, max(dist) AS worst FROM m GROUP BY 1, 2),
        k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, mode) <= 2) SELECT id, round(min(ade), 6) AS min_ade, round(min(fde), 6) AS min_fde, min(worst) >= 2 AS missed FROM k GROUP BY 1""",
    "point_in_polygon": """WITH s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, (s_suppkey % 40)::DOUBLE AS y FROM supplier), p AS (SELECT k AS poly, k * 8.0 AS c FROM range(12) t(k)),
        e AS (SELECT poly, unnest([[c - 9.5, 20.25, c, 1.5], [c, 1.5, c + 9.5, 20.25], [c + 9.5, 20.25, c, 38.5], [c, 38.5, c - 9.5, 20.25]]) AS q FROM p)
        SELECT id, min(poly) AS poly FROM (SELECT id, poly FROM s JOIN e ON (q[2] > y) <> (q[4] > y) AND x < q[1] + (y - q[2]) * (q[3] - q[1]) / (q[4] - q[2]) GROUP BY id, poly HAVING count(*) % 2 = 1) GROUP BY 1""",
    "lane_groups": """WITH RECURSIVE l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 50), f AS (SELECT p, min(s) AS a FROM l GROUP BY 1), e AS (SELECT a, s AS b FROM l JOIN f USING (p) WHERE s <> a), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS lane, a AS other FROM both_ways UNION SELECT r.lane, b.b FROM r JOIN both_ways b ON r.other = b.a) SELECT lane, min(other) AS "group" FROM r GROUP BY 1""",
}
