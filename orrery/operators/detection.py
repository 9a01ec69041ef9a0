"""Evaluation of detected boxes from raw boxes to the score: matching per class, threshold and sample, one curve with all errors, averages.

Boxes: sample, class, box (an id), x, y, length, width, height, yaw (degrees), vx, vy (null where unknown), attribute (null where there is none); detections also have a score.
A sample and class hold a bounded number of boxes, so they meet as two arrays in one row, and the greedy choice is a fold over these arrays: one exchange of all boxes (none if they are dealt by sample), and no Python.
A detection is one row for all thresholds, as they share its place in the order; of the curves only the points that recalls ask for are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.session import durable

from . import metrics

#: The thresholds in metres, the one that errors are taken at, and the errors that some classes have not.
THRESHOLDS, ERROR_THRESHOLD = (0.5, 1.0, 2.0, 4.0), 2.0
ERRORS = ("translation", "scale", "orientation", "velocity", "attribute")
UNDEFINED = {"traffic_cone": ("attribute", "velocity", "orientation"), "barrier": ("attribute", "velocity")}
#: Fixed value: the class whose heading is known up to half a turn.
HALF_TURN = "barrier"

BOX = ("box", "x", "y", "length", "width", "height", "yaw", "vx", "vy", "attribute")


def _errors(klass: Column, truth: Column, guess: Column) -> dict[str, Column]:
    size = lambda b: [b[c] for c in ("length", "width", "height")]
    turn = F.when(klass == HALF_TURN, G.angle_difference(truth["yaw"], guess["yaw"], 180.0)).otherwise(G.angle_difference(truth["yaw"], guess["yaw"]))
    return {
        "translation": F.hypot(truth["x"] - guess["x"], truth["y"] - guess["y"]),
        "scale": 1 - G.scale_iou(size(truth), size(guess)),
        "orientation": F.radians(F.abs(turn)),
        "velocity": F.hypot(truth["vx"] - guess["vx"], truth["vy"] - guess["vy"]),
        "attribute": F.when(truth["attribute"].isNotNull(), F.when(truth["attribute"].eqNullSafe(guess["attribute"]), 0.0).otherwise(1.0)),
    }


def together(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """Both tables as one: the columns of a box, ``score`` (null for truths) and ``is_truth``."""
    columns = ["sample", "class", *BOX]
    return truth.select(*columns, F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_truth")).unionByName(guess.select(*columns, F.col("score").cast("double").alias("score"), F.lit(False).alias("is_truth")))


def _met(boxes: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """sample, class, truths (their number), gts, found (by falling score; b, and near: the truths within the largest threshold, nearest first)."""
    # negated, so that arrays sort by falling score and falling box
    by_score = F.struct((-F.col("score")).alias("_s"), (-F.col("box")).alias("_b"), F.struct("score", *BOX).alias("b"))
    arrays = F.array_sort(F.collect_list(F.when(F.col("is_truth"), F.struct(*BOX)))).alias("gts"), F.array_sort(F.collect_list(F.when(~F.col("is_truth"), by_score))).alias("found")
    met = boxes.groupBy("sample", "class").agg(*arrays)
    # an unknown sample or class is equal to none
    met = met.select("sample", "class", F.size("gts").alias("truths"), F.when(F.col("sample").isNotNull() & F.col("class").isNotNull(), F.col("gts")).otherwise(F.slice("gts", 1, 0)).alias("gts"), "found")
    near = lambda g: F.array_sort(F.filter(F.transform("gts", lambda t, i: F.struct(F.hypot(t["x"] - g["x"], t["y"] - g["y"]).alias("d"), i.alias("i"))), lambda c: c["d"] < max(thresholds)))
    return met.select("sample", "class", "truths", "gts", F.transform("found", lambda f: F.struct(f["b"].alias("b"), near(f["b"]).alias("near"))).alias("found"))


def _taken(threshold: Column) -> Column:
    """For each detection the number of the truth that it takes, -1 for none."""

    def take(state: Column, f: Column) -> Column:
        free = F.filter(f["near"], lambda c: (c["d"] < threshold) & ~F.array_contains(state, c["i"]))
        return F.concat(state, F.array(F.coalesce(F.get(free, F.lit(0))["i"], F.lit(-1))))

    return F.aggregate("found", F.array().cast("array<int>"), take)


def _with_errors() -> list[Column]:
    return [F.when(F.col("t").isNotNull(), e).alias(n) for n, e in _errors(F.col("class"), F.col("t"), F.col("b")).items()]


def matched(truth: DataFrame, guess: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """class, threshold, sample, box, score, hit, gt, errors of every detection at every threshold.

    By falling score (of equal ones the larger box first) each detection takes its nearest truth of the same sample and class that is still free, the smaller box of equally
    near ones, if it is nearer than the threshold.
    """
    return matched_boxes(together(truth, guess), thresholds)


def matched_boxes(boxes: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """:func:`matched` of boxes that are one table, see :func:`together`."""
    each = _met(boxes, thresholds).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    chosen = each.withColumn("taken", _taken(F.col("threshold")))
    rows = chosen.select("sample", "class", "threshold", "gts", F.explode(F.arrays_zip(F.col("found.b").alias("b"), "taken")).alias("r"))
    rows = rows.select("sample", "class", "threshold", F.col("r.b").alias("b"), F.when(F.col("r.taken") >= 0, F.get("gts", F.col("r.taken"))).alias("t"))
    return rows.select("class", "threshold", "sample", "b.box", "b.score", F.col("t").isNotNull().alias("hit"), F.col("t.box").alias("gt"), *_with_errors())


def matched_once(boxes: DataFrame, thresholds: tuple[float, ...], error_threshold: float) -> DataFrame:
    """class, truths, box, score, hits, errors: of every detection one row, with a bit for each threshold that it has a match at, and the errors at ``error_threshold``.

    The sum of ``truths`` is their number; where a sample has no detection of a class a row without box has it.
    """
    takings = [_taken(F.lit(float(t))).alias(f"taken_{k}") for k, t in enumerate(thresholds)]
    chosen = _met(boxes, thresholds).select("class", "truths", "gts", F.col("found.b").alias("b"), *takings)
    rows = chosen.select("class", "truths", "gts", F.posexplode_outer(F.arrays_zip("b", *[f"taken_{k}" for k in range(len(thresholds))])).alias("nth", "r"))
    hits = sum((F.when(F.col(f"r.taken_{k}") >= 0, 1 << k).otherwise(0) for k in range(len(thresholds))), F.lit(0))
    at = [k for k, t in enumerate(thresholds) if float(t) == float(error_threshold)]
    truth = F.when(F.col(f"r.taken_{at[0]}") >= 0, F.get("gts", F.col(f"r.taken_{at[0]}"))) if at else F.get(F.slice("gts", 1, 0), F.lit(0))
    rows = rows.select("class", F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("truths")).otherwise(0).alias("truths"), F.col("nth").isNotNull().alias("found"), F.col("r.b").alias("b"), hits.cast("int").alias("hits"), truth.alias("t"))
    return rows.select("class", "truths", "found", "b.box", "b.score", "hits", *_with_errors())


def class_metrics(truth: DataFrame, guess: DataFrame, classes: tuple[str, ...], thresholds: tuple[float, ...] = THRESHOLDS, error_threshold: float = ERROR_THRESHOLD) -> DataFrame:
    """class, ap (mean over thresholds), ap_<threshold>, and the five errors at ``error_threshold``, null where a class has none.

    A class without truths or without matches has no precision and errors of 1.
    """
    return class_metrics_of(together(truth, guess), classes, thresholds, error_threshold)


def class_metrics_of(boxes: DataFrame, classes: tuple[str, ...], thresholds: tuple[float, ...] = THRESHOLDS, error_threshold: float = ERROR_THRESHOLD) -> DataFrame:
    """:func:`class_metrics` of boxes that are one table, see :func:`together`."""
    rows = durable(matched_once(boxes, thresholds, error_threshold), "matches")
    keys, errors, values = ["class", "threshold"], list(ERRORS), ["precision", "score"]
    hit = lambda k: F.col("hits").bitwiseAND(F.lit(1 << k)) != 0
    at_each = lambda of: F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), of(k).alias("tp")) for k, t in enumerate(thresholds)])).alias("_e")
    one = F.col("threshold") == float(error_threshold)
    counts = rows.groupBy("class").agg(F.sum("truths").alias("_n"), *[F.sum(F.when(hit(k), 1).otherwise(0)).alias(f"tp_{k}") for k in range(len(thresholds))])
    groups = counts.where("_n > 0").select("class", "_n", at_each(lambda k: F.col(f"tp_{k}"))).select("class", "_e.threshold", F.col("_e.tp").alias("_hits"), "_n")
    wanted = durable(metrics.wanted_recalls(groups, keys), "recalls")  # 101 rows for each class and threshold
    # one order for all thresholds, and the errors of the hits at one of them
    error_hit = next((hit(k) for k, t in enumerate(thresholds) if float(t) == float(error_threshold)), F.lit(False))
    sums = {f"tp_{k}": F.when(hit(k), 1).otherwise(0) for k in range(len(thresholds))} | {"k": F.lit(1)} | metrics.error_sums(errors, error_hit)
    curve = metrics.running_sums(rows.where("found").drop("truths", "found"), "class", "score", [F.desc("box")], sums, peers=error_hit)
    means, tied = metrics.error_means(errors)
    curve = curve.withColumns({"mean": means, "tied": tied}).select("class", "score", "k", "mean", "tied", at_each(lambda k: F.col(f"tp_{k}"))).select("class", "score", "k", "mean", "tied", "_e.threshold", "_e.tp")
    points = durable(metrics.recall_points(curve.withColumn("precision", F.col("tp") / F.col("k")), wanted, keys, [*values, "mean", "tied"]), "points")
    at = durable(metrics.between_points(points, wanted, keys, values), "at-recalls")
    conf = metrics.asked_confidences(at.where(one), ["class"], "score")
    # the first point of m hits is the m-th hit
    known = points.where(one & (F.col("tp") > 0)).select("class", F.col("tp").alias("m"), F.struct("_first.score", "_first.mean", "_first.tied").alias("_h"))
    means = metrics.errors_between(known, conf, ["class"], errors).select("class", *[F.round(e, 6).alias(e) for e in errors])
    # one row for each class: few classes
    ap = lambda t: F.max(F.when(F.col("threshold") == float(t), F.col("ap"))).alias(f"ap_{t:g}".replace(".", "_"))
    wide = metrics.mean_precision(at, keys).groupBy("class").agg(*[ap(t) for t in thresholds]).join(means, "class", "full")
    aps = [f"ap_{t:g}".replace(".", "_") for t in thresholds]
    listed = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string").join(wide, "class", "left").fillna(0.0, aps).fillna(1.0, errors)
    mean = sum((F.col(a) for a in aps), F.lit(0.0)) / len(aps)
    kept = lambda e: F.when(~F.col("class").isin([c for c, x in UNDEFINED.items() if e in x] or [""]), F.col(e))
    return listed.select("class", F.round(mean, 6).alias("ap"), *aps, *[kept(e).alias(e) for e in ERRORS])


def detection_report(truth: DataFrame, guess: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """The rows of :func:`class_metrics` and one without class: mean AP, mean errors over the classes that have them, and ``score``, (5 mAP + the sum of what each error leaves of one) / 10."""
    return report_of(together(truth, guess), classes)


def report_of(boxes: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """:func:`detection_report` of boxes that are one table, see :func:`together`."""
    by = durable(class_metrics_of(boxes, classes), "classes")  # read twice: as it is, and for the means
    means = by.agg(F.avg("ap").alias("ap"), *[F.avg(c).alias(c) for c in by.columns if c.startswith("ap_")], *[F.avg(e).alias(e) for e in ERRORS])
    score = metrics.detection_score(F.col("ap"), *[F.col(e) for e in ERRORS])
    whole = means.select(F.lit(None).cast("string").alias("class"), *[F.round(c, 4).alias(c) for c in by.columns[1:]], F.round(score, 4).alias("score"))
    return by.withColumn("score", F.lit(None).cast("double")).unionByName(whole)
