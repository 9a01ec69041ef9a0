"""Evaluation of tracks from raw boxes: filling of gaps, thresholds from recalls, CLEAR-MOT accounts for each threshold, averages over thresholds.

Boxes: scene, t, class, track, x, y; guessed ones also have a score. frames: scene, t, every time of every scene.
Association in time is sequential, so one scene and class is one group for a Python function, which gives a short row for each true track and threshold; all measures are made of those by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import durable

from .metrics import by_groups, optimal_match, running_sums

#: Recalls, distance of a match, seconds of a frame, and the worst values, which stand for what is not reached.
STEPS, LEAST_RECALL, RADIUS, SECONDS = 40, 0.1, 2.0, 0.5
WORST = {"motar": 0.0, "mota": 0.0, "motp": 2.0, "recall": 0.0, "faf": 500.0, "mt": 0, "tp": 0, "tid": 20.0, "lgd": 20.0}
#: What is summed over classes; the rest is averaged.
SUMMED = ("mt", "ml", "tp", "fp", "fn", "ids", "frag")
MEASURES = ("motar", "mota", "motp", "recall", "faf", "mt", "ml", "tp", "fp", "fn", "ids", "frag", "tid", "lgd")


def filled_tracks(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """scene, i (number of the frame), class, track, x, y, score: every track at every frame between its first and last one; scores become the track's mean.

    A missing box lies between its neighbours. The later neighbour has the share of the time that is left until it, as the protocol weighs them; class and score are the later one's.
    """
    numbered = frames.select("scene", "t").distinct().withColumn("i", F.row_number().over(Window.partitionBy("scene").orderBy("t")))
    if "score" not in boxes.columns:
        boxes = boxes.withColumn("score", F.lit(None).cast("double"))
    keys = ["scene", "track"]
    own = Window.partitionBy(*keys)
    known = boxes.join(numbered, ["scene", "t"]).withColumns({"score": F.avg("score").over(own), "_a": F.min("i").over(own), "_z": F.max("i").over(own)})
    spans = known.groupBy(*keys).agg(F.first("_a").alias("a"), F.first("_z").alias("z")).select(*keys, F.explode(F.sequence("a", "z")).alias("i")).join(numbered, ["scene", "i"])
    here = known.select(*keys, "i", F.struct("t", "x", "y", "class", "score").alias("b"))
    placed = spans.join(here, [*keys, "i"], "left")
    w = Window.partitionBy(*keys).orderBy("i")
    before, after = F.last("b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("b", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = placed.withColumns({"l": before, "r": after})
    time = lambda c: F.unix_micros(c).cast("double") if dict(frames.dtypes)["t"].startswith("timestamp") else c.cast("double")
    share = F.coalesce(F.try_divide(time(F.col("r.t")) - time(F.col("t")), time(F.col("r.t")) - time(F.col("l.t"))), F.lit(1.0))
    mixed = lambda c: F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise((1 - share) * F.col(f"l.{c}") + share * F.col(f"r.{c}")).alias(c)
    return both.select("scene", "i", F.col("r.class").alias("class"), "track", mixed("x"), mixed("y"), F.col("r.score").alias("score"))


def _frames(of: dict[str, np.ndarray]) -> Iterator[tuple[list, list, list, np.ndarray, list]]:
    """Per frame, in order: ids of truths, ids and scores of guesses, and all distances between them, also as lists; ``of``: the columns by i and track."""
    gt, track, score, at = of["gt"].astype(bool), of["track"], of["score"].astype(float), np.stack([of["x"], of["y"]], axis=1).astype(float)
    cuts = np.flatnonzero(np.diff(of["i"])) + 1
    for a0, z0 in zip([0, *cuts], [*cuts, len(gt)], strict=True):
        own = np.arange(a0, z0)
        a, b = own[gt[a0:z0]], own[~gt[a0:z0]]
        gap = at[a][:, None, :] - at[b][None, :, :]
        far = np.hypot(gap[..., 0], gap[..., 1])
        yield track[a].tolist(), track[b].tolist(), score[b].tolist(), far, far.tolist()


def _assigned(far: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """The pairs closer than ``radius`` of the assignment with most of them and, of these, least distance."""
    close = far < radius
    if not close.any():
        return []
    if close.sum(axis=0).max() == 1 and close.sum(axis=1).max() == 1:  # nobody has a choice
        return list(zip(*np.nonzero(close), strict=True))
    cost = np.where(close, far, 1e3 * radius)
    pairs = optimal_match(cost) if len(cost) <= len(cost.T) else [(j, i) for i, j in optimal_match(cost.T)]
    return [(i, j) for i, j in pairs if close[i, j]]


def _followed(frames: list[tuple], kept: set, radius: float) -> tuple[dict, dict, int, int, list[float]]:
    """States and distances of the true tracks, false guesses, frames and scores of plain matches, with the guessed tracks ``kept``."""
    last, states, distance, false, seen, scores = {}, {}, {}, 0, 0, []
    for gt, pr, score, matrix, far in frames:
        here = [j for j, p in enumerate(pr) if p in kept]
        if not len(gt) and not here:
            continue
        seen += 1
        place = {pr[j]: j for j in here}
        pairs, used = {}, set()
        for i, g in enumerate(gt):
            j = place.get(last.get(g))
            if j is not None and j not in used and far[i][j] < radius:
                pairs[i] = (j, 1)
                used.add(j)
        rest, free = [i for i in range(len(gt)) if i not in pairs], [j for j in here if j not in used]
        if any(far[i][j] < radius for i in rest for j in free):
            for a, b in _assigned(matrix[np.ix_(rest, free)], radius):
                i, j = rest[a], free[b]
                pairs[i] = (j, 2 if gt[i] in last and last[gt[i]] != pr[j] else 1)
        for i, g in enumerate(gt):
            j, state = pairs.get(i, (None, 0))
            states.setdefault(g, []).append(state)
            distance.setdefault(g, 0.0)
            if j is not None:
                last[g] = pr[j]
                distance[g] += far[i][j]
                if state == 1:
                    scores.append(score[j])
        false += len(here) - len(pairs)
    return states, distance, false, seen, scores


def associated(boxes: DataFrame, thresholds: dict[str, list[float]] | None, radius: float = RADIUS) -> DataFrame:
    """scene, class, threshold, gt, states, distance, false, frames, scores from boxes (scene, class, i, gt, track, x, y, score).

    One row for each true track, with its state in each frame it is in (0 missed, 1 matched, 2 matched to another guess than before) and the sum of its distances; and one row without ``gt`` for
    the scene: false guesses, frames with boxes and, without ``thresholds``, the scores of plain matches. A pair of the last match stays while close; the rest is assigned at least total distance.
    A score belongs to a track, so thresholds that keep the same tracks of a scene are followed once.
    """

    def run(key: tuple, of: dict[str, np.ndarray]) -> list[tuple]:
        scene, klass = key
        guessed = ~of["gt"].astype(bool)
        score_of = dict(zip(of["track"][guessed].tolist(), of["score"][guessed].tolist(), strict=True))
        frames, done, out = list(_frames(of)), {}, []
        for threshold in [None] if thresholds is None else thresholds.get(klass, []):
            kept = frozenset(t for t, s in score_of.items() if threshold is None or s >= threshold)
            if kept not in done:
                done[kept] = _followed(frames, kept, radius)
            states, distance, false, seen, scores = done[kept]
            out += [(scene, klass, threshold, g, s, distance[g], None, None, None) for g, s in states.items()]
            out.append((scene, klass, threshold, None, None, None, false, seen, scores if threshold is None else []))
        return out

    schema = {"scene": "bigint", "class": "string", "threshold": "double", "gt": "bigint", "states": "array<int>", "distance": "double", "false": "bigint", "frames": "bigint", "scores": "array<double>"}
    return by_groups(boxes.select("scene", "class", "i", "gt", "track", F.col("x").cast("double"), F.col("y").cast("double"), F.col("score").cast("double")), ["scene", "class"], ["i", "track"], run, schema)


def score_thresholds(scores: DataFrame, positives: DataFrame, steps: int = STEPS, least_recall: float = LEAST_RECALL) -> DataFrame:
    """class, step, recall, threshold: the score, interpolated between matches, at which each recall is reached; null where it is not. scores: class, score of the matches; positives: class, n."""
    # a score belongs to a track, so the matches are counted by score before they are ranked; equal scores make equal thresholds, so their order does not matter
    each = running_sums(scores.groupBy("class", "score").agg(F.count("*").alias("c")), "class", "score", [], {"k": F.col("c")})
    total = scores.groupBy("class").agg(F.count("*").alias("hits"))
    at = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.round(F.lit(least_recall) + k * (1 - least_recall) / (steps - 1), 12))
    wanted = positives.join(total, "class", "left").select("class", "n", "hits", F.posexplode(at).alias("step", "recall")).withColumn("m", F.floor(F.col("recall") * F.col("n") + 1e-9))
    # the few ranks that are asked for go to the scores: a table of all ranks is small on disk but not in a driver
    asked = wanted.select("class", F.explode(F.array(F.col("m"), F.col("m") + 1)).alias("m")).distinct()
    place = each.join(F.broadcast(asked), "class").where((F.col("m") > F.col("k") - F.col("c")) & (F.col("m") <= F.col("k"))).select("class", "m", "score")
    low, high = place.withColumnRenamed("score", "low"), place.select("class", (F.col("m") - 1).alias("m"), F.col("score").alias("high"))
    met = wanted.join(low, ["class", "m"], "left").join(high, ["class", "m"], "left")
    value = F.when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull(), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (F.col("recall") * F.col("n") - F.col("m")))
    return met.select("class", "step", "recall", F.when(F.col("recall") <= F.col("hits") / F.col("n") + 1e-12, value).alias("threshold"))


def _tracked(states: Column) -> Column:
    return F.filter(F.transform(states, lambda s, i: F.when(s > 0, i)), lambda i: i.isNotNull())


def _longest_gap(states: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))
    step = lambda a, s: F.struct(F.when(s > 0, 0).otherwise(a["run"] + 1).alias("run"), F.greatest(a["most"], F.when(s > 0, 0).otherwise(a["run"] + 1)).alias("most"))
    return F.aggregate(states, start, step, lambda a: a["most"])


def _losses(states: Column) -> Column:
    """How often a track is lost between its first and its last match."""
    at = _tracked(states)
    return F.size(F.filter(F.transform(at, lambda i, k: i - F.get(at, k - 1)), lambda gap: gap > 1))


def threshold_measures(rows: DataFrame) -> DataFrame:
    """class, threshold and :data:`MEASURES` from the rows of :func:`associated`; a measure without a base is null.

    A true track's frames are consecutive, so states tell time: until the first match (tid) and the longest gap (lgd), in seconds, over matched tracks.
    """
    s = F.col("states")
    n = F.size("states")
    hits = F.size(_tracked(s))
    gt = F.col("gt").isNotNull()
    one = {
        "n": F.when(gt, n), "hits": F.when(gt, hits), "ids": F.when(gt, F.size(F.filter(s, lambda x: x == 2))), "frag": F.when(gt, _losses(s)),
        "mt": F.when(gt, (hits >= 0.8 * n).cast("int")), "ml": F.when(gt, (hits < 0.2 * n).cast("int")), "tracked": F.when(gt, (hits > 0).cast("int")),
        "tid": F.when(gt & (hits > 0), F.get(_tracked(s), F.lit(0)) * SECONDS), "lgd": F.when(gt & (hits > 0), _longest_gap(s) * SECONDS), "far": F.col("distance"), "fp": F.col("false"), "frames": F.col("frames"),
    }
    by = rows.groupBy("class", "threshold").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in one.items()])
    fn, tp = F.col("n") - F.col("hits"), F.col("hits") - F.col("ids")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    # errors beyond those that the recall implies
    beyond = fn + F.col("ids") + F.col("fp") - (F.col("n") - tp)
    return by.select(
        "class", "threshold", F.greatest(F.lit(0.0), 1 - ratio(beyond, tp)).alias("motar"), F.greatest(F.lit(0.0), 1 - ratio(fn + F.col("ids") + F.col("fp"), F.col("n"))).alias("mota"), ratio(F.col("far"), F.col("hits")).alias("motp"),
        ratio(F.col("hits"), F.col("n")).alias("recall"), (100 * ratio(F.col("fp"), F.col("frames"))).alias("faf"), "mt", "ml", tp.alias("tp"), "fp", fn.alias("fn"), "ids", "frag", ratio(F.col("tid"), F.col("tracked")).alias("tid"), ratio(F.col("lgd"), F.col("tracked")).alias("lgd"),
    ).withColumn("motar", F.when(F.col("tp") > 0, F.col("motar")))


def track_report(truth: DataFrame, guess: DataFrame, frames: DataFrame, classes: tuple[str, ...], radius: float = RADIUS) -> DataFrame:
    """class, gt, amota, amotp and :data:`MEASURES` at the threshold of the best mota, the one of the highest recall among equals; the row without class sums or averages the classes.

    amota and amotp are means over the recall steps, with the worst value where a recall is not reached; a class without truths has nulls, one without matches the worst values.
    """
    spark = truth.sparkSession
    listed = spark.createDataFrame([(c,) for c in classes], "class string")
    gts = filled_tracks(truth, frames).withColumn("gt", F.lit(True))
    boxes = gts.unionByName(filled_tracks(guess, frames).withColumn("gt", F.lit(False))).join(F.broadcast(listed), "class", "left_semi")
    boxes = durable(boxes, "boxes")
    positives = boxes.where("gt").groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("scene", "track").alias("tracks"))
    scores = durable(associated(boxes, None, radius).where("gt is null").select("class", F.explode("scores").alias("score")), "scores")
    # as many rows as there are classes and steps
    steps = score_thresholds(scores, positives).collect()
    chosen: dict[str, set] = {}
    for r in steps:
        if r["threshold"] is not None:
            chosen.setdefault(r["class"], set()).add(r["threshold"])
    by = threshold_measures(associated(boxes, {c: sorted(t) for c, t in chosen.items()}, radius))
    table = spark.createDataFrame([(r["class"], r["step"], r["recall"], r["threshold"]) for r in steps], "class string, step int, hypothesis double, threshold double")
    each = table.join(by, ["class", "threshold"], "left")
    best = F.max_by(F.struct(*MEASURES), F.when(F.col("mota").isNotNull(), F.struct("mota", "step")))
    out = each.groupBy("class").agg(F.avg(F.coalesce("motar", F.lit(WORST["motar"]))).alias("amota"), F.avg(F.coalesce("motp", F.lit(WORST["motp"]))).alias("amotp"), best.alias("b"))
    full = listed.join(positives, "class", "left").join(out, "class", "left")
    none = F.col("b").isNull() & F.col("n").isNotNull()

    def value(c: str) -> Column:
        worst = {"ml": F.col("tracks"), "fn": F.col("n")}.get(c, F.lit(WORST.get(c)))
        return F.when(none, worst).otherwise(F.col(f"b.{c}")).cast("bigint" if c in SUMMED else "double").alias(c)

    rows = full.select("class", F.col("n").alias("gt"), F.when(F.col("n").isNotNull(), F.coalesce("amota", F.lit(0.0))).alias("amota"), F.when(F.col("n").isNotNull(), F.coalesce("amotp", F.lit(WORST["motp"]))).alias("amotp"), *[value(c) for c in MEASURES])
    total = rows.agg(*[(F.sum(c) if c in SUMMED else F.avg(c)).alias(c) for c in rows.columns[1:]])
    rounded = [F.round(F.col(c).cast("double"), 6).alias(c) for c in rows.columns[1:]]
    return rows.select("class", *rounded).unionByName(total.select(F.lit(None).cast("string").alias("class"), *rounded))
