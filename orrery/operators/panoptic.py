"""Panoptic tracking of labelled points: identity switches, association of instance tubes over whole scenes, and track quality, as joins of segment counts.

Points: scene, frame (ordered numbers), truth_class, truth, guess_class, guess (class ids and instance ids; stuff has one instance id, such as 0, for a region). All measures come from the
numbers of points by frame and pair of segments, which are counted once; what follows is small. Classes of ``things`` have tracks; points whose true class is in ``ignored`` do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a segment of this many points or fewer has no tube and no track.
LEAST_POINTS = 30


def segment_counts(points: DataFrame, ignored: tuple[int, ...] = (0,)) -> DataFrame:
    """scene, i (number of the frame in its scene), truth_class, truth, guess_class, guess, n."""
    kept = points.where(~F.col("truth_class").isin(list(ignored))) if ignored else points
    n = kept.groupBy("scene", "frame", "truth_class", "truth", "guess_class", "guess").agg(F.count("*").alias("n"))
    # frames whose points are all ignored still stand between their neighbours
    order = points.select("scene", "frame").distinct().withColumn("i", F.row_number().over(Window.partitionBy("scene").orderBy("frame")))
    return n.join(order, ["scene", "frame"]).drop("frame")


def _overlaps(pair: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], b_keys: list[str]) -> DataFrame:
    """``pair`` (n) with the sizes ``na`` and ``nb`` of both segments and their intersection over union."""
    return pair.join(a, [*keys, "truth"]).join(b, [*b_keys, "guess"]).withColumn("iou", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))


def _segments(seg: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per scene, frame and class: true segments (na), guessed ones (nb), and pairs of one class with their overlap."""
    keys = ["scene", "i", "class"]
    a = seg.groupBy("scene", "i", F.col("truth_class").alias("class"), "truth").agg(F.sum("n").alias("na"))
    b = seg.groupBy("scene", "i", F.col("guess_class").alias("class"), "guess").agg(F.sum("n").alias("nb"))
    same = seg.where("truth_class = guess_class").groupBy("scene", "i", F.col("truth_class").alias("class"), "truth", "guess").agg(F.sum("n").alias("n"))
    return a, b, _overlaps(same, a, b, keys, keys)


def class_tracking(seg: DataFrame, classes: list[int], things: list[int], least_points: int = LEAST_POINTS) -> DataFrame:
    """class, tp, fp, fn, ids, iou (sums), pq, ptq, sptq, and for things motsa, smotsa, motsp; from :func:`segment_counts`.

    Overlaps above one half are one-to-one. A true thing that is matched in two successive frames, to different guesses, is a switch; the soft count adds the overlap that it has then.
    """
    a, b, met = _segments(seg)
    hit = met.where("iou > 0.5")
    keys = ["scene", "i", "class"]
    before = hit.select("scene", (F.col("i") + 1).alias("i"), "class", "truth", F.col("guess").alias("was"))
    switched = hit.join(before, [*keys, "truth"], "left").withColumn("switch", F.coalesce(F.col("was") != F.col("guess"), F.lit(False)) & F.col("class").isin(things))
    tp = switched.groupBy("class").agg(F.count("*").alias("tp"), F.sum("iou").alias("iou"), F.count_if("switch").alias("ids"), F.sum(F.when(F.col("switch"), F.col("iou")).otherwise(0.0)).alias("soft"))
    fn = a.where(F.col("na") >= least_points).join(hit, [*keys, "truth"], "left_anti").groupBy("class").agg(F.count("*").alias("fn"))
    fp = b.where(F.col("nb") >= least_points).join(hit, [*keys, "guess"], "left_anti").groupBy("class").agg(F.count("*").alias("fp"))
    listed = seg.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    full = listed.join(tp, "class", "left").join(fn, "class", "left").join(fp, "class", "left").fillna(0)
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    size = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    thing = lambda x: F.when(F.col("class").isin(things) & (F.col("tp") + F.col("fn") > 0), x)
    true = F.col("tp") + F.col("fn")
    return full.select(
        "class", "tp", "fp", "fn", "ids", "iou", share(F.col("iou"), size).alias("pq"), share(F.col("iou") - F.col("ids"), size).alias("ptq"), share(F.col("iou") - F.col("soft"), size).alias("sptq"),
        thing(F.try_divide(F.col("tp") - F.col("fp") - F.col("ids"), true)).alias("motsa"), thing(F.try_divide(F.col("iou") - F.col("fp") - F.col("ids"), true)).alias("smotsa"), thing(share(F.col("iou"), F.col("tp"))).alias("motsp"),
    )


def tube_association(seg: DataFrame, things: list[int], least_points: int = LEAST_POINTS) -> DataFrame:
    """scene, class, truth, points, association: how well the tube of a true thing, its points in all frames of the scene, is kept together by guesses.

    Every guess with points in the tube adds, as a share of the tube, its points there weighted by the overlap of both tubes. Segments of few points in a frame are in no tube; a guess counts whatever its class there.
    """
    thing = lambda c: F.col(c).isin(things)
    big = seg.where(thing("truth_class")).groupBy("scene", "i", "truth_class", "truth").agg(F.sum("n").alias("na")).where(F.col("na") > least_points)
    tubes = big.groupBy("scene", "truth_class", "truth").agg(F.sum("na").alias("points"))
    guesses = seg.where(thing("guess_class")).groupBy("scene", "i", "guess_class", "guess").agg(F.sum("n").alias("nb")).where(F.col("nb") > least_points).groupBy("scene", "guess").agg(F.sum("nb").alias("nb"))
    both = seg.join(big, ["scene", "i", "truth_class", "truth"], "left_semi").groupBy("scene", "truth_class", "truth", "guess").agg(F.sum("n").alias("n"))
    part = both.join(guesses, ["scene", "guess"]).join(tubes, ["scene", "truth_class", "truth"])
    sums = part.groupBy("scene", "truth_class", "truth").agg(F.sum(F.col("n") * F.col("n") / (F.col("points") + F.col("nb") - F.col("n"))).alias("s"))
    return tubes.join(sums, ["scene", "truth_class", "truth"], "left").select("scene", F.col("truth_class").alias("class"), "truth", "points", (F.coalesce("s", F.lit(0.0)) / F.col("points")).alias("association"))


def track_quality(seg: DataFrame, things: list[int], none: int = 0, least_points: int = LEAST_POINTS) -> DataFrame:
    """scene, class, truth, frames, association, identity, quality of every true thing's track.

    In a frame the guess that overlaps a thing by more than half, whatever its class, tracks it; the guess ``none``, the region of stuff, and no guess do not. A guess's frames with the thing, squared, over
    the track's frames and the guess's frames elsewhere, as a share of the track, make its association; a change of the guess, or none before it, loses identity. Quality is their geometric mean.
    """
    keys = ["scene", "i", "truth_class", "truth"]
    a = seg.where(F.col("truth_class").isin(things)).groupBy(*keys).agg(F.sum("n").alias("na")).where(F.col("na") > least_points)
    b = seg.groupBy("scene", "i", "guess").agg(F.sum("n").alias("all"))
    # guesses are measured on all points, their overlap with a class on its large segments
    pair = seg.join(a, keys).groupBy(*keys, "na", "guess").agg(F.sum("n").alias("n"))
    met = pair.join(b, ["scene", "i", "guess"]).where(F.col("n") / (F.col("na") + F.col("all") - F.col("n")) > 0.5).select(*keys, F.when(F.col("guess") != none, F.col("guess")).alias("guess"))
    steps = a.join(met, keys, "left")
    own = ["scene", "truth_class", "truth"]
    w = Window.partitionBy(*own).orderBy("i")
    before, first = F.lag("guess").over(w), F.row_number().over(w) == 1
    lost = ~first & (before.isNull() | F.coalesce(F.col("guess") != before, F.lit(True)))
    tracks = steps.withColumn("lost", lost).groupBy(*own).agg(F.count("*").alias("frames"), F.count_if("lost").alias("lost"))
    total = b.where(F.col("all") > least_points).groupBy("scene", "guess").agg(F.count("*").alias("in_all"))
    held = steps.where("guess is not null").groupBy(*own, "guess").agg(F.count("*").alias("c")).join(total, ["scene", "guess"], "left").join(tracks, own)
    apart = F.coalesce(F.col("in_all") - F.col("c"), F.lit(0))
    sums = held.groupBy(*own).agg(F.sum(F.col("c") * F.col("c") / (F.col("frames") + apart)).alias("s"))
    association = F.coalesce("s", F.lit(0.0)) / F.col("frames")
    identity = F.when(F.col("frames") == 1, 1.0).otherwise(1 - F.try_divide(F.col("lost"), F.col("frames") - 1))
    return tracks.join(sums, own, "left").select("scene", F.col("truth_class").alias("class"), "truth", "frames", association.alias("association"), identity.alias("identity"), F.sqrt(association * identity).alias("quality"))


def class_overlap(seg: DataFrame, classes: list[int]) -> DataFrame:
    """class, iou of the points' classes, 0 for a class without points."""
    each = F.explode(F.array(F.struct(F.col("truth_class").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col("guess_class").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("g"))))
    rows = seg.withColumn("same", F.col("truth_class") == F.col("guess_class")).groupBy("truth_class", "guess_class", "same").agg(F.sum("n").alias("n")).select("same", "n", each.alias("e")).select("same", "n", "e.*")
    by = rows.groupBy("class").agg(F.sum(F.col("n") * F.col("t") * F.col("same").cast("int")).alias("tp"), F.sum(F.when(F.col("same"), F.col("n") * F.col("t")).otherwise(F.col("n"))).alias("any"))
    return seg.sparkSession.createDataFrame([(c,) for c in classes], "class int").join(by, "class", "left").select("class", F.coalesce(F.try_divide(F.col("tp"), F.col("any")), F.lit(0.0)).alias("iou"))


def panoptic_report(points: DataFrame, classes: list[int], things: list[int], ignored: tuple[int, ...] = (0,), least_points: int = LEAST_POINTS) -> DataFrame:
    """One row: ptq and sptq (classes with truths), motsa, smotsa, motsp (things with truths), association, class_iou and lstq (the root of their product), pq, tq and pat (their harmonic mean)."""
    seg = segment_counts(points, ignored)
    by = class_tracking(seg, classes, things, least_points)
    there = lambda c: F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col(c))).alias(c)
    one = by.agg(there("ptq"), there("sptq"), *[F.avg(c).alias(c) for c in ("motsa", "smotsa", "motsp")], F.avg("pq").alias("pq"))
    rows = [one, tube_association(seg, things, least_points).agg(F.avg("association").alias("association")), class_overlap(seg, classes).agg(F.avg("iou").alias("class_iou")), track_quality(seg, things, least_points=least_points).agg(F.avg("quality").alias("tq"))]
    # four tables of one row
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))

    def rounded(c: Column) -> Column:
        return F.round(c, 6)

    lstq = F.sqrt(F.col("association") * F.col("class_iou"))
    pat = F.try_divide(2 * F.col("pq") * F.col("tq"), F.col("pq") + F.col("tq"))
    return out.select(*[rounded(F.col(c)).alias(c) for c in ("ptq", "sptq", "motsa", "smotsa", "motsp", "association", "class_iou")], rounded(lstq).alias("lstq"), *[rounded(F.col(c)).alias(c) for c in ("pq", "tq")], rounded(pat).alias("pat"))
