"""Tracking metrics on small fixtures."""

from pyspark.sql import functions as F

from orrery.operators import metrics


def test_panoptic_tracking(spark):
    rows = [(0, f, "car", 1, g) for f, g in ((0, 5), (1, 5), (2, 6), (3, 6)) for _ in range(4)] + [(1, 0, "car", 1, 9)] * 4
    r = metrics.panoptic_tracking(spark.createDataFrame(rows, "scene int, frame int, class string, truth int, guess int")).first()
    assert (r.switches, r.ptq, r.sptq) == (1, 0.8, 0.8)


def test_thresholds(spark):
    scored = spark.createDataFrame([("c", i, s, h) for i, (s, h) in enumerate([(0.9, True), (0.8, False), (0.7, True)])], "class string, i int, s double, h boolean")
    got = metrics.recall_thresholds(scored, "class", "s", "i", "h", spark.createDataFrame([("c", 4)], "class string, n int"), steps=4).orderBy("recall").collect()
    assert [(round(r.recall, 2), r.threshold) for r in got] == [(0.1, 0.9), (0.4, 0.7), (0.7, None), (1.0, None)]


def test_summary(spark):
    rows = [("c", 0.9, 0.5, 0.4, 0.2, 4, 1, 2, 0), ("c", 0.5, 0.7, 0.6, 0.4, 6, 2, 1, 1), ("c", 0.1, None, None, None, None, None, None, None)]
    r = metrics.tracking_summary(spark.createDataFrame(rows, "class string, threshold double, motar double, mota double, motp double, tp int, fp int, fn int, switches int")).first()
    assert (r.amota, round(r.amotp, 6), r.mota, r.tp, r.switches) == (0.4, 0.866667, 0.6, 6, 1)
    assert round(spark.range(1).select(metrics.detection_score(F.lit(0.5), *[F.lit(x) for x in (0.2, 0.4, 2.0, 0.0, 1.0)]).alias("s")).first().s, 6) == round((2.5 + 0.8 + 0.6 + 1) / 10, 6)
