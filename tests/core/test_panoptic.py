"""Panoptic tracking on hand-made points."""

import math

from orrery.operators import panoptic


def points(spark, rows):
    """rows: scene, frame, truth class, truth, guess class, guess, points."""
    return spark.createDataFrame([r[:6] for r in rows for _ in range(r[6])], "scene int, frame int, truth_class int, truth bigint, guess_class int, guess bigint")


def test_perfect_tracks(spark):
    rows = [(0, f, 1, 5, 1, 9, 10) for f in range(4)] + [(0, f, 2, 0, 2, 0, 20) for f in range(4)]
    r = panoptic.panoptic_report(points(spark, rows), [1, 2], [1], least_points=2).first()
    assert all(v == 1 for v in r)


def test_a_switch_and_a_lost_frame(spark):
    # five frames: guessed 9, 9, nothing (as stuff of another class), 8, 8
    guesses = [(1, 9), (1, 9), (2, 0), (1, 8), (1, 8)]
    rows = [(0, f, 1, 5, c, g, 10) for f, (c, g) in enumerate(guesses)] + [(0, f, 2, 0, 2, 0, 40) for f in range(5)]
    seg = panoptic.segment_counts(points(spark, rows))
    by = {r["class"]: r for r in panoptic.class_tracking(seg, [1, 2], [1], 2).collect()}
    # the frame between breaks the succession, so no switch is counted
    assert (by[1].tp, by[1].fn, by[1].fp, by[1].ids) == (4, 1, 0, 0)
    assert by[1].motsa == 4 / 5
    q = panoptic.track_quality(seg, [1], least_points=2).first()
    # two guesses with two frames each out of five; lost at the gap and after it
    assert math.isclose(q.association, (4 / 5 + 4 / 5) / 5) and q.identity == 0.5 and q.frames == 5
    t = panoptic.tube_association(seg, [1], 2).first()
    assert t.points == 50 and math.isclose(t.association, 2 * 20 * (20 / 50) / 50)


def test_switch_between_neighbours(spark):
    rows = [(0, f, 1, 5, 1, g, 10) for f, g in enumerate([9, 8, 8])]
    seg = panoptic.segment_counts(points(spark, rows))
    r = panoptic.class_tracking(seg, [1, 3], [1, 3], 2).where("class = 1").first()
    assert (r.tp, r.ids, r.ptq, r.sptq, r.motsa) == (3, 1, 2 / 3, 2 / 3, 2 / 3)


def test_ignored_and_few_points(spark):
    rows = [(0, 0, 0, 3, 1, 9, 50), (0, 0, 1, 5, 1, 9, 10), (0, 0, 1, 6, 1, 7, 2), (0, 1, 0, 0, 0, 0, 5), (0, 2, 1, 5, 1, 9, 10)]
    seg = panoptic.segment_counts(points(spark, rows))
    assert {r.i for r in seg.collect()} == {1, 3}
    assert panoptic.tube_association(seg, [1], 2).count() == 1
    one = panoptic.track_quality(seg, [1], least_points=2).first()
    assert (one.truth, one.frames, one.quality) == (5, 2, 1.0)
    assert panoptic.panoptic_report(points(spark, []), [1], [1]).first().tq is None
