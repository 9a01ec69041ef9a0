"""Detection and tracking evaluation against plain replays."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import detection, tracking

CLASSES = ("car", "barrier", "traffic_cone", "bus", "bicycle")
BOX = "sample bigint, class string, box bigint, x double, y double, length double, width double, height double, yaw double, vx double, vy double, attribute string"


def make_boxes(rng):
    truth, guess = [], []
    for sample in range(30):
        for k in range(rng.randint(0, 12)):
            c = rng.choice(CLASSES[:4])
            row = [sample, c, sample * 100 + k, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(1, 5), rng.uniform(1, 3), 1.5, rng.uniform(-180, 180)]
            v = (None, None) if rng.random() < 0.3 else (rng.uniform(-3, 3), rng.uniform(-3, 3))
            truth.append((*row, *v, rng.choice([None, "moving", "parked"])))
            for copy in range(rng.randint(0, 2)):
                moved = [row[0], c, row[2] * 10 + copy, row[3] + rng.gauss(0, 1), row[4] + rng.gauss(0, 1), row[5] * rng.uniform(0.7, 1.4), row[6], row[7], row[8] + rng.gauss(0, 40)]
                guess.append((*moved, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice(["moving", "parked"]), rng.choice([0.1, 0.5, 0.9, rng.random(), rng.random()])))
        guess.append((sample, "bus", sample * 1000 + 999, 100.0, 100.0, 4.0, 2.0, 1.5, 0.0, 0.0, 0.0, "moving", rng.random()))
    return truth, guess


def replay(truth, guess, klass, threshold):
    """Precision at 101 recalls, confidence there, and the errors there."""
    gts = defaultdict(list)
    for t in truth:
        if t[1] == klass:
            gts[t[0]].append(t)
    n = sum(map(len, gts.values()))
    mine = sorted((g for g in guess if g[1] == klass), key=lambda g: (-g[12], -g[2]))
    taken, hit, errors = set(), [], []
    for g in mine:
        best = min(((math.hypot(t[3] - g[3], t[4] - g[4]), t[2], t) for t in gts[g[0]] if t[2] not in taken), default=None)
        hit.append(best is not None and best[0] < threshold)
        if hit[-1]:
            t = best[2]
            taken.add(t[2])
            both = min(t[5], g[5]) * min(t[6], g[6]) * 1.5
            turn = abs((t[8] - g[8] + 180) % 360 - 180)
            if klass == "barrier":
                turn = abs((t[8] - g[8] + 90) % 180 - 90)
            errors.append([best[0], 1 - both / ((t[5] * t[6] + g[5] * g[6]) * 1.5 - both), math.radians(turn), np.nan if t[9] is None else math.hypot(t[9] - g[9], t[10] - g[10]), np.nan if t[11] is None else float(t[11] != g[11])])
    if not n or not errors:
        return 0.0, [1.0] * 5
    tp = np.cumsum(hit)
    at = np.linspace(0, 1, 101)
    precision = np.interp(at, tp / n, tp / np.arange(1, len(tp) + 1), right=0)
    conf = np.interp(at, tp / n, [g[12] for g in mine], right=0)
    scores = [g[12] for g, h in zip(mine, hit, strict=True) if h]
    out, last = [], np.flatnonzero(conf)[-1]
    for e in np.array(errors).T:
        known = ~np.isnan(e)
        mean = np.ones(len(e)) if not known.any() else np.divide(np.nancumsum(e), np.cumsum(known), out=np.zeros(len(e)), where=np.cumsum(known) > 0)
        out.append(1.0 if last < 11 else float(np.interp(conf[::-1], scores[::-1], mean[::-1])[::-1][11 : last + 1].mean()))
    return float(np.maximum(precision[11:] - 0.1, 0).mean() / 0.9), out


@pytest.mark.parametrize("seed", [1, 2])
def test_detection_equals_a_replay(spark, seed):
    truth, guess = make_boxes(random.Random(seed))
    t, g = spark.createDataFrame(truth, BOX).repartition(3), spark.createDataFrame(guess, BOX + ", score double").repartition(4)
    got = {r["class"]: r for r in detection.detection_report(t, g, CLASSES).collect()}
    aps, all_errors = [], defaultdict(list)
    for c in CLASSES:
        want = [replay(truth, guess, c, x)[0] for x in detection.THRESHOLDS]
        assert [got[c].ap_0_5, got[c].ap_1, got[c].ap_2, got[c].ap_4] == pytest.approx(want, abs=2e-6)
        aps.append(np.mean(want))
        for name, e in zip(detection.ERRORS, replay(truth, guess, c, 2.0)[1], strict=True):
            if name in detection.UNDEFINED.get(c, ()):
                assert got[c][name] is None
            else:
                assert got[c][name] == pytest.approx(e, abs=2e-6)
                all_errors[name].append(e)
    score = (5 * np.mean(aps) + sum(max(0, 1 - np.mean(e)) for e in all_errors.values())) / 10
    assert got[None].score == pytest.approx(score, abs=6e-5) and got[None].ap == pytest.approx(np.mean(aps), abs=6e-5)


def test_detection_without_boxes(spark):
    none, one = spark.createDataFrame([], BOX + ", score double"), spark.createDataFrame(make_boxes(random.Random(3))[0], BOX)
    got = {r["class"]: r for r in detection.detection_report(one, none, CLASSES).collect()}
    assert got[None].ap == 0 and got[None].score == 0 and got["car"].translation == 1 and got["barrier"].velocity is None


# --- tracks


def plain_fill(rows, frames):
    """(scene, i, class, track, x, y, score) with gaps filled by the protocol's weights."""
    out, by = [], defaultdict(dict)
    for s, t, c, k, x, y, *score in rows:
        by[s, k][t] = (c, x, y, score[0] if score else None)
    for (s, k), at in by.items():
        times = sorted(t for q, t in frames if q == s)
        mean = None if None in [v[3] for v in at.values()] else np.mean([v[3] for v in at.values()])
        for i, t in enumerate(times):
            if min(at) <= t <= max(at):
                if t in at:
                    c, x, y, _ = at[t]
                else:
                    r, lo = min(u for u in at if u > t), max(u for u in at if u < t)
                    w = (r - t) / (r - lo)
                    c, x, y = at[r][0], (1 - w) * at[lo][1] + w * at[r][1], (1 - w) * at[lo][2] + w * at[r][2]
                out.append((s, i + 1, c, k, x, y, mean))
    return out


def assign(gt, pr, far):
    """All pairs closer than the radius: most of them, then least distance, by trying every way."""
    best = (0, 0.0, [])
    small, large = (gt, pr) if len(gt) <= len(pr) else (pr, gt)
    for way in itertools.permutations(large, len(small)):
        pairs = [(a, b) if len(gt) <= len(pr) else (b, a) for a, b in zip(small, way, strict=True)]
        pairs = [p for p in pairs if far[p] < 2.0]
        best = min(best, (-len(pairs), sum(far[p] for p in pairs), pairs))
    return best[2]


def plain_mot(gts, prs, klass, threshold):
    """Events of one class: per true track its states and distances; false guesses, frames, scores of plain matches."""
    states, dist, false, frames, scores = defaultdict(list), defaultdict(float), 0, 0, []
    for s in sorted({r[0] for r in gts + prs}):
        last = {}
        for i in sorted({r[1] for r in gts + prs if r[0] == s}):
            g = {r[3]: r for r in sorted(gts) if r[:3] == (s, i, klass)}
            p = {r[3]: r for r in sorted(prs) if r[:3] == (s, i, klass) and (threshold is None or r[6] >= threshold)}
            if not g and not p:
                continue
            frames += 1
            far = {(a, b): math.hypot(g[a][4] - p[b][4], g[a][5] - p[b][5]) for a in g for b in p}
            pairs = {}
            for a in sorted(g):
                if last.get(a) in p and last[a] not in pairs.values() and far[a, last[a]] < 2.0:
                    pairs[a] = last[a]
            state = dict.fromkeys(pairs, 1)
            for a, b in assign([a for a in sorted(g) if a not in pairs], [b for b in sorted(p) if b not in pairs.values()], far):
                state[a] = 2 if a in last and last[a] != b else 1
                pairs[a] = b
            for a in g:
                states[s, a].append(state.get(a, 0))
                if a in pairs:
                    dist[s, a] += far[a, pairs[a]]
                    last[a] = pairs[a]
                    if state[a] == 1:
                        scores.append(p[pairs[a]][6])
            false += len(p) - len(pairs)
    return states, dist, false, frames, scores


def plain_measures(states, dist, false, frames):
    n, hits, ids = sum(map(len, states.values())), sum(x > 0 for s in states.values() for x in s), sum(x == 2 for s in states.values() for x in s)
    tid = lgd = frag = tracked = 0
    for s in states.values():
        on = [i for i, x in enumerate(s) if x]
        if on:
            tracked += 1
            tid += 0.5 * on[0]
            lgd += 0.5 * max(len(list(g)) if k == 0 else 0 for k, g in itertools.groupby(min(x, 1) for x in s))
            frag += sum(s[i] > 0 and s[i + 1] == 0 for i in range(on[0], on[-1]))
    tp = hits - ids
    return {
        "motar": None if tp == 0 else max(0.0, 1 - false / tp), "mota": max(0.0, 1 - (n - hits + ids + false) / n) if n else None, "motp": sum(dist.values()) / hits if hits else None, "recall": hits / n if n else None, "faf": 100 * false / frames,
        "mt": sum(sum(x > 0 for x in s) >= 0.8 * len(s) for s in states.values()), "ml": sum(sum(x > 0 for x in s) < 0.2 * len(s) for s in states.values()), "tp": tp, "fp": false, "fn": n - hits, "ids": ids, "frag": frag,
        "tid": tid / tracked if tracked else None, "lgd": lgd / tracked if tracked else None,
    }


def plain_report(truth, guess, frames, classes):
    gts, prs = plain_fill(truth, frames), plain_fill(guess, frames)
    out = {}
    for c in classes:
        n = sum(r[2] == c for r in gts)
        if not n:
            out[c] = None
            continue
        scores = sorted(plain_mot(gts, prs, c, None)[4], reverse=True)
        rows = []
        for r in np.linspace(0.1, 1, 40).round(12):
            if not scores or r > len(scores) / n:
                rows.append((r, None))
            else:
                t = float(np.interp(r, np.arange(1, len(scores) + 1) / n, scores))
                rows.append((r, plain_measures(*plain_mot(gts, prs, c, t)[:4])))
        best = max((m["mota"], r) for r, m in rows if m)[1] if scores else None
        one = next((m for r, m in rows if r == best), None)
        out[c] = (np.mean([0.0 if m is None or m["motar"] is None else m["motar"] for _, m in rows]), np.mean([2.0 if m is None or m["motp"] is None else m["motp"] for _, m in rows]), one, n)
    return out


def make_tracks(rng):
    truth, guess, frames = [], [], [(s, t) for s in range(3) for t in (0, 5, 10, 20, 25, 30, 40, 50)]
    for s in range(3):
        for k in range(4):
            c, x0 = ("car", "bus")[k % 2], rng.uniform(0, 6)
            for t in sorted({t for q, t in frames if q == s})[rng.randint(0, 2) :]:
                x, y = x0 + t * 0.1, k * 1.3
                if rng.random() < 0.8:
                    truth.append((s, t, c, k, x, y))
                if rng.random() < 0.75:
                    guess.append((s, t, c, k if t < 25 or k < 2 else 20 - k, x + rng.gauss(0, 0.4), y + rng.gauss(0, 0.4), rng.choice([0.3, rng.random()])))
        for t in (5, 10, 40):
            guess.append((s, t, "car", 99, 50.0, 50.0, 0.4))
    return truth, guess, frames


def track_frames(spark, truth, guess, frames):
    schema = "scene bigint, t bigint, class string, track bigint, x double, y double"
    return spark.createDataFrame(truth, schema).repartition(3), spark.createDataFrame(guess, schema + ", score double"), spark.createDataFrame(frames, "scene bigint, t bigint")


@pytest.mark.parametrize("seed", [5, 6])
def test_tracking_equals_a_replay(spark, seed):
    data = make_tracks(random.Random(seed))
    classes = ("car", "bus", "trailer")
    got = {r["class"]: r for r in tracking.track_report(*track_frames(spark, *data), classes).collect()}
    want = plain_report(*data, classes)
    assert got["trailer"].gt is None and got["trailer"].amota is None
    for c in ("car", "bus"):
        amota, amotp, one, n = want[c]
        assert got[c].gt == n and got[c].amota == pytest.approx(amota, abs=2e-6) and got[c].amotp == pytest.approx(amotp, abs=2e-6)
        for m, v in one.items():
            assert got[c][m] == (None if v is None else pytest.approx(v, abs=2e-6)), (c, m)
    assert got[None].ids == got["car"].ids + got["bus"].ids and got[None].amota == pytest.approx((got["car"].amota + got["bus"].amota) / 2, abs=2e-6)


def scenario(spark, gt, pred):
    rows = lambda p: [(0, t, "car", k, float(x), float(y)) for k, track in enumerate(p) for t, (x, y) in enumerate(track)]
    data = rows(gt), [(*r, 0.5) for r in rows(pred)], [(0, t) for t in range(len(gt[0]))]
    return {r["class"]: r for r in tracking.track_report(*track_frames(spark, *data), ("car",)).collect()}["car"]


def test_moving_scenarios(spark):
    """Side by side and crossing tracks switch no identity; a guess that jumps away for one frame switches two."""
    beside = [[(1, y) for y in range(-3, 1)], [(0, y) for y in range(-3, 1)]]
    closer = [[(0.7, y) for y in range(-3, 1)], [(0.3, y) for y in range(-3, 1)]]
    crossing = [[(2, -3), (1, -2), (0, -1), (-1, 0)], [(-2, -3), (-1, -2), (0, -1), (1, 0)]]
    for gt, pred in ((beside, beside), (beside, closer), (closer, closer), (crossing, crossing)):
        r = scenario(spark, gt, pred)
        assert (r.ids, r.fp, r.fn, r.amota, r.mt) == (0, 0, 0, 1, 2)
    jump = scenario(spark, [[(-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0)]], [[(0, -2), (0, -1), (0, 0), (0, 1), (0, 2)], [(-2, 0), (-1, 0), (3, 0), (1, 0), (2, 0)]])
    assert jump.ids == 2


def test_no_matches_give_the_worst(spark):
    far = scenario(spark, [[(0, 0), (1, 0)]], [[(90, 0), (91, 0)]])
    assert (far.amota, far.amotp, far.mota, far.motp, far.faf, far.tid, far.lgd, far.ml, far.fn, far.fp, far.gt) == (0, 2, 0, 2, 500, 20, 20, 1, 2, None, 2)


def test_filling(spark):
    truth = [(0, 0, "car", 1, 0.0, 0.0), (0, 30, "bus", 1, 9.0, 3.0), (1, 5, "car", 1, 1.0, 1.0)]
    frames = [(0, t) for t in (0, 10, 20, 30, 40)] + [(1, 5), (1, 6)]
    got = sorted(map(tuple, tracking.filled_tracks(track_frames(spark, truth, [(0, 0, "car", 1, 0.0, 0.0, 0.5)], frames)[0], track_frames(spark, truth, [(0, 0, "car", 1, 0.0, 0.0, 0.5)], frames)[2]).collect()))
    assert [g[:4] for g in got] == [(0, 1, "car", 1), (0, 2, "bus", 1), (0, 3, "bus", 1), (0, 4, "bus", 1), (1, 1, "car", 1)]
    # the later neighbour has the share of the time that is left until it
    assert [round(g[4], 6) for g in got] == [0.0, 6.0, 3.0, 9.0, 1.0]


def test_thresholds_send_no_ranks_to_the_driver(spark, tmp_path):
    # equal scores are small on disk, so a table of all ranks would be broadcast
    n = 600_000
    spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, "car").otherwise("bus").alias("class"), (F.floor(F.col("id") / 20000) / 100).cast("double").alias("score")).write.parquet(str(tmp_path / "s"))
    positives = spark.createDataFrame([("car", n * 5 // 4), ("bus", n), ("van", 3)], "class string, n bigint")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48m")
    try:
        got = tracking.score_thresholds(spark.read.parquet(str(tmp_path / "s")), positives).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    falling = sorted((k // 20000 / 100 for k in range(0, 2 * n, 2)), reverse=True)
    for r in got:
        of = {"car": n * 5 // 4, "bus": n, "van": 3}[r["class"]]
        at, share = divmod(r.recall * of + 1e-9, 1)
        if r["class"] == "van" or r.recall > n / of + 1e-12:
            assert r.threshold is None
        else:
            low, high = (falling[int(k) - 1] if 0 < k <= n else None for k in (at, at + 1))
            want = high if low is None else low if high is None else low + (high - low) * share
            assert r.threshold == pytest.approx(want, abs=1e-6)
    assert len(got) == 3 * tracking.STEPS


def test_few_points_are_gathered(spark, monkeypatch):
    """Recalls ask for a few points of a curve: the others are not gathered by their number of hits, and the classes are computed once."""
    from pyspark.sql import functions as F

    from orrery.operators import metrics

    curve = spark.range(2000).select(F.lit("car").alias("class"), (F.col("id") + 1).alias("k"), (F.col("id") + 1).alias("tp"), F.lit(2000).cast("bigint").alias("positives"), (1 - F.col("id") / 4000).alias("score"))
    at = metrics.at_recalls(curve, "class", "score")
    assert "LeftSemi" in at._jdf.queryExecution().optimizedPlan().toString()
    got = {r.bin: r.score for r in at.collect()}
    assert len(got) == 101 and got[0] == 1 and abs(got[50] - (1 - 999 / 4000)) < 1e-12
    written, durable = [], detection.durable
    monkeypatch.setattr(detection, "durable", lambda df, name: written.append(name) or durable(df, name))
    columns = "sample bigint, class string, box bigint, x double, y double, length double, width double, height double, yaw double, vx double, vy double, attribute string"
    row = (1, "car", 1, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, None)
    report = detection.detection_report(spark.createDataFrame([row], columns), spark.createDataFrame([(*row, 0.5)], columns + ", score double"), ("car",))
    assert written[-1] == "classes" and report.count() == 2


def test_protocol_deals_lines_once(spark, monkeypatch, tmp_path):
    """Lines travel once, and of the curves only the points that recalls ask for are written: a detection is one row, not one for each threshold."""
    from orrery.plans import protocol

    written, durable = {}, detection.durable
    monkeypatch.setattr(detection, "durable", lambda df, name: written.setdefault(name, durable(df, name)))
    boxes = protocol._boxes(spark, "/root/testdata/sf0.001")
    rows = detection.matched_once(boxes, detection.THRESHOLDS, 2.0)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    report = protocol.detection_protocol(spark, "/root/testdata/sf0.001")
    guesses = boxes.where("not is_truth").count()
    assert written["matches"].where("found").count() == guesses and "curve" not in written
    assert written["matches"].agg({"truths": "sum"}).first()[0] == boxes.where("is_truth").count()
    assert written["points"].count() <= 2 * 101 * 10 * 4 and report.count() == 11
