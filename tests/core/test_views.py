"""Clipped hulls, projection on lanes, off-road rate and selection against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.operators import constraints, planning, spatial


def hull(points):
    out = []
    for way in (sorted(set(points)), sorted(set(points), reverse=True)):
        part = []
        for p in way:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]):
                part.pop()
            part.append(p)
        out += part[:-1]
    return out or list(set(points))


def clip(polygon, w, h):
    for axis, limit, sign in ((0, 0, 1), (0, w, -1), (1, 0, 1), (1, h, -1)):
        out = []
        for p, q in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if a >= 0:
                out.append(p)
            if (a > 0 > b) or (a < 0 < b):
                out.append(tuple(x + (y - x) * a / (a - b) for x, y in zip(p, q, strict=True)))
        polygon = out
        if not polygon:
            return None
    return min(p[0] for p in polygon), min(p[1] for p in polygon), max(p[0] for p in polygon), max(p[1] for p in polygon)


def test_clipped_hull(spark):
    rng = random.Random(9)
    rows = [(k, [(rng.uniform(-80, 180), rng.uniform(-60, 110)) for _ in range(rng.choice([3, 4, 8]))]) for k in range(150)]
    rows += [(900, [(-10.0, 20.0), (20.0, -10.0), (-30.0, -30.0)]), (901, [(-50.0, -50.0), (300.0, -50.0), (300.0, 200.0), (-50.0, 200.0)]), (902, [(-5.0, 10.0), (-1.0, 40.0), (-9.0, 3.0)]), (903, [(50.0, 25.0)]), (904, [(-20.0, 25.0), (40.0, 25.0)]), (905, [])]
    df = spark.createDataFrame(rows, "id int, p array<struct<u:double,v:double>>").repartition(3)
    got = {r.id: r.b for r in df.select("id", G.clipped_hull(F.col("p"), 100.0, 50.0).alias("b")).collect()}
    for k, points in rows:
        want = clip(hull(points), 100.0, 50.0) if points else None
        assert got[k] is None if want is None else tuple(got[k]) == pytest.approx(want, abs=1e-9), k
    # points are paired once, and each pair meets the later points
    assert df.select(G.clipped_hull(F.col("p"), 100.0, 50.0).alias("b"))._jdf.queryExecution().optimizedPlan().toString().count("slice(") == 2
    # the corner of the hull outside does not widen the extent
    assert tuple(got[900]) == pytest.approx((0, 0, 10, 10))


def walk(paths, step):
    """Poses of a lane by short steps along its arcs."""
    out = []
    for x, y, yaw, lengths, bends in paths:
        total = sum(lengths)
        n = int(max(math.ceil(total / step) + 1.5, 2))
        for k in range(n):
            left, px, py, a = k / (n - 1) * total, x, y, yaw
            for length, bend in zip(lengths, bends, strict=True):
                go = min(left, length)
                m = 2000
                for _ in range(m):
                    px, py, a = px + math.cos(a + bend * go / m / 2) * go / m, py + math.sin(a + bend * go / m / 2) * go / m, a + bend * go / m
                left -= go
            out.append((px, py, a))
    return out


def test_projection_on_lanes(spark):
    lanes = {1: [(0.0, 0.0, 0.3, [2.0, 0.0, 3.0], [0.2, 0.0, -0.4]), (4.0, 2.0, 0.0, [1.0, 1.0, 1.5], [0.0, 0.5, 0.0])], 2: [(-3.0, 1.0, 2.0, [1.0, 2.0, 1.0], [-0.5, 0.0, 0.5])]}
    paths = spark.createDataFrame([(lane, k, *p) for lane, ps in lanes.items() for k, p in enumerate(ps)], "lane int, part int, x double, y double, yaw double, lengths array<double>, curvatures array<double>")
    rng = random.Random(3)
    poses = [(i, rng.choice([1, 2]), rng.uniform(-5, 8), rng.uniform(-4, 6)) for i in range(40)]
    got = {r.id: r for r in spatial.projected_on_lanes(spark.createDataFrame(poses, "id int, lane int, x double, y double"), paths).collect()}
    for i, lane, x, y in poses:
        all_ = walk(lanes[lane], 0.5)
        k = min(range(len(all_)), key=lambda k: math.hypot(all_[k][0] - x, all_[k][1] - y))
        assert got[i].along == 0.5 * k and (got[i].x, got[i].y) == pytest.approx(all_[k][:2], abs=1e-5)
    places = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 2.1), (1, 5.0), (1, 6.5), (1, 8.5), (1, 9.0), (2, 1.0), (3, 1.0)], "lane int, along double")
    bends = {(r.lane, r.along): r.curvature for r in spatial.curvature_along(places, paths).collect()}
    assert bends == {(1, 0.0): 0.2, (1, 2.0): 0.2, (1, 2.1): 0.4, (1, 5.0): 0.4, (1, 6.5): 0.5, (1, 8.5): 0.0, (1, 9.0): None, (2, 1.0): 0.5, (3, 1.0): None}


def test_off_road_rate(spark):
    square = lambda k, x: (k, [(x, 0.0), (x + 4, 0.0), (x + 4, 4.0), (x, 4.0)])
    polygons = spark.createDataFrame([square(0, 0.0), square(1, 6.0)], "poly bigint, ring array<struct<x:double,y:double>>")
    modes = {(1, 0): [(1.0, 1.0), (2.0, 3.0)], (1, 1): [(1.0, 1.0), (7.0, 1.0)], (2, 0): [(6.5, 1.0), (6.5, 9.0)], (2, 1): [(9.0, 3.0)], (3, 0): [(1.0, 1.0), (3.5, 3.5), (1.0, 3.5)]}
    df = spark.createDataFrame([(i, m, t, x, y) for (i, m), ps in modes.items() for t, (x, y) in enumerate(ps)], "id int, mode int, t int, x double, y double")
    got = {r.id: (r.modes, r.rate) for r in spatial.off_road_rate(df, polygons, 4.0).collect()}
    assert got == {1: (2, 0.5), 2: (2, 0.5), 3: (1, 0.0)}
    # places between points are looked up where they arise: nothing is dealt out by place
    plan = spatial.off_road_rate(df, polygons, 4.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 3


def test_sharing_counts_equal_the_listed_pairs(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randint(0, 25) for _ in range(rng.randint(0, 5))]) for i in range(150)] + [(200 + i, [3, 4, 9]) for i in range(7)] + [(300 + i, [5]) for i in range(4)] + [(400, [1, None, 2]), (401, [2, 1]), (402, [None])]
    df = spark.createDataFrame(rows, "id bigint, nodes array<bigint>").repartition(3)
    want = set()
    for kind, every in (("any", False), ("all", True)):
        want |= {(kind, r.shared, r.n) for r in spatial.sharing_nodes(df, df, every).where("id <> other").groupBy("shared").agg(F.count("*").alias("n")).collect()}
    assert {tuple(r) for r in spatial.sharing_counts(df).collect()} == want
    # many copies make no pairs: listed, these would be 1.6 billion
    copies = spark.range(40000).select("id", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("nodes"))
    assert {tuple(r) for r in spatial.sharing_counts(copies).collect()} == {("any", 3, 40000 * 39999), ("all", 3, 40000 * 39999)}


# --- selection


def plain_phases(rows, share, window):
    """rows: key, score, {slot: covers}; the picks as (phase, key, slot, delta)."""
    covered, out, streak, every = set(), [], 0, {k for k, _, _ in rows}
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    counts = dict.fromkeys("ABCD", 0)
    for phase in (1, 2):
        for k, _, plans in rows:
            if phase == 1 and (len(covered) / len(every) >= share or streak >= window):
                break
            if k in covered:
                continue
            choice = [s for s in sorted("ABCD", key=lambda s: (counts[s], s)) if s in plans and (phase == 2 or s == "A")]
            if choice:
                new = (set(plans[choice[0]]) & every) - covered
                covered |= new
                counts[choice[0]] += 1
                streak = streak + 1 if len(new) <= 1 else 0
                out.append((phase, k, choice[0], len(new)))
    return out


@pytest.mark.parametrize(("share", "window"), [(0.25, 10), (0.9, 3), (0.0, 10), (1.0, 100)])
def test_two_phases(spark, share, window):
    rng = random.Random(8)
    frames = {}
    for f in range(4):
        keys = [f"k{i:02d}" for i in range(60)]
        frames[f] = [(k, rng.randint(1, 9), {s: [k, *rng.sample(keys, rng.randint(0, 3))] if s == "A" else [k] for s in "ABCD" if rng.random() < 0.6}) for k in keys]
    rows = [(f, k, n, list(p.items())) for f, rs in frames.items() for k, n, p in rs]
    df = spark.createDataFrame(rows, "frame bigint, key string, score int, plans array<struct<slot:string,covers:array<string>>>").repartition(3)
    got = constraints.two_phase_selection(df, share, window).orderBy("frame", "step").collect()
    for f, rs in frames.items():
        assert [(r.phase, r.key, r.slot, r.delta) for r in got if r.frame == f] == plain_phases(rs, share, window)


def test_lazy_selection_is_plain_selection(spark):
    rng = random.Random(2)
    rows = [(f, f"{f}-{i:03d}", *rng.sample("abcdefghijklmnop", 3)) for f in range(3) for i in range(80)]
    got = constraints.select_gaps(spark.createDataFrame(rows, "frame bigint, key string, a string, b string, c string").repartition(4), 25).orderBy("frame", "step").collect()
    for f in range(3):
        left, nodes, pairs = {k: (a, b, c) for g, k, a, b, c in rows if g == f}, set(), set()
        for r in (r for r in got if r.frame == f):
            worth = {k: 100 * len({*p} - nodes) + 10 * len({frozenset(p[:2]), frozenset(p[1:])} - pairs) + 1 for k, p in left.items()}
            best = min(left, key=lambda k: (-worth[k], k))
            assert (r.key, r.score) == (best, worth[best])
            p = left.pop(best)
            nodes |= {*p}
            pairs |= {frozenset(p[:2]), frozenset(p[1:])}
    assert len(got) == 75


def test_plateau_step(spark):
    new = [5, 1, 0, 2, 1, 1, 1, 0, 4]
    curve = spark.createDataFrame([(0, "L1", i, n) for i, n in enumerate(new)] + [(1, "L1", 0, 1)], "frame int, level string, ord int, new_keys int")
    assert {r.frame: r.ord for r in planning.plateau_step(curve, 3).collect()} == {0: 6, 1: None}
    assert {r.frame: r.ord for r in planning.plateau_step(curve, 1).collect()} == {0: 1, 1: 0}
