"""Round trips of binary point files and labels; answers with their support against trying all ways."""

import itertools
import random
import struct

import numpy as np
import pytest

from orrery.operators import patterns, provenance
from orrery.sources import clouds

SIZES = (4, 4, 4, 1, 2, 4, 4, 4, 4, 4, 1, 1, 1, 1, 1, 1, 1, 1)
TYPES = "FFFIIFFFFFIIIIIIII"
CODE = {("F", 4): "f", ("I", 1): "b", ("I", 2): "h"}


def cloud(points, width=None):
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(clouds.RADAR_FIELDS), "SIZE " + " ".join(map(str, SIZES)), "TYPE " + " ".join(TYPES), "COUNT" + " 1" * 18]
    head += [f"WIDTH {len(points) if width is None else width}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(points)}", "DATA binary"]
    code = "<" + "".join(CODE[t, s] for t, s in zip(TYPES, SIZES, strict=True))
    return "\n".join(head).encode() + b"\n" + b"".join(struct.pack(code, *p) for p in points)


def test_radar_files(spark, tmp_path):
    rng = random.Random(4)
    point = lambda: [np.float32(rng.uniform(-9, 9)).item() if t == "F" else rng.randint(0, 4) for t in TYPES]
    files = {"a": [point() for _ in range(60)], "b": [point() for _ in range(3)], "c": [[float("nan")] + point()[1:], point()], "d": []}
    for name, points in files.items():
        (tmp_path / f"{name}.pcd").write_bytes(cloud(points))
    got = clouds.read_radar(spark, str(tmp_path / "*.pcd"))
    back = sorted((r.path.rsplit("/", 1)[1][0], r.k, *[r[f] for f in clouds.RADAR_FIELDS]) for r in got.collect())
    assert back == sorted((n, k, *map(float, p)) for n, ps in files.items() if n != "c" for k, p in enumerate(ps))
    kept = clouds.kept_returns(got)
    assert kept.count() == sum(p[14] == 0 and p[3] <= 6 and p[11] == 3 for n in "ab" for p in files[n])
    assert clouds.kept_returns(got, range(18), range(18), range(18)).count() == 63
    assert clouds.without_close(got, 5.0).count() == sum(not (abs(p[0]) < 5 and abs(p[1]) < 5) for n in "ab" for p in files[n])


def test_broken_radar_file():
    with pytest.raises(ValueError):
        clouds.parsed_cloud(cloud([], width=1))
    with pytest.raises(ValueError):
        clouds.parsed_cloud(b"no header")


def test_labels(spark, tmp_path):
    raw = bytes(range(256)) * 3
    (tmp_path / "x.bin").write_bytes(raw)
    np.savez_compressed(tmp_path / "y.npz", data=np.array([1003, 24000, 7], np.uint16))
    got = clouds.read_labels(spark, str(tmp_path / "*")).orderBy("path", "k").collect()
    assert [r.label for r in got if r.path.endswith(".bin")] == list(raw)
    parts = clouds.panoptic_parts(clouds.read_labels(spark, str(tmp_path / "*.npz"))).orderBy("k").collect()
    assert [(r["class"], r.instance) for r in parts] == [(1, 3), (24, 0), (0, 7)]


def test_answers_with_support(spark):
    rng = random.Random(6)
    nodes = [(f, i, rng.choice(["car", "bus"]), rng.choice(["moving", "parked"])) for f in range(6) for i in range(7)]
    edges = [(f, a, b, rng.choice(["front", "left"]), rng.uniform(1, 9)) for f in range(6) for a, b in itertools.permutations(range(7), 2) if rng.random() < 0.4]
    n = spark.createDataFrame(nodes, "frame int, id bigint, type string, status string")
    e = spark.createDataFrame(edges, "frame int, src bigint, dst bigint, dir4 string, dist double")
    car = patterns.Obj("car", None, None, (patterns.Relation(patterns.Obj("bus"), "front", "dir4"),))
    obj = patterns.Obj(None, "moving", None, (patterns.Relation(car, "left", "dir4", 8.0), patterns.Relation(patterns.Obj(None, "parked"), None)))
    kind, state = {(f, i): t for f, i, t, _ in nodes}, {(f, i): s for f, i, _, s in nodes}
    got = {k: {r.frame: r for r in provenance.answers_with_support(n, e, obj, k).collect()} for k in ("count", "exist", "status", "object")}
    for f in range(6):
        mine = [x for x in edges if x[0] == f]
        ways = []
        for (_, a, b, d, _), (_, c, x, g, far), (_, p, y, _, _) in itertools.product(mine, repeat=3):
            if d == "front" and kind[f, a] == "bus" and kind[f, b] == "car" and c == b and g == "left" and far <= 8 and x == y and state[f, x] == "moving" and state[f, p] == "parked":
                ways.append((x, {(a, b), (b, x), (p, x)}))
        ids = sorted({x for x, _ in ways})
        assert got["count"][f].answer == str(len(ids)) and got["count"][f].ids == ids and got["exist"][f].answer == ("yes" if ids else "no")
        assert [tuple(s) for s in got["count"][f].support] == sorted(set().union(*[s for _, s in ways]))
        assert got["object"][f].answer == (kind[f, ids[0]] if ids else None) and got["status"][f].answer == ("moving" if ids else None)
        assert [tuple(s) for s in got["status"][f].support] == sorted(set().union(*[s for x, s in ways if x == ids[0]]) if ids else [])
    keys = {(r.frame, r.level, r.key) for r in provenance.support_footprint(provenance.answers_with_support(n, e, obj)).collect()}
    for f in range(6):
        support = [tuple(s) for s in got["count"][f].support]
        assert {k for g, v, k in keys if g == f and v == "L0"} == {str(i) for s in support for i in s}
        assert len({k for g, v, k in keys if g == f and v == "L1"}) == len({frozenset(s) for s in support})
