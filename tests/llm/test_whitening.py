"""Operator 11 against a plain decomposition of the covariance."""

import math
import os

import numpy as np
import pytest

from orrery.llm import embedding_whitening as ew
from orrery.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows, components=4):
    """(vec_id, component) -> values, from numpy's eigenvectors of the covariance of the distinct vectors."""
    sound = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    once = np.array(sorted({tuple(x) for _, x in sound}))
    n, sums = len(once), once.sum(axis=0)
    cov = np.cov(once.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in sound:
        dev = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        w = (np.array(x) - sums / n) @ vectors[:, order] / np.sqrt(values[order])
        out.append((i, dev, np.abs(w), values[order] / np.trace(cov)))
    return n, out


def agree(got, rows, components=4):
    n, want = plain(rows, components)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == components * len(want)
    for i, dev, w, share in want:
        mine = sorted(by[i], key=lambda r: r.component)
        assert {r.component for r in mine} == set(range(1, components + 1))
        for r in mine:
            assert r.n == n and r.deviation == dev and r.identity_error < 1e-8
            assert abs(r.whitened) == pytest.approx(w[r.component - 1], abs=1e-7)
            assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    return by


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of the rows share one vector
    return rows + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (7, rows[7][1])]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_any_partitioning_gives_the_covariances_eigenvectors(spark, vectors, parts):
    df = spark.createDataFrame([(i, v, 1, "y") for i, v in vectors], "vec_id bigint, embedding array<float>, x int, whitened string").repartition(parts)
    by = agree(ew.whitening_report(df).collect(), vectors)
    assert len({(r.component, r.whitened) for i in by for r in by[i] if i == 0 or i >= 1000}) == 4  # copies have equal results, signs included


def test_merging_loses_no_dimension():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, size=(64, 5))
    whole = ew.State.of(x)
    state = ew.State.of(x[:1])
    for i in range(1, 64, 7):
        state = state.merged(ew.State.of(x[i : i + 7]))
    assert state.n == 64 and (state.sums == whole.sums).all()
    assert np.allclose(state.axes.T @ state.axes, whole.axes.T @ whole.axes)


def test_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = ew.whitening_report(spark.createDataFrame(rows, schema))
        assert got.columns == names and got.collect() == []
    # one dimension has variance; vectors of another length are left out
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0]), (4, [1.0])]
    got = ew.whitening_report(spark.createDataFrame(rows, schema)).collect()
    assert [(r.vec_id, r.component, abs(r.whitened), r.explained) for r in sorted(got, key=lambda r: r.vec_id or 99)] == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (None, 1, 1.0, 1.0)]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i) * 2**30, 1.0]) for i in range(4)]
    got = ew.whitening_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agree(queries.QUERIES["op11_embedding_whitening"](spark, SF).collect(), rows)
