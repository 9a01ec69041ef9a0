"""Isomorphism classes against trying every bijection."""

import itertools
import random

import pytest

from orrery.operators import isomorphism


def same(a, b):
    (ta, ea), (tb, eb) = a, b
    if len(ta) != len(tb) or len(ea) != len(eb):
        return False
    return any(all(ta[i] == tb[p[i]] for i in range(len(ta))) and sorted((p[x], p[y], c) for x, y, c in ea) == sorted(eb) for p in itertools.permutations(range(len(ta))))


def classes(graphs):
    heads, out = [], {}
    for k in sorted(graphs):
        head = next((h for h in heads if same(graphs[h], graphs[k])), k)
        if head == k:
            heads.append(k)
        out[k] = head
    return out


def run(spark, graphs):
    rng = random.Random(1)
    nodes, edges = [], []
    for k, (types, es) in graphs.items():
        ids = rng.sample(range(1000), len(types))
        nodes += [(k, ids[i], t) for i, t in enumerate(types)]
        edges += [(k, ids[x], ids[y], c) for x, y, c in es]
    n = spark.createDataFrame(nodes, "graph bigint, id bigint, type string").repartition(3)
    e = spark.createDataFrame(edges, "graph bigint, src bigint, dst bigint, label string")
    return {r["graph"]: r["class"] for r in isomorphism.isomorphism_classes(n, e).collect()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("points")))


def ring(n, at=0):
    return [(at + i, at + (i + 1) % n, "x") for i in range(n)]


def test_graphs_with_equal_colours(spark, folder):
    six, triangles = (["a"] * 6, ring(6)), (["a"] * 6, ring(3) + ring(3, 3))
    both = lambda es: es + [(y, x, c) for x, y, c in es]
    prism = both(ring(3) + ring(3, 3) + [(i, i + 3, "x") for i in range(3)])
    bipartite = both([(i, j, "x") for i in range(3) for j in range(3, 6)])
    turned = [((x * 5 + 2) % 6, (y * 5 + 2) % 6, c) for x, y, c in prism]
    graphs = {0: six, 1: triangles, 2: (["a"] * 6, turned), 3: (["a"] * 6, bipartite), 4: (["a"] * 6, prism), 5: (["a"] * 6, ring(3, 3) + ring(3)), 6: (["a"] * 12, []), 7: (["a"] * 12, []), 8: (["a"] * 11 + ["b"], []), 9: (["b"], []), 10: (["a"] * 6, ring(6)[::-1])}
    assert run(spark, graphs) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2, 5: 1, 6: 6, 7: 6, 8: 8, 9: 9, 10: 0}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, folder, seed):
    rng = random.Random(seed)
    graphs = {}
    for k in range(60):
        n = rng.randint(1, 5)
        es = [(x, y, rng.choice("pq")) for x in range(n) for y in range(n) if x != y and rng.random() < 0.35]
        if es and rng.random() < 0.2:
            es.append(es[0])
        types = [rng.choice("ab") for _ in range(n)]
        p = rng.sample(range(n), n)
        graphs[2 * k] = (types, es)
        graphs[2 * k + 1] = ([types[p.index(i)] for i in range(n)], [(p[x], p[y], c) for x, y, c in es])
    assert run(spark, graphs) == classes(graphs)
