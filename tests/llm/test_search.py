"""Operator 13 against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from orrery.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return TERM.findall((t or "").translate(LOW))


def plain(docs, items, k=20):
    texts = [Counter(words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in texts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, size in zip(docs, texts, sizes, strict=True):
            m = 75 + (25 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(words(text)).items() if c[t])
            if s > 0:
                scores.append((-s, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(60)] + ["Ärger", "the", "The2"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "-- ?"), (2003, text(4000)), (-3, docs[5][1])]
    items = [(i, text(rng.randint(1, 15))) for i in range(25)] + [(90, None), (91, "nowhere"), (92, docs[5][1]), (93, "THE the, ärger Ärger"), (94, "t1")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, row int, term string").repartition(5)
    return d, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, item int").repartition(2)


@pytest.mark.parametrize(("k", "block", "held"), [(20, 200_000, 500_000), (1, 200_000, 500_000), (7, 20, 5), (500, 200_000, 100)])
def test_best_documents(spark, tables, monkeypatch, k, block, held):
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "HELD", held)
    got = ls.search(*frames(spark, *tables), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(*tables, k)


def test_odd_tables(spark):
    docs, items = [(1, "a b"), (1, "a b"), (None, "a c"), (2, "d")], [(1, "a"), (1, "a"), (None, "b d")]
    got = ls.search(*frames(spark, docs, items)).collect()
    by = Counter((r.item_id, r.rank, r.doc_id) for r in got)
    assert by == Counter({(1, 1, None): 2, (1, 2, 1): 2, (1, 3, 1): 2, (None, 1, 2): 1, (None, 2, 1): 1, (None, 3, 1): 1})
    for d, i in (([], items), (docs, []), ([(1, None)], items), ([], [])):
        got = ls.search(*frames(spark, d, i))
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_candidates_do_not_grow_with_tasks(spark, tables, monkeypatch):
    counts = []

    def counted(df, name, plain=ls.durable):
        out = plain(df, name)
        if name in ("met", "candidates"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(ls, "durable", counted)
    shuffled, most = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            counts.clear()
            got = ls.search(*frames(spark, *tables), k=3)
            assert sorted(map(tuple, got.collect())) == plain(*tables, 3)
            most.append(max(counts))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most[0] == most[1]
