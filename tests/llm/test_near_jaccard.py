"""The pipeline's near stage against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from orrery.llm import near_jaccard

from .test_free import roots


def brute(rows):
    """Ids that stay: the smallest of each group of texts with similarity 0.8 or more on 5-word shingles."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = roots(set(sets), [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    least = {}
    for i in sets:
        least[root[i]] = min(i, least.get(root[i], i))
    return set(least.values())


def edited(rng, words, share):
    return " ".join(f"edit{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize(("small", "part"), [(64, 4096), (3, 4096), (3, 5)])
def test_similarity(spark, monkeypatch, small, part):
    monkeypatch.setattr(near_jaccard, "SMALL", small)
    monkeypatch.setattr(near_jaccard, "PART_ROWS", part)
    monkeypatch.setattr(near_jaccard, "SAMPLE", 2)
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    base = [fresh(rng.randint(30, 300)) for _ in range(25)]
    line = fresh(40)
    texts = [" ".join(b) for b in base] + [edited(rng, b, rng.choice([0.01, 0.02, 0.04])) for b in base for _ in range(4)]
    texts += [" ".join(line + fresh(rng.randint(4, 60))) for _ in range(30)] + [edited(rng, base[0], 0.015) for _ in range(30)]
    texts += ["", None, " \n", "one two", "ONE two", "three", "a b c d e f g h i", "a b c d e f g h"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) < len(rows) - 60


def test_empty(spark):
    assert corpus_pipeline.near(spark, spark.createDataFrame([], "doc_id bigint, text string"), "").collect() == []


def test_sketches():
    rng = random.Random(6)
    for n in (3, 60, 900):
        for share in (0, 0.05, 0.1, 0.5):
            a = {f"s{k}".encode() for k in range(n)}
            b = {x if rng.random() >= share else x + b"!" for x in a} | {b"t%d" % k for k in range(rng.randint(0, n // 8))}
            x, y = (near_jaccard.np.array([near_jaccard.xxhash.xxh64_intdigest(s) for s in c], near_jaccard.np.uint64).view(near_jaccard.np.int64) for c in (a, b))
            near = near_jaccard.near_sketches(len(x), near_jaccard.sketch(x), len(y), near_jaccard.sketch(y))
            assert near or not near_jaccard.similar(a, b)
            assert not (near and share == 0.5 and n == 900)
            low = [near_jaccard.np.frombuffer(near_jaccard.fold(h), near_jaccard.np.uint64) for h in (x, y)]
            assert near_jaccard.near_folds(near_jaccard.np.array(len(x)), low[0], near_jaccard.np.array(len(y)), low[1]) or not near_jaccard.similar(a, b)


def test_near_copies_of_near_copies(spark, monkeypatch):
    """Of copies edited so much that few are near any one of them, most are joined before all pairs are compared."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**5)}" for _ in range(200)]
    rows = list(enumerate(edited(rng, base, rng.uniform(0.005, 0.03)) for _ in range(400)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    counts, verified = [], near_jaccard.verified

    def counted(pairs, *more):
        pairs = near_jaccard.durable(pairs, "counted")
        counts.append(pairs.distinct().count())
        return verified(pairs, *more)

    monkeypatch.setattr(near_jaccard, "verified", counted)
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == brute(rows)
    assert max(counts) < 10 * len(rows), counts
