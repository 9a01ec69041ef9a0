"""Operator 4 against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from orrery.llm import suffix_dedup

from .test_native import key


def brute(rows, n):
    starts = Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if starts[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(key, out))


@pytest.mark.parametrize("length", [7, 1, 20, 40, 400])
def test_cover(length):
    v, cover = suffix_dedup.difference_cover(length)
    assert v <= max(1, 0.7 * length) and {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("length,chunk", [(40, 1 << 20), (40, 3000), (400, 20_000)])
def test_corpus(docs, corpus, length, chunk):
    got = suffix_dedup.remove_repeats(docs, length, chunk=chunk).collect()
    assert sorted(map(key, got)) == brute([(i, (t or "").encode()) for i, t in corpus], length)


def test_shared_passages_and_monotone_texts(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, edge = text(90), text(40)
    rows = [(0, text(30) + passage + text(50)), (1, passage[3:]), (2, text(20) + passage[:41] + text(20)), (3, "x" * 500), (4, "xy" * 120), (5, "x" * 39), (6, "x" * 40)]
    rows += [(7, edge), (8, text(60) + edge), (9, edge + edge), (10, ""), (11, text(39)), (12, "Ω" * 30)]
    rows += [(20 + i, text(10) + passage[i : i + 60] + text(10)) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = suffix_dedup.remove_repeats(docs, 40, with_text=True, chunk=700).collect()
    assert sorted(key(r[:5]) for r in got) == brute([(i, t.encode()) for i, t in rows], 40)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_no_documents(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [1, 3000])
def test_split_buckets(spark, docs, corpus, hot):
    """A passage with ever different surroundings, and copies, in buckets that are split."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(35)
    rows = [(1000 + k, text(60) + passage + text(60)) for k in range(80)]
    rows += [(2000 + k, rows[k % 5][1][20:130] + text(k)) for k in range(40)]
    full = [*corpus, *rows]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(6)
    got = suffix_dedup.remove_repeats(table, 40, chunk=4000, hot=hot).collect()
    assert sorted(map(key, got)) == brute([(i, (t or "").encode()) for i, t in full], 40)


def test_equal_suffixes():
    """Ranks tell ties of any two remainders and of every depth from differences in the last byte, the first and between."""
    import numpy as np

    rng = random.Random(2)
    for depth in (1, 13, 25, 61, 240):
        base = [bytes(rng.choice(b"ab") for _ in range(depth)) for _ in range(3)]
        parts = []
        for _ in range(200):
            x = bytearray(rng.choice(base))
            if rng.random() < 0.6:
                x[rng.choice([0, depth // 2, depth - 1, rng.randrange(depth)])] ^= 3
            parts.append(bytes(x) + b"zz"[: rng.randrange(3)])
        text = np.frombuffer(b"".join(parts), np.uint8)
        start = np.arange(len(text) - depth + 1)
        got = suffix_dedup.Blocks(text, depth).equal(start, depth)
        raw = text.tobytes()
        want = {}
        for s, g in zip(start.tolist(), got.tolist(), strict=True):
            want.setdefault(raw[s : s + depth], set()).add(g)
        assert all(len(x) == 1 for x in want.values()) and len(want) == len(set(got.tolist()))


def test_passages(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))
    long, short = words(60), words(44)
    rows = [(k, f"{words(30)} {long} {words(30)}") for k in range(3)] + [(10 + k, f"{words(5)} {short} {words(9)}") for k in range(2)] + [(20, words(300)), (21, ""), (22, None), (23, f"{long} {words(3)} {long}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, 400, passage=(200, 50)).collect()}
    assert {i: r.n_passages for i, r in got.items()} == {0: 1, 1: 1, 2: 1, 10: 0, 11: 0, 20: 0, 21: 0, 22: 0, 23: 2}
    assert sorted(key(r[:5]) for r in got.values()) == brute([(i, (t or "").encode()) for i, t in rows], 400)
