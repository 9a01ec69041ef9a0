"""Operator 12 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from orrery.llm import substring_dedup as sd


def plain(rows, words=20):
    """What each row, in table order, loses: (id, words, lost places)."""
    texts = [(t or "").encode().split() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, lost = set(), [set() for _ in rows]
    for k in order:
        for s in range(len(texts[k]) - words + 1):
            window = tuple(texts[k][s : s + words])
            if window in seen:
                lost[k].update(range(s, s + words))
            seen.add(window)
    return [(i, w, x) for (i, _), w, x in zip(rows, texts, lost, strict=True)]


def report(rows, words=20):
    out = []
    for i, w, lost in plain(rows, words):
        kept = b" ".join(x for k, x in enumerate(w) if k not in lost)
        out.append((i, len(w), len(lost), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "x", "é", "yz"]) + str(rng.randint(0, 40))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(n) for n in (12, 19, 20, 21, 24, 30, 45, 60, 120)]
    phrase = prose(7)
    out = []
    for k in range(220):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += prose(rng.randint(0, 40))
            p = rng.choice(passages)
            if rng.random() < 0.3:
                lo = rng.randint(0, len(p) // 2)
                p = p[lo:]
            if rng.random() < 0.2:
                p = [*p[: len(p) // 2], "changed", *p[len(p) // 2 + 1 :]]
            parts += p + (phrase if k % 3 else [])
        out.append((rng.randint(-5, 10**6), rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    copy = " ".join(prose(300))
    out += [(1000 + i, copy) for i in range(30)] + [(2000 + i, copy + " " + " ".join(prose(3))) for i in range(10)]
    out += [(3000, " ".join(["same"] * 100)), (3001, " ".join(["a", "b", "c"] * 40)), (3002, None), (3003, ""), (3004, " \n\t ")]
    out += [(None, out[0][1]), (None, None), (4000, " ".join(prose(5000) + copy.split()[3:290]))]
    return out


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, data string, chunk int").repartition(parts)


@pytest.mark.parametrize(("chunk", "bucket", "many"), [(1 << 22, 1 << 22, 32), (4000, 3000, 32), (3000, 2000, 0), (1, 500, 2)])
def test_windows_that_start_earlier_go(spark, rows, monkeypatch, chunk, bucket, many):
    for k, v in (("CHUNK", chunk), ("BUCKET", bucket), ("MANY", many)):
        monkeypatch.setattr(sd, k, v)
    # ids may be equal by chance in the random rows; the order of such rows is the table's, which repartition changes
    unique = list({i: (i, t) for i, t in rows if i is not None}.values()) + [(None, rows[0][1])]
    got = sd.substring_report(frame(spark, unique))
    assert Counter(map(tuple, got.collect())) == report(unique)
    assert got.where("n_removed > 0").count() > 100


def test_short_windows(spark, rows):
    unique = list({i: (i, t) for i, t in rows if i is not None}.values())
    assert Counter(map(tuple, sd.substring_report(frame(spark, unique, 3), words=6).collect())) == report(unique, 6)


def test_spans_are_the_maximal_runs(spark, rows):
    unique = list({i: (i, t) for i, t in rows if i is not None}.values())
    want = Counter()
    for i, _, lost in plain(unique):
        for s in sorted(lost):
            if s - 1 not in lost:
                stop = s
                while stop in lost:
                    stop += 1
                want[i, s, stop] += 1
    assert Counter(map(tuple, sd.substring_spans(frame(spark, unique)).collect())) == want


def test_repeated_rows_and_dropped_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (7, "pre " + text + " post"), (8, "alone"), (9, None), (3, text[:60])]
    df = frame(spark, rows, 1)
    got = sorted((r.doc_id, r.n_removed) for r in sd.substring_report(df).collect())
    assert got == [(3, 0), (5, 0), (5, 40), (7, 40), (8, 0), (9, 0)]
    cut = sd.drop_substrings(df)
    assert cut.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == Counter({(5, text): 2, (7, "pre post"): 1, (8, "alone"): 1, (9, None): 1, (3, text[:60]): 1})


def test_empty_table(spark):
    got = sd.substring_report(frame(spark, [], 2))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.collect() == []


def test_equal_windows_have_equal_anchors():
    """Of two texts that share 20 words, the anchors of the shared windows are at the same words."""
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**63, 200).astype(np.uint64)
    powers = sd._Powers()
    place = []
    for pad in (0, 13, 50):
        h = np.r_[rng.integers(0, 2**63, pad).astype(np.uint64), shared]
        a = sd.Anchors(h, np.array([len(h)]), np.array([1]), 20, powers)
        place.append({(int(x), int(s) - pad) for x, f, z in zip(a.anchor, a.first, a.last, strict=True) for s in range(f, z + 1) if s >= pad})
    assert place[0] == place[1] == place[2]
