"""Operators 2, 3, 5 and 6 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from orrery.llm import common, decontaminate, exact_dedup, secret_ledger, shuffle_shards

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(x):
    return tuple((v is not None, v) for v in x)


def test_duplicate_groups(docs, corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    got = exact_dedup.duplicate_groups(docs).collect()
    assert sorted((key((r.doc_id, r.text_sha256)) for r in got)) == sorted(key((i, hashlib.sha256((t or "").encode()).hexdigest())) for i, t in corpus)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_sha.keys())


def test_exact_dedup_keeps_whole_rows(docs, corpus):
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    assert Counter(r.text or "" for r in got.collect()) == Counter({t or "" for _, t in corpus})


def test_small_filter_changes_nothing(docs, monkeypatch):
    want = sorted(map(key, exact_dedup.duplicate_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: common.BLOCK)
    assert sorted(map(key, exact_dedup.duplicate_groups(docs).collect())) == want


def test_filter_size_is_bounded():
    assert common.filter_bits(0) == common.LEAST_BITS and common.filter_bits(10**12) == common.MOST_BITS


def spans(x):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(found))


def test_secrets(docs, corpus):
    got = secret_ledger.secret_report(docs).collect()
    assert sorted(key((r.doc_id, r.spans)) for r in got) == sorted(key((i, spans(t or ""))) for i, t in corpus)
    assert any(r.n_assign and r.n_access and r.n_hex for r in got)
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)


def test_ledger_scans_only_what_is_new(docs, spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = secret_ledger.scan_versions(docs.where("doc_id < 50"), path).count()
    assert first == 3 * docs.where("doc_id < 50").select("text").distinct().count()
    assert secret_ledger.scan_versions(docs.where("doc_id < 50"), path).count() == 0
    secret_ledger.scan_versions(docs, path)
    changed = (*secret_ledger.RULES[:2], secret_ledger.Rule("hex", r"[0-9a-f]{40,}+", 0, 40, version=2))
    again = secret_ledger.scan_versions(docs, path, changed)
    assert {r.rule for r in again.select("rule").distinct().collect()} == {"hex"}
    assert secret_ledger.secret_report(docs, path).count() == docs.count()


def test_decontamination(docs, corpus, spark):
    texts = dict((i, t) for i, t in corpus if i is not None)
    items = [(1, texts[40]), (2, "PRE " + texts[40]), (3, " ".join(texts[10].split()[:4])), (4, None), (5, "..."), (None, texts[203][500:900]), (12, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].update(() if i is None else (str(i),))
    want = []
    for i, t in corpus:
        w = word.findall((t or "").translate(LOW))
        hit, met = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    met |= windows[tuple(w[s : s + n])]
        want.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination_report(docs, bench).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want) > 0


def test_shards(docs, corpus):
    got = shuffle_shards.shard_documents(docs, shards=7).collect()
    assert sorted(key((r.doc_id, r["size"], r.text_crc32)) for r in got) == sorted(key((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in corpus)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and sorted(by) == list(range(7))


def test_sub_buckets_leave_no_gap(docs):
    got = shuffle_shards.shuffle_shards(docs.select("doc_id"), 3, bucket_rows=4).collect()
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_matrix_has_exact_margins_and_the_right_mean():
    counts = [0, 1, 50, 7, 1000]
    total = Counter()
    for seed in range(200):
        m = shuffle_shards.communication_matrix(counts, 4, seed)
        assert [sum(r) for r in m] == counts
        columns = [sum(r[s] for r in m) for s in range(4)]
        assert max(columns) - min(columns) <= 1
        total.update({s: m[2][s] for s in range(4)})
    assert all(abs(total[s] / 200 - 12.5) < 1 for s in range(4))


def test_draws_follow_the_law():
    """Frequencies of 20,000 draws against the exact probabilities, and draws at 10**10 rows against mean and deviation."""
    rng = random.Random(3)
    for good, bad, draws in ((5, 7, 6), (1, 30, 10), (40, 40, 40), (3, 0, 2)):
        seen = Counter(shuffle_shards._hypergeometric(rng, good, bad, draws) for _ in range(20_000))
        law = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
        assert set(seen) <= set(law) and all(abs(seen[k] / 20_000 - p) < 0.015 for k, p in law.items())
    n, good, draws = 10**10, 10**10 // 24, 4_000_000
    got = [shuffle_shards._hypergeometric(rng, good, n - good, draws) for _ in range(300)]
    mean, dev = draws / 24, math.sqrt(draws / 24 * 23 / 24)
    assert abs(sum(got) / 300 - mean) < 5 * dev / math.sqrt(300) and 0.8 < math.sqrt(sum((x - mean) ** 2 for x in got) / 300) / dev < 1.2


def test_places_are_uniform(spark):
    """Over many rows, shard and slot have no relation to the place in the input: each tenth of the input fills each shard and each half of it alike."""
    got = shuffle_shards.shuffle_shards(spark.range(0, 40_000, 1, 8), 4).collect()
    seen = Counter((r.id // 4000, r.shard, r.slot // 5000) for r in got)
    assert len(seen) == 80 and sum((n - 500) ** 2 / 500 for n in seen.values()) < 140  # chi-square, 79 degrees: 1 in 30,000


def test_empty_tables(nothing, docs, spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for out in (exact_dedup.duplicate_groups(nothing), exact_dedup.exact_dedup(nothing), secret_ledger.secret_report(nothing), shuffle_shards.shard_documents(nothing), decontaminate.contamination_report(nothing, bench)):
        assert out.count() == 0
    assert decontaminate.contamination_report(docs, bench).where("contaminated").count() == 0
