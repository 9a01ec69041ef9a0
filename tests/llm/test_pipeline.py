"""The pipeline against a plain version of each stage on a small table."""

import random
import re

import pytest

import corpus_pipeline

from .test_near_jaccard import brute as near_copies_gone


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eta", "of", "the"]) + rng.choice(["", "s", "ly", "tion"])
    good = [" ".join(word() for _ in range(rng.randint(40, 150))) + "." for _ in range(90)]
    bad = [" ".join(w.upper() + "!!" for w in g.split()) for g in good[:30]]
    items = [(1, " ".join(f"item{k}" for k in range(14)))]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(200 + i, good[i]) for i in range(10)] + [(300 + i, good[20 + i] + " end") for i in range(8)]
    rows += [(400, good[50] + " " + items[0][1]), (401, "item1 item2 item3 " + good[51])]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 90), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages(spark, sf_dir):
    path, rows, items = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{path}/out{k}")
            docs = spark.read.parquet(f"{path}/out{k}")
            ids.append({r.doc_id for r in docs.collect()})
    texts = dict(rows)
    assert ids[0] == {i for i in texts if not 90 <= i < 120}
    last = {}
    for i in sorted(ids[0]):
        last[texts[i]] = i
    assert ids[1] == set(last.values())
    assert ids[2] == near_copies_gone([(i, texts[i]) for i in ids[1]]) and ids[1] - ids[2]
    windows = {tuple(items[0][1].split()[s : s + 10]) for s in range(5)}
    dirty = {i for i in ids[2] if any(tuple(w[s : s + 10]) in windows for w in [re.findall(r"\w+", texts[i].lower())] for s in range(len(w)))}
    assert ids[3] == ids[2] - dirty and dirty <= {400}
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == ids[3]


def test_odd_rows(spark, sf_dir, tmp_path):
    """Null and empty texts, null ids, repeated rows, columns of any name; every stage keeps the columns and loses no other text."""
    path, _, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 20")
    odd = [(500, None), (501, ""), (502, " "), (None, "one text without an id, of ten words or so, indeed"), (503, "short"), (503, "short")]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    names = ("text_key", "row_id", "key", "sha", "row", "w", "odds_of", "text_sha", "bit", "root", "word")
    table = docs.unionByName(odd).selectExpr("*", *[f"doc_id AS `{n}`" for n in names])
    columns = table.columns
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, path)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/odd{k}")
            table = spark.read.parquet(f"{tmp_path}/odd{k}")
            ids.append(sorted((r.doc_id for r in table.collect()), key=str))
            assert set(range(20)) <= set(ids[-1])
    kept = set(ids[0])
    assert {500, 501} & set(ids[1]) == ({501} if {500, 501} <= kept else {500, 501} & kept)
    assert ids[1].count(503) == (503 in kept) and len({500, 501, 502} & set(ids[2])) <= 1
    assert sorted((r.doc_id for r in out.collect()), key=str) == ids[3]


def test_empty_tables(spark, sf_dir, tmp_path):
    path, rows, _ = sf_dir
    for name in ("labels", "benchmark", "documents"):
        target = str(tmp_path / name)
        for other in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{path}/{other}.parquet")
            (df.limit(0) if other == name else df).write.parquet(f"{target}/{other}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "documents")).count() == 0
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path / "benchmark")).count() == len(rows)
    assert corpus_pipeline.quality(spark, docs, str(tmp_path / "labels")).count() == len(rows)
