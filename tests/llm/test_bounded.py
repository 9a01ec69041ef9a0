"""What tasks of operators 4 and 12 hold at a time does not grow with what they have to do."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from orrery.llm import substring_dedup, suffix_dedup
from orrery.llm.common import BATCH, durable, small_batches
from orrery.llm.suffix_dedup import chunked


def large(spark, n=48):
    """Rows of about 1 MB in one partition."""
    return spark.range(n, numPartitions=1).selectExpr("id", "encode(array_join(transform(sequence(1, 16000), i -> sha2(cast(id * 100000 + i as string), 256)), ''), 'utf-8') AS data")


def test_tables_of_large_rows_have_small_row_groups(spark):
    table = durable(large(spark), "large", large_rows=True)
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in table.inputFiles()]
    groups = [f.metadata.row_group(k).column(1).total_uncompressed_size for f in files for k in range(f.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 40 << 20, groups
    assert table.count() == 48


def test_chunks_are_written_so(spark):
    docs = large(spark).selectExpr("id AS doc_id", "decode(data, 'utf-8') AS text")
    for table in (chunked(docs, 1 << 20), substring_dedup._chunks(docs, "doc_id", "text", 20)):
        files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in table.inputFiles()]
        assert max(f.metadata.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)) < 40 << 20


def test_batches_of_large_rows_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = large(spark).select("data").mapInArrow(sizes, "n bigint")
    with small_batches(spark):
        most = max(r.n for r in rows.collect())
    assert most <= BATCH // 1_000_000 + 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_hashes_remembered():
    hashes = substring_dedup._Hashes()
    for k in range(400_000):
        hashes[b"w%d" % k]
    assert len(hashes) <= 200_000
    assert hashes[b"w5"] == substring_dedup.xxhash.xxh3_64_intdigest(b"w5")


def test_a_passage_in_many_surroundings_is_sorted_once(spark, monkeypatch, tmp_path):
    """A split bucket holds what its pieces have in common once, however many they are."""
    from .test_suffix import brute, key

    repeats, to = suffix_dedup.repeats, str(tmp_path)

    def counted(rows, depths):
        with open(f"{to}/{random.random()}", "w") as f:
            f.write(str(sum(len(r[-1]) for r in rows)))
        return repeats(rows, depths)

    monkeypatch.setattr(suffix_dedup, "repeats", counted)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 1)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(120)
    rows = [(k, text(50) + passage + text(50)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = suffix_dedup.remove_repeats(docs, 40, chunk=4000, hot=1).collect()
    assert sorted(map(key, got)) == brute([(i, t.encode()) for i, t in rows], 40)
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) < 600 * 40
