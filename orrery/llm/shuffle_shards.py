"""Uniform sharding by a hypergeometric communication matrix (operator 6).

The rows of each partition are counted, and for every partition the number of its rows that go to
each shard is drawn from the exact (multivariate hypergeometric) law, so that the shard sizes come out as fixed in
advance, at most one apart. Each partition is permuted locally, by a sort in place, and cut by its row of that matrix; one exchange moves
the rows, and a second permutation orders each shard. The result has the law of a uniform shuffle of all
rows. Rows are permuted by sorting on a hash of seed and row number, which a
repeated task computes again alike; another run with the same seed may pack the table's files otherwise, and then is another shuffle. Long shards are permuted in random sub-buckets of about ``bucket_rows`` rows, whose sizes give
the first slot of each, so no task sorts a whole shard. Built-in functions only.

The partitions are those of the table of rows as first written, without the scanned texts: one for some millions of rows. What reaches the driver is a count for each of
them, and what goes back is a row of the matrix. Draws are by inversion with probabilities relative to the mode, so their error is that of a few thousand
roundings, whatever the number of rows.

The method has no use for groups of equal texts: each row is dealt on its own, as the ``rows`` law asks.
Defined cases: null text has no bytes (size 8) and checksum 0; a null or repeated ``doc_id`` is dealt like any other row; with fewer
rows than shards the last shards are empty; an empty table gives an empty result; other columns of any name pass through.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, fresh, plain_text


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken from good + bad are good: inversion of the law, of which each weight follows from its neighbour's, outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    top = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    weights = {top: 1.0}
    for step in (1, -1):
        k, w = top, 1.0
        while low <= k + step <= high and w > 1e-22:
            if step > 0:
                w *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
            else:
                w *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
            k += step
            weights[k] = w
    u = rng.random() * math.fsum(weights.values())
    for k, w in weights.items():
        u -= w
        if u <= 0:
            return k
    return top


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each partition to each shard: row sums are ``counts``, column sums at most one apart."""
    rng, total = random.Random(seed), sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        row, rest, draws = [], sum(left), n
        for s in range(shards):
            rest -= left[s]
            row.append(_hypergeometric(rng, left[s], rest, draws))
            draws -= row[-1]
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_shards(rows: DataFrame, shards: int, seed: int = 42, bucket_rows: int = 200_000) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard); a uniform shuffle.

    Columns of ``rows`` named shard or slot are replaced.
    """
    spark: SparkSession = rows.sparkSession
    part, row, rank, bounds, bucket, key, first = (fresh(rows, f"sh_{x}") for x in ("part", "row", "rank", "bounds", "bucket", "key", "first"))
    base = durable(rows.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()), "dealt")
    hashed = lambda n: F.xxhash64(F.lit(seed), F.lit(n), F.col(row))
    # the low bits of the running number are the place in the sorted partition
    local = base.sortWithinPartitions(hashed(1), row).withColumn(part, F.spark_partition_id()).withColumn(rank, F.expr(f"monotonically_increasing_id() & {(1 << 33) - 1}"))
    local = durable(local, "permuted")
    sizes = sorted((r[0], r[1]) for r in local.groupBy(part).count().collect())  # one for each partition
    total = sum(n for _, n in sizes)
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    cut = [(p, [sum(m[: s + 1]) for s in range(shards)]) for (p, _), m in zip(sizes, matrix, strict=True)]
    cuts = spark.createDataFrame(cut, f"`{part}` int, `{bounds}` array<bigint>")
    sent = local.join(cuts, part).withColumn("shard", F.expr(f"size(filter(`{bounds}`, b -> b <= `{rank}`))"))
    pieces = max(1, math.ceil(total / shards / bucket_rows))
    sent = sent.withColumn(key, hashed(2)).withColumn(bucket, F.pmod(F.shiftrightunsigned(key, 20), F.lit(pieces)).cast("int"))
    sent = durable(sent.drop(rank, bounds, part), "sent")
    starts = sent.groupBy("shard", bucket).agg(F.count("*").alias("n"))
    starts = starts.withColumn(first, F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    slot = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(key, row)) - 1
    done = sent.withColumn("slot", slot.cast("long")).join(starts, ["shard", bucket]).withColumn("slot", F.col("slot") + F.col(first))
    return done.select(*[f"`{c}`" for c in rows.columns if c.lower() not in ("shard", "slot")], "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) of every document."""
    size = (F.octet_length(plain_text()) + 8).cast("long")
    light = docs.select("doc_id", size.alias("size"), F.crc32(plain_text().cast("binary")).alias("text_crc32"))
    dealt = shuffle_shards(light, shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
