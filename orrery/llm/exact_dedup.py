"""Exact deduplication by two-pass Bloom filtering (operator 2).

Pass one hashes every row to two cells of a blocked Bloom filter and counts the rows of each cell; the cells
that two or more rows hit form the filter. Its size depends on ``bits`` alone (4 KB a block, 32 MB at most), so it may
be broadcast whatever the input. Pass two tests each row where it stands: rows of which a cell was hit once
are certainly unique and pass straight through; only the others shuffle, to be compared by SHA-256. A
filter that is too small lets more rows into that comparison and changes no result. Each step uses built-in functions only.

Defined cases: null text equals the empty text; a null ``doc_id`` is smaller than any other, and its row stays only if
all rows of its group have none; of repeated rows with one ``doc_id`` and text one stays; an empty table gives an empty result; other columns,
whatever their names, are kept by :func:`exact_dedup` and ignored by :func:`duplicate_groups`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, bit_at, durable, filter_bits, fresh, plain_text, sha256_hex

def _cells(sha: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a digest, and its two bits there."""
    at = lambda a, n: F.conv(F.substring(sha, a, n), 16, 10).cast("long")
    return (at(1, 8) % blocks).cast("int"), (at(9, 4) % BLOCK).cast("int"), (at(13, 4) % BLOCK).cast("int")


def repeated_cells(digests: DataFrame, sha: str, bits: int) -> DataFrame:
    """The filter: for each block with such cells, the bitmap of those that two or more rows hit."""
    block, a, b = _cells(F.col(sha), bits // BLOCK)
    cells = digests.select(block.alias("block"), F.explode(F.array_distinct(F.array(a, b))).alias("bit"))
    twice = cells.groupBy("block", "bit").count().where("count > 1")
    return twice.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def flag_repeats(rows: DataFrame, sha: str, cells: DataFrame, bits: int, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``: false only if no other row has this digest."""
    block, a, b = _cells(F.col(sha), bits // BLOCK)
    names = fresh(rows, "bloom_block"), fresh(rows, "bloom_bitmap")
    small = cells.select(F.col("block").alias(names[0]), F.col("bitmap").alias(names[1]))
    tested = rows.join(F.broadcast(small), block == F.col(names[0]), "left")
    hit = F.coalesce(bit_at(F.col(names[1]), a) & bit_at(F.col(names[1]), b), F.lit(False))
    return tested.withColumn(flag, hit).drop(*names)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = durable(docs.select(F.col(id_col).alias("doc_id"), sha256_hex(plain_text(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    bits = filter_bits(digests.count())
    flagged = flag_repeats(digests, "text_sha256", repeated_cells(digests, "text_sha256", bits), bits, "again")
    alone = flagged.where(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = flagged.where("again").drop("again")
    # a table of its own, so that the join has an exchange on both sides and adaptive execution can split hot groups
    groups = durable(again.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size")), "groups")
    met = again.join(groups, "text_sha256").select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the row with the largest id."""
    sha, flag = fresh(docs, "text_sha"), fresh(docs, "maybe_again")
    hashed = docs.withColumn(sha, sha256_hex(plain_text(text_col)))
    digests = durable(hashed.select(F.col(id_col).alias("doc_id"), F.col(sha).alias("sha")), "digests")
    bits = filter_bits(digests.count())
    cells = durable(repeated_cells(digests, "sha", bits), "bloom")
    flagged = flag_repeats(hashed, sha, cells, bits, flag)
    last = durable(flag_repeats(digests, "sha", cells, bits, "again").where("again").groupBy("sha").agg(F.max("doc_id").alias("last")), "last")
    last = last.select(F.col("sha").alias(fresh(hashed, "last_sha")), F.col("last").alias(fresh(hashed, "last_id")))
    same = (F.col(sha) == last[last.columns[0]]) & F.col(id_col).eqNullSafe(last[last.columns[1]])
    stay = flagged.where(flag).join(last, same, "left_semi").dropDuplicates([sha, id_col])
    return flagged.where(~F.col(flag)).unionByName(stay).select(*[F.col(f"`{c}`") for c in docs.columns])
