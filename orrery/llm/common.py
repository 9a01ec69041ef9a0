"""What the operators of this subpackage share: durable intermediate tables and exact text rules."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import durable, shared_dir

__all__ = ["durable", "shared_dir"]

#: Bytes of an Arrow batch of rows of megabytes; Spark's own limit of 64 MB is held several times over by each task.
BATCH = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile sends Arrow batches of BATCH bytes, or of one row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)

#: The letters that the contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def plain_text(text: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until it clashes with no column of ``df`` (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of one block of a filter: what bitmap_construct_agg keeps in one value of 4096 bytes. Smallest and largest filter, in bits: 128 KB and 32 MB.
BLOCK, LEAST_BITS, MOST_BITS = 32768, 1 << 20, 1 << 28


def filter_bits(rows: int) -> int:
    """Sixteen bits a row, a power of two between LEAST_BITS and MOST_BITS."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))


def bit_at(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1


def perhaps_in(rows: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``: false only if ``key`` (a 64-bit hash) is not in the only column of the durable table ``keys``.

    A filter of bounded size is broadcast, so that rows which are certainly not concerned need not shuffle.
    """
    blocks = filter_bits(keys.count()) // BLOCK
    place = lambda k: (F.pmod(F.shiftright(k, 15), F.lit(blocks)).cast("int"), F.pmod(k, F.lit(BLOCK)).cast("int"))
    names = fresh(rows, "filter_block"), fresh(rows, "filter_bitmap")
    block, bit = place(F.col(keys.columns[0]))
    small = keys.select(block.alias(names[0]), bit.alias("bit")).groupBy(names[0]).agg(F.expr("bitmap_construct_agg(bit)").alias(names[1]))
    block, bit = place(key)
    tested = rows.join(F.broadcast(small), block == F.col(names[0]), "left")
    return tested.withColumn(flag, F.coalesce(bit_at(F.col(names[1]), bit), F.lit(False))).drop(*names)
