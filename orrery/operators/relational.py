"""Relational building blocks: foreign keys, closures, statistics, ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` of which a non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def closure(start: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Sub-tables that a subset needs: each step (table, its key, key of the table before) is a left-semi join with the table before."""
    out = [start]
    for table, key, before in steps:
        out.append(table.join(out[-1].select(F.col(before).alias(key)), key, "left_semi"))
    return out


def category_stats(rows: DataFrame, by: str, *values: str) -> DataFrame:
    """Count, mean and population deviation of each value by category."""
    stats = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *stats)


def frequency(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def neighbours(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """prev_<value> and next_<value> along the chain of a key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({f"prev_{value}": F.lag(value).over(w), f"next_{value}": F.lead(value).over(w)})


def central_difference(rows: DataFrame, key: str, time_us: str, value: str, longest_s: float = 1.5) -> DataFrame:
    """rate: change between the neighbours over their time; at an end of the chain between the row and its neighbour, null alone or beyond ``longest_s`` (doubled with both neighbours)."""
    w = Window.partitionBy(key).orderBy(time_us)
    before, after = (lambda c: F.coalesce(F.lag(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lead(c).over(w), F.col(c)))
    seconds = (after(time_us) - before(time_us)) * 1e-6
    both = F.lag(time_us).over(w).isNotNull() & F.lead(time_us).over(w).isNotNull()
    limit = F.when(both, 2 * longest_s).otherwise(longest_s)
    return rows.withColumn("rate", F.when(seconds <= limit, F.try_divide(after(value) - before(value), seconds)))


def islands(rows: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """key, start, n: runs of consecutive rows with the flag."""
    all_rows = rows.withColumn("_f", flag).withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    on = all_rows.where("_f").withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return on.groupBy(key, "_g").agg(F.min("_i").alias("start"), F.count("*").alias("n")).drop("_g")


def sessions(rows: DataFrame, key: str, time_us: str, gap_s: float) -> DataFrame:
    """Rows with the number of their session (from 0): a longer gap begins a new one."""
    w = Window.partitionBy(key).orderBy(time_us)
    new = F.when(F.col(time_us) - F.lag(time_us).over(w) > gap_s * 1_000_000, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its time: one sort of the union, no range join."""
    one = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    two = right.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return one.unionByName(two).withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def bracketed(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``filled``: the value, or where it is null the linear interpolation between its neighbours in time."""
    before, after = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    out = rows.withColumns({"_a": F.last(known, ignorenulls=True).over(before), "_b": F.first(known, ignorenulls=True).over(after)})
    share = F.try_divide(F.col(time) - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    return out.withColumn("filled", F.coalesce(value, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share)).drop("_a", "_b")


def majority(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by, value, n: the most frequent value; of equally frequent ones that which comes first in ``order``."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = counted.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), "_first", value)).alias("best"))
    return best.select(by, F.col(f"best.{value}").alias(value), (-F.col("best.m")).alias("n"))


def ranked(rows: DataFrame, part: Column, *order: str) -> DataFrame:
    """``rows`` with ``rank``, from 1, over the whole table, without gathering it in one task.

    ``part`` must rise with ``order``, which must tell all rows apart: rows are numbered inside each part, after the rows of all parts before it.
    """
    placed = rows.withColumn("_part", part)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_place", inside).join(before, "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def tiles(rows: DataFrame, n: int, part: Column, *order: str) -> DataFrame:
    """``rows`` with ``part``, 1 to ``n``: as even parts as can be, larger ones first; see :func:`ranked`."""
    total = rows.agg(F.count("*").alias("_total"))
    k, size, more = F.col("rank") - 1, F.expr(f"_total div {n}"), F.col("_total") % n
    tile = F.when(k < more * (size + 1), F.floor(k / (size + 1))).otherwise(more + F.floor(F.try_divide(k - more * (size + 1), size)))
    return ranked(rows, part, *order).join(F.broadcast(total)).withColumn("part", (tile + 1).cast("int")).drop("rank", "_total")


def seeded_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle order."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def camera_usage(calibrations: DataFrame, samples: DataFrame, sensors: DataFrame) -> DataFrame:
    """channel, calibrations, keyframes: calibrated sensors and keyframes of each channel. calibrations: calibration, sensor; samples: calibration, is_key_frame; sensors: sensor, channel."""
    named = calibrations.join(sensors, "sensor").select("calibration", "channel")
    frames = samples.where("is_key_frame").groupBy("calibration").agg(F.count("*").alias("n"))
    both = named.join(frames, "calibration", "left")
    return both.groupBy("channel").agg(F.count("*").alias("calibrations"), F.coalesce(F.sum("n"), F.lit(0)).alias("keyframes"))
