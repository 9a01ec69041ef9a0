"""Evaluation metrics as aggregates and windows; only matching that is sequential by nature runs in grouped functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, guess: str, ignore: Column | None = None) -> DataFrame:
    """truth, guess, n of the rows that are not ignored."""
    kept = rows if ignore is None else rows.where(~ignore)
    return kept.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_iou(matrix: DataFrame) -> DataFrame:
    """class, tp, fp, fn, iou (null where nothing is)."""
    rows = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("guess").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("h")))).alias("r")).select("r.*")
    by = rows.groupBy("class").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("h").alias("tp"))
    fp, fn = F.col("g") - F.col("tp"), F.col("t") - F.col("tp")
    return by.select("class", "tp", fp.alias("fp"), fn.alias("fn"), F.round(F.try_divide(F.col("tp"), F.col("tp") + fp + fn), 6).alias("iou"))


def mean_iou(by_class: DataFrame) -> DataFrame:
    """miou and frequency-weighted iou."""
    weight = F.col("tp") + F.col("fn")
    return by_class.agg(F.round(F.avg("iou"), 6).alias("miou"), F.round(F.sum(F.col("iou") * weight) / F.sum(weight), 6).alias("fwiou"))


def _keys(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def running_sums(rows: DataFrame, by: str | list[str], score: str, ties: list[Column], sums: dict[str, Column], peers: bool | Column = False) -> DataFrame:
    """``rows`` with the running sums ``sums`` of each group by falling score, then by ``ties``, and ``all_<name>``, the sum over the group; with ``peers`` also ``first_<name>``: the running sum at the first row of equal score (that meets the condition ``peers``).

    Scores fall into ranges first: sums over whole ranges and a running sum inside one give the running sums, so a large group is spread over many tasks.
    Groups are few (classes, thresholds): what is known of them and their ranges is broadcast, never the rows, which may be small on disk.
    """
    keys = _keys(by)
    placed = ranges(rows, by, score)
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(score), *ties).rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_whole_{n}") for n, c in sums.items()])
    above, group = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    before = whole.select(*keys, "_range", *[F.coalesce(F.sum(f"_whole_{n}").over(above), F.lit(0)).alias(f"_above_{n}") for n in sums], *[F.sum(f"_whole_{n}").over(group).alias(f"all_{n}") for n in sums])
    # dealt before the windows, else what is summed travels beside the columns that it is made of
    out = placed.repartition(*keys, "_range").withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(before), [*keys, "_range"])
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) + F.col(f"_above_{n}") for n in sums})
    if peers is not False:
        one = lambda n: F.first(n) if peers is True else F.first(F.when(peers, F.col(n)), ignorenulls=True)
        out = out.withColumns({f"first_{n}": one(n).over(Window.partitionBy(*keys, "_range", score).orderBy(*ties)) for n in sums})
    return out.drop("_range", *[f"_above_{n}" for n in sums])


def precision_recall(scored: DataFrame, by: str | list[str], score: str, order: str, hit: str, positives: DataFrame | None = None) -> DataFrame:
    """Running precision and recall by falling score, ties by falling ``order``; recall is of all hits of the group, or of ``positives`` (by, n). See :func:`running_sums`."""
    one = F.when(F.col(hit), 1).otherwise(0)
    out = running_sums(scored, by, score, [F.desc(order)], {"tp": one, "k": F.lit(1)}).withColumnRenamed("all_tp", "positives").drop("all_k")
    if positives is not None:
        out = out.drop("positives").join(positives.select(*_keys(by), F.col("n").alias("positives")), _keys(by))
    return out.withColumns({"precision": F.col("tp") / F.col("k"), "recall": F.try_divide(F.col("tp"), F.col("positives"))})


def ranges(rows: DataFrame, by: str | list[str], value: str, parts: int = 256) -> DataFrame:
    """``rows`` with ``_range``: the part, of equal width between the group's least and largest ``value``, in which a row lies."""
    ends = rows.groupBy(*_keys(by)).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    place = F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * parts)
    return rows.join(F.broadcast(ends), _keys(by)).withColumn("_range", F.least(place, F.lit(parts - 1))).drop("_low", "_high")


def _asked(wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp: the numbers of hits m and m + 1 of each row of ``wanted``, which are a few for each group."""
    return wanted.select(*keys, F.explode(F.array("m", F.col("m") + 1)).alias("tp")).distinct()


def wanted_recalls(groups: DataFrame, keys: list[str], bins: int = 101) -> DataFrame:
    """keys, _hits, _n, bin, m: the evenly many recalls of each row of ``groups`` (keys, _hits, _n), and the number of hits below each."""
    steps = bins - 1
    return groups.select(*keys, "_hits", "_n", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("bin")).withColumn("m", F.expr(f"(bin * _n) div {steps}"))


def recall_points(curve: DataFrame, wanted: DataFrame, keys: list[str], values: list[str | Column]) -> DataFrame:
    """keys, tp, _first, _last: the values at the first and last of the points that share a number of hits which ``wanted`` asks for."""
    # a few points of the curve are asked for: only they are gathered by their number of hits
    return curve.join(F.broadcast(_asked(wanted, keys)), [*keys, "tp"], "left_semi").groupBy(*keys, "tp").agg(F.min_by(F.struct(*values), "k").alias("_first"), F.max_by(F.struct(*values), "k").alias("_last"))


def between_points(points: DataFrame, wanted: DataFrame, keys: list[str], values: list[str], bins: int = 101) -> DataFrame:
    """:func:`at_recalls` from :func:`recall_points` and :func:`wanted_recalls`."""
    steps = bins - 1
    here = points.select(*keys, F.col("tp").alias("m"), "_last")
    after = points.select(*keys, (F.col("tp") - 1).alias("m"), "_first")
    met = wanted.join(here, [*keys, "m"], "left").join(after, [*keys, "m"], "left")
    share = F.col("bin") * F.col("_n") / F.lit(float(steps)) - F.col("m")
    at_end = (F.col("_hits") > 0) & (F.col("_hits") * steps == F.col("bin") * F.col("_n"))

    def between(v: str) -> Column:
        low, high = F.col(f"_last.{v}"), F.col(f"_first.{v}")
        return F.when(F.col("_first").isNull(), F.when(at_end, low)).when(F.col("_last").isNull(), high).otherwise(low + (high - low) * share)

    # the values last, as they may have the names of columns that they are made from
    return met.select(*keys, "bin", "m", *[between(v).alias(v) for v in values]).where(F.col(values[0]).isNotNull())


def at_recalls(curve: DataFrame, by: str | list[str], value: str | list[str], bins: int = 101) -> DataFrame:
    """by, bin, m, values: each value linearly interpolated at evenly many recalls; beyond the largest recall nothing (zero to the reader), before the first one its value.

    A recall lies between the m-th hit and the next. Of the points that share m hits the last bounds the span above it and the first the span below it, so two joins on the number of hits replace windows over the curve.
    """
    keys, values = _keys(by), _keys(value)
    counted = curve.where("positives > 0")
    wanted = wanted_recalls(counted.groupBy(*keys).agg(F.max("tp").alias("_hits"), F.first("positives").alias("_n")), keys, bins)
    return between_points(recall_points(counted, wanted, keys, values), wanted, keys, values, bins)


def average_precision(curve: DataFrame, by: str | list[str], bins: int = 101, least_recall: float = 0.1, least_precision: float = 0.1) -> DataFrame:
    """by, ap: precision interpolated at ``bins`` recalls, clipped and averaged over bins above ``least_recall``."""
    keys = _keys(by)
    return curve.select(*keys).distinct().join(mean_precision(at_recalls(curve, by, "precision", bins), keys, bins, least_recall, least_precision), keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_precision(at: DataFrame, keys: list[str], bins: int = 101, least_recall: float = 0.1, least_precision: float = 0.1) -> DataFrame:
    """keys, ap from the precision of :func:`at_recalls`."""
    first = int(round((bins - 1) * least_recall)) + 1
    clipped = F.greatest(F.col("precision") - least_precision, F.lit(0.0))
    return at.where(F.col("bin") >= first).groupBy(*keys).agg(F.round(F.sum(clipped) / (bins - first) / (1 - least_precision), 6).alias("ap"))


def true_positive_errors(curve: DataFrame, by: str | list[str], score: str, errors: list[str], hit: str, bins: int = 101, least_recall: float = 0.1, at: DataFrame | None = None) -> DataFrame:
    """by, errors: the running means of the matches' errors, taken at the confidence of each recall bin and averaged from ``least_recall`` to the largest recall; 1 where that is not reached.

    Unknown (null) errors are skipped: a running mean is 0 before the first known one, and 1 throughout where none is known. ``at``: :func:`at_recalls` of the score, where it is at hand.
    """
    keys = _keys(by)
    at = at_recalls(curve, by, score, bins) if at is None else at
    conf = asked_confidences(at, keys, score, bins, least_recall)
    hits = running_sums(curve.where(F.col(hit)), by, score, [F.asc("k")], error_sums(errors), peers=True).join(F.broadcast(_asked(conf, keys)), [*keys, "tp"], "left_semi")
    known = hits.select(*keys, F.col("tp").cast("bigint").alias("m"), F.struct(F.col(score).alias("score"), *error_means(errors)).alias("_h"))
    found = errors_between(known, conf, keys, errors)
    return curve.select(*keys).distinct().join(found, keys, "left").select(*keys, *[F.round(F.coalesce(e, F.lit(1.0)), 6).alias(e) for e in errors])


def asked_confidences(at: DataFrame, keys: list[str], score: str, bins: int = 101, least_recall: float = 0.1) -> DataFrame:
    """keys, bin, m, _c: the scores at the recalls from ``least_recall`` on, from :func:`at_recalls`."""
    first = int(round((bins - 1) * least_recall)) + 1
    return at.where((F.col("bin") >= first) & (F.col(score) != 0)).select(*keys, "bin", "m", F.col(score).alias("_c"))


def error_sums(errors: list[str], hit: Column | None = None) -> dict[str, Column]:
    """What :func:`running_sums` sums for :func:`error_means`: each error and how often it is known, of the rows that meet ``hit``."""
    known = lambda e: F.col(e).isNotNull() & (F.lit(True) if hit is None else hit)
    return {f"_s_{e}": F.when(known(e), F.col(e)).otherwise(0.0) for e in errors} | {f"_n_{e}": F.when(known(e), 1).otherwise(0) for e in errors}


def error_means(errors: list[str]) -> list[Column]:
    """``mean`` and ``tied``: the running means of the errors at a hit, and at the first one of equal score, from :func:`error_sums`."""
    mean = lambda e, first: F.when(F.col(f"all__n_{e}") == 0, 1.0).when(F.col(f"{first}_n_{e}") == 0, 0.0).otherwise(F.try_divide(F.col(f"{first}_s_{e}"), F.col(f"{first}_n_{e}"))).alias(e)
    return [F.struct(*[mean(e, "") for e in errors]).alias("mean"), F.struct(*[mean(e, "first_") for e in errors]).alias("tied")]


def errors_between(known: DataFrame, conf: DataFrame, keys: list[str], errors: list[str]) -> DataFrame:
    """keys, errors: the running means ``known`` (keys, m, _h: score, mean, tied) at the m-th hits, interpolated at the confidences ``conf`` and averaged."""
    low = known.withColumnRenamed("_h", "_low")
    high = known.select(*keys, (F.col("m") - 1).alias("m"), F.col("_h").alias("_high"))
    met = conf.join(low, [*keys, "m"], "left").join(high, [*keys, "m"], "left")
    share = F.try_divide(F.col("_c") - F.col("_high.score"), F.col("_low.score") - F.col("_high.score"))

    def value(e: str) -> Column:
        mean, tied, below = F.col(f"_low.mean.{e}"), F.col(f"_low.tied.{e}"), F.col(f"_high.mean.{e}")
        return F.when(F.col("_low").isNull(), below).when(F.col("_low.score") == F.col("_c"), tied).when(F.col("_high").isNull(), mean).otherwise(below + (mean - below) * share)

    return met.groupBy(*keys).agg(*[F.avg(value(e)).alias(e) for e in errors])


def true_positive_error(curve: DataFrame, by: str | list[str], score: str, error: str, hit: str, bins: int = 101, least_recall: float = 0.1) -> DataFrame:
    """by, error: see :func:`true_positive_errors`."""
    return true_positive_errors(curve, by, score, [error], hit, bins, least_recall).withColumnRenamed(error, "error")


def precision_and_errors(curve: DataFrame, by: str | list[str], score: str, errors: list[str], hit: str, bins: int = 101, least_recall: float = 0.1, least_precision: float = 0.1) -> DataFrame:
    """by, ap, errors: both from one resampling of the curve."""
    keys = _keys(by)
    at = at_recalls(curve, by, ["precision", score], bins)
    ap = mean_precision(at, keys, bins, least_recall, least_precision)
    return true_positive_errors(curve, by, score, errors, hit, bins, least_recall, at).join(ap, keys, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def greedy_match(pairs: DataFrame, threshold: float) -> DataFrame:
    """group, pred, gt: by falling score each prediction takes its nearest free truth closer than ``threshold``.

    pairs: group, pred, score, gt, dist, with each prediction near any truth (a range join keeps the table small). A group is one sample.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for (_, pred), rows in pdf.sort_values(["score", "pred"], ascending=False).groupby(["score", "pred"], sort=False):
            free = rows[~rows["gt"].isin(taken) & (rows["dist"] < threshold)].sort_values(["dist", "gt"])
            if len(free):
                taken.add(free["gt"].iloc[0])
                out.append((pdf["group"].iloc[0], pred, free["gt"].iloc[0], free["dist"].iloc[0]))
        return pd.DataFrame(out, columns=["group", "pred", "gt", "dist"])

    return pairs.groupBy("group").applyInPandas(match, "`group` bigint, pred bigint, gt bigint, dist double")


def optimal_match(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of a small matrix (rows <= columns) by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]


#: Fixed value: the types that functions on groups return.
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def by_groups(rows: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, dict[str, np.ndarray]], list[tuple]], schema: dict[str, str]) -> DataFrame:
    """The rows (of ``schema``) that ``fn`` makes of the key and the columns, in ``order``, of each group of ``keys``; one group is held at a time.

    Groups follow each other in sorted batches. A grouped pandas function takes longer to make a table of a small group than the group's own work takes.
    """

    def split(table: pa.Table) -> np.ndarray:
        new = np.ones(len(table), bool)
        same = np.ones(max(len(table) - 1, 0), bool)
        for k in keys:
            c = table[k].combine_chunks()
            a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
            same &= pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        new[1:] = ~same
        return np.flatnonzero(new)

    def made(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        columns = {c: table[c].to_numpy() for c in table.column_names}
        names = list(zip(*[table[k].take(pa.array(starts)).to_pylist() for k in keys], strict=True))
        out: list[tuple] = []
        for key, a, z in zip(names, starts, [*starts[1:], len(table)], strict=True):
            out += fn(key, {c: v[a:z] for c, v in columns.items()})
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _TYPES[t]) for k, t in enumerate(schema.values())], names=list(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            if len(now):
                # the last group may go on in the next batch
                starts = split(now)
                if len(starts) > 1:
                    yield made(now.slice(0, starts[-1]), starts[:-1])
                rest = now.slice(starts[-1])
        if rest is not None and len(rest):
            yield made(rest, np.array([0]))

    # a fixed number of partitions, as small tables are long work here
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in schema.items()))


def track_events(frames: DataFrame, threshold: float) -> DataFrame:
    """scene, frames, tp, fp, fn, switches, distance: CLEAR-MOT counts. A pair of the last frame stays while close; the rest is assigned at least total distance.

    frames: scene, t, kind ('gt' or 'pred'), id, x, y. A scene is sequential and one group; scenes run in parallel.
    """

    def scene(key: tuple, of: dict[str, np.ndarray]) -> list[tuple]:
        last: dict = {}
        tp = fp = fn = switches = 0
        far = 0.0
        cuts = np.flatnonzero(of["t"][1:] != of["t"][:-1]) + 1
        starts = [0, *cuts.tolist()]
        for a0, z0 in zip(starts, [*starts[1:], len(of["t"])], strict=True):
            t = of["t"][a0]
            kind, ids, xs, ys = (of[c][a0:z0].tolist() for c in ("kind", "id", "x", "y"))
            g, p = ({i: (x, y) for k, i, x, y in zip(kind, ids, xs, ys, strict=True) if k == which} for which in ("gt", "pred"))
            gaps = np.array([*g.values()]).reshape(-1, 1, 2) - np.array([*p.values()]).reshape(1, -1, 2)
            gap = np.hypot(gaps[..., 0], gaps[..., 1]).tolist()
            row, column = {a: k for k, a in enumerate(g)}, {b: k for k, b in enumerate(p)}
            close = lambda a, b: gap[row[a]][column[b]]  # noqa: B023, E731
            pairs: dict = {}
            taken: set = set()
            for a, (b, _) in sorted(last.items(), key=lambda x: -x[1][1]):  # the newest pairs first, as a truth that comes back may find its partner taken
                if a in g and b in p and b not in taken and close(a, b) < threshold:
                    pairs[a] = b
                    taken.add(b)
            rest, free = [a for a in g if a not in pairs], [b for b in p if b not in taken]
            if rest and free:
                cost = np.array([[min(close(a, b), 1e3 * threshold) for b in free] for a in rest])
                flip = len(rest) > len(free)
                for i, j in optimal_match(cost.T if flip else cost):
                    a, b = (rest[j], free[i]) if flip else (rest[i], free[j])
                    if close(a, b) < threshold:
                        switches += a in last and last[a][0] != b
                        pairs[a] = b
            tp, fp, fn = tp + len(pairs), fp + len(p) - len(pairs), fn + len(g) - len(pairs)
            far += sum(close(a, b) for a, b in pairs.items())
            last |= {a: (b, t) for a, b in pairs.items()}
        return [(*key, len(starts), tp, fp, fn, switches, far)]

    counts = dict.fromkeys(("scene", "frames", "tp", "fp", "fn", "switches"), "bigint")
    return by_groups(frames.select("scene", "t", "kind", "id", "x", "y").where("t is not null"), ["scene"], ["t", "id"], scene, counts | {"distance": "double"})


def mot_summary(events: DataFrame) -> DataFrame:
    """mota and motar (0 at least), motp, recall and false positives for a hundred frames, over all scenes. motar does not count the truths beyond the recall as errors."""
    s = events.agg(*[F.sum(c).alias(c) for c in ("frames", "tp", "fp", "fn", "switches", "distance")])
    objects = F.col("tp") + F.col("fn")
    mota = 1 - F.try_divide(F.col("fp") + F.col("fn") + F.col("switches"), objects)
    motar = 1 - F.try_divide(F.col("fp") + F.col("switches"), F.col("tp"))
    return s.select(F.greatest(F.lit(0.0), mota).alias("mota"), F.greatest(F.lit(0.0), motar).alias("motar"), F.try_divide(F.col("distance"), F.col("tp")).alias("motp"), F.try_divide(F.col("tp"), objects).alias("recall"), F.try_divide(100 * F.col("fp"), F.col("frames")).alias("faf"))


def panoptic_quality(points: DataFrame, least_points: int = 1) -> DataFrame:
    """class, tp, fp, fn, sq, rq, pq from points (frame, class, truth, guess instance ids; 0 is none): overlaps above one half are one-to-one, so no matching is needed."""
    pair = points.groupBy("frame", "class", "truth", "guess").agg(F.count("*").alias("both"))
    truth = points.where("truth <> 0").groupBy("frame", "class", "truth").agg(F.count("*").alias("nt"))
    guess = points.where("guess <> 0").groupBy("frame", "class", "guess").agg(F.count("*").alias("ng"))
    met = pair.where("truth <> 0 and guess <> 0").join(truth, ["frame", "class", "truth"]).join(guess, ["frame", "class", "guess"]).withColumn("iou", F.col("both") / (F.col("nt") + F.col("ng") - F.col("both"))).where("iou > 0.5")
    fn = truth.where(F.col("nt") >= least_points).join(met, ["frame", "class", "truth"], "left_anti").groupBy("class").agg(F.count("*").alias("fn"))
    fp = guess.where(F.col("ng") >= least_points).join(met, ["frame", "class", "guess"], "left_anti").groupBy("class").agg(F.count("*").alias("fp"))
    tp = met.groupBy("class").agg(F.count("*").alias("tp"), F.sum("iou").alias("s"))
    out = points.select("class").distinct().join(tp, "class", "left").join(fp, "class", "left").join(fn, "class", "left").fillna(0)
    sq = F.coalesce(F.try_divide(F.col("s"), F.col("tp")), F.lit(0.0))
    rq = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")), F.lit(0.0))
    return out.select("class", "tp", "fp", "fn", F.round(sq, 6).alias("sq"), F.round(rq, 6).alias("rq"), F.round(sq * rq, 6).alias("pq"))


def displacement_errors(modes: DataFrame, k: int, tolerance: float = 2.0) -> DataFrame:
    """id, min_ade, min_fde, missed over the k most probable modes (id, mode, p, t, dist: distance at each step)."""
    by = modes.groupBy("id", "mode").agg(F.max("p").alias("p"), F.avg("dist").alias("ade"), F.max_by("dist", F.struct("t", "dist")).alias("fde"), F.max("dist").alias("worst"))
    top = by.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "mode"))).where(F.col("r") <= k)
    return top.groupBy("id").agg(F.round(F.min("ade"), 6).alias("min_ade"), F.round(F.min("fde"), 6).alias("min_fde"), (F.min("worst") >= tolerance).alias("missed"))


def accuracy(rows: DataFrame, hit: Column, *by: str) -> DataFrame:
    """Accuracy in percent for all rows and each prefix of ``by`` (nulls mark the coarser levels)."""
    out = rows.withColumn("_hit", hit.cast("int")).rollup(*by).agg(F.count("*").alias("n"), F.sum("_hit").cast("bigint").alias("hits"))
    return out.withColumn("accuracy", F.round(F.col("hits") * 100.0 / F.col("n"), 2))


def panoptic_tracking(points: DataFrame, least_points: int = 1) -> DataFrame:
    """class, switches, ptq, sptq: panoptic quality less identity switches, as counts and as the overlap that they lose.

    points: scene, frame, class, truth, guess (instance ids kept over the frames of a scene; 0 is none). A switch is a true instance matched to another guess than when it was last matched.
    """
    whole = points.withColumn("_scene", F.col("scene")).withColumn("frame", F.struct("scene", "frame"))
    pair = whole.groupBy("_scene", "frame", "class", "truth", "guess").agg(F.count("*").alias("both"))
    truth = whole.where("truth <> 0").groupBy("frame", "class", "truth").agg(F.count("*").alias("nt"))
    guess = whole.where("guess <> 0").groupBy("frame", "class", "guess").agg(F.count("*").alias("ng"))
    met = pair.where("truth <> 0 and guess <> 0").join(truth, ["frame", "class", "truth"]).join(guess, ["frame", "class", "guess"]).withColumn("iou", F.col("both") / (F.col("nt") + F.col("ng") - F.col("both"))).where("iou > 0.5")
    before = F.lag("guess").over(Window.partitionBy("_scene", "class", "truth").orderBy("frame"))
    switched = met.withColumn("switched", F.coalesce(before != F.col("guess"), F.lit(False)))
    by = switched.groupBy("class").agg(F.count_if("switched").alias("switches"), F.sum("iou").alias("s"), F.sum(F.when(F.col("switched"), F.col("iou")).otherwise(0.0)).alias("lost"))
    quality = panoptic_quality(whole.drop("_scene", "scene"), least_points).select("class", "tp", "fp", "fn")
    both = quality.join(by, "class", "left").fillna(0)
    size = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    ptq, sptq = (F.round(F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("s") - x), size), F.lit(0.0)), 6) for x in (F.col("switches"), F.col("lost")))
    return both.select("class", "switches", ptq.alias("ptq"), sptq.alias("sptq"))


def recall_thresholds(scored: DataFrame, by: str, score: str, order: str, hit: str, positives: DataFrame, steps: int = 40, least_recall: float = 0.1) -> DataFrame:
    """by, recall, threshold: the score at which each of ``steps`` recalls is reached (null where never): that of the hit which reaches it. positives: by, n."""
    hits = running_sums(scored.where(F.col(hit)), by, score, [F.desc(order)], {"tp": F.lit(1)})
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.round(F.lit(least_recall) + k * (1 - least_recall) / (steps - 1), 12)))
    wanted = positives.select(by, "n", at.alias("recall")).withColumn("tp", F.greatest(F.lit(1), F.ceil((F.col("recall") - 1e-12) * F.col("n"))).cast("bigint"))
    return wanted.join(hits.select(by, F.col("tp").cast("bigint").alias("tp"), F.col(score).alias("threshold")), [by, "tp"], "left").select(by, "recall", "threshold")


def tracking_summary(rows: DataFrame, worst_distance: float = 2.0) -> DataFrame:
    """class, amota, amotp, mota and the counts at the best threshold, from one row for each class and threshold (class, threshold, motar, mota, motp, tp, fp, fn, switches; nulls where a recall is not reached)."""
    best = F.max_by(F.struct("tp", "fp", "fn", "switches"), F.coalesce("mota", F.lit(-1.0)))
    out = rows.groupBy("class").agg(F.round(F.avg(F.coalesce("motar", F.lit(0.0))), 6).alias("amota"), F.round(F.avg(F.coalesce("motp", F.lit(worst_distance))), 6).alias("amotp"), F.round(F.max("mota"), 6).alias("mota"), best.alias("b"))
    return out.select("class", "amota", "amotp", "mota", "b.*")


def detection_score(mean_ap: Column, *errors: Column) -> Column:
    """(5 mAP + the sum of what each error leaves of one) / (5 + errors)."""
    left = sum((F.greatest(F.lit(0.0), 1 - e) for e in errors), F.lit(0.0))
    return (5 * mean_ap + left) / (5 + len(errors))


def label_stats(points: DataFrame, by: str, label: str) -> DataFrame:
    """by, label, points, share: labelled points of each frame, and their share of the frame."""
    n = points.groupBy(by, label).agg(F.count("*").alias("points"))
    return n.withColumn("share", F.round(F.col("points") / F.sum("points").over(Window.partitionBy(by)), 6))


def running_least(modes: DataFrame) -> DataFrame:
    """id, k, min_ade, min_fde: the least errors over the k most probable modes, for every k at once (id, mode, p, t, dist)."""
    by = modes.groupBy("id", "mode").agg(F.max("p").alias("p"), F.avg("dist").alias("ade"), F.max_by("dist", F.struct("t", "dist")).alias("fde"))
    w = Window.partitionBy("id").orderBy(F.desc("p"), "mode")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return by.select("id", F.row_number().over(w).alias("k"), F.round(F.min("ade").over(so_far), 6).alias("min_ade"), F.round(F.min("fde").over(so_far), 6).alias("min_fde"))
