"""Which conditions single out a target: uniqueness as window counts, and a greedy choice of references."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Single conditions in order of preference; each is a set of edge columns that may leave one target of a source.
METHODS = (
    ("type", ("dst_type",)), ("type_status", ("dst_type", "dst_status")), ("direction", ("dir8",)), ("type_level", ("dst_type", "level")),
    ("type_direction_level", ("dst_type", "dir8", "level")), ("all", ("dst_type", "dst_status", "dir8", "level")),
)


def uniqueness(edges: DataFrame) -> DataFrame:
    """Each edge with unique_<method> for every method, the rank of its target by distance and the first method that is unique.

    Every method is one window count over equal values, so no subset is searched.
    """
    out = edges
    for name, columns in METHODS:
        out = out.withColumn(f"unique_{name}", F.count("*").over(Window.partitionBy("frame", "src", *columns)) == 1)
    kind = Window.partitionBy("frame", "src", "dst_type")
    alone = F.count("*").over(Window.partitionBy("frame", "src", "dst_type", "dist")) == 1  # equal distances single out none
    out = out.withColumns({"rank": F.row_number().over(kind.orderBy("dist", "dst")), "of_type": F.count("*").over(kind), "_alone": alone, "_least": F.min("dist").over(kind), "_most": F.max("dist").over(kind)})
    first = F.coalesce(*[F.when(F.col(f"unique_{n}"), F.lit(n)) for n, _ in METHODS], F.when(F.col("_alone") & (F.col("dist") == F.col("_least")), "nearest"), F.when(F.col("_alone") & (F.col("dist") == F.col("_most")), "farthest"), F.lit("ordinal"))
    out = out.withColumn("_method", first).drop("_alone", "_least", "_most")
    return out.withColumnRenamed("_method", "method")


def rank_label(rank, count):
    """nearest, 2nd-nearest, farthest, 2nd-farthest or the k-th of a partition."""
    return F.when(rank == 1, "nearest").when(rank == count, "farthest").when(rank == 2, "2nd-nearest").when(rank == count - 1, "2nd-farthest").otherwise(F.concat(rank.cast("string"), F.lit("-th")))


def two_references(edges: DataFrame) -> DataFrame:
    """frame, dst, refs: pairs of sources of which the views (type and dir6) leave only the target in common.

    A target seen alone by one source needs no second one and is left out.
    """
    view = edges.select("frame", "src", "dst", "dst_type", "dir6")
    seen = view.withColumn("n", F.count("*").over(Window.partitionBy("frame", "src", "dst_type", "dir6")))
    hard = seen.where("n > 1")
    pair = hard.alias("p").join(hard.alias("q"), ["frame", "dst"]).where("p.src < q.src").select("frame", "dst", F.col("p.src").alias("s1"), F.col("p.dst_type").alias("t"), F.col("p.dir6").alias("d1"), F.col("q.src").alias("s2"), F.col("q.dir6").alias("d2"))
    one = view.select("frame", F.col("src").alias("s1"), F.col("dir6").alias("d1"), F.col("dst_type").alias("t"), F.col("dst").alias("z"))
    two = view.select("frame", F.col("src").alias("s2"), F.col("dir6").alias("d2"), F.col("dst_type").alias("t"), F.col("dst").alias("z"))
    common = pair.join(one, ["frame", "s1", "d1", "t"]).join(two, ["frame", "s2", "d2", "t", "z"]).groupBy("frame", "dst", "s1", "s2").agg(F.count("*").alias("n"))
    return common.where("n = 1").groupBy("frame", "dst").agg(F.count("*").alias("refs"))


def _chosen(left: set, kept: dict[int, set], most: int, without: set) -> tuple[list[int], set]:
    """References taken one by one, that which removes most first; of equals a remaining candidate, then the smallest id."""
    refs: list[int] = []
    while len(refs) < most and len(left) > 1:
        gain, _, ref = min(((-len(left - k), r not in left, r) for r, k in kept.items() if r not in refs and r not in without), default=(0, False, None))
        if gain == 0:
            break
        refs.append(ref)
        left = left & kept[ref]
    return refs, left


def _planned(views: DataFrame, plan: Callable[[set, dict[int, set]], list[tuple[list[int], set]]], schema: str, numbered: bool) -> DataFrame:
    names = ["frame", "target", *["plan"] * numbered, "rounds", "left", "refs"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.list_value_length(b.column("views")).to_numpy()).tolist()
            refs, candidates, agrees = (x.to_numpy(zero_copy_only=False).tolist() for x in b.column("views").flatten().flatten())
            rows, start = [], 0
            for frame, target, end in zip(b.column("frame").to_pylist(), b.column("target").to_pylist(), ends, strict=True):
                kept: dict[int, set] = {}
                for r, c, same in zip(refs[start:end], candidates[start:end], agrees[start:end], strict=True):
                    own = kept.setdefault(r, set())
                    if same:
                        own.add(c)
                chosen = plan(set(candidates[start:end]), kept)
                rows += [(frame, target, *[k] * numbered, len(taken), len(left), "|".join(map(str, taken))) for k, (taken, left) in enumerate(chosen)]
                start = end
            types = {"plan": pa.int32(), "rounds": pa.int32(), "left": pa.int32(), "refs": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(n, pa.int64())) for k, n in enumerate(names)], names=names)

    return views.groupBy("frame", "target").agg(F.collect_list(F.struct("ref", "candidate", "agrees")).alias("views")).mapInArrow(choose, schema)


def greedy_references(views: DataFrame, most: int = 3) -> DataFrame:
    """frame, target, rounds, left, refs: references chosen one by one, each removing the most candidates; stops when none gains.

    views: frame, target, ref, candidate, agrees (whether the reference sees the candidate as it sees the target). The choice is sequential for
    one target, whose candidates are the few nodes of its frame, so each target is one small row, and a batch of rows is read at a time.
    """
    return _planned(views, lambda left, kept: [_chosen(left, kept, most, set())], "frame bigint, target bigint, rounds int, left int, refs string", False)


def plan_alternatives(views: DataFrame, most: int = 3, plans: int = 3) -> DataFrame:
    """frame, target, plan, rounds, left, refs: up to ``plans`` choices as in greedy_references, each without the first reference of those before; it ends with a choice of none."""

    def several(left: set, kept: dict[int, set]) -> list[tuple[list[int], set]]:
        out, without = [], set()
        while len(out) < plans:
            refs, rest = _chosen(left, kept, most, without)
            if not refs and out:
                break
            out.append((refs, rest))
            if not refs:
                break
            without.add(refs[0])
        return out

    return _planned(views, several, "frame bigint, target bigint, plan int, rounds int, left int, refs string", True)


def select_gaps(gaps: DataFrame, budget: int) -> DataFrame:
    """frame, step, key, score: paths picked one by one by how many uncovered parts they add, at most ``budget`` for each frame.

    gaps: frame, key, a, b, c. Coverage so far decides the next pick, so a frame is sequential; frames run in parallel. What a path adds never grows, so scores are upper bounds
    in a heap and only the topmost is scored anew.
    """

    def one_frame(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: ({a, b, c}, {tuple(sorted((a, b))), tuple(sorted((b, c)))}) for k, a, b, c in pdf[["key", "a", "b", "c"]].itertuples(index=False, name=None)}
        nodes: set = set()
        pairs: set = set()
        score = lambda k: 100 * len(parts[k][0] - nodes) + 10 * len(parts[k][1] - pairs) + 1
        heap = [(-score(k), k) for k in parts]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < budget:
            bound, key = heap[0]
            if -bound != (now := score(key)):
                heapq.heapreplace(heap, (-now, key))
                continue
            heapq.heappop(heap)
            nodes |= parts[key][0]
            pairs |= parts[key][1]
            out.append((pdf["frame"].iloc[0], len(out) + 1, key, now))
        return pd.DataFrame(out, columns=["frame", "step", "key", "score"])

    return gaps.groupBy("frame").applyInPandas(one_frame, "frame bigint, step int, key string, score int")


def two_phase_selection(gaps: DataFrame, share: float = 0.25, window: int = 10, first: str = "A", slots: tuple[str, ...] = ("A", "B", "C", "D")) -> DataFrame:
    """frame, step, phase, key, slot, delta, reason: the questions that a frame asks, in order.

    gaps: frame, key, score, plans (array of slot and ``covers``, the paths that its question covers; the first of a slot counts). By falling score (ties by key) gaps that are not covered yet take a plan.
    Phase 1 takes plans of the slot ``first`` until ``share`` of the gaps is covered (reason share), ``window`` successive questions cover one new gap or none (plateau), or no gap is left (exhausted). Phase 2
    gives each remaining gap the slot with the fewest questions so far, phase 1 counting for the first slot, or the next one that has a plan; ties by slot.
    """

    def one_frame(table: pa.Table) -> pa.Table:
        frame = table.column("frame")[0].as_py()
        own = table.column("plans").combine_chunks()
        each = dict(zip([f.name for f in own.type.value_type], own.flatten().flatten(), strict=True))
        lists, named = (np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy())].tolist() for x in (own, each["covers"]))
        asks, paths = each["slot"].to_pylist(), each["covers"].flatten().to_numpy(zero_copy_only=False).tolist()
        rows = sorted(zip(table.column("key").to_pylist(), table.column("score").to_pandas().tolist(), range(len(own)), strict=True), key=lambda r: (-r[1], r[0]))
        plans: dict[str, dict] = {}
        for k, _, at in rows:
            plans[k] = {}
            for p in range(lists[at], lists[at + 1]):
                plans[k].setdefault(asks[p], paths[named[p] : named[p + 1]])
        every, covered, out, streak, reason = set(plans), set(), [], 0, "exhausted"

        def ask(key: str, slot: str, phase: int) -> int:
            new = every.intersection(plans[key][slot]) - covered
            covered.update(new)
            out.append((frame, len(out) + 1, phase, key, slot, len(new)))
            return len(new)

        for k, _, _ in rows:
            if len(covered) >= share * len(every) or streak >= window:
                reason = "plateau" if streak >= window else "share"
                break
            if k not in covered and first in plans[k]:
                streak = streak + 1 if ask(k, first, 1) <= 1 else 0
        asked = dict.fromkeys(slots, 0) | {first: len(out)}
        for k, _, _ in rows:
            if k in covered:
                continue
            slot = min((s for s in slots if s in plans[k]), key=lambda s: (asked[s], s), default=None)
            if slot is not None:
                ask(k, slot, 2)
                asked[slot] += 1
        types = {"frame": pa.int64(), "step": pa.int32(), "phase": pa.int32(), "key": pa.string(), "slot": pa.string(), "delta": pa.int32(), "reason": pa.string()}
        return pa.table({name: pa.array([(*r, reason)[i] for r in out], kind) for i, (name, kind) in enumerate(types.items())})

    return gaps.groupBy("frame").applyInArrow(one_frame, "frame bigint, step int, phase int, key string, slot string, delta int, reason string")
