"""The catalogue of question kinds: each name is a small plan over the pattern operators, answered for all frames at once.

A kind takes (nodes, edges, Ask) and returns frame, answer (text; null where nothing can be answered). Nodes need the columns of
:mod:`orrery.operators.graph`; distances "within" and nearest or farthest are from the origin, where ego stands.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G

from .patterns import Obj, Relation, between_query, comparison_query, count_query, exist_query, extreme_query, first_query, matches, same_status_query, types_present


@dataclass(frozen=True)
class Ask:
    """What a template fills in. ``one`` and ``two`` name single nodes; ``ref`` and ``ref2`` are anchors, ``ego`` the own vehicle."""

    type: str | None = None
    type2: str | None = None
    status: str | None = None
    status2: str | None = None
    direction: str | None = None
    direction2: str | None = None
    ref: Obj = field(default_factory=Obj)
    ref2: Obj = field(default_factory=Obj)
    one: Obj = field(default_factory=Obj)
    two: Obj = field(default_factory=Obj)
    ego: Obj = field(default_factory=lambda: Obj("ego"))
    within: float = 10.0


Kind = Callable[[DataFrame, DataFrame, Ask], DataFrame]


def _text(df: DataFrame) -> DataFrame:
    return df.select("frame", F.col("answer").cast("string").alias("answer"))


def _seen(ask: Ask, *anchors: tuple[Obj, str | None], type: str | None = None, status: str | None = None) -> Obj:
    return Obj(type, status, None, tuple(Relation(o, d) for o, d in anchors))


def _chain(ask: Ask, status: str | None = None) -> Obj:
    """ref, then a node of type2 in direction, then the target in direction2."""
    return Obj(ask.type, status, None, (Relation(Obj(ask.type2, None, None, (Relation(ask.ref, ask.direction),)), ask.direction2),))


def _exists(build: Callable[[Ask], Obj]) -> Kind:
    return lambda n, e, a: exist_query(n, e, build(a))


def _counts(build: Callable[[Ask], Obj]) -> Kind:
    return lambda n, e, a: _text(count_query(n, e, build(a)))


def _first(build: Callable[[Ask], Obj], prop: str) -> Kind:
    return lambda n, e, a: _text(first_query(n, e, build(a), prop))


def _near(nodes: DataFrame, ask: Ask) -> DataFrame:
    return nodes.where(F.hypot("x", "y") <= ask.within)


def _heading(facing: bool) -> Callable[[DataFrame], DataFrame]:
    """Nodes that look towards the origin (within 45 degrees), or away from it."""

    def keep(nodes: DataFrame) -> DataFrame:
        off = F.abs(G.wrap(F.col("yaw") - F.degrees(F.atan2(-F.col("y"), -F.col("x")))))
        return nodes.where(off <= 45 if facing else off >= 135)

    return keep


def _on(keep: Callable[[DataFrame], DataFrame], build: Callable[[Ask], Obj], count: bool = False) -> Kind:
    """Existence or count among the matches that also pass a filter on nodes."""

    def ask(n: DataFrame, e: DataFrame, a: Ask) -> DataFrame:
        met = matches(n, e, build(a)).select("frame", "id").distinct().join(keep(n).select("frame", "id"), ["frame", "id"], "left_semi")
        got = n.select("frame").distinct().join(met.groupBy("frame").agg(F.count("*").alias("k")), "frame", "left").fillna(0, ["k"])
        return got.select("frame", (F.col("k").cast("string") if count else F.when(F.col("k") > 0, "yes").otherwise("no")).alias("answer"))

    return ask


def _value(build: Callable[[Ask], Obj], prop: Callable[[], Column]) -> Kind:
    """A property computed for the matching node of smallest id."""
    return lambda n, e, a: _text(n.select("frame").distinct().join(matches(n.withColumn("_p", prop()), e, build(a)).select("frame", "id").join(n.select("frame", "id", prop().alias("_p")), ["frame", "id"]).groupBy("frame").agg(F.min_by("_p", "id").alias("answer")), "frame", "left"))


def _two(prop: Callable[[], Column], which: bool, less: bool, first: Callable[[Ask], Obj] = lambda a: a.one, second: Callable[[Ask], Obj] = lambda a: a.two) -> Kind:
    """Whether the first has less (or more) than the second, strictly; or which has, the first on ties."""

    def ask(n: DataFrame, e: DataFrame, a: Ask) -> DataFrame:
        x = _value(first, prop)(n, e, a).withColumnRenamed("answer", "p")
        y = _value(second, prop)(n, e, a).withColumnRenamed("answer", "q")
        p, q = F.col("p").cast("double"), F.col("q").cast("double")
        if which:
            answer = F.when((q < p) if less else (q > p), "second").otherwise("first")
        else:
            answer = F.when((p < q) if less else (p > q), "yes").otherwise("no")
        return x.join(y, "frame").select("frame", F.when(p.isNotNull() & q.isNotNull(), answer).alias("answer"))

    return ask


def _equal(first: Kind, second: Kind) -> Kind:
    def ask(n: DataFrame, e: DataFrame, a: Ask) -> DataFrame:
        x, y = first(n, e, a).withColumnRenamed("answer", "p"), second(n, e, a).withColumnRenamed("answer", "q")
        return x.join(y, "frame").select("frame", F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), F.when(F.col("p") == F.col("q"), "yes").otherwise("no")).alias("answer"))

    return ask


def _more(first: Callable[[Ask], Obj], second: Callable[[Ask], Obj], which: bool) -> Kind:
    def ask(n: DataFrame, e: DataFrame, a: Ask) -> DataFrame:
        x = count_query(n, e, first(a)).withColumnRenamed("answer", "p")
        y = count_query(n, e, second(a)).withColumnRenamed("answer", "q")
        answer = F.when(F.col("q") > F.col("p"), "second").otherwise("first") if which else F.when(F.col("p") > F.col("q"), "yes").otherwise("no")
        return x.join(y, "frame").select("frame", answer.alias("answer"))

    return ask


def _direction(anchor: Callable[[Ask], Obj], target: Callable[[Ask], Obj]) -> Kind:
    def ask(n: DataFrame, e: DataFrame, a: Ask) -> DataFrame:
        src = matches(n, e, anchor(a)).groupBy("frame").agg(F.min("id").alias("src"))
        dst = matches(n, e, target(a)).groupBy("frame").agg(F.min("id").alias("dst"))
        met = e.join(src, ["frame", "src"]).join(dst, ["frame", "dst"]).select("frame", F.col("dir6").alias("answer"))
        return n.select("frame").distinct().join(met, "frame", "left")

    return ask


def _same(kind: bool, which: str) -> Kind:
    """Others of the reference's status: exists, count, or the type of the first one."""

    def ask(n: DataFrame, e: DataFrame, a: Ask) -> DataFrame:
        if which == "what":
            anchor = matches(n, e, a.ref).groupBy("frame").agg(F.min(F.struct("id", "status")).alias("r"))
            met = n.join(anchor, "frame").where((F.col("status") == F.col("r.status")) & (F.col("id") != F.col("r.id")))
            return n.select("frame").distinct().join(met.groupBy("frame").agg(F.min_by("type", "id").alias("answer")), "frame", "left")
        got = same_status_query(n, e, a.ref, a.type if kind else None)
        return _text(got) if which == "count" else got.select("frame", F.when(F.col("answer") > 0, "yes").otherwise("no").alias("answer"))

    return ask


def _common_status(build: Callable[[Ask], Obj]) -> Kind:
    """The status that all matches share, else null."""

    def ask(n: DataFrame, e: DataFrame, a: Ask) -> DataFrame:
        met = matches(n, e, build(a)).groupBy("frame").agg(F.min("status").alias("p"), F.max("status").alias("q"))
        return n.select("frame").distinct().join(met.select("frame", F.when(F.col("p") == F.col("q"), F.col("p")).alias("answer")), "frame", "left")

    return ask


def _dist() -> Column:
    return F.hypot("x", "y")


def _speed() -> Column:
    return F.hypot("vx", "vy")


def _heading_name() -> Column:
    off = F.abs(G.wrap(F.col("yaw") - F.degrees(F.atan2(-F.col("y"), -F.col("x")))))
    return F.when(off <= 45, "facing_ego").when(off >= 135, "away_from_ego").otherwise("sideways")


def _moving_name() -> Column:
    return F.when(_speed() < 0.5, "stopped").otherwise(G.dir6(F.degrees(F.atan2("vy", "vx"))))


def _approaches(n: DataFrame) -> DataFrame:
    return n.where(G.is_approaching(*[F.col(c) for c in ("x", "y", "vx", "vy")]))


any_ = lambda a: Obj()
typed = lambda a: Obj(a.type)
typed2 = lambda a: Obj(a.type2)
stated = lambda a: Obj(a.type, a.status)
from_ego = lambda a: _seen(a, (a.ego, a.direction), type=a.type)
from_ref = lambda a: _seen(a, (a.ref, a.direction), type=a.type)
any_from_ego = lambda a: _seen(a, (a.ego, a.direction))
any_from_ref = lambda a: _seen(a, (a.ref, a.direction))
stated_from_ego = lambda a: _seen(a, (a.ego, a.direction), type=a.type, status=a.status)
stated_from_ref = lambda a: _seen(a, (a.ref, a.direction), type=a.type, status=a.status)
any_stated_from_ego = lambda a: _seen(a, (a.ego, a.direction), status=a.status)
met = lambda a: _seen(a, (a.ref, a.direction), (a.ref2, a.direction2), type=a.type)
any_met = lambda a: _seen(a, (a.ref, a.direction), (a.ref2, a.direction2))
stated_met = lambda a: _seen(a, (a.ref, a.direction), (a.ref2, a.direction2), type=a.type, status=a.status)
second_from_ref = lambda a: _seen(a, (a.ref, a.direction2), type=a.type2)
one = lambda a: a.one
two = lambda a: a.two
ref = lambda a: a.ref


def _nearest(build: Callable[[Ask], Obj], prop: str, farthest: bool = False) -> Kind:
    return lambda n, e, a: _text(extreme_query(n, e, build(a), prop, farthest))


def _by(build: Callable[[Ask], Obj], prop: Callable[[], Column], most: bool) -> Kind:
    """The id of the match with the largest (or smallest) property, the smaller id on ties."""

    def ask(n: DataFrame, e: DataFrame, a: Ask) -> DataFrame:
        ids = matches(n, e, build(a)).select("frame", "id").distinct().join(n.select("frame", "id", prop().alias("_p")), ["frame", "id"])
        key = F.struct((-F.col("_p") if most else F.col("_p")).alias("p"), "id")
        return _text(n.select("frame").distinct().join(ids.groupBy("frame").agg(F.min_by("id", key).alias("answer")), "frame", "left"))

    return ask


def _yes(kind: Kind, wanted: Callable[[Ask], str | None]) -> Kind:
    """Whether another kind's answer is the wanted word."""
    return lambda n, e, a: kind(n, e, a).select("frame", F.when(F.col("answer") == F.lit(wanted(a)), "yes").otherwise("no").alias("answer"))


KINDS: dict[str, Kind] = {
    # existence
    "exists_type": _exists(typed), "exists_status_type": _exists(stated), "exists_any": _exists(any_), "exists_direction_from_ego": _exists(from_ego), "exists_direction_from_ref": _exists(from_ref),
    "exists_status_direction_from_ego": _exists(stated_from_ego), "exists_status_direction_from_ref": _exists(stated_from_ref), "exists_any_direction_from_ego": _exists(any_from_ego),
    "exists_converge_pivot": _exists(met), "exists_converge_pivot_any": _exists(any_met), "exists_diverge_direction": _exists(from_ref), "exists_facing_ego_in_direction": _on(_heading(True), from_ego), "exists_facing_away_in_direction": _on(_heading(False), from_ego),
    "exists_within_distance": lambda n, e, a: _on(lambda m: _near(m, a), typed)(n, e, a), "exists_within_distance_direction": lambda n, e, a: _on(lambda m: _near(m, a), from_ego)(n, e, a), "exists_between_two": lambda n, e, a: between_query(n, 0, 1, a.type),
    "exists_2hop_chain": _exists(_chain), "exists_2hop_chain_status": _exists(lambda a: _chain(a, a.status)), "exists_2hop_chain_heading": _on(_heading(True), _chain), "exists_both_directions": _exists(met), "exists_any_both_directions": _exists(any_met),
    "exists_same_status_another": _same(True, "exists"), "exists_approaching_direction": _on(_approaches, from_ego),
    # counts
    "count_type": _counts(typed), "count_status_type": _counts(stated), "count_all_objects": _counts(any_), "count_distinct_types": lambda n, e, a: _text(types_present(n).select("frame", F.col("n_types").alias("answer"))),
    "count_direction_from_ego": _counts(from_ego), "count_direction_from_ref": _counts(from_ref), "count_any_direction_from_ego": _counts(any_from_ego), "count_status_direction_from_ego": _counts(stated_from_ego), "count_status_any_direction_from_ego": _counts(any_stated_from_ego),
    "count_converge_pivot": _counts(met), "count_diverge_direction": _counts(from_ref), "count_within_distance": lambda n, e, a: _on(lambda m: _near(m, a), typed, True)(n, e, a), "count_within_distance_direction": lambda n, e, a: _on(lambda m: _near(m, a), from_ego, True)(n, e, a),
    "count_status_within_distance": lambda n, e, a: _on(lambda m: _near(m, a), stated, True)(n, e, a), "count_both_directions": _counts(met), "count_same_status": _same(True, "count"), "count_same_status_any": _same(False, "count"), "count_approaching": _on(_approaches, typed, True),
    # status
    "node_status_by_type": _first(typed, "status"), "node_status_by_id": _first(one, "status"), "status_direction_from_ego": _first(from_ego, "status"), "status_direction_from_ref": _first(from_ref, "status"), "status_converge_pivot": _first(met, "status"),
    "status_diverge_direction": _first(from_ref, "status"), "status_nearest_direction": _nearest(any_from_ego, "status"), "status_of_nearest": _nearest(typed, "status"), "status_2hop_chain": _first(_chain, "status"), "status_both_directions": _first(met, "status"),
    "common_status_near_ref": _common_status(any_from_ref), "shared_status_same_type": _common_status(typed), "what_status_both_directions": _first(any_met, "status"),
    # objects
    "what_is_status_type": _first(lambda a: Obj(None, a.status), "type"), "what_is_status_thing": _first(lambda a: Obj(None, a.status), "type"), "list_all_types": lambda n, e, a: types_present(n).select("frame", F.col("types").alias("answer")),
    "what_direction_from_ego": _first(any_from_ego, "type"), "what_thing_direction_from_ego": _first(any_from_ego, "type"), "what_direction_from_ref": _first(any_from_ref, "type"), "what_converge_pivot": _first(any_met, "type"), "what_diverge_direction": _first(any_from_ref, "type"),
    "nearest_of_type": _nearest(typed, "id"), "nearest_in_direction": _nearest(any_from_ego, "id"), "farthest_of_type": _nearest(typed, "id", True), "what_2hop_chain": _first(lambda a: replace(_chain(a), type=None), "type"), "what_both_directions": _first(any_met, "type"), "what_same_status_other": _same(False, "what"),
    "fastest_of_type": _by(typed, _speed, True), "largest_of_type": _by(typed, lambda: F.col("height"), True), "smallest_of_type": _by(typed, lambda: F.col("height"), False),
    # comparison
    "compare_status_two": lambda n, e, a: comparison_query(n, e, a.one, a.two), "compare_type_two": lambda n, e, a: comparison_query(n, e, a.one, a.two, "type"), "compare_count_two_types": _more(typed, typed2, False), "compare_count_two_types_which": _more(typed, typed2, True),
    "compare_count_two_statuses": _more(lambda a: Obj(None, a.status), lambda a: Obj(None, a.status2), False), "compare_count_two_statuses_which": _more(lambda a: Obj(None, a.status), lambda a: Obj(None, a.status2), True),
    "compare_direction_ref_vs_id": _equal(_first(any_from_ref, "status"), _first(one, "status")), "compare_id_vs_direction_ref": _equal(_first(one, "status"), _first(any_from_ref, "status")), "compare_direction_ego_vs_id": _equal(_first(any_from_ego, "status"), _first(one, "status")),
    "compare_ego_dir_vs_ref_dir": _equal(_first(any_from_ego, "status"), _first(any_from_ref, "status")), "compare_two_direction_refs": _equal(_first(any_from_ref, "status"), _first(lambda a: _seen(a, (a.ref2, a.direction2)), "status")),
    "compare_diverge_status": _equal(_first(from_ref, "status"), _first(second_from_ref, "status")), "compare_diverge_distance": _two(_dist, False, True, from_ref, second_from_ref), "compare_distance_two_ids": _two(_dist, False, True), "compare_distance_two_ids_which": _two(_dist, True, True),
    "compare_nearest_farthest_status": _equal(_nearest(typed, "status"), _nearest(typed, "status", True)), "compare_speed_two_ids": _two(_speed, False, False), "compare_speed_two_ids_which": _two(_speed, True, False), "compare_size_two": _two(lambda: F.col("height"), False, False), "compare_size_two_which": _two(lambda: F.col("height"), True, False),
    # checks, heading, speed and direction
    "verify_status_by_id": _yes(_first(one, "status"), lambda a: a.status), "verify_status_by_type": _yes(_first(typed, "status"), lambda a: a.status), "is_facing_ego": _on(_heading(True), one), "is_facing_away": _on(_heading(False), one), "heading_of_id": _value(one, _heading_name),
    "is_facing_ego_direction": _on(_heading(True), any_from_ego), "is_facing_ego_ref_direction": _on(_heading(True), any_from_ref), "heading_of_direction_obj": _value(any_from_ego, _heading_name), "heading_2hop_chain": _on(_heading(True), _chain), "heading_2hop_chain_query": _value(_chain, _heading_name),
    "direction_of_id_from_ego": _direction(lambda a: a.ego, one), "direction_of_id_from_ref": _direction(ref, one), "is_approaching_direction": _on(_approaches, any_from_ego), "is_approaching_id": _on(_approaches, one), "moving_direction_of_id": _value(one, _moving_name),
    "distance_to_nearest_type": lambda n, e, a: _text(n.select("frame").distinct().join(n.where(F.col("type") == F.lit(a.type)).groupBy("frame").agg(F.round(F.min(_dist()), 4).alias("answer")), "frame", "left")), "distance_to_obj_id": _value(one, lambda: F.round(_dist(), 4)), "speed_of_obj": _value(one, lambda: F.round(_speed(), 4)), "speed_of_type": _value(typed, lambda: F.round(_speed(), 4)),
}


def answer(kind: str, nodes: DataFrame, edges: DataFrame, ask: Ask) -> DataFrame:
    """frame, answer of a kind by name; an unknown name is an error."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    return KINDS[kind](nodes, edges, ask)
