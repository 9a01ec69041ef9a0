"""The whole catalogue of question kinds over the stand-in, one query for each family, and its twins, written for DuckDB from a table of the kinds' meanings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import graph, kinds
from orrery.session import durable

from .scene import _FRAMES, ASK, EDGES, REACH, nodes_of


def _of(type: str | None = None, status: str | None = None, *seen: tuple[str, str]) -> str:
    """Nodes of a type and status that lie in the direction of each of ``seen`` (nodes, direction)."""
    joins = "".join(f" JOIN edges e{k} ON e{k}.frame = n.frame AND e{k}.dst = n.id AND e{k}.dir6 = '{way}' JOIN ({ref}) r{k} ON r{k}.frame = n.frame AND r{k}.id = e{k}.src" for k, (ref, way) in enumerate(seen))
    where = [f"n.{c} = '{v}'" for c, v in (("type", type), ("status", status)) if v]
    return f"SELECT DISTINCT n.frame, n.id, n.type, n.status, n.x, n.y, n.vx, n.vy, n.yaw, n.height FROM nodes n{joins}{' WHERE ' + ' AND '.join(where) if where else ''}"


# What the catalogue's template is filled with: cars, moving, to the front; trucks, parked, to the back; a car and a pedestrian as anchors, a bus as own vehicle, a trailer and a pedestrian as single nodes.
_CAR, _BUS, _PED = _of("car"), _of("bus"), _of("pedestrian")
_EGO, _REF, _TWO = (_BUS, "front"), (_CAR, "front"), (_PED, "back")
_BY_EGO, _BY_REF, _BY_BOTH = _of("car", None, _EGO), _of("car", None, _REF), _of("car", None, _REF, _TWO)
_ANY_EGO, _ANY_REF, _ANY_BOTH = _of(None, None, _EGO), _of(None, None, _REF), _of(None, None, _REF, _TWO)
_MIDDLE = (_of("truck", None, _REF), "back")
_CHAIN, _ONE = _of("car", None, _MIDDLE), _of("trailer")
_SECOND = _of("truck", None, (_CAR, "back"))
_MOVING, _PARKED = _of(None, "moving"), _of(None, "parked")

_DIST, _SPEED = "sqrt(x * x + y * y)", "sqrt(vx * vx + vy * vy)"
_OFF = "abs(((yaw - degrees(atan2(-y, -x)) + 180) % 360 + 360) % 360 - 180)"
_NEAR, _FACING, _AWAY, _COMING = f"{_DIST} <= 8", f"{_OFF} <= 45", f"{_OFF} >= 135", "-(x * vx + y * vy) > 0"
_HEADING = f"CASE WHEN {_FACING} THEN 'facing_ego' WHEN {_AWAY} THEN 'away_from_ego' ELSE 'sideways' END"
_WAY = f"CASE WHEN {_SPEED} < 0.5 THEN 'stopped' ELSE (['front','front left','back left','back','back right','front right'])[((ceil(((degrees(atan2(vy, vx)) + 30 + 360) % 360) / 60))::INT + 5) % 6 + 1] END"


def _each(value: str, of: str, where: str = "") -> str:
    """An aggregate over the nodes of each frame."""
    return f"SELECT f.frame, {value} AS answer FROM frames f LEFT JOIN (SELECT * FROM ({of}){' WHERE ' + where if where else ''}) m ON m.frame = f.frame GROUP BY 1"


def _yes(condition: str, source: str) -> str:
    return f"SELECT frame, CASE WHEN {condition} THEN 'yes' ELSE 'no' END AS answer FROM ({source})"


def _exists(of: str, where: str = "") -> str:
    return _yes("answer > 0", _each("count(id)", of, where))


def _count(of: str, where: str = "") -> str:
    return _each("count(DISTINCT id)::VARCHAR", of, where)


def _first(of: str, value: str = "status", order: str = "id") -> str:
    return _each(f"arg_min({value}, {order})", of)


def _extreme(of: str, value: str, order: str) -> str:
    """A value of the first node by an order, ties by id."""
    return f"SELECT f.frame, m.answer FROM frames f LEFT JOIN (SELECT frame, {value} AS answer FROM ({of}) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY {order}, id) = 1) m ON m.frame = f.frame"


def _pair(a: str, b: str, answer: str) -> str:
    return f"SELECT p.frame, {answer} AS answer FROM ({a}) p JOIN ({b}) q ON p.frame = q.frame"


def _equal(a: str, b: str) -> str:
    return _pair(a, b, "CASE WHEN p.answer = q.answer THEN 'yes' WHEN p.answer <> q.answer THEN 'no' END")


def _more(a: str, b: str, which: bool) -> str:
    return _pair(_each("count(DISTINCT id)", a), _each("count(DISTINCT id)", b), "CASE WHEN q.answer > p.answer THEN 'second' ELSE 'first' END" if which else "CASE WHEN p.answer > q.answer THEN 'yes' ELSE 'no' END")


def _two(value: str, which: bool, less: bool, a: str = _ONE, b: str = _PED) -> str:
    sign = "<" if less else ">"
    answer = f"CASE WHEN q.answer {sign} p.answer THEN 'second' ELSE 'first' END" if which else f"CASE WHEN p.answer {sign} q.answer THEN 'yes' ELSE 'no' END"
    return _pair(_first(a, value), _first(b, value), f"CASE WHEN p.answer IS NOT NULL AND q.answer IS NOT NULL THEN {answer} END")


def _agree(value: str) -> str:
    return _yes("answer > 0", f"SELECT f.frame, count(a.id) AS answer FROM frames f LEFT JOIN (SELECT a.frame, a.id FROM ({_ONE}) a JOIN ({_PED}) b ON a.frame = b.frame AND a.{value} = b.{value} AND a.id <> b.id) a ON a.frame = f.frame GROUP BY 1")


def _same(value: str, type: str | None = None) -> str:
    """Over the other nodes of the status of the first car."""
    kind = f" AND n.type = '{type}'" if type else ""
    return f"SELECT f.frame, {value} AS answer FROM frames f LEFT JOIN (SELECT frame, min(id) AS rid, arg_min(status, id) AS rs FROM nodes WHERE type = 'car' GROUP BY 1) r ON r.frame = f.frame LEFT JOIN nodes n ON n.frame = f.frame AND n.status = rs AND n.id <> rid{kind} GROUP BY 1"


def _direction(a: str, b: str) -> str:
    return f"SELECT p.frame, e.dir6 AS answer FROM ({_each('min(id)', a)}) p JOIN ({_each('min(id)', b)}) q ON p.frame = q.frame LEFT JOIN edges e ON e.frame = p.frame AND e.src = p.answer AND e.dst = q.answer"


def _text(value: str, digits: int = 4) -> str:
    return f"round({value}, {digits})::VARCHAR"


MEANINGS = {
    "existence": {
        "exists_type": _exists(_CAR), "exists_status_type": _exists(_of("car", "moving")), "exists_any": _exists(_of()), "exists_direction_from_ego": _exists(_BY_EGO), "exists_direction_from_ref": _exists(_BY_REF), "exists_status_direction_from_ego": _exists(_of("car", "moving", _EGO)),
        "exists_status_direction_from_ref": _exists(_of("car", "moving", _REF)), "exists_any_direction_from_ego": _exists(_ANY_EGO), "exists_converge_pivot": _exists(_BY_BOTH), "exists_converge_pivot_any": _exists(_ANY_BOTH), "exists_diverge_direction": _exists(_BY_REF),
        "exists_facing_ego_in_direction": _exists(_BY_EGO, _FACING), "exists_facing_away_in_direction": _exists(_BY_EGO, _AWAY), "exists_within_distance": _exists(_CAR, _NEAR), "exists_within_distance_direction": _exists(_BY_EGO, _NEAR), "exists_2hop_chain": _exists(_CHAIN),
        "exists_2hop_chain_status": _exists(_of("car", "moving", _MIDDLE)), "exists_2hop_chain_heading": _exists(_CHAIN, _FACING), "exists_both_directions": _exists(_BY_BOTH), "exists_any_both_directions": _exists(_ANY_BOTH), "exists_same_status_another": _yes("answer > 0", _same("count(n.id)", "car")),
        "exists_approaching_direction": _exists(_BY_EGO, _COMING),
    },
    "counts": {
        "count_type": _count(_CAR), "count_status_type": _count(_of("car", "moving")), "count_all_objects": _count(_of()), "count_distinct_types": _each("count(DISTINCT type)::VARCHAR", _of()), "count_direction_from_ego": _count(_BY_EGO), "count_direction_from_ref": _count(_BY_REF),
        "count_any_direction_from_ego": _count(_ANY_EGO), "count_status_direction_from_ego": _count(_of("car", "moving", _EGO)), "count_status_any_direction_from_ego": _count(_of(None, "moving", _EGO)), "count_converge_pivot": _count(_BY_BOTH), "count_diverge_direction": _count(_BY_REF),
        "count_within_distance": _count(_CAR, _NEAR), "count_within_distance_direction": _count(_BY_EGO, _NEAR), "count_status_within_distance": _count(_of("car", "moving"), _NEAR), "count_both_directions": _count(_BY_BOTH), "count_same_status": _same("count(n.id)::VARCHAR", "car"),
        "count_same_status_any": _same("count(n.id)::VARCHAR"), "count_approaching": _count(_CAR, _COMING),
    },
    "status": {
        "node_status_by_type": _first(_CAR), "node_status_by_id": _first(_ONE), "status_direction_from_ego": _first(_BY_EGO), "status_direction_from_ref": _first(_BY_REF), "status_converge_pivot": _first(_BY_BOTH), "status_diverge_direction": _first(_BY_REF),
        "status_nearest_direction": _extreme(_ANY_EGO, "status", _DIST), "status_of_nearest": _extreme(_CAR, "status", _DIST), "status_2hop_chain": _first(_CHAIN), "status_both_directions": _first(_BY_BOTH), "what_status_both_directions": _first(_ANY_BOTH),
        "common_status_near_ref": _each("CASE WHEN min(status) = max(status) THEN min(status) END", _ANY_REF), "shared_status_same_type": _each("CASE WHEN min(status) = max(status) THEN min(status) END", _CAR),
    },
    "objects": {
        "what_is_status_type": _first(_MOVING, "type"), "what_is_status_thing": _first(_MOVING, "type"), "list_all_types": _each("string_agg(DISTINCT type, '|' ORDER BY type)", _of()), "what_direction_from_ego": _first(_ANY_EGO, "type"), "what_thing_direction_from_ego": _first(_ANY_EGO, "type"),
        "what_direction_from_ref": _first(_ANY_REF, "type"), "what_converge_pivot": _first(_ANY_BOTH, "type"), "what_diverge_direction": _first(_ANY_REF, "type"), "nearest_of_type": _extreme(_CAR, "id::VARCHAR", _DIST), "nearest_in_direction": _extreme(_ANY_EGO, "id::VARCHAR", _DIST),
        "farthest_of_type": _extreme(_CAR, "id::VARCHAR", f"{_DIST} DESC"), "what_2hop_chain": _first(_of(None, None, _MIDDLE), "type"), "what_both_directions": _first(_ANY_BOTH, "type"), "what_same_status_other": _same("arg_min(n.type, n.id)"),
        "fastest_of_type": _extreme(_CAR, "id::VARCHAR", f"{_SPEED} DESC"), "largest_of_type": _extreme(_CAR, "id::VARCHAR", "height DESC"), "smallest_of_type": _extreme(_CAR, "id::VARCHAR", "height"),
    },
    "comparisons": {
        "compare_status_two": _agree("status"), "compare_type_two": _agree("type"), "compare_count_two_types": _more(_CAR, _of("truck"), False), "compare_count_two_types_which": _more(_CAR, _of("truck"), True), "compare_count_two_statuses": _more(_MOVING, _PARKED, False),
        "compare_count_two_statuses_which": _more(_MOVING, _PARKED, True), "compare_direction_ref_vs_id": _equal(_first(_ANY_REF), _first(_ONE)), "compare_id_vs_direction_ref": _equal(_first(_ONE), _first(_ANY_REF)), "compare_direction_ego_vs_id": _equal(_first(_ANY_EGO), _first(_ONE)),
        "compare_ego_dir_vs_ref_dir": _equal(_first(_ANY_EGO), _first(_ANY_REF)), "compare_two_direction_refs": _equal(_first(_ANY_REF), _first(_of(None, None, _TWO))), "compare_diverge_status": _equal(_first(_BY_REF), _first(_SECOND)), "compare_diverge_distance": _two(_DIST, False, True, _BY_REF, _SECOND),
        "compare_distance_two_ids": _two(_DIST, False, True), "compare_distance_two_ids_which": _two(_DIST, True, True), "compare_nearest_farthest_status": _equal(_extreme(_CAR, "status", _DIST), _extreme(_CAR, "status", f"{_DIST} DESC")), "compare_speed_two_ids": _two(_SPEED, False, False),
        "compare_speed_two_ids_which": _two(_SPEED, True, False), "compare_size_two": _two("height", False, False), "compare_size_two_which": _two("height", True, False),
    },
    "checks": {
        "verify_status_by_id": _yes("answer = 'moving'", _first(_ONE)), "verify_status_by_type": _yes("answer = 'moving'", _first(_CAR)), "is_facing_ego": _exists(_ONE, _FACING), "is_facing_away": _exists(_ONE, _AWAY), "heading_of_id": _first(_ONE, _HEADING), "is_facing_ego_direction": _exists(_ANY_EGO, _FACING),
        "is_facing_ego_ref_direction": _exists(_ANY_REF, _FACING), "heading_of_direction_obj": _first(_ANY_EGO, _HEADING), "heading_2hop_chain": _exists(_CHAIN, _FACING), "heading_2hop_chain_query": _first(_CHAIN, _HEADING), "direction_of_id_from_ego": _direction(_BUS, _ONE), "direction_of_id_from_ref": _direction(_CAR, _ONE),
        "is_approaching_direction": _exists(_ANY_EGO, _COMING), "is_approaching_id": _exists(_ONE, _COMING), "moving_direction_of_id": _first(_ONE, _WAY), "distance_to_nearest_type": _each(_text(f"min({_DIST})"), _CAR), "distance_to_obj_id": _first(_ONE, _text(_DIST)), "speed_of_obj": _first(_ONE, _text(_SPEED)), "speed_of_type": _first(_CAR, _text(_SPEED)),
    },
}


def _family(name: str):
    def ask(spark, sf_dir) -> DataFrame:
        """kind, frame, answer for every kind of the family."""
        n = durable(graph.spread(nodes_of(spark, sf_dir).drop("vec"), "frame"), "nodes")
        e = durable(graph.build_edges(n, REACH).select("frame", "src", "dst", "dir6", "dist"), "edges")
        each = [kinds.answer(k, n, e, ASK).select(F.lit(k).alias("kind"), "frame", "answer") for k in MEANINGS[name]]
        return reduce(DataFrame.unionByName, each)

    ask.__name__ = f"kinds_{name}"
    return ask


QUERIES = {f.__name__: f for f in map(_family, MEANINGS)}
ORACLE = {f"kinds_{name}": f"WITH {EDGES}{_FRAMES} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, frame, answer FROM ({sql})" for k, sql in of.items()) for name, of in MEANINGS.items()}
