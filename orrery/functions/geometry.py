"""Angles, directions, distances and boxes as column expressions; angles are degrees unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Direction words by convention, from the first sector on.
DIR4 = ("front", "left", "back", "right")
DIR8 = ("front", "front_left", "left", "back_left", "back", "back_right", "right", "front_right")
DIR6 = ("front", "front left", "back left", "back", "back right", "front right")
#: Overlapping sectors (centre, half width) of the loose match.
LOOSE = {"front": (0, 90), "left": (90, 90), "back": (180, 90), "right": (-90, 90), "front_left": (45, 45), "back_left": (135, 45), "back_right": (-135, 45), "front_right": (-45, 45)}


def wrap(angle: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def wrap_closed(angle: Column) -> Column:
    """To (-180, 180]."""
    w = wrap(angle)
    return F.when(w == -180.0, F.lit(180.0)).otherwise(w)


def yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Heading of a unit quaternion, in degrees."""
    return F.degrees(F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z)))


def bearing(dx: Column, dy: Column, heading: Column | float = 0.0) -> Column:
    """Direction of an offset, seen from a heading; counter-clockwise is positive."""
    return wrap(F.degrees(F.atan2(dy, dx)) - heading)


def north_bearing(dx: Column, dy: Column) -> Column:
    """Clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _sector(angle: Column, names: tuple[str, ...]) -> Column:
    width = 360.0 / len(names)
    k = F.floor(F.pmod(angle + width / 2, F.lit(360.0)) / width).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), k + 1)


def dir4(angle: Column) -> Column:
    """90 degree sectors, closed below and open above."""
    return _sector(angle, DIR4)


def dir8(angle: Column) -> Column:
    """45 degree sectors, closed below and open above."""
    return _sector(angle, DIR8)


def dir6(angle: Column, margin: float = 0.0) -> Column:
    """60 degree sectors, open below and closed above; null within ``margin`` of an edge."""
    a = F.pmod(angle + 30.0, F.lit(360.0))
    k = F.pmod(F.ceil(a / 60.0).cast("int") - 1, F.lit(6))
    name = F.element_at(F.array(*[F.lit(n) for n in DIR6]), k + 1)
    if not margin:
        return name
    off = F.pmod(a, F.lit(60.0))
    return F.when((off >= margin) & (off <= 60.0 - margin), name)


def sector8(angle: Column) -> Column:
    """45 degree sectors of which the upper edge is closed."""
    a = F.pmod(angle + 22.5, F.lit(360.0))
    k = F.pmod(F.ceil(a / 45.0).cast("int") - 1, F.lit(8))
    return F.element_at(F.array(*[F.lit(n) for n in DIR8]), k + 1)


def loose_directions(angle: Column) -> Column:
    """All direction words whose overlapping range holds the angle (inclusive)."""
    hits = [F.when(F.abs(wrap(angle - float(c))) <= float(h), F.lit(n)) for n, (c, h) in LOOSE.items()]
    return F.array_compact(F.array(*hits))


def distance_level(d: Column) -> Column:
    """near up to 10, mid up to 25, else far."""
    return F.when(d <= 10, "near").when(d <= 25, "mid").otherwise("far")


def distance_class(d: Column) -> Column:
    """very_close below 2, close below 10, medium below 30, else far."""
    return F.when(d < 2, "very_close").when(d < 10, "close").when(d < 30, "medium").otherwise("far")


def safety_bin(d: Column, edges: tuple[float, ...] = (2, 5, 10, 15, 20, 30, 50)) -> Column:
    """Index of the first edge that is not below the distance; null beyond the last."""
    return reduce(lambda acc, i: F.when(d <= edges[i], F.lit(i)).otherwise(acc), range(len(edges) - 1, -1, -1), F.lit(None).cast("int"))


def angle_difference(a: Column, b: Column, period: float = 360.0) -> Column:
    """Signed difference, half a period at most."""
    return F.pmod(a - b + period / 2, F.lit(period)) - period / 2


def side_of(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column, axis: float = 10.0) -> Column:
    """left or right of the view from a to b; null within ``axis`` degrees of the line."""
    off = bearing(px - ax, py - ay, F.degrees(F.atan2(by - ay, bx - ax)))
    beside = (F.abs(off) > axis) & (F.abs(off) < 180.0 - axis)
    return F.when(beside & (off > 0), "left").when(beside & (off < 0), "right")


def time_to_contact(dx: Column, dy: Column, dvx: Column, dvy: Column, least: float = 0.1) -> Column:
    """Distance over closing speed; null unless both exceed ``least``."""
    d = distance(dx, dy)
    closing = -F.try_divide(dx * dvx + dy * dvy, d)
    return F.when((d > least) & (closing > least), F.try_divide(d, closing))


def scale_iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two aligned boxes with common centre, by their sizes."""
    product = lambda s: reduce(lambda x, y: x * y, s)
    both = product([F.least(x, y) for x, y in zip(a, b, strict=True)])
    return both / (product(a) + product(b) - both)


def relation_type(dx: Column, dy: Column, crossing: Column) -> Column:
    """How an object lies to the viewer's heading (x ahead): intersecting where one of both is in an intersection, else longitudinal within 45 degrees of ahead or behind, or lateral."""
    off = F.abs(F.degrees(F.atan2(dy, dx)))
    return F.when(crossing, "intersecting").when((off <= 45) | (off >= 135), "longitudinal").otherwise("lateral")


def lane_relation(lane: Column, other: Column, dx: Column, dy: Column, relation: Column) -> Column:
    """same, adjacent (lateral, less than 5 aside and 20 along) or apart for two objects on lanes; null where one is on none, or where lanes differ and the relation is not lateral."""
    near = (F.abs(dy) < 5) & (F.abs(dx) < 20)
    return F.when(lane == other, "same").when((lane != other) & (relation == "lateral"), F.when(near, "adjacent").otherwise("apart"))


def is_approaching(x: Column, y: Column, vx: Column, vy: Column) -> Column:
    """Whether an object moves towards the origin."""
    return -(x * vx + y * vy) > 0


def to_local(x: Column, y: Column, ox: Column, oy: Column, heading: Column) -> tuple[Column, Column]:
    """Global coordinates in the frame of a pose."""
    c, s = F.cos(F.radians(heading)), F.sin(F.radians(heading))
    return (x - ox) * c + (y - oy) * s, (y - oy) * c - (x - ox) * s


def to_global(x: Column, y: Column, ox: Column, oy: Column, heading: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(heading)), F.sin(F.radians(heading))
    return x * c - y * s + ox, x * s + y * c + oy


def rotation(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Row-major rotation matrix of a unit quaternion."""
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def point_in_box(px: Column, py: Column, cx: Column, cy: Column, length: Column, width: Column, heading: Column) -> Column:
    """Whether a point lies in a turned rectangle, edges included."""
    u, v = to_local(px, py, cx, cy, heading)
    return (F.abs(u) <= length / 2) & (F.abs(v) <= width / 2)


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting over array<struct<x,y>>, without a repeated last point."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.pmod(i + 1, n) + 1)
        at = p["x"] + (py - p["y"]) * F.try_divide(q["x"] - p["x"], q["y"] - p["y"])
        return F.when(((p["y"] > py) != (q["y"] > py)) & (px < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1


def turned_between(a: Column, b: Column, share: Column) -> Column:
    """Heading at a share of the way from a to b, the shorter way round (spherical interpolation of turns about one axis)."""
    return wrap(a + wrap(b - a) * share)


def slerp(a: Column, b: Column, share: Column) -> Column:
    """Spherical interpolation of unit quaternions (arrays of four), the shorter way round; linear where they nearly agree."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = F.transform(b, lambda x: x * F.when(dot < 0, -1.0).otherwise(1.0))
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    flat = F.abs(dot) > 0.9995
    one = F.when(flat, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * angle), F.sin(angle)))
    two = F.when(flat, share).otherwise(F.try_divide(F.sin(share * angle), F.sin(angle)))
    mixed = F.zip_with(a, near, lambda x, y: x * one + y * two)
    size = F.sqrt(F.aggregate(F.transform(mixed, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.transform(mixed, lambda x: x / size)


def box_corners(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, heading: Column) -> Column:
    """array<struct<x,y,z>>: the eight corners of a box that is turned about the vertical axis."""
    corners = []
    for u, v, w in ((1, 1, 1), (1, -1, 1), (1, -1, -1), (1, 1, -1), (-1, 1, 1), (-1, -1, 1), (-1, -1, -1), (-1, 1, -1)):
        px, py = to_global(length / 2 * u, width / 2 * v, x, y, heading)
        corners.append(F.struct(px.alias("x"), py.alias("y"), (z + height / 2 * w).alias("z")))
    return F.array(*corners)


def view_points(points: Column, focal: float, cx: float, cy: float) -> Column:
    """array<struct<u,v,depth>>: points (z is the optical axis, x to the right, y down) through a pinhole camera."""
    return F.transform(points, lambda p: F.struct((F.try_divide(p["x"], p["z"]) * focal + cx).alias("u"), (F.try_divide(p["y"], p["z"]) * focal + cy).alias("v"), p["z"].alias("depth")))


def box_in_image(corners: Column, width: float, height: float, every: bool = False) -> Column:
    """Whether any (or every) corner (from view_points) is inside the image and more than a metre away, and all are in front of the camera."""
    inside = lambda c: (c["u"] > 0) & (c["u"] < width) & (c["v"] > 0) & (c["v"] < height) & (c["depth"] > 1)
    seen = F.forall(corners, inside) if every else F.exists(corners, inside)
    return F.coalesce(seen, F.lit(False)) & F.forall(corners, lambda c: c["depth"] > 0.1)


def image_box(corners: Column, width: float, height: float) -> Column:
    """struct<u0,v0,u1,v1>: the least upright rectangle of the corners, cut at the image's edges; null outside."""
    us, vs = F.transform(corners, lambda c: c["u"]), F.transform(corners, lambda c: c["v"])
    clip = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(most))
    u0, u1, v0, v1 = clip(F.array_min(us), width), clip(F.array_max(us), width), clip(F.array_min(vs), height), clip(F.array_max(vs), height)
    return F.when((u0 < u1) & (v0 < v1), F.struct(u0.alias("u0"), v0.alias("v0"), u1.alias("u1"), v1.alias("v1")))


def clipped_hull(points: Column, width: float, height: float) -> Column:
    """u0, v0, u1, v1: the extent of what the convex hull of ``points`` (u, v) and the canvas have in common; null where that is nothing.

    Its corners are points on the canvas, crossings of the canvas' edges with segments between points, and corners of the canvas in the hull, which are those in a triangle of points. So no hull need be built;
    and where edges leave the canvas the extent is smaller than the clipped extent of the points (see :func:`image_box`).
    """
    spot = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    on = lambda p: (p["u"] >= 0) & (p["u"] <= width) & (p["v"] >= 0) & (p["v"] <= height)
    # a value with a name is computed once, as the only element of an array
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    later = lambda ps, k: F.slice(ps, k + 2, F.size(ps))
    joined = lambda ps: F.flatten(F.transform(ps, lambda p, i: F.transform(later(ps, i), lambda q, j: F.struct(p.alias("p"), q.alias("q"), (i + j + 1).alias("k")))))

    def crossings(s: Column) -> Column:
        p, q = s["p"], s["q"]
        found = []
        for a, b, edges, last in (("u", "v", (0.0, width), height), ("v", "u", (0.0, height), width)):
            for edge in edges:
                share = F.try_divide(F.lit(edge) - p[a], q[a] - p[a])
                other = p[b] + (q[b] - p[b]) * share
                here = spot(F.lit(edge), other) if a == "u" else spot(other, F.lit(edge))
                found.append(F.when((share >= 0) & (share <= 1) & (other >= 0) & (other <= last), here))
        return F.array(*found)

    side = lambda a, b, c: (b["u"] - a["u"]) * (c["v"] - a["v"]) - (b["v"] - a["v"]) * (c["u"] - a["u"])

    def inside(c: Column, p: Column, q: Column, r: Column) -> Column:
        turns = [side(p, q, c), side(q, r, c), side(r, p, c)]
        return (side(p, q, r) != 0) & ((F.least(*turns) >= 0) | (F.greatest(*turns) <= 0))

    corners = F.array(*[spot(F.lit(u), F.lit(v)) for u in (0.0, width) for v in (0.0, height)])

    def seen(ps: Column, pairs: Column) -> Column:
        # each triangle once
        held = F.filter(corners, lambda c: F.exists(pairs, lambda s: F.exists(later(ps, s["k"]), lambda r: inside(c, s["p"], s["q"], r))))
        return F.concat(F.transform(F.filter(ps, on), lambda p: spot(p["u"], p["v"])), F.filter(F.flatten(F.transform(pairs, crossings)), lambda x: x.isNotNull()), held)

    def extent(spots: Column) -> Column:
        us, vs = F.transform(spots, lambda x: x["u"]), F.transform(spots, lambda x: x["v"])
        return F.when(F.size(spots) > 0, F.struct(F.array_min(us).alias("u0"), F.array_min(vs).alias("v0"), F.array_max(us).alias("u1"), F.array_max(vs).alias("v1")))

    return once(points, lambda ps: once(once(joined(ps), lambda pairs: seen(ps, pairs)), extent))


def destination(lat: Column, lon: Column, bearing_deg: Column, metres: Column, radius: float = 6_378_137.0) -> tuple[Column, Column]:
    """Latitude and longitude (degrees) reached from a place by a bearing (clockwise from north) and a way."""
    d, b, p = metres / radius, F.radians(bearing_deg), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    return F.degrees(q), lon + F.degrees(F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q)))
