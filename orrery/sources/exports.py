"""Boxes and poses in formats of other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G

#: A quarter turn to the right about the vertical axis: from x to the right to x ahead.
QUARTER = (0.7071067811865476, 0.0, 0.0, -0.7071067811865476)


def _turned(q: tuple[float, ...], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    m = G.rotation(*[F.lit(float(v)) for v in q])
    row = lambda k: F.get(m, F.lit(3 * k)) * x + F.get(m, F.lit(3 * k + 1)) * y + F.get(m, F.lit(3 * k + 2)) * z
    return row(0), row(1), row(2)


def _two_digits(v: Column) -> Column:
    """Two significant digits, one decimal place at least."""
    places = F.greatest(F.lit(1), 1 - F.floor(F.log10(F.abs(v))).cast("int"))
    return F.when(v == 0, "0.0").otherwise((F.rint(v * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)).cast("string"))


def label_line(name: Column, x: Column, y: Column, z: Column, width: Column, length: Column, height: Column, heading: Column, to_camera: tuple[float, ...], offset: tuple[float, float, float] = (0.0, 0.0, 0.0), rectified: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0), score: Column | None = None) -> Column:
    """A line of a label file of boxes seen from a camera: name, three unknowns, image box (unknown), height, width, length, bottom centre, turn about the camera's y axis, and a score.

    The box stands in a lidar's frame with x to the right and y ahead (heading in degrees); ``to_camera`` and ``rectified`` are unit quaternions from a lidar's frame with x ahead, ``offset`` is added between them.
    """
    cx, cy, cz = _turned(to_camera, *_turned(QUARTER, x, y, z))
    cx, cy, cz = _turned(rectified, *(c + o for c, o in zip((cx, cy, cz), offset, strict=True)))
    turn = F.radians(heading)
    vx, _, vz = _turned(rectified, *_turned(to_camera, *_turned(QUARTER, F.cos(turn), F.sin(turn), F.lit(0.0))))
    cells = [F.format_string("%.2f", c) for c in (width, length, cx, cy + height / 2, cz, -F.atan2(vz, vx))]
    line = F.concat_ws(" ", name, F.lit("-1.00 -1 -10.00 -1.00 -1.00 -1.00 -1.00"), _two_digits(height), *cells)
    return line if score is None else F.concat(line, F.when(score.isNotNull() & ~F.isnan(score), F.format_string(" %.4f", score)).otherwise(""))


def pose_places(poses: DataFrame, lat: float, lon: float, every: int = 1) -> DataFrame:
    """scene, timestamp, latitude, longitude of every ``every``-th pose (scene, timestamp, ordinal, x, y in metres east and north of the given place)."""
    at = poses.where(F.pmod("ordinal", F.lit(every)) == 0) if every > 1 else poses
    way = G.distance(F.col("x"), F.col("y"))
    there = G.destination(F.lit(lat), F.lit(lon), G.north_bearing(F.col("x"), F.col("y")), way)
    return at.select("scene", "timestamp", there[0].alias("latitude"), there[1].alias("longitude"))
