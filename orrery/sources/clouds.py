"""Point clouds and their labels from binary files: radar records whose layout the header states, close points, label arrays."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a radar return, and the states that are kept.
RADAR_FIELDS = ("x", "y", "z", "dyn_prop", "id", "rcs", "vx", "vy", "vx_comp", "vy_comp", "is_quality_valid", "ambig_state", "x_rms", "y_rms", "invalid_state", "pdh0", "vx_rms", "vy_rms")
INVALID_STATES, DYNAMIC_STATES, AMBIGUOUS_STATES = (0,), (0, 1, 2, 3, 4, 5, 6), (3,)
#: Letters of the header's types, for numpy.
KINDS = {"F": "f", "I": "i", "U": "u"}


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole files, through Spark's reader."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parsed_cloud(content: bytes) -> np.ndarray:
    """The records of one file as a structured array; a file whose first record holds a NaN has none."""
    head = re.match(rb"(?s)(.*?\n?DATA +(\S+)[^\n]*\n)", content)
    if head is None:
        raise ValueError("the header of a point file has no DATA line")
    said = {w[0]: w[1:] for w in (line.split() for line in head[1].decode().splitlines()) if w}
    if said["DATA"] != ["binary"] or said["HEIGHT"] != ["1"] or set(said.get("COUNT", ["1"])) != {"1"}:
        raise ValueError("only binary point files of one row with single values are read")
    kind = np.dtype([(n, f"<{KINDS[t]}{s}") for n, t, s in zip(said["FIELDS"], said["TYPE"], said["SIZE"], strict=True)])
    n = int(said["WIDTH"][0])
    body = content[head.end() :]
    if len(body) < n * kind.itemsize:
        raise ValueError(f"a point file holds fewer than the {n} records that its header states")
    points = np.frombuffer(body, kind, n)
    return points[:0] if n and any(np.isnan(points[0][f]) for f in kind.names if kind[f].kind == "f") else points


def read_radar(spark: SparkSession, path: str) -> DataFrame:
    """path, k and a double column for each radar field (null where a file has none), a row for each return. One file is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                points = parsed_cloud(content.as_py())
                n = len(points)
                fields = [pa.array(points[f].astype(float)) if f in points.dtype.names else pa.nulls(n, pa.float64()) for f in RADAR_FIELDS]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *fields], names=["path", "k", *RADAR_FIELDS])

    return _files(spark, path).mapInArrow(run, "path string, k int, " + ", ".join(f"`{f}` double" for f in RADAR_FIELDS))


def kept_returns(points: DataFrame, invalid: tuple[int, ...] = INVALID_STATES, dynamic: tuple[int, ...] = DYNAMIC_STATES, ambiguous: tuple[int, ...] = AMBIGUOUS_STATES) -> DataFrame:
    """Radar returns whose states are among those given."""
    return points.where(F.col("invalid_state").isin(list(invalid)) & F.col("dyn_prop").isin(list(dynamic)) & F.col("ambig_state").isin(list(ambiguous)))


def without_close(points: DataFrame, radius: float) -> DataFrame:
    """Points that are not within ``radius`` of the origin in both x and y."""
    return points.where(~((F.abs("x") < radius) & (F.abs("y") < radius)))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, k, label: a byte for each point from raw files, or the array ``data`` of .npz files; :func:`panoptic_parts` splits the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = content.as_py()
                labels = np.load(io.BytesIO(raw))["data"].ravel() if name.endswith(".npz") else np.frombuffer(raw, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(labels), pa.string()), pa.array(np.arange(len(labels), dtype=np.int32)), pa.array(labels.astype(np.int32))], names=["path", "k", "label"])

    return _files(spark, path).mapInArrow(run, "path string, k int, label int")


def panoptic_parts(labels: DataFrame, base: int = 1000) -> DataFrame:
    """``labels`` with class and instance of a panoptic label: class times ``base`` plus instance."""
    return labels.withColumns({"class": F.expr(f"label div {base}").cast("int"), "instance": (F.col("label") % base).cast("int")})
