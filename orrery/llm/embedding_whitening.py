"""Whitening of embeddings by hierarchical merging of singular value decompositions (operator 11).

Every task reduces its vectors to their number, their exact sums and all singular values with right singular vectors of the centred
rows: a square of the dimension at most, however many rows it read. Two such states merge without loss: the scaled singular vectors
of both stand above each other with one more row, the difference of the means times sqrt(n1 n2 / (n1 + n2)), and are decomposed again. Spark
merges FAN states a task, level by level, each level written as a table; no task or driver sees more than FAN states at once. All dimensions are kept, so
the last state has the covariance's eigenvectors, and its eigenvalues as squares of singular values over n.

Vectors are taken in fixed point, x = floor(256 c), and each distinct x counts once, so copies of a vector have no weight.

Defined cases: rows whose vector is null, or holds a null or non-finite entry, are left out; so are rows that are not as long as most
distinct vectors are (the longer of two equally frequent lengths), as one basis has one dimension; components without variance
(a constant dimension, fewer distinct vectors than dimensions) do not exist, so a table of one distinct vector or none gives an empty result; null ids and repeated rows are
kept, each row with its own result; other columns, whatever their names, are ignored by :func:`whitening_report`. Entries beyond
2**54 in size do not fit the fixed point and count as non-finite. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh

#: States that one task merges.
FAN = 16
#: Steps of the fixed point.
STEPS = 256


@dataclass(frozen=True)
class State:
    """n rows, their exact sums, and scaled right singular vectors of the centred rows (rows of ``axes``; rank x dimension)."""

    n: int
    sums: np.ndarray
    axes: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @staticmethod
    def of(x: np.ndarray) -> State:
        sums = x.sum(axis=0)
        return State(len(x), sums, _decomposed(x - sums / len(x)))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        bridge = np.sqrt(self.n * (other.n / n)) * (self.mean - other.mean)
        return State(n, self.sums + other.sums, _decomposed(np.vstack([self.axes, other.axes, bridge])))


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Rows with the same sums of products, at most as many as there are columns: singular values times vectors, largest first."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")  # has the same singular values and vectors, and is square
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values[:, None] * vectors


@dataclass(frozen=True)
class Whitening:
    """What maps a vector x to its whitened coordinates: (x - sums / n) projected on unit components (rows), over the root of their eigenvalues."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def fixed_point(vector: Column) -> Column:
    """array<bigint>, floor(256 c) of each entry; null for a null vector or one with a null or non-finite entry."""
    # an entry that is null makes the comparison null, which forall does not take for true
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 54), F.lit(False)))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("bigint")))


def with_fixed_point(rows: DataFrame, vector_col: str, name: str) -> DataFrame:
    """``rows`` with a sound vector, with it in fixed point as the column ``name``."""
    return rows.withColumn(name, fixed_point(F.col(f"`{vector_col}`"))).where(F.col(name).isNotNull())


def distinct_vectors(vectors: DataFrame, name: str) -> DataFrame:
    """x: each vector of the column ``name`` once, all of the most frequent length; written, as several passes read it."""
    once = durable(vectors.select(F.col(name).alias("x")).distinct(), "vectors")
    most = once.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return once.where(F.size("x") == (most[0]["size"] if most else 0))


STATE = "part bigint, n bigint, sums array<bigint>, axes array<double>"


def _packed(part: int, state: State) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([state.n]), pa.array([state.sums.tolist()], pa.list_(pa.int64())), pa.array([state.axes.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "n", "sums", "axes"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for b in batches:
        if b.num_rows:
            new = State.of(_matrix(b.column("x")))
            state = new if state is None else state.merged(new)
    if state is not None:
        yield _packed(TaskContext.get().partitionId(), state)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    states = [State(int(n), np.array(s, np.int64), np.array(a, float).reshape(-1, len(s))) for n, s, a in zip(rows["n"], rows["sums"], rows["axes"], strict=True)]
    all_ = states[0]
    for s in states[1:]:
        all_ = all_.merged(s)
    return pd.DataFrame({"part": [int(rows["part"].min()) // FAN], "n": [all_.n], "sums": [all_.sums], "axes": [all_.axes.ravel()]})


def fit_whitening(vectors: DataFrame) -> Whitening | None:
    """All components with variance of the column ``x`` (array<bigint>, one length), by falling eigenvalue; None without any."""
    states = durable(vectors.select("x").where(F.size("x") > 0).mapInArrow(_states, STATE), "states")
    parts = states.agg(F.max("part")).first()[0]
    while parts:
        merged = states.groupBy((F.col("part") / FAN).cast("bigint").alias("group")).applyInPandas(_merge, STATE)
        states, parts = durable(merged, "states"), parts // FAN
    last = states.first()  # one row of dimension x dimension numbers
    if last is None:
        return None
    sums = np.array(last["sums"], np.int64)
    axes = np.array(last["axes"], float).reshape(-1, len(sums))
    size = np.linalg.norm(axes, axis=1)
    kept = np.flatnonzero(size > size.max(initial=0) * len(sums) * np.finfo(float).eps)
    if not len(kept):
        return None
    kept = kept[np.argsort(-size[kept], kind="stable")]
    return Whitening(int(last["n"]), sums, axes[kept] / size[kept, None], size[kept] ** 2 / last["n"], float((size**2).sum() / last["n"]))


def whiten(rows: DataFrame, name: str, model: Whitening, components: int, out: str = "whitened", deviation: str | None = None) -> DataFrame:
    """``rows`` whose vector ``name`` has the model's dimension, with array<double> ``out``: the first coordinates; with ``deviation``, also the exact sum of (n x - sums)^2."""
    d, k = len(model.sums), min(components, len(model.eigenvalues))
    weights = Whitening(model.n, model.sums, model.components[:k], model.eigenvalues[:k], model.trace)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(name))
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k), pa.int32()), pa.array(weights.transform(x).ravel()))
            columns, names = [*b.columns, w], [*b.schema.names, out]
            if deviation:
                rough = weights.n * x.astype(float) - weights.sums
                fits = (rough**2).sum(axis=1) < 9.2e18
                exact = np.zeros(len(x), np.int64)
                exact[fits] = ((weights.n * x[fits] - weights.sums) ** 2).sum(axis=1)
                columns.append(pa.array(exact, mask=~fits))
                names.append(deviation)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType())), *([T.StructField(deviation, T.LongType())] if deviation else [])])
    return rows.where(F.size(name) == d).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, components: int, name: str = "whitened") -> float:
    """The largest absolute entry of the covariance of ``name`` minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components + 1))
        for b in batches:
            if b.num_rows:
                w = _matrix(b.column(name))
                one = np.hstack([np.ones((len(w), 1)), w])
                total += one.T @ one
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = whitened.select(name).mapInArrow(run, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((components + 1, components + 1))
    for r in sums:
        total[r["i"], r["j"]] = r["s"]
    mean = total[0, 1:] / total[0, 0]
    return float(np.abs(total[1:, 1:] / total[0, 0] - np.outer(mean, mean) - np.eye(components)).max())


def whitening_report(rows: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each sound row and component."""
    name = fresh(rows.select(id_col), "x")
    vectors = with_fixed_point(rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), "v", name).drop("v")
    once = distinct_vectors(vectors, name)
    model = fit_whitening(once)
    schema = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema.format(vectors.schema["vec_id"].dataType.simpleString()))
    k = min(components, len(model.eigenvalues))
    error = identity_error(whiten(once, "x", model, k), k)
    done = whiten(vectors, name, model, k, "coordinates", "deviation")
    shares = F.from_json(F.lit(json.dumps((model.eigenvalues[:k] / model.trace).tolist())), "array<double>")
    each = done.select("vec_id", "deviation", F.posexplode("coordinates").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
