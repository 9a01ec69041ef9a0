"""Quality classification by hierarchical empirical Bayes (operator 8).

A logistic regression on text-shape features gives each document its evidence, trained on a bounded sample of the labelled rows (``sample``
of them, chosen by a hash of the id). Grouped aggregation over all documents then gives every host and every path a posterior
quality: the host's mean is shrunk towards the global mean, the path's towards its host's, with a prior strength estimated from the spread between
groups (method of moments), so sparse sites keep the prior and large ones speak for themselves. A document's final log odds are
its evidence plus the shift of its path's posterior from the global mean.

Here a document's host is its ``source`` and its path is source and ``lang``.

Defined cases: null text equals the empty text, which has the features of a text without words; null host or path parts count as empty names; labels with nulls are
left out, of repeated labels of one id one counts; without labels of both kinds every document keeps even odds and is kept; repeated rows and null ids are
rows of their own; an empty table gives an empty result. Very long texts are read in full, block by block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, plain_text

#: Words of a block: distinct words are counted by block, as their share falls with length.
BLOCK = 200
FEATURES = ("log_words", "word_bytes", "upper", "digit", "ascii_mark", "mark_in_word", "bars", "distinct", "top_share", "line_words", "repeated_lines", "short_words", "stops")


def features(text: bytes) -> list[float]:
    """Shape of a text; shares are taken of its bytes, words or lines."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    lower = text.lower().split()
    blocks = [lower[i : i + BLOCK] for i in range(0, len(lower), BLOCK)] or [[b""]]
    counted = [Counter(b) for b in blocks]
    distinct = sum(len(c) * len(b) ** 0.2 for b, c in zip(blocks, counted, strict=True)) / n
    top = sum(max(c.values()) if len(b) > 4 else 1 for b, c in zip(blocks, counted, strict=True)) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    mark = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    odd = mark - counts[[33, 39, 44, 45, 46, 58, 59, 63]].sum()
    return [
        float(np.log1p(len(words))), (size - counts[[9, 10, 13, 32]].sum()) / n, counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / size, mark / n,
        odd / n, counts[124] / n, distinct, top, len(words) / max(len(lines), 1) / 50, 1 - len(set(lines)) / max(len(lines), 1), sum(len(w) < 4 for w in words) / n, (counts[33] + counts[46]) / n,
    ]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights) from at most ``sample`` labelled documents, so the labels joined by broadcast are bounded."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("label_id"), "quality")
    rows = docs.select(F.col(id_col).alias("id"), plain_text(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.float64()), pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.select("quality", "text").mapInArrow(run, "y double, x array<double>").collect()
    y, x = np.array([r.y for r in got]), np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    if len(set(y.tolist())) < 2:
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return mean, scale, _logistic(np.clip((x - mean) / scale, -8, 8), (y > 0).astype(float))


def add_evidence(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the evidence of each text, a log odds, in ``column``."""
    mean, scale, w = model
    text = fresh(docs, "utf8_text")
    rows = docs.withColumn(text, plain_text(text_col).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(b.num_columns - 1).to_pylist()]).reshape(-1, len(mean))
            odds = np.clip(np.clip((x - mean) / scale, -8, 8) @ w[:-1] + w[-1], -12, 12)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(odds, pa.float64())], names=[*b.schema.names[:-1], column])

    schema = docs.schema.add(column, "double")
    return rows.mapInArrow(run, schema)


def _beta(groups: DataFrame, mean: str) -> Column:
    """Prior strength over a table of groups (n, s: rows and sum of probabilities; mean: the prior mean column): within over between variance, 1 to 1000."""
    between = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)) / F.sum("n")
    within = F.sum("v") / F.sum("n")
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), within / F.greatest(between, F.lit(1e-9))))


def path_posteriors(scored: DataFrame, host: str, path: str, odds: str) -> DataFrame:
    """host, path, shift: the log odds by which documents of a path differ from all, shrunk by host and by path.

    ``shift`` is bounded by the prior: the rows of one group are summed before the shuffle, whatever its share of all rows.
    """
    p = 1 / (1 + F.exp(-F.col(odds)))
    by_path = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    by_path = durable(by_path.withColumn("v", F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))), "paths")
    total = by_path.agg(F.sum("n"), F.sum("s")).first()
    mu = (total[1] or 0.0) / total[0] if total[0] else 0.5
    mu = min(1 - 1e-6, max(1e-6, mu))
    hosts = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).withColumn("v", F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).withColumn("mu", F.lit(mu))
    k_host = hosts.agg(_beta(hosts, "mu")).first()[0] or 1.0
    hosts = hosts.select(F.col("host").alias("h"), ((k_host * mu + F.col("s")) / (k_host + F.col("n"))).alias("host_mean"))
    both = by_path.join(hosts, F.col("host") == F.col("h")).drop("h")
    k_path = both.agg(_beta(both, "host_mean")).first()[0] or 1.0
    post = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (k_path * F.col("host_mean") + F.col("s")) / (k_path + F.col("n"))))
    return both.select("host", "path", F.col("host_mean").alias("host_posterior"), post.alias("path_posterior"), (F.log(post / (1 - post)) - F.lit(float(np.log(mu / (1 - mu))))).alias("shift"))


def _judged(scored: DataFrame, host: str, path: str, odds: str, threshold: float) -> DataFrame:
    sites = path_posteriors(scored, host, path, odds)
    sites = sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "host_posterior", "path_posterior", "shift")
    met = scored.join(sites, (F.col(host) == sites.site_host) & (F.col(path) == sites.site_path))
    score = 1 / (1 + F.exp(-(F.col(odds) + F.col("shift"))))
    return met.withColumn("score", score).withColumn("keep", score >= threshold)


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, evidence (log odds), host_posterior, path_posterior, score, keep of every document."""
    named = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("path"), "text")
    scored = durable(add_evidence(named, fit_quality(docs, labels), "evidence").drop("text"), "evidence")
    return _judged(scored, "host", "path", "evidence", threshold).select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", "keep")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, host_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns. The scored rows are written once, so no text shuffles unless the table of sites is large."""
    host, path, odds = fresh(docs, "site_of"), fresh(docs, "path_of"), fresh(docs, "odds_of")
    named = docs.withColumn(host, F.coalesce(host_col, F.lit(""))).withColumn(path, F.concat_ws("/", F.coalesce(host_col, F.lit("")), F.coalesce(lang_col, F.lit(""))))
    scored = durable(add_evidence(named, fit_quality(docs, labels), odds), "scored")
    sites = durable(path_posteriors(scored, host, path, odds).select(F.col("host").alias(fresh(scored, "site_host")), F.col("path").alias(fresh(scored, "site_path")), F.col("shift").alias(fresh(scored, "site_shift"))), "sites")
    h, p, shift = sites.columns
    met = scored.join(sites, (F.col(host) == F.col(h)) & (F.col(path) == F.col(p)))
    return met.where(1 / (1 + F.exp(-(F.col(odds) + F.col(shift)))) >= threshold).select(*[f"`{c}`" for c in docs.columns])
