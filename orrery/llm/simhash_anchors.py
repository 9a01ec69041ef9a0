"""SimHash near-duplicate detection by anchor-point covering (operator 9).

Fingerprints are 64 majority bits over XXH64 hashes of word shingles. Equal fingerprints are merged first. The anchors are the words of
a covering code: the binary Golay code [23, 12] on bits 0-22 and again on bits 23-45, of which each block has covering radius 3. Every
fingerprint has one home, its nearest code words; it is replicated to every pair of code words within radius plus threshold (the
excess over the radius, summed over both blocks, at most the threshold). Two fingerprints within the threshold then meet at the home of
each, where they are compared by their differing bits. That is exact: no link is lost and none is added. About 61 copies of a distinct fingerprint
result for a threshold of 2, whatever the input. Links join into components by alternating stars.

A run of very many fingerprints at one anchor is not compared pair by pair: each looks up the 2,080 fingerprints within two bits of
it, and only links that join two parts of the run are reported.

Defined cases: null, empty and blank texts have fingerprint zero and link like others; a null ``doc_id`` joins its group, of which the smallest
non-null id is the component; repeated rows are all returned; an empty table gives an empty result; other columns are ignored
by :func:`near_duplicates` and kept by :func:`near_dedup` and :func:`similar_dedup`. Very long texts are hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, perhaps_in, plain_text
from .components import connected_components
from .near_jaccard import similar_links

#: Seed of the shingle hash; generator polynomial, length and covering radius of the Golay code.
SEED = 42
GOLAY, LENGTH, RADIUS = 0b101011100011, 23, 3
#: Shingles hashed at a time, runs compared by shifting, runs compared in blocks of pairs.
SLICE, SMALL, MIDDLE = 65_536, 64, 4_096


def simhash(text: bytes, words: int = 3) -> int:
    """The fingerprint of UTF-8 text: A-Z lower-cased, words between ASCII white space, repeated shingles counted."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SLICE):
        part = w[a : a + SLICE + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp`` (the 64 bits as a bigint)."""
    keep = keep if keep is not None else ["doc_id"]
    out = docs.select(*keep, plain_text(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(fp)], names=[*keep, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1])
    return out.mapInArrow(run, f"{schema}, fp bigint" if schema else "fp bigint")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; viewed as unsigned, as numpy counts the bits of a signed number's magnitude."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator polynomial."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        left ^= np.where(left >> bit & 1, GOLAY << (bit - 11), 0)
    return left


@cache
def _patterns(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight up to radius plus threshold, and how far each exceeds the radius."""
    found = np.array([sum(1 << i for i in c) for k in range(RADIUS + threshold + 1) for c in combinations(range(LENGTH), k)], np.int64)
    over = np.maximum(np.bitwise_count(found).astype(np.int64) - RADIUS, 0)
    syndromes = _syndrome(found)
    order = np.lexsort((over, syndromes))
    counts = np.bincount(syndromes, minlength=2048)
    column = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    table, excess = np.zeros((2048, counts.max()), np.int64), np.full((2048, counts.max()), threshold + 1, np.int64)
    table[syndromes[order], column], excess[syndromes[order], column] = found[order], over[order]
    return table, excess


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fp, home) of every copy of the fingerprints ``fp`` (int64)."""
    table, excess = _patterns(threshold)
    x, y = fp & ((1 << LENGTH) - 1), fp >> LENGTH & ((1 << LENGTH) - 1)
    sx, sy = _syndrome(x), _syndrome(y)
    over = excess[sx][:, :, None] + excess[sy][:, None, :]
    at, i, j = np.nonzero(over <= threshold)
    return (x[at] ^ table[sx[at], i]) << LENGTH | (y[at] ^ table[sy[at], j]), at, over[at, i, j] == 0


def _joined(fp: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between the distinct, sorted fingerprints of one run, as many as it takes to join what they join."""
    parent = np.arange(len(fp))
    links = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: np.ndarray, j: np.ndarray) -> None:
        apart = parent[i] != parent[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            if (ta := top(a)) != (tb := top(b)):
                parent[max(ta, tb)] = min(ta, tb)
                links.append((int(fp[a]), int(fp[b])))

    if len(fp) <= MIDDLE:
        step = max(1, (1 << 20) // len(fp))
        for a in range(0, len(fp), step):
            i, j = np.nonzero(_differing(fp[a : a + step, None], fp[None, :]) <= threshold)
            join(i[i + a < j] + a, j[i + a < j])
    else:
        for k in range(1, threshold + 1):
            for c in combinations(range(64), k):
                other = fp ^ np.uint64(sum(1 << b for b in c)).view(np.int64)
                at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
                i = np.nonzero((fp[at] == other) & (other > fp))[0]
                join(i, at[i])
    return links


def links_at_anchors(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found in whole runs of equal anchors (sorted by anchor, then fingerprint)."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    a, b = [], []
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        if pairs := _joined(fp[s : s + n], threshold):
            a.append(np.array([p[0] for p in pairs], np.int64))
            b.append(np.array([p[1] for p in pairs], np.int64))
    few = np.repeat(sizes <= SMALL, sizes)
    anchor, fp, home = anchor[few], fp[few], home[few]
    for k in range(1, SMALL):
        same = np.flatnonzero(anchor[k:] == anchor[:-k])
        if not len(same):
            break
        met = same[(home[same] | home[same + k]) & (_differing(fp[same], fp[same + k]) <= threshold)]
        a.append(fp[met])
        b.append(fp[met + k])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def fingerprint_links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``distinct`` (column fp) at ``threshold`` bits or fewer; enough of them to join every component."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for s in range(0, len(fp), 4096):
                anchor, at, home = anchors(part := fp[s : s + 4096], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[at]), pa.array(home)], names=["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if parts:
                a, b = links_at_anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)), threshold)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("anchor", "fp", "home")]
            last = int(np.searchsorted(new[0], new[0][-1]))  # the last run may go on in the next batch
            if last or (held and held[0][0][0] != new[0][0]):
                yield from flush([*held, [x[:last] for x in new]] if last else held)
                held = []
            held.append([x[last:] for x in new])
        yield from flush(held)

    copies = distinct.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint, home boolean")
    return copies.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compare, "a bigint, b bigint")


def components_of(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``fps`` that has a link."""
    distinct = durable(fps.select("fp").distinct(), "fingerprints")
    return connected_components(fingerprint_links(distinct, threshold)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) of every document."""
    fps = durable(fingerprints(docs, words), "simhash")
    roots = durable(components_of(fps, threshold), "roots")
    smallest = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp", "left")
    smallest = smallest.withColumn("root", F.coalesce("root", "fp"))
    least = durable(smallest.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    by_fp = durable(smallest.select("fp", "root").join(least, "root").select("fp", "component_id"), "by-fp")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _one_of_each(marked: DataFrame, row_id: str, key: str, groups: DataFrame, columns: list[str]) -> DataFrame:
    """Of the rows of ``marked`` with one root in ``groups`` (key, root; keys that are not there have none), that with the smallest id; of repeated rows, one.

    Only rows of groups, and of texts that occur twice, shuffle; the others stay where they are.
    """
    rows = marked.select(row_id, key)
    repeated = rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key)
    concerned = durable(groups.select(key).unionByName(repeated).distinct(), "concerned")
    flag = fresh(marked, "perhaps_again")
    flagged = perhaps_in(marked, F.col(key), concerned, flag)
    some = flagged.where(flag).select(row_id, key).join(groups, key, "left").groupBy(F.coalesce("root", key).alias("root"))
    order = F.struct(F.col(row_id).isNull(), row_id, key)
    stay = some.agg(F.min_by(F.struct(row_id, key), order).alias("s")).select(F.col(f"s.{row_id}").alias("stay_id"), F.col(f"s.{key}").alias("stay_key"))
    stay = durable(stay, "stay")
    kept = flagged.where(flag).join(stay, F.col(row_id).eqNullSafe(stay.stay_id) & (F.col(key) == stay.stay_key), "left_semi")
    kept = kept.dropDuplicates([row_id, key]) if not rows.groupBy(row_id, key).count().where("count > 1").isEmpty() else kept
    return flagged.where(~F.col(flag)).unionByName(kept).select(*[f"`{c}`" for c in columns])


def near_dedup(docs: DataFrame, words: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of fingerprints within ``threshold`` bits, with all its columns: that with the smallest id (of rows with one id, one)."""
    key, row_id = fresh(docs, "text_key"), fresh(docs, "row_id")
    marked = docs.withColumn(key, F.xxhash64(plain_text(text_col))).withColumn(row_id, F.col(id_col))
    fps = durable(fingerprints(marked, words, [key], text_col).distinct(), "simhash")
    roots = durable(components_of(fps, threshold), "roots")
    # a group is named by the least text of its least fingerprint
    rooted = durable(fps.join(roots, "fp", "left").select(key, F.coalesce("root", "fp").alias("fp")), "rooted")
    named = durable(rooted.groupBy("fp").agg(F.min(key).alias("root"), F.count("*").alias("texts")).where("texts > 1").select("fp", "root"), "named")
    return _one_of_each(marked, row_id, key, rooted.join(named, "fp").select(key, "root"), docs.columns)


def near_pairs(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): pairs of texts of ``prints`` (text_key, fp) with fingerprints that are equal or that the anchors link."""
    fps = durable(prints.groupBy("fp").agg(F.min("text_key").alias("least"), F.count("*").alias("texts")), "fingerprints")
    equal = prints.join(fps.where("texts > 1"), "fp").select(F.col("least").alias("a"), F.col("text_key").alias("b"))
    links = durable(fingerprint_links(fps, threshold), "links")
    ends = links.join(fps.select(F.col("fp").alias("a"), F.col("least").alias("p")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("q")), "b")
    return equal.unionByName(ends.select(F.col("p").alias("a"), F.col("q").alias("b")))


def similar_dedup(docs: DataFrame, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts that a Jaccard similarity of 4/5 of 5-word shingles links, with all its columns: that with the smallest id (of rows with one id, one).

    The anchors find candidates among the fingerprints of 5-word shingles, which are checked by their shingles; links beyond ``threshold`` bits are completed by an exact
    set join (see near_jaccard), so none is lost. A null id comes last in the choice of what stays; repeated rows leave one row.
    """
    key, row_id = fresh(docs, "text_key"), fresh(docs, "row_id")
    marked = docs.withColumn(key, F.xxhash64(plain_text(text_col))).withColumn(row_id, F.col(id_col))
    texts = marked.select(F.col(key).alias("text_key"), plain_text(text_col).cast("binary").alias("text"))
    roots = durable(connected_components(similar_links(texts, lambda prints: near_pairs(prints, threshold))), "roots")
    return _one_of_each(marked, row_id, key, roots.select(F.col("node").alias(key), "root"), docs.columns)
