"""The exact side of near-duplicate removal (operator 9): links by Jaccard similarity of word shingles.

Two texts are linked if the sets of their 5-word shingles have a Jaccard similarity of 4/5 or more. At that similarity about 10 of 64 bits of two fingerprints
differ, which no covering by anchors reaches at a bearable number of copies; so the links that the anchors find are checked here by shingles as
text, and the links that they cannot find are completed by a prefix-filtered set join.

1. The shingles of a text stand in one order for the whole table: by hash, but the heaviest of a sample of texts last. Sets of similarity 4/5 share a
   shingle among their first n - ceil(4n/5) + 1, so only these are sent (hash, text, size, place), and texts meet at equal shingles.
2. Pairs whose sizes or places rule out 4/5 go, and those whose sketches do: a sketch holds the parity of a text's shingles by
   hash (a fold is a small one that travels along), so the sets differ by as many shingles as the sketches by bits, or more. The others are compared by their shingles as text. That is exact: no link that joins two groups is lost
   and none is added.
3. A shingle with more than ``SMALL`` texts first compares its texts with one of them, then in TURNS turns with STARS others, first of all texts, then of the groups that links leave. Only then are all pairs compared that
   still lie in different groups, in parts of PART_ROWS texts that meet two by two, so that the pairs of a large run are dealt to many tasks. So a large group of near copies costs a few comparisons a text; many
   texts that share a leading shingle and pass the filters without being near copies cost a comparison a pair.

The order has no influence on results, so the sample may be any. Defined cases: A-Z count as a-z, words stand between ASCII white space; a text of fewer than five
words is one shingle, so null, empty and blank texts are copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import connected_components

#: Words of a shingle; the similarity as a fraction.
WORDS, PART, WHOLE = 5, 4, 5
#: Texts at a shingle that are compared pair by pair at once; texts of one part of a larger run.
SMALL, PART_ROWS = 16, 4096
#: Texts of a larger run that all others are compared with in a turn, and turns.
STARS, TURNS = 8, 2
#: One text of SAMPLE is counted for the heaviest shingles, of which HEAVY are kept if LEAST sampled texts hold them.
SAMPLE, HEAVY, LEAST = 32, 1 << 16, 4
#: Bits of a fold.
FOLD = 1024
#: Bits of the filter for the texts that take part in a comparison.
BITS = 1 << 23


def shingles(text: bytes) -> set[bytes]:
    w = text.lower().split()
    return set(map(b" ".join, zip(*(w[k:] for k in range(WORDS))))) if len(w) >= WORDS else {b" ".join(w)}


def hashes(text: bytes) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingles(text)], np.uint64)).view(np.int64)


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def prefix(h: np.ndarray, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The shingles that are sent, in their order; ``heavy`` (ascending) come last, by ``weight``."""
    rank = np.zeros(len(h), np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        rank = np.where(heavy[at] == h, weight[at], 0)
    return h[np.lexsort((h, rank))][: len(h) + PART * len(h) // -WHOLE + 1]


def possible(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can reach the similarity if the first that they share is at these places."""
    most = np.minimum(n - place, m - other)
    return (WHOLE * np.minimum(n, m) >= PART * np.maximum(n, m)) & ((PART + WHOLE) * most >= PART * (n + m))


def sketch(h: np.ndarray) -> bytes:
    """The parity of the hashes ``h`` by their low bits, as many bits as hashes or up to twice as many (64 at least)."""
    bits = 1 << max(6, (len(h) - 1).bit_length())
    return np.packbits((np.bincount(h & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(h: np.ndarray) -> bytes:
    """The parity of the hashes ``h`` by their low bits, FOLD of them whatever their number."""
    return np.packbits((np.bincount(h & (FOLD - 1), minlength=FOLD) & 1).astype(np.uint8)).tobytes()


def near_folds(n: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with these folds (numbers of 64 bits) can reach the similarity."""
    return (PART + WHOLE) * np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= (WHOLE - PART) * (n + m)


def near_sketches(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sets of n and m shingles with these sketches can reach the similarity."""
    if WHOLE * min(n, m) < PART * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return (PART + WHOLE) * int(np.bitwise_count(x ^ y).sum()) <= (WHOLE - PART) * (n + m)


def _standing(text: np.ndarray, turn: int) -> int:
    """The text that stands for all in this turn: the same for all shingles that it leads, so that few different pairs arise."""
    x = (text.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    return int(np.argmin((x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)))


def _stars(text: np.ndarray, root: np.ndarray, key: int, turn: int) -> np.ndarray:
    """The texts that stand for all in a later turn: first by text, the same for all shingles, then of groups by ``root``, of whatever size and others at each shingle."""
    by = text if turn == 1 else root ^ key
    return np.unique([_standing(by, STARS * turn + k) for k in range(STARS)])


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Whole runs of the first column, as many at a time as come."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(k).to_numpy(zero_copy_only=False) for k in names]
        last = int(np.searchsorted(new[0], new[0][-1]))
        if last or (held and held[0][0][0] != new[0][0]):
            yield [np.concatenate(x) for x in zip(*([*held, [x[:last] for x in new]] if last else held), strict=True)]
            held = []
        held.append([x[last:] for x in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the only column, by its low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy(zero_copy_only=False) & (BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(BITS // 8, np.uint8)
    for r in keys.coalesce(8).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of ``texts`` (text_key, text) that reach the similarity."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = zip(*(b.column(c).to_pylist() for c in ("n", "sketch", "m", "other")), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([near_sketches(*x) for x in met], pa.bool_()))

    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(sketches.select(F.col("text_key").alias("a"), "n", "sketch"), "a").join(sketches.select(F.col("text_key").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other")), "b")
    pairs = durable(pairs.mapInArrow(close, "a bigint, b bigint").distinct(), "pairs")
    taking = pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    bits = _filter(taking)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = b.column("text_key").to_numpy(zero_copy_only=False) & (BITS - 1)
            yield b.filter(pa.array((bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, set()
        for b in batches:
            a, other = b.column("a").to_pylist(), []
            for key, text, to in zip(a, b.column("ta"), b.column("tb"), strict=True):
                if key != now:
                    now, own = key, shingles(text.as_py())
                other.append(similar(own, shingles(to.as_py())))
            yield b.select(["a", "b"]).filter(pa.array(other, pa.bool_()))

    some = durable(texts.mapInArrow(needed, "text_key bigint, text binary").join(taking.hint("shuffle_hash"), "text_key", "left_semi").dropDuplicates(["text_key"]), "compared")
    met = pairs.join(some.select(F.col("text_key").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("text_key").alias("b"), F.col("text").alias("tb")), "b")
    return durable(met.mapInArrow(compare, "a bigint, b bigint"), "links")


def majority(h: np.ndarray) -> int:
    """The fingerprint of a set of hashes: a bit is 1 if set in over half of them."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def similar_links(texts: DataFrame, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): links between the rows of ``texts`` (text_key bigint, text binary); enough of them to join every group.

    ``candidates`` gives pairs (a, b) to check first, from (text_key, fp), the fingerprints of all texts.
    """

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(t.as_py()))], names=["key"])

    some = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(sampled, "key bigint").groupBy("key").agg(F.count("*").alias("c"))
    top = sorted((r.key, r.c) for r in some.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "key").limit(HEAVY).collect())
    heavy, weight = np.array([k for k, _ in top], np.int64), np.array([c for _, c in top], np.int64)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [hashes(t.as_py()) for t in b.column("text")]
            rows = [(len(h), majority(h), sketch(h), fold(h), prefix(h, heavy, weight).astype("<i8").tobytes()) for h in every]
            n, fp, own, low, sent = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(own, pa.binary()), pa.array(low, pa.binary()), pa.array(sent, pa.binary())], names=["text_key", "n", "fp", "sketch", "fold", "sent"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.frombuffer(x, "<i8") for x in b.column("sent").to_pylist()]
            if keys:
                count = np.array([len(k) for k in keys])
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                text, n = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), count) for c in ("text_key", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(text), pa.array(n), pa.array(place.astype(np.int32))], names=names)

    names = ["key", "text_key", "n", "place"]

    def batch(a: list[np.ndarray], b: list[np.ndarray], kept: list[np.ndarray] | None = None) -> pa.RecordBatch:
        """Pairs without a key, and the rows of large runs with it."""
        none = np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([none, *a]), np.concatenate([none, *b])]), axis=1)
        kept = kept if kept is not None else [none] * 4
        first, more = pairs.shape[1], len(kept[0])
        rows = [np.r_[pairs[0], kept[1]], np.r_[pairs[1], kept[0]], np.r_[np.full(first, -1), kept[2]], np.r_[np.full(first, -1), kept[3]]]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(rows, (np.int64, np.int64, np.int32, np.int32), strict=True)], names=["a", "b", "n", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, names):
            new = np.r_[True, (run[0][1:] != run[0][:-1]) | (run[1][1:] != run[1][:-1])]
            key, text, n, place = (x[new] for x in run)
            n, place = n.astype(np.int64), place.astype(np.int64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            a, b = [], []
            for s, k in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                x = slice(s, s + k)
                p = s + _standing(text[x], 0)
                may = possible(n[x], place[x], n[p], place[p])
                a.append(text[x][may])
                b.append(np.full(may.sum(), text[p]))
            large = np.repeat(sizes > SMALL, sizes)
            kept = [key[large], text[large], n[large], place[large]]
            key, text, n, place = (x[~large & np.repeat(sizes > 1, sizes)] for x in (key, text, n, place))
            for k in range(1, SMALL):
                same = np.flatnonzero(key[k:] == key[:-k])
                if not len(same):
                    break
                same = same[possible(n[same], place[same], n[same + k], place[same + k])]
                a.append(text[same])
                b.append(text[same + k])
            yield batch(a, b, kept)

    table = durable(texts.mapInArrow(shingled, "text_key bigint, n int, fp bigint, sketch binary, fold binary, sent binary"), "shingled")
    sketches = durable(table.select("text_key", "n", "sketch").dropDuplicates(["text_key"]), "sketches")
    sent = table.select("text_key", "n", "sent").mapInArrow(send, "key bigint, text_key bigint, n int, place int")
    met = durable(sent.repartition("key").sortWithinPartitions("key", "text_key").mapInArrow(meet, "a bigint, b bigint, n int, place int"), "met")
    pairs = met.where("n < 0").select("a", "b")
    if candidates:
        pairs = pairs.unionByName(candidates(table.select("text_key", "fp").distinct()))
    links = verified(pairs, texts, sketches)
    large = met.where("n >= 0").select(F.col("b").alias("key"), F.col("a").alias("text_key"), "n", "place")
    if large.isEmpty():
        return links

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of (key, part, other): with one text that stands for all where part is -1, else pair by pair, between two parts or inside one."""
        for run in _runs(batches, ["key", "part", "other", "text_key", "n", "place", "root", "own", "fold"]):
            new = (run[0][1:] != run[0][:-1]) | (run[1][1:] != run[1][:-1]) | (run[2][1:] != run[2][:-1])
            cuts = np.flatnonzero(np.r_[True, new, True])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part, other, text, n, place, root, own, low = (x[s:e] for x in run[1:])
                n, place = n.astype(np.int64), place.astype(np.int64)
                low = np.frombuffer(b"".join(low.tolist()), np.uint64).reshape(-1, FOLD // 64)
                left = _stars(text, root, int(run[0][s]), -int(part[0])) if part[0] < 0 else np.flatnonzero(own == part[0])
                right = np.arange(len(text)) if part[0] < 0 else np.flatnonzero(own == other[0])
                step = max(1, (1 << 16) // max(1, len(right)))
                for k in range(0, len(left), step):
                    p, q = left[k : k + step][:, None], right[None, :]
                    i, j = np.nonzero((root[p] != root[q]) & possible(n[p], place[p], n[q], place[q]))
                    i, j = p[i, 0], right[j]
                    near = near_folds(n[i], low[i], n[j], low[j])
                    if near.any():
                        yield batch([text[i[near]]], [text[j[near]]])

    folds = durable(table.select("text_key", "fold").join(large.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"]), "folds")
    marked = large.join(folds, "text_key")
    order = ("key", "part", "other")

    def found(rows: DataFrame) -> DataFrame:
        pairs = rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(across, "a bigint, b bigint, n int, place int")
        return durable(links.unionByName(verified(pairs.select("a", "b"), texts, sketches)), "links")

    # some texts for all, but where links join already: two steps to the least neighbour give all texts around one that stands for them the same name
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    roots = durable(both.join(least, "b").groupBy("a").agg(F.min("m").alias("root")), "hubs").withColumnRenamed("a", "node")

    def rooted() -> DataFrame:
        return marked.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))

    def open_runs() -> DataFrame:
        """Runs with texts that links do not join yet."""
        return rooted().groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")

    for turn in range(TURNS):
        links = found(rooted().join(open_runs().select("key"), "key").withColumns({c: F.lit(-1 - turn) for c in ("part", "other", "own")}))
        roots = durable(connected_components(links), "roots")
    # then what links do not join yet, in parts of PART_ROWS texts that meet two by two, so a large run is many small tasks
    runs = durable(open_runs().select("key", F.expr(f"(size + {PART_ROWS - 1}) div {PART_ROWS}").cast("int").alias("parts")), "runs")
    dealt = rooted().join(runs, "key").withColumn("own", F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int"))
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("own", k).alias("part"), F.greatest("own", k).alias("other"))))
    return found(dealt.withColumn("m", met).select("*", "m.*"))
