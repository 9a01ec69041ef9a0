"""Removal of repeated byte strings by difference-cover blockwise construction (operator 4).

Every byte covered by a ``length``-byte string that also starts anywhere else is removed; strings are compared in the input as it is. On request, passages are
counted too: runs of bytes that repeated strings of a smaller length cover, with more than so many words.

1. The texts stand in chunks of a few megabytes.
2. Cover sample: positions (in their document) whose remainder lies in a perfect difference cover of period v. Two equal strings of ``length`` bytes
   have a sample at the same distance from both starts, within v, and so equal names (hashes of the next length - v + 1 bytes) there. Each chunk sends
   its distinct names to name buckets; one bucket at a time is sorted, and names that other chunks hold too go back. A suffix
   without a repeated name within reach is unique and goes no further, and a document without other suffixes is done.
3. The other suffixes go to suffix buckets: by the smallest hash of the short strings inside their first ``length`` bytes, which neighbours share, so a run of
   suffixes travels as one piece of text, once from each chunk. One bucket at a time is sorted: first the blocks of a difference-cover sample of its
   text get ranks (by doubling), then its suffixes are sorted by their first v bytes, and longer ties are broken by the ranks of the sample positions that
   both suffixes have at the same distance, and by the last bytes, which those blocks don't reach. Suffixes that tie over all ``length`` bytes are repeats.
4. The runs of repeated starts go back to the documents, where the covered bytes are removed.

A bucket above ``hot`` bytes of text is split: equal pieces of all chunks are merged by salted grouping first, and then the short strings that are
frequent in such buckets are taken last in the choice of a bucket, so that a passage with ever different surroundings is dealt by these.
Memory is bounded by a chunk, or by one bucket.

Defined cases: null text is the empty text; texts shorter than ``length`` bytes are never cut; repeated rows and copies lose all bytes that a
string covers; null ids are rows of their own; an empty table gives an empty result; other columns are ignored. A longer text than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, plain_text, small_batches

#: Primitive polynomials over two elements, by degree.
PRIMITIVE = {3: 0b1011, 6: 0b1000011, 9: 0b1000010001, 12: 0b1000001010011}
#: Bytes of text in a chunk; names in a bucket.
CHUNK, NAME_BUCKET = 4 << 20, 1 << 19
#: Most suffixes in one piece of text, bytes of text sorted at a time, bytes of a bucket that is split; sorting takes a hundred times the bytes.
PIECE, AT_ONCE, HOT = 1024, 1 << 19, 3 << 19
#: For hot buckets: parts in which equal pieces are merged first; one piece of SAMPLE is read for its short strings, of which COMMON are taken last if LEAST pieces read have them.
SALTS, SAMPLE, COMMON, LEAST = 64, 8, 1 << 16, 64


@cache
def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """(v, cover): Singer's perfect difference set with the longest period up to 7/10 of ``length``."""
    k = max([k for k in (1, 2, 3, 4) if 4**k + 2**k + 1 <= 0.7 * length], default=0)
    if not k:
        return 1, (0,)
    q, degree = 2**k, 3 * k
    power = [1]
    for _ in range(2**degree - 2):
        x = power[-1] << 1
        power.append(x ^ PRIMITIVE[degree] if x >> degree else x)
    v, n = q * q + q + 1, 2**degree - 1
    return v, tuple(i for i in range(v) if power[i] ^ power[q * i % n] ^ power[q * q * i % n] == 0)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


class Hasher:
    """Hashes of all strings of a text from one running sum: byte values by a table, places by powers of an odd number, modulo 2**64."""

    def __init__(self, seed: int):
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
        self.base = 0xD1342543DE82EF95 + 8 * seed
        self.power = self.inverse = np.ones(1, np.uint64)

    def sums(self, text: np.ndarray) -> np.ndarray:
        n = len(text) + 1
        if n > len(self.power):
            self.power, self.inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
            self.power[1:], self.inverse[1:] = np.uint64(self.base), np.uint64(pow(self.base, -1, 1 << 64))
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.inverse, out=self.inverse)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[text] * self.power[: n - 1], out=out[1:])
        return out

    def strings(self, sums: np.ndarray, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return _mix((sums[start + size] - sums[start]) * self.inverse[start])


@cache
def _hasher(seed: int) -> Hasher:
    return Hasher(seed)  # powers are kept by the worker


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in its document, bytes left there) of each byte of a chunk."""
    place = np.arange(sizes.sum(), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    return place, np.repeat(sizes.astype(np.int32), sizes) - place


def _samples(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the cover sample; only names inside documents of ``length`` bytes and more count."""
    v, cover = difference_cover(length)
    inside = np.zeros(v, bool)
    inside[list(cover)] = True
    place, left = _places(sizes)
    at = np.flatnonzero(inside[place % v] & (left >= length - v + 1) & (place + left >= length))
    h = _hasher(1)
    return at, h.strings(h.sums(text), at, length - v + 1)


def _key(names: np.ndarray) -> np.ndarray:
    return names >> np.uint64(24)


def chunked(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, ids, sizes, data: documents side by side."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", plain_text().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            texts = b.column("text").to_pylist()
            group = np.cumsum([len(t) for t in texts]) // chunk
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if texts else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column("doc_id").slice(lo, hi - lo))
                sizes = pa.array([[len(t) for t in texts[lo:hi]]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([base + k]), ids, sizes, pa.array([b"".join(texts[lo:hi])], pa.binary())], names=["chunk", "ids", "sizes", "data"])
                k += 1

    return durable(rows.mapInArrow(run, f"chunk bigint, ids array<{kind}>, sizes array<bigint>, data binary"), "chunks", large_rows=True)


def shared_names(chunks: DataFrame, length: int) -> DataFrame:
    """chunk, names: those of its sample's names (40 bits and the bucket) that another chunk holds too, 8 bytes each."""
    total = chunks.agg(F.sum(F.octet_length("data").cast("bigint"))).first()[0] or 0
    v, cover = difference_cover(length)
    buckets = max(12, int(total * len(cover) / v / NAME_BUCKET) + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, sizes, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "sizes", "data")), strict=True):
                _, names = _samples(np.frombuffer(data, np.uint8), np.array(sizes, np.int64), length)
                key = np.unique(names)
                bucket = (key & np.uint64(0xFFFFFF)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                key, bucket = _key(key[order]), bucket[order]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                raw = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()  # 40 bits of each
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), chunk)), pa.array([raw[5 * cut[i] : 5 * cut[i + 1]] for i in full], pa.binary())], names=["bucket", "chunk", "names"])

    def repeated(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        names = np.concatenate([x for _, x in held])
        value, count = np.unique(names, return_counts=True)
        again = value[count > 1]
        out = [(c, x[again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x]) for c, x in held] if len(again) else []
        out = [(c, x.astype("<u8").tobytes()) for c, x in out if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["chunk", "names"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, chunk, raw in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "names")), strict=True):
                if bucket != now and held:
                    yield repeated(held)
                    held = []
                wide = np.zeros((len(raw) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
                now = bucket
                held.append((chunk, np.unique(wide.view("<u8").ravel())))  # so that equal names come from different chunks
        if held:
            yield repeated(held)

    sent = chunks.select("chunk", "sizes", "data").mapInArrow(send, "bucket bigint, chunk bigint, names binary")
    with small_batches(chunks.sparkSession):
        return durable(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "chunk bigint, names binary"), "names")


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _shorts(text: np.ndarray, length: int) -> np.ndarray:
    """31 bits of the hash of each short string."""
    gram = max(4, min(16, length // 4))
    h = _hasher(1)
    return (h.strings(h.sums(text), np.arange(len(text) - gram + 1), gram) >> np.uint64(33)).astype(np.int32)


def _runs(start: np.ndarray, key: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, suffixes, key) of each run of neighbours in ``start`` with one key, PIECE suffixes long at most; none crosses an edge."""
    first = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(key) != 0) | edge[1:]])
    n = np.diff(np.r_[first, len(start)])
    parts = -(-n // PIECE)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(start[first], parts) + nth * PIECE, np.minimum(PIECE, np.repeat(n, parts) - nth * PIECE), np.repeat(key[first].astype(np.int64), parts)


def suffix_pieces(text: np.ndarray, sizes: np.ndarray, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, suffixes, bucket key, bytes to the end of the document) of each run of suffixes that may be repeated."""
    none = np.empty(0, np.int64)
    if len(text) < length:
        return none, none, none, none
    v, _ = difference_cover(length)
    at, names = _samples(text, sizes, length)
    if not len(at):
        return none, none, none, none
    key = _key(names)
    _, back, count = np.unique(names, return_inverse=True, return_counts=True)
    again = count[back] > 1
    if len(shared):
        again |= shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key
    at = at[again]
    place, left = _places(sizes)
    change = np.bincount(np.maximum(at - v + 1, at - place[at]), minlength=len(text) + 1) - np.bincount(at + 1, minlength=len(text) + 1)
    may = (np.cumsum(change[:-1]) > 0) & (left >= length)
    start = np.flatnonzero(may)
    if not len(start):
        return none, none, none, none
    short = _shorts(text, length)
    least = _sliding_least(short, length - (len(text) - len(short)))[start]
    first, n, key = _runs(start, least, place[start] == 0)
    return first, n, key, left[first].astype(np.int64)


@cache
def _distances(v: int, cover: tuple[int, ...]) -> np.ndarray:
    """For remainders a and b, the least d for which a + d and b + d are both in the cover."""
    inside = np.zeros(v, bool)
    inside[list(cover)] = True
    out = np.zeros((v, v), np.int64)
    a, b = np.meshgrid(np.arange(v), np.arange(v), indexing="ij")
    for d in range(v - 1, -1, -1):
        out[inside[(a + d) % v] & inside[(b + d) % v]] = d
    return out


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys in this order); ``bits`` hold any key. Where key and place fit one number, plain sorting does."""
    wide = len(key).bit_length()
    if bits + wide > 63:
        order = np.argsort(key)
        return order, key[order]
    both = key << wide | np.arange(len(key))
    both.sort()
    return both & ((1 << wide) - 1), both >> wide


def _ranked(key: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of the values of ``key``."""
    order, own = _sorted(key, bits)
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.r_[False, own[1:] != own[:-1]], dtype=np.int32)
    return out


class Blocks:
    """Ranks of the blocks of one bucket's text: of v bytes at chosen positions, of longer ones at the positions of a difference cover."""

    def __init__(self, text: np.ndarray, depth: int):
        """For comparisons of ``depth`` bytes or more."""
        self.v, self.cover = difference_cover(next((m for m in (30, 10) if m <= 0.5 * depth), 1))
        self.n = len(text)
        self.bits = (self.n + 1).bit_length()
        code = np.cumsum(np.bincount(text, minlength=256) > 0)  # bytes by rank, so that more of them fit one number
        wide = int(code[-1]).bit_length()
        self.size = min(self.v, max(1, (63 - self.bits) // wide))
        padded = np.r_[code[text], np.zeros(self.size, np.int64)]
        word = np.zeros(self.n, np.int64)
        for k in range(self.size):
            word = word << wide | padded[k : k + self.n]
        self.short = _ranked(word, wide * self.size)
        inside = np.zeros(self.v, bool)
        inside[list(self.cover)] = True
        self.at = np.flatnonzero(inside[np.arange(self.n) % self.v])
        self.sample: dict[int, np.ndarray] = {}

    def _longer(self, rank: np.ndarray, size: int, at: np.ndarray, to: int) -> np.ndarray:
        """Ranks of the blocks of ``to`` bytes at ``at`` (twice ``size`` at most), from the ranks of blocks of ``size`` bytes."""
        if to == size:
            return rank[at]
        more = at + (to - size)
        key = rank[at].astype(np.int64) << self.bits | (rank[np.minimum(more, self.n - 1)] + np.int64(1)) * (more < self.n)
        return _ranked(key, 2 * self.bits)

    def heads(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the v bytes at each of ``at``."""
        rank, size = self.short, self.size
        while 2 * size < self.v:
            rank, size = self._longer(rank, size, np.arange(self.n), 2 * size), 2 * size
        return self._longer(rank, size, at, self.v)

    def ranks(self, size: int) -> np.ndarray:
        """Ranks of the blocks of ``size`` bytes, a multiple of v, at the sample positions."""
        while size not in self.sample:
            known = max((k for k in self.sample if k < size), default=0)
            out = np.zeros(self.n, np.int32)
            out[self.at] = self._longer(self.sample[known], known, self.at, min(2 * known, size)) if known else self.heads(self.at)
            self.sample[min(2 * known, size) or self.v] = out
        return self.sample[size]

    def equal(self, start: np.ndarray, depth: int) -> np.ndarray:
        """A number for each of the suffixes at ``start``, equal for those that tie over ``depth`` bytes: sorted by their first v bytes, and longer ties by ranks."""
        v, n = self.v, len(start)
        size = v * ((depth - v + 1) // v)
        block = self.ranks(size)
        apart = _distances(v, self.cover)
        # first and last bytes of each suffix; what lies between is in the sample's blocks, of which a second one begins so late as the depth allows
        ends = self.heads(np.concatenate([start, start + depth - v]))
        group, tail = ends[:n].astype(np.int64), ends[n:]
        done = np.zeros(n, np.int64)
        closed = 0
        order, own = _sorted(group, self.bits + 1)
        while len(order):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            count = np.diff(np.r_[first, len(order)])
            pivot = np.repeat(order[first + count // 2], count)
            a, b = start[order], start[pivot]
            d = apart[a % v, b % v]
            way = np.sign(block[a + d] - block[b + d])
            tie = np.flatnonzero(way == 0)
            late = d[tie] + (depth - size - d[tie]) // v * v
            way[tie] = np.sign(block[a[tie] + late] - block[b[tie] + late])
            way = np.where(way == 0, np.sign(tail[order] - tail[pivot]), way)
            nth = np.repeat(np.arange(len(first)), count)
            same = way == 0
            done[order[same]] = closed + nth[same]
            closed += len(first)
            order, nth, way = order[~same], nth[~same], way[~same]
            place, own = _sorted(2 * nth + (way > 0), self.bits + 1)
            order = order[place]
        return done


def repeats(rows: list[tuple[list[tuple[bytes, int]], int, int, bytes]], depths: tuple[int, ...]) -> pa.RecordBatch:
    """Whole buckets of (its places as piece_id and offset, n, times, piece): their suffixes are sorted, and the runs of those given that tie with another, by depth, at each place."""
    places, n, times, pieces = zip(*rows, strict=True)
    size, n = np.array([len(p) for p in pieces]), np.array(n)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + nth
    reach = np.repeat(size, n) - nth
    many, piece = np.repeat(np.array(times), n), np.repeat(np.arange(len(n)), n)
    edge = np.r_[True, piece[1:] != piece[:-1]]
    last = np.r_[edge[1:], True]
    blocks = Blocks(text, depths[0])
    some, out = np.arange(len(start)), []
    for level, depth in enumerate(depths):
        some = some[reach[some] >= depth]
        again = np.zeros(len(start), bool)
        if len(some):
            same = blocks.equal(start[some], depth)
            again[some] = np.bincount(same, weights=many[some])[same] > 1
        begin = np.flatnonzero(again & (edge | ~np.r_[False, again[:-1]]))
        stop = np.flatnonzero(again & (last | ~np.r_[again[1:], False])) + 1
        own = piece[begin]
        out.append((own, nth[begin], stop - begin, np.full(len(own), level)))
        some = np.flatnonzero(again)  # a longer tie is one of these
    own, begin, count, level = (np.concatenate(x) for x in zip(*out, strict=True))
    each = np.array([len(x) for x in places], np.int64)[own]
    begin, count, level = (np.repeat(x, each) for x in (begin, count, level))
    ids, offset = zip(*[x for k in own.tolist() for x in places[k]], strict=True) if len(own) else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(begin + np.array(offset, np.int64)), pa.array(count), pa.array(level.astype(np.int32))], names=["piece_id", "at", "many", "level"])


def dealt_anew(pieces: DataFrame, depths: tuple[int, ...], hot: int) -> DataFrame:
    """key, piece_id, offset, n, times, piece: the rows that meet by key. Pieces of buckets of more than ``hot`` bytes are merged, and cut and dealt by a rarer key."""
    plain = pieces.select("key", "piece_id", F.lit(0).alias("offset"), "n", F.size("refs").cast("bigint").alias("times"), "piece")
    large = durable(pieces.groupBy("key").agg(F.sum(F.octet_length("piece").cast("bigint")).alias("bytes")).where(F.col("bytes") > hot).select("key"), "hot")
    if large.isEmpty():
        return plain
    one = pieces.join(large, "key", "left_semi").select("piece_id", F.pmod("chunk", F.lit(SALTS)).alias("salt"), "n", F.size("refs").cast("bigint").alias("times"), "piece")
    same = F.first("n").alias("n"), F.sum("times").alias("times"), F.first("piece").alias("piece")
    one = durable(one.groupBy("piece_id", "salt").agg(*same).groupBy("piece_id").agg(*same), "merged")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(_shorts(np.frombuffer(p, np.uint8), depths[0])) for p in b.column("piece").to_pylist()]
            value, times = np.unique(np.concatenate([np.empty(0, np.int32), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times)], names=["short", "c"])

    counts = one.where(F.pmod(F.xxhash64("piece_id"), F.lit(SAMPLE)) == 0).select("piece").mapInArrow(count, "short int, c bigint").groupBy("short").agg(F.sum("c").alias("c"))
    common = np.sort(np.array([r.short for r in counts.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "short").limit(COMMON).collect()], np.int32))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, n, times, piece in zip(*(b.column(c).to_pylist() for c in ("piece_id", "n", "times", "piece")), strict=True):
                short = _shorts(np.frombuffer(piece, np.uint8), depths[0]).astype(np.int64)
                if len(common):
                    short += (common[np.minimum(np.searchsorted(common, short), len(common) - 1)] == short).astype(np.int64) << 31
                least = _sliding_least(short, depths[0] - (len(piece) - len(short)))[:n]
                for s, k, key in zip(*(x.tolist() for x in _runs(np.arange(n), least, np.zeros(n, bool))), strict=True):
                    out.append((key + (1 << 40), i, s, k, times, piece[s : s + k + depths[-1] - 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=names)

    names = ["key", "piece_id", "offset", "n", "times", "piece"]
    again = one.mapInArrow(deal, "key bigint, piece_id binary, offset int, n int, times bigint, piece binary")
    return plain.join(large, "key", "left_anti").unionByName(again)


def repeated_starts(pieces: DataFrame, depths: tuple[int, ...], hot: int = HOT) -> DataFrame:
    """chunk, refs, at, many, level: at each of the positions ``refs`` + ``at`` of the chunk's text ``many`` neighbours start a repeated string of ``depths[level]`` bytes."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # by text: what many pieces have in common is sorted once
        now, size = None, 0
        for b in batches:
            for key, i, offset, n, times, piece in zip(*(b.column(c).to_pylist() for c in ("key", "piece_id", "offset", "n", "times", "piece")), strict=True):
                if key != now and size > AT_ONCE:
                    yield sort(held)
                    held, size = {}, 0
                now = key
                if (own := held.get((n, piece))) is None:
                    own = held[n, piece] = [{}, 0]
                    size += len(piece)
                own[0][i, offset] = None
                own[1] += times
        if held:
            yield sort(held)

    def sort(held: dict[tuple, list]) -> pa.RecordBatch:
        return repeats([(list(places), n, times, piece) for (n, piece), (places, times) in held.items()], depths)

    dealt = dealt_anew(pieces, depths, hot)
    met = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "piece_id binary, at bigint, many bigint, level int")
    runs = durable(met, "repeats")  # a table of its own, so that adaptive execution can split a piece that very many chunks hold
    return durable(pieces.select("piece_id", "chunk", "refs").join(runs, "piece_id").select("chunk", "refs", "at", "many", "level"), "starts")


def remove_repeats(docs: DataFrame, length: int = 400, passage: tuple[int, int] | None = None, with_text: bool = False, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for) of every document.

    ``passage`` (bytes, words), with fewer bytes than ``length``, adds n_passages: maximal runs of bytes covered by repeated strings of so many bytes, of more than so many words.
    """
    depths = (passage[0], length) if passage else (length,)
    base, words = depths[0], passage[1] if passage else 0
    chunks = chunked(docs, chunk)
    names = shared_names(chunks, base)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("piece_id", pa.binary()), ("refs", pa.list_(pa.int64())), ("n", pa.int32()), ("piece", pa.binary()), ("sizes", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("data", pa.binary()), ("sha", pa.list_(pa.string()))])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """The pieces of a chunk; its documents that pieces come from (starts, data); the others, which are done (sha)."""
        out = []
        own_ids = left.column("ids").type
        for row, (number, sizes, data) in enumerate(zip(*(left.column(c).to_pylist() for c in ("chunk", "sizes", "data")), strict=True)):
            text, sizes = np.frombuffer(data, np.uint8), np.array(sizes, np.int64)
            ids = left.column("ids").slice(row, 1).combine_chunks().flatten()
            shared = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, "<u8") for x in right.column("names").to_pylist())]))
            start, n, key, room = suffix_pieces(text, sizes, shared, base)
            stop = np.cumsum(sizes)
            met = np.full(len(sizes), with_text)
            met[np.searchsorted(stop, start, "right")] = True
            if len(start):
                h, g = _hasher(1), _hasher(2)
                extent = np.minimum(n + length - 1, room)
                one, two = (x.strings(x.sums(text), start, extent) ^ _mix(n.astype(np.uint64)) for x in (h, g))
                _, first, back = np.unique(one ^ _mix(two), return_index=True, return_inverse=True)
                order = np.argsort(back, kind="stable")
                refs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(back))].astype(np.int32)), pa.array(start[order]))
                piece = [data[s : s + k] for s, k in zip(start[first].tolist(), extent[first].tolist(), strict=True)]
                name = np.stack([one[first], two[first]], axis=1).astype("<u8").view(np.uint8).reshape(len(first), 16)
                out.append(pa.table({"chunk": pa.array(np.full(len(first), number)), "key": pa.array(key[first]), "piece_id": pa.array([x.tobytes() for x in name], pa.binary()), "refs": refs, "n": pa.array(n[first].astype(np.int32)), "piece": pa.array(piece, pa.binary())}))
            for chosen in (met, ~met):
                if chosen.any():
                    at = np.flatnonzero(chosen).tolist()
                    texts = [data[stop[k] - sizes[k] : stop[k]] for k in at]
                    more = {"starts": pa.array([[int(stop[k] - sizes[k]) for k in at]], pa.list_(pa.int64())), "data": pa.array([b"".join(texts)], pa.binary())} if chosen is met else {"sha": pa.array([[hashlib.sha256(t).hexdigest() for t in texts]], pa.list_(pa.string()))}
                    listed = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids.take(pa.array(at)))
                    out.append(pa.table({"chunk": pa.array([number]), "ids": listed.cast(own_ids), "sizes": pa.array([[int(sizes[k]) for k in at]], pa.list_(pa.int64()))} | more))
        full = schema.insert(1, pa.field("ids", own_ids))
        return pa.concat_tables([pa.table({f.name: t.column(f.name) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in full}, schema=full) for t in out]) if out else full.empty_table()

    made = chunks.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(send, f"chunk bigint, ids array<{kind}>, key bigint, piece_id binary, refs array<bigint>, n int, piece binary, sizes array<bigint>, starts array<bigint>, data binary, sha array<string>")
    made = durable(made, "pieces", large_rows=True)
    starts = repeated_starts(made.where("key is not null").select("chunk", "key", "piece_id", "refs", "n", "piece"), depths, hot)
    zero = F.lit(0).cast("bigint")
    done = made.where("sha is not null").select(F.explode(F.arrays_zip("ids", "sizes", "sha")).alias("x"))
    done = done.select(F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("x.sha").alias("kept_sha256"), *[zero.alias("n_passages")] * bool(passage))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids").combine_chunks().flatten()
        sizes, first = (np.array([k for x in left.column(c).to_pylist() for k in x], np.int64) for c in ("sizes", "starts"))
        data = b"".join(left.column("data").to_pylist())
        text = np.frombuffer(data, np.uint8)
        stop = np.cumsum(sizes)
        edge = np.zeros(len(text) + 1, bool)
        edge[stop - sizes] = True
        refs = right.column("refs").combine_chunks()
        count = np.diff(refs.offsets.to_numpy()) if right.num_rows else np.empty(0, np.int64)
        at, many, level = (np.repeat(right.column(c).to_numpy(), count) for c in ("at", "many", "level"))
        begin = refs.flatten().to_numpy() + at if right.num_rows else at
        begin = begin - (first - stop + sizes)[np.searchsorted(first, begin, "right") - 1] if len(begin) else begin

        def covered(deep: int) -> tuple[np.ndarray, np.ndarray]:
            """(bytes that repeats of this level cover, first bytes of their runs)"""
            a = begin[level == deep]
            change = np.bincount(a, minlength=len(text) + 1) - np.bincount(a + many[level == deep] + depths[deep] - 1, minlength=len(text) + 1)
            gone = np.cumsum(change)[:-1] > 0
            return gone, gone & (edge[:-1] | ~np.r_[False, gone[:-1]][: len(gone)])

        def by_document(x: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(x)]
            return sums[stop] - sums[stop - sizes]

        gone, heads = covered(len(depths) - 1)
        kept = [text[a:z][~gone[a:z]].tobytes() for a, z in zip((stop - sizes).tolist(), stop.tolist(), strict=True)]
        out = {"doc_id": ids, "n_bytes": pa.array(sizes), "n_removed": pa.array(by_document(gone)), "n_spans": pa.array(by_document(heads)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if passage:
            inside, heads = covered(0)
            ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
            long = np.zeros(len(text), bool)
            for a, z in zip(np.flatnonzero(heads).tolist(), ends.tolist(), strict=True):
                long[a] = len(data[a:z].split()) > words
            out["n_passages"] = pa.array(by_document(long))
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    columns = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", n_passages bigint" * bool(passage)
    open_docs = made.where("starts is not null").select("chunk", "ids", "sizes", "starts", "data")
    met = open_docs.groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInArrow(cut, columns + ", kept binary" * with_text)
    return met if with_text else met.unionByName(done)
