"""Removal of repeated word sequences by seed and extend (operator 12).

Seeds: of every ``words`` consecutive words the least of the hashes of its GRAM-word strings is the anchor (winnowing), so equal windows have equal anchors at
equal places, and an anchor stands for the neighbouring windows it is least in. Its extent, all words of those windows, is the seed extended as far to both sides as it can matter.

1. Anchors meet by hash. Where another occurrence has an equal extent, all of it repeats: everything but the first occurrence is removed at once, which
   settles the inside of long copies. An anchor that occurs with one extent only is done.
2. First occurrences whose anchor also occurs with other extents (edges of copies, changed words) are extended word by word: the windows at each
   possible distance to the left and right of the anchor are compared by their hashes. Of equal windows all but the first are removed.

What is removed of a document is the union of both, in maximal runs. No pairs are made: an occurrence is only compared with the first of its class. Strings are
told apart by 128 bits (anchor and extent or window, 64 each).

Texts are packed in chunks of CHUNK bytes, written once. Per step a chunk sends each string once, in one row for each bucket, and gets back a byte or a
place for what it sent; the next step finds the strings again from the text. A string in a third of all rows is thus one entry a chunk. A bucket holds
about BUCKET bytes and is worked on alone. Anchors with many different extents (a phrase in a third of all rows) are found while chunks
are written and are spread over the buckets by their extents.

A document comes before another by its id, null first, rows of equal id in table order (each is a document of its own).

Defined cases: null and empty texts have no words and lose none; documents of fewer than ``words`` words lose none; one very long text makes a long chunk;
repeated rows with one id are compared like documents of different ids; an empty table gives an empty result; other columns, whatever their names, are kept by
:func:`drop_substrings` and ignored by :func:`substring_report`. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, plain_text, small_batches
from .suffix_dedup import _sliding_least

#: Bytes of text of a chunk, and of what a bucket receives.
CHUNK, BUCKET = 1 << 22, 1 << 22
#: Words of an anchor.
GRAM = 5
#: An anchor with this many extents in one chunk is spread over the buckets; so many anchors at most, which bounds what tasks are told.
MANY, MOST = 32, 1 << 16
#: Words whose hashes a task remembers.
REMEMBERED = 150_000
#: Odd numbers that hashes are multiplied by.
ODD, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: Bits of a place in a chunk; the rest of a word's bits orders anchors, ties by place.
PLACE = 31


class _Hashes(dict):
    """word -> 64-bit hash; forgets all when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(27))


class _Powers:
    """Powers of ODD and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (ODD, pow(ODD, -1, 1 << 64)))
        return self.up, self.down


class Anchors:
    """The anchors of a chunk's words: ``anchor`` and ``extent`` hashes, first and last window, place, and rank (document, place) of each occurrence."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, words: int, powers: _Powers) -> None:
        self.words = words
        n = len(hashes)
        self.up, self.down = powers.of(n + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(hashes * self.up[:n])]
        start = np.cumsum(sizes) - sizes
        left = np.repeat(start + sizes, sizes) - np.arange(n)  # words to the end of the document
        self.ids = ids
        # documents of the chunk in their order
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((np.arange(len(ids)), ids))] = np.arange(len(ids))
        windows = np.flatnonzero(left >= words)
        if not len(windows):
            self.first = self.last = self.doc = np.empty(0, np.int64)
            self.anchor = self.extent = np.empty(0, np.uint64)
            self.rank = self.first
            return
        gram = _mixed(self.strings(np.arange(n - GRAM + 1), GRAM))
        least = _sliding_least((gram >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(gram), dtype=np.uint64), words - GRAM + 1)
        place = (least[windows] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(windows) != 1)])
        self.first, self.last = windows[new], windows[np.r_[new[1:], len(windows)] - 1]
        place = place[new]
        self.anchor = gram[place]
        size = self.last - self.first + words
        self.extent = _mixed(self.strings(self.first, size) + (size * 64 + place - self.first).astype(np.uint64) * np.uint64(ODD))
        self.doc = np.searchsorted(start + sizes, self.first, side="right")
        self.rank = (rank[self.doc] << 32) | (self.first - start[self.doc])
        self._rank_of = lambda doc, at: (rank[doc] << 32) | (at - start[doc])

    def strings(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(first occurrence of each pair of anchor and extent, by these; all other occurrences)."""
        order = np.lexsort((self.rank, self.extent, self.anchor))
        new = _changes(self.anchor[order], self.extent[order])
        return order[new], order[~new]

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of these occurrences: hash, anchor, id, start of the first of each kind; starts of all others."""
        n = self.last[of] - self.first[of] + 1
        each = np.repeat(of, n)
        at = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + self.first[each]
        key, anchor, doc = _mixed(self.strings(at, self.words)), self.anchor[each], self.doc[each]
        order = np.lexsort((self._rank_of(doc, at), anchor, key)) if len(at) else np.empty(0, np.int64)
        new = _changes(key[order], anchor[order])
        one = order[new]
        return key[one], anchor[one], self.ids[doc[one]], at[one], at[order[~new]]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    out = np.zeros(len(keys[0]), bool)
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    out[:1] = True
    return out


def _split(data: bytes, bytes_: list[int]) -> tuple[list[bytes], np.ndarray]:
    """All words of a chunk, and the number of each document's."""
    words, sizes, at = [], [], 0
    for n in bytes_:
        mine = data[at : at + n].split()
        words += mine
        sizes.append(len(mine))
        at += n
    return words, np.array(sizes, np.int64)


class _Reader:
    """Anchors of one chunk after another; a task has one."""

    def __init__(self, words: int) -> None:
        self.words, self.hashes, self.powers = words, _Hashes(), _Powers()

    def anchors(self, data: bytes, bytes_: list[int], ids: list[int]) -> Anchors:
        words, sizes = _split(data, bytes_)
        return Anchors(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)), sizes, np.array(ids, np.int64), self.words, self.powers)


def _raw(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _table(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if v and isinstance(v[0], bytes) else None if v else pa.null()) for v in columns.values()], names=list(columns))


def _each(b: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in names), strict=True)


def _id(id_col: str) -> Column:
    """The id as a number; null comes first."""
    return F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63)))


CHUNKS = "chunk bigint, ids array<bigint>, sizes array<bigint>, data binary, many array<bigint>"


def _chunks(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """chunk, ids, sizes (bytes), data of documents side by side; ``many``: the anchors that it has with many extents."""
    rows = docs.select(_id(id_col).alias("id"), plain_text(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, chunk = _Reader(words), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal ids, texts, size, chunk
            data, sizes = b"".join(texts), [len(t) for t in texts]
            a = reader.anchors(data, sizes, ids)
            one, _ = a.classes()
            anchor, count = np.unique(a.anchor[one], return_counts=True)
            many = anchor[count > MANY].astype(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([many.tolist()], pa.list_(pa.int64()))], names=["chunk", "ids", "sizes", "data", "many"])
            ids, texts, size, chunk = [], [], 0, chunk + 1
            return out

        for b in batches:
            for id_, text in _each(b, "id", "text"):
                if texts and size + len(text) > CHUNK:
                    yield done()
                ids.append(id_)
                texts.append(text)
                size += len(text)
        if texts:
            yield done()

    return durable(rows.mapInArrow(run, CHUNKS), "chunks", large_rows=True)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, columns of its entries as bytes), entries in order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    for lo, hi in zip(cut, np.r_[cut[1:], len(order)], strict=True):
        yield int(bucket[order[lo]]), *(_raw(c[order[lo:hi]]) for c in columns)


def _buckets_met(batches: Iterator[pa.RecordBatch], meet: Callable) -> Iterator[pa.RecordBatch]:
    """``meet(bucket, rows)`` of one bucket after another; rows come sorted by bucket, which is their first column."""
    now, held = None, []
    for b in batches:
        for row in _each(b, *b.schema.names):
            if row[0] != now and held:
                yield from meet(now, held)
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield from meet(now, held)


def _joined(rows: list[tuple], *kinds: type) -> list[np.ndarray]:
    """For rows (chunk, bytes, ...): the chunk of each entry, then its columns."""
    columns = [np.concatenate([np.frombuffer(x, k) for x in c]) for c, k in zip(list(zip(*rows, strict=True))[1:], kinds, strict=True)]
    n = [len(r[1]) // np.dtype(kinds[0]).itemsize for r in rows]
    return [np.repeat(np.array([r[0] for r in rows], np.int64), n), *columns]


class _Steps:
    """What the steps share: window length, buckets of each step, spread anchors."""

    def __init__(self, words: int, buckets: int, many: np.ndarray) -> None:
        self.words, self.buckets, self.many = words, buckets, many

    def spread(self, anchor: np.ndarray) -> np.ndarray:
        if not len(self.many):
            return np.zeros(len(anchor), bool)
        return self.many[np.minimum(np.searchsorted(self.many, anchor), len(self.many) - 1)] == anchor

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return (_mixed(key * np.uint64(ODD)) >> np.uint64(1)).astype(np.int64) % self.buckets

    def entries(self, a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first of each class, by bucket, their buckets, other occurrences): the same for the same chunk each time."""
        one, other = a.classes()
        anchor = a.anchor[one]
        bucket = self.bucket(np.where(self.spread(anchor), anchor ^ a.extent[one], anchor))
        order = np.argsort(bucket, kind="stable")
        return one[order], bucket[order], other

    def send(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(self.words)
        for b in batches:
            for chunk, ids, sizes, data in _each(b, "chunk", "ids", "sizes", "data"):
                a = reader.anchors(data, sizes, ids)
                one, bucket, _ = self.entries(a)
                rows = list(_by_bucket(bucket, a.anchor[one], a.extent[one], a.ids[a.doc[one]]))
                if rows:
                    k, anchor, extent, id_ = map(list, zip(*rows, strict=True))
                    yield _table(bucket=k, chunk=[chunk] * len(k), anchor=anchor, extent=extent, id=id_)

    def meet(self, bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A byte for each entry: 0 nothing repeats, 1 first of its class beside others, 2 repeats."""
        rows.sort(key=lambda r: r[0])
        chunk, anchor, extent, id_ = _joined(rows, np.uint64, np.uint64, np.int64)
        order = np.lexsort((chunk, id_, extent, anchor))
        new_class, new_anchor = _changes(anchor[order], extent[order]), _changes(anchor[order])
        group = np.cumsum(new_anchor) - 1
        beside = (np.bincount(group, weights=new_class)[group] > 1) | self.spread(anchor[order])
        status = np.empty(len(order), np.uint8)
        status[order] = np.where(new_class, beside, 2)
        cut = np.cumsum([0] + [len(r[1]) // 8 for r in rows])
        out = [(r[0], _raw(status[lo:hi])) for r, lo, hi in zip(rows, cut[:-1], cut[1:], strict=True)]
        yield _table(bucket=[bucket] * len(out), chunk=[c for c, _ in out], status=[s for _, s in out])

    def met(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _buckets_met(batches, self.meet)

    def extend(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket -1): starts and ends of what is settled; other rows: windows to compare."""
        reader = _Reader(self.words)
        for b in batches:
            for chunk, ids, sizes, data, replies in _each(b, "chunk", "ids", "sizes", "data", "replies"):
                a = reader.anchors(data, sizes, ids)
                one, bucket, other = self.entries(a)
                status = np.frombuffer(b"".join(r["status"] for r in sorted(replies or [], key=lambda r: r["bucket"])), np.uint8)
                if len(status) != len(one):
                    raise ValueError("a chunk was not read as it was written")
                gone = np.r_[other, one[status == 2]]
                key, anchor, id_, at, again = a.windows(one[status == 1])
                start, stop = np.r_[a.first[gone], again], np.r_[a.last[gone], again] + self.words
                rows = [(-1, b"", b"", b"", _raw(np.stack([start, stop]).astype(np.int32)))] if len(start) else []
                rows += _by_bucket(self.bucket(key), key, anchor, id_, at.astype(np.int32))
                if rows:
                    k, key, anchor, id_, at = map(list, zip(*rows, strict=True))
                    yield _table(bucket=k, chunk=[chunk] * len(k), key=key, anchor=anchor, id=id_, at=at)

    def compare(self, _bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The places, by chunk, of windows that are not the first of their kind."""
        chunk, key, anchor, id_, at = _joined(rows, np.uint64, np.uint64, np.int64, np.int32)
        order = np.lexsort((chunk, id_, anchor, key))
        again = order[~_changes(key[order], anchor[order])]
        if not len(again):
            return
        again = again[np.argsort(chunk[again], kind="stable")]
        mine = chunk[again]
        cut = np.flatnonzero(_changes(mine))
        spans = [_raw(np.stack([at[again[lo:hi]], at[again[lo:hi]] + self.words]).astype(np.int32)) for lo, hi in zip(cut, np.r_[cut[1:], len(again)], strict=True)]
        yield _table(chunk=[int(mine[i]) for i in cut], spans=spans)

    def compared(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _buckets_met(batches, self.compare)


def _marks(spans: pa.Table, n: int) -> np.ndarray:
    """Which of a chunk's words are removed."""
    change = np.zeros(n + 1, np.int64)
    for s in spans.column("spans"):
        start, stop = np.frombuffer(s.as_py(), np.int32).reshape(2, -1)
        change += np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def marked_chunks(docs: DataFrame, words: int, id_col: str, text_col: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``run`` makes of each chunk and of the ``spans``, starts and ends in words of the chunk, of what is to be removed."""
    chunks = _chunks(docs, id_col, text_col, words)
    size = chunks.agg(F.sum(F.octet_length("data").cast("bigint"))).first()[0] or 0
    many = chunks.select(F.explode("many").alias("anchor")).groupBy("anchor").count().orderBy(F.desc("count"), "anchor").limit(MOST).collect()
    # an anchor for some 50 bytes of text, 24 bytes each
    steps = _Steps(words, max(12, size * 24 // 50 // BUCKET + 1), np.sort(np.array([r["anchor"] for r in many], np.int64).astype(np.uint64)))
    texts = chunks.select("chunk", "ids", "sizes", "data")
    sent = texts.mapInArrow(steps.send, "bucket bigint, chunk bigint, anchor binary, extent binary, id binary")
    with small_batches(docs.sparkSession):
        status = durable(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(steps.met, "bucket bigint, chunk bigint, status binary"), "status")
    replies = status.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "status")).alias("replies"))
    extended = texts.join(replies.hint("shuffle_hash"), "chunk", "left").mapInArrow(steps.extend, "bucket bigint, chunk bigint, key binary, anchor binary, id binary, at binary")
    with small_batches(docs.sparkSession):
        extended = durable(extended, "windows")
    compared = extended.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(steps.compared, "chunk bigint, spans binary")
    spans = extended.where("bucket < 0").select("chunk", F.col("at").alias("spans")).unionByName(compared)
    spans = durable(spans, "spans")
    # one chunk at a time, as the caller's write runs outside small_batches
    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(run, schema)


def _kept(chunk: pa.Table, spans: pa.Table) -> Iterator[tuple[list[int], list[list[bytes]], np.ndarray, np.ndarray]]:
    """Per chunk: ids, kept words, numbers of words and of removed words of its documents."""
    for ids, bytes_, data in _each(chunk, "ids", "sizes", "data"):
        words, sizes = _split(data, bytes_)
        gone = _marks(spans, len(words))
        end = np.cumsum(sizes)
        removed = np.r_[0, np.cumsum(gone)][np.r_[end]] - np.r_[0, np.cumsum(gone)][end - sizes]
        kept = []
        for lo, hi, r in zip((end - sizes).tolist(), end.tolist(), removed.tolist(), strict=True):
            kept.append(words[lo:hi] if not r else [] if r == hi - lo else [words[i] for i in (np.flatnonzero(~gone[lo:hi]) + lo).tolist()])
        yield ids, kept, sizes, removed


def _back(ids: list[int], kind: pa.DataType) -> pa.Array:
    return pa.array([None if i == -(1 << 63) else i for i in ids], pa.int64()).cast(kind)


def substring_report(docs: DataFrame, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(chunk: pa.Table, spans: pa.Table) -> pa.Table:
        rows = []
        for ids, kept, sizes, removed in _kept(chunk, spans):
            sha = [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]
            rows.append(pa.Table.from_arrays([_back(ids, pa.int64()), pa.array(sizes), pa.array(removed), pa.array(sha, pa.string())], names=names))
        return pa.concat_tables(rows)

    return marked_chunks(docs, words, id_col, text_col, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def substring_spans(docs: DataFrame, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop: the maximal runs of removed words, in words of the document."""

    def run(chunk: pa.Table, spans: pa.Table) -> pa.Table:
        rows = []
        for ids, bytes_, data in _each(chunk, "ids", "sizes", "data"):
            _, sizes = _split(data, bytes_)
            gone = _marks(spans, int(sizes.sum()))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            edge = np.r_[True, np.diff(doc) != 0] if len(doc) else gone
            at = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]]))
            stop = np.flatnonzero(gone & np.r_[edge[1:] | ~gone[1:], True]) + 1 if len(doc) else at
            base = (np.cumsum(sizes) - sizes)[doc[at]]
            rows.append(pa.Table.from_arrays([_back([ids[i] for i in doc[at]], pa.int64()), pa.array(at - base), pa.array(stop - base)], names=["doc_id", "start", "stop"]))
        return pa.concat_tables(rows)

    return marked_chunks(docs, words, id_col, text_col, run, "doc_id bigint, start bigint, stop bigint")


def drop_substrings(docs: DataFrame, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, texts that lose words as their kept words joined by a space; rows of equal id and text all lose what the first of them loses."""
    key, cut = fresh(docs, "text_key"), fresh(docs, "cut_text")

    def run(chunk: pa.Table, spans: pa.Table) -> pa.Table:
        rows = []
        for data, bytes_, (ids, kept, _, removed) in zip(chunk.column("data").to_pylist(), chunk.column("sizes").to_pylist(), _kept(chunk, spans), strict=True):
            end = np.cumsum(bytes_)
            sha = [hashlib.sha256(data[z - n : z]).hexdigest() for n, z in zip(bytes_, end, strict=True)]
            texts = [b" ".join(k) if r else None for k, r in zip(kept, removed, strict=True)]
            rows.append(pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "sha", "cut"]))
        return pa.concat_tables(rows)

    rows = marked_chunks(docs, words, id_col, text_col, run, "id bigint, sha string, cut string")
    # the first of repeated rows has lost least
    least = F.when(F.count("cut") == F.count("*"), F.max_by("cut", F.length("cut")))
    texts = durable(rows.groupBy("id", "sha").agg(least.alias("cut")).where("cut is not null").select(F.struct("id", "sha").alias(key), F.col("cut").alias(cut)), "cut-texts")
    own = F.struct(_id(id_col).alias("id"), F.sha2(plain_text(text_col).cast("binary"), 256).alias("sha"))
    joined = docs.withColumn(key, own).join(texts, key, "left")
    return joined.select(*[(F.coalesce(F.col(cut), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
