"""Language-model scoring with a hashed maximum-entropy model (operator 10).

The probability of a token is factored by class: P(class | history) P(token | class, history), each a softmax over hashed features of the history: the
previous token, the previous two, and the token before the previous one (a skip). The most frequent tokens have a class each; the next ones are grouped, by their
endings, into classes of ``MEMBERS`` tokens, among which the second softmax decides (its features are hashed together with the class); all others are in the class of
their last two bytes, if these are among the most frequent endings, or in one class for the rest. Below these last classes stands a tree of ``MEMBERS`` branches a node: a token's
way is given by digits of its hash, and at each node a third softmax decides, from features that are hashed together with the node. The tree is as deep as the training
vocabulary needs for some ``LEAF`` tokens a leaf, up to ``DEPTH`` levels (221,184 leaves). In a leaf a token has its share of the leaf in training; the class's share of
tokens seen once is set aside for unknown tokens, which do not enter the tree. So every known token's probability depends on its history, and no task needs the vocabulary: a bitmap
by hash (16 bits a token, ``MOST_BITS`` at most) tells known tokens, and each leaf has room for one of those that it takes for known by mistake.

Weights come from distributed gradient updates in ``ROUNDS`` synchronous rounds, each over its own part of the training documents: small partitions are put together to
shards of some megabytes, every shard runs adaptive gradient steps from the shared weights, and each row of weights moves by the mean of the shards' steps, weighted by
how often the shards met the feature. Where they met it seldom, the steps are lengthened by up to the root of the number of shards, as steps over all gradients would be (``SELDOM``). So the number of shards follows from the text, not from the partitions, and no text shuffles. The table of
weights grows with the training tokens up to a bound. Texts are scored in sparse numpy batches.

Token counts cover all training documents. Each batch of documents is one chunk with an inverted index: a row for each distinct token holds its training count there
and its postings (place in the chunk, occurrences). Counts are summed by token, joined back to the postings, and summed by document, so no task needs the vocabulary
and what shuffles are distinct tokens of chunks, not tokens.

Defined cases: null and empty texts are one end token; ``doc_id`` may have any type, a null one counts as the empty id (remainder 0, for training); repeated rows are all
returned and counted; without training documents the counts are zero and the class weights stay uniform; an empty table gives an empty result;
other columns are ignored. Very long texts are part of one chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK as BLOCK_BITS
from .common import durable, filter_bits, plain_text

#: Folds, the held-out remainder.
FOLDS, HELD_OUT = 7, 2
#: Classes of one token; classes of several, and tokens in each; classes of frequent endings; one more class takes the rest.
HEADS, GROUPS, MEMBERS, ENDINGS = 8, 8, 24, 15
#: Tokens wanted in a leaf below the other classes, levels of branches at most.
LEAF, DEPTH = 8, 3
#: A feature that shards met so often is moved half way between the mean of their steps and what their gradients together would move it.
SELDOM = 1000.0
#: Hashed feature slots of each template: one for so many training tokens, a power of two between two bounds.
TOKENS_A_SLOT, LEAST_SLOTS, MOST_SLOTS = 1 << 13, 1 << 13, 1 << 16
#: Templates, tokens of a gradient step, step size, first sum of squares by round, and for the tree, whose branches say less.
TEMPLATES, STEP, RATE, SQUARES, TREE_SQUARES = 3, 16384, 0.15, (1e-2, 0.3), (3.0, 3.0)
#: Synchronous rounds, least bytes of text in a shard of one round, tokens scored at a time.
ROUNDS, SHARD, SCORED = len(SQUARES), 48 << 20, 4096
#: Bytes of text in a chunk at most (a longer document is a chunk of its own), documents in a chunk, bytes of text trained or scored at a time.
CHUNK, CHUNK_DOCS, AT_ONCE = 20 << 20, 1 << 16, 2 << 20
#: Sums of documents that a task holds.
HELD = 2_000_000
#: Largest exponent of a softmax, rows of a run that are summed one after the other, rows that are worked on while they are in the cache.
LARGEST, PIECE, NEAR = 60.0, 8, 1024
#: Rows of a block of weights.
BLOCK = 256
END = b"\n"  # no word, so it can stand for the end of a text


@dataclass(frozen=True)
class Table:
    """Tokens by class: ``heads`` are classes 0 and up, then come ``groups``, then ``endings``, then the rest."""

    heads: list[bytes]
    groups: list[list[bytes]]
    endings: list[bytes]
    depth: int = 0

    @property
    def leaves(self) -> int:
        return (self.classes - self.other) * MEMBERS**self.depth

    def ways(self, kind: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(node, branch) on each level for tokens of the other classes, by their hash; at last (leaf, nothing)."""
        at, first = kind - self.other, 0
        for level in range(self.depth):
            branch = code // MEMBERS**level % MEMBERS
            yield first + at, branch
            first += (self.classes - self.other) * MEMBERS**level
            at = at * MEMBERS + branch
        yield at, at[:0]

    def leaf(self, kind: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The leaf of each token, -1 for those with a class or place of their own, and for unknown ones (code -1)."""
        out = np.full(len(kind), -1)
        at = np.flatnonzero((kind >= self.other) & (code >= 0))
        for found, _ in self.ways(kind[at], code[at]):
            out[at] = found
        return out

    @property
    def classes(self) -> int:
        return self.other + len(self.endings) + 1

    @property
    def other(self) -> int:
        """The first class whose tokens are told by their share."""
        return len(self.heads) + len(self.groups)

    def members(self) -> dict[bytes, tuple[int, int]]:
        """Class and place there of each listed token."""
        return {w: (k, i) for k, group in enumerate([[w] for w in self.heads] + self.groups) for i, w in enumerate(group)}


def has_bit(bits: np.ndarray, hashed):
    """Whether the bit of a hash (or of each) is set; ``bits`` are bytes, a power of two of them, the lowest bit first."""
    at = hashed & (8 * len(bits) - 1)
    return bits[at >> 3] >> (at & 7) & 1 == 1


def known_bits(counts: DataFrame) -> np.ndarray:
    """The bitmap of the hashes of ``counts`` (word): one row of 4096 bytes for each block, of which there are 8192 at most."""
    blocks = filter_bits(counts.count()) // BLOCK_BITS
    h = F.crc32("word")
    block = F.pmod(F.floor(h / BLOCK_BITS), F.lit(blocks)).cast("int")
    rows = counts.select(block.alias("block"), (h % BLOCK_BITS).alias("bit")).groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()
    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for r in rows:
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


class Classes:
    """Class, place in the class (else its hash) and hash of tokens, all tokens of a chunk at once; nothing is kept from one chunk to the next."""

    def __init__(self, table: Table, known: np.ndarray | None = None):
        self.bits = known
        listed = table.members()
        self.listed = pa.array(list(listed), pa.binary())
        self.own = np.array(list(listed.values()), np.int64).reshape(-1, 2)
        self.endings = pa.array(table.endings, pa.binary())
        self.rest, self.other = table.classes - 1, table.other

    def forget(self) -> None:
        """No chunk leaves anything behind."""

    def columns(self, words: pa.Array) -> np.ndarray:
        """class, place, hash of each of ``words``."""
        out = np.empty((3, len(words)), np.int64)
        out[2] = np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words))
        out[1] = out[2]
        ending = pc.fill_null(pc.index_in(pc.binary_slice(words, -2), value_set=self.endings), -1).to_numpy()
        out[0] = np.where(ending < 0, self.rest, ending + self.other)
        place = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy()
        at = np.flatnonzero(place >= 0)
        out[:2, at] = self.own[place[at]].T
        if self.bits is not None:
            out[1, (out[0] >= self.other) & ~has_bit(self.bits, out[2])] = -1
        return out


def _tokens(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens of all texts, the end last; code of each token in order; tokens of each text). A-Z are lower-cased, ASCII white space separates."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(b.column("text").cast(pa.string(), safe=False)))
    some = pc.binary_length(text).to_numpy() > 0
    text = text.filter(pa.array(some))  # one name: of large chunks only the last copy is held
    text = pc.ascii_split_whitespace(text)
    lengths = np.ones(len(some), np.int64)
    lengths[some] += pc.list_value_length(text).to_numpy()
    found = text.flatten().dictionary_encode()
    del text
    words = found.dictionary.cast(pa.binary())
    code = np.full(lengths.sum(), len(words), np.int64)
    inner = np.ones(len(code), bool)
    inner[np.cumsum(lengths) - 1] = False
    code[inner] = found.indices.to_numpy()
    return pa.concat_arrays([words, pa.array([END], pa.binary())]), code, lengths


def _rows(docs: DataFrame) -> DataFrame:
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT
    return docs.select("doc_id", F.xxhash64(plain_text()).alias("text_key"), held.alias("held_out"), plain_text().cast("binary").alias("text"))


def _chunks(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.binary_length(b.column("text")).to_numpy().astype(np.int64)
        group = np.cumsum(sizes) // most + np.arange(b.num_rows) // CHUNK_DOCS  # a new chunk where either count is full
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield b.slice(lo, hi - lo)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, word, n (training count), postings (document << 16 | occurrences, as uint32); the documents of a chunk stand in a row of their own."""
    names = ["chunk", "word", "n", "postings", "docs"]
    base = TaskContext.get().partitionId() << 24
    for k, b in enumerate(_chunks(batches, CHUNK)):
        listing = pa.list_(pa.struct([("doc_id", b.schema.field("doc_id").type), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())]))
        words, key, lengths = _tokens(b)
        key <<= 16
        key |= np.repeat(np.arange(b.num_rows, dtype=np.uint16), lengths)
        key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[starts, len(key)])
        key = key[starts]
        while (times > 65535).any():  # an entry holds 16 bits
            over = times > 65535
            key, times = np.r_[key, key[over]], np.r_[np.minimum(times, 65535), times[over] - 65535]
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        word, doc = (key >> 16).astype(np.int32), (key & 65535).astype(np.uint16)
        del key, starts
        train = ~b.column("held_out").to_numpy(zero_copy_only=False)
        n = np.bincount(word, weights=times * train[doc], minlength=len(words)).astype(np.int64)
        entries = np.bincount(word, minlength=len(words))
        post = (doc.astype("<u4") << 16 | times.astype("<u4")).tobytes()
        blobs = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.r_[0, np.cumsum(entries) * 4].astype(np.int32).tobytes()), pa.py_buffer(post)])
        chunk = pa.array(np.full(len(words), base + k))
        yield pa.RecordBatch.from_arrays([chunk, words, pa.array(n), blobs, pa.nulls(len(words), listing)], names=names)
        listed = [dict(zip(("doc_id", "text_key", "held_out", "n_tokens"), x, strict=True)) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_key", "held_out")), lengths.tolist(), strict=True)]
        del words, word, doc, times, n, entries, post, blobs
        pa.default_memory_pool().release_unused()  # else the worker keeps what the largest chunk took, also in later stages
        yield pa.RecordBatch.from_arrays([chunk.slice(0, 1), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([listed], listing)], names=names)


def _histories(b: pa.RecordBatch, memo: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each token, place in the class or else its hash, hashed history of each token by template, tokens of each document)."""
    words, codes, lengths = _tokens(b)
    kind, member, hashed = memo.columns(words).take(codes, axis=1)
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    one, two = np.r_[0, hashed[:-1]], np.r_[0, 0, hashed[:-2]][: len(hashed)]
    one[first] = 0
    two[first] = 0
    two[(first + 1)[lengths > 1]] = 0
    history = np.empty((TEMPLATES, len(hashed)), np.uint32)  # hashes have 32 bits
    history[0], history[2] = one, two
    one *= 0x9E3779B1
    two *= 0x85EBCA77
    one += two
    one &= 0xFFFFFFFF
    history[1] = one
    return kind, member, history, lengths


def _slots(history: np.ndarray, slots: int, salt: np.ndarray | int = 0) -> np.ndarray:
    """Rows of the table of weights, by template; ``slots`` is a power of two."""
    return ((((history + np.asarray(salt) * 0x27D4EB2F & 0xFFFFFFFF) * 0x2C1B3C6D >> 13) & (slots - 1)) + slots * np.arange(TEMPLATES)[:, None]).astype(np.int32)


def _powers(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Exponents of a softmax, kept between ``-LARGEST`` and ``LARGEST``, so that none overflows."""
    z = weights.take(slots[0], axis=0)
    for s in slots[1:]:
        z += weights.take(s, axis=0)
    z += bias
    return np.clip(z, -LARGEST, LARGEST, out=z)


def _log_chosen(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log probability of what was chosen for each token."""
    z = _powers(weights, bias, slots)
    own = z[np.arange(len(chosen)), chosen]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _run_sums(rows: np.ndarray, order: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs in some order, their sums): ``rows`` are taken in ``order``, each run is that many of them; runs are summed in pieces of ``PIECE`` rows, then the pieces likewise."""
    while True:
        ends = np.cumsum(times)
        first, size = ends - times, times
        if times.max(initial=0) > PIECE:
            pieces = (times + (PIECE - 1)) // PIECE
            first = np.repeat(first - PIECE * (np.cumsum(pieces) - pieces), pieces) + PIECE * np.arange(pieces.sum())
            size = np.minimum(np.repeat(ends, pieces) - first, PIECE)
        size = size.astype(np.int8)
        by = np.argsort(-size, kind="stable")  # the longest first, so that all that have a next row stand in front
        first = first[by]
        sums = rows.take(order[first], axis=0)
        for k, n in enumerate(np.cumsum(np.bincount(size, minlength=PIECE + 1)[::-1])[::-1][2:].tolist(), 1):
            if n:
                sums[:n] += rows.take(order[first[:n] + k], axis=0)
        if len(by) == len(times):
            return by, sums
        rows, order, times = sums, np.empty_like(by), pieces
        order[by] = np.arange(len(by))


def _gradient_step(chosen: np.ndarray, slots: np.ndarray, weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, seen: np.ndarray) -> None:
    """One adaptive gradient step over some tokens, in place; ``seen`` counts how often each row was met."""
    g = np.empty((len(chosen), weights.shape[1]), weights.dtype)
    ones = np.ones(weights.shape[1], weights.dtype)
    for s in range(0, len(g), NEAR):  # what is near is still in the cache
        part = _powers(weights, bias[s : s + NEAR] if bias.ndim > 1 else bias, slots[:, s : s + NEAR])
        np.exp(part, out=part)
        np.divide(part, (part @ ones)[:, None], out=g[s : s + NEAR])
    g[np.arange(len(chosen)), chosen] -= 1
    for rows in slots:
        order = np.argsort(rows)
        own = rows[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        times = np.diff(np.r_[starts, len(own)])
        by, total = _run_sums(g, order, times)
        own = own[starts[by]]
        seen[own] += times[by]
        for s in range(0, len(own), NEAR):
            at, change = own[s : s + NEAR], total[s : s + NEAR]
            square = squares.take(at, axis=0)
            square += change * change
            squares[at] = square
            np.sqrt(square, out=square)
            change /= square
            change *= RATE
            after = weights.take(at, axis=0)
            after -= change
            weights[at] = after


@dataclass
class Model:
    """Table of tokens, feature slots of a template, start values of the softmaxes (by class; by class and member, then by node and branch), the weights of the three."""

    table: Table
    slots: int
    class_bias: np.ndarray
    member_bias: np.ndarray
    weights: list[np.ndarray]

    @classmethod
    def start(cls, table: Table, counts: dict[bytes, int], mass: np.ndarray, leaves: np.ndarray | None = None) -> Model:
        """Without features, from training counts of the listed tokens, of the classes and of the leaves."""
        n = mass.sum()
        slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (max(int(n) // TOKENS_A_SLOT, 1) - 1).bit_length()))
        member_bias = np.full((table.classes, MEMBERS), -1e4, np.float32)
        for w, (k, i) in table.members().items():
            member_bias[k, i] = np.log(counts[w] / mass[k])
        for level in range(table.depth):
            below = leaves.reshape((table.classes - table.other) * MEMBERS**level, MEMBERS, -1).sum(axis=2) + 0.5
            member_bias = np.concatenate([member_bias, np.log(below / below.sum(axis=1, keepdims=True)).astype(np.float32)])
        weights = [np.zeros((slots * TEMPLATES, width), np.float32) for width in (table.classes, MEMBERS, *[MEMBERS] * (table.depth > 0))]
        return cls(table, slots, np.log((mass + 1) / (n + table.classes)).astype(np.float32), member_bias, weights)

    def choices(self, kind: np.ndarray, member: np.ndarray, history: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(which softmax, tokens concerned, choice, feature slots, bias): the class of all, then the token in classes of several, then the branch on each level below the other classes."""
        yield 0, np.arange(len(kind)), kind, _slots(history, self.slots), self.class_bias
        at = np.flatnonzero((kind >= len(self.table.heads)) & (kind < self.table.other))
        yield 1, at, member[at], _slots(history[:, at], self.slots, kind[at] + 1), self.member_bias.take(kind[at], axis=0)
        if self.table.depth:
            at = np.flatnonzero((kind >= self.table.other) & (member >= 0))
            own = history[:, at]
            for node, branch in self.table.ways(kind[at], member[at]):
                if len(branch):
                    row = self.table.classes + node
                    yield 2, at, branch, _slots(own, self.slots, row + 1), self.member_bias.take(row, axis=0)

    def log_probability(self, kind: np.ndarray, member: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Natural log of P(class | history), times P(token | class, history) in classes of several and P(leaf | class, history) in others."""
        out = np.zeros(len(kind))
        for k, at, chosen, slots, bias in self.choices(kind, member, history):
            if len(at):
                out[at] += _log_chosen(self.weights[k], bias, slots, chosen)
        return out


def frequent(counts: DataFrame) -> tuple[Table, dict[bytes, int]]:
    """The tokens and endings that have classes, by training count (their number is bounded), and the counts of these tokens."""
    top = [(bytes(r.word), r.c) for r in counts.orderBy(F.desc("c"), "word").limit(HEADS + GROUPS * MEMBERS).collect()]
    rest = sorted((w for w, _ in top[HEADS:]), key=lambda w: (w[::-1], w))
    listed = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in top], "word binary")
    tails = counts.join(F.broadcast(listed), "word", "left_anti").groupBy(F.expr("substring(word, -2, 2)").alias("e")).agg(F.sum("c").alias("c"))
    endings = [bytes(r.e) for r in tails.orderBy(F.desc("c"), "e").limit(ENDINGS).collect()]
    spread = counts.count() / (LEAF * (len(endings) + 1))
    depth = min(DEPTH, max(0, int(np.floor(np.log(max(spread, 1)) / np.log(MEMBERS) + 0.5))))
    return Table([w for w, _ in top[:HEADS]], [rest[i : i + MEMBERS] for i in range(0, len(rest), MEMBERS)], endings, depth), dict(top)


def ending_class(table: Table) -> Column:
    """The class of the column ``word`` if it is not listed, as Classes gives it."""
    rest = F.lit(table.classes - 1)
    if not table.endings:
        return rest
    return F.coalesce(F.create_map(*[F.lit(x) for i, w in enumerate(table.endings, table.other) for x in (w.hex().upper(), i)])[F.substring(F.hex("word"), -4, 4)], rest)


def leaf_of(table: Table) -> Column:
    """The leaf of the column ``word`` if it is not listed, as Table gives it."""
    at = (ending_class(table) - table.other).cast("bigint")
    for level in range(table.depth):
        at = at * MEMBERS + F.expr(f"(crc32(word) div {MEMBERS**level}) % {MEMBERS}")
    return at


def classified(counts: DataFrame, table: Table) -> DataFrame:
    """``counts`` with the class ``k`` of each word, and its ``leaf`` (-1 for listed ones)."""
    listed = counts.sparkSession.createDataFrame([(bytearray(w), k) for w, (k, _) in table.members().items()], "word binary, listed int")
    return counts.join(F.broadcast(listed), "word", "left").withColumns({"k": F.coalesce("listed", ending_class(table)), "leaf": F.when(F.col("listed").isNull(), leaf_of(table)).otherwise(-1)}).drop("listed")


def train_weights(rows: DataFrame, model: Model, shards: int) -> None:
    """Trains the weights of ``model`` on the training documents, in ``shards`` shards at most in each round."""
    sizes = [len(w) for w in model.weights]

    def train(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = Classes(model.table)
            weights, squares = [w.copy() for w in model.weights], [np.full_like(w, (TREE_SQUARES if k == 2 else SQUARES)[turn]) for k, w in enumerate(model.weights)]
            seen = [np.zeros(n) for n in sizes]
            for b in _chunks(batches):
                kind, member, history, _ = _histories(b, memo)
                for s in range(0, len(kind), STEP):
                    part = kind[s : s + STEP], member[s : s + STEP], history[:, s : s + STEP]
                    for k, at, chosen, slots, bias in model.choices(*part):
                        if len(at):
                            _gradient_step(chosen, slots, weights[k], squares[k], bias, seen[k])
            for k, (w, n) in enumerate(zip(weights, seen, strict=True)):
                for s in range(0, len(w), BLOCK):
                    if (part := n[s : s + BLOCK]).any():
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), pa.array([part.astype("<f4").tobytes()], pa.binary()), pa.array([w[s : s + BLOCK].astype("<f2").tobytes()], pa.binary())], names=names)

        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for k, s, n, w in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                n = np.frombuffer(n, "<f4").astype(np.float64)[:, None]
                old = sums.setdefault((k, s), [0.0, 0.0, 0.0])
                old[0] = old[0] + n
                old[2] = old[2] + n * n
                old[1] = old[1] + n * np.frombuffer(w, "<f2").astype(np.float64).reshape(len(n), -1)
        for (k, s), (n, w, squared) in sums.items():
            before = model.weights[k][s : s + BLOCK]
            shards = n * n / np.maximum(squared, 1)  # as many even ones
            longer = 1 + (np.sqrt(np.maximum(shards, 1)) - 1) * SELDOM / (SELDOM + squared / np.maximum(n, 1))
            mean = np.where(n > 0, before + longer * (w / np.maximum(n, 1) - before), before)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), pa.array([b""], pa.binary()), pa.array([mean.astype("<f4").tobytes()], pa.binary())], names=names)

    names, schema = ["part", "row", "seen", "weights"], "part int, row int, seen binary, weights binary"
    turn_of = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text_key"), F.lit(ROUNDS))
    for turn in range(ROUNDS):
        own = rows.where(~F.col("held_out") & (turn_of == turn)).select("text").coalesce(shards)
        for r in own.mapInArrow(train(turn), schema).repartition("part", "row").mapInArrow(merge, schema).collect():  # the table of weights, which is bounded
            width = model.weights[r.part].shape[1]
            model.weights[r.part][r.row : r.row + BLOCK] = np.frombuffer(r["weights"], "<f4").reshape(-1, width)


@dataclass
class Fitted:
    """A trained model with the counts behind it: bitmap of known tokens (None without a tree); by leaf, the last for tokens without one, room for unknown tokens and log10 of one over all; by class, log10 of the shares of known and unknown tokens."""

    model: Model
    n_train: int
    types: int
    bits: np.ndarray | None
    room: np.ndarray
    within: np.ndarray
    shares: np.ndarray


def fit(rows: DataFrame, counts: DataFrame) -> tuple[Fitted, DataFrame]:
    """The model, and ``counts`` (word, c: of all training tokens) with the class ``k`` and the ``leaf`` of each word."""
    table, listed_counts = frequent(counts)
    counts = classified(counts, table)
    sized = counts.groupBy("k", "leaf").agg(F.sum("c").alias("c"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("once")).collect()  # one row for each class or leaf, whose number is bounded
    mass, once, leaves, types = np.zeros(table.classes), np.zeros(table.classes), np.zeros(table.leaves), 0
    for r in sized:
        mass[r.k], once[r.k], types = mass[r.k] + r.c, once[r.k] + r.once, types + r.types
        if r.leaf >= 0:
            leaves[r.leaf] = r.c
    tree, other = table.depth > 0, np.arange(table.classes) >= table.other
    room = np.r_[np.ones(table.leaves) if tree else once[other] + 1, 0.0]
    within = np.r_[-np.log10(leaves + room[:-1]), 0.0]
    whole = np.log10(mass + once + 1)
    shares = np.where(other, [np.log10(np.maximum(mass, 1e-300)) - whole, np.log10(once + 1) - whole], 0.0) if tree else np.zeros((2, table.classes))
    model = Model.start(table, listed_counts, mass, leaves)
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    train_weights(rows, model, max(1, size // (SHARD * ROUNDS)))
    return Fitted(model, int(mass.sum()), types, known_bits(counts) if tree else None, room, within, shares), counts


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = _rows(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    listing = f"docs array<struct<doc_id:{kind},text_key:bigint,held_out:boolean,n_tokens:bigint>>"
    index = durable(rows.mapInArrow(_index, f"chunk bigint, word binary, n bigint, postings binary, {listing}"), "index")
    fitted, counts = fit(rows, durable(index.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts"))
    model, table, bits, room, within, shares = fitted.model, fitted.model.table, fitted.bits, fitted.room, fitted.within, fitted.shares

    def class_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Classes(table, bits)
        for b in _chunks(batches):
            k, member, history, lengths = _histories(b, memo)
            logs = np.empty(len(k))
            for s in range(0, len(k), SCORED):
                logs[s : s + SCORED] = model.log_probability(k[s : s + SCORED], member[s : s + SCORED], history[:, s : s + SCORED])
            total = np.add.reduceat(logs / np.log(10) + within[table.leaf(k, member)] + shares[(member < 0).astype(int), k], np.r_[0, np.cumsum(lengths)[:-1]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(total)], names=["doc_id", "text_key", "class_score"])

    def token_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by document, gathered over the task and handed on when there are many."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, *(np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(keys)) for k in (1, 2, 3))

        def handed(keys: np.ndarray, known: np.ndarray, logs: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys >> 16, keys & 65535, known.astype(np.int64), logs, shares)], names=["chunk", "doc", "n_known", "logs", "shares"])

        for b in batches:
            if not b.num_rows:
                continue
            c = b.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
            leaf = b.column("leaf").to_numpy(zero_copy_only=False)
            if bits is not None:
                leaf = np.where((c > 0) | has_bit(bits, b.column("h").to_numpy(zero_copy_only=False)), leaf, -1)
            spare = room[leaf]
            blob = b.column("postings")
            edges = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset :][: b.num_rows + 1]
            sizes = np.diff(edges) // 4
            post = np.frombuffer(blob.buffers()[2], "<u4", count=int(sizes.sum()), offset=int(edges[0]))
            times = (post & 65535).astype(np.float64)
            key = np.repeat(b.column("chunk").to_numpy(zero_copy_only=False), sizes) << 16 | (post >> 16).astype(np.int64)
            each = (c > 0) * 1.0, np.log10(c + 1), np.where(leaf >= 0, np.log10(np.maximum(np.where(c > 0, c, spare), 1e-300)), 0.0)
            held.append(summed([(key, *(times * np.repeat(x, sizes) for x in each))]))
            size += len(held[-1][0])
            if size > HELD:
                held = [summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield handed(*held[0])
                    held, size = [], 0
        if held:
            yield handed(*summed(held))

    words = index.where("word is not null").select("chunk", "word", "postings")
    # of words that training has, only whether they have a leaf matters, so that leaf and hash take no room in the shuffle
    unmet = F.col("c").isNull()
    leaf, hashed = F.when(unmet, leaf_of(table)).otherwise(F.least("leaf", F.lit(0))), F.when(unmet, F.crc32("word")).otherwise(F.lit(0))
    met = words.join(counts.hint("shuffle_hash"), "word", "left").select("chunk", "postings", F.coalesce("c", F.lit(0)).alias("c"), leaf.cast("bigint").alias("leaf"), hashed.cast("bigint").alias("h"))
    # by chunk first: else every task would hold a sum for nearly every document
    sums = met.repartition("chunk").mapInArrow(token_sums, "chunk bigint, doc bigint, n_known bigint, logs double, shares double")
    sums = sums.groupBy("chunk", "doc").agg(F.sum("n_known").alias("n_known"), F.sum("logs").alias("logs"), F.sum("shares").alias("shares"))
    listed = index.where("docs is not null").select("chunk", F.posexplode("docs").alias("doc", "d")).select("chunk", F.col("doc").cast("bigint").alias("doc"), "d.*")
    classed = rows.mapInArrow(class_scores, f"doc_id {kind}, text_key bigint, class_score double").groupBy("doc_id", "text_key").agg(F.max("class_score").alias("class_score"))
    classed = classed.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "class_score")
    full = listed.join(sums, ["chunk", "doc"]).join(classed, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")))
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(fitted.n_train + fitted.types + 1)))
    return full.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(fitted.n_train).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("class_score") + F.col("shares")).alias("score"))
