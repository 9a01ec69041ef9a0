"""Best-fit packing of token sequences in bulk-synchronous sweeps (operator 7).

Documents are tokenised where they stand and cut into pieces of at most ``capacity`` tokens. Each superstep range-sorts the open pieces and gaps, matches every piece
with its successor, the smallest gap that holds it, resolves conflicts by rank, updates the gaps and repeats until all pieces are placed. Rows move by size, by
level (see :func:`_sweep`) and by sequence; all of these are spread evenly, however many pieces share one length. The driver sees a few sums of each sweep.

Defined cases: null and empty texts are one end token; ties in length are broken by a hash of the piece; null and repeated ids are
rows of their own; an empty table gives an empty result; other columns are ignored. Very long texts are held one at a time as token arrays.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, plain_text

#: ASCII marks: neither letters, digits nor white space.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: what the vocabulary's last tokens of a word end with. Words tokenised in one go.
FINAL, JOINED = "</w>", 256
#: Words whose tokens a Python worker remembers, and bytes of text it tokenises at a time.
REMEMBERED, AT_ONCE = 600_000, 8 << 20


class WordTokens(dict):
    """Numbers words as they are met and keeps their token ids.

    The tokenizer lower-cases, and white space always ends a token, so a text's ids are those of its lower-case words in turn; marks after a last ASCII letter or
    digit are tokens of their own, so such a word is put together from two parts.
    """

    def __init__(self, path: str, end: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith(FINAL)]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pending: list[bytes | tuple[int, int]] = []
        self.known: list[tuple[int, ...]] = [(self.end,)]
        self[b"\n"] = 0  # not a word, so it can stand for the end

    def __missing__(self, word: bytes) -> int:
        stem = word.rstrip(MARKS)
        new = (self[stem], self[word[len(stem) :]]) if stem[-1:].isalnum() and len(stem) < len(word) else word
        self[word] = code = len(self)
        self.pending.append(new)
        return code

    def _plain(self, words: list[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[tuple[int, ...]]:
        """As _plain, for words that are one run of letters and so have one final token each: many words at a time, cut after final tokens."""
        ids = np.array([i for e in self.tokenizer.encode_batch_fast([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False) for i in e.ids], np.int64)
        stops = np.flatnonzero(self.final[ids]) + 1
        if len(stops) != len(words) or not words:
            return self._plain(words)
        flat = ids.tolist()
        return [tuple(flat[a:z]) for a, z in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def resolve(self) -> None:
        """Token ids of the words met since the last time."""
        words = [w.decode() for w in self.pending if isinstance(w, bytes)]
        letters = [w.isalpha() and w.lower().isalpha() for w in words]
        parts = iter(self._letters([w for w, x in zip(words, letters, strict=True) if x])), iter(self._plain([w for w, x in zip(words, letters, strict=True) if not x]))
        kind = iter(letters)
        for w in self.pending:
            self.known.append(next(parts[0] if next(kind) else parts[1]) if isinstance(w, bytes) else self.known[w[0]] + self.known[w[1]])
        self.pending = []
        self.sizes = np.fromiter(map(len, self.known), np.int64, len(self.known))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = np.fromiter(chain.from_iterable(self.known), np.uint32, int(self.sizes.sum()))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, each with its end token; tokens of each text)."""
        if len(self) > REMEMBERED:
            self.forget()
        codes, words = [], []
        for t in texts:
            w = t.lower().split()
            w.append(b"\n")
            codes.append(np.fromiter(map(self.__getitem__, w), np.int64, len(w)))
            words.append(len(w))
        if self.pending or len(self) == 1:
            self.resolve()
        code = np.concatenate(codes)
        size = self.sizes[code]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[code] - stop + size, size) + np.arange(stop[-1])]
        return ids, np.diff(np.r_[0, stop[np.cumsum(words) - 1]])


_WORKER: dict[tuple, WordTokens] = {}  # one for each Python worker


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 (and ids, if asked for) of every piece of every document.

    ``tokenizer`` is a path, or a file name of the installed public tokenizers.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), plain_text().cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, end) not in _WORKER:
            _WORKER[tokenizer, end] = WordTokens(tokenizer, end)
        model = _WORKER[tokenizer, end]
        for b in batches:
            texts = b.column("text").to_pylist()
            cut = np.cumsum([len(t) for t in texts]) // AT_ONCE
            for g in np.unique(cut):
                lo, hi = (int(x) for x in (np.searchsorted(cut, g), np.searchsorted(cut, g, "right")))
                ids, sizes = model.encode(texts[lo:hi])
                pieces = -(-sizes // capacity)
                at = np.repeat(np.arange(lo, hi), pieces)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, np.repeat(sizes, pieces) - start)
                first = np.repeat(np.cumsum(sizes) - sizes, pieces) + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(first.tolist(), length.tolist(), strict=True)]
                taken = pa.array(at)
                out = [b.column("doc_id").take(taken), b.column("row").take(taken), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def _sweep(items: DataFrame, gaps: DataFrame, longest: int) -> DataFrame:
    """kind, id, size, seq: the open gaps (kind 0) and pieces (kind 1) of one superstep; ``seq`` is the sequence that a piece got, or null.

    Gaps and pieces are range-sorted together, large first. Each piece takes the nearest gap before it that no larger piece took: its best fit. As with
    brackets, that gap is the last one on the same level, where gaps lead one level up and pieces one down; of several pieces with the same successor
    the first by rank takes it, the others go on. A gap offers itself as so many equal parts as it holds of the longest piece.
    """
    parts = F.expr(f"cast(greatest(1, size div {longest}) as int)")
    opened = gaps.withColumn("parts", parts).select(F.lit(0).alias("kind"), F.col("seq").alias("id"), F.floor(F.col("size") / F.col("parts")).cast("bigint").alias("size"), F.explode(F.sequence(F.lit(1), "parts")).alias("part"))
    events = opened.unionByName(items.select(F.lit(1).alias("kind"), "id", "size", F.lit(0).alias("part")))
    order = F.desc("size"), F.col("kind"), F.xxhash64("id", "part"), F.col("id"), F.col("part")  # the hash cuts lengths that very many pieces have

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds place and level within the task."""
        task, at, level = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            if b.num_rows:
                up = 1 - 2 * b.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
                after = level + np.cumsum(up)
                own = np.where(up > 0, after, after + 1)  # a gap opens the level that the piece closes
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), b.column("size"), pa.array(np.full(b.num_rows, task)), pa.array(at + np.arange(b.num_rows)), pa.array(own), pa.array(up)], names=names)
                at, level = at + b.num_rows, int(after[-1])

    names = ["kind", "id", "size", "task", "at", "own", "up"]
    walked = durable(events.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, "kind int, id bigint, size bigint, task bigint, at bigint, own bigint, up bigint"), "walked")
    tasks = walked.groupBy("task").agg(F.sum("up").alias("up"))  # one row for each task
    before = tasks.select("task", F.coalesce(F.sum("up").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    levels = walked.join(before, "task").withColumn("level", F.col("own") + F.col("before"))
    # a level is met at most twice for each length, so its rows are bounded by the capacity
    met = Window.partitionBy("level").orderBy("task", "at")
    last = F.when(F.lag("kind").over(met) == 0, F.lag("id").over(met))
    return levels.select("kind", "id", "size", F.when(F.col("kind") == 1, last).alias("seq"))


def best_fit(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (column length among others) with sequence_id and offset.

    Pieces of more than half the capacity open a sequence each, and as many more are opened as the rest needs at least. Then sweeps match pieces to gaps and update the
    gaps; where no gap holds the longest pieces, the sequences they need at least are opened. What reaches the driver is a few sums of each sweep.
    """
    spark = pieces.sparkSession
    rid = fresh(pieces, "piece_row")
    numbered = durable(pieces.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(rid).alias("id"), F.col("length").alias("size"))
    placed = [rows.where(F.col("size") * 2 > capacity).select("id", F.col("id").alias("seq"), F.lit(0).alias("turn"))]
    items = rows.where(F.col("size") * 2 <= capacity)
    gaps = rows.where(F.col("size") * 2 > capacity).select(F.col("id").alias("seq"), (capacity - F.col("size")).alias("size"))
    opened, turn = 0, 0

    def fresh_gaps(tokens: int) -> DataFrame:
        nonlocal opened
        more = -(-tokens // capacity)
        opened += more
        return spark.range(opened - more, opened).select((-1 - F.col("id")).alias("seq"), F.lit(capacity).cast("bigint").alias("size"))

    free = gaps.agg(F.sum("size")).first()[0] or 0
    state = items.agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.max("size").alias("most"), F.min("size").alias("least")).first()
    gaps = gaps.unionByName(fresh_gaps(max(0, (state.tokens or 0) - free)))
    while state.n:
        turn += 1
        met = durable(_sweep(items, gaps.where(F.col("size") >= state.least), state.most), "swept")
        found = met.where("seq is not null").select("id", "seq", F.lit(turn).alias("turn"), "size")
        placed.append(found.drop("size"))
        items = met.where("kind = 1 and seq is null").select("id", "size")
        taken = gaps.where(F.col("size") >= state.least).unionByName(found.select("seq", (-F.col("size")).alias("size")))
        gaps = durable(taken.groupBy("seq").agg(F.sum("size").alias("size")), "gaps")
        widest = gaps.agg(F.max("size")).first()[0] or 0
        too_long = F.sum(F.when(F.col("size") > widest, F.col("size")))
        state = items.agg(F.count("*").alias("n"), F.max("size").alias("most"), F.min("size").alias("least"), F.coalesce(too_long, F.lit(0)).alias("tokens")).first()
        if state.tokens:
            gaps = gaps.unionByName(fresh_gaps(state.tokens))
    where = reduce(DataFrame.unionByName, placed)
    where = where.select(F.col("id").alias(rid), F.col("seq").alias("sequence_id"), F.col("turn").alias(turn_of := fresh(numbered, "turn")))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(turn_of, rid).rowsBetween(Window.unboundedPreceding, -1))
    return numbered.join(where, rid).withColumn("offset", F.coalesce(before, F.lit(0)).cast("bigint")).select(*[f"`{c}`" for c in pieces.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return best_fit(token_pieces(docs, tokenizer, capacity=capacity), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
