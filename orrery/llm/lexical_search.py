"""Ranked lexical search by three phases of a uniform threshold over term-partitioned postings (operator 13).

The index holds one list for each term that a query uses: postings (term, row, impact), range-partitioned and sorted by term and falling impact, so a long
list spreads over many files. A posting adds weight x impact to its document's score for an item; the weight belongs to item and term. For each item:

1. the first ``k`` postings of each of its m lists, summed by document, give a lower bound t of the k-th best score;
2. every list gives all postings that add t/m or more. A document that no list gives adds less than t in total and is out. The sums are lower bounds,
   and with less than t/m for each list that did not give the document they are upper bounds; documents whose upper bound is below the k-th best lower bound are out;
3. for those that remain, all their postings are looked up and summed exactly.

Step 2 gathers what the lists give by document (a shuffle of light rows), twice: a task sums one document after another and gives its k best lower bounds, then, with the
k-th best of all tasks, candidates only. Queries are taken in
blocks of ``BLOCK`` (item, term) rows, so what goes to the tasks is bounded; the index is built once for all of them. Postings of terms that no query uses are mostly
left out by a bitmap of query terms (16 bits a term, 32 MB at most); what it lets through in error makes lists that nobody reads.

Terms: maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

Defined cases: null and empty texts have no terms: as documents they do not count and are not found, as items they find nothing; documents of equal score and id
are ranked by their place in the table, a null id before all others; repeated rows are documents of their own, repeated items items of their own; an empty table on either side gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK as BITMAP
from .common import durable, filter_bits, plain_text

#: Rows (item, term) of the queries that are taken at once.
BLOCK = 200_000
#: Candidates that a task holds before it gives them on.
HELD = 500_000
#: Bytes that separate terms become spaces, A-Z become a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass(frozen=True)
class Index:
    """postings (term, row, impact), documents (row, doc_id), lists (term, df, best): written tables; n documents with terms."""

    postings: DataFrame
    documents: DataFrame
    lists: DataFrame
    n: int


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number of its own), item_id, term, times: written."""
    kind = items.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            counts = [Counter(terms_of(t)) for t in b.column("text").to_pylist()]
            n = [len(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(at, at + len(n)), n)), b.column("item_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([t.decode() for c in counts for t in c], pa.string()), pa.array([x for c in counts for x in c.values()], pa.int64())],
                names=["item", "item_id", "term", "times"],
            )
            at += len(n)

    rows = items.select(F.col(id_col).alias("item_id"), plain_text(text_col).cast("binary").alias("text"))
    return durable(rows.mapInArrow(run, f"item bigint, item_id {kind}, term string, times bigint"), "query-terms")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Bytes of a bitmap with two bits for each term, sized by their number."""
    hashes = durable(terms.select(F.xxhash64("term").alias("h")).distinct(), "query-hashes")
    bits = filter_bits(hashes.count())
    cells = hashes.select(F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftright("h", 32), F.lit(bits)))).alias("c"))
    blocks = cells.groupBy(F.shiftright("c", BITMAP.bit_length() - 1).cast("int").alias("k")).agg(F.expr(f"bitmap_construct_agg(c % {BITMAP})").alias("bits"))
    table = np.zeros((bits // BITMAP, BITMAP // 8), np.uint8)
    for k, raw in blocks.collect():
        table[k] = np.frombuffer(bytes(raw), np.uint8)
    return table.ravel()


class _Asked(dict):
    """term -> may a query use it? Keeps the answers of the terms met so far."""

    def __init__(self, bitmap: np.ndarray) -> None:
        self.bitmap, self.most = bitmap, len(bitmap) * 8

    def __missing__(self, term: bytes) -> bool:
        if len(self) > 2_000_000:
            self.clear()
        h = xxhash.xxh64_intdigest(term, 42)
        h -= (h >> 63) << 64
        self[term] = ok = all(self.bitmap[c >> 3] >> (c & 7) & 1 for c in (h % self.most, (h >> 32) % self.most))
        return ok


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index | None:
    """The index of ``docs`` for the query terms ``terms``; None if no document has a term."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).cast("binary").alias("text"))
    bitmap = _bitmap(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = TaskContext.get().partitionId() << 33, _Asked(bitmap)
        for b in batches:
            sizes, n, found, times = [], [], [], []
            for text in b.column("text").to_pylist():
                words = terms_of(text)
                counts = Counter(words)
                mine = [t for t in counts if asked[t]]
                sizes.append(len(words))
                n.append(len(mine))
                found += mine
                times += map(counts.__getitem__, mine)
            here = np.arange(len(n))
            # a document is a row without term, its size in place of the term's occurrences
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(n)), pa.array(here + at), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sizes, pa.int64())], names=["term", "row", "doc_id", "tf", "n"])
            nth = np.repeat(here, n)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array(nth + at), pa.nulls(len(nth), b.column("doc_id").type), pa.array(times, pa.int64()), pa.array(np.array(sizes, np.int64)[nth])], names=["term", "row", "doc_id", "tf", "n"])
            at += len(n)

    raw = durable(rows.mapInArrow(run, f"term string, row bigint, doc_id {kind}, tf bigint, n bigint"), "terms-of-documents")
    documents = raw.where("term = ''")
    total = documents.agg(F.count_if(F.col("tf") > 0).alias("n"), F.sum("tf").alias("l")).first()
    if not total["n"]:
        return None
    length = F.expr(f"75 + (25 * n * {total['n']}L) div {total['l']}L")
    impacts = raw.where("term <> ''").withColumn("m", length).select("term", "row", F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)").alias("impact"))
    order = (F.asc("term"), F.desc("impact"), F.asc("row"))
    postings = durable(impacts.repartitionByRange(*order).sortWithinPartitions(*order), "postings")
    lists = durable(postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("best")), "lists")
    return Index(postings, documents.select("row", "doc_id"), lists, total["n"])


def _kth(rows: DataFrame, k: int, value: str) -> DataFrame:
    """item, kth: the k-th largest value of each item that has as many."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(value)))).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") == k).select("item", F.col(value).alias("kth"))


class _Lists:
    """The items of a block: for each term the items that use it, their weights and the least impact that the threshold lets through."""

    def __init__(self, rows: list, k: int) -> None:
        self.k = k
        self.items = np.array(sorted({r["item"] for r in rows}), np.int64)
        terms = sorted({r["term"] for r in rows})
        place = {t: i for i, t in enumerate(terms)}
        order = sorted(rows, key=lambda r: place[r["term"]])
        self.item = np.searchsorted(self.items, np.array([r["item"] for r in order], np.int64))
        self.weight = np.array([r["weight"] for r in order], np.int64)
        self.least = np.array([r["least"] for r in order], np.int64)
        at = np.array([place[r["term"]] for r in order])
        self.start = np.searchsorted(at, np.arange(len(terms) + 1))
        self.m, self.share, self.floor = (np.zeros(len(self.items), np.int64) for _ in range(3))
        for i, r in zip(self.item, order, strict=True):
            self.m[i], self.share[i], self.floor[i] = r["m"], r["share"], r["bound"]
        self.terms = [(t, i, int(self.least[self.start[i] : self.start[i + 1]].min())) for i, t in enumerate(terms)]

    def sums(self, term: np.ndarray, row: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, row, lower bound, upper bound) of postings that hold whole documents, sorted by row."""
        n = self.start[term + 1] - self.start[term]
        of = np.repeat(np.arange(len(term)), n)
        entry = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.start[term][of]
        given = impact[of] >= self.least[entry]
        of, entry = of[given], entry[given]
        if not len(of):
            return (np.empty(0, np.int64),) * 4
        nth = np.cumsum(np.r_[False, row[1:] != row[:-1]])
        key = nth[of] * len(self.items) + self.item[entry]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low = np.add.reduceat((self.weight[entry] * impact[of])[order], first)
        item = key[first] % len(self.items)
        missing = self.m[item] - np.diff(np.r_[first, len(key)])
        return item, row[of[order[first]]], low, low + missing * np.maximum(self.share[item] - 1, 0)

    def raised(self, item: np.ndarray, low: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """``floor`` raised to the k-th best of these lower bounds for each item."""
        order = np.lexsort((-low, item))
        item, low = item[order], low[order]
        first = np.searchsorted(item, np.arange(len(floor)))
        kth = np.flatnonzero(np.arange(len(item)) - first[item] == self.k - 1)
        floor = floor.copy()
        floor[item[kth]] = np.maximum(floor[item[kth]], low[kth])
        return floor

    def _documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """The sums of whole documents of sorted postings, batch by batch."""
        rest, empty = None, (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
        for b in _with_end(batches):
            new = empty if b is None else tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("term", "row", "impact"))
            term, row, impact = new if rest is None else (np.concatenate(x) for x in zip(rest, new, strict=True))
            # the last document may go on in the next batch
            cut = len(row) if b is None or not len(row) else int(np.searchsorted(row, row[-1]))
            rest = term[cut:], row[cut:], impact[cut:]
            yield self.sums(term[:cut], row[:cut], impact[:cut])

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best lower bounds of each item in this task, of those that reach its bound."""
        floor, held, size = self.floor, [(np.empty(0, np.int64),) * 2], 0

        def pruned() -> tuple[np.ndarray, ...]:
            item, low = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((-low, item))
            item, low = item[order], low[order]
            top = np.arange(len(item)) - np.searchsorted(item, np.arange(len(floor)))[item] < self.k
            return item[top], low[top]

        for item, _, low, _ in self._documents(batches):
            stay = low >= floor[item]
            held.append((item[stay], low[stay]))
            size += int(stay.sum())
            if size > HELD:
                floor = self.raised(*(np.concatenate(x) for x in zip(*held, strict=True)), floor)
                held, size = [pruned()], 0
        item, low = pruned()
        yield pa.RecordBatch.from_arrays([pa.array(self.items[item]), pa.array(low)], names=["item", "low"])

    def candidates(self, floor: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents whose upper bound reaches the floor of their item."""
        for item, row, _, high in self._documents(batches):
            stay = high >= floor[item]
            yield pa.RecordBatch.from_arrays([pa.array(self.items[item[stay]]), pa.array(row[stay])], names=["item", "row"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def top_documents(index: Index, terms: DataFrame, k: int = 20) -> DataFrame:
    """item, item_id, rank, doc_id, score: the k best documents with a score above 0 for each item of ``terms``."""
    weight = F.floor(1000 * F.log((F.lit(2 * index.n + 2).cast("double")) / (2 * F.col("df") + 1))) * F.col("times")
    lists = durable(terms.join(index.lists, "term").withColumn("weight", weight).where("weight > 0").select("item", "term", "weight", "best"), "lists-of-items")
    order = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    heads = durable(index.postings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("term", "row", "impact"), "heads")
    blocks = max(1, -(-lists.count() // BLOCK))
    found = []
    for i in range(blocks):
        block = lists.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        lower = block.join(heads, "term").groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("low"))
        bound = block.groupBy("item").agg(F.count("*").alias("m")).join(_kth(lower, k, "low"), "item", "left").select("item", "m", F.coalesce("kth", F.lit(0)).alias("bound"))
        bound = bound.withColumn("share", F.expr("(bound + m - 1) div m"))
        least = F.greatest(F.lit(1), F.expr("(share + weight - 1) div weight"))
        asked = durable(block.join(bound, "item").withColumn("least", least), "thresholds")
        rows = asked.where("least <= best").collect()  # BLOCK rows and one item's at most
        if not rows:
            continue
        sums = _Lists(rows, k)
        # as many rows as the block has terms
        floors = F.broadcast(terms.sparkSession.createDataFrame(sums.terms, "term string, place int, floor bigint"))
        given = index.postings.join(floors, "term").where("impact >= floor").select(F.col("place").alias("term"), "row", "impact")
        # the lists are summed twice: once for the k-th best lower bound of all tasks, which one task alone knows badly, and once for what reaches it
        by_row = given.repartition("row").sortWithinPartitions("row")
        second = dict(_kth(by_row.mapInArrow(sums.best, "item bigint, low bigint"), k, "low").collect())  # one row an item
        floor = np.maximum(sums.floor, np.array([second.get(i, 0) for i in sums.items.tolist()], np.int64))
        left = durable(by_row.mapInArrow(partial(sums.candidates, floor), "item bigint, row bigint"), "candidates")
        exact = index.postings.join(left, "row").join(block, ["item", "term"]).groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
        found.append(durable(exact, "scores"))
    if not found:
        return terms.sparkSession.createDataFrame([], f"item bigint, item_id {terms.schema['item_id'].dataType.simpleString()}, rank int, doc_id {index.documents.schema['doc_id'].dataType.simpleString()}, score bigint")
    scores = reduce(DataFrame.unionByName, found).where("score > 0").join(index.documents, "row")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row"))).where(F.col("rank") <= k)
    return ranked.join(terms.select("item", "item_id").distinct(), "item").select("item", "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents for each item."""
    terms = query_terms(items)
    index = build_index(docs, terms)
    if index is None:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    return top_documents(index, terms, k).drop("item")
