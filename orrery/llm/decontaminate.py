"""Benchmark decontamination as a prefix-filtered set join (operator 5).

The windows of the benchmark items are sets of words to be contained in a document. The words of each window are ordered by how
often all documents use them, rarest first; as every word must be contained, the necessary prefix is the one rarest word.
Documents are joined on these prefix words only (a fixed-size bit table first discards most words where they stand), the length and positional bounds
drop windows that would stick out of the document, and what is left is verified word by word over the window. Built-in functions only.

Words: A-Z lower-cased, maximal runs of ASCII letters, digits and non-ASCII characters. A window is ``width`` consecutive words of an item, or the whole item if it is shorter.

Defined cases: null and empty texts have no words, are never hit, and give no windows; null or repeated ids are rows of their
own; items that share a window are all reported; an item without id hits words but is not listed; an empty benchmark hits nothing; an empty table gives an empty result.
Very long texts are held as one array of words in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, fresh, perhaps_in, plain_text, sha256_hex

#: What separates words, after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the table that discards words, whatever the size of the benchmark.
BITS = 1 << 16
#: Benchmark windows are broadcast up to this many prefix words and windows, else they shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: str = "text") -> Column:
    return F.array_remove(F.split(ascii_lower(plain_text(text)), GAPS, -1), "")


def benchmark_windows(benchmark: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window array<string>, items array<string>: each distinct window with the items that hold it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(text_col).alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(1, greatest(size(w) - {width} + 1, 1))")
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: list[str] | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with row number ``row`` and ``n_words``; spans: row, start, stop, items), start and stop in words."""
    keep = keep if keep is not None else ["doc_id"]
    words = durable(docs.select(*keep, F.monotonically_increasing_id().alias("row"), words_of(text_col).alias("w")), "words")
    windows = durable(benchmark_windows(benchmark, width), "windows")
    n_windows = windows.count()
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    # rarity: occurrences over all documents, words that no document has first
    seen = words.select(F.explode("w").alias("word")).join(_bounded(vocabulary, n_windows * width), "word", "left_semi").groupBy("word").count()
    rarity = vocabulary.join(seen, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))
    ranked = windows.select("window", "items", F.posexplode("window").alias("at", "word")).join(rarity, "word")
    prefix = ranked.groupBy("window").agg(F.min_by(F.struct("word", "at"), F.struct("n", "word", "at")).alias("p"), F.first("items").alias("items"))
    prefix = durable(prefix.select("window", "items", "p.*"), "prefix")
    # a table of BITS bits, of which the driver sees one long for each 64
    slot = lambda word: F.pmod(F.xxhash64(word), F.lit(BITS))
    table = [0] * (BITS // 64)
    for k, bits in prefix.select(slot(F.col("word")).alias("s")).groupBy(F.shiftright("s", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))")).collect():
        table[k] = bits
    lookup = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    rows = words.where("size(w) > 0")
    # position and slot in one number, so that each word is hashed once
    marked = F.transform("w", lambda word, i: i.cast("long") * BITS + slot(word))
    hits = F.filter(marked, lambda x: F.call_function("bit_get", F.get(lookup, F.shiftright(x % BITS, 6).cast("int")), (x % 64).cast("int")) == 1)
    at = lambda x: F.shiftright(x, BITS.bit_length() - 1).cast("int")
    left = lambda x: F.greatest(at(x) - (width - 1), F.lit(0))
    near = F.transform(hits, lambda x: F.struct(at(x).alias("pos"), F.get("w", at(x)).alias("word"), left(x).alias("from"), F.slice("w", left(x) + 1, F.lit(2 * width - 1)).alias("around")))
    found = rows.select("row", F.size("w").alias("n"), F.explode(near).alias("x")).select("row", "n", "x.*")
    met = found.join(_bounded(prefix, n_windows), "word").withColumn("start", F.col("pos") - F.col("at"))
    met = met.where("size(window) <= n and start >= 0 and start + size(window) <= n")
    met = met.where(F.slice("around", F.col("start") - F.col("from") + 1, F.size("window")) == F.col("window"))
    spans = durable(met.select("row", "start", (F.col("start") + F.size("window")).alias("stop"), "items"), "spans")
    return words.select(*keep, "row", F.size("w").cast("long").alias("n_words")), spans


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    rows, spans = contaminated_spans(docs, benchmark, width)
    runs = spans.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    before = F.max("stop").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("row", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("new"))
    hit = runs.groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    items = spans.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    full = rows.join(hit.join(items, "row", "left"), "row", "left")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return full.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), sha256_hex(listed).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """The documents that hold no window of any item, with all their columns. Only rows that a filter of the hit texts lets through shuffle."""
    sha, key, flag = fresh(docs, "sha_of_text"), fresh(docs, "key_of_text"), fresh(docs, "perhaps_hit")
    hashed = docs.withColumn(sha, sha256_hex(plain_text(text_col)))
    rows, spans = contaminated_spans(hashed, benchmark, width, keep=[sha], text_col=text_col)
    dirty = durable(rows.join(spans.select("row").distinct(), "row", "left_semi").select(sha).distinct(), "dirty")
    flagged = perhaps_in(hashed, F.xxhash64(sha), durable(dirty.select(F.xxhash64(sha).alias(key)), "hit-keys"), flag)
    clean = flagged.where(flag).join(dirty, sha, "left_anti")
    return flagged.where(~F.col(flag)).unionByName(clean).select(*[f"`{c}`" for c in docs.columns])
