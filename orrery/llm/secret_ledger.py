"""Secret scanning with an incremental blob ledger (operator 3).

Every version of every path is addressed by its content (SHA-256). A ledger table remembers which (blob, rule, rule
version) triples have been scanned and the spans found; a run scans one copy of each blob, and only for triples that the ledger lacks,
appends them, and joins the findings back to all paths that hold the blob. A changed rule gets a new version and is
scanned again; the old entries stay. Built-in functions only: the pieces of ``split`` and the matches of ``regexp_extract_all``
alternate, so running sums of their lengths give the spans.

Defined cases: null text equals the empty text; a null path or ``doc_id`` is a path of its own; repeated rows share one scan and
are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, perhaps_in, plain_text, sha256_hex, shared_dir


@dataclass(frozen=True)
class Rule:
    """A secret kind: matches are leftmost, non-overlapping; those whose ``group`` is shorter than ``least`` characters are dropped afterwards."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: The contract's patterns. ``[0-9a-f]{32,}`` has the matches of ``[0-9a-f]+`` with 32 characters or more, and likewise AKIA.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}+", 0, 32),
)

LEDGER = "blob string, rule string, version int, starts array<int>, ends array<int>"


def _matches(text: Column, rule: Rule) -> Column:
    """Lengths: of what precedes each match, of the match, of its deciding group; null without a match."""
    find = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.char_length)
    before = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = find(0)
    rows = F.arrays_zip(before.alias("skip"), whole.alias("whole"), (find(rule.group) if rule.group else whole).alias("deciding"))
    return F.when(text.rlike(rule.pattern), F.filter(rows, lambda x: x["whole"].isNotNull()))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty before the first run."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_versions(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``versions``; return what was scanned now (blob, rule, version, starts, ends)."""
    spark = versions.sparkSession
    ids = versions.select(sha256_hex(plain_text(text_col)).alias("blob"), F.col(id_col).alias("at"))
    rule_rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules]))
    blobs = ids.groupBy("blob").agg(F.min("at").alias("at"))
    unseen = blobs.select("blob", "at", rule_rows.alias("r")).select("blob", "at", "r.*").join(open_ledger(spark, ledger_path).select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    todo = durable(unseen.groupBy("blob", "at").agg(F.collect_set("rule").alias("todo")), "todo").select(F.col("blob").alias("todo_blob"), F.col("at").alias("todo_at"), "todo")
    names = {r[0] for r in todo.select(F.explode("todo")).distinct().collect()}  # one for each rule at most
    waiting = [r for r in rules if r.name in names]
    if not waiting:
        return spark.createDataFrame([], LEDGER)
    # one copy of each blob, and the few that a filter takes for one, are scanned where they stand: no text shuffles
    texts = versions.select(sha256_hex(plain_text(text_col)).alias("blob"), plain_text(text_col).alias("text"), F.col(id_col).alias("at"))
    keys = durable(todo.select(F.xxhash64("todo_blob", "todo_at").alias("key")), "todo-keys")
    chosen = perhaps_in(texts, F.xxhash64("blob", "at"), keys, "chosen").where("chosen")
    found = chosen.select("blob", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _matches(F.col("text"), r).alias("m")) for r in waiting])).alias("r")).select("blob", "r.*")
    wanted = todo.select(F.col("todo_blob").alias("blob"), F.explode("todo").alias("rule"))
    found = durable(found.dropDuplicates(["blob", "rule"]).join(wanted, ["blob", "rule"], "left_semi"), "matches")
    order = Window.partitionBy("blob", "rule").orderBy("pos")
    each = found.select("blob", "rule", "version", "least", F.posexplode("m").alias("pos", "x"))
    each = each.withColumn("end", F.sum(F.col("x.skip") + F.col("x.whole")).over(order).cast("int")).where("x.deciding >= least")
    spans = each.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("x.whole")).alias("start"), "end"))).alias("s"))
    none = F.array().cast("array<int>")
    new = found.select("blob", "rule", "version").join(spans, ["blob", "rule", "version"], "left")
    new = new.select("blob", "rule", "version", F.coalesce("s.start", none).alias("starts"), F.coalesce("s.end", none).alias("ends"))
    new = durable(new, "findings")
    new.write.mode("append").parquet(ledger_path)
    return new


def findings_of(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every path with what the ledger knows of its blob: id, blob, found array<struct<start, kind, end>> in order of start, then kind as listed."""
    kinds = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    seen = open_ledger(versions.sparkSession, ledger_path).where(F.concat_ws(":", "rule", "version").isin([f"{r.name}:{r.version}" for r in rules]))
    marks = seen.where("size(starts) > 0").select("blob", F.explode(F.arrays_zip("starts", "ends")).alias("x"), kinds[F.col("rule")].alias("kind"))
    by_blob = marks.distinct().groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(F.col("x.starts").alias("start"), "kind", F.col("x.ends").alias("end")))).alias("found"))
    paths = versions.select(F.col(id_col).alias("doc_id"), sha256_hex(plain_text(text_col)).alias("blob"))
    # a table of its own, so that adaptive execution can split a blob that very many paths hold
    return paths.join(durable(by_blob, "by-blob"), "blob", "left")


def secret_report(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document, by a ledger that starts empty unless a path is given."""
    path = ledger_path or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    scan_versions(docs, path)
    names = F.array(*[F.lit(r.name) for r in RULES])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = findings_of(docs, path).withColumn("found", F.coalesce("found", none))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    return rows.select("doc_id", *[count(k).alias(f"n_{r.name}") for k, r in enumerate(RULES)], sha256_hex(spans).alias("base_sha256"), spans.alias("spans"))
