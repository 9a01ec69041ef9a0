"""URL filter: ordered host and path rules, then logistic regression on hashed character n-grams (operator 1).

Rules decide first: a rule fits its host and all subdomains if the path starts with the rule's, and the longest wins. Any other url is
judged by a logistic regression over hashed character n-grams of host and path, trained from a small labelled table of urls.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged by the model alone, as is a url whose path is empty where every rule
asks for a slash; null or repeated page ids are rows of their own; an empty table gives an empty result; other columns are ignored.
Very long urls are n-grams like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh
from .url_labels import labelled


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


#: The contract's rules.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def seed_urls(spark: SparkSession) -> DataFrame:
    """(url, bad): the small labelled table."""
    return spark.createDataFrame(labelled(), "url string, bad double")


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule (of equal length, the first given), or null."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, r.rule).otherwise(out)
    return out


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of the text between ^ and $, marked so that host and path differ."""
    chars = F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""))  # bound to a lambda variable, so that it is split once
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), F.array_join(F.slice(c, i, F.lit(n)), "")))
    return F.flatten(F.transform(chars, lambda c: F.concat(*[grams(c, n) for n in sizes])))


def grams_of(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """All n-grams of both. Digits count as one character class: page numbers carry no topic."""
    no_digits = F.regexp_replace(ascii_lower(path), r"[0-9]+", "0")
    return F.concat(_grams(host, "h:", sizes), _grams(no_digits, "p:", sizes))


def fit_urls(seeds: DataFrame, buckets: int = 1 << 14) -> PipelineModel:
    """The model, from a labelled table (url, bad); rows with nulls are left out."""
    rows = seeds.where("url is not null and bad is not null").select("bad", grams_of(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
    tf = HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True)
    model = LogisticRegression(labelCol="bad", regParam=0.01, maxIter=40, probabilityCol="probability").fit(tf.transform(rows).coalesce(1))
    return PipelineModel([tf, model])


def judge_urls(pages: DataFrame, model: PipelineModel, rules: tuple[Rule, ...] = RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and p_bad; columns of these names are replaced."""
    rows = pages.drop("host", "path", "rule", "verdict", "p_bad")
    grams, features = fresh(rows, "grams"), fresh(rows, "features")
    url = F.col(url_col)
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    tf, lr = (s.copy() for s in model.stages)
    tf.setInputCol(grams).setOutputCol(features)
    names = {k: fresh(rows, k) for k in ("raw", "probability", "prediction")}
    lr.setFeaturesCol(features).setRawPredictionCol(names["raw"]).setProbabilityCol(names["probability"]).setPredictionCol(names["prediction"])
    scored = lr.transform(tf.transform(rows.withColumn(grams, grams_of(F.col("host"), F.col("path")))))
    scored = scored.withColumn("p_bad", vector_to_array(names["probability"])[1]).drop(grams, features, *names.values())
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in (r.rule, r.verdict)])
    by_model = F.when(F.col("p_bad") >= threshold, "block").otherwise("allow")
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule[F.col("rule")], by_model))


def url_verdicts(pages: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_bad of every page."""
    model = fit_urls(seeds if seeds is not None else seed_urls(pages.sparkSession))
    return judge_urls(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "p_bad")
