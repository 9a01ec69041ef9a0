"""Coverage of nodes (L0), edges (L1) and two-hop paths (L2) by questions, in one canonical key space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import edge_key, path_key, pivot_universe


def universe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """frame, level, key of everything that can be covered."""
    text = lambda c: F.col(c).cast("string")
    l0 = nodes.select("frame", F.lit("L0").alias("level"), text("id").alias("key"))
    l1 = edges.select("frame", F.lit("L1").alias("level"), edge_key(text("src"), text("dst")).alias("key")).distinct()
    l2 = pivot_universe(edges).select("frame", F.lit("L2").alias("level"), path_key(text("a"), text("pivot"), text("c")).alias("key"))
    return l0.unionByName(l1).unionByName(l2)


def cascade(paths: DataFrame) -> DataFrame:
    """A covered path covers its two edges and three nodes: ``paths`` (frame, qid, ord, a, b, c as strings) to frame, qid, ord, level, key."""
    hit = lambda level, key: F.struct(F.lit(level).alias("level"), key.alias("key"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    parts = F.array(hit("L0", a), hit("L0", b), hit("L0", c), hit("L1", edge_key(a, b)), hit("L1", edge_key(b, c)), hit("L2", path_key(a, b, c)))
    return paths.select("frame", "qid", "ord", F.explode(parts).alias("h")).select("frame", "qid", "ord", "h.*")


def coverage_stats(everything: DataFrame, hits: DataFrame) -> DataFrame:
    """level, total, covered, gap, rate (percent, two decimals)."""
    seen = hits.select("frame", "level", "key").distinct().withColumn("hit", F.lit(1))
    joined = everything.join(seen, ["frame", "level", "key"], "left")
    counts = joined.groupBy("level").agg(F.count("*").alias("total"), F.count("hit").alias("covered"))
    return counts.select("level", "total", "covered", (F.col("total") - F.col("covered")).alias("gap"), F.round(F.col("covered") * 100.0 / F.col("total"), 2).alias("rate"))


def uncovered(everything: DataFrame, hits: DataFrame) -> DataFrame:
    return everything.join(hits.select("frame", "level", "key").distinct(), ["frame", "level", "key"], "left_anti")


def coverage_curve(everything: DataFrame, hits: DataFrame) -> DataFrame:
    """frame, level, ord, new_keys, covered, rate: keys of the universe seen for the first time, and so far, in the order of questions.

    First occurrences are a minimum by key; only their counts are summed over the order, so no window holds the keys.
    """
    real = hits.join(everything, ["frame", "level", "key"], "left_semi")
    first = real.groupBy("frame", "level", "key").agg(F.min("ord").alias("ord")).groupBy("frame", "level", "ord").agg(F.count("*").alias("new_keys"))
    steps = hits.select("frame", "level", "ord").distinct().join(first, ["frame", "level", "ord"], "left").fillna(0, ["new_keys"])
    total = everything.groupBy("frame", "level").agg(F.count("*").alias("total"))
    so_far = F.sum("new_keys").over(Window.partitionBy("frame", "level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    curve = steps.withColumn("covered", so_far).join(total, ["frame", "level"])
    return curve.select("frame", "level", "ord", "new_keys", "covered", F.round(F.col("covered") / F.col("total"), 6).alias("rate"))


def new_counts(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """``paths`` (frame, a, b, c as strings) with new_l0, new_l1 and new_l2: how many of their parts are not covered yet."""
    seen = hits.select("frame", "level", "key").distinct().withColumn("_seen", F.lit(1))
    parts = cascade(paths.withColumns({"qid": path_key(F.col("a"), F.col("b"), F.col("c")), "ord": F.lit(0)}))
    missing = parts.join(seen, ["frame", "level", "key"], "left").where("_seen is null")
    counted = missing.groupBy("frame", "qid").agg(*[F.count_if(F.col("level") == f"L{k}").alias(f"new_l{k}") for k in range(3)])
    return paths.withColumn("qid", path_key(F.col("a"), F.col("b"), F.col("c"))).join(counted, ["frame", "qid"], "left").fillna(0, ["new_l0", "new_l1", "new_l2"])


def gap_score(new_l0: Column, new_l1: Column) -> Column:
    return 100 * new_l0 + 10 * new_l1 + 1


def gap_level(new_l0: Column, new_l1: Column, new_l2: Column) -> Column:
    """2: a new path, 1: a new edge, 0: a new node, -1: nothing new."""
    return F.when(new_l2 > 0, 2).when(new_l1 > 0, 1).when(new_l0 > 0, 0).otherwise(-1)


def gap_tier(new_l0: Column, new_l1: Column) -> Column:
    """5 for the most uncovered parts, 0 for none."""
    return F.when((new_l0 >= 2) & (new_l1 >= 2), 5).when((new_l0 >= 1) & (new_l1 >= 2), 4).when(new_l1 >= 2, 3).when((new_l0 >= 1) & (new_l1 >= 1), 2).when(new_l1 >= 1, 1).otherwise(0)


def family_quotas(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the given ratios that sum to ``total``: the largest remainders are rounded up, ties by name."""
    exact = {k: total * r / sum(ratios.values()) for k, r in ratios.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def locked_curve(everything: DataFrame, hits: DataFrame) -> DataFrame:
    """The coverage curve of the questions whose answer is unique (``hits`` with is_unique)."""
    return coverage_curve(everything, hits.where("is_unique").drop("is_unique"))


def gap_priority(new_l0: Column, new_l1: Column) -> Column:
    """Edges weigh more than nodes, as they are rarer."""
    return 10 * new_l0 + 15 * new_l1


def leading_gaps(gaps: DataFrame, k: int, seed: int = 0, sure: float = 0.8) -> DataFrame:
    """``gaps`` (frame, key, priority) that are taken, with ``chosen``: of ``k`` for each frame the share ``sure`` by priority (top), ties by key, and the rest by a seeded order of what is left (random)."""
    top = int(k * sure)
    placed = gaps.withColumn("_place", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("priority"), "key")))
    count = F.count("*").over(Window.partitionBy("frame"))
    first = placed.withColumn("_head", F.when(count > k, F.col("_place") <= top).otherwise(True))
    order = Window.partitionBy("frame", "_head").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "key")), "key")
    taken = first.withColumn("_turn", F.row_number().over(order)).where(F.col("_head") | (F.col("_turn") <= k - top))
    return taken.withColumn("chosen", F.when(F.col("_head"), "top").otherwise("random")).drop("_place", "_head", "_turn")


def eligible_families(gaps: DataFrame) -> DataFrame:
    """``gaps`` (a, b, c as text, their types) with ``families``: those whose ends and types are known. The own vehicle as pivot is not asked for by a converging question."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    ids = there("a") & there("b") & there("c")
    rules = {"converge": ids & there("b_type") & (F.col("b") != "ego"), "diverge": ids & there("a_type") & there("c_type"), "distance_chain": ids, "direction_chain": ids, "viewpoint": ids}
    return gaps.withColumn("families", F.filter(F.array(*[F.when(ok, F.lit(f)) for f, ok in rules.items()]), lambda f: f.isNotNull()))


def over_cap(used: Column, generated: Column, cap: Column | float) -> Column:
    """Whether one more question would put a family above its share of all questions."""
    return (used + 1) / (generated + 1) > cap


def question_footprint(edges: DataFrame) -> DataFrame:
    """qid, level, key of the graph of each question (qid, src, dst as strings): nodes, edges and two-edge paths inside it."""
    near = edges.select("qid", F.col("src").alias("n"), F.col("dst").alias("o")).unionByName(edges.select("qid", F.col("dst").alias("n"), F.col("src").alias("o"))).distinct()
    l0 = near.select("qid", F.lit("L0").alias("level"), F.col("n").alias("key"))
    l1 = near.select("qid", F.lit("L1").alias("level"), edge_key(F.col("n"), F.col("o")).alias("key"))
    l2 = near.select("qid", "n", F.col("o").alias("a")).join(near.select("qid", "n", F.col("o").alias("c")), ["qid", "n"]).where("a < c").select("qid", F.lit("L2").alias("level"), path_key(F.col("a"), F.col("n"), F.col("c")).alias("key"))
    return l0.unionByName(l1).unionByName(l2).distinct()
