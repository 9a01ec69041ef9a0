"""Stored questions grounded in scene graphs, plans held against graphs, and answers under several frames of direction: all as joins within a frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions import text as T
from orrery.session import durable

from .graph import edge_key
from .questions import DIRECTIONS, _fits, parsed

PAIRS = "array<struct<src:bigint,dst:bigint>>"


def grounded(questions: DataFrame, nodes: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    """frame, qid, family, verdict, ids, pairs: the objects and edges that a stored question (frame, qid, text, answer) stands on, if the graph's answer is the stored one.

    The anchor is the own vehicle (``own``: frame, id) for "of me", else the fitting node of smallest id. Verdicts: match; mismatch (only the anchor stands);
    partial (an object or status that no target has: all targets stand); grounded (a comparison with targets in a direction that it names); unparsed, without
    an anchor or rule. A right no stands on the anchor alone.
    """
    questions = questions.withColumn("_normal", F.lower(T.normalised_question(F.col("text"))))
    low = F.col("_normal")
    ways = "|".join(DIRECTIONS)
    mine = F.nullif(F.regexp_extract(low, rf"to the ({ways}) of me\b", 1), F.lit(""))
    q = parsed(questions).withColumns({"of_me": mine.isNotNull() & F.col("direction").isNull(), "way": F.coalesce("direction", mine), "ways": F.array_distinct(F.regexp_extract_all(low, F.lit(rf"to the ({ways}) of"), 1)), "told": F.lower(F.trim("answer"))})
    q = durable(q.select("frame", "qid", "family", "told", "type", "status", "ref_type", "ref_status", "of_me", "way", "ways"), "parsed")  # texts are read once
    kind = nodes.select("frame", "id", F.col("type").alias("kind"), F.col("status").alias("state"))
    anchors = q.where("of_me").join(own.select("frame", F.col("id").alias("anchor")), "frame").select("frame", "qid", "anchor")
    named = q.where("way is not null and not of_me and ref_type is not null").join(kind, "frame").where(_fits(F.col("kind"), F.col("state"), F.col("ref_type"), F.col("ref_status")))
    q = durable(q.join(anchors.unionByName(named.groupBy("frame", "qid").agg(F.min("id").alias("anchor"))), ["frame", "qid"], "left"), "anchored")

    seen = edges.select("frame", F.col("src").alias("anchor"), F.col("dst").alias("id"), F.replace("dir6", F.lit("_"), F.lit(" ")).alias("seen"), F.col("dst_type").alias("kind"), F.col("dst_status").alias("state"))
    compared = F.col("family") == "comparison"
    asked_status = F.when(F.col("family") != "status", F.col("status"))
    near = q.join(seen, ["frame", "anchor"]).where(F.when(compared, F.array_contains("ways", F.col("seen"))).otherwise((F.col("seen") == F.col("way")) & _fits(F.col("kind"), F.col("state"), F.col("type"), asked_status)))
    alone = q.where("way is null and family in ('exist', 'count')").join(kind, "frame").where(_fits(F.col("kind"), F.col("state"), F.col("type"), F.col("status")))
    hits = near.unionByName(alone, allowMissingColumns=True).groupBy("frame", "qid").agg(F.array_sort(F.collect_set(F.struct("id", "kind", "state"))).alias("hits"))
    q = q.join(hits, ["frame", "qid"], "left").withColumn("hits", F.coalesce("hits", F.array()))

    n, told, family = F.size("hits"), F.col("told"), F.col("family")
    right = F.filter("hits", lambda h: F.when(family == "object", T.type_matches(h["kind"], told)).otherwise(F.replace(F.lower(h["state"]), F.lit("_"), F.lit(" ")) == F.replace(told, F.lit("_"), F.lit(" "))))
    yes = told.isin("yes", "true")
    checked = (
        F.when(F.col("way").isNotNull() & F.col("anchor").isNull(), "unparsed")
        .when(family == "exist", F.when((n > 0) == yes, "match").otherwise("mismatch")).when(family == "count", F.when(n == F.expr("try_cast(told AS int)"), "match").otherwise("mismatch"))
        .when(F.col("way").isNull(), "unparsed").when(compared, F.when(n > 0, "grounded").otherwise("mismatch"))
        .when(family.isin("object", "status"), F.when(F.size(right) > 0, "match").when(n > 0, "partial").otherwise("mismatch")).otherwise("unparsed")
    )
    stands = F.when(F.col("verdict").isin("unparsed", "mismatch"), F.array().cast("array<bigint>")).otherwise(F.transform(F.when(family.isin("object", "status") & (F.col("verdict") == "match"), right).otherwise(F.col("hits")), lambda h: h["id"].cast("bigint")))
    q = q.withColumn("verdict", checked).withColumn("stands", stands)
    anchor = F.when((F.col("verdict") != "unparsed") & F.col("anchor").isNotNull(), F.array(F.col("anchor").cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    pairs = F.when(F.col("anchor").isNotNull(), F.transform("stands", lambda i: F.struct(F.col("anchor").cast("bigint").alias("src"), i.alias("dst")))).otherwise(F.array().cast(PAIRS))
    return q.select("frame", "qid", "family", "verdict", F.concat(anchor, "stands").alias("ids"), pairs.alias("pairs"))


def grounded_hits(found: DataFrame) -> DataFrame:
    """frame, level, key: what grounded questions cover; those whose answer isn't the graph's cover nothing."""
    sure = found.where("verdict in ('match', 'grounded')")
    l0 = sure.select("frame", F.lit("L0").alias("level"), F.explode(F.col("ids").cast("array<string>")).alias("key"))
    l1 = sure.select("frame", F.explode("pairs").alias("p")).select("frame", F.lit("L1").alias("level"), edge_key(F.col("p.src").cast("string"), F.col("p.dst").cast("string")).alias("key"))
    return l0.unionByName(l1).distinct()


def direction_answers(nodes: DataFrame, questions: DataFrame, own: DataFrame, most: int = 10) -> DataFrame:
    """frame, qid, family, method, answers, told: the set of answers of each question under three frames of direction: the own vehicle's heading (ego), the reference's (source), none (world).

    ``questions``: frame, qid, family, src (the reference), type and status (null: any), direction, answer. Counts stop at ``most``, statuses that are unknown
    are no answers, a comparison is with the reference's status and may have both answers.
    """
    heading = own.select("frame", "id").join(nodes.select("frame", "id", F.col("yaw").alias("own_yaw")), ["frame", "id"]).drop("id")
    q = questions.join(nodes.select("frame", F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("yaw").alias("src_yaw"), F.col("status").alias("src_status")), ["frame", "src"]).join(heading, "frame")
    turned = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), h.alias("heading")) for m, h in (("ego", F.col("own_yaw")), ("source", F.col("src_yaw")), ("world", F.lit(0.0)))]))
    q = q.select("*", turned.alias("m")).select("frame", "qid", "family", "src", "type", "status", "direction", "answer", "sx", "sy", "src_status", "m.*")
    met = q.join(nodes.select("frame", F.col("id"), F.col("x"), F.col("y"), F.col("type").alias("kind"), F.col("status").alias("state")), "frame").where("id <> src")
    way = F.replace(G.dir6(G.bearing(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"), F.col("heading"))), F.lit("_"), F.lit(" "))
    fits = (way == F.replace("direction", F.lit("_"), F.lit(" "))) & _fits(F.col("kind"), F.col("state"), F.col("type"), F.col("status"))
    known = F.when(F.col("state") != "unknown", F.col("state"))
    same = F.when((F.col("src_status") != "unknown") & known.isNotNull(), F.when(known == F.col("src_status"), "yes").otherwise("no"))
    seen = met.where(fits).groupBy("frame", "qid", "method").agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds"), F.collect_set(known).alias("states"), F.collect_set(same).alias("same"))
    out = q.select("frame", "qid", "family", "method", F.col("answer").alias("told")).join(seen, ["frame", "qid", "method"], "left")
    n = F.coalesce("n", F.lit(0))
    none = F.array().cast("array<string>")
    sets = {"exist": F.array(F.when(n > 0, "yes").otherwise("no")), "count": F.array(F.least(n, F.lit(most)).cast("string")), "object": F.col("kinds"), "status": F.col("states"), "comparison": F.col("same")}
    answers = reduce(lambda acc, kv: F.when(F.col("family") == kv[0], F.coalesce(kv[1], none)).otherwise(acc), sets.items(), none)
    return out.select("frame", "qid", "family", "method", F.array_sort(answers).alias("answers"), "told")


def accuracy_by_method(answered: DataFrame) -> DataFrame:
    """method, family, n, answered, correct, rate (of all questions, six digits): correct if the told answer is in the set."""
    right = F.exists("answers", lambda a: T.same_answer(a, F.col("told")))
    return answered.groupBy("method", "family").agg(F.count("*").alias("n"), F.count_if(F.size("answers") > 0).alias("answered"), F.count_if(right).alias("correct"), F.round(F.avg(right.cast("int")), 6).alias("rate"))


def pair_holds(plans: DataFrame, edges: DataFrame) -> DataFrame:
    """The plans (frame, a, b, c, a_type, c_type, dir_to_a, dir_to_c) whose pivot b sees both ends with their types and in their directions, with a_status and c_status."""
    for end in ("a", "c"):
        seen = edges.select("frame", F.col("src").alias("b"), F.col("dst").alias(end), F.col("dst_type").alias(f"{end}_type"), F.col("dir6").alias(f"dir_to_{end}"), F.col("dst_status").alias(f"{end}_status"))
        plans = plans.join(seen, ["frame", "b", end, f"{end}_type", f"dir_to_{end}"])
    return plans


def found_by_plans(plans: DataFrame, edges: DataFrame) -> DataFrame:
    """Plans (frame, qid, a, b, c, a_type, b_type, c_type; out_a, out_c: directions of the ends seen from b; in_a, in_c: of b seen from the ends) with what a graph has for them.

    n_b, found_b: objects of b's type in both directions from the ends, and the smallest id; n_a, found_a, n_c, found_c: objects of an end's type in its direction from b.
    """
    seen = edges.select("frame", F.col("src").alias("a"), F.col("dst").alias("x"), F.col("dst_type").alias("b_type"), F.col("dir6").alias("in_a"))
    back = edges.select("frame", F.col("src").alias("c"), F.col("dst").alias("x"), F.col("dir6").alias("in_c"))
    both = plans.join(seen, ["frame", "a", "b_type", "in_a"]).join(back, ["frame", "c", "x", "in_c"]).groupBy("frame", "qid").agg(F.count("*").alias("n_b"), F.min("x").alias("found_b"))
    out = plans.join(both, ["frame", "qid"], "left")
    branch = edges.groupBy("frame", F.col("src").alias("b"), "dst_type", "dir6").agg(F.count("*").alias("n"), F.min("dst").alias("first"))
    for end in ("a", "c"):
        own = branch.select("frame", "b", F.col("dst_type").alias(f"{end}_type"), F.col("dir6").alias(f"out_{end}"), F.col("n").alias(f"n_{end}"), F.col("first").alias(f"found_{end}"))
        out = out.join(own, ["frame", "b", f"{end}_type", f"out_{end}"], "left")
    return out


def valid_plan(family: Column, answer: Column) -> Column:
    """Whether what was found (columns of ``found_by_plans``, d_ab, d_bc, dir_ab, dir_bc) makes a plan good: its objects alone fit, the two distances differ, both directions are known, or the answer is a side."""
    only = lambda k: F.coalesce((F.col(f"n_{k}") == 1) & (F.col(f"found_{k}") == F.col(k)), F.lit(False))
    return (
        F.when(family == "converge", only("b")).when(family == "diverge_compare", only("a") & only("c")).when(family == "distance_chain", F.coalesce(F.col("d_ab") != F.col("d_bc"), F.lit(False)))
        .when(family == "direction_chain", F.col("dir_ab").isNotNull() & F.col("dir_bc").isNotNull()).otherwise(F.coalesce(answer.isin("left", "right"), F.lit(False)))
    )


def plan_graph(family: Column, a: Column, b: Column, c: Column, refs: Column, more: Column | None = None) -> Column:
    """array<struct<src,dst,source>>: the edges that a question's form has (template) and its references (constraint): a and c to b, b to a and c (``more`` are references of c), or a to b to c."""
    edge = lambda s, d, kind: F.struct(s.alias("src"), d.alias("dst"), F.lit(kind).alias("source"))
    bound = lambda r, to: F.transform(r, lambda x: edge(x, to, "constraint"))
    none = F.array().cast("array<string>")
    more = F.coalesce(more, none) if more is not None else none
    converge = F.concat(F.array(edge(a, b, "template"), edge(c, b, "template")), bound(refs, b))
    diverge = F.concat(F.array(edge(a, b, "template"), edge(b, c, "template")), bound(refs, a), bound(more, c))
    return F.when(family == "converge", converge).when(family == "diverge_compare", diverge).otherwise(F.array(edge(a, b, "template"), edge(b, c, "template")))


def text_coverage(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """frame, covered, total, rate (percent, two digits) of the edges (frame, source, target: names) that texts of queries (frame, text) touch by ids, types or the own vehicle.

    An id or type that a text asks for covers the edges with it in the name of an end; the word ego those from the own vehicle.
    """
    term = lambda kind, found: F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    quoted = lambda name: F.regexp_extract_all("text", F.lit(rf"{name}\s*[:=]\s*['\"](\w+)['\"]"), 1)
    ego = F.when(F.contains(F.lower("text"), F.lit("ego")), F.array(F.struct(F.lit("ego").alias("kind"), F.lit("ego").alias("term")))).otherwise(F.array().cast("array<struct<kind:string,term:string>>"))
    terms = queries.select("frame", F.explode(F.concat(term("id", quoted("unique_id")), term("type", F.transform(quoted("type"), F.lower)), ego)).alias("t")).select("frame", "t.*").distinct()
    has = lambda c: F.contains(c, F.col("term"))
    hit = F.when(F.col("kind") == "id", has(F.col("source")) | has(F.col("target"))).when(F.col("kind") == "type", has(F.lower("source")) | has(F.lower("target"))).otherwise(F.col("source") == "ego")
    covered = edges.join(terms, "frame").where(hit).select("frame", "source", "target").distinct().groupBy("frame").agg(F.count("*").alias("covered"))
    total = edges.select("frame", "source", "target").distinct().groupBy("frame").agg(F.count("*").alias("total"))
    return total.join(covered, "frame", "left").select("frame", F.coalesce("covered", F.lit(0)).alias("covered"), "total", F.round(100.0 * F.coalesce("covered", F.lit(0)) / F.col("total"), 2).alias("rate"))


def known(value: Column) -> Column:
    return F.coalesce(~F.trim(value.cast("string")).isin("", "unknown", "null", "None"), F.lit(False))


#: What a template may require of a context, by name.
REQUIREMENTS = {
    "ego_src": lambda: F.coalesce(F.col("src_id") == "ego", F.lit(False)), "tgt_status": lambda: known(F.col("tgt_status")), "src_status": lambda: known(F.col("src_status")), "anc_status": lambda: known(F.col("anc_status")),
    "beyond_status": lambda: known(F.col("beyond_status")), "dist": lambda: known(F.col("dist_level")), "anc": lambda: F.coalesce(F.length("anc_id"), F.lit(0)) > 0, "beyond": lambda: F.coalesce(F.length("beyond_id"), F.lit(0)) > 0,
}


def applicable_templates(templates: dict[str, tuple[str, ...]]) -> Column:
    """The templates of which a context (src_id, tgt_status, src_status, anc_status, beyond_status, dist_level, anc_id, beyond_id) has all that they require, in the order given."""
    return F.array_compact(F.array(*[F.when(reduce(lambda x, y: x & y, [REQUIREMENTS[r]() for r in needs], F.lit(True)), name) for name, needs in templates.items()]))


def filled(template: Column, parts: dict[str, Column]) -> Column:
    """A template with its places {name} filled; null if one that it has is unknown."""
    for name, value in parts.items():
        place = F.lit(f"{{{name}}}")
        template = F.when(F.contains(template, place), F.when(known(value), F.replace(template, place, value.cast("string")))).otherwise(template)
    return template


def run_error(ms: Column, used: Column, depth: Column, unique: Column, method: Column, fails: Column, question: Column, limit: float = 29000) -> Column:
    """struct<error_type, detail> of a logged step of generation: the first that holds of a timeout, a query without a match, a lock that failed, a repeated word in the question; else OK."""
    told = lambda kind, detail: F.struct(F.lit(kind).alias("error_type"), detail.alias("detail"))
    used = F.coalesce(used, F.lit(False))
    return (
        F.when((F.coalesce(ms, F.lit(0.0)) >= limit) & ~used, told("Timeout", F.format_string("timeout after %.0f ms", ms.cast("double")))).when(used & (F.coalesce(depth, F.lit(0)) == 0), told("QueryError", F.lit("no match in the query")))
        .when(~F.coalesce(unique, F.lit(False)) & (method == "yesno_fallback"), told("LockFailed", F.format_string("fallback after %d attempts", F.coalesce(fails, F.lit(0)).cast("int"))))
        .when(F.coalesce(question.rlike(r"(?i)\b(\w+) \1\b"), F.lit(False)), told("SemanticRedundant", F.lit("repeated word in the question"))).otherwise(told("OK", F.lit("")))
    )
