"""Plans for questions over gaps: which references and attributes single out a target, dry runs of chains, and what coverage follows from coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as G

from .coverage import edge_key, path_key

#: Order of the distance levels, and the types that a scene may hold.
LEVELS = ("near", "mid", "far")
#: Single conditions of a cell (source and coarse direction), in order of preference, that are equality of attributes.
EQUAL = (
    ("type", ("dst_type",)), ("status", ("dst_status",)), ("type_status", ("dst_type", "dst_status")), ("dir8", ("dir8",)), ("dual_reference", ("dir8", "own_dir8")),
    ("type_level", ("dst_type", "level")), ("type_dir8_level", ("dst_type", "dir8", "level")), ("all", ("dst_type", "dir8", "dst_status", "level")),
)
#: All fifteen methods in order of preference.
ORDER = ("type", "status", "type_status", "dir8", "dual_reference", "level_order", "type_level", "type_dir8_level", "all", "distance_order", "two_hop", "dual_hop", "anchor", "count", "yes_no")
#: Attributes of the subset search, and its steps: subsets by size around the referents.
ATTRIBUTES = ("dst_type", "dst_status", "dir8", "level")


def _alone(*columns: str) -> Column:
    return F.count("*").over(Window.partitionBy("frame", "src", "dir4", *columns)) == 1


def referents(edges: DataFrame) -> DataFrame:
    """frame, dst, ref, siblings (ids that the reference sees with this type in this direction), n, rank: who else sees a target, those with the fewest siblings first."""
    seen = edges.groupBy("frame", F.col("src").alias("ref"), "dst_type", "dir8").agg(F.array_sort(F.collect_set("dst")).alias("siblings"))
    out = edges.select("frame", "dst", F.col("src").alias("ref"), "dst_type", "dir8", "dist").join(seen, ["frame", "ref", "dst_type", "dir8"]).withColumn("n", F.size("siblings"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("frame", "dst").orderBy("n", "dist", "ref")))


def constraint_methods(edges: DataFrame, most: int = 6) -> DataFrame:
    """Each edge with the first of the fifteen methods that singles out its target among those in the same coarse direction of its source.

    edges: also dst_status, src_status and own_dir8 (the direction of the target seen from the own vehicle). Equality of attributes is a window count; order by level or distance is strict and among
    targets of one type and fine direction, of which there must be others; a two-hop referent sees the target alone, two referents (of the ``most`` first) have only the target in common.
    """
    same = Window.partitionBy("frame", "src", "dir4", "dst_type", "dir8")
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    strict = lambda v: (F.count("*").over(same) > 1) & (F.count("*").over(Window.partitionBy("frame", "src", "dir4", "dst_type", "dir8", v)) == 1) & ((F.col(v) == F.min(v).over(same)) | (F.col(v) == F.max(v).over(same)))
    out = edges.withColumn("_rank", rank).withColumns({f"by_{n}": _alone(*c) for n, c in EQUAL} | {"by_level_order": strict("_rank"), "by_distance_order": strict("dist") & (F.col("dist") > 0)})
    refs = referents(edges)
    one = refs.where("n = 1").select("frame", "dst", "ref")
    # the source itself is no referent: another one must see the target alone
    alone = one.groupBy("frame", "dst").agg(F.count("*").alias("_refs"))
    own = one.select("frame", "dst", F.col("ref").alias("src"), F.lit(1).alias("_own"))
    few = refs.where(F.col("rank") <= most).select("frame", "dst", "rank", "siblings")
    pair = few.alias("p").join(few.alias("q"), ["frame", "dst"]).where("p.rank < q.rank and size(array_intersect(p.siblings, q.siblings)) = 1").select("frame", "dst").distinct().withColumn("_dual", F.lit(True))
    out = out.join(alone, ["frame", "dst"], "left").join(own, ["frame", "dst", "src"], "left").join(pair, ["frame", "dst"], "left")
    out = out.withColumns({"by_two_hop": F.coalesce(F.col("_refs"), F.lit(0)) > F.coalesce(F.col("_own"), F.lit(0)), "by_dual_hop": F.coalesce("_dual", F.lit(False)), "by_anchor": F.col("src_status").isNotNull(), "by_count": F.col("dst_type").isNotNull(), "by_yes_no": F.lit(True)})
    return out.withColumn("method", F.coalesce(*[F.when(F.col(f"by_{m}"), F.lit(m)) for m in ORDER])).drop("_rank", "_refs", "_own", "_dual")


def smallest_subsets(marked: DataFrame) -> DataFrame:
    """``marked`` (from constraint_methods) with ``subset``: the fewest attributes that leave one target: one or two of them, a two-hop referent, three or four, two referents, else the anchor."""
    subsets = [[c for k, c in enumerate(ATTRIBUTES) if bits >> k & 1] for bits in range(1, 16)]
    subsets.sort(key=lambda s: (len(s), [ATTRIBUTES.index(c) for c in s]))
    first = lambda sizes: [F.when(_alone(*s), F.lit("+".join(s))) for s in subsets if len(s) in sizes]
    return marked.withColumn("subset", F.coalesce(*first((1, 2)), F.when(F.col("by_two_hop"), F.lit("two_hop")), *first((3, 4)), F.when(F.col("by_dual_hop"), F.lit("dual_hop")), F.lit("anchor")))


def chain_answers(paths: DataFrame, least_gap: float = 0.5) -> DataFrame:
    """Dry runs of paths a, b, c with coordinates and headings (ax, ay, ayaw and so on): closer (a or c, null when the distances differ by less than ``least_gap``) and same_direction (of b from a, and of c from b)."""
    ab, bc = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")), F.hypot(F.col("bx") - F.col("cx"), F.col("by") - F.col("cy"))
    one, two = (G.dir6(G.bearing(F.col(f"{q}x") - F.col(f"{p}x"), F.col(f"{q}y") - F.col(f"{p}y"), F.col(f"{p}yaw"))) for p, q in ("ab", "bc"))
    return paths.withColumns({"closer": F.when(F.abs(ab - bc) >= least_gap, F.when(ab < bc, "a").otherwise("c")), "same_direction": one == two})


def inferred_paths(pairs: DataFrame) -> DataFrame:
    """frame, key: the paths that follow from covered pairs (frame, u, v as text), as two covered pairs share a pivot."""
    both = pairs.select("frame", F.col("u").alias("pivot"), F.col("v").alias("n")).unionByName(pairs.select("frame", F.col("v").alias("pivot"), F.col("u").alias("n"))).distinct()
    met = both.alias("p").join(both.alias("q"), ["frame", "pivot"]).where("p.n < q.n")
    return met.select("frame", path_key(F.col("p.n"), F.col("pivot"), F.col("q.n")).alias("key"))


def branch_candidates(edges: DataFrame) -> DataFrame:
    """Each edge with ``branch``: how many targets its source sees with the same type and dir6 (the candidates of one branch of a diverging question)."""
    return edges.withColumn("branch", F.count("*").over(Window.partitionBy("frame", "src", "dst_type", "dir6")))


def converge_candidates(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """frame, a, c, b, candidates: for each target b that both a and c see, the nodes of its type that they see in the same directions."""
    view = lambda end: edges.select("frame", F.col("src").alias(end), F.col("dst").alias("b"), F.col("dst_type").alias("kind"), F.col("dir6").alias(f"dir_{end}"))
    seen = pairs.join(view("a"), ["frame", "a"]).join(view("c"), ["frame", "c", "b", "kind"])
    return seen.select("frame", "a", "c", "b", F.count("*").over(Window.partitionBy("frame", "a", "c", "kind", "dir_a", "dir_c")).alias("candidates"))


def missing_types(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """frame, missing: the types that a frame lacks, in order, joined by |."""
    have = nodes.groupBy("frame").agg(F.collect_set("type").alias("have"))
    return have.select("frame", F.array_join(F.array_except(F.array(*[F.lit(t) for t in types]), "have"), "|").alias("missing"))


def restored(rows: DataFrame) -> DataFrame:
    """frame, level, key: coverage of earlier questions (frame, passed, text, a, b, c) that passed and whose text names the target b."""
    good = rows.where(F.col("passed") & F.contains("text", F.col("b")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    parts = F.array(*[F.struct(F.lit(x).alias("level"), k.alias("key")) for x, k in (("L0", a), ("L0", b), ("L0", c), ("L1", edge_key(a, b)), ("L1", edge_key(b, c)), ("L2", path_key(a, b, c)))])
    return good.select("frame", F.explode(parts).alias("h")).select("frame", "h.*").distinct()


def authentic(rows: DataFrame) -> DataFrame:
    """``rows`` (ids, text, results array<array<string>>) whose text names every id and of which some result row holds them all."""
    named = F.forall("ids", lambda i: F.contains(F.col("text"), i))
    return rows.where(named & F.exists("results", lambda r: F.size(F.array_except(F.col("ids"), r)) == 0))


def plateau(curve: DataFrame, within: float = 0.01) -> DataFrame:
    """frame, level, ord: the first step from which the rate stays within ``within`` of its last value."""
    last = F.max_by("rate", "ord").over(Window.partitionBy("frame", "level"))
    off = curve.withColumn("_off", F.when(F.abs(F.col("rate") - last) > within, F.col("ord")))
    return off.groupBy("frame", "level").agg(F.min(F.when(F.col("_off").isNull(), F.col("ord"))).alias("_first"), F.max("_off").alias("_late"), F.collect_set("ord").alias("_all")).select("frame", "level", F.coalesce(F.array_min(F.filter("_all", lambda x: x > F.col("_late"))), F.col("_first")).alias("ord"))


def plateau_step(curve: DataFrame, window: int = 10, least: int = 1) -> DataFrame:
    """frame, level, ord: the step at which ``window`` successive steps have each added ``least`` keys or fewer; null where that never happens. curve: frame, level, ord, new_keys."""
    w = Window.partitionBy("frame", "level").orderBy("ord")
    # the last step that added more restarts the count
    more = F.sum(F.when(F.col("new_keys") > least, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = curve.withColumn("_run", more).withColumn("_small", F.count_if(F.col("new_keys") <= least).over(Window.partitionBy("frame", "level", "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("frame", "level").agg(F.min(F.when(F.col("_small") >= window, F.col("ord"))).alias("ord"))
