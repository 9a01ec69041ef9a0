"""Exact isomorphism classes of small graphs: types of nodes and labels of edges must agree.

Colours are refined inside each graph, a row with arrays of its nodes and neighbours: a node's colour takes in the colours of its neighbours by label and direction, as often as there are nodes.
Graphs whose sorted colours differ are not isomorphic. Where all colours of a graph differ, numbering nodes by colour is a canonical form, and equal forms are isomorphic graphs: a grouping. The
other graphs are compared with one graph of their colour class at a time, by a search that follows the colours; those that fail form the next turn. No pairs of a class are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import durable

def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, types, out, into: node types by place (ids in order), and for each place the edges from it and to it.

    nodes: graph, id, type; edges: graph, src, dst, label (several edges of a pair count each). A graph is one row, so it must be of bounded size.
    """
    ids = nodes.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("id", "type"))).alias("v"))
    lines = edges.groupBy("graph").agg(F.collect_list(F.struct("src", "dst", "label")).alias("e"))
    full = ids.join(lines, "graph", "left").withColumn("e", F.coalesce("e", F.array()))
    place = F.map_from_entries(F.transform("v", lambda n, i: F.struct(n["id"].alias("k"), i.alias("v"))))
    known = full.withColumn("p", place).withColumn("e", F.filter(F.transform("e", lambda x: F.struct(F.element_at("p", x["src"]).alias("a"), F.element_at("p", x["dst"]).alias("b"), x["label"].alias("label"))), lambda x: x["a"].isNotNull() & x["b"].isNotNull()))
    of = lambda one, other: F.transform("v", lambda n, i: F.array_sort(F.transform(F.filter("e", lambda x: x[one] == i), lambda x: F.struct(F.coalesce(x["label"], F.lit("")).alias("label"), x[other].alias("at")))))
    return known.select("graph", F.transform("v", lambda n: F.coalesce(n["type"], F.lit(""))).alias("types"), of("a", "b").alias("out"), of("b", "a").alias("into"))


def refined(graphs: DataFrame) -> DataFrame:
    """``graphs`` with ``colours`` of the places and ``key``, equal for graphs whose colours are the same in some order."""

    def step(colours, _):
        seen = lambda edges, way: F.array_sort(F.transform(edges, lambda x: F.xxhash64(F.lit(way), x["label"], F.get(colours, x["at"]))))
        return F.transform(colours, lambda c, i: F.xxhash64(c, seen(F.get("out", i), 1), seen(F.get("into", i), 2)))

    start = F.transform("types", lambda t: F.xxhash64(t))
    colours = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("types"), F.lit(1))), start, step)
    return graphs.withColumn("colours", colours).withColumn("key", F.xxhash64(F.array_sort("colours")))


def _canonical() -> F.Column:
    """The graph with places numbered by colour, as text; canonical where all colours differ."""
    order = F.array_sort("colours")
    rank = lambda i: F.array_position(order, F.get("colours", i))
    nodes = F.array_sort(F.transform("types", lambda t, i: F.concat_ws(" ", F.lpad(rank(i).cast("string"), 9, "0"), t)))
    edges = F.array_sort(F.flatten(F.transform("out", lambda es, i: F.transform(es, lambda x: F.concat_ws(" ", rank(i), rank(x["at"]), x["label"])))))
    return F.sha2(F.concat_ws("\n", F.concat_ws("|", nodes), F.concat_ws("|", edges)), 256)


def same_graph(a: dict, b: dict) -> bool:
    """Whether a bijection keeps types and labelled edges; both: types, out, colours. Searches place by place among those of equal colour."""
    n = len(a["types"])
    links = [{}, {}]
    for g, table in zip((a, b), links, strict=True):
        for i, es in enumerate(g["out"]):
            for e in es:
                table.setdefault((i, int(e["at"])), []).append(e["label"])
        for k in table:
            table[k].sort()
    if n != len(b["types"]) or len(links[0]) != len(links[1]):
        return False
    near = [set() for _ in range(n)]
    for i, j in links[0]:
        near[i].add(j)
        near[j].add(i)
    # connected places one after the other, so that a wrong choice is noticed early
    order, left = [], set(range(n))
    rare = sorted(range(n), key=lambda i: list(a["colours"]).count(a["colours"][i]))
    while left:
        todo = [next(i for i in rare if i in left)]
        left.discard(todo[0])
        for i in todo:
            order.append(i)
            new = sorted(near[i] & left)
            left -= set(new)
            todo += new
    image: dict[int, int] = {}

    def fits(i: int, j: int) -> bool:
        if a["types"][i] != b["types"][j] or a["colours"][i] != b["colours"][j]:
            return False
        pairs = [*image.items(), (i, j)]
        return all(links[0].get((i, p)) == links[1].get((j, q)) and links[0].get((p, i)) == links[1].get((q, j)) for p, q in pairs)

    # a stack of iterators instead of recursion: graphs may be deeper than Python allows
    stack = [iter(range(n))]
    used: set[int] = set()
    while stack:
        depth = len(stack) - 1
        if depth == n:
            return True
        i = order[depth]
        if i in image:
            used.discard(image.pop(i))
        j = next((j for j in stack[-1] if j not in used and fits(i, j)), None)
        if j is None:
            stack.pop()
        else:
            image[i] = j
            used.add(j)
            stack.append(iter(range(n)))
    return False


def isomorphism_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, class: the smallest graph that is isomorphic to it; each turn is written as a table, and there are as many turns as a colour class has graphs that differ."""
    graphs = refined(graph_rows(nodes, edges)).withColumn("distinct_colours", F.size(F.array_distinct("colours")) == F.size("colours"))
    graphs = durable(graphs, "graphs")
    told = graphs.where("distinct_colours").withColumn("form", _canonical())
    first = told.groupBy("key", "form").agg(F.min("graph").alias("class"))
    found = told.join(first, ["key", "form"]).select("graph", "class")
    rest = graphs.where(~F.col("distinct_colours")).select("graph", "key", "types", "out", "colours")
    while True:
        heads = rest.groupBy("key").agg(F.min("graph").alias("class"), F.min_by(F.struct("types", "out", "colours"), "graph").alias("head"))
        met = rest.join(heads, "key")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                same = [r["graph"] == r["class"] or same_graph(r, r["head"]) for r in rows]
                yield pa.RecordBatch.from_arrays([b.column("graph"), b.column("class"), pa.array(same, pa.bool_())], names=["graph", "class", "same"])

        kind = dict(graphs.dtypes)["graph"]
        judged = durable(met.select("graph", "class", "types", "out", "colours", "head").mapInArrow(compare, f"graph {kind}, class {kind}, same boolean"), "judged")
        found = found.unionByName(judged.where("same").select("graph", "class"))
        if judged.where(~F.col("same")).isEmpty():
            return found
        rest = durable(rest.join(judged.where(~F.col("same")).select("graph"), "graph", "left_semi"), "rest")
