"""Directed graphs as (src, dst) edges: components, layers, centrality, link scores."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Vertices above which closures of the graph are refused: they have a row for each pair.
CLOSURE_LIMIT = 20_000


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least vertex of each vertex's undirected component.

    Large-star and small-star rounds, logarithmic in the diameter; lineage is cut each round.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = checkpoint(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = state(e)
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = checkpoint(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low).distinct())
        now = state(small)
        if now == before:
            roots = small.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(small.select("v", "v")).distinct()
        e, before = small, now


def reachability(edges: DataFrame) -> DataFrame:
    """(src, dst) of all vertices joined by a path of at least one edge, by doubling path lengths."""
    e = checkpoint(distinct_edges(edges))
    if vertices(e).count() > CLOSURE_LIMIT:
        raise ValueError(f"the closure of more than {CLOSURE_LIMIT} vertices is refused")
    n = e.count()
    while True:
        step = e.alias("x").join(e.alias("y"), F.col("x.dst") == F.col("y.src")).select("x.src", "y.dst")
        e = checkpoint(e.union(step).distinct())
        m = e.count()
        if m == n:
            return e
        n = m


def trim(edges: DataFrame) -> DataFrame:
    """``edges``, a checkpoint, without those that lie on no cycle because an end has no edge in or none out."""
    n = edges.count()
    while n:
        kept = checkpoint(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = kept.count()
        if m == n:
            break
        edges, n = kept, m
    return edges


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """(node, comp): the least vertex that can be reached from the node and reaches it.

    Without a ``closure``, by colours: each vertex takes the least one that reaches it; those of a
    colour that reach its first vertex are a component, and edges among the others of a colour go to
    the next round. Rows are vertices and edges, never pairs; steps are as many as the longest such
    path, and lineage is cut at each.
    """
    v = vertices(edges) if nodes is None else nodes.select("node").union(vertices(edges)).distinct()
    if closure is not None:
        back = closure.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        mutual = closure.join(back, ["src", "dst"], "left_semi").groupBy("src").agg(F.min("dst").alias("low"))
        return v.join(mutual, v["node"] == mutual["src"], "left").select("node", F.least("node", F.coalesce("low", "node")).alias("comp"))
    rest, found = trim(checkpoint(distinct_edges(edges))), None
    while not rest.isEmpty():
        colour = vertices(rest).select("node", F.col("node").alias("colour"), F.lit(True).alias("moved"))
        while True:
            sent = colour.filter("moved").select("node", "colour")  # of the others neighbours know
            near = rest.join(sent, rest["src"] == sent["node"]).groupBy("dst").agg(F.min("colour").alias("low"))
            colour = checkpoint(colour.join(near, colour["node"] == near["dst"], "left").select("node", F.least("colour", "low").alias("colour"), F.coalesce(F.col("low") < F.col("colour"), F.lit(False)).alias("moved")))
            if colour.filter("moved").isEmpty():
                break
        a, b = colour.select(F.col("node").alias("src"), "colour"), colour.select(F.col("node").alias("dst"), F.col("colour").alias("other"))
        inside = checkpoint(rest.join(a, "src").join(b, "dst").filter("colour = other").select("src", "dst", "colour"))
        done = checkpoint(colour.filter("node = colour").select("node", F.col("colour").alias("comp")))
        new = done
        while not new.isEmpty():
            new = checkpoint(inside.join(new, inside["dst"] == new["node"]).select(F.col("src").alias("node"), F.col("colour").alias("comp")).distinct().join(done, "node", "left_anti"))
            done = checkpoint(done.union(new))
        found = done if found is None else checkpoint(found.union(done))
        left = inside.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
        rest = trim(checkpoint(left.select("src", "dst")))
    if found is None:
        return v.select("node", F.col("node").alias("comp"))
    return v.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def condensation(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(src, dst) between components."""
    a, b = comps.select(F.col("node").alias("src"), F.col("comp").alias("cs")), comps.select(F.col("node").alias("dst"), F.col("comp").alias("cd"))
    return edges.join(a, "src").join(b, "dst").filter("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def layers(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, comp, layer): the longest path of components below; 0 for those without out-edges."""
    dag = checkpoint(condensation(edges, comps))
    level = checkpoint(comps.select("comp").distinct().select("comp", F.lit(0).alias("layer"), F.lit(True).alias("moved")))
    while True:
        sent = level.filter("moved").select("comp", "layer")  # what didn't move has been counted
        up = dag.join(sent, dag["dst"] == sent["comp"]).groupBy("src").agg((F.max("layer") + 1).alias("up"))
        level = checkpoint(level.join(up, level["comp"] == up["src"], "left").select("comp", F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer"), F.coalesce(F.col("up") > F.col("layer"), F.lit(False)).alias("moved")))
        if level.filter("moved").isEmpty():
            return comps.join(level, "comp").select("node", "comp", "layer")


def topological_order(layered: DataFrame) -> DataFrame:
    """(comp, position): dependents before what they depend on; by layer, then name."""
    c = layered.select("comp", "layer").distinct()
    return c.select("comp", (F.row_number().over(Window.orderBy(F.desc("layer"), "comp")) - 1).alias("position"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, fan_in, fan_out)."""
    e = distinct_edges(edges)
    v = vertices(e) if nodes is None else nodes.select("node")
    i = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    o = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    return v.join(i, "node", "left").join(o, "node", "left").fillna(0, ["fan_in", "fan_out"])


def betweenness(edges: DataFrame, nodes: DataFrame | None = None, max_sources: int = 120) -> DataFrame:
    """(node, betweenness): directed, unnormalised, from shortest paths of all sources.

    Beyond ``max_sources`` vertices every (n // max_sources)-th one by name is a source, and sums are
    scaled up. Sources are rows; each task walks its sources over the adjacency of the graph, which
    is collected and sent to it.
    """
    e = checkpoint(distinct_edges(edges))
    v = (vertices(e) if nodes is None else nodes.select("node")).distinct()
    n = v.count()
    adjacency = {r["src"]: sorted(r["to"]) for r in e.groupBy("src").agg(F.collect_list("dst").alias("to")).collect()}
    step = max(1, n // max_sources) if n > max_sources else 1
    picked = v.withColumn("k", F.row_number().over(Window.orderBy("node")) - 1).filter((F.col("k") % step == 0))
    if n > max_sources:
        picked = picked.filter(F.col("k") < step * max_sources)
    scale = n / max(1, min(max_sources, -(-n // step))) if n > max_sources else 1.0

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: dict[str, float] = {}
            for s in b["node"]:
                order, dist, paths, before = [], {s: 0}, {s: 1.0}, {s: []}
                queue = deque([s])
                while queue:
                    x = queue.popleft()
                    order.append(x)
                    for y in adjacency.get(x, ()):
                        if y not in dist:
                            dist[y], paths[y], before[y] = dist[x] + 1, 0.0, []
                            queue.append(y)
                        if dist[y] == dist[x] + 1:
                            paths[y] += paths[x]
                            before[y].append(x)
                gain = dict.fromkeys(order, 0.0)
                for y in reversed(order):
                    for x in before[y]:
                        gain[x] += paths[x] / paths[y] * (1.0 + gain[y])
                    if y != s:
                        total[y] = total.get(y, 0.0) + gain[y]
            yield pd.DataFrame({"node": list(total), "b": list(total.values())}, columns=["node", "b"])

    sums = picked.select("node").mapInPandas(walk, "node string, b double").groupBy("node").agg(F.sum("b").alias("b"))
    return v.join(sums, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def link_scores(edges: DataFrame, degree: DataFrame, layered: DataFrame) -> DataFrame:
    """(src, dst, layer_drop, score): (fan_out + 1) (fan_in + 1) (layers dropped + 1)."""
    d = degree.join(layered.select("node", "layer"), "node")
    a = d.select(F.col("node").alias("src"), F.col("fan_out").alias("out"), F.col("layer").alias("ls"))
    b = d.select(F.col("node").alias("dst"), F.col("fan_in").alias("into"), F.col("layer").alias("ld"))
    j = distinct_edges(edges).join(a, "src").join(b, "dst").withColumn("layer_drop", F.col("ls") - F.col("ld"))
    return j.select("src", "dst", "layer_drop", ((F.col("out") + 1) * (F.col("into") + 1) * (F.greatest("layer_drop", F.lit(0)) + 1)).alias("score"))


def key_links(scores: DataFrame, top: int = 12) -> DataFrame:
    return scores.orderBy(F.desc("score"), "src", "dst").limit(top)


def key_nodes(degree: DataFrame, centrality: DataFrame, layered: DataFrame, top: int = 10) -> DataFrame:
    j = degree.join(centrality, "node").join(layered.select("node", "layer"), "node")
    return j.orderBy(F.desc(F.col("fan_in") + F.col("fan_out") + F.col("betweenness")), "node").limit(top)


def layer_map(degree: DataFrame, layered: DataFrame, shown: int = 8, files: int = 8) -> DataFrame:
    """(layer, n_files, listing): up to ``shown`` layers (the first ones and the last), ``files`` names each."""
    j = degree.join(layered.select("node", "layer"), "node")
    w = Window.partitionBy("layer").orderBy(F.desc("fan_in"), "node")
    n = j.groupBy("layer").agg(F.count("*").alias("n_files"))
    named = j.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= files).groupBy("layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]), ", ").alias("names"))
    out = named.join(n, "layer").withColumn("pos", F.row_number().over(Window.orderBy("layer"))).withColumn("n_layers", F.count("*").over(Window.partitionBy(F.lit(0))))
    kept = out.filter((F.col("n_layers") <= shown) | (F.col("pos") < shown) | (F.col("pos") == F.col("n_layers")))
    more = F.when(F.col("n_files") > files, F.concat(F.lit(", ... (+"), (F.col("n_files") - files).cast("string"), F.lit(" more)"))).otherwise("")
    return kept.select("layer", "n_files", F.concat("names", more).alias("listing"))


def topology(edges: DataFrame, layered: DataFrame) -> DataFrame:
    """One row of totals: nodes, edges, components, the largest, those with cycles, the top layer."""
    size = layered.groupBy("comp").agg(F.count("*").alias("s"))
    a = layered.agg(F.count("*").alias("nodes"), F.max("layer").alias("max_layer"))
    b = size.agg(F.count("*").alias("components"), F.max("s").alias("largest"), F.count_if(F.col("s") > 1).alias("cyclic"))
    return a.crossJoin(b).crossJoin(distinct_edges(edges).agg(F.count("*").alias("edges")))
