"""Queries over a directed graph of nations and over imports between generated modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, imports
from ..session import checkpoint
from .adapters import nation_edges, table


def _name() -> Column:
    return F.concat(F.lit("p"), F.col("p_partkey").cast("string"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, dir)."""
    return table(spark, d, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("/b"), (F.col("p_size") % 7).cast("string")).alias("dir"))


def module_paths(spark: SparkSession, d: str) -> DataFrame:
    """(path) of :func:`modules`, for which no line is read."""
    return _parts(spark, d).select(F.concat("dir", F.lit("/"), _name(), F.lit(".py")).alias("path"))


def modules(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): parts as Python files; an order's first part imports the others.

    Odd lines import by full name, lines divisible by 4 an outside name, others by bare name.
    """
    p = _parts(spark, d)
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    first = line.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("importer"))
    full = F.concat_ws(".", F.replace("dir", F.lit("/"), F.lit(".")), _name())
    stated = F.when(F.col("l_linenumber") % 2 == 1, full).when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("vendor."), _name())).otherwise(_name())
    wanted = line.filter("l_linenumber > 1").join(first, "l_orderkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("importer", F.concat(F.lit("import "), stated).alias("stmt"))
    body = wanted.groupBy("importer").agg(F.array_join(F.array_sort(F.collect_set("stmt")), "\n").alias("text"))
    return p.join(body, F.col("p_partkey") == F.col("importer"), "left").select(F.concat("dir", F.lit("/"), _name(), F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return imports.resolve_python(imports.python_modules(modules(spark, d)), module_paths(spark, d))


def deps_classified(spark: SparkSession, d: str) -> DataFrame:
    return imports.classified(_resolved(spark, d))


def deps_regex(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import text

    return imports.regex_imports(text.lines(modules(spark, d))).select("src", "module")


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return imports.edges(_resolved(spark, d))


def module_import_counts(spark: SparkSession, d: str) -> DataFrame:
    return imports.module_counts(_resolved(spark, d))


def related(spark: SparkSession, d: str) -> DataFrame:
    m = checkpoint(modules(spark, d))
    path = m.filter(F.col("path").endswith("/p7.py")).first()["path"]
    return imports.related(m, imports.resolve_python(imports.python_modules(m.filter(F.col("path") == path)), m.select("path")), path)


def import_degrees(spark: SparkSession, d: str) -> DataFrame:
    e, nodes = _imports(spark, d)
    return graph.degrees(e, nodes)


def _nations(spark: SparkSession, d: str, per: int = 2) -> DataFrame:
    """The edges, of which operators make use several times."""
    return checkpoint(nation_edges(spark, d, per))


def _layered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _nations(spark, d)
    return e, checkpoint(graph.layers(e, graph.strong_components(e)))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_nations(spark, d))


def graph_scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_nations(spark, d))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_nations(spark, d, 1))


def graph_layers(spark: SparkSession, d: str) -> DataFrame:
    return _layered(spark, d)[1]


def graph_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.topological_order(_layered(spark, d)[1])


def graph_topology(spark: SparkSession, d: str) -> DataFrame:
    return graph.topology(*_layered(spark, d))


def graph_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(_nations(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


def graph_key_links(spark: SparkSession, d: str) -> DataFrame:
    e, layered = _layered(spark, d)
    return graph.key_links(graph.link_scores(e, graph.degrees(e), layered))


def graph_key_nodes(spark: SparkSession, d: str) -> DataFrame:
    e, layered = _layered(spark, d)
    return graph.key_nodes(graph.degrees(e), graph.betweenness(e), layered).withColumn("betweenness", F.round("betweenness", 6))


def layer_map(spark: SparkSession, d: str) -> DataFrame:
    e, layered = _layered(spark, d)
    return graph.layer_map(graph.degrees(e), layered)


def _imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return checkpoint(graph.distinct_edges(imports.edges(_resolved(spark, d)))), checkpoint(module_paths(spark, d).select(F.col("path").alias("node")))


def _layered_imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, nodes = _imports(spark, d)
    return e, nodes, checkpoint(graph.layers(e, checkpoint(graph.strong_components(e, nodes))))


def import_scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(*_imports(spark, d))


def import_components(spark: SparkSession, d: str) -> DataFrame:
    e, nodes = _imports(spark, d)
    return nodes.join(graph.connected_components(e), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def import_layers(spark: SparkSession, d: str) -> DataFrame:
    return _layered_imports(spark, d)[2]


def import_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.topological_order(_layered_imports(spark, d)[2])


def import_topology(spark: SparkSession, d: str) -> DataFrame:
    e, _, layered = _layered_imports(spark, d)
    return graph.topology(e, layered)


def import_key_links(spark: SparkSession, d: str) -> DataFrame:
    e, nodes, layered = _layered_imports(spark, d)
    return graph.key_links(graph.link_scores(e, graph.degrees(e, nodes), layered))


QUERIES = {f.__name__: f for f in (
    deps_classified, deps_regex, import_edges, module_import_counts, related, import_degrees,
    graph_degrees, graph_scc, graph_components, graph_layers, graph_order, graph_topology, graph_betweenness, graph_key_links, graph_key_nodes, layer_map,
    import_scc, import_components, import_layers, import_order, import_topology, import_key_links,
)}

_MODS = """p AS (SELECT p_partkey, lower(p_type) || '/b' || (p_size % 7) AS dir FROM part), f AS (SELECT l_orderkey, l_partkey AS importer FROM lineitem WHERE l_linenumber = 1),
w AS (SELECT DISTINCT a.dir || '/p' || importer || '.py' AS src, a.dir AS here, CASE WHEN l_linenumber % 2 = 1 THEN replace(b.dir, '/', '.') || '.p' || l_partkey WHEN l_linenumber % 4 = 0 THEN 'vendor.p' || l_partkey ELSE 'p' || l_partkey END AS module,
 CASE WHEN l_linenumber % 2 = 1 OR (l_linenumber % 4 <> 0 AND a.dir = b.dir) THEN b.dir || '/p' || l_partkey || '.py' END AS dst
 FROM lineitem l JOIN f USING (l_orderkey) JOIN p a ON a.p_partkey = importer JOIN p b ON b.p_partkey = l_partkey WHERE l_linenumber > 1)"""


def _nat(per: int = 2) -> str:
    return f"""rev AS (SELECT cn.n_name AS src, sn.n_name AS dst, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_name <> sn.n_name GROUP BY ALL),
e AS (SELECT src, dst FROM rev QUALIFY row_number() OVER (PARTITION BY src ORDER BY r DESC, dst) <= {per}), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


_DEG = "deg AS (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS fan_in, (SELECT count(*) FROM e WHERE src = node) AS fan_out FROM v)"
_SCC = _nat() + """, reach(s, t) AS (SELECT src, dst FROM e UNION SELECT reach.s, e.dst FROM reach JOIN e ON e.src = reach.t),
scc AS (SELECT node, least(node, coalesce((SELECT min(a.t) FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s WHERE a.s = node), node)) AS comp FROM v)"""
_LAY = _SCC + """, dag AS (SELECT DISTINCT a.comp AS src, b.comp AS dst FROM e JOIN scc a ON a.node = e.src JOIN scc b ON b.node = e.dst WHERE a.comp <> b.comp),
dep(c, k) AS (SELECT comp, 0 FROM scc UNION SELECT dag.src, dep.k + 1 FROM dep JOIN dag ON dag.dst = dep.c), lay AS (SELECT node, comp, layer FROM scc JOIN (SELECT c AS comp, max(k) AS layer FROM dep GROUP BY c) USING (comp)), """ + _DEG
_BET = """dist(s, t, k) AS (SELECT node, node, 0 FROM v UNION SELECT s, e.dst, k + 1 FROM dist JOIN e ON e.src = t WHERE k < 25), d AS (SELECT s, t, min(k) AS k FROM dist GROUP BY s, t),
walk(s, t, k) AS (SELECT node, node, 0 FROM v UNION ALL SELECT walk.s, e.dst, walk.k + 1 FROM walk JOIN e ON e.src = walk.t JOIN d ON d.s = walk.s AND d.t = e.dst AND d.k = walk.k + 1), sg AS (SELECT s, t, k, count(*) AS n FROM walk GROUP BY ALL),
bet AS (SELECT node, round(coalesce(b, 0), 6) AS betweenness FROM v LEFT JOIN (SELECT a.t AS node, sum(a.n * b.n / c.n) AS b FROM sg a JOIN sg b ON b.s = a.t JOIN sg c ON c.s = a.s AND c.t = b.t AND c.k = a.k + b.k WHERE a.t <> a.s AND a.t <> b.t AND a.s <> b.t GROUP BY a.t) USING (node))"""

ORACLE_SQL = {
    "deps_classified": f"WITH {_MODS} SELECT DISTINCT src, module, CASE WHEN dst IS NULL THEN 'external' ELSE 'internal' END AS class FROM w",
    "deps_regex": f"WITH {_MODS} SELECT DISTINCT src, module FROM w",
    "import_edges": f"WITH {_MODS} SELECT DISTINCT src, dst FROM w WHERE dst IS NOT NULL AND dst <> src",
    "module_import_counts": f"WITH {_MODS} SELECT module, count(DISTINCT src) AS importers FROM w WHERE dst IS NOT NULL GROUP BY module",
    "import_degrees": f"WITH {_MODS}, e AS (SELECT DISTINCT src, dst FROM w WHERE dst IS NOT NULL AND dst <> src), i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), o AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT dir || '/p' || p_partkey || '.py' AS node, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM p LEFT JOIN i ON i.dst = dir || '/p' || p_partkey || '.py' LEFT JOIN o ON o.src = dir || '/p' || p_partkey || '.py'",
    "related": f"""WITH {_MODS}, me AS (SELECT dir || '/p7' AS stem FROM p WHERE p_partkey = 7) SELECT DISTINCT 'forward' AS direction, dst AS path FROM w, me WHERE src = stem || '.py' AND dst IS NOT NULL
UNION SELECT 'reverse', src FROM w, me WHERE src <> stem || '.py' AND contains(module, 'p7')""",
    "graph_degrees": f"WITH {_nat()}, {_DEG} SELECT * FROM deg",
    "graph_scc": f"WITH RECURSIVE {_SCC} SELECT node, comp FROM scc",
    "graph_components": f"WITH RECURSIVE {_nat(1)}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, min(b) AS root FROM r GROUP BY a",
    "graph_layers": f"WITH RECURSIVE {_LAY} SELECT node, comp, layer FROM lay",
    "graph_order": f"WITH RECURSIVE {_LAY} SELECT comp, row_number() OVER (ORDER BY layer DESC, comp) - 1 AS position FROM (SELECT DISTINCT comp, layer FROM lay)",
    "graph_topology": f"WITH RECURSIVE {_LAY}, s AS (SELECT comp, count(*) AS n FROM lay GROUP BY comp) SELECT (SELECT count(*) FROM lay) AS nodes, (SELECT max(layer) FROM lay) AS max_layer, count(*) AS components, max(n) AS largest, count(*) FILTER (WHERE n > 1) AS cyclic, (SELECT count(*) FROM e) AS edges FROM s",
    "graph_betweenness": f"WITH RECURSIVE {_nat()}, {_BET} SELECT node, betweenness FROM bet",
    "graph_key_links": f"WITH RECURSIVE {_LAY} SELECT e.src, e.dst, a.layer - b.layer AS layer_drop, (x.fan_out + 1) * (y.fan_in + 1) * (greatest(a.layer - b.layer, 0) + 1) AS score FROM e JOIN lay a ON a.node = e.src JOIN lay b ON b.node = e.dst JOIN deg x ON x.node = e.src JOIN deg y ON y.node = e.dst ORDER BY score DESC, e.src, e.dst LIMIT 12",
    "graph_key_nodes": f"WITH RECURSIVE {_LAY}, {_BET} SELECT node, fan_in, fan_out, betweenness, layer FROM deg JOIN bet USING (node) JOIN lay USING (node) ORDER BY fan_in + fan_out + betweenness DESC, node LIMIT 10",
    "layer_map": f"""WITH RECURSIVE {_LAY}, r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY fan_in DESC, node) AS k, count(*) OVER (PARTITION BY layer) AS n FROM lay JOIN deg USING (node))
SELECT layer, max(n) AS n_files, string_agg(node, ', ' ORDER BY k) FILTER (WHERE k <= 8) || CASE WHEN max(n) > 8 THEN ', ... (+' || (max(n) - 8) || ' more)' ELSE '' END AS listing FROM r GROUP BY layer""",
}

_IMP = _MODS + """, e AS (SELECT DISTINCT src, dst FROM w WHERE dst IS NOT NULL AND dst <> src), v AS (SELECT dir || '/p' || p_partkey || '.py' AS node FROM p)"""
_U = "u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e UNION SELECT node, node FROM v), r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)"
ORACLE_SQL |= {f"import_{k}": ORACLE_SQL[f"graph_{k}"].replace(_nat(), _IMP) for k in ("scc", "layers", "order", "topology", "key_links")}
ORACLE_SQL["import_components"] = f"WITH RECURSIVE {_IMP}, {_U} SELECT a AS node, min(b) AS root FROM r GROUP BY a"
