"""Queries over directories and notebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import notebook, signatures, tree
from ..session import checkpoint
from .adapters import spread, table


def _tree(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat_ws("/", F.lower("p_type"), "p_brand", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).alias("path"), F.col("p_size").cast("bigint").alias("loc"))


def _churn(spark: SparkSession, d: str) -> DataFrame:
    """Lines sold of each part, as changes of its file."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("/", F.lower("p_type"), "p_brand", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).alias("path"))
    return table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("path").agg(F.count("*").alias("commits"), F.sum("l_quantity").cast("bigint").alias("lines"))


def dir_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tree.directory_stats(_tree(spark, d)).withColumn("importance", F.round("importance", 6))


def dir_rollup_churn(spark: SparkSession, d: str) -> DataFrame:
    s = tree.directory_stats(_tree(spark, d), _churn(spark, d))
    return s.withColumns({"importance": F.round("importance", 6), "hot_files": F.array_join("hot_files", ";")})


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree.nodes(_tree(spark, d), 2)


def tree_lines(spark: SparkSession, d: str) -> DataFrame:
    return tree.tree_lines(_tree(spark, d))


def tree_budgeted(spark: SparkSession, d: str) -> DataFrame:
    return tree.expand_budgeted(_tree(spark, d), 50, _churn(spark, d))


def module_summaries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    files = p.select(F.concat(F.lower("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.element_at(F.array(F.lit(".py"), F.lit(".sh"), F.lit(".MD")), (F.col("p_size") % 3 + 1).cast("int"))).alias("path"), "p_partkey", "p_type", "p_size")
    tags = files.select("path", F.col("p_type").alias("name"), F.col("p_size").alias("line"), F.lit(None).cast("string").alias("scope"))
    s = tree.top_directory_summary(files.select("path"), tags)
    kinds = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("dir", "files", kinds.alias("types"), F.array_join("symbols", ",").alias("symbols"))


def file_importance(spark: SparkSession, d: str) -> DataFrame:
    j = _tree(spark, d).join(_churn(spark, d), "path", "left").fillna(0, ["commits", "lines"])
    return j.select("path", F.round(tree.file_importance(F.col("loc"), F.col("commits"), F.col("lines")), 6).alias("importance"), F.round(tree.file_importance(F.col("loc")), 6).alias("plain"))


def _notebooks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as notebook JSON: user turns are code, with the turn's text as output and every third an error."""
    t = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "code").when(F.col("role") == "assistant", "markdown").otherwise("raw")
    frames = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit('\u001b[0;31m  File "src/m'), i.cast("string"), F.lit('.py", line '), (F.col("conv_id") % 50 + i).cast("string"), F.lit(", in f\u001b[0m")))
    null = lambda k: F.lit(None).cast(k)
    out = lambda kind_, text, data, en, ev, tb: F.struct(F.lit(kind_).alias("output_type"), text.alias("text"), data.alias("data"), en.alias("ename"), ev.alias("evalue"), tb.alias("traceback"))
    s, m, a = null("string"), null("map<string,string>"), null("array<string>")
    outs = F.array(out("stream", F.col("text"), m, s, s, a), out("display_data", s, F.create_map(F.lit("image/png"), F.lit("aa")), s, s, a), out("error", s, m, F.lit("ValueError"), F.concat(F.lit("bad "), F.col("turn").cast("string")), frames))
    chosen = F.when(kind == "code", F.when(F.col("turn") % 3 == 0, outs).otherwise(F.slice(outs, 1, 2)))
    cell = F.struct("turn", F.struct(kind.alias("cell_type"), F.col("text").alias("source"), F.col("turn").cast("int").alias("execution_count"), chosen.alias("outputs")).alias("c"))
    nb = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn"), F.to_json(cell["c"]).alias("j")))), lambda x: x["j"]).alias("cells"))
    text = F.concat(F.lit('{"metadata":{"kernelspec":{"language":"python","name":"python3"}},"cells":['), F.array_join("cells", ","), F.lit("]}"))
    return nb.select(F.concat(F.lit("nb/"), F.col("conv_id").cast("string"), F.lit(".ipynb")).alias("path"), text.alias("text"))


def notebook_cells(spark: SparkSession, d: str) -> DataFrame:
    return notebook.cells(notebook.parse(_notebooks(spark, d))).select("path", "pos", "cell_type", "execution_count", "source")


def notebook_counts(spark: SparkSession, d: str) -> DataFrame:
    return notebook.cell_counts(notebook.cells(notebook.parse(_notebooks(spark, d))))


def notebook_outputs(spark: SparkSession, d: str) -> DataFrame:
    return notebook.outputs(notebook.cells(notebook.parse(_notebooks(spark, d))))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    c, k = F.col("c").cast("string"), F.col("o_orderkey").cast("string")
    tb = F.array(
        F.concat(F.lit('  File "src/p'), c, F.lit('.py", line '), k, F.lit(", in run")), F.concat(F.lit("File /repo/src/p"), c, F.lit(".py:12, in go(x)")), F.concat(F.lit("Cell In["), c, F.lit("], line 4")),
        F.concat(F.lit("Input In ["), c, F.lit("], in <module>")), F.lit("ValueError: no frame"), F.lit("\u001b[1mFile \u001b[0;32m/usr/lib/x.py:7"),
    )
    return notebook.parse_frames(o.select("o_orderkey", tb.alias("traceback")), ["o_orderkey"])


def traceback_frames(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d)


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """A file for each customer with a positive balance; frames of others lie outside."""
    return table(spark, d, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("src/p"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"))


def frame_classify(spark: SparkSession, d: str) -> DataFrame:
    return notebook.classify_frames(_frames(spark, d), _paths(spark, d), "/repo").select("o_orderkey", "frame_no", "frame_path", "type")


def notebook_debug_summary(spark: SparkSession, d: str) -> DataFrame:
    return notebook.debug_summary(notebook.classify_frames(_frames(spark, d), _paths(spark, d), "/repo"), ["o_orderkey"])


def notebook_errors(spark: SparkSession, d: str) -> DataFrame:
    e = notebook.errors(notebook.cells(notebook.parse(_notebooks(spark, d))))
    return e.select("path", "pos", "ename", "evalue", F.size("traceback").alias("frames"))


def signatures_python(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of generated modules: an import, a class and a function each."""
    return signatures.python_sketches(_sources(spark, d), spans=True).select("path", F.array_join("sig", "\n").alias("sig"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "part").select("p_partkey", "p_size", F.regexp_replace("p_type", "[^A-Za-z]", "").alias("t")), "p_partkey")
    text = F.concat(F.lit('"""Part '), F.col("p_partkey").cast("string"), F.lit('."""\n\nclass '), "t", F.lit(':\n    def size(self):\n        return '), F.col("p_size").cast("string"), F.lit("\n\ndef f"), F.col("p_partkey").cast("string"), F.lit("(a, b=1):\n    pass\n"))
    return p.select(F.concat(F.lit("m/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"), F.col("p_size").cast("bigint").alias("loc"))


def signatures_budgeted(spark: SparkSession, d: str) -> DataFrame:
    s = checkpoint(_sources(spark, d))
    return signatures.budgeted(signatures.python_sketches(s, spans=True), s, 100).select("path", "tier", "rank")


QUERIES = {f.__name__: f for f in (
    dir_rollup, dir_rollup_churn, tree_nodes, tree_lines, tree_budgeted, module_summaries, file_importance, notebook_cells, notebook_counts, notebook_outputs, notebook_errors,
    traceback_frames, frame_classify, notebook_debug_summary, signatures_python, signatures_budgeted,
)}

_T = "tr AS (SELECT lower(p_type) || '/' || p_brand || '/' || p_name || ' ' || p_partkey AS path, lower(p_type) AS d1, lower(p_type) || '/' || p_brand AS d2, CAST(p_size AS BIGINT) AS loc, p_partkey FROM part)"
_C = "ch AS (SELECT path, count(*) AS commits, CAST(sum(l_quantity) AS BIGINT) AS lines FROM lineitem JOIN tr ON l_partkey = p_partkey GROUP BY path)"
_UP = "up AS (SELECT d1 AS dir, path, loc, d2 AS child FROM tr UNION ALL SELECT d2, path, loc, path FROM tr)"
_CELLS = "c AS (SELECT 'nb/' || conv_id || '.ipynb' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, conv_id, text, CASE role WHEN 'user' THEN 'code' WHEN 'assistant' THEN 'markdown' ELSE 'raw' END AS cell_type FROM conversations)"
_FR = r"""raw AS (SELECT o_orderkey, o_custkey, unnest([0, 1, 2, 3, 4, 5]) AS frame_no, unnest(['  File "src/p' || o_custkey || '.py", line ' || o_orderkey || ', in run', 'File /repo/src/p' || o_custkey || '.py:12, in go(x)', 'Cell In[' || o_custkey || '], line 4',
 'Input In [' || o_custkey || '], in <module>', 'ValueError: no frame', chr(27) || '[1mFile ' || chr(27) || '[0;32m/usr/lib/x.py:7']) AS l FROM orders),
bare AS (SELECT *, regexp_replace(l, '\x1b\[[0-9;]*m', '', 'g') AS t FROM raw),
form AS (SELECT *, CASE WHEN regexp_matches(t, 'File "[^"]+", line [0-9]+') THEN 1 WHEN regexp_matches(t, 'File [^ \t:]+:[0-9]+') THEN 2 WHEN regexp_matches(t, '(?:Cell |Input )[ \t]*In[ \t]*\[?[ \t]*[0-9]+\]?,?[ \t]*in[ \t]+[^ \t]') THEN 3 WHEN regexp_matches(t, '(?:Cell |Input )[ \t]*In[ \t]*\[?[ \t]*[0-9]+\]?,?[ \t]*line[ \t]*[0-9]') THEN 4 END AS k FROM bare),
fr AS (SELECT o_orderkey, o_custkey, frame_no, CASE k WHEN 1 THEN split_part(t, '"', 2) WHEN 2 THEN regexp_extract(t, 'File ([^ \t:]+):', 1) ELSE 'Cell In[' || regexp_extract(t, 'In[ \t]*\[?[ \t]*([0-9]+)', 1) || ']' END AS frame_path,
 CAST(CASE k WHEN 1 THEN regexp_extract(t, 'line ([0-9]+)', 1) WHEN 2 THEN regexp_extract(t, ':([0-9]+)', 1) WHEN 3 THEN '0' ELSE regexp_extract(t, 'line[ \t]*([0-9]+)', 1) END AS INTEGER) AS line,
 CASE k WHEN 1 THEN regexp_extract(t, ', in (.+)$', 1) WHEN 2 THEN regexp_extract(t, ',[ \t]*in[ \t]+([^ \t(]+)', 1) WHEN 3 THEN regexp_extract(t, 'in[ \t]+([^ \t]+)$', 1) ELSE '' END AS function, k > 2 AS in_cell FROM form WHERE k IS NOT NULL)"""
_CLS = _FR + """, rel AS (SELECT *, CASE WHEN starts_with(frame_path, '/repo/') THEN substr(frame_path, 7) ELSE frame_path END AS rel FROM fr), tracked AS (SELECT 'src/p' || c_custkey || '.py' AS path FROM customer WHERE c_acctbal > 0),
cl AS (SELECT o_orderkey, frame_no, CASE WHEN in_cell THEN 'notebook' WHEN tracked.path IS NOT NULL THEN 'repo' ELSE 'external' END AS type, CASE WHEN NOT in_cell AND tracked.path IS NOT NULL THEN rel ELSE frame_path END AS frame_path FROM rel LEFT JOIN tracked ON tracked.path = rel)"""

ORACLE_SQL = {
    "dir_rollup": f"WITH {_T}, {_UP} SELECT dir, count(*) AS file_count, CAST(sum(loc) AS BIGINT) AS total_loc, count(DISTINCT child) AS direct_children, round(0.5 * (log2(1 + count(*)) + log2(1 + sum(loc) / 100)), 6) AS importance FROM up GROUP BY dir",
    "dir_rollup_churn": f"""WITH {_T}, {_C}, {_UP}, j AS (SELECT up.*, commits, lines FROM up LEFT JOIN ch USING (path))
SELECT dir, count(*) AS file_count, CAST(sum(loc) AS BIGINT) AS total_loc, count(DISTINCT child) AS direct_children, CAST(coalesce(sum(commits), 0) AS BIGINT) AS churn_commits, CAST(coalesce(sum(lines), 0) AS BIGINT) AS churn_lines, count(lines) AS hot_count,
 coalesce(array_to_string((list(path ORDER BY lines DESC, path) FILTER (WHERE lines IS NOT NULL))[1:2], ';'), '') AS hot_files, round(0.4 * log2(1 + count(*)) + 0.2 * log2(1 + sum(loc) / 100) + 0.25 * log2(1 + coalesce(sum(lines), 0) / 100) + 0.15 * log2(1 + count(lines)), 6) AS importance FROM j GROUP BY dir""",
    "tree_nodes": f"WITH {_T} SELECT DISTINCT d1 AS path, '' AS parent, d1 AS name, 1 AS depth, true AS is_dir, CAST(NULL AS BIGINT) AS loc FROM tr UNION ALL SELECT DISTINCT d2, d1, split_part(d2, '/', 2), 2, true, NULL FROM tr",
    "tree_lines": f"""WITH {_T}, a AS (SELECT DISTINCT d1 FROM tr), b AS (SELECT DISTINCT d1, d2 FROM tr), la AS (SELECT d1, d1 = (SELECT max(d1) FROM a) AS l FROM a), lb AS (SELECT d1, d2, d2 = max(d2) OVER (PARTITION BY d1) AS l FROM b),
lc AS (SELECT *, path = max(path) OVER (PARTITION BY d2) AS l FROM tr), g(l, lead, tip) AS (VALUES (true, '    ', '└── '), (false, '│   ', '├── '))
SELECT d1 AS path, tip || d1 || '/' AS line FROM la JOIN g USING (l)
UNION ALL SELECT d2, ga.lead || gb.tip || split_part(d2, '/', 2) || '/' FROM lb JOIN la ON la.d1 = lb.d1 JOIN g ga ON ga.l = la.l JOIN g gb ON gb.l = lb.l
UNION ALL SELECT path, ga.lead || gb.lead || gc.tip || split_part(path, '/', 3) || ' (' || loc || ')' FROM lc JOIN lb ON lb.d2 = lc.d2 JOIN la ON la.d1 = lc.d1 JOIN g ga ON ga.l = la.l JOIN g gb ON gb.l = lb.l JOIN g gc ON gc.l = lc.l""",
    "module_summaries": """WITH f AS (SELECT lower(p_brand) AS dir, p_partkey, p_type, p_size, lower(p_brand) || '/' || p_partkey || (['.py', '.sh', '.MD'])[p_size % 3 + 1] AS path, (['py', 'sh', 'md'])[p_size % 3 + 1] AS ext FROM part),
k AS (SELECT dir, ext, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT dir, p_type, min(path || chr(0) || lpad(CAST(p_size AS VARCHAR), 6, '0')) AS o FROM f GROUP BY ALL)
SELECT dir, CAST(sum(n) AS BIGINT) AS files, string_agg(ext || '=' || n, ',' ORDER BY ext) AS types, (SELECT string_agg(p_type, ',' ORDER BY o, p_type) FROM s WHERE s.dir = k.dir) AS symbols FROM k GROUP BY dir""",
    "file_importance": f"WITH {_T}, {_C} SELECT path, round(0.25 * log2(1 + loc / 100) + 0.4 * log2(1 + coalesce(lines, 0) / 100) + 0.35 * log2(1 + coalesce(commits, 0)), 6) AS importance, round(log2(1 + loc / 100), 6) AS plain FROM tr LEFT JOIN ch USING (path)",
    "notebook_cells": f"WITH {_CELLS} SELECT path, pos, cell_type, turn AS execution_count, text AS source FROM c",
    "notebook_counts": f"WITH {_CELLS} SELECT path, count(*) AS cells, count(*) FILTER (WHERE cell_type = 'code') AS code, count(*) FILTER (WHERE cell_type = 'markdown') AS markdown, count(*) FILTER (WHERE cell_type = 'raw') AS raw FROM c GROUP BY path",
    "notebook_outputs": f"""WITH {_CELLS}, t AS (SELECT *, string_split(regexp_replace(text, '\\n+$', ''), chr(10)) AS p FROM c WHERE cell_type = 'code')
SELECT path, pos, 0 AS out, 'text' AS kind, CASE WHEN len(p) > 10 THEN '→ 10 lines of output (truncated from ' || len(p) || ')' ELSE '→ ' || len(p) || ' lines of output' END AS header, array_to_string(p[1:10], chr(10)) AS body FROM t WHERE text <> ''
UNION ALL SELECT path, pos, 1, 'rich', '[image/png output]', '' FROM t
UNION ALL SELECT path, pos, 2, 'error', '→ **ValueError**: bad ' || turn || ' (7 frames, showing last 5)', array_to_string([x FOR x IN list_transform([3, 4, 5, 6, 7], lambda i: '  File "src/m' || i || '.py", line ' || (conv_id % 50 + i) || ', in f')], chr(10)) FROM t WHERE turn % 3 = 0""",
    "notebook_errors": f"WITH {_CELLS} SELECT path, pos, 'ValueError' AS ename, 'bad ' || turn AS evalue, 7 AS frames FROM c WHERE cell_type = 'code' AND turn % 3 = 0",
    "traceback_frames": f"WITH {_FR} SELECT o_orderkey, frame_no, frame_path, line, function, in_cell FROM fr",
    "frame_classify": f"WITH {_CLS} SELECT o_orderkey, frame_no, type, frame_path FROM cl",
    "notebook_debug_summary": f"WITH {_CLS} SELECT o_orderkey, count(*) AS frames, count(*) FILTER (WHERE type = 'notebook') AS notebook, count(*) FILTER (WHERE type = 'repo') AS repo, count(*) FILTER (WHERE type = 'external') AS external FROM cl GROUP BY o_orderkey",
    "signatures_python": r"""SELECT 'm/p' || p_partkey || '.py' AS path, '# Part ' || p_partkey || '.' || chr(10) || chr(10) || 'class ' || regexp_replace(p_type, '[^A-Za-z]', '', 'g') || ':  # L3-5' || chr(10) || '    def size(self):  # L4-5' || chr(10) || '        return ' || p_size || chr(10) || chr(10) || chr(10)
 || 'def f' || p_partkey || '(a, b=1):  # L7-8' || chr(10) || '    ...' || chr(10) AS sig FROM part""",
    "signatures_budgeted": """WITH r AS (SELECT 'm/p' || p_partkey || '.py' AS path, row_number() OVER (ORDER BY log2(1 + p_size / 100) DESC, 'm/p' || p_partkey || '.py') AS rank FROM part)
SELECT path, rank, CASE WHEN rank <= 5 THEN 'detail' WHEN rank <= 5 + 36 THEN 'catalog' ELSE 'omitted' END AS tier FROM r""",
}
