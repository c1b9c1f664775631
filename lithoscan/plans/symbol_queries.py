"""Queries over symbol tags, with conversations as outer spans and turns as inner ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import symbols as ops
from ..operators import text
from .adapters import symbols as tags
from .adapters import table


def _points(t: DataFrame) -> DataFrame:
    return t.select("path").distinct().withColumn("at", F.explode(F.array(F.lit(1), F.lit(3), F.lit(8), F.lit(21))))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """The tagged files: a header line, then the lines of all turns."""
    c = table(spark, d, "conversations")
    path = F.concat(F.lit("conv"), (F.col("conv_id") % 10).cast("string"), F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".py"))
    body = c.groupBy(path.alias("path"), "conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return text.lines(body.select("path", F.concat(F.lit("# conversation\n"), "body", F.lit("\n")).alias("text")))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return ops.symbols(tags(spark, d), scope="conv1/")


def outline(spark: SparkSession, d: str) -> DataFrame:
    return ops.outline(tags(spark, d))


def definition(spark: SparkSession, d: str) -> DataFrame:
    return ops.definitions(tags(spark, d), "user_0")


def format_signatures(spark: SparkSession, d: str) -> DataFrame:
    return ops.format_signatures(tags(spark, d))


def context_innermost(spark: SparkSession, d: str) -> DataFrame:
    t = tags(spark, d)
    return ops.innermost(t.filter("kind <> 'class'"), _points(t))


def show(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("user_0",), ("conv_3",), ("conv_5.assistant_1",), ("nothing",)], "wanted string")
    return ops.show(tags(spark, d), _lines(spark, d), names)


def best_definition(spark: SparkSession, d: str) -> DataFrame:
    return ops.best_definitions(tags(spark, d), rank=ops.CALL_RANK).select("wanted", "path", "line", "kind")


def callees(spark: SparkSession, d: str) -> DataFrame:
    """A word before a full stop counts as a call; a turn defines its first word."""
    c = table(spark, d, "conversations")
    source = c.select(F.concat_ws("_", "conv_id", "turn").alias("symbol"), F.replace("text", F.lit("."), F.lit("(")).alias("text"))
    t = c.select(F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("name"), F.col("conv_id").cast("string").alias("path"), F.lit("function").alias("kind"), F.col("turn").cast("int").alias("line")).filter("name <> ''")
    return ops.resolve_calls(ops.call_names(source, ["symbol"]), t)


def symbol_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Definitions found by line rules; turns become lines of source by their number."""
    c = table(spark, d, "conversations")
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    code = F.element_at(F.array(F.concat(F.lit("def "), word, F.lit("(x):")), F.concat(F.lit("  class "), word, F.lit(":")), F.concat(word, F.lit("() {")), F.concat(F.lit("export function "), word, F.lit("(a) {"))), (F.col("turn") % 4 + 1).cast("int"))
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".sh"), F.lit(".js")), (F.col("conv_id") % 3 + 1).cast("int"))
    lines = c.select(F.concat(F.lit("f"), F.col("conv_id").cast("string"), ext).alias("path"), (F.col("turn") + 1).alias("line_no"), code.alias("text"))
    return ops.regex_tags(lines).select("name", "path", "line", "kind")


def tag_parse(spark: SparkSession, d: str) -> DataFrame:
    """Tags written as JSON (functions) or classic lines (others), and parsed again."""
    t = tags(spark, d)
    as_json = F.to_json(F.struct(F.lit("tag").alias("_type"), "name", "path", "line", "end", "kind", "signature", "scope"))
    code = F.when(F.col("kind") == "class", "c").otherwise("m")
    classic = F.concat_ws("\t", "name", "path", F.lit('/^x$/;"'), code, F.concat(F.lit("line:"), F.col("line").cast("string")), F.concat(F.lit("end:"), F.col("end").cast("string")), F.concat(F.lit("signature:"), "signature"), F.concat(F.lit("class:"), "scope"))
    return ops.parse_tags(t.select(F.when(F.col("kind") == "function", as_json).otherwise(classic).alias("value"))).select("name", "path", "line", "end", "kind", "signature", "scope")


QUERIES = {f.__name__: f for f in (symbols, outline, definition, format_signatures, context_innermost, show, best_definition, callees, symbol_fallback, tag_parse)}

_TAGS = """t AS (SELECT *, 'conv' || (conv_id % 10) || '/c' || conv_id || '.py' AS path, len(string_split(text, chr(10))) AS n FROM conversations),
u AS (SELECT *, CAST(1 + sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS e FROM t),
tags AS (SELECT role || '_' || turn AS name, path, CAST(e - n + 1 AS INTEGER) AS line, CASE WHEN turn % 3 <> 2 THEN e END AS "end", CASE role WHEN 'user' THEN 'function' ELSE 'member' END AS kind, '(' || n || ')' AS signature, 'conv_' || conv_id AS scope FROM u
 UNION ALL SELECT 'conv_' || conv_id, any_value(path), 1, max(e), 'class', NULL, NULL FROM u GROUP BY conv_id)"""
_SPAN = """'L' || line || coalesce('-' || "end", '')"""
_Q = "coalesce(scope || '.', '') || name"

ORACLE_SQL = {
    "symbols": f"WITH {_TAGS} SELECT path, line, {_Q} AS symbol, kind, {_SPAN} AS span, coalesce(signature, '') AS signature FROM tags WHERE starts_with(path, 'conv1/')",
    "outline": f"WITH {_TAGS} SELECT path, line, CASE WHEN scope IS NULL THEN '' ELSE '  ' END || kind || ' ' || name || coalesce(signature, '') || ' [' || {_SPAN} || ']' AS entry FROM tags",
    "definition": f"WITH {_TAGS} SELECT path, line, {_Q} AS symbol, kind, {_SPAN} AS span, coalesce(signature, '') AS signature FROM tags WHERE name = 'user_0'",
    "format_signatures": f"WITH {_TAGS} SELECT path, line, CASE WHEN scope IS NULL THEN '' ELSE '    ' END || kind || ': ' || name || coalesce(signature, '') || ' [' || {_SPAN} || ']' AS entry FROM tags",
    "context_innermost": f"""WITH {_TAGS}, s AS (SELECT * FROM tags WHERE kind <> 'class'), pts AS (SELECT path, unnest([1, 3, 8, 21]) AS "at" FROM (SELECT DISTINCT path FROM tags)),
i AS (SELECT p.path, p."at", name, kind, line, "end", true AS exact FROM pts p JOIN s ON s.path = p.path AND p."at" BETWEEN line AND "end" QUALIFY row_number() OVER (PARTITION BY p.path, p."at" ORDER BY "end" - line, line, name, kind) = 1),
nx AS (SELECT s.*, (SELECT min(line) FROM s z WHERE z.path = s.path AND z.line > s.line) AS nxt FROM s),
b AS (SELECT p.path, p."at", name, kind, line, coalesce("end", nxt - 1) AS "end", false AS exact FROM pts p JOIN nx ON nx.path = p.path AND line <= p."at" WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.path = p.path AND i."at" = p."at")
 QUALIFY row_number() OVER (PARTITION BY p.path, p."at" ORDER BY line DESC, name DESC) = 1)
SELECT * FROM i UNION ALL SELECT * FROM b""",
    "show": f"""WITH {_TAGS}, body AS (SELECT path, ['# conversation'] || string_split(string_agg(text, chr(10) ORDER BY turn), chr(10)) AS p FROM t GROUP BY path),
ln AS (SELECT path, i AS line_no, p[i] AS text FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM body)),
w AS (SELECT n.wanted, g.* FROM (VALUES ('user_0'), ('conv_3'), ('conv_5.assistant_1'), ('nothing')) n(wanted) JOIN tags g ON g.name = n.wanted OR {_Q} = n.wanted
 QUALIFY row_number() OVER (PARTITION BY n.wanted ORDER BY "end" IS NULL, CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'member' THEN 3 ELSE 5 END, line, path) = 1)
SELECT wanted, ln.path, line_no, text FROM w JOIN ln ON ln.path = w.path AND line_no BETWEEN line AND coalesce("end", line)""",
    "best_definition": f"""WITH {_TAGS} SELECT name AS wanted, path, line, kind FROM tags QUALIFY row_number() OVER (PARTITION BY name ORDER BY "end" IS NULL, CASE kind WHEN 'function' THEN 0 WHEN 'member' THEN 2 WHEN 'class' THEN 3 ELSE 5 END, line, path) = 1""",
    "callees": r"""WITH c AS (SELECT DISTINCT conv_id || '_' || turn AS symbol, regexp_extract(piece, '([\p{L}\p{N}_]+)[ \t\r\f\v]*$', 1) AS callee FROM (SELECT *, unnest(string_split(replace(text, '.', '('), '(')[:-2]) AS piece FROM conversations)),
f AS (SELECT regexp_extract(text, '^([A-Za-z]+)', 1) AS name, CAST(conv_id AS VARCHAR) AS path, 'function' AS kind, CAST(turn AS INTEGER) AS line FROM conversations WHERE regexp_matches(text, '^[A-Za-z]')),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, line) = 1)
SELECT callee, symbol, path AS def_path, kind AS def_kind, line AS def_line, path IS NOT NULL AS resolved FROM c LEFT JOIN d ON d.name = c.callee
WHERE regexp_matches(callee, '^[A-Za-z_]') AND callee NOT IN ('yield','with','while','try','return','raise','print','or','not','lambda','is','in','if','for','finally','except','elif','del','def','class','assert','and')""",
    "symbol_fallback": """SELECT * FROM (SELECT regexp_extract(text, '([A-Za-z]+)', 1) AS name, 'f' || conv_id || (['.py', '.sh', '.js'])[conv_id % 3 + 1] AS path, CAST(turn + 1 AS INTEGER) AS line,
 CASE WHEN conv_id % 3 = 0 AND turn % 4 = 0 THEN 'function' WHEN conv_id % 3 = 0 AND turn % 4 = 1 THEN 'class' WHEN conv_id % 3 = 1 AND turn % 4 = 2 THEN 'function' WHEN conv_id % 3 = 2 AND turn % 4 = 3 THEN 'function' WHEN conv_id % 3 = 2 AND turn % 4 = 1 THEN 'class' END AS kind
 FROM conversations) WHERE kind IS NOT NULL AND name <> ''""",
    "tag_parse": f'WITH {_TAGS} SELECT name, path, line, "end", kind, signature, scope FROM tags',
}
