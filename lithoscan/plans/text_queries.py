"""Queries over documents as files: scans, searches, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text
from .adapters import files, table

_FILES = "files AS (SELECT source || '/' || lang || '/doc' || doc_id || '.txt' AS path, text FROM documents)"
_LOC = "CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"
_LINES = _FILES + """, parts AS (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p FROM files WHERE length(text) > 0),
lines AS (SELECT path, i AS line_no, p[i] AS text FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM parts))"""

GREP, WORD = "[Cc]opper|Licen[cs]ed? under|[0-9]{3}-[0-9]{4}", "the"


def files_glob(spark: SparkSession, d: str) -> DataFrame:
    return text.files_matching(files(spark, d), "src1*/en/*")


def file_parts(spark: SparkSession, d: str) -> DataFrame:
    return text.with_parts(files(spark, d).select("path"))


def file_line_counts(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", text.line_count(F.col("text")).alias("loc"))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return text.lines(files(spark, d)).groupBy("path").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.sum(F.length("text")).alias("chars"))


def grep(spark: SparkSession, d: str) -> DataFrame:
    return text.grep(files(spark, d), GREP, context=0)


def grep_context(spark: SparkSession, d: str) -> DataFrame:
    return text.grep(files(spark, d), GREP, context=2, limit=None)


def grep_counts(spark: SparkSession, d: str) -> DataFrame:
    return text.match_counts(text.grep(files(spark, d), GREP, context=2, limit=None))


def references(spark: SparkSession, d: str) -> DataFrame:
    return text.references(text.lines(files(spark, d)), WORD, limit=30)


def references_all(spark: SparkSession, d: str) -> DataFrame:
    return text.references(text.lines(files(spark, d)), WORD, limit=None)


def slice_file(spark: SparkSession, d: str) -> DataFrame:
    return text.slice_lines(text.lines(files(spark, d)), "src6/en/doc6.txt", 2, 5)


def readme_summary(spark: SparkSession, d: str) -> DataFrame:
    return text.readme_summary(files(spark, d))


def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat_ws("/", F.element_at(F.array(*[F.lit(x) for x in ("src", "build", "node_modules", ".git", "lib")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(F.array(*[F.lit(x) for x in (".py", ".pyc", ".min.js", ".lock")]), (F.col("p_size") % 4 + 1).cast("int")))).alias("path"))
    return text.drop_ignored(p)


def scan_priority(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("src/", "tests/", "docs/", "conf/", "")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_partkey").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".md", ".bin", ".sh", ".json")]), (F.col("p_size") % 5 + 1).cast("int"))).alias("path"))
    return text.select_for_scan(p)


def diff_stat(spark: SparkSession, d: str) -> DataFrame:
    """A diff of orders (removed) against their line count (added), in the unified form."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey").cast("string")
    rows = F.array(F.concat(F.lit("diff --git a/o"), k, F.lit(" b/o"), k), F.concat(F.lit("--- a/o"), k), F.concat(F.lit("+++ b/o"), k), F.lit("@@ -1 +1,2 @@"), F.concat(F.lit("-"), "o_orderstatus"), F.lit("+++ counter"), F.lit("+x"))
    lines = o.select("o_orderkey", F.posexplode(rows).alias("pos", "text")).withColumn("line_no", F.col("o_orderkey") * 10 + F.col("pos"))
    return text.diff_stat(lines)


def escapes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages")
    return t.select("page_id", text.escape_attribute(F.col("url")).alias("url"), text.clip(F.col("html"), 100).alias("head"), text.strip_ansi(F.concat(F.lit("\u001b[1;31m"), "url", F.lit("\u001b[0m"))).alias("plain"))


QUERIES = {f.__name__: f for f in (
    files_glob, file_parts, file_line_counts, text_lines, grep, grep_context, grep_counts, references, references_all, slice_file, readme_summary, ignore_filter, scan_priority, diff_stat, escapes,
)}

_HIT = f"regexp_matches(text, '{GREP}')"
_REF = f"regexp_matches(text, '(^|[^0-9A-Za-z_]){WORD}([^0-9A-Za-z_]|$)') AND NOT regexp_matches(text, '(^|[^0-9A-Za-z_])(async def|class|const|def|enum|fn|func|function|interface|let|struct|trait|type|var)[ \\t]+{WORD}([^0-9A-Za-z_]|$)')"
_NEAR = f"WITH {_LINES}, h AS (SELECT *, {_HIT} AS is_match FROM lines), w AS (SELECT *, bool_or(is_match) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h)"
_IGN = r"(__pycache__/|node_modules/|venv/|env/|dist/|build/|\.git/|\.(a|o|so|pyc|pyo|map|lock|class|jar|war|dylib)$|\.min\.(js|css)$)"

ORACLE_SQL = {
    "files_glob": f"WITH {_FILES} SELECT path, {_LOC} AS loc FROM files WHERE path LIKE 'src1%/en/%'",
    "file_parts": f"WITH {_FILES} SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, split_part(path, '/', 3) AS base, 'txt' AS ext, 3 AS depth FROM files",
    "file_line_counts": f"WITH {_FILES} SELECT path, {_LOC} AS loc FROM files",
    "text_lines": f"WITH {_LINES} SELECT path, count(*) AS n, max(line_no) AS last, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY path",
    "grep": f"WITH {_LINES} SELECT path, line_no, text, true AS is_match FROM lines WHERE {_HIT} ORDER BY path, line_no LIMIT 100",
    "grep_context": _NEAR + " SELECT path, line_no, text, is_match FROM w WHERE near",
    "grep_counts": f"WITH {_LINES} SELECT count(*) AS matches, count(DISTINCT path) AS files FROM lines WHERE {_HIT}",
    "references": f"WITH {_LINES} SELECT path, line_no, text FROM lines WHERE {_REF} ORDER BY path, line_no LIMIT 30",
    "references_all": f"WITH {_LINES} SELECT path, line_no, text FROM lines WHERE {_REF}",
    "slice_file": f"WITH {_LINES} SELECT line_no, lpad(CAST(line_no AS VARCHAR), 6, ' ') || '  ' || text AS shown FROM lines WHERE path = 'src6/en/doc6.txt' AND line_no BETWEEN 2 AND 5",
    "readme_summary": f"""WITH {_LINES}, b AS (SELECT *, trim(text, ' ') <> '' AND NOT starts_with(text, '#') AS f FROM lines WHERE line_no > 1),
s AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS seen FROM b), g AS (SELECT *, sum(CASE WHEN NOT f AND seen > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS gaps FROM s)
SELECT path, string_agg(text, chr(10) ORDER BY line_no) AS summary FROM g WHERE f AND gaps = 0 AND seen <= 5 GROUP BY path""",
    "ignore_filter": f"SELECT path FROM (SELECT (['src', 'build', 'node_modules', '.git', 'lib'])[p_partkey % 5 + 1] || '/' || replace(p_name, ' ', '_') || (['.py', '.pyc', '.min.js', '.lock'])[p_size % 4 + 1] AS path FROM part) WHERE NOT regexp_matches(path, '{_IGN}')",
    "scan_priority": """SELECT path, CAST(CASE WHEN path LIKE 'src/%' THEN 8 ELSE 0 END + CASE WHEN path LIKE 'tests/%' THEN 6 ELSE 0 END + CASE WHEN path LIKE 'conf/%' THEN 5 ELSE 0 END
 + CASE WHEN path LIKE '%.py' OR path LIKE '%.sh' THEN 7 ELSE 0 END - CASE WHEN path LIKE '%.md' THEN 3 ELSE 0 END AS INTEGER) AS priority
FROM (SELECT (['src/', 'tests/', 'docs/', 'conf/', ''])[p_partkey % 5 + 1] || p_partkey || (['.py', '.md', '.bin', '.sh', '.json'])[p_size % 5 + 1] AS path FROM part) WHERE path NOT LIKE '%.bin' ORDER BY priority DESC, path LIMIT 2500""",
    "diff_stat": "SELECT count(*) AS files, 2 * count(*) AS added, count(*) AS removed FROM orders",
    "escapes": "SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS url, CASE WHEN length(html) > 100 THEN substr(html, 1, 97) || '...' ELSE html END AS head, url AS plain FROM pages",
}
