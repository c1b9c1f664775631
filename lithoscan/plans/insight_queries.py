"""Queries of weighted signals, over parts as the files of a repository with written texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import churn, insights, text
from .adapters import spread, table

_DIRS = ["bin/", "src/", "tests/", "docs/", ""]
_NAMES = ["main", "f", "test_", "server", "util"]
_EXTS = [".py", ".sh", ".c", ".md", ".js"]
_TEXTS = [
    "import argparse\np.add_parser('run')\np.add_parser(\"stop\")\n",
    "case \"$cmd\" in\nrun)\nsource lib/x.sh # all\ncmd_run \"$@\"\n;;\nstop)\ncmd_stop\n;;\n*)\nexit 1\n;;\nesac\n",
    "def test_a():\n    assert x\n\ndef test_b():\n    assert y == 1\n    expect (z)\n",
    "int main(void) {}\n# TODO later\nx = 1 # FIXME\nclass A\n",
    "set -euo pipefail\nfoo || true\ntool --repo /r run\ntool stop\ntool run\n",
    "see src/f12.py and lib/x.sh or (bin/main5.py).\ntest_it() {\n  assert_eq 1\n}\n",
    "if __name__ == '__main__':\n    pass\nthe fallback value must be set\nexcept Exception:\n",
]


def _pick(values: list[str], c) -> object:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): two of the texts above, and lines that depend on the part's name and brand."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand"), "p_partkey")
    k = F.col("p_partkey")
    path = F.concat(_pick(_DIRS, k), _pick(_NAMES, F.col("p_size")), F.when(k % 3 == 0, F.lit("")).otherwise(k.cast("string")), F.when(k % 3 == 0, F.concat(F.lit("/x"), k.cast("string"))).otherwise(F.lit("")), _pick(_EXTS, F.floor(k / 5)))
    own = F.concat(F.lit("tool "), F.substring_index("p_name", " ", 1), F.lit("\nsee lib/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".sh\n"))
    return p.select(path.alias("path"), F.concat(_pick(_TEXTS, k), _pick(_TEXTS, F.floor(k / 7)), own).alias("text"))


def entrypoint_score(spark: SparkSession, d: str) -> DataFrame:
    e = insights.entrypoints(_files(spark, d), top=None)
    return e.withColumn("signals", F.array_join("signals", ","))


def test_counts(spark: SparkSession, d: str) -> DataFrame:
    return insights.test_counts(_files(spark, d))


def risk_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return insights.risks(text.lines(_files(spark, d)))


def runtime_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return insights.boundaries(text.lines(_files(spark, d)))


def dispatch_shell(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return insights.shell_dispatch(text.lines(f), f.select("path"))


def dispatch_parser(spark: SparkSession, d: str) -> DataFrame:
    return insights.parser_dispatch(_files(spark, d))


def command_hits(spark: SparkSession, d: str) -> DataFrame:
    return insights.command_hits(_files(spark, d), "tool")


def path_mentions(spark: SparkSession, d: str) -> DataFrame:
    return insights.mentions(_files(spark, d))


def symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    return insights.symbol_counts(_files(spark, d))


def _critical(spark: SparkSession, d: str, top: int | None) -> tuple[DataFrame, DataFrame]:
    f = _files(spark, d)
    entry = insights.entrypoints(f, top=None)
    disp = insights.shell_dispatch(text.lines(f), f.select("path")).unionByName(insights.parser_dispatch(f))
    targets = disp.filter("source_file <> ''").groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("n"))
    fan = f.select(F.concat(F.lit("bin/main"), (F.length("path") % 7).cast("string"), F.lit(".py")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    touched = insights.touched_paths(insights.mentions(f), insights.command_hits(f, "tool", None), disp)
    loc = f.select("path", text.line_count(F.col("text")).alias("loc"))
    return entry, insights.critical_scores(loc, entry, targets, fan, touched, insights.symbol_counts(f), top)


def critical_score(spark: SparkSession, d: str) -> DataFrame:
    return _critical(spark, d, None)[1].withColumn("score", F.round("score", 6))


def critical_top(spark: SparkSession, d: str) -> DataFrame:
    return _critical(spark, d, 12)[1].withColumn("score", F.round("score", 6))


def entrypoint_blend(spark: SparkSession, d: str) -> DataFrame:
    entry, crit = _critical(spark, d, 12)
    steady = entry.select("path", (F.length("path") % 4 / 4.0).alias("continuity"))
    r = insights.rerank(entry, crit, steady)
    return r.select("path", F.round("blend", 6).alias("blend"), "score", F.round("critical", 6).alias("critical"), "continuity")


def activity_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change log: users are authors, event types paths."""
    e = table(spark, d, "events").select(F.col("event_id").alias("commit_idx"), F.col("user_id").cast("string").alias("author"), F.lit(0).alias("pos"), F.col("event_type").alias("path"), F.lit(1).cast("bigint").alias("changes"))
    return churn.file_churn(e).select("path", "commits", "lines", "first_seen")


QUERIES = {f.__name__: f for f in (
    entrypoint_score, test_counts, risk_hotspots, runtime_boundaries, dispatch_shell, dispatch_parser, command_hits, path_mentions, symbol_counts, critical_score, critical_top, entrypoint_blend, activity_by_type,
)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_T7 = _list([t.replace(chr(10), "~") for t in _TEXTS])
_F = f"""f0 AS (SELECT p_partkey AS k, ({_list(_DIRS)})[p_partkey % 5 + 1] || ({_list(_NAMES)})[p_size % 5 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '/x' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END || ({_list(_EXTS)})[(p_partkey // 5) % 5 + 1] AS path,
 replace(({_T7})[p_partkey % 7 + 1] || ({_T7})[(p_partkey // 7) % 7 + 1], '~', chr(10)) || 'tool ' || split_part(p_name, ' ', 1) || chr(10) || 'see lib/' || lower(replace(p_brand, '#', '')) || '.sh' || chr(10) AS text FROM part),
f AS (SELECT *, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext, regexp_extract(path, '[^/]+$') AS base FROM f0)"""
_L = _F + ", ln AS (SELECT path, i AS line_no, p[i] AS text FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p FROM f)))"
_ENTRY = """sg AS (SELECT path, base, text, ext, starts_with(path, 'bin/') AS s1, base IN ('main.py', 'main.go', 'main.rs', 'main.c', 'main.cc', 'main.cpp', 'app.py', 'app.js', 'cli.py', 'cli.js', 'server.py', 'server.js', 'index.js', 'manage.py') AS s2, regexp_matches(base, 'main|cli|app|server') AS s3, NOT contains(path, '/') AND ext IN ('py', 'sh', 'js', 'ts', 'go', 'rb', 'rs') AS s4,
 regexp_matches(text, 'case\\s+"?\\$[A-Za-z_]') AS s5, regexp_matches(text, 'click\\.command|subparsers|add_parser|argparse') AS s6, regexp_matches(text, 'if __name__ == ["'']__main__["'']') AS s7, ext IN ('c', 'cc', 'cpp') AND regexp_matches(text, '\\bint\\s+main\\s*\\(') AS s8 FROM f),
sr AS (SELECT *, s1 OR s5 OR s6 OR s7 OR s8 AS r, regexp_matches(path, '^(docs|tests)/') AS nr FROM sg),
en AS (SELECT path, CAST(5 * s1::INT + 4 * s2::INT + 2 * s3::INT + s4::INT + 4 * s5::INT + 3 * s6::INT + 2 * s7::INT + 5 * s8::INT - 4 * (nr AND NOT r)::INT - 3 * (ext = 'sh' AND NOT s1 AND NOT r)::INT AS INTEGER) AS score,
 array_to_string(list_filter([CASE WHEN s1 THEN 'bin' END, CASE WHEN s2 THEN 'entry-name' END, CASE WHEN s3 THEN 'name-hint' END, CASE WHEN s4 THEN 'repo-root' END, CASE WHEN s5 THEN 'case-dispatch' END, CASE WHEN s6 THEN 'cli-parser' END, CASE WHEN s7 THEN '__main__' END, CASE WHEN s8 THEN 'c-main' END,
  CASE WHEN nr AND NOT r THEN 'non-runtime-path' END, CASE WHEN ext = 'sh' AND NOT s1 AND NOT r THEN 'non-entry-shell' END], lambda x: x IS NOT NULL), ',') AS signals FROM sr WHERE NOT regexp_matches(path, '^(tests/fixtures|ci|build|dist)/')),
en4 AS (SELECT * FROM en WHERE score >= 4)"""
_SYM = "len(regexp_extract_all(text, '(?m)^\\s*(?:class|def|enum|function|interface|struct|type)\\b'))"
_DISP = """st AS (SELECT path, line_no, text, trim(text) AS t, last_value(CASE WHEN starts_with(trim(text), 'case ') AND contains(text, '$') THEN 1 WHEN starts_with(trim(text), 'esac') THEN 0 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS inside
 FROM ln WHERE regexp_extract(path, '\\.([a-z]+)$', 1) IN ('', 'bash', 'sh')),
lb AS (SELECT *, regexp_extract(t, '^([A-Za-z0-9_.-]+)\\)\\s*$', 1) AS label FROM st WHERE inside = 1 AND NOT (starts_with(t, 'case ') AND contains(t, '$'))),
ar AS (SELECT *, sum((label <> '')::INT) OVER (PARTITION BY path ORDER BY line_no) AS arm FROM lb), sp AS (SELECT *, min(CASE WHEN starts_with(t, ';;') THEN line_no END) OVER (PARTITION BY path, arm) AS stop FROM ar WHERE arm > 0),
am AS (SELECT path, arm, max(label) AS command, min_by(regexp_extract(text, '^\\s*source\\s+([^#]+)', 1), line_no) FILTER (WHERE regexp_matches(text, '^\\s*source\\s+[^#]')) AS src, min_by(regexp_extract(text, '\\b(cmd_[A-Za-z0-9_]+)', 1), line_no) FILTER (WHERE regexp_matches(text, '\\bcmd_[A-Za-z0-9_]')) AS handler FROM sp WHERE line_no <= stop GROUP BY path, arm),
tk AS (SELECT *, CASE WHEN NOT regexp_matches(trim(src), '[$`]') THEN trim(trim(src), chr(34) || chr(39)) END AS token FROM am),
dsh AS (SELECT DISTINCT command, path AS entry_file, coalesce(CASE WHEN token IN (SELECT path FROM f) THEN token WHEN regexp_replace(path, '[^/]*$', '') || token IN (SELECT path FROM f) THEN regexp_replace(path, '[^/]*$', '') || token WHEN 'lib/' || regexp_extract(token, '[^/]+$') IN (SELECT path FROM f) THEN 'lib/' || regexp_extract(token, '[^/]+$') END, token, '') AS source_file, coalesce(handler, '') AS handler FROM tk)"""
_PARS = """dpy AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'add_parser\\(\\s*["'']([A-Za-z0-9_.-]+)["'']', 1)) AS command, path AS entry_file, '' AS source_file, '' AS handler FROM f WHERE ext = 'py')"""
_MEN = "mn AS (SELECT path, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(text, '\\b((?:bin|conf|lib|src)/[A-Za-z0-9_./-]*[0-9A-Za-z_])', 1)) AS path FROM f) GROUP BY path)"
_HITS = "hits AS (SELECT command, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(text, '\\btool(?:\\s+--repo\\s+\\S+)?\\s+([A-Za-z0-9_-]+)', 1)) AS command FROM f) GROUP BY command)"
_CRIT = f"""{_L}, {_ENTRY}, {_DISP}, {_PARS}, {_MEN}, {_HITS}, dp AS (SELECT * FROM dsh UNION ALL SELECT * FROM dpy),
tc AS (SELECT path, sum(hits) AS hits FROM (SELECT * FROM mn UNION ALL SELECT source_file, hits FROM hits JOIN (SELECT DISTINCT command, source_file FROM dp WHERE source_file <> '') USING (command)) GROUP BY path),
fan AS (SELECT 'bin/main' || (length(path) % 7) || '.py' AS path, count(*) AS n FROM f GROUP BY 1), dt AS (SELECT source_file AS path, count(*) AS n FROM dp WHERE source_file <> '' GROUP BY 1),
cp AS (SELECT f.path, CAST(f.path IN (SELECT path FROM en4) AS INTEGER)::DOUBLE AS entry, coalesce(dt.n, 0)::DOUBLE AS dispatch, coalesce(fan.n, 0)::DOUBLE AS fanin, coalesce(tc.hits, 0)::DOUBLE AS test, length(text) - length(replace(text, chr(10), '')) AS loc, {_SYM} AS sym, f.ext
 FROM f LEFT JOIN dt ON dt.path = f.path LEFT JOIN fan ON fan.path = f.path LEFT JOIN tc ON tc.path = f.path),
cs AS (SELECT path, entry * 6 + dispatch * 4 + fanin * 3 + test * 2 + least(loc / 300.0, 2.0) + least(sym / 8.0, 2.0) + CASE WHEN ext = 'md' THEN -0.8 ELSE 1.5 END AS score, entry, dispatch, fanin, test FROM cp), ok AS (SELECT * FROM cs WHERE score > 0.2),
top12 AS (SELECT * FROM ok ORDER BY score DESC, path LIMIT 12)"""

ORACLE_SQL = {
    "entrypoint_score": f"WITH {_F}, {_ENTRY} SELECT path, score, signals FROM en4",
    "test_counts": rf"""WITH {_F} SELECT path, CASE ext WHEN 'py' THEN len(regexp_extract_all(text, '(?m)^\s*def\s+test_[A-Za-z0-9_]+\s*\(')) WHEN 'sh' THEN len(regexp_extract_all(text, '(?m)^\s*test_[A-Za-z0-9_]+\s*\(\)\s*\{{')) WHEN 'js' THEN len(regexp_extract_all(text, '\b(?:it|test)\s*\(\s*["'']')) ELSE 0 END AS cases,
 CASE ext WHEN 'py' THEN len(regexp_extract_all(text, '\bassert\b')) WHEN 'sh' THEN len(regexp_extract_all(text, '\bassert_[A-Za-z0-9_]+')) WHEN 'js' THEN len(regexp_extract_all(text, '\bexpect\s*\(')) ELSE 0 END AS asserts FROM f WHERE regexp_matches(path, '(^|/)tests?/') OR starts_with(base, 'test_')""",
    "risk_hotspots": f"""WITH {_L}, r AS (SELECT path, line_no, trim(text) AS t FROM ln), h AS (SELECT path, line_no, CASE WHEN regexp_matches(lower(t), 'heuristic|fallback') THEN 'heuristic/fallback' WHEN contains(t, '|| true') THEN 'error suppression' WHEN contains(t, 'except Exception') THEN 'broad exception' WHEN regexp_matches(t, 'FIXME|TODO|XXX') THEN 'todo/fixme' END AS label, t AS snippet
 FROM r WHERE NOT (starts_with(t, '#') AND regexp_matches(lower(t), 'fallback|fixme|heuristic|todo'))) SELECT * FROM h WHERE label IS NOT NULL ORDER BY path, line_no LIMIT 16""",
    "runtime_boundaries": f"""WITH {_L}, c(label, re) AS (VALUES ('Strict shell fail-fast mode', 'set -euo pipefail'), ('CLI input validation', 'must be')) SELECT label, path, line_no, text AS snippet FROM ln JOIN c ON contains(text, re) QUALIFY row_number() OVER (PARTITION BY label ORDER BY path, line_no) <= 3""",
    "dispatch_shell": f"WITH {_L}, {_DISP} SELECT * FROM dsh",
    "dispatch_parser": f"WITH {_F}, {_PARS} SELECT * FROM dpy",
    "command_hits": f"WITH {_F}, {_HITS} SELECT * FROM hits ORDER BY hits DESC, command LIMIT 10",
    "path_mentions": f"WITH {_F}, {_MEN} SELECT * FROM mn",
    "symbol_counts": f"WITH {_F} SELECT path, {_SYM} AS symbols FROM f",
    "critical_score": f"WITH {_CRIT} SELECT path, round(score, 6) AS score, entry, dispatch, fanin, test FROM ok",
    "critical_top": f"WITH {_CRIT} SELECT path, round(score, 6) AS score, entry, dispatch, fanin, test FROM top12",
    "entrypoint_blend": f"""WITH {_CRIT}, b AS (SELECT e.path, e.score, coalesce(t.score, 0) AS critical, (length(e.path) % 4) / 4.0 AS continuity, e.score + coalesce(t.score, 0) / (SELECT max(score) FROM top12) * 4 + least(coalesce(t.fanin, 0), 8) * 0.8 + least(coalesce(t.dispatch, 0), 4) * 1.2 + (length(e.path) % 4) / 4.0 * 2.5 - CASE WHEN regexp_matches(e.path, '^(docs|tests)/') THEN 2 ELSE 0 END AS blend
 FROM en4 e LEFT JOIN top12 t ON t.path = e.path) SELECT path, round(blend, 6) AS blend, score, round(critical, 6) AS critical, CAST(continuity AS DOUBLE) AS continuity FROM b ORDER BY b.blend DESC, path LIMIT 8""",
    "activity_by_type": "SELECT event_type AS path, count(*) AS commits, count(*) AS lines, min(event_id) AS first_seen FROM events GROUP BY event_type",
}
