"""Files, lines, searches and slices. A file is (path, text); a line is (path, line_no, text), from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import last_known

#: Unanchored fragments of paths that scans leave out.
IGNORED = (
    ["__pycache__/", "node_modules/", "venv/", "env/", "dist/", "build/"]
    + [rf"\.{d}/" for d in sorted(("git", "hg", "svn", "tox", "eggs", "cache", "venv", "env", "idea", "vscode", "egg-info", "mypy_cache", "pytest_cache"))]
    + [rf"\.{e}$" for e in sorted(("a", "o", "so", "dylib", "class", "jar", "war", "pyc", "pyo", "map", "lock", r"min\.js", r"min\.css"))]
    + [r"package-lock\.json$", r"\.DS_Store", r"Thumbs\.db"]
)
MAX_READ = 512_000
MAX_SCAN = 2500

_CODE = sorted("bash c cc cpp cs go h hpp java js jsx kt kts lua php py rb rs scala sh sql swift ts tsx zsh".split())
_PROSE = sorted("cfg conf ini json md rst toml txt xml yaml yml".split())
TEXT_EXTENSIONS = _CODE + _PROSE


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def with_parts(files: DataFrame) -> DataFrame:
    """Add dir, base, ext and depth."""
    p = F.col("path")
    return files.withColumns({"dir": dirname(p), "base": basename(p), "ext": extension(p), "depth": F.size(F.split(p, "/"))})


def ignored(path: Column, fragments: list[str] | None = None) -> Column:
    return path.rlike("|".join(IGNORED if fragments is None else fragments))


def drop_ignored(files: DataFrame) -> DataFrame:
    return files.filter(~ignored(F.col("path")))


def glob_to_regex(glob: str) -> str:
    """A pathspec: ``*`` and ``?`` cross slashes; a leading directory matches all below it."""
    out = ""
    for c in glob:
        out += ".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/-" else "\\" + c
    return f"^{out}(/.*)?$"


def files_matching(files: DataFrame, glob: str) -> DataFrame:
    """(path, loc) of the files that match, in order of path."""
    return files.filter(F.col("path").rlike(glob_to_regex(glob))).select("path", line_count(F.col("text")).alias("loc")).orderBy("path")


def line_count(text: Column) -> Column:
    """Line feeds, and one more for an unterminated last line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce((feeds + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)).cast("bigint"), F.lit(0).cast("bigint"))


def has_nul(text: Column) -> Column:
    return F.instr(text, "\0") > 0


def bounded_text(content: Column, limit: int = MAX_READ) -> Column:
    """At most ``limit`` bytes of a binary column as text without malformed bytes; empty if there is a NUL byte."""
    text = F.replace(F.make_valid_utf8(F.substring(content, 1, limit).cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.when(has_nul(text), F.lit("")).otherwise(text)


def is_text_file(path: Column, text: Column | None = None) -> Column:
    known = extension(path).isin(*TEXT_EXTENSIONS)
    return known if text is None else known & ~has_nul(text)


def is_scan_candidate(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS) | F.lower(basename(path)).isin("dockerfile", "makefile", "rakefile") | path.startswith("bin/") | path.startswith("scripts/")


def _starts(path: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def scan_priority(path: Column) -> Column:
    low, ext, base = F.lower(path), extension(path), F.lower(basename(path))
    points = [
        (_starts(low, "app/", "bin/", "cmd/", "core/", "internal/", "lib/", "src/"), 8),
        (_starts(low, "test/", "tests/") | low.contains("/test/") | low.contains("/tests/"), 6),
        (_starts(low, ".github/", "conf/", "config/"), 5),
        (ext.isin(*"bash c cc cpp go h hpp java js lua py rs sh ts".split()), 7),
        (ext.isin("md", "rst", "txt"), -3),
        (base.isin("cmakelists.txt", "dockerfile", "makefile"), 2),
    ]
    total = F.lit(0)
    for test, n in points:
        total = total + F.when(test, n).otherwise(0)
    return total


def select_for_scan(files: DataFrame, limit: int = MAX_SCAN) -> DataFrame:
    """(path, priority) of scan candidates, the best ``limit``."""
    return files.filter(is_scan_candidate(F.col("path"))).select("path", scan_priority(F.col("path")).alias("priority")).orderBy(F.desc("priority"), "path").limit(limit)


def lines(files: DataFrame) -> DataFrame:
    """One row a line; the empty rest after a last line feed is none."""
    parts = F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)
    return files.filter(F.length("text") > 0).select("path", F.posexplode(parts).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text")


def _split(text: Column) -> Column:
    """Lines as an array; the empty rest after a last line feed is none."""
    return F.when(F.length(text) > 0, F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def grep(files: DataFrame, pattern: str, context: int = 2, limit: int | None = 50) -> DataFrame:
    """(path, line_no, text, is_match) of files (path, text): matching lines and those within ``context`` of one.

    ``limit`` bounds the rows to limit * (2 * context + 2), in order of path and line. A file's lines
    are an array until those to show are known, so that nothing is shuffled but what is shown.
    """
    f = files.select("path", _split(F.col("text")).alias("p")).filter("p IS NOT NULL")
    f = f.withColumn("hit", F.transform("p", lambda x: x.rlike(pattern))).filter(F.exists("hit", lambda h: h))
    at = F.filter(F.transform("hit", lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - context, F.lit(0)), F.least(i + context, F.size("p") - 1)))))
    rows = f.select("path", F.explode(near).alias("i"), "p", "hit").select("path", (F.col("i") + 1).alias("line_no"), F.col("p")[F.col("i")].alias("text"), F.col("hit")[F.col("i")].alias("is_match"))
    return rows if limit is None else rows.orderBy("path", "line_no").limit(limit * (2 * context + 2))


def match_counts(found: DataFrame) -> DataFrame:
    """One row: true matches, and files that have them."""
    m = found.filter("is_match")
    return m.agg(F.count("*").alias("matches"), F.count_distinct("path").alias("files"))


def word_regex(symbol: str) -> str:
    return rf"(^|[^0-9A-Za-z_]){symbol}([^0-9A-Za-z_]|$)"


def definition_regex(symbol: str) -> str:
    words = "|".join(("async def", "class", "const", "def", "enum", "fn", "func", "function", "interface", "let", "struct", "trait", "type", "var"))
    return rf"(^|[^0-9A-Za-z_])({words})[ \t]+{symbol}([^0-9A-Za-z_]|$)"


def references(all_lines: DataFrame, symbol: str, limit: int | None = 30) -> DataFrame:
    """Lines that have the symbol as a whole word and don't define it, in order."""
    kept = all_lines.filter(F.col("text").rlike(word_regex(symbol)) & ~F.col("text").rlike(definition_regex(symbol))).select("path", "line_no", "text")
    return kept if limit is None else kept.orderBy("path", "line_no").limit(limit)


def slice_lines(all_lines: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Lines start to end of one file, numbered in print."""
    if start < 1 or end < start:
        raise ValueError("lines must be positive and in order")
    return all_lines.filter((F.col("path") == path) & F.col("line_no").between(start, end)).select("line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 6, " "), F.lit("  "), F.col("text")).alias("shown"))


LANGUAGES = dict(sorted({
    "py": "python", "sh": "bash", "bash": "bash", "js": "javascript", "ts": "typescript", "rb": "ruby", "rs": "rust", "go": "go", "java": "java", "cpp": "cpp", "c": "c", "h": "c",
    "cc": "cpp", "hpp": "cpp", "md": "markdown", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml", "sql": "sql", "xml": "xml", "html": "html", "css": "css", "jsx": "jsx", "tsx": "tsx",
}.items()))


def language(path: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(m, extension(path)), F.lit(""))


def diff_stat(diff_lines: DataFrame, order: str = "line_no") -> DataFrame:
    """One row: files, added, removed. Hunks tell headers from added lines that begin with ``++``."""
    t = F.col("text")
    state = F.when(t.startswith("diff --git "), F.lit(False)).when(t.startswith("@@"), F.lit(True))
    s = last_known(diff_lines, state, order, "in_hunk").withColumn("in_hunk", F.coalesce("in_hunk", F.lit(False)))
    target = F.when(~F.col("in_hunk") & t.startswith("+++ "), F.regexp_replace(F.substring(t, 5, 1 << 20), r"^b/", ""))
    origin = F.when(~F.col("in_hunk") & t.startswith("--- "), F.regexp_replace(F.substring(t, 5, 1 << 20), r"^a/", ""))
    named = s.withColumn("file", F.when(target != "/dev/null", target).otherwise(F.when(origin != "/dev/null", origin)))
    return named.agg(
        F.count_distinct("file").alias("files"), F.count_if(F.col("in_hunk") & t.startswith("+")).alias("added"), F.count_if(F.col("in_hunk") & t.startswith("-")).alias("removed"),
    )


def readme_summary(files: DataFrame, limit: int = 5) -> DataFrame:
    """(path, summary) of files (path, text): the first paragraph after the first line, without headings, of up to ``limit`` lines. No shuffle."""
    f = files.select("path", _split(F.col("text")).alias("p")).filter(F.size("p") > 1).withColumn("p", F.slice("p", 2, F.size("p")))
    full = F.transform("p", lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    f = f.withColumn("full", full).withColumn("at", F.array_position("full", F.lit(True)).cast("int")).filter(F.col("at") > 0)
    f = f.withColumn("gap", F.array_position(F.slice("full", F.col("at"), F.size("full")), F.lit(False)).cast("int"))
    n = F.least(F.when(F.col("gap") > 0, F.col("gap") - 1).otherwise(F.size("p")), F.lit(limit))
    return f.select("path", F.array_join(F.slice("p", F.col("at"), n), "\n").alias("summary"))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\u001b\\[[0-9;]*m", "")


def escape_attribute(c: Column) -> Column:
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        c = F.replace(c, F.lit(raw), F.lit(f"&{name};"))
    return c


def clip(c: Column, width: int) -> Column:
    """At most ``width`` characters; a longer text ends in three dots."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def head_lines(c: Column, n: int) -> Column:
    """The first ``n`` lines, and a note of how many there are if more."""
    parts = F.split(c, "\n", -1)
    total = F.size(parts)
    return F.when(total <= n, c).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "\n"), F.lit("\n... ("), total.cast("string"), F.lit(" lines total)")))


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as text padded to its greatest width."""
    one = Window.partitionBy(F.lit(0))
    return df.select(*[F.rpad(F.col(c).cast("string"), F.max(F.length(F.col(c).cast("string"))).over(one), F.lit(" ")).alias(c) for c in columns])
