"""Notebooks: cells, outputs, and the frames of error tracebacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import head_lines, strip_ansi

MAX_LINES, MAX_FRAMES = 10, 5
_CELL = "struct<cell_type:string,source:variant,execution_count:int,outputs:array<struct<output_type:string,text:variant,data:map<string,variant>,ename:string,evalue:string,traceback:array<string>>>>"
SCHEMA = f"struct<cells:array<{_CELL}>,metadata:struct<kernelspec:struct<language:string,name:string,display_name:string>>>"


def joined(v: Column) -> Column:
    """A value that is a string or a list of strings, as one string."""
    return F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"), F.lit(""))


def parse(notebooks: DataFrame) -> DataFrame:
    """(path, nb) from (path, text) of JSON; unreadable ones drop."""
    doc = F.try_variant_get(F.try_parse_json("text"), "$", SCHEMA)
    return notebooks.select("path", doc.alias("nb")).filter("nb IS NOT NULL")


def cells(parsed: DataFrame) -> DataFrame:
    """(path, pos, cell_type, execution_count, source, outputs), in order."""
    e = parsed.select("path", F.posexplode("nb.cells").alias("pos", "c"))
    return e.select("path", "pos", "c.cell_type", "c.execution_count", joined(F.col("c.source")).alias("source"), "c.outputs")


def kernel(parsed: DataFrame) -> DataFrame:
    k = F.col("nb.metadata.kernelspec")
    return parsed.select("path", F.coalesce(k["language"], k["name"], F.lit("python")).alias("language"))


def cell_counts(all_cells: DataFrame) -> DataFrame:
    """(path, cells, code, markdown, raw)."""
    return all_cells.groupBy("path").agg(F.count("*").alias("cells"), *[F.count_if(F.col("cell_type") == k).alias(k) for k in ("code", "markdown", "raw")])


def shorten(text: Column, n: int = MAX_LINES) -> tuple[Column, Column]:
    """(the first n lines, how many there are); a last line feed ends no line."""
    parts = F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1)
    return F.array_join(F.slice(parts, 1, n), "\n"), F.size(parts)


def outputs(all_cells: DataFrame, max_lines: int = MAX_LINES, max_frames: int = MAX_FRAMES) -> DataFrame:
    """(path, pos, out, kind, header, body): shown outputs.

    Text keeps its first lines, with the number of all in the header; images, HTML and the like are
    named; an error shows its last frames without terminal colours.
    """
    o = all_cells.filter("outputs IS NOT NULL").select("path", "pos", F.posexplode("outputs").alias("out", "o"))
    data = F.coalesce(F.col("o.data"), F.create_map().cast("map<string,variant>"))
    rich = F.filter(F.map_keys(data), lambda m: m.startswith("image/") | m.isin("application/json", "text/html", "text/latex"))
    plain = F.when(F.col("o.output_type") == "stream", joined(F.col("o.text"))).otherwise(joined(F.element_at(data, F.lit("text/plain"))))
    o = o.withColumns({"rich": rich, "plain": F.regexp_replace(plain, r"\n+$", ""), "tb": F.transform(F.coalesce("o.traceback", F.array().cast("array<string>")), strip_ansi)})
    kind = F.col("o.output_type")
    named = o.filter(kind.isin("display_data", "execute_result")).select("path", "pos", "out", F.lit("rich").alias("kind"), F.explode("rich").alias("m")).select("path", "pos", "out", "kind", F.concat(F.lit("["), "m", F.lit(" output]")).alias("header"), F.lit("").alias("body"))
    body, total = shorten(F.col("plain"), max_lines)
    count = F.when(total > max_lines, F.concat(F.lit(f"→ {max_lines} lines of output (truncated from "), total.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("→ "), total.cast("string"), F.lit(" lines of output")))
    text = o.filter(kind.isin("stream", "display_data", "execute_result") & (F.col("plain") != "")).select("path", "pos", "out", F.lit("text").alias("kind"), count.alias("header"), body.alias("body"))
    n = F.size("tb")
    head = F.concat(F.lit("→ **"), F.coalesce("o.ename", F.lit("Error")), F.lit("**: "), F.coalesce("o.evalue", F.lit("")), F.when(n > max_frames, F.concat(F.lit(" ("), n.cast("string"), F.lit(f" frames, showing last {max_frames})"))).otherwise(""))
    tail = F.when(n > max_frames, F.slice("tb", -max_frames, max_frames)).otherwise(F.col("tb"))
    error = o.filter(kind == "error").select("path", "pos", "out", F.lit("error").alias("kind"), head.alias("header"), F.array_join(tail, "\n").alias("body"))
    return named.unionByName(text).unionByName(error)


def errors(all_cells: DataFrame) -> DataFrame:
    """(path, pos, ename, evalue, traceback) of error outputs."""
    o = all_cells.filter("outputs IS NOT NULL").select("path", "pos", F.explode("outputs").alias("o")).filter("o.output_type = 'error'")
    return o.select("path", "pos", F.coalesce("o.ename", F.lit("Error")).alias("ename"), F.coalesce("o.evalue", F.lit("")).alias("evalue"), F.coalesce("o.traceback", F.array().cast("array<string>")).alias("traceback"))


_CELL_AT = r"(?:Cell |Input )[ \t]*(?:In[ \t]*\[?[ \t]*([0-9]+)\]?),?[ \t]*"
_FRAMES = [  # regex, path, line, function: groups (0: none)
    (r'File "([^"]+)", line ([0-9]+)(?:, in (.+))?', 1, 2, 3),
    (r"File ([^ \t:]+):([0-9]+)(?:,[ \t]*in[ \t]+([^ \t(]+))?", 1, 2, 3),
    (_CELL_AT + r"in[ \t]+([^ \t]+)", 1, 0, 2),
    (_CELL_AT + r"line[ \t]*([0-9]+)", 1, 2, 0),
]


def parse_frames(tracebacks: DataFrame, keys: list[str], col: str = "traceback") -> DataFrame:
    """(keys, frame_no, frame_path, line, function, in_cell): the first of four forms that each line has."""
    t = tracebacks.select(*keys, F.posexplode(col).alias("frame_no", "raw")).withColumn("raw", strip_ansi(F.col("raw")))
    form = F.lit(None).cast("int")
    for k, (regex, *_) in reversed(list(enumerate(_FRAMES))):
        form = F.when(F.col("raw").rlike(regex), k).otherwise(form)
    # exploding an array of one keeps the optimizer from copying the tests into each column
    t = t.withColumn("form", F.explode(F.array(form))).filter("form IS NOT NULL")
    path = line = func = F.lit(None)
    for k, (regex, p, n, f) in enumerate(_FRAMES):
        got = lambda g: F.regexp_extract("raw", regex, g)  # noqa: B023, E731
        own = F.col("form") == k
        path = F.when(own, F.concat(F.lit("Cell In["), got(p), F.lit("]")) if k > 1 else got(p)).otherwise(path)
        line = F.when(own, got(n).cast("int") if n else F.lit(0)).otherwise(line)
        func = F.when(own, got(f) if f else F.lit("")).otherwise(func)
    return t.select(*keys, "frame_no", path.alias("frame_path"), line.alias("line"), func.alias("function"), (F.col("form") > 1).alias("in_cell"))


def classify_frames(frames: DataFrame, paths: DataFrame, root: str | None = None) -> DataFrame:
    """Add ``type``: notebook, repo (the path, made relative to ``root``, is tracked) or external."""
    rel = F.col("frame_path") if not root else F.when(F.col("frame_path").startswith(root.rstrip("/") + "/"), F.substring("frame_path", len(root.rstrip("/")) + 2, 1 << 20)).otherwise(F.col("frame_path"))
    f = frames.withColumn("rel", rel)
    known = paths.select(F.col("path").alias("tracked")).distinct()
    j = f.join(known, f["rel"] == known["tracked"], "left")
    kind = F.when(F.col("in_cell"), "notebook").when(F.col("tracked").isNotNull(), "repo").otherwise("external")
    return j.withColumn("type", kind).withColumn("frame_path", F.when(F.col("type") == "repo", F.col("rel")).otherwise(F.col("frame_path"))).drop("rel", "tracked")


def frame_context(frames: DataFrame, tags: DataFrame, all_lines: DataFrame, around: int = 2) -> DataFrame:
    """(path, at, symbol, line_no, marker, text): each repo frame's enclosing symbol, else ``around`` lines."""
    from .symbols import innermost

    pts = frames.filter("type = 'repo'").select(F.col("frame_path").alias("path"), F.col("line").alias("at")).distinct()
    inner = innermost(tags, pts).filter("exact").select("path", "at", F.col("name").alias("symbol"), F.col("line").alias("lo"), F.col("end").alias("hi"))
    spans = pts.join(inner, ["path", "at"], "left").select(F.col("path").alias("p"), "at", "symbol", F.coalesce("lo", F.col("at") - around).alias("lo"), F.coalesce("hi", F.col("at") + around).alias("hi"))
    j = all_lines.join(spans, (F.col("path") == F.col("p")) & F.col("line_no").between(F.col("lo"), F.col("hi")))
    return j.select("path", "at", "symbol", "line_no", F.when(F.col("line_no") == F.col("at"), ">>>").otherwise("   ").alias("marker"), "text")


def dependency_trace(frames: DataFrame, resolved_imports: DataFrame) -> DataFrame:
    """(src, module, is_internal) of the files in a traceback."""
    repo = frames.filter("type = 'repo'").select(F.col("frame_path").alias("src")).distinct()
    return resolved_imports.join(repo, "src", "left_semi").select("src", "module", "is_internal").distinct()


def debug_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames by type for each error."""
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), *[F.count_if(F.col("type") == k).alias(k) for k in ("notebook", "repo", "external")])


def render_source(c: Column, n: int) -> Column:
    return head_lines(c, n)
