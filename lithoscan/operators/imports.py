"""Imports and their resolution to files.

An import is (src, module, level, names); a file set is (path).
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import dirname, extension

_QUOTED = r"""['"]([@.A-Za-z_][A-Za-z0-9_./@-]*)['"]"""
#: Extensions, regex, group of the module.
PATTERNS = [
    (("py",), r"^\s*(?:import|from)\s+(\.*[A-Za-z_][A-Za-z0-9_.]*|\.+)", 1),
    (("js", "jsx", "ts", "tsx"), r"^\s*(?:import|export)\s.*[^0-9A-Za-z_]from\s+" + _QUOTED, 1),
    (("js", "jsx", "ts", "tsx"), r"(?:^|[^0-9A-Za-z_])require\s*\(\s*" + _QUOTED, 1),
    (("go",), r'^\s*"([A-Za-z0-9_./-]+)"', 1),
    (("rb",), r"^\s*require(?:_relative)?\s+" + _QUOTED, 1),
    (("rs",), r"^\s*(?:use|extern crate)\s+([A-Za-z_][A-Za-z0-9_:]*)", 1),
    (("java",), r"^\s*import\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*;", 1),
    (("c", "cc", "cpp", "h", "hpp"), r'^\s*#\s*include\s*[<"]([0-9A-Za-z_./-]+)[>"]', 1),
    (("bash", "sh"), r"""^\s*(?:\.|source)\s+['"]*([A-Za-z0-9_./-]+)['"]?""", 1),
    (("css", "scss"), r"^\s*@import\s+" + _QUOTED, 1),
]


def regex_imports(all_lines: DataFrame) -> DataFrame:
    """(src, module, level): one row a module that a line's language pattern captures."""
    ext = extension(F.col("path"))
    found = F.array().cast("array<string>")
    for exts, regex, group in PATTERNS:
        found = F.concat(found, F.when(ext.isin(*exts), F.regexp_extract_all("text", F.lit(regex), F.lit(group))).otherwise(F.array().cast("array<string>")))
    rows = all_lines.select(F.col("path").alias("src"), F.explode(found).alias("raw")).distinct()
    dots = F.when(extension(F.col("src")) == "py", F.length(F.regexp_extract("raw", r"^(\.*)", 1))).otherwise(0)
    return rows.select("src", F.when(dots > 0, F.regexp_replace("raw", r"^\.+", "")).otherwise(F.col("raw")).alias("module"), dots.alias("level"))


#: Files that are parsed, and rows that are sent, at once.
_FILES, _ROWS = 512, 1 << 14


def _statements(text: str) -> list[ast.Import | ast.ImportFrom]:
    """All import statements, in whatever block; expressions, which have none, aren't walked. An unparsable text has none."""
    try:
        level: list = [ast.parse(text)]
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    while level:
        x = level.pop()
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            out.append(x)
            continue
        for part in ("body", "orelse", "finalbody", "handlers", "cases"):
            below = getattr(x, part, None)
            if isinstance(below, list):
                level += below
    return out


def _parsed(files: DataFrame, rows_of: Callable[[str, list], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that ``rows_of`` makes of each Python file's path and import statements; a task holds a few files' at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for b in batches:
                for k in range(0, b.num_rows, _FILES):
                    part = b.slice(k, _FILES)
                    for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        if text:
                            rows += rows_of(path, _statements(text))
                        if len(rows) >= _ROWS:
                            yield taken()
            if rows:
                yield taken()

    return files.filter(extension(F.col("path")) == "py").select("path", "text").mapInArrow(run, ddl)


def python_imports(files: DataFrame) -> DataFrame:
    """(src, module, level, names) from syntax trees; unparsable files have none."""

    def rows_of(path: str, found: list) -> list[tuple]:
        rows = []
        for x in found:
            if isinstance(x, ast.Import):
                rows += [(path, a.name, 0, []) for a in x.names]
            else:
                rows.append((path, x.module or "", x.level, [a.name for a in x.names]))
        return rows

    schema = pa.schema([("src", pa.string()), ("module", pa.string()), ("level", pa.int32()), ("names", pa.list_(pa.string()))])
    return _parsed(files, rows_of, schema, "src string, module string, level int, names array<string>")


def python_modules(files: DataFrame) -> DataFrame:
    """(src, module): as :func:`with_submodules` of :func:`python_imports`, but a file's rows are made distinct where it is parsed.

    Rows repeat only where a path does.
    """

    def rows_of(path: str, found: list) -> list[tuple]:
        here, names = None, set()
        for x in found:
            if isinstance(x, ast.Import):
                names.update(a.name for a in x.names)
                continue
            base = x.module or ""
            if x.level:
                if here is None:
                    here = [p for p in path.rpartition("/")[0].replace("/", ".").split(".") if p]
                base = ".".join([*here[: max(len(here) - x.level + 1, 0)], *([base] if base else [])])
            names.add(base)
            names.update(f"{base}.{a.name}" if base else a.name for a in x.names if a.name != "*")
        names.discard("")
        return [(path, m) for m in names]

    return _parsed(files, rows_of, pa.schema([("src", pa.string()), ("module", pa.string())]), "src string, module string")


def shell_sources(all_lines: DataFrame) -> DataFrame:
    """(path, imports): the files that each shell file sources, by name, with commas between."""
    line = r"""(?:^|\s)(?:\.|source)\s+['"]*([a-zA-Z0-9_./-]+)"""
    found = all_lines.filter(extension(F.col("path")).isin("bash", "sh")).select("path", F.explode(F.regexp_extract_all("text", F.lit(line), F.lit(1))).alias("file"))
    return found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("imports"))


def package_of(path: Column) -> Column:
    """The dotted package of a Python file."""
    return F.regexp_replace(dirname(path), "/", ".")


def absolute_module(path: Column, level: Column, module: Column) -> Column:
    """A relative import's dotted name: level 1 is the file's own package."""
    parts = F.filter(F.split(package_of(path), r"\."), lambda x: x != "")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - level + 1, F.lit(0)))
    return F.when(level == 0, module).otherwise(F.array_join(F.concat(base, F.when(module == "", F.array().cast("array<string>")).otherwise(F.split(module, r"\."))), "."))


def with_submodules(imports: DataFrame) -> DataFrame:
    """(src, module): absolute names, and for ``from x import y`` also ``x.y``, which may be a module."""
    base = absolute_module(F.col("src"), F.col("level"), F.col("module"))
    subs = F.transform(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: n != "*"), lambda n: F.concat_ws(".", F.when(base != "", base), n))
    return imports.select("src", F.explode(F.array_distinct(F.concat(F.array(base), subs))).alias("module")).filter("module <> ''").distinct()


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; a path that leaves the root is null. Only paths with such a segment are walked."""
    walked = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when(acc.isNull() | x.isin("", "."), acc).when((x == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(path.rlike(r"(?:^|/)(?:\.{0,2})(?:/|$)"), F.array_join(walked, "/")).otherwise(path)


def candidates(src: Column, module: Column) -> Column:
    """Paths at which a module may lie, in order of preference, by the language of the importing file."""
    ext, here = extension(src), dirname(src)
    at = lambda base, *tails: [normalise(F.concat(base, F.lit(t))) for t in tails]
    near = F.concat(here, F.lit("/"), module)
    dotted = F.replace(module, F.lit("."), F.lit("/"))
    near_dotted = F.concat(here, F.lit("/"), dotted)
    bare = F.regexp_replace(module, r"^\./", "")
    return (
        F.when(ext == "py", F.array(*at(dotted, ".py", "/__init__.py"), *at(near_dotted, ".py", "/__init__.py")))
        .when(ext.isin("js", "jsx", "ts", "tsx") & module.startswith("."), F.array(*at(near, "", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")))
        .when(ext.isin("bash", "sh"), F.array(*at(bare, ""), *at(near, "")))
        .when(ext.isin("c", "cc", "cpp", "h", "hpp"), F.array(*at(module, ""), *at(near, ""), normalise(F.concat(here, F.lit("/../"), module)), *[normalise(F.concat(F.lit(r), module)) for r in ("src/", "include/", "lib/")]))
        .when(ext == "go", F.array(*at(bare, "", ".go"))).when(ext == "rb", F.array(*at(bare, ".rb"), *at(near, ".rb"), normalise(F.concat(F.lit("lib/"), module, F.lit(".rb")))))
        .otherwise(F.array().cast("array<string>"))
    )


def resolve(imports: DataFrame, paths: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Add dst (null if none) and is_internal: the first candidate path that exists.

    ``roots`` (root) are directories tried in order after the top one, for Python source layouts;
    a module that is a directory of files is internal without a dst.
    """
    i = imports.withColumn("c", candidates(F.col("src"), F.col("module")))
    cand = i.select("src", "module", F.posexplode("c").alias("pos", "path")).withColumn("root", F.lit(""))
    if roots is not None:
        py = i.filter(extension(F.col("src")) == "py").select("src", "module", F.slice("c", 1, 2).alias("c"))
        more = py.crossJoin(F.broadcast(roots.select("root"))).filter("root <> ''").select("src", "module", F.posexplode("c").alias("pos", "path"), "root")
        cand = cand.unionByName(more.select("src", "module", (F.col("pos") + 100).alias("pos"), F.concat("root", F.lit("/"), "path").alias("path"), "root"))
    known = paths.select("path").distinct()
    hit = cand.join(known, "path").groupBy("src", "module").agg(F.min(F.struct("pos", "root", "path")).alias("m")).select("src", "module", F.col("m.path").alias("dst"))
    dirs = known.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    packages = cand.filter(F.col("path").endswith(".py") & ~F.col("path").endswith("/__init__.py")).withColumn("path", F.regexp_replace("path", r"\.py$", ""))
    space = packages.join(dirs, "path", "left_semi").select("src", "module").distinct().withColumn("space", F.lit(True)) if roots is not None else None
    out = imports.join(hit, ["src", "module"], "left")
    if space is None:
        return out.withColumn("is_internal", F.col("dst").isNotNull())
    return out.join(space, ["src", "module"], "left").withColumn("is_internal", F.col("dst").isNotNull() | F.coalesce("space", F.lit(False))).drop("space")


def resolve_python(imports: DataFrame, paths: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """As :func:`resolve`, of imports that are all of Python files and name something behind the last dot.

    Paths are looked up by their stem (without ``.py`` or ``/__init__.py``): a module has one at the top, one beside the
    importing file, and those under roots. What is under roots is found for each path, not for each import. So an
    import is a row throughout, and meets the stems twice.
    """
    p = F.col("path")
    pair = lambda cut, pos: F.struct(F.expr(f"left(path, length(path) - {cut})").alias("stem"), F.lit(pos).alias("pos"))
    known = paths.select("path").filter(p.endswith(".py"))
    files = known.select("path", F.explode(F.when(p.endswith("/__init__.py"), F.array(pair(3, 0), pair(12, 1))).otherwise(F.array(pair(3, 0)))).alias("s")).select("path", "s.*")
    at = files.select("stem", F.struct("pos", "path").alias("top"))
    best = [F.min("top")["path"].alias("top")]
    if roots is not None:
        # a module's candidates that are called __init__ in a directory aren't looked up as directories
        dirs = paths.select(F.explode(ancestors(p)).alias("path")).distinct().filter(~p.endswith("/__init__"))
        under = lambda df: df.withColumn("root", F.explode(ancestors(p))).join(roots.select("root").filter("root <> ''").distinct(), "root").filter(F.col("stem").startswith(F.concat("root", F.lit("/")))).withColumn("stem", F.expr("substring(stem, length(root) + 2)"))
        at = at.unionByName(dirs.select(p.alias("stem"), F.lit(True).alias("space")), allowMissingColumns=True)
        at = at.unionByName(under(files).select("stem", F.struct("pos", "root", "path").alias("low")), allowMissingColumns=True)
        at = at.unionByName(under(dirs.withColumn("stem", p)).select("stem", F.lit(True).alias("low_space")), allowMissingColumns=True)
        best += [F.min("low")["path"].alias("low"), F.coalesce(F.max("space"), F.lit(False)).alias("space"), F.coalesce(F.max("low_space"), F.lit(False)).alias("low_space")]
    at = at.groupBy("stem").agg(*best)
    dotted = F.replace("module", F.lit("."), F.lit("/"))
    names = [c for c in at.columns if c != "stem"]
    first = at.select(F.col("stem").alias("_stem"), *[F.col(c).alias(f"_{c}") for c in names])
    near = at.select(F.col("stem").alias("_near"), F.col("top").alias("_beside"), *[F.col("space").alias("_beside_space")] * (roots is not None))
    out = imports.join(first, normalise(dotted) == F.col("_stem"), "left")
    # what is found has a key that spreads it
    beside = F.when(F.col("_top").isNull(), normalise(F.concat(dirname(F.col("src")), F.lit("/"), dotted))).otherwise(F.col("src"))
    out = out.withColumn("_key", beside).join(near, F.col("_key") == F.col("_near"), "left")
    found = [F.col("_top"), F.col("_beside")]
    if roots is None:
        return out.withColumn("dst", F.coalesce(*found)).select(*imports.columns, "dst", F.col("dst").isNotNull().alias("is_internal"))
    space = F.coalesce("_space", F.lit(False)) | F.coalesce("_low_space", F.lit(False)) | F.coalesce("_beside_space", F.lit(False))
    return out.withColumn("dst", F.coalesce(*found, "_low")).select(*imports.columns, "dst", (F.col("dst").isNotNull() | space).alias("is_internal"))


def source_roots(paths: DataFrame) -> DataFrame:
    """(root): the top and every first directory of a Python file."""
    top = paths.filter(extension(F.col("path")) == "py").select(F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("").alias("root"))
    return top.distinct()


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def edges(resolved: DataFrame) -> DataFrame:
    """(src, dst) between files, none to itself."""
    return resolved.filter("dst IS NOT NULL AND dst <> src").select("src", "dst").distinct()


def classified(resolved: DataFrame) -> DataFrame:
    """(src, module, class), internal before external, then by name."""
    return resolved.select("src", "module", F.when(F.col("is_internal"), "internal").otherwise("external").alias("class")).distinct()


def contains_internal(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """The looser test: internal if some path contains the module's path form. They meet by the form's first three characters."""
    form = F.when(extension(F.col("src")) == "py", F.replace("module", F.lit("."), F.lit("/"))).otherwise(F.regexp_replace("module", r"^(\./)+", ""))
    m = imports.select("src", "module").distinct().withColumn("form", form).withColumn("start", F.substring("form", 1, 3))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("path") - n + 1, F.lit(1))), lambda i: F.substring(F.col("path"), i, F.lit(n)))
    p = paths.select(F.col("path").alias("p"), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), at(1), at(2), at(3)))).alias("part"))
    return m.join(p, (F.col("start") == F.col("part")) & F.col("p").contains(F.col("form")), "left_semi").select("src", "module")


def module_counts(resolved: DataFrame) -> DataFrame:
    """(module, importers): files that import each internal module."""
    return resolved.filter("is_internal").groupBy("module").agg(F.count_distinct("src").alias("importers"))


def related(files: DataFrame, resolved: DataFrame, path: str) -> DataFrame:
    """(direction, path): files that ``path`` imports, and other files whose text names it, as files of its kind are named."""
    forward = resolved.filter((F.col("src") == path) & F.col("dst").isNotNull()).select(F.lit("forward").alias("direction"), F.col("dst").alias("path")).distinct()
    name, (root, _, ext) = path.rsplit("/", 1)[-1], path.rpartition(".")
    stem = name.rsplit(".", 1)[0]
    if ext == "py":
        names = {root.removesuffix("/__init__").replace("/", "."), stem}
    elif ext in ("js", "jsx", "ts", "tsx"):
        names = {root, stem}
    else:
        names = {name, path if ext in ("bash", "sh") else stem}
    test = F.lit(False)
    for n in sorted(names - {""}):
        test = test | F.col("text").contains(n)
    reverse = files.filter(test & (F.col("path") != path)).select(F.lit("reverse").alias("direction"), "path").distinct()
    return forward.unionByName(reverse)
