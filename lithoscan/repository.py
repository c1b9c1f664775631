"""The query commands over one git repository, each a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FILE_NAME, Config, positive
from .operators import blocks, churn, graph, imports, insights, notebook, signatures, symbols, text, tree
from .prompts import prompt
from .session import checkpoint
from .sources import git

LEVELS = ("light", "medium", "heavy")


class Repository:
    """Relations are read once and kept: files by content, so that a changed work tree is read anew by a new object."""

    def __init__(self, spark: SparkSession, path: str = ".", config: Config | None = None):
        git.register(spark)
        self.spark, self.root = spark, git.discover(path)
        self.config = config or Config().with_file(f"{self.root}/{FILE_NAME}")

    # relations

    @cached_property
    def tracked(self) -> DataFrame:
        """(path, text, loc, executable) of all tracked files; binary ones have no text."""
        raw = self.spark.read.format("gitfiles").option("path", self.root).load()
        return checkpoint(raw.select("path", text.bounded_text(F.col("content")).alias("text"), text.line_count(F.col("content").cast("string")).alias("loc"), "executable"))

    @cached_property
    def files(self) -> DataFrame:
        return text.drop_ignored(self.tracked)

    @cached_property
    def lines(self) -> DataFrame:
        return text.lines(self.files.select("path", "text"))

    @cached_property
    def tags(self) -> DataFrame:
        """From syntax trees for Python, from rules and blocks for other languages."""
        return checkpoint(symbols.python_tags(self.files).unionByName(blocks.block_tags(self.files)))

    @cached_property
    def imports(self) -> DataFrame:
        """(src, module, dst, is_internal) of all languages."""
        py = imports.with_submodules(imports.python_imports(self.files))
        other = imports.regex_imports(self.lines.filter(text.extension(F.col("path")) != "py")).select("src", "module")
        return checkpoint(imports.resolve(py.unionByName(other), self.files.select("path"), imports.source_roots(self.files)))

    def log(self, revision: str = "HEAD") -> tuple[DataFrame, DataFrame]:
        """(commits, changes)."""
        return churn.parse_numstat(self.spark.read.format("gitlog").option("path", self.root).option("revision", revision).load())

    # commands

    def tree(self, path: str = ".", depth: int | None = None, budget: int | None = None, summary: DataFrame | None = None) -> DataFrame:
        f = self._below(path).select("path", "loc")
        if budget is not None:
            return tree.expand_budgeted(f, positive(budget, "budget"), summary)
        return tree.tree_lines(f, depth or self.config.tree_depth)

    def symbols(self, path: str | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
        return symbols.symbols(self.tags, kinds or self.config.symbol_kinds, path and git.inside(self.root, path)).orderBy("path", "line")

    def outline(self, path: str) -> DataFrame:
        return symbols.outline(self.tags.filter(F.col("path") == git.inside(self.root, path))).orderBy("line")

    def slice(self, path: str, start: int, end: int) -> DataFrame:
        return text.slice_lines(self.lines, git.inside(self.root, path), positive(start, "start"), positive(end, "end")).orderBy("line_no")

    def definition(self, name: str) -> DataFrame:
        return symbols.definitions(self.tags, name).orderBy("path", "line")

    def references(self, name: str, limit: int | None = None) -> DataFrame:
        return text.references(self.lines, name, limit or self.config.references_max)

    def deps(self, path: str) -> DataFrame:
        own = self.imports.filter(F.col("src") == git.inside(self.root, path))
        stated = imports.python_imports(self.files.filter(F.col("path") == git.inside(self.root, path))).select(imports.absolute_module(F.col("src"), F.col("level"), F.col("module")).alias("module"))
        kept = own.join(stated, "module", "left_semi") if path.endswith(".py") else own
        return imports.classified(kept).select("class", "module").orderBy(F.desc("class"), "module")

    def grep(self, pattern: str, scope: str | None = None, context: int | None = None, limit: int | None = None) -> DataFrame:
        found = self.files if scope is None else self.files.filter(F.col("path").startswith(git.inside(self.root, scope)))
        return text.grep(found, pattern, self.config.grep_context if context is None else context, limit or self.config.grep_max)

    def show(self, *names: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(n,) for n in names], "wanted string")
        return symbols.show(self.tags, self.lines, wanted).orderBy("wanted", "line_no")

    def context(self, path: str, line: int) -> DataFrame:
        """Lines of the innermost symbol around a line."""
        rel = git.inside(self.root, path)
        point = self.spark.createDataFrame([(rel, positive(line, "line"))], "path string, at int")
        b = symbols.innermost(self.tags, point).select(F.col("path").alias("p"), "name", "kind", "line", "end")
        return self.lines.join(b, (F.col("path") == F.col("p")) & (F.col("line_no") >= F.col("line")) & (F.col("end").isNull() | (F.col("line_no") <= F.col("end")))).select("name", "kind", "line_no", "text").orderBy("line_no")

    def diff(self, revision: str | None = None, staged: bool = False) -> DataFrame:
        r = self.spark.read.format("gitdiff").option("path", self.root).option("staged", str(staged).lower())
        return (r.option("revision", revision) if revision else r).load()

    def diff_stat(self, revision: str | None = None, staged: bool = False) -> DataFrame:
        return text.diff_stat(self.diff(revision, staged))

    def files_matching(self, glob: str) -> DataFrame:
        return self.files.filter(F.col("path").rlike(text.glob_to_regex(glob))).select("path", "loc").orderBy("path")

    def callees(self, name: str) -> DataFrame:
        best = symbols.best_definitions(self.tags, self.spark.createDataFrame([(name,)], "wanted string"), symbols.CALL_RANK)
        spans = checkpoint(best.select("path", F.col("wanted").alias("symbol"), "line", "end", "kind"))
        py = symbols.python_calls(self.files, spans.filter(F.col("path").endswith(".py") & (F.col("kind") != "class")).drop("kind"))
        rest = spans.filter(~F.col("path").endswith(".py") | (F.col("kind") == "class")).withColumnRenamed("path", "p")
        inside = self.lines.join(F.broadcast(rest), (F.col("path") == F.col("p")) & (F.col("line_no") >= F.col("line")) & (F.col("end").isNull() | (F.col("line_no") <= F.col("end"))))
        found = symbols.call_names(inside, ["symbol", "path"]).filter(F.col("callee") != F.substring_index("symbol", ".", -1))
        known = found.join(self.tags.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi").filter(~F.col("path").endswith(".py"))
        calls = py.unionByName(found.filter(F.col("path").endswith(".py")).select("symbol", "callee")).unionByName(known.select("symbol", "callee")).distinct()
        return symbols.resolve_calls(calls, self.tags).orderBy(F.desc("resolved"), "callee")

    def related(self, path: str) -> DataFrame:
        r = imports.related(self.files, self.imports, git.inside(self.root, path))
        return r.join(self.files.select("path", "loc"), "path").select("direction", "path", "loc").orderBy("direction", "path")

    def churn(self, revision: str = "HEAD", top: int | None = None, bucket: int | None = None, sort: str = "lines", min_lines: int = 0, min_continuity: float | None = None,
              min_coupling: float | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), authors: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        c = self.config
        commits, changes = map(checkpoint, self.log(revision))
        if authors:
            commits, changes = map(checkpoint, churn.by_authors(commits, changes, authors))
        kept = changes.filter(churn.glob_filter(F.col("path"), include, exclude))
        size = bucket or c.churn_bucket
        pairs = churn.cochange_pairs(kept, c.min_coupling if min_coupling is None else min_coupling)
        return {
            "files": churn.heatmap(commits, kept, sort, top or c.churn_top, min_lines, size), "authors": churn.author_activity(commits, kept, bucket_size=size),
            "sustained": churn.sustained(commits, kept, c.min_continuity if min_continuity is None else min_continuity, bucket_size=size), "pairs": pairs, "clusters": churn.cochange_clusters(pairs),
        }

    def churn_summary(self, revision: str = "HEAD") -> DataFrame:
        return churn.churn_summary(self.log(revision)[1])

    def signatures(self, path: str = ".", budget: int | None = None, summary: DataFrame | None = None, spans: bool = False) -> DataFrame:
        f = self._below(path)
        other = symbols.format_signatures(self.tags.filter(~F.col("path").endswith(".py")).join(f.select("path"), "path", "left_semi"))
        s = signatures.python_sketches(f, spans or budget is not None).unionByName(signatures.tag_sketches(other))
        return s if budget is None else signatures.budgeted(s, f, positive(budget, "budget"), summary)

    def notebook(self, path: str, debug: bool = False) -> dict[str, DataFrame]:
        c = self.config
        one = self.tracked.filter(F.col("path") == git.inside(self.root, path)).select("path", "text")
        parsed = notebook.parse(one)
        cells = checkpoint(notebook.cells(parsed))
        if not debug:
            return {"kernel": notebook.kernel(parsed), "counts": notebook.cell_counts(cells), "cells": cells.select("pos", "cell_type", "execution_count", "source").orderBy("pos"), "outputs": notebook.outputs(cells, c.notebook_lines, c.notebook_frames).orderBy("pos", "out")}
        errors = notebook.errors(cells)
        frames = checkpoint(notebook.classify_frames(notebook.parse_frames(errors, ["path", "pos"]), self.files.select("path"), self.root))
        return {"errors": errors, "frames": frames, "code": notebook.frame_context(frames, self.tags, self.lines), "imports": notebook.dependency_trace(frames, self.imports), "summary": notebook.debug_summary(frames, ["path", "pos"])}

    def prompt(self, task: str | None = None) -> str:
        return prompt(task)

    def wiring(self) -> dict[str, DataFrame]:
        """The Python import graph: totals, key files, layers, links; and modules by importers."""
        nodes = self.files.filter(F.col("path").endswith(".py")).select(F.col("path").alias("node"))
        e = checkpoint(imports.edges(self.imports.filter(F.col("src").endswith(".py"))))
        layered = checkpoint(graph.layers(e, graph.strong_components(e, nodes)))
        deg = checkpoint(graph.degrees(e, nodes))
        counts = imports.module_counts(self.imports.filter(F.col("src").endswith(".py"))).orderBy(F.desc("importers"), "module")
        return {
            "topology": graph.topology(e, layered), "key_files": graph.key_nodes(deg, graph.betweenness(e, nodes), layered), "layers": graph.layer_map(deg, layered),
            "links": graph.key_links(graph.link_scores(e, deg, layered)), "modules": counts.limit(self.config.primer_modules), "shell": imports.shell_sources(self.lines),
        }

    def insights(self) -> dict[str, DataFrame]:
        scanned = self.tracked.join(text.select_for_scan(self.tracked), "path").select("path", "text", "loc", "executable")
        lines = text.lines(scanned)
        entry = checkpoint(insights.entrypoints(scanned, F.col("executable")))
        routed = scanned.join(entry.select("path"), "path", "left_semi")
        dispatch = checkpoint(insights.shell_dispatch(text.lines(routed), self.tracked).unionByName(insights.parser_dispatch(routed)))
        targets = dispatch.filter("source_file <> ''").groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("n"))
        fan = imports.edges(self.imports).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))
        program = self.root.rstrip("/").rsplit("/", 1)[-1]
        hits = insights.command_hits(scanned, program)
        tests = self.tracked.filter(insights.is_test(F.col("path"))).select("path", "text")
        symbols_in = insights.symbol_counts(insights.merge(scanned.select("path", "text"), tests))
        critical = checkpoint(insights.critical_scores(self.tracked.select("path", "loc"), entry, targets, fan, insights.touched_paths(insights.mentions(scanned), hits, dispatch), symbols_in))
        commits, changes = map(checkpoint, self.log())
        steady = churn.presence_continuity(commits, changes.join(self.tracked.select("path"), "path", "left_semi"))
        return {
            "entrypoints": insights.rerank(entry, critical, steady), "dispatch": dispatch, "critical": critical, "tests": insights.test_counts(tests), "commands": hits,
            "boundaries": insights.boundaries(lines), "risks": insights.risks(lines),
        }

    def primer(self, level: str = "heavy", task: str | None = None, tree_depth: int | None = None, max_symbols: int | None = None) -> dict[str, object]:
        """Sections by name: a prompt text, and DataFrames; each level adds to the one before."""
        if level not in LEVELS:
            raise ValueError(f"level must be one of {', '.join(LEVELS)}")
        c, rank = self.config, LEVELS.index(level)
        depth = tree_depth or c.primer_tree_depth
        ins = self.insights()
        summary = checkpoint(self.churn_summary())
        out: dict[str, object] = {"prompt": prompt(task), "readme": text.readme_summary(self.files.filter(F.lower("path").rlike(r"^readme(\.md)?$"))), "entrypoints": ins["entrypoints"], "dispatch": ins["dispatch"], "boundaries": ins["boundaries"]}
        if rank:
            out |= {f"churn_{k}": v for k, v in self.churn().items()}
        shown = tree.expand_budgeted(self.files.select("path", "loc"), c.primer_tree_budget, summary)  # of all files; depth only cuts what is shown
        out["tree"] = shown.filter(F.size(F.split("path", "/")) <= depth)
        if rank:
            out |= {"critical": ins["critical"], "tests": ins["tests"], "commands": ins["commands"], "symbols": self.symbols(), "modules": tree.top_directory_summary(self.files, self.tags, text.readme_summary(self.files))}
        if rank == 2:
            out["signatures"] = self.signatures(budget=max_symbols or c.primer_max_symbols, summary=summary)
            out |= {f"wiring_{k}": v for k, v in self.wiring().items()}
            out["risks"] = ins["risks"]
        return out

    def _below(self, path: str) -> DataFrame:
        rel = git.inside(self.root, path)
        return self.files if rel == "." else self.files.filter((F.col("path") == rel) | F.col("path").startswith(rel + "/"))
