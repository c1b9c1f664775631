"""Source sketches: the lines that show a file's interface, and a budgeted choice of them."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .ordering import dense_ordinal
from .text import extension
from .tree import file_importance

PER_FILE = 20
_DEF = re.compile(r"(?:async\s+)?(?:class|def)\s+\w+")
_TAG = re.compile(r"\w+:\s+\w+")


class Sketch:
    """Interface lines of one parsed Python file."""

    def __init__(self, text: str, spans: bool):
        self.source = text.split("\n")
        self.spans = spans

    def header(self, node: ast.AST) -> str:
        stop = min(node.end_lineno, len(self.source))
        taken = []
        for k in range(node.lineno - 1, stop):
            taken.append(self.source[k].rstrip())
            if ":" in self.source[k]:
                break
        return "\n".join(taken) + (f"  # L{node.lineno}-{node.end_lineno}" if self.spans else "")

    def summary(self, node: ast.AST) -> str | None:
        doc = ast.get_docstring(node, clean=False)
        return doc.strip().split("\n")[0].strip() if doc else None

    def returns(self, node: ast.AST) -> list[str]:
        """Lines of the function's own return statements, outer blocks first."""
        out, level = [], list(ast.iter_child_nodes(node))
        while level:
            below = []
            for x in level:
                if isinstance(x, ast.Return):
                    out.append(self.source[x.lineno - 1].rstrip())
                elif not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                    below += ast.iter_child_nodes(x)
            level = below
        return out

    def body(self, nodes: list[ast.stmt], indent: str) -> Iterator[str]:
        for node in nodes:
            if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            for d in node.decorator_list:
                yield self.source[d.lineno - 1].rstrip()
            yield self.header(node)
            doc = self.summary(node)
            if doc:
                yield f"{indent}    # {doc}"
            if isinstance(node, ast.ClassDef):
                if doc:
                    yield ""
                yield from self.body(node.body, indent + "    ")
            else:
                back = self.returns(node)
                yield from back
                if not doc and not back:
                    yield f"{indent}    ..."
            yield ""

    def lines(self) -> list[str]:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse("\n".join(self.source))
        except (SyntaxError, ValueError, RecursionError):
            return ["# (syntax error, could not parse)"]
        doc = self.summary(tree)
        return ([f"# {doc}", ""] if doc else []) + list(self.body(tree.body, ""))


def python_sketches(files: DataFrame, spans: bool = False) -> DataFrame:
    """(path, sig): interface lines of Python files as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "sig": [Sketch(t or "", spans).lines() for t in b["text"]]})

    return files.filter(extension(F.col("path")) == "py").select("path", "text").mapInPandas(run, "path string, sig array<string>")


def tag_sketches(formatted: DataFrame) -> DataFrame:
    """(path, sig) from formatted tags (path, line, entry)."""
    return formatted.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "entry"))), lambda x: x["entry"]).alias("sig"))


def count_symbols(lines: list[str]) -> int:
    return sum(1 for x in map(str.strip, lines) if x and x != "..." and not x.startswith("#") and (_DEF.match(x) or _TAG.match(x)))


def by_span(lines: list[str], cap: int) -> list[str]:
    """Top-level blocks with the longest spans first, cut to ``cap`` lines; a decorator goes with what follows."""
    heads = [k for k, x in enumerate(lines) if x and not x[0].isspace() and (_DEF.match(x) or _TAG.match(x))]
    for n, k in enumerate(heads):
        while k > 0 and lines[k - 1].strip().startswith("@"):
            k -= 1
        heads[n] = k
    edges = sorted({0, *heads}) + [len(lines)]
    blocks = ["\n".join(lines[a:b]).rstrip().split("\n") for a, b in zip(edges, edges[1:])]
    blocks = [b for b in blocks if b != [""]]

    def reach(block: list[str]) -> int:
        spans = [int(b) - int(a) for x in block for a, b in re.findall(r"(?:#\s*|\[)L(\d+)-(\d+)", x)]
        return max(spans, default=0) or len(block)

    out: list[str] = []
    for b in sorted(blocks, key=reach, reverse=True):
        gap = [""] if out else []
        room = cap - len(out) - len(gap)
        if len(b) <= room:
            out += gap + b
            continue
        if room >= 2:
            out += gap + b[:room]
        break
    return out


def catalog_entry(path: str, lines: list[str], loc: int) -> str:
    """One line for a file: its first five symbols."""
    found = []
    for x in map(str.strip, lines):
        if not x or x == "..." or x.startswith("#"):
            continue
        m = re.match(r"(?:async\s+)?(?:class|def)\s+(\w+)", x) or re.match(r"\w+:\s+(\w+)", x)
        if m:
            at = re.search(r"(?:#\s*|\[)L(\d+)", x)
            found.append(f"{m[1]} (L{at[1]})" if at else m[1])
    if not found:
        return f"- `{path}` — {loc}L"
    more = f" +{len(found) - 5} more" if len(found) > 5 else ""
    return f"- `{path}`: {', '.join(found[:5])}{more} — {loc}L"


def prioritised(sketches: DataFrame, loc: DataFrame, cap: int = PER_FILE) -> DataFrame:
    """(path, loc, capped, more, symbols, entry) for each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, sig, n in zip(b["path"], b["sig"], b["loc"]):
                sig = list(sig)
                kept = by_span(sig, cap) or sig[:cap]
                total = count_symbols(sig)
                rows.append((path, n, kept, total - count_symbols(kept), total, catalog_entry(path, sig, n)))
            yield pd.DataFrame(rows, columns=["path", "loc", "capped", "more", "symbols", "entry"])

    j = sketches.join(loc.select("path", "loc"), "path")
    return j.mapInPandas(run, "path string, loc bigint, capped array<string>, more int, symbols int, entry string")


def allocate(costs: DataFrame, budget: int, order: list[Column]) -> dict[str, str]:
    """{path: tier} of the files (path, cost) in detail or in the catalog; all others are omitted.

    Overhead takes 5 % (5 at least), detail 63 % of the rest. First fit goes in ``order`` and
    skips what doesn't fit. Of the files of one cost no more can fit than the budget has room for, and
    the first ones do if any: these alone come to the driver, and as many first ones as the catalog has lines.
    """
    overhead = max(5, int(budget * 0.05))
    full = int((budget - overhead) * 0.63)
    listed = budget - overhead - full
    w = Window.partitionBy("cost").orderBy(*order)
    few = costs.filter(F.col("cost") <= full).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") * F.col("cost") <= full)
    tiers, used = {}, 0
    for r in few.orderBy(*order).select("path", "cost").collect():
        if used + r["cost"] <= full:
            used += r["cost"]
            tiers[r["path"]] = "detail"
    first = [r["path"] for r in costs.orderBy(*order).limit(listed + len(tiers)).select("path").collect()]
    return tiers | dict.fromkeys([p for p in first if p not in tiers][:listed], "catalog")


def budgeted(sketches: DataFrame, loc: DataFrame, budget: int = 500, churn: DataFrame | None = None) -> DataFrame:
    """(path, tier, rank, importance, shown, more): which files show in detail, in the catalog, or not."""
    p = prioritised(sketches, loc)
    if churn is not None:
        p = p.join(churn.select("path", "commits", "lines"), "path", "left").fillna(0, ["commits", "lines"])
    imp = file_importance(F.col("loc")) if churn is None else file_importance(F.col("loc"), F.col("commits"), F.col("lines"))
    cost = F.lit(3) + F.size("capped") + F.when(F.col("more") > 0, 1).otherwise(0)
    r = checkpoint(p.withColumn("importance", imp).withColumn("cost", cost.cast("bigint")))
    order = [F.desc("importance"), F.asc("path")]
    tiers = allocate(r.select("path", "cost", "importance"), budget, order)
    chosen = r.sparkSession.createDataFrame(sorted(tiers.items()), "path string, tier string")  # at most as many as the budget has lines
    ranked = dense_ordinal(r, -F.floor(F.col("importance") * 1000), order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    shown = F.when(F.col("tier") == "detail", F.array_join("capped", "\n")).when(F.col("tier") == "catalog", F.col("entry"))
    return ranked.join(F.broadcast(chosen), "path", "left").withColumn("tier", F.coalesce("tier", F.lit("omitted"))).select("path", "tier", "rank", "importance", shown.alias("shown"), "more")
