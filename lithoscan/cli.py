"""Command line: ``python -m lithoscan [--repo PATH] COMMAND ...`` prints Markdown."""

from __future__ import annotations

import argparse
import sys

from . import render


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lithoscan", description="Queries over a git repository.")
    p.add_argument("--repo", default=".", help="target repository (default: the one around the current folder)")
    p.add_argument("--rows", type=int, default=200, help="rows shown of each table")
    sub = p.add_subparsers(dest="command", required=True, metavar="COMMAND")

    def add(name: str, about: str, *arguments: tuple) -> None:
        c = sub.add_parser(name, help=about)
        for names, how in arguments:
            c.add_argument(*names.split(), **how)

    path, name, number = ("path", {}), ("name", {}), {"type": int}
    below = ("path", {"nargs": "?", "default": "."})
    add("tree", "directory tree", below, ("--depth", number), ("--budget", number))
    add("symbols", "symbols of files", ("path", {"nargs": "?"}), ("--kinds", {"nargs": "+"}))
    add("outline", "symbols of one file, indented", path)
    add("signatures", "interface lines of files", below, ("--budget", number), ("--spans", {"action": "store_true"}))
    add("slice", "numbered lines of a file", path, ("start", number), ("end", number))
    add("show", "source of symbols", ("names", {"nargs": "+"}))
    add("context", "the symbol around a line", path, ("line", number))
    add("definition", "where a symbol is defined", name)
    add("references", "lines that use a symbol", name, ("--limit", number))
    add("deps", "imports of a file", path)
    add("grep", "lines that match a regex", ("pattern", {}), ("--scope", {}), ("--context", number), ("--limit", number))
    add("diff", "lines of a diff", ("revision", {"nargs": "?"}), ("--staged", {"action": "store_true"}), ("--stat", {"action": "store_true"}))
    add("files", "files that match a glob", ("glob", {}))
    add("callees", "what a function calls", name)
    add("related", "files that a file imports, or that name it", path)
    add("churn", "change intensity", ("revision", {"nargs": "?", "default": "HEAD"}), ("--top", number), ("--bucket", number), ("--sort", {"choices": ("lines", "commits", "init"), "default": "lines"}),
        ("--min-lines", {"type": int, "default": 0}), ("--include", {"nargs": "+", "default": []}), ("--exclude", {"nargs": "+", "default": []}), ("--author", {"nargs": "+", "default": []}), ("--summary", {"action": "store_true"}))
    add("primer", "a summary of the repository", ("--level", {"choices": ("light", "medium", "heavy"), "default": "medium"}), ("--task", {}), ("--tree-depth", number), ("--max-symbols", number))
    add("notebook", "cells and outputs of a notebook", path, ("--debug", {"action": "store_true"}))
    add("prompt", "task framing", ("task", {"nargs": "?"}))
    return p


def result(repo, a: argparse.Namespace) -> object:
    """A text, a DataFrame or a dict of either, for parsed arguments."""
    run = {
        "tree": lambda: repo.tree(a.path, a.depth, a.budget), "symbols": lambda: repo.symbols(a.path, tuple(a.kinds) if a.kinds else None), "outline": lambda: repo.outline(a.path),
        "signatures": lambda: repo.signatures(a.path, a.budget, spans=a.spans), "slice": lambda: repo.slice(a.path, a.start, a.end), "show": lambda: repo.show(*a.names), "context": lambda: repo.context(a.path, a.line),
        "definition": lambda: repo.definition(a.name), "references": lambda: repo.references(a.name, a.limit), "deps": lambda: repo.deps(a.path), "grep": lambda: repo.grep(a.pattern, a.scope, a.context, a.limit),
        "diff": lambda: repo.diff_stat(a.revision, a.staged) if a.stat else repo.diff(a.revision, a.staged), "files": lambda: repo.files_matching(a.glob), "callees": lambda: repo.callees(a.name), "related": lambda: repo.related(a.path),
        "churn": lambda: repo.churn_summary(a.revision) if a.summary else repo.churn(a.revision, a.top, a.bucket, a.sort, a.min_lines, include=tuple(a.include), exclude=tuple(a.exclude), authors=tuple(a.author)),
        "primer": lambda: repo.primer(a.level, a.task, a.tree_depth, a.max_symbols), "notebook": lambda: repo.notebook(a.path, a.debug), "prompt": lambda: repo.prompt(a.task),
    }
    return run[a.command]()


def shown(got: object, command: str, rows: int) -> str:
    if isinstance(got, str):
        return got
    if isinstance(got, dict):
        return render.sections(got, rows)
    if command in ("context", "diff", "show", "slice"):
        column = "shown" if command == "slice" else "text"
        return render.code(got, column, rows) if column in got.columns else render.table(got, rows)
    return render.table(got, rows)


def main(args: list[str] | None = None, spark=None) -> int:
    """Exit code 0, or 1 with a message where the command can't be run."""
    a = parser().parse_args(args)
    from .repository import Repository
    from .session import local_session

    try:
        print(shown(result(Repository(spark or local_session(), a.repo), a), a.command, a.rows))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
