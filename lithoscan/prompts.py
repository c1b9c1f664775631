"""Orientation for a reader of query results, and framings by task."""

from __future__ import annotations

ORIENTATION = """# How to use these results
Each section answers one question about the repository from its tracked files and its history.
Start with the tree and the entrypoints, then ask for a symbol, its context, its callees or the files related to it.
Prefer narrow queries: an outline before a slice, a slice before a whole file.
Quote paths and line numbers as they are given."""

TASKS = {
    "debug": "# Task: find a fault\nBegin at the failing line: context, then callees and references. Compare recent churn with the files of the traceback.",
    "explain": "# Task: explain how it works\nFollow the layers from the foundations upwards, and the dispatch table from commands to handlers.",
    "feature": "# Task: add a feature\nFind the nearest existing feature, its tests and the files that change together with it.",
    "review": "# Task: review a change\nRead the diff, then the references of each changed symbol, and look for tests that mention them.",
}


def prompt(task: str | None = None) -> str:
    if task is None:
        return ORIENTATION
    if task not in TASKS:
        raise ValueError(f"unknown task {task}; known: {', '.join(sorted(TASKS))}")
    return f"{ORIENTATION}\n\n{TASKS[task]}"
