"""Data sources over a git work tree that all executors can read: ``gitfiles``, ``gitlog``, ``gitdiff``."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def run_git(root: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-c", "core.quotepath=off", "-c", "safe.directory=*", "-C", root, *args], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def discover(start: str) -> str:
    """The nearest directory at or above ``start`` that has a ``.git``."""
    p = Path(start).resolve()
    for d in (p, *p.parents):
        if (d / ".git").exists():
            return str(d)
    raise ValueError(f"no git repository at or above {start}")


def inside(root: str, path: str) -> str:
    """``path`` relative to the root; refused if it lies outside."""
    p = (Path(root) / path).resolve()
    if not p.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} is outside of the repository")
    return p.relative_to(Path(root).resolve()).as_posix()


class Chunk(InputPartition):
    def __init__(self, first: int, items: list[str]):
        self.first, self.items = first, items


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.spec, self.size = options["path"], options.get("pathspec"), int(options.get("chunk", "500"))

    def partitions(self) -> list[InputPartition]:
        args = ["ls-files", "-z", "--"] + ([self.spec] if self.spec else [])
        paths = sorted({x.decode(errors="replace") for x in run_git(self.root, *args).split(b"\0") if x})
        return [Chunk(k, paths[k : k + self.size]) for k in range(0, len(paths), self.size)] or [Chunk(0, [])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for rel in partition.items:
            full = os.path.join(self.root, rel)
            try:
                with open(full, "rb") as f:
                    yield rel, f.read(), os.access(full, os.X_OK)
            except OSError:  # deleted in the work tree, or a link to nowhere
                continue


class GitFiles(DataSource):
    """(path, content, executable) of tracked files; options ``path``, ``pathspec``, ``chunk`` files a task."""

    @classmethod
    def name(cls) -> str:
        return "gitfiles"

    def schema(self) -> str:
        return "path string, content binary, executable boolean"

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.revision, self.size = options["path"], options.get("revision", "HEAD"), int(options.get("chunk", "2000"))

    def partitions(self) -> list[InputPartition]:
        try:
            total = len(run_git(self.root, "rev-list", *self.revision.split()).split())
        except ValueError:
            if self.revision != "HEAD":
                raise
            total = 0
        return [Chunk(k, [str(k)]) for k in range(0, total, self.size)] or [Chunk(0, [])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        if not partition.items:
            return
        text = run_git(self.root, "log", "--numstat", "--pretty=format:COMMIT%x09%an", f"--skip={partition.first}", f"--max-count={self.size}", *self.revision.split())
        base = partition.first << 24
        for k, line in enumerate(text.decode(errors="replace").splitlines()):
            if line:
                yield base + k, line


class GitLog(DataSource):
    """(line_no, text) of the numstat log, newest commit first; options ``path``, ``revision``, ``chunk`` commits a task."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "line_no bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)


class DiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.args = [options["revision"]] if options.get("revision") else ["--cached"] if options.get("staged", "false") == "true" else []

    def read(self, partition) -> Iterator[tuple]:
        for k, line in enumerate(run_git(self.root, "diff", *self.args).decode(errors="replace").splitlines(), 1):
            yield k, line


class GitDiff(DataSource):
    """(line_no, text) of a diff; options ``path``, ``revision``, ``staged`` (a revision comes first)."""

    @classmethod
    def name(cls) -> str:
        return "gitdiff"

    def schema(self) -> str:
        return "line_no bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return DiffReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (GitFiles, GitLog, GitDiff):
        spark.dataSource.register(source)
