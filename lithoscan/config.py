"""Settings of a repository's queries: defaults, then a KEY=VALUE file, then arguments."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass
from pathlib import Path

FILE_NAME = ".lithoscanrc"


@dataclass(frozen=True)
class Config:
    tree_depth: int = 4
    symbol_kinds: tuple[str, ...] = ("class", "enum", "function", "interface", "member", "method", "module", "struct", "type")
    grep_context: int = 2
    grep_max: int = 50
    references_max: int = 30
    primer_tree_depth: int = 3
    primer_tree_budget: int = 50
    primer_max_symbols: int = 500
    primer_modules: int = 50
    notebook_lines: int = 10
    notebook_frames: int = 5
    churn_top: int = 20
    churn_bucket: int | None = None  # sized by the number of commits
    min_continuity: float = 0.25
    min_coupling: float = 0.30

    def with_file(self, path: str | Path) -> Config:
        """Keys in capitals, one a line; anything that a shell would run is refused."""
        p = Path(path)
        if not p.exists():
            return self
        kinds = {f.name: f for f in dataclasses.fields(self)}
        given = {}
        for k, line in enumerate(p.read_text().splitlines(), 1):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            m = re.fullmatch(r"\s*([A-Z_]+)=([^;$`(]*)", line)
            if not m or m[1].lower() not in kinds:
                raise ValueError(f"{p.name}, line {k}: {line}")
            name, value = m[1].lower(), m[2].strip().strip("\"'")
            now = getattr(self, name)
            if name == "churn_bucket":
                given[name] = None if value == "auto" else positive(value, name)
            elif isinstance(now, tuple):
                given[name] = tuple(x.strip() for x in value.split(",") if x.strip())
            elif isinstance(now, float):
                given[name] = float(value)
            else:
                given[name] = positive(value, name)
        return dataclasses.replace(self, **given)


def positive(value: object, name: str) -> int:
    if not re.fullmatch(r"[0-9]+", str(value)) or int(str(value)) < 1:
        raise ValueError(f"{name} must be a positive integer, not {value}")
    return int(str(value))
