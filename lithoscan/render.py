"""Markdown from small ordered results."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame


def table(df: DataFrame, rows: int = 200) -> str:
    """An aligned table of at most ``rows`` rows, numbers to the right; the rest is counted."""
    got = df.limit(rows + 1).collect()
    names = df.columns
    numeric = [t in ("int", "bigint", "double", "float") or t.startswith("decimal") for _, t in df.dtypes]
    body = [[cell(v) for v in r] for r in got[:rows]]
    width = [max(len(n), *(len(r[k]) for r in body), 3) if body else max(len(n), 3) for k, n in enumerate(names)]
    line = lambda r: "| " + " | ".join(v.rjust(w) if q else v.ljust(w) for v, w, q in zip(r, width, numeric)) + " |"
    rule = "|" + "|".join("-" * (w + 1) + (":" if q else "-") for w, q in zip(width, numeric)) + "|"
    more = ["", f"*(more than {rows} rows)*"] if len(got) > rows else []
    return "\n".join([line(names), rule, *map(line, body), *more])


def code(df: DataFrame, column: str, rows: int = 200) -> str:
    """A fenced block of at most ``rows`` lines, longer than any fence in it."""
    got = [r[0] for r in df.select(column).limit(rows + 1).collect()]
    fence = "`" * max(3, 1 + max((len(x) - len(x.lstrip("`")) for x in map(str.strip, got)), default=0))
    return "\n".join([fence, *got[:rows], fence, *([f"*(more than {rows} lines)*"] if len(got) > rows else [])])


def cell(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v:.4g}"
    if isinstance(v, (list, tuple)):
        return ", ".join(map(cell, v))
    return str(v).replace("\n", " ").replace("|", "\\|")


def tagged(mode: str, body: str, **attributes: object) -> str:
    """A section in a tag of its own, attributes escaped."""
    extra = "".join(f" {k}={quoteattr(str(v))}" for k, v in attributes.items())
    return f"<{mode}{extra}>\n{body}\n</{mode}>"


def sections(parts: dict[str, object], rows: int = 50) -> str:
    """All parts of a composite result, in order."""
    return "\n\n".join(tagged(k, v if isinstance(v, str) else table(v, rows)) for k, v in parts.items())
