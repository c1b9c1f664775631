"""Symbol tags of languages whose blocks are delimited by braces or by ``end``, with spans and scopes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .symbols import TAG_SCHEMA
from .text import extension

_C, _JS = ("c", "cc", "cpp", "h", "hpp"), ("js", "jsx", "ts", "tsx")
_MODS = r"(?:(?:abstract|default|final|native|private|protected|public|static|synchronized)\s+)*"
_ANY = r"(?:(?:async|default|export)\s+)*"
#: Extensions, regex of a line with the groups name and, for some, scope; kind; what only counts inside a class.
RULES: list[tuple[tuple[str, ...], str, str, bool]] = [
    (("go",), r"^func\s+\(\s*\w*\s*\*?(?P<scope>\w+)[^)]*\)\s*(?P<name>\w+)", "method", False),
    (("go",), r"^func\s+(?P<name>\w+)", "function", False),
    (("go",), r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b", "struct", False),
    (("go",), r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b", "interface", False),
    (("go",), r"^type\s+(?P<name>\w+)\s", "type", False),
    (("rs",), r"^\s*impl\b(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)", "", False),
    (("rs",), r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|extern(?:\s+\"[^\"]*\")?|unsafe)\s+)*fn\s+(?P<name>\w+)", "function", False),
    *[(("rs",), rf"^\s*(?:pub(?:\([^)]*\))?\s+)?{word}\s+(?P<name>\w+)", kind, False) for word, kind in (("enum", "enum"), ("mod", "module"), ("struct", "struct"), ("trait", "interface"), ("type", "type"))],
    *[(("java",), rf"^\s*{_MODS}{word}\s+(?P<name>\w+)", kind, False) for word, kind in (("@?interface", "interface"), ("class", "class"), ("enum", "enum"), ("record", "class"))],
    (("java",), rf"^\s*{_MODS}(?:<[^>]*>\s*)?(?:[\w.<>,\[\]?]+\s+)?(?P<name>\w+)\s*\([^;]*$", "method", True),
    (_C, r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*(?::[^;]*)?\{?\s*$", "struct", False),
    (_C, r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)", "enum", False),
    (_C, r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)\s*(?:final\s*)?(?::[^;]*)?\{?\s*$", "class", False),
    (_C, r"^\s*namespace\s+(?P<name>\w+)", "module", False),
    (_C, r"^[A-Za-z_][\w\s*&<>,:~]*?[\s*&](?:(?P<scope>\w+)::)?(?P<name>~?\w+)\s*\([^;]*$", "function", False),
    (_C, r"^\s+(?:[\w*&<>,:]+\s+[*&]*)?(?P<name>~?\w+)\s*\([^;]*\{", "method", True),
    (_JS, rf"^\s*{_ANY}class\s+(?P<name>[\w$]+)", "class", False),
    (_JS, rf"^\s*{_ANY}(?:declare\s+)?interface\s+(?P<name>[\w$]+)", "interface", False),
    (_JS, rf"^\s*{_ANY}(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)", "enum", False),
    (_JS, rf"^\s*{_ANY}function\s*\*?\s*(?P<name>[\w$]+)", "function", False),
    (_JS, rf"^\s*{_ANY}(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]*)?=>|\w+\s*=>)", "function", False),
    (_JS, r"^\s*(?:(?:async|get|private|protected|public|readonly|set|static)\s+)*\*?(?P<name>[\w$#]+)\s*\([^;]*\{\s*$", "method", True),
    (("rb",), r"^\s*class\s+(?P<name>[A-Z]\w*)", "class", False), (("rb",), r"^\s*module\s+(?P<name>[A-Z]\w*)", "module", False),
    (("rb",), r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)", "method", False),
    (("lua",), r"^\s*(?:local\s+)?function\s+(?:(?P<scope>\w+)[.:])?(?P<name>\w+)", "function", False),
    (("bash", "sh"), r"^\s*(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\)", "function", False), (("bash", "sh"), r"^\s*function\s+(?P<name>[A-Za-z_][\w-]*)", "function", False),
]
_NOT_NAMES = set("catch do else for if new return sizeof switch throw while".split())
_COMPILED: dict[str, list[tuple[re.Pattern, str, bool]]] = {}
for _exts, _regex, _kind, _inside in RULES:
    for _e in _exts:
        _COMPILED.setdefault(_e, []).append((re.compile(_regex), _kind, _inside))
_NOISE = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\'|`[^`]*`|//.*|/\*.*?\*/')
_ENDS = ("lua", "rb")
_HOLDERS = ("class", "interface", "struct", "enum", "module", "")


def _bare(line: str, ext: str) -> str:
    """A line without strings and comments, whose braces don't count."""
    return re.sub(r"(?:^|\s)#.*", "", line) if ext in ("bash", "sh") else _NOISE.sub("", line)


def _stop(lines: list[str], bare: list[str], at: int, ext: str) -> int | None:
    """The last line of the block that a line opens: where its braces close, or the ``end`` of its indent; null if it has none."""
    if ext in _ENDS:
        if re.search(r"\bend\b\s*$", bare[at]) or re.match(r"\s*def\s+[\w.?!]+(?:\([^)]*\))?\s+=\s", bare[at]):
            return at
        lead = re.match(r"\s*", lines[at])[0]
        return next((k for k in range(at + 1, len(lines)) if re.match(re.escape(lead) + r"end\b", lines[k])), None)
    depth, opened = 0, False
    for k in range(at, len(bare)):
        if not opened and not lines[k].strip():
            return None
        for c in bare[k]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not opened and depth == 0:
                return at
        if opened and depth <= 0:
            return k
    return None


def file_tags(path: str, text: str) -> list[tuple]:
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    rules = _COMPILED.get(ext)
    if not rules:
        return []
    lines = text.split("\n")
    bare = [_bare(x, ext) for x in lines]
    out: list[tuple] = []
    around: list[tuple[int, str, str]] = []  # last line, name, kind
    for k, line in enumerate(lines):
        while around and around[-1][0] < k:
            around.pop()
        holder = next((x for x in reversed(around) if x[2] in _HOLDERS), None)
        for regex, kind, inside in rules:
            m = regex.match(line)
            if not m or m["name"] in _NOT_NAMES or (inside and (holder is None or around[-1] is not holder)):
                continue
            stop = _stop(lines, bare, k, ext)
            if kind in ("function", "method") and ext in (*_C, "java") and (stop is None or "{" not in "".join(bare[k : stop + 1])):
                continue  # a declaration, or a call
            scope = m.groupdict().get("scope") or ".".join(x[1] for x in around if x[2] in _HOLDERS)
            of = holder[2] or "struct" if holder else "struct" if m.groupdict().get("scope") else None
            if kind == "function" and holder and holder[2] != "module":
                kind = "method"
            signature = re.search(r"\(.*?\)", line[m.end("name") :])[0] if kind in ("function", "method") and re.search(r"\(.*?\)", line[m.end("name") :]) else None
            if kind:
                out.append((m["name"], path, k + 1, None if stop is None else stop + 1, kind, signature, scope or None, of if scope else None))
            if stop is not None and stop > k:
                around.append((stop, m["name"], kind))
            break
    return out


def block_tags(files: DataFrame) -> DataFrame:
    """Tags of Go, Rust, Java, C, C++, Ruby, Lua, JavaScript, TypeScript and shell files (path, text), one pass over each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["name", "path", "line", "end", "kind", "signature", "scope", "scope_kind"]
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["text"]) if t for r in file_tags(p, t)]
            yield pd.DataFrame(rows, columns=names).astype({"line": "int32", "end": "Int32"})

    return files.filter(extension(F.col("path")).isin(*sorted(_COMPILED))).select("path", "text").mapInPandas(run, TAG_SCHEMA)
