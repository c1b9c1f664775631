"""The commands over a small generated git repository."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lithoscan import render
from lithoscan.config import Config
from lithoscan.repository import Repository
from lithoscan.sources import git

HELPERS = '''"""Helper functions."""
import json


def shout(text):
    """Upper case."""
    return text.upper()


def check(value):
    if not value:
        raise ValueError("Input must not be empty")
    return True
'''
MAIN = '''import os
from src.tools.helpers import check, shout
from vendor import thing


class Job:
    """Runs once."""

    def __init__(self, name):
        self.name = name

    def start(self):
        if check(self.name):
            print(shout(self.name))
        return self.name


def main():
    job = Job(os.sep)
    job.start()


if __name__ == "__main__":
    main()
'''
SHELL = """#!/usr/bin/env bash
set -euo pipefail
case "$1" in
  go)
    source lib/go.sh
    cmd_go "$@"
    ;;
  stop)
    cmd_stop
    ;;
esac
"""


def notebook():
    code = lambda src, outs: {"cell_type": "code", "source": src, "execution_count": 1, "outputs": outs, "metadata": {}}
    tb = ["\u001b[0;31mValueError\u001b[0m Traceback", "Cell In[2], line 1", 'File "src/tools/helpers.py", line 11, in check', "ValueError: Input must not be empty"]
    cells = [
        {"cell_type": "markdown", "source": ["# Title\n", "text"], "metadata": {}},
        code("for i in range(14): print(i)", [{"output_type": "stream", "name": "stdout", "text": [f"{i}\n" for i in range(14)]}]),
        code("check('')", [{"output_type": "error", "ename": "ValueError", "evalue": "Input must not be empty", "traceback": tb}]),
        code("plot()", [{"output_type": "display_data", "data": {"image/png": "aa", "text/plain": ["<Figure>"]}, "metadata": {}}]),
        {"cell_type": "raw", "source": "r", "metadata": {}},
    ]
    return json.dumps({"cells": cells, "metadata": {"kernelspec": {"name": "python3", "language": "python", "display_name": "P"}}, "nbformat": 4, "nbformat_minor": 5})


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("sample")
    content = {
        "src/main.py": MAIN, "src/tools/helpers.py": HELPERS, "src/tools/__init__.py": "", "lib/go.sh": "cmd_go() {\n  echo go || true\n}\n", "bin/run": SHELL, "README.md": "# Sample\n\nA small repository.\nTwo lines.\n\n## More\n",
        "nb/a.ipynb": notebook(), "tests/test_main.py": "def test_a():\n    assert 1\n", "node_modules/x.js": "skip", "web/a.js": 'import x from "./b";\nconst y = require("lodash");\nfunction go(a) {}\n', "web/b.js": "export class B {}\n",
        "blob.bin": "\0\1", "broken.py": "def (:\n",
    }
    run = lambda *a: subprocess.run(["git", "-C", str(r), "-c", "user.name=Ann", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, body in content.items():
        p = r / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    os.chmod(r / "bin/run", 0o755)
    run("add", "-A")
    run("commit", "-qm", "one")
    for k in range(5):
        (r / "src/main.py").write_text(MAIN + f"# {k}\n")
        if k % 2:
            (r / "src/tools/helpers.py").write_text(HELPERS + f"# {k}\n")
        subprocess.run(["git", "-C", str(r), "-c", "user.name=Bob", "-c", "user.email=b@example.com", "commit", "-qam", str(k)], check=True)
    return r


@pytest.fixture(scope="module")
def repo(spark, root):
    return Repository(spark, str(root / "src"))


def rows(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_files_leave_out_noise(repo):
    paths = set(rows(repo.files, "path"))
    assert "src/main.py" in paths and "node_modules/x.js" not in paths and "node_modules/x.js" in set(rows(repo.tracked, "path"))
    assert rows(repo.files_matching("src/*.py"), "path") == ["src/main.py", "src/tools/__init__.py", "src/tools/helpers.py"]
    assert dict(rows(repo.files_matching("*.py"), "path", "loc"))["src/tools/helpers.py"] == 14
    assert rows(repo.tracked.filter("path = 'blob.bin'"), "text") == [""]


def test_tree(repo):
    drawn = [r.line for r in repo.tree("src", depth=9).orderBy("path").collect()]
    assert drawn == ["└── src/", "    ├── main.py (25)", "    └── tools/", "        ├── __init__.py (0)", "        └── helpers.py (14)"]
    few = repo.tree(budget=10).collect()
    assert sum(r.state in ("file", "collapsed") for r in few) <= 10 and any(r.state == "expanded" for r in few)


def test_symbols(repo):
    got = {(r.path, r.symbol): (r.kind, r.span) for r in repo.symbols().collect()}
    assert got["src/main.py", "Job"] == ("class", "L6-15") and got["src/main.py", "Job.start"] == ("member", "L12-15") and got["lib/go.sh", "cmd_go"] == ("function", "L1-3")
    assert [r.entry for r in repo.outline("src/main.py").collect()][:2] == ["class Job [L6-15]", "  member __init__(self, name) [L9-10]"]
    assert rows(repo.definition("Job.start"), "line") == [12] == rows(repo.definition("start"), "line")
    assert [r.text for r in repo.show("check").collect()][0] == "def check(value):"
    assert rows(repo.references("shout"), "path", "line_no") == [("src/main.py", 2), ("src/main.py", 14)]


def test_context_and_callees(repo):
    assert {r.name for r in repo.context("src/main.py", 14).collect()} == {"start"}
    assert {r.name for r in repo.context("src/main.py", 7).collect()} == {"Job"}
    assert {r.name for r in repo.context("lib/go.sh", 2).collect()} == {"cmd_go"}
    got = {r.callee: r.resolved for r in repo.callees("Job.start").collect()}
    assert got == {"check": True, "shout": True, "print": False}
    assert {r.callee for r in repo.callees("main").collect()} == {"Job", "start"}


def test_imports(repo):
    assert set(map(tuple, repo.deps("src/main.py").collect())) == {("internal", "src.tools.helpers"), ("external", "os"), ("external", "vendor")}
    assert set(map(tuple, repo.deps("web/a.js").collect())) == {("internal", "./b"), ("external", "lodash")}
    rel = set(rows(repo.related("src/tools/helpers.py"), "direction", "path"))
    assert ("reverse", "src/main.py") in rel and not any(d == "forward" for d, _ in rel)
    assert ("forward", "src/tools/helpers.py") in set(rows(repo.related("src/main.py"), "direction", "path"))
    w = repo.wiring()
    assert w["topology"].first().edges == 1 and rows(w["links"], "src", "dst", "layer_drop") == [("src/main.py", "src/tools/helpers.py", 1)]


def test_grep_and_slice(repo):
    found = repo.grep("raise ValueError", context=1).collect()
    assert [(r.line_no, r.is_match) for r in found if r.path == "src/tools/helpers.py"] == [(11, False), (12, True), (13, False)]
    assert repo.slice("src/main.py", 6, 7).first().shown == "     6  class Job:"
    with pytest.raises(ValueError):
        repo.slice("src/main.py", 7, 6)
    with pytest.raises(ValueError):
        repo.outline("../outside.py")


def test_churn(repo):
    c = repo.churn(bucket=2)
    top = {r.path: (r.commits, r.history) for r in c["files"].collect()}
    assert top["src/main.py"][0] == 6 and len(top["src/main.py"][1]) == 3
    assert dict(rows(c["authors"], "author", "commits")) == {"Bob": 5, "Ann": 1}
    assert dict(rows(c["sustained"], "path", "possible"))["src/main.py"] == 3
    assert {r.commits for r in repo.churn(authors=("ann",))["files"].collect()} == {1}
    assert dict(rows(repo.churn_summary(), "path", "commits"))["src/tools/helpers.py"] == 3


def test_signatures(repo):
    sig = dict(rows(repo.signatures("src"), "path", "sig"))
    assert sig["src/main.py"][:6] == ["class Job:", "    # Runs once.", "", "    def __init__(self, name):", "        ...", ""]
    assert sig["src/tools/helpers.py"][:4] == ["# Helper functions.", "", "def shout(text):", "    # Upper case."]
    tiers = dict(rows(repo.signatures(budget=40), "path", "tier"))
    assert tiers["src/main.py"] == "detail" and set(tiers.values()) <= {"detail", "catalog", "omitted"}
    assert dict(rows(repo.signatures(), "path", "sig"))["broken.py"] == ["# (syntax error, could not parse)"]


def test_notebook(repo):
    n = repo.notebook("nb/a.ipynb")
    assert tuple(n["counts"].first())[1:] == (5, 3, 1, 1) and n["kernel"].first().language == "python"
    heads = [r.header for r in n["outputs"].collect()]
    assert "→ 10 lines of output (truncated from 14)" in heads and "[image/png output]" in heads
    d = repo.notebook("nb/a.ipynb", debug=True)
    assert {(r.frame_path, r.type) for r in d["frames"].collect()} == {("Cell In[2]", "notebook"), ("src/tools/helpers.py", "repo")}
    assert [r.text.strip() for r in d["code"].filter("marker = '>>>'").collect()] == ["if not value:"]
    assert rows(d["imports"], "module") == ["json"]


def test_insights_and_primer(repo, tmp_path):
    p = repo.primer("heavy", "debug")
    assert p["prompt"].count("# Task") == 1 and p["readme"].first().summary == "A small repository.\nTwo lines."
    assert p["entrypoints"].orderBy(F.desc("blend")).first().path in ("bin/run", "src/main.py")
    assert set(rows(p["dispatch"], "command", "source_file", "handler")) == {("go", "lib/go.sh", "cmd_go"), ("stop", "", "cmd_stop")}
    assert rows(p["tests"], "path", "cases", "asserts") == [("tests/test_main.py", 1, 1)]
    assert ("lib/go.sh", "error suppression") in rows(p["risks"], "path", "label")
    assert "bin/run" in rows(p["boundaries"], "path")
    assert set(repo.primer("light")) < set(repo.primer("medium")) < set(p)
    assert "<tree>" in render.sections({"tree": p["tree"], "prompt": p["prompt"]})
    with pytest.raises(ValueError):
        repo.primer("huge")
    with pytest.raises(ValueError):
        repo.prompt("sleep")


def test_diff(repo, root):
    assert tuple(repo.diff_stat().first()) == (0, 0, 0)
    (root / "README.md").write_text("# Sample\n++ more\n")
    try:
        assert tuple(Repository(repo.spark, str(root)).diff_stat().first()) == (1, 1, 5)
    finally:
        subprocess.run(["git", "-C", str(root), "checkout", "-q", "README.md"], check=True)


def test_config(tmp_path):
    f = tmp_path / "rc"
    f.write_text('# note\nGREP_MAX=7\nSYMBOL_KINDS="class, enum"\nCHURN_BUCKET=auto\n')
    c = Config().with_file(f)
    assert (c.grep_max, c.symbol_kinds, c.churn_bucket) == (7, ("class", "enum"), None)
    for bad in ("GREP_MAX=$(id)", "NOPE=1", "GREP_MAX=0", "echo hi"):
        f.write_text(bad + "\n")
        with pytest.raises(ValueError):
            Config().with_file(f)


def test_no_repository(tmp_path):
    with pytest.raises(ValueError):
        git.discover("/proc")
