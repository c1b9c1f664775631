"""The command line over the repository of the command tests."""

import pytest

from lithoscan.cli import main, parser

from .test_repository import repo, root  # noqa: F401


@pytest.mark.parametrize(("args", "has"), [
    ("symbols", "Job.start"), ("symbols src/tools --kinds function", "shout"), ("outline src/main.py", "class Job"), ("slice src/main.py 1 2", "import os"), ("show Job", "def start(self)"),
    ("definition shout", "helpers.py"), ("references shout", "main.py"), ("deps src/main.py", "internal"), ("grep upper --context 0", "helpers.py"), ("files *.md", "README.md"), ("callees start", "check"),
    ("related src/tools/helpers.py", "main.py"), ("tree --depth 1", "src/"), ("signatures src/tools", "def shout"), ("diff --stat", "added"), ("churn --summary", "commits"), ("prompt", "repository"), ("context src/main.py 14", "def start"),
])
def test_commands(spark, root, capsys, args, has):  # noqa: F811
    assert main(["--repo", str(root), *args.split()], spark) == 0
    assert has.lower() in capsys.readouterr().out.lower()


def test_errors_and_help(spark, root, capsys):  # noqa: F811
    assert main(["--repo", str(root), "slice", "src/main.py", "3", "1"], spark) == 1 and "error" in capsys.readouterr().err
    assert main(["--repo", "/", "symbols"], spark) == 1
    for bad in ([], ["nothing"], ["slice", "a"], ["churn", "--sort", "x"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)
    assert all(f" {c} " in parser().format_help() for c in ("tree", "symbols", "primer", "notebook", "related"))
