"""Steps that have to do their work once, in many tasks, and with the rows of the plain way."""

import itertools
import random

from lithoscan.operators import churn, graph, imports
from lithoscan.plans import adapters, insight_queries, tree_queries


def counted(df, log):
    """``df``, of which each evaluation of a part adds a letter to the file ``log``."""

    def run(batches):
        with open(log, "a") as f:
            f.write("x")
        yield from batches

    return df.coalesce(1).mapInArrow(run, df.schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


_TEXTS = [
    "import a.b.c, d\nfrom . import e\nfrom .. import *\nfrom ..f import g as h, i\n",
    "def f():\n    import a\n    try:\n        import b.c\n    except ValueError:\n        import d as e\n    else:\n        from x import y\n    finally:\n        import z\n",
    "match 1:\n    case 1:\n        import m\nwith open('x') as f:\n    import w\nfor i in x:\n    import l\nelse:\n    import k\nwhile x: import q\nclass A:\n    import n\n",
    "from .... import far\nfrom . import __init__\nimport a.b\nimport a.b\nx = lambda: [y for y in z]\n", "import (", "", None, "import ü.é\nfrom .q import (r,\n s)\n",
]


def test_python_modules_are_those_of_all_statements(spark):
    paths = ["p/q/r.py", "top.py", "p.x/y.z/m.py", "p/__init__.py", "/abs/n.py", "other.txt"]
    files = spark.createDataFrame([(p if n == 0 else f"{n}/{p}", t) for p in paths for n, t in enumerate(_TEXTS)], "path string, text string")
    plain = imports.with_submodules(imports.python_imports(files))
    assert rows(imports.python_modules(files)) == rows(plain)
    got = {r.module for r in imports.python_modules(files.filter("path = '1/p/q/r.py'")).collect()}
    assert got == {"a", "b.c", "d", "x", "x.y", "z"}
    assert {r.module for r in imports.python_modules(files.filter("path = '2/p/q/r.py'")).collect()} == {"m", "w", "l", "k", "q", "n"}


def test_python_resolution_by_stems_is_that_of_candidates(spark):
    r = random.Random(5)
    names = ["a", "b", "src", "__init__", "c.d", "é"]
    dirs = ["", *("/".join(x) for k in (1, 2, 3) for x in itertools.product(names[:4], repeat=k)), "c.d", "c.d/a", "/a", "a//b", "./a", "a/../b"]
    paths = [f"{x}/{n}.{e}".removeprefix("/") if x else f"{n}.{e}" for x in dirs for n in names for e in ("py", "md") if r.random() < 0.25]
    paths += r.sample(paths, 20)
    srcs = r.sample([p for p in paths if p.endswith(".py")], 40)
    modules = [".".join(x) for k in (1, 2, 3) for x in itertools.product(["a", "b", "src", "__init__", "none"], repeat=k)]
    asked = spark.createDataFrame([(s, m, k) for k, s in enumerate(srcs) for m in r.sample(modules, 40)] * 1, "src string, module string, k int")
    known = spark.createDataFrame([(p,) for p in paths], "path string")
    assert rows(imports.resolve_python(asked, known)) == rows(imports.resolve(asked, known).select("src", "module", "k", "dst", "is_internal"))
    for roots in (imports.source_roots(known), spark.createDataFrame([("",), ("src",), ("a",), ("a/b",), ("a",)], "root string")):
        distinct = roots.distinct()  # the plain way tries a root given twice twice
        mine = imports.resolve_python(asked, known, roots)
        assert rows(mine) == rows(imports.resolve(asked, known, distinct).select("src", "module", "k", "dst", "is_internal"))
    assert {x.is_internal for x in mine.collect()} == {True, False}


def test_small_tables_are_spread(spark, sf_dir):
    least = spark.sparkContext.defaultParallelism
    for df in (insight_queries._files(spark, sf_dir), tree_queries._sources(spark, sf_dir), insight_queries._files(spark, sf_dir).filter("length(text) > 3")):
        assert df.rdd.getNumPartitions() >= least
    one = adapters.table(spark, sf_dir, "part")
    assert one.rdd.getNumPartitions() == 1 and rows(adapters.spread(one, "p_partkey")) == rows(one)


def test_betweenness_reads_its_edges_once(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {r.node: r.betweenness for r in graph.betweenness(counted(e, tmp_path / "log")).collect()} == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 0.0}
    assert (tmp_path / "log").read_text() == "x"


def test_clusters_read_their_pairs_once(spark, tmp_path):
    p = spark.createDataFrame([("a", "b", 2, 0.5), ("b", "c", 2, 1.0), ("x", "y", 3, 0.4)], "a string, b string, co_commits int, coupling double")
    got = rows(churn.cochange_clusters(counted(p, tmp_path / "log")))
    assert got == [("a", "a", 3, 0.75, 2), ("a", "b", 3, 0.75, 2), ("a", "c", 3, 0.75, 2), ("x", "x", 2, 0.4, 1), ("x", "y", 2, 0.4, 1)]
    assert (tmp_path / "log").read_text() == "x"


def test_pairs_of_commits_of_every_size(spark):
    r = random.Random(3)
    sets = {k: {r.choice("abcdefgh") for _ in range(r.randrange(1, 6))} for k in range(60)} | {99: {f"p{i}" for i in range(9)}}
    flat = [(k, p) for k, s in sets.items() for p in s]
    flat += flat[::7]
    df = spark.createDataFrame([(k, "x", 0, p, 1) for k, p in flat] + [(None, "x", 0, p, 1) for p in "ab"], "commit_idx int, author string, pos int, path string, changes int")
    want = {}
    for s in sets.values():
        if 2 <= len(s) <= 4:
            for pair in itertools.combinations(sorted(s), 2):
                want[pair] = want.get(pair, 0) + 1
    got = {(x.a, x.b): x.co_commits for x in churn.cochange_pairs(df, 0.0, max_paths=4).collect()}
    assert got == {k: n for k, n in want.items() if n >= churn.MIN_CO_COMMITS}
