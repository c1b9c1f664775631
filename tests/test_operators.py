"""Operators on cases that the shared tables don't have."""

import random

import pytest
from pyspark.sql import functions as F

from lithoscan.operators import churn, graph, imports, insights, signatures, symbols, text, tree
from lithoscan.streaming.changes import windowed_churn


def log(spark, sets):
    rows = [(i, "a", p, f"f{x}", 10) for i, s in enumerate(sets) for p, x in enumerate(sorted(s))]
    return spark.createDataFrame([(i, "a") for i in range(len(sets))], "commit_idx long, author string"), spark.createDataFrame(rows, "commit_idx long, author string, pos int, path string, changes long")


def test_commits_of_many_paths_make_no_pairs(spark):
    commits, changes = log(spark, [range(100)] * 4)
    assert churn.cochange_pairs(changes).collect() == []
    assert churn.sustained(commits, changes).count() == 94
    _, mixed = log(spark, [range(51), range(51), {1, 2}, {1, 2}])
    got = churn.cochange_pairs(mixed, 0.1).collect()
    assert [(r.a, r.b, r.co_commits, r.coupling) for r in got] == [("f1", "f2", 2, 2 / 6)]


def test_log_parsing(spark):
    lines = ["COMMIT\tBob", "1\t2\ta.py", "-\t-\tpic.png", "", "COMMIT\tMerge", "COMMIT\tAnn", '3\t0\t"b c.py"', "x\ty\tbad", "COMMIT\tBinary", "-\t-\tz"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, text string")
    commits, changes = churn.parse_numstat(df)
    assert {tuple(r) for r in commits.collect()} == {(0, "Ann"), (1, "Bob")}
    assert {(r.commit_idx, r.path, r.changes) for r in changes.collect()} == {(0, "b c.py", 3), (1, "a.py", 3)}


def test_bucket_sizes(spark):
    def want(n):
        if n <= 60:
            return 1
        s = max(1, round(n / 50))
        b = -(-n // s)
        return max(1, -(-n // 60)) if b > 60 else max(1, n // 30) if b < 30 else s

    df = spark.range(1, 2000).withColumn("s", churn.auto_bucket_size(F.col("id")))
    assert {r.id: r.s for r in df.collect()} == {n: want(n) for n in range(1, 2000)}


def tarjan(nodes, adj):
    reach = {n: {n} for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for y in adj.get(todo.pop(), ()):
                if y not in reach[n]:
                    reach[n].add(y)
                    todo.append(y)
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:02}" for k in range(14)]
    e = {(rng.choice(names), rng.choice(names)) for _ in range(18)}
    df = spark.createDataFrame(sorted(e), "src string, dst string")
    e = {(a, b) for a, b in e if a != b}
    adj = {}
    for a, b in e:
        adj.setdefault(a, set()).add(b)
    nodes = {x for p in e for x in p}
    clean = graph.distinct_edges(df)
    comp = tarjan(nodes, adj)
    comps = graph.strong_components(clean)
    assert {r.node: r.comp for r in comps.collect()} == comp

    def depth(c, seen=()):
        below = {comp[b] for a, b in e if comp[a] == c and comp[b] != c}
        return 1 + max(map(depth, below)) if below else 0

    assert {r.node: r.layer for r in graph.layers(clean, comps).collect()} == {n: depth(comp[n]) for n in nodes}
    sampled = graph.betweenness(clean, max_sources=5).collect()
    assert len(sampled) == len(nodes) and all(r.betweenness >= 0 for r in sampled)


def test_closure_has_a_limit(spark, monkeypatch):
    monkeypatch.setattr(graph, "CLOSURE_LIMIT", 3)
    with pytest.raises(ValueError):
        graph.reachability(spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string"))


def test_graph_beyond_the_closure_limit(spark, monkeypatch, sf_dir):
    from lithoscan.plans import graph_queries

    monkeypatch.setattr(graph, "CLOSURE_LIMIT", 3)
    rng = random.Random(6)
    e = {(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(75)} | {("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x0", "x1"), ("x3", "x4"), ("x4", "x5"), ("x5", "x4")}
    df = spark.createDataFrame(sorted(e), "src string, dst string")
    imported = graph_queries.import_edges(spark, sf_dir)
    for edges, pairs, nodes in ((df, e, set()), (imported, set(map(tuple, imported.select("src", "dst").collect())), {r.path for r in graph_queries.modules(spark, sf_dir).collect()})):
        adj = {}
        for a, b in pairs:
            adj.setdefault(a, set()).add(b)
        nodes = nodes | {x for p in pairs for x in p}
        want = tarjan(nodes, adj)
        got = graph.strong_components(edges) if edges is df else graph_queries.import_scc(spark, sf_dir)
        assert {r.node: r.comp for r in got.collect()} == want and len(set(want.values())) < len(nodes)
    assert graph.betweenness(df).count() == len({x for p in e for x in p})


def test_import_resolution(spark):
    files = spark.createDataFrame([("pkg/a.py",), ("pkg/__init__.py",), ("pkg/sub/b.py",), ("src/lib/c.py",), ("web/x.ts",), ("web/lib/index.js",), ("include/u.h",), ("c/v.h",)], "path string")
    want = spark.createDataFrame(
        [("pkg/sub/b.py", "a", 2, []), ("pkg/sub/b.py", "", 2, ["a"]), ("pkg/a.py", "lib.c", 0, []), ("pkg/a.py", "pkg", 0, ["sub"]), ("pkg/a.py", "os.path", 0, [])], "src string, module string, level int, names array<string>"
    )
    got = {(r.src, r.module): (r.dst, r.is_internal) for r in imports.resolve(imports.with_submodules(want), files, imports.source_roots(files)).collect()}
    assert got["pkg/sub/b.py", "pkg.a"] == ("pkg/a.py", True) and got["pkg/a.py", "lib.c"] == ("src/lib/c.py", True)
    assert got["pkg/a.py", "pkg"] == ("pkg/__init__.py", True) and got["pkg/a.py", "pkg.sub"] == (None, True) and got["pkg/a.py", "os.path"] == (None, False)
    other = spark.createDataFrame([("web/x.ts", "./lib"), ("web/lib/index.js", "../x"), ("web/x.ts", "react"), ("c/m.c", "u.h"), ("c/m.c", "v.h"), ("c/m.c", "stdio.h")], "src string, module string")
    assert {(r.src, r.module): r.dst for r in imports.resolve(other, files).collect()} == {
        ("web/x.ts", "./lib"): "web/lib/index.js", ("web/lib/index.js", "../x"): "web/x.ts", ("web/x.ts", "react"): None, ("c/m.c", "u.h"): "include/u.h", ("c/m.c", "v.h"): "c/v.h", ("c/m.c", "stdio.h"): None,
    }


def test_lines_and_counts(spark):
    df = spark.createDataFrame([("a", ""), ("b", "x"), ("c", "x\n"), ("d", "x\n\ny"), ("e", None), ("f", "\n")], "path string, text string")
    assert {r.path: r.n for r in df.select("path", text.line_count(F.col("text")).alias("n")).collect()} == {"a": 0, "b": 1, "c": 1, "d": 3, "e": 0, "f": 1}
    n = {r.path: r["count"] for r in text.lines(df).groupBy("path").count().collect()}
    assert n == {"b": 1, "c": 1, "d": 3, "f": 1}


def test_binary_and_malformed_text(spark):
    df = spark.createDataFrame([("a", bytearray(b"ok \xff\xfe end")), ("b", bytearray(b"x\0y")), ("c", bytearray(b"a" * 600_000))], "path string, content binary")
    got = {r.path: r.t for r in df.select("path", text.bounded_text(F.col("content")).alias("t")).collect()}
    assert got["a"] == "ok  end" and got["b"] == "" and len(got["c"]) == 512_000


def test_block_choice_and_first_fit(spark):
    small = [x for k in range(10) for x in (f"def f{k}():  # L{k * 2 + 1}-{k * 2 + 2}", "    ...", "")]
    big = ["@deco", "class Big:  # L50-150"] + [f"    def m{k}(self):  # L{60 + k}-{61 + k}" for k in range(8)]
    kept = signatures.by_span(small + big, 20)
    assert kept[:2] == ["@deco", "class Big:  # L50-150"] and len(kept) <= 20
    assert signatures.count_symbols(small + big) == 19
    costs = spark.createDataFrame([(1, "a", 5), (2, "b", 9), (3, "c", 3)], "rank int, path string, cost long")
    assert signatures.allocate(costs, 20, [F.asc("rank")]) == {"a": "detail", "b": "catalog", "c": "detail"}
    assert signatures.catalog_entry("p.py", big, 9).startswith("- `p.py`: Big (L50), m0 (L60)") and "+4 more" in signatures.catalog_entry("p.py", big, 9)


def test_budgeted_tree_fits(spark):
    files = spark.createDataFrame([(f"d{a}/f{b}.py", 1) for a in range(6) for b in range(6)], "path string, loc long")
    got = tree.expand_budgeted(files, 10).collect()
    lines = sum(r.state in ("file", "collapsed") for r in got) + sum(r.state == "partial" for r in got)
    assert lines <= 10 and sum(r.state == "partial" and r.hidden > 0 for r in got) == 1


def test_entrypoints(spark):
    rows = [("src/app/main.c", "int main(void) {}"), (".github/ci.sh", 'case "$x" in\nesac'), ("docs/main.py", ""), ("tool.sh", "echo"), ("bin/x", "")]
    got = {r.path: (r.score, r.signals) for r in insights.entrypoints(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"src/app/main.c": (11, ["entry-name", "name-hint", "c-main"]), "bin/x": (5, ["bin"])}


def test_nested_and_classic_tags(spark):
    df = spark.createDataFrame([("a.py", "class A:\n    class B:\n        def f(self, x=1): pass\n    async def g(self):\n        def h(): pass\nif 1:\n    def k(): pass\n")], "path string, text string")
    got = {(r.name, r.scope, r.kind, r.signature) for r in symbols.python_tags(df).collect()}
    assert got == {("A", None, "class", None), ("B", "A", "class", None), ("f", "A.B", "member", "(self, x=1)"), ("g", "A", "member", "(self)"), ("h", "A.g", "function", "()"), ("k", None, "function", "()")}
    raw = spark.createDataFrame([("!_TAG\tx",), ("n\tp.c",), ("n\tp.c\t/x/\tf\tline:3\tclass:K",), ('{"_type":"ptag"}',)], "value string")
    assert [(r.name, r.line, r.kind, r.scope, r.end) for r in symbols.parse_tags(raw).collect()] == [("n", 3, "function", "K", None)]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stamped = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src = tmp_path / "in"
    spark.read.parquet(path).repartition(1).write.parquet(str(src))
    q = windowed_churn(stamped(spark.readStream.schema(schema).parquet(str(src)))).writeStream.format("memory").queryName("churned").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("churned").collect()} == {tuple(r) for r in windowed_churn(stamped(spark.read.parquet(path))).collect()}


def test_calls_side_by_side_and_nested(spark):
    rows = [("a", "y = f(g(x))"), ("b", "h (1); _i(2)"), ("c", "if (x): éa(1); naïve(2)")]
    got = symbols.call_names(spark.createDataFrame(rows, "symbol string, text string"), ["symbol"]).collect()
    assert {tuple(r) for r in got} == {("a", "f"), ("a", "g"), ("b", "h"), ("b", "_i"), ("c", "naïve")}


def test_words_that_share_a_separator_count_each(spark):
    df = spark.createDataFrame([("tests/test_a.sh", "assert_eq assert_ne\nsrc/a.py,lib/b.sh tool run tool stop")], "path string, text string")
    assert insights.test_counts(df).first().asserts == 2
    assert {tuple(r) for r in insights.mentions(df).collect()} == {("src/a.py", 1), ("lib/b.sh", 1)}
    assert {tuple(r) for r in insights.command_hits(df, "tool").collect()} == {("run", 1), ("stop", 1)}


def test_budgeted_choice_against_first_fit_by_hand(spark):
    rng = random.Random(4)
    for budget in (12, 30, 80, 300):
        rows = [(k, f"f{k:03}", rng.choice([3, 4, 5, 9, 17, 24, 400])) for k in range(200)]
        want, used, listed = {}, 0, 0
        overhead = max(5, int(budget * 0.05))
        full = int((budget - overhead) * 0.63)
        for _, path, cost in rows:
            if used + cost <= full:
                want[path], used = "detail", used + cost
            elif listed < budget - overhead - full:
                want[path], listed = "catalog", listed + 1
        assert signatures.allocate(spark.createDataFrame(rows, "rank int, path string, cost long"), budget, [F.asc("rank")]) == want


def greedy_tree(files, budget):
    """{path: (state, hidden)} by a queue of collapsed directories, the most important first."""
    import heapq
    import math

    below, stats = {}, {}
    for path, loc in files:
        parts = path.split("/")
        for k in range(len(parts)):
            parent = "/".join(parts[:k])
            below.setdefault(parent, set()).add("/".join(parts[: k + 1]))
            n, total = stats.get(parent, (0, 0))
            stats[parent] = (n + 1, total + loc)
    locs = dict(files)
    weight = {d: 0.5 * (math.log2(1 + n) + math.log2(1 + total / 100)) for d, (n, total) in stats.items()}
    state = {p: "collapsed" if p in below else "file" for p in below.get("", ())}
    queue = [(-weight[p], p) for p, s in state.items() if s == "collapsed"]
    heapq.heapify(queue)
    used, hidden = len(state), {}
    while queue and used < budget:
        _, d = heapq.heappop(queue)
        inside = below[d]
        if used + len(inside) - 1 <= budget:
            state[d], used = "expanded", used + len(inside) - 1
            show = inside
        else:
            if budget - used < 1:
                break
            state[d], hidden[d] = "partial", len(inside) - (budget - used)
            show = sorted(inside, key=lambda p: (-(weight[p] if p in below else locs[p] / 1000), p))[: budget - used]
        for p in show:
            state[p] = "collapsed" if p in below else "file"
            if p in below and state[d] == "expanded":
                heapq.heappush(queue, (-weight[p], p))
        if state[d] == "partial":
            break
    return {p: (s, hidden.get(p, 0)) for p, s in state.items()}


@pytest.mark.parametrize("budget", [3, 9, 14, 40])
def test_budgeted_tree_against_a_queue(spark, budget):
    rng = random.Random(budget)
    files = sorted({"/".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) + f".{k % 40}": rng.randint(1, 900) for k in range(60)}.items())
    got = {r.path: (r.state, r.hidden) for r in tree.expand_budgeted(spark.createDataFrame(files, "path string, loc long"), budget).collect()}
    assert got == greedy_tree(files, budget)


def test_running_counts_and_states_over_stretches(spark, monkeypatch):
    from lithoscan.operators import ordering

    monkeypatch.setattr(ordering, "STRETCH", 7)
    rng = random.Random(2)
    rows = [(k * 3, rng.random() < 0.2, rng.choice([None, None, None, "a", "b"])) for k in range(100)]
    df = spark.createDataFrame(rows, "o long, f boolean, v string").repartition(5)
    n, last, want = 0, None, {}
    for o, f, v in rows:
        n, last = n + f, v or last
        want[o] = (n, last)
    a = {r.o: r.n for r in ordering.running_count(df, F.col("f"), "o", "n").collect()}
    b = {r.o: r.s for r in ordering.last_known(df, F.col("v"), "o", "s").collect()}
    assert {o: (a[o], b[o]) for o in want} == want


def test_modules_in_paths(spark):
    mods = spark.createDataFrame([("x.py", "a.b"), ("x.py", "zz"), ("x.js", "./lib"), ("x.c", "io"), ("x.rb", "")], "src string, module string")
    got = imports.contains_internal(mods, spark.createDataFrame([("src/a/b.py",), ("lib/u.js",), ("io.h",)], "path string")).collect()
    assert {tuple(r) for r in got} == {("x.py", "a.b"), ("x.js", "./lib"), ("x.c", "io"), ("x.rb", "")}


def test_search_context_at_the_edges(spark):
    files = spark.createDataFrame([("a", "x\nhit\n"), ("b", "1\n2\n3\nhit\n5\nhit\n7\n8\n9"), ("c", ""), ("d", None), ("e", "no\n\n")], "path string, text string")
    got = {(r.path, r.line_no, r.is_match) for r in text.grep(files, "hit", context=1, limit=None).collect()}
    assert got == {("a", 1, False), ("a", 2, True), ("b", 3, False), ("b", 4, True), ("b", 5, False), ("b", 6, True), ("b", 7, False)}
    assert [(r.path, r.line_no) for r in text.grep(files, "hit", context=0, limit=1).collect()] == [("a", 2), ("b", 4)]
