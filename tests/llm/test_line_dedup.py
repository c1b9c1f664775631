import random
import time

import pytest

from lithoscan.llm import line_dedup, queries


def brute(rows):
    """A line stays in the rows of the least id, null first, and least number at which it stands."""
    first = {}
    order = lambda i, k: (i is not None, i or 0, k)
    blank = lambda line: all(ord(c) <= 32 for c in line)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            first[line] = min(first.get(line, order(i, k)), order(i, k))
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if blank(x) or first[x] == order(i, k))) for i, t in rows), key=str)


def made(n=300, seed=1):
    rng = random.Random(seed)
    pool = [f"line {k} " + "é" * (k % 5) for k in range(400)]
    return [(i, "\n".join(rng.choice(pool + ["", " \t", "unique %d" % rng.random().__hash__()]) for _ in range(rng.randint(0, 9)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "\n"), (n + 3, "x\n" * 5000), (None, "line 1 é\nnull id")]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_brute_force(spark, limit):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df, broadcast_bytes=limit).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_rows_of_one_id_with_different_texts(spark, limit):
    rows = [(0, "z\ny"), (1, "x\nq"), (1, "y\nr"), (2, "x"), (1, None), (1, "q\nx\ny\nz\nw"), (1, ""), (None, "w\nw"), (None, None), (3, "w\nv"), (3, "v\nv"), (0, "z\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df, broadcast_bytes=limit).collect()), key=str)
    assert got == brute(rows) and (1, "r") in got


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_a_line_in_every_document_and_many_chunks(spark, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK_LINES", 50)
    rows = [(f"d{k:04}", f"own {k}\nthe same everywhere\nhalf {k // 2}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, broadcast_bytes=limit).collect()}
    assert got == {f"d{k:04}": f"own {k}" + ("\nthe same everywhere" if k == 0 else "") + (f"\nhalf {k // 2}" if k % 2 == 0 else "") for k in range(600)}


def test_both_ways_suspect_the_same_lines(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string").repartition(5)
    twice = line_dedup.twice_seen(df, 16)
    shared = spark.sparkContext.broadcast(line_dedup.Suspects(16, [(r["seg"], r["m"], bytes(r["bits"])) for r in twice.collect()]))
    one = {(r.doc_id, i) for r in line_dedup._marked_by_broadcast(df, "text", "s", shared).collect() for i in r.s}
    two = {(r.id, i) for r in line_dedup.suspect_numbers(df, twice, 16, "doc_id", "text").collect() for i in r.numbers}
    assert one == two


def test_local_rows_take_no_longer_than_rows_of_a_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "b")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "t"))
    line_dedup.dedup_lines(df).collect()
    took = []
    for d in (df, spark.read.parquet(str(tmp_path / "t"))):
        began = time.perf_counter()
        assert sorted(map(tuple, line_dedup.dedup_lines(d).collect())) == [(1, "a\nb"), (2, "")]
        took.append(time.perf_counter() - began)
    assert took[0] < 2 * took[1] + 2


def test_same_as_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.op3_line_dedup(spark, sf_dir), queries.ORACLE_SQL["op3_line_dedup"])


def test_repeated_rows_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb", 1), (1, "a\nb", 2), (2, "b\nc", 3)], "doc_id long, text string, suspects int").selectExpr("*", "7 AS kept", "'z' AS line", "now() AS at")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r.suspects, r.kept) for r in out.collect()) == [(1, "a\nb", 1, 7), (1, "a\nb", 2, 7), (2, "c", 3, 7)]
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []
