"""The pipeline's stages against brute force, each on its own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from lithoscan.llm import langid, ngram_join, queries  # noqa: E402

from .test_line_dedup import brute as dedup_by_hand  # noqa: E402
from .test_ngram_join import brute as pairs_by_hand  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(pipeline.STAGES):
        f(spark, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "source_mixing", "best_fit_packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_language(stages):
    ok = {r.doc_id for r in langid.identify(stages[0]).collect() if r.accepted}
    assert {r.doc_id for r in stages[1].collect()} == ok


def test_lines(stages):
    want = {(i, t) for i, t in dedup_by_hand([(r.doc_id, r.text) for r in stages[1].collect()]) if t and t.strip()}
    rows = stages[2].collect()
    assert {(r.doc_id, r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_near_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in pairs_by_hand(rows, ngram_join.THRESHOLD):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.doc_id for r in stages[3].collect()} == {i for i in root if find(i) == i}


def test_mix(stages, tmp_path):
    import duckdb

    path = str(tmp_path / "in")
    stages[3].write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.mixing_sql()})").fetchall())
    assert sorted(r.doc_id for r in stages[4].collect()) == want


def test_bins(stages):
    words, got = {}, {}
    for r in stages[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    fill = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    assert got == words and max(fill.values()) <= queries.CAPACITY
    assert len(fill) <= -(-sum(words.values()) // queries.CAPACITY) + 2


def test_run_is_the_stages(spark, sf_dir, stages):
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_every_stage_takes_nulls_repeats_long_texts_clashing_names_and_empty_tables(spark):
    rows = [(k, f"The quick word number {k} of many that stand in line {k}\nshared line", "en", "s1", 9) for k in range(30)]
    rows += [(100, None, "en", "s1", None), (101, "", None, None, 0), (None, "Words of a text that has no id at all", "en", None, 5), (102, "\n\n", "en", "s1", 2), rows[0], (103, "long words of a text " * 20000, None, "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(("suspects", "kept", "kept_id", "rep", "id", "epoch_", "domain__m", "whole__m", "distance", "lang__f", "shard", "n", "gone__id"))])
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, df, "")
        got = out.collect()
        assert stage(spark, df.limit(0), "").collect() == []
        assert k == 4 or out.dtypes == df.dtypes
        ids = {r.doc_id for r in got}
        if k == 0:
            assert not ids & {100, 101, 102}
        elif k == 1:
            assert ids == set(range(30)) | {None, 103} and sum("shared line" in r.text for r in got) == 2  # a repeated row is treated like its twin
        elif k == 2:
            assert {100, 101, 102, 103, None} <= ids and sum(r.doc_id == 0 for r in got) == 2
        elif k == 4:
            assert ids == {r[0] for r in rows}
