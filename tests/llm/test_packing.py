import random
import time
from itertools import combinations, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithoscan.llm import packing


def sums(bins, sizes):
    return [sum(sizes[i] for i in b) for b in bins]


def best(sizes, capacity):
    """The least number of bins, by trying all assignments."""
    for k in range(1, len(sizes) + 1):
        for where in product(range(k), repeat=len(sizes)):
            if all(sum(s for s, w in zip(sizes, where) if w == b) <= capacity for b in range(k)):
                return k
    return 0


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=60, deadline=None)
def test_every_size_once_and_no_bin_too_full(sizes):
    bins = packing.pack_sizes(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < s <= 20 for s in sums(bins, sizes))
    assert len(bins) <= len(packing.best_fit(sizes, 20))


def test_near_the_optimum_on_small_cases():
    rng = random.Random(3)
    over = 0
    for _ in range(25):
        sizes = [rng.randint(1, 10) for _ in range(6)]
        over += len(packing.pack_sizes(sizes, 12)) - best(sizes, 12)
    assert over <= 1


def test_search_beats_best_fit():
    rng = random.Random(5)
    fewer = 0
    for _ in range(60):
        sizes = [rng.randint(20, 60) for _ in range(40)]
        fewer += len(packing.best_fit(sizes, 100)) - len(packing.pack_sizes(sizes, 100, underfull=1.0))
    assert fewer > 0


@pytest.mark.parametrize("kind", ["one", "two", "split"])
def test_exchanges_raise_squared_fill(kind):
    sizes, bins = {"one": ([6, 3, 5, 4], [[0, 1], [2, 3]]), "two": ([7, 2, 3, 3, 3], [[0, 1], [2, 3, 4]]), "split": ([4, 3, 2, 8], [[0, 1, 2], [3]])}[kind]
    s = packing.LocalSearch(sizes, [list(b) for b in bins], 10, 1.0)
    before = int((s.fill**2).sum())
    moved = any(s.improve(k) for k in range(len(s.bins)) if s.bins[k])
    assert not moved or int((s.fill**2).sum()) > before


def test_documents(spark):
    rows = [(1, "a " * 25), (2, "b " * 4), (3, None), (4, ""), (None, "c c c"), (2, "b " * 4), (5, "d " * 10), (6, "e " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bin_id", "2 AS shard", "3 AS n")
    got = packing.pack(df, capacity=10).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {1: 25, 2: 8, 3: 0, 4: 0, None: 3, 5: 10, 6: 7}
    assert {r.bin_id for r in got if r.n_tokens == 0} == {None}
    fill = {}
    for r in got:
        if r.bin_id is not None:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    assert all(fill[r.bin_id] == r.bin_tokens <= 10 for r in got if r.bin_id is not None)
    assert len(fill) == 6  # 53 tokens
    assert sorted(r.piece for r in got if r.doc_id == 1) == [0, 1, 2]


def test_empty_and_shards(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).collect() == []
    many = spark.range(500).selectExpr("id AS doc_id", "repeat('w ', cast(id % 9 + 1 as int)) AS text")
    got = packing.pack(many, capacity=16, shard_rows=50).collect()
    assert len(got) == 500 and len({r.bin_id >> 32 for r in got}) > 5


def exchanges(bins, sizes, capacity):
    """Whether any move or exchange of one or two for none, one or two would make squared fill grow (by hand)."""
    groups = [[()] + [(i,) for i in b] + list(combinations(b, 2)) for b in bins]
    for x, y in product(range(len(bins)), repeat=2):
        fx, fy = sum(sizes[i] for i in bins[x]), sum(sizes[i] for i in bins[y])
        for give, back in product(groups[x], groups[y]) if x != y else ():
            if (len(give), len(back)) in ((1, 0), (1, 1), (2, 1), (1, 2)):
                g = sum(sizes[i] for i in give) - sum(sizes[i] for i in back)
                if g > 0 and fy + g <= capacity and (fx - g) ** 2 + (fy + g) ** 2 > fx**2 + fy**2:
                    return True
    return False


def test_ends_where_no_exchange_helps_or_bins_are_as_few_as_can_be():
    rng = random.Random(8)
    for _ in range(40):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(2, 25))]
        bins = packing.pack_sizes(sizes, 40, underfull=1.0)
        assert len(bins) <= -(-sum(sizes) // 40) or not exchanges(bins, sizes, 40)


def test_moves_that_only_swap_fills_do_not_go_on_for_ever():
    for sizes, bins in (([7, 3, 7], [[0, 1], [2]]), ([4, 3, 3, 4], [[0, 1], [2, 3]]), ([5, 5, 5], [[0, 1], [2]])):
        s = packing.LocalSearch(sizes, [list(b) for b in bins], 12, 1.0)
        before = int((s.fill**2).sum())
        steps = 0
        for k in (0, 1, 0, 1):
            while s.bins[k] and s.improve(k):
                after = int((s.fill**2).sum())
                assert after > before
                before, steps = after, steps + 1
        assert steps < 10
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 60))]
        assert sorted(i for b in packing.pack_sizes(sizes, 20, underfull=rng.choice([0.9, 0.98, 1.0])) for i in b) == list(range(len(sizes)))


def test_many_small_documents_in_one_bin_take_no_time():
    began = time.perf_counter()
    assert len(packing.pack_sizes([1] * 8000, 8192)) == 1
    assert len(packing.pack_sizes([1] * 8000 + [4000] * 3 + [2500] * 5, 8192)) == 4  # 32,500 tokens need as many
    assert time.perf_counter() - began < 1


def test_repeated_rows_spread_over_shards(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN NULL ELSE id END AS doc_id", "'w w w' AS text")
    got = packing.pack(df, capacity=16, shard_rows=200).collect()
    per = {}
    for r in got:
        per[r.bin_id >> 32] = per.get(r.bin_id >> 32, 0) + 1
    assert len(got) == 3000 and sum(r.doc_id is None for r in got) == 2000 and len(per) > 10 and max(per.values()) < 500
