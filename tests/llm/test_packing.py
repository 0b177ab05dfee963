import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm.packing import combinations, least_squares, packed, placement, plan, unused_space


def test_plan_holds_every_item_once():
    rng = random.Random(2)
    for n in (0, 1, 50, 3000):
        h = Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1)))) for _ in range(n))
        p = plan(h)
        got = Counter()
        for sizes, m in p:
            assert sum(sizes) <= 4096
            for s in sizes:
                got[s] += m
        assert got == h
    used, containers = sum(k * v for k, v in h.items()), sum(m for _, m in p)
    assert 1 - used / (4096 * containers) < 0.005


def test_plan_corners():
    assert plan({4096: 3}) == [((4096,), 3)]
    assert sum(m for _, m in plan({2049: 10})) == 10
    assert sum(m for _, m in plan({2048: 11})) == 6
    assert sum(m for _, m in plan({1: 4097})) == 2
    with pytest.raises(ValueError):
        plan({5000: 1})


def test_least_squares_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.uniform(0, 1, (8, 12)), rng.uniform(0, 1, 8)
        x = least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_combinations_fill_the_window():
    for c in combinations(16, 4):
        assert 16 <= sum(c) <= 16 + len(c) // 2 and list(c) == sorted(c, reverse=True)
    assert len(set(combinations(16, 4))) == len(combinations(16, 4))


def test_placement_ranks():
    at = placement([((5, 5), 2), ((5, 3), 1)])
    assert list(zip(*(at[k].tolist() for k in ("size", "rank", "container", "offset")))) == [(3, 0, 2, 5), (5, 0, 0, 0), (5, 2, 0, 5), (5, 4, 2, 0)]


def test_packed_items(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 7, 300, 300, 300, 1500, 4096, 9000, rng.randrange(1, 4000)])) for i in range(1500)] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("bucket", F.lit(1)).withColumn("n", F.lit(1))
    out = packed(df).collect()
    by, size = {}, Counter()
    for r in out:
        size[r.doc_id] += r.n_tokens
        if r.container is None:
            assert r.n_tokens == 0
        else:
            by.setdefault(r.container, []).append((r.start, r.n_tokens))
    assert size == Counter({i: n or 0 for i, n in rows})
    assert {r.piece for r in out if r.doc_id in {i for i, n in rows if n and n <= 4096}} == {0}  # none of these is split
    for parts in by.values():
        parts.sort()
        end = 0
        for start, n in parts:
            assert start == end
            end += n
        assert end <= 4096
    assert sorted(by) == list(range(len(by)))
    total = unused_space(packed(df)).first()
    assert total.containers == len(by) and total.unused_share < 0.02
    assert packed(df.limit(0)).count() == 0 and packed(df.where("n_tokens = 0")).where("container is not null").count() == 0
