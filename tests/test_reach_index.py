"""Components and the reachability index against plain walks, in one task and in distributed rounds."""

import random

import pytest
from pyspark.sql import functions as F

from relyframe.operators import graph, reach_index


def reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for m in after.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = seen
    return out


def graphs():
    for seed, n, m in ((1, 40, 45), (2, 40, 90), (3, 60, 50), (4, 30, 30)):
        r = random.Random(seed)
        yield [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    yield [(1, 2), (2, 3), (3, 2), (4, 4), (5, 6), (6, 7), (3, 5), (8, 9)]


@pytest.mark.parametrize("one_task", [10**6, 8])
@pytest.mark.parametrize("edges", list(graphs()))
def test_components(spark, monkeypatch, edges, one_task):
    monkeypatch.setattr(reach_index, "ONE_TASK", one_task)
    df = spark.createDataFrame([*edges, edges[0], (None, 1), (2, None)], "src long, dst long")
    all_ = reach(edges)
    want = {n: max([m for m in seen if n in all_[m]] + [n]) for n, seen in all_.items()}
    assert {r.node: r.component for r in reach_index.strong_components(df).collect()} == want


@pytest.mark.parametrize("edges", list(graphs()))
def test_index_answers_like_walks(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    want, index = reach(edges), reach_index.build_index(df)
    assert {r.node: (r.reached, r.itself) for r in index.counts().collect()} == {n: (len(s), n in s) for n, s in want.items()}
    roots = spark.createDataFrame([(n,) for n in [*list(want)[::3], 999, None]], "root long")
    assert sorted((r.root, r.node) for r in index.pairs(roots).collect()) == sorted((n, m) for n in list(want)[::3] for m in want[n])
    loops = {n for n, s in want.items() if n in s}
    assert {r.node: r.meets_cycle for r in index.meets_cycle().collect()} == {n: bool(({n} | s) & loops) for n, s in want.items()}


def test_no_index_beyond_its_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(i, j) for i in range(20) for j in range(100, 160, 2 + i % 3)], "src long, dst long")
    want = {r.node: r.reached for r in graph.reach_counts(df).collect()}
    assert reach_index.build_index(df, most=30) is None
    monkeypatch.setattr(reach_index, "ONE_TASK", 50)
    assert reach_index.build_index(df) is None
    have = {r.node: r.reached for r in graph.reach_counts(df).collect()}
    assert have == {n: k for n, k in want.items() if k}
    assert reach_index.build_index(df.limit(0)).counts().count() == 0


def test_ladder_and_ring_need_few_rounds(spark, monkeypatch):
    rounds = []
    plain = reach_index.settle
    monkeypatch.setattr(reach_index, "settle", lambda df: rounds.append(1) or plain(df))
    steps = spark.range(10_000).select(F.col("id").alias("level"))
    ladder = steps.select(F.explode(F.array(*[F.struct((2 * F.col("level") + a).alias("src"), (2 * F.col("level") + 2 + b).alias("dst")) for a in (0, 1) for b in (0, 1)])).alias("e")).select("e.*")
    index = reach_index.build_index(ladder)
    assert index.counts().agg(F.max("reached"), F.sum("reached")).first() == (20_000, sum(2 * 2 * k for k in range(10_001)))
    ring = steps.select(F.col("level").alias("src"), ((F.col("level") + 1) % 10_000).alias("dst"))
    index = reach_index.build_index(ring)
    assert index.counts().where("reached = 10000 AND itself").count() == 10_000 and len(rounds) < 30
    assert index.meets_cycle().where("meets_cycle").count() == 10_000


def test_numbering_holds_a_few_numbers_per_node():
    """A tree of 60,000 nodes whose every seventh node also has a way to another branch: at most 250 bytes a node, no object for each."""
    import tracemalloc

    import numpy as np

    from relyframe.operators.reach_index import ranges_of

    n = 60_000
    child, far = np.arange(1, n), np.arange(1, n // 2, 7)
    src, dst = np.concatenate([(child - 1) // 2, far]), np.concatenate([child, far + n // 2])
    tracemalloc.start()
    try:
        found = ranges_of(n, src, dst, np.ones(n, np.int64), 10_000_000)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found and most < 250 * n
