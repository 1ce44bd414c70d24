import numpy as np
import pytest

from relyframe.llm import mtree
from tests.llm.test_vectors_chat_pipeline import brute, run


def test_mtree_moves_a_row_for_a_block_and_a_shard(spark, monkeypatch):
    """queries are not copied for every shard, and several blocks give what one gives."""
    monkeypatch.setattr(mtree, "SHARD_ROWS", 30)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 4)
    monkeypatch.setattr(mtree, "WALKS", 2, raising=False)
    moved, plain = [], mtree.meetings

    def counted(routed, trees):
        near, own = plain(routed, trees)
        moved.append((near.count(), own.count(), near.select("block").distinct().count()))
        return near, own

    monkeypatch.setattr(mtree, "meetings", counted)
    rng = np.random.default_rng(6)
    rows = [(i, (np.round(rng.normal(size=4), 1) * (1 + i % 2)).tolist()) for i in range(500)] + [(500 + i, [0.5, 0.5, 0.25, 0.0]) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    assert len(moved) == 2 and all(near == own for near, own, _ in moved) and moved[1][2] > 1


def test_mtree_best_is_carried_from_tree_to_tree():
    """A second tree sees the k-th score of the first; equal scores go to the smaller id, whichever tree has it."""
    rng = np.random.default_rng(7)
    x = rng.integers(-4, 5, (900, 3))
    ids = rng.permutation(900)
    top = float((x**2).sum(axis=1).max())
    trees = [mtree.load(mtree.dump(mtree.MTree(x[i::3], [[int(a)] for a in ids[i::3]], top))) for i in range(3)]
    best = mtree.Best(x[:50], 7)
    for tree in trees:
        best.visit(tree, np.arange(0, 50, 2))
    for q in range(50):
        order = np.lexsort((ids, -(x @ x[q])))[:7]
        assert best.ids[q].tolist() == (ids[order].tolist() if q % 2 == 0 else [mtree._LAST] * 7)
        assert q % 2 or best.scores[q].tolist() == (x @ x[q])[order].tolist()


@pytest.mark.parametrize("big", [1, 2**11, 2**20, 2**24, 2**54])
def test_mtree_scores_are_exact(big):
    """The number type follows from both sides: a long query among short objects, too."""
    x = np.array([[1, 1], [1, 0], [1, 2], [-1, 1], [0, 1]], np.int64)
    q = np.array([[big, 1], [1, -big], [big - 1, big // 2 + 1]], np.int64)
    scores, ids, _ = mtree.MTree(x, [[i] for i in range(5)]).search(q, 3)
    for mine, names, one in zip(scores, ids, q, strict=True):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(one, row, strict=True)), i) for i, row in enumerate(x))[:3]
        assert [(-s, i) for s, i in zip(mine.tolist(), names.tolist(), strict=True)] == exact


def test_mtree_first_objects(spark):
    rows = spark.createDataFrame([(h * (2**63 // 150), [h]) for h in range(-140, 140)], "h long, v array<long>")
    assert [r["v"] for r in mtree.first_objects(rows, 280, 5)] == [[h] for h in range(-140, -135)]
    high = rows.filter("h > 0")  # none below the expected hash
    assert [r["v"] for r in mtree.first_objects(high, 139, 3)] == [[1], [2], [3]]


def test_mtree_blocks_of_queries():
    assert mtree.dealt([(0, 3), (1, 5), (2, 4), (7, 25), (8, 1), (9, 9)], 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (7, 2, 3), (8, 5, 1), (9, 5, 1)]
    assert mtree.dealt([], 10) == []
