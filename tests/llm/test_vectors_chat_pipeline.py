"""M-tree against brute force, chat round trips, and the pipeline's stages."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from relyframe.llm import chat, mtree
from tests.llm.conftest import EDGES, PASSAGE, prose

EMBEDDINGS = "vec_id long, embedding array<float>, label int, v string, pivot int, shard string"


def brute(rows, step=20, k=20):
    ok = {}
    for i, x in rows:
        if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x):
            v = [int(np.floor(float(np.float32(y)) * 64)) for y in x]
            ok[i] = min(ok.get(i, v), v)
    out = []
    for q in (i for i in ok if i % step == 0):
        scores = sorted((-sum(a * b for a, b in zip(ok[q], x)), i) for i, x in ok.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows):
    table = spark.createDataFrame([(i, x, 0, "c", 1, "s") for i, x in rows], EMBEDDINGS)
    v = mtree.whole_vectors(table)
    got = mtree.top_inner_products(v, v.filter("vec_id % 20 = 0"))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def test_mtree_edges(spark):
    rng = np.random.default_rng(0)
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(60)] + [(i, rng.normal(size=3).tolist()) for i in range(60, 400)]
    rows += [(400, None), (401, [None, 1.0, 2.0]), (402, [float("nan"), 1.0, 0.0]), (403, [float("inf"), 0.0, 0.0]), (None, same), (404, [0.0, 0.0, 0.0]), (61, rows[61][1]), (405, [300.0, -7.5, 0.1]), (420, [])]
    assert run(spark, rows) == brute(rows)


def test_mtree_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 100)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 8))
    rows = [(i, (centers[i % 5] + 0.2 * rng.normal(size=8)).tolist()) for i in range(700)]
    assert run(spark, rows) == brute(rows)


def test_mtree_hot_pivots_and_copies_of_trees(spark, monkeypatch):
    """Few pivots with many shards each; a tree is sent once to each block of its queries and nowhere else."""
    monkeypatch.setattr(mtree, "SHARD_ROWS", 40)
    monkeypatch.setattr(mtree, "PIVOTS", 2)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 8)
    sent = []
    plain = mtree.meetings

    def counted(routed, trees):
        near, own = plain(routed, trees)
        sent.append((own.count(), near.select("shard", "block").distinct().count(), near.groupBy("shard", "block").count().agg({"count": "max"}).first()[0]))
        return near, own

    monkeypatch.setattr(mtree, "meetings", counted)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * (1 + i % 3)).tolist()) for i in range(600)]
    assert run(spark, rows) == brute(rows)
    assert len(sent) == 2 and all(a == b and most <= 3 * mtree.QUERY_BLOCK for a, b, most in sent)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_mtree_few_rows(spark, n):
    rows = [(20 * i, [1.0, float(i)]) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_mtree_skips_work():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, (400, 4)) + c for c in ([200, 0, 0, 0], [0, 200, 0, 0], [0, 0, 200, 0])])
    tree = mtree.MTree(x.astype(np.int64), [[i] for i in range(len(x))])
    scores, ids, computed = tree.search(x[[7, 500]].astype(np.int64), 5)
    for q, s, i in zip((7, 500), scores, ids):
        order = np.lexsort((np.arange(len(x)), -(x @ x[q])))[:5]
        assert s.tolist() == (x @ x[q])[order].tolist() and i.tolist() == order.tolist()
    assert (computed < len(x) // 2).all()


TURNS = "conv_id long, turn long, role string, text string, turns string, segments int"


def test_chat_round_trip_and_machine(spark):
    nasty = ["### User: </turn>\n", "\\", "\\\\#", "</", "a<", "/turn>", "", "é🙂\n### Assistant: ", "\\/\\#", "< /turn>", ":"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate([*nasty, "end"])]
    rows += [(2, 0, "assistant", "too soon"), (3, 0, "user", None), (3, 1, "assistant", None), (4, 0, "to:ol\\#", "x"), (4, 1, None, "y"), (5, 0, "user", "q"), (5, 0, "user", "q"), (None, None, "user", "lost"), (6, 0, "system", "s"), (6, 1, "user", "u")]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS)
    out = {r.conv_id: r for r in chat.format_conversations(table).withColumn("back", chat.read_back(chat.F.col("formatted"))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in out[conv].back] == [(r[2] or "", r[3] or "") for r in mine]
        assert out[conv].formatted == "".join(s.text for s in out[conv].segments)
        assert out[conv].formatted.count("</turn>") == len(mine)
    assert {c: (r.valid, r.broken_at) for c, r in out.items()} == {1: (True, None), 2: (False, 0), 3: (True, None), 4: (False, 0), 5: (False, 1), None: (False, None), 6: (False, None)}
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table)).collect()}
    said = "".join(r[3] for r in rows if r[0] == 1 and r[2] == "assistant")
    assert got[1].loss_chars == len(said) and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


@pytest.mark.parametrize("template", [
    chat.Template("<|im_start|>", "\n", "<|im_end|>\n", {"system": "system", "user": "user", "assistant": "assistant"}),
    chat.Template("[INST]", "]: ", "[/INST].*+", {"user": "U (1)"}, ("user", "assistant")),
    chat.Template("((", "#", "</s>", {"assistant": "a.b"}),
    chat.Template(),
])
def test_chat_templates_are_reversible(spark, template):
    parts = [template.open, template.close, template.colon, template.open[0], template.close[:2], template.close[1:], "\\", "#", "\n", "]", "x", "$1", "(", "é🙂"]
    texts = [a + b + c for a in parts for b in parts for c in ("", "\\", template.close[0])]
    rows = [(k // 40, k % 40, ("user", "assistant", "system", template.colon + template.open, "@x\\")[k % 5], t) for k, t in enumerate(texts)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS)
    out = {r.conv_id: r for r in chat.format_conversations(table, template).withColumn("back", chat.read_back(chat.F.col("formatted"), template)).collect()}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in out[conv].back] == [r[2:] for r in mine]
        assert out[conv].formatted.count(template.close) == out[conv].formatted.count(template.open) == len(mine)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table, template), template).collect()}
    said = "".join(r[3] for r in rows if r[0] == 0 and r[2] in template.learned)
    assert got[0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} # </turn>") for i in range(4_000)] + [(2, 0, "user", "</#\\" * 100_000), (2, 1, "assistant", "word </turn> " * 50_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS))).collect()}
    for conv in (1, 2):
        turns = "".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == conv)
        assert got[conv].valid and got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()


@pytest.mark.parametrize("parts", [("#", ": ", "</turn>"), ("###", "", "</turn>"), ("###", ": ", "\n\n"), ("###", ": ", "<\\>")])
def test_chat_refuses_templates_that_cannot_be_read_back(parts):
    with pytest.raises(ValueError):
        chat.Template(*parts)


def test_chat_uses_no_python(spark):
    table = spark.createDataFrame([(1, 0, "user", "a", "c", 1)], TURNS)
    plan = chat.digests(chat.format_conversations(table))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(make, spark):
    rows = [*EDGES, *((100 + s, prose(s, 60)) for s in range(10)), (200, prose(3, 60)), (201, prose(3, 60) + " more"), (202, "Text before. " + spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").first().text)]
    docs, names = make(rows), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    kept, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, "/root/testdata/sf0.01")
        if name != names[-1]:
            assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), out.schema)
        ids[name] = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not {1, 2, 3, 10} & ids["language_id"] and {4, 5, 6, 7, 8} <= ids["language_id"]
    assert 7 not in ids["line_dedup"] and 6 in ids["line_dedup"]
    assert not {13, 201} & ids["minhash_near_dedup"] and 12 in ids["minhash_near_dedup"]
    assert 202 not in ids["benchmark_decontamination"] and {4, 100} <= ids["sentencepiece"] and PASSAGE


def test_pipeline_near_duplicates_by_text(make, spark):
    """No text is lost because its doc_id has another text, and one row of each group stays."""
    p, q = prose(60, 80), prose(61, 80)
    rows = [(1, p), (2, p), (2, q), (3, q + " word"), (4, prose(62, 40)), (4, prose(62, 40)), (None, prose(63, 40)), (None, prose(63, 40)), (None, p), (5, ""), (5, ""), (6, None), (7, " ")]
    out = corpus_pipeline.near_duplicates(spark, make(rows), "")
    assert out.columns == make(rows).columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, p), (2, q), (4, prose(62, 40)), (None, prose(63, 40)), (5, ""), (6, None), (7, " ")], key=repr)


@pytest.mark.parametrize("size", [0, 10**9])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, size):
    from relyframe.llm import components

    monkeypatch.setattr(components, "ONE_TASK", size)
    rng = np.random.default_rng(3)
    links = [*((i, i + 1) for i in range(100, 180)), *((int(a), int(b)) for a, b in rng.integers(200, 500, (250, 2))), (7, 9), (9, 8), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for ab in links for x in ab if ab[0] != ab[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_pipeline_empty(make, spark, stage):
    assert stage(spark, make([]), "/root/testdata/sf0.01").count() == 0
