"""Findings of the second advice: whole runs, limits, placeholders, rejections, nulls."""

import random
import zlib


import corpus_pipeline
import pyarrow as pa

from relyframe.llm import decontaminate, language_id, language_model, line_dedup, near_dup, queries
from tests.llm.conftest import prose


def runs_deleted(rows):
    """Lines in later maximal runs of 4 words or 3 lines, or of few words but in 20 documents; every pair of places is tried."""
    docs = {i: [(n, x.strip()) for n, x in enumerate(t.split("\n")) if x.strip()] for i, t in rows}
    places = {}
    for i in sorted(docs):
        for p, (_, x) in enumerate(docs[i]):
            places.setdefault(x, []).append((i, p))
    gone = {i: set() for i in docs}
    for x, at in places.items():
        many = len({i for i, _ in at}) >= 20
        for k, (j, q) in enumerate(at):
            for i, p in at[:k]:
                lo = hi = 0
                while min(p, q) - lo > 0 and docs[i][p - lo - 1][1] == docs[j][q - lo - 1][1]:
                    lo += 1
                while p + hi + 1 < len(docs[i]) and q + hi + 1 < len(docs[j]) and docs[i][p + hi + 1][1] == docs[j][q + hi + 1][1]:
                    hi += 1
                run = docs[j][q - lo : q + hi + 1]
                if many or len(run) >= 3 or sum(len(y.split()) for _, y in run) >= 4:
                    gone[j].add(docs[j][q][0])
    return {i: len(g) for i, g in gone.items()}


def test_single_and_short_lines_are_runs(make):
    r = random.Random(5)
    pool = ["One line of boilerplate words", "Share this", "Read more", "Next", "a b c", "So.", "Again and again we meet", "Yes", "No", "Top"]
    rows = [(i, "\n".join([prose(1000 + i, 5), *(r.choice([*pool, "", prose(r.randrange(10**6), 3)]) for _ in range(r.randint(0, 9)))])) for i in range(25)]
    rows += [(99, "Share this\nRead more"), (100, "Share this\nRead more"), (101, "One line of boilerplate words"), (102, "tail one two three\nx9\ny9"), (103, "tail one two three\nx9\ny9")]
    got = {x.doc_id: x.gone for x in line_dedup.dedup_lines(make(rows), count_as="gone").collect()}
    assert got == runs_deleted(rows) and got[101] == 1 and got[103] == 3 and got[100] == 2
    stage = {x.doc_id for x in corpus_pipeline.lines(None, make(rows), "").collect()}
    assert not {100, 101, 103} & stage and 102 in stage


def test_pipeline_links_from_80_percent(make):
    """Sets of 96 shingles that share 86: 81 % of their union."""
    words = [f"w{k}" for k in range(100)]
    a, b = " ".join(words), " ".join([*words[:20], "x", *words[21:60], "y", *words[61:]])
    rows = [(1, a), (2, b), (3, prose(77, 100))]
    assert {r.doc_id for r in near_dup.near_duplicates(make(rows), 85).filter("kept").collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(None, make(rows), "").collect()} == {1, 3}


def leaks(spark, make, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(make(list(enumerate(texts))), bench).collect()}


def test_verbatim_items_of_few_literals_are_found(make, spark):
    items = ["What is 12 times 7", "Convert 5 km to miles", "WHO WROTE THE BOOK OF THE DEAD", "12 + 7 - 3 * 4 / 2 = 13", "3 4 5 6 7 8 9 10 11 12 13 14 15"]
    texts = [f"{prose(90, 20)}. {item}. {prose(91, 20)}" for item in items]
    texts += [x.lower() for x in items] + ["What is 13 times 8", "Convert 6 km to miles", "4 4 5 6 7 8 9 9 11 12 12 14 15"]
    # Short items asked again with other values are leaks too; a list of other numbers is not.
    assert leaks(spark, make, items, texts) == {(i, i % 5) for i in range(10)} | {(10, 0), (11, 1)}


def test_items_in_scripts_without_spaces(make, spark):
    items = ["小明有12个苹果，他给了小红5个，现在还剩多少个苹果？", "東京は日本の首都です", "서울은한국의수도이다"]
    texts = [f"一些文字。{items[0]}其他的文字。", "小明有30个苹果，他给了小红8个，现在还剩多少个苹果？", f"前の文。{items[1]}。後の文。", f"앞 {items[2]} 뒤", "這是完全不同的一段文字，沒有任何題目。"]
    assert leaks(spark, make, items, texts) == {(0, 0), (1, 0), (2, 1), (3, 2)}


def test_items_asked_again_with_other_values(make, spark):
    items = [
        "Anna has 12 apples in a box. Anna gives 5 apples to her friend",
        "Mr. Olsen buys 12 apples and 7 pears at the market for Karla and walks 3 km home with his two little dogs and then Karla counts all of the fruit on the table",
        "A farmer keeps 3 cows and 4 goats in the old barn and sells 3 of them at the market before the winter",
    ]
    texts = [
        "Some words. Bob has 30 apples in a box. Bob gives 8 apples to her friend. The end",
        "Mr. Garcia buys 30 apples and 4 pears at the market for Anna van Dyke and walks 9 miles home with his two little dogs and then Anna van Dyke counts all of the fruit on the table",
        "A farmer keeps 5 cows and 5 goats in the old barn and sells 5 of them at the market before the winter",
        "Some words. Bob has 30 apples in a box. Carl gives 8 apples to her friend. The end",
        "A farmer keeps 5 cows and 6 goats in the old barn and sells 7 of them at the market before the winter",
    ]
    assert leaks(spark, make, items, texts) == {(0, 0), (1, 1), (2, 2)}


def test_unlearned_languages_and_gibberish_are_rejected(make, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    r = random.Random(1)
    polish = "Wczoraj wieczorem poszliśmy do kina, żeby zobaczyć nowy film, a potem długo rozmawialiśmy o tym, co się wydarzyło w naszym mieście. Nikt nie wiedział, dlaczego wszyscy sąsiedzi wyjechali tak nagle. "
    finnish = "Eilen illalla menimme elokuviin katsomaan uutta elokuvaa, ja sen jälkeen puhuimme pitkään siitä, mitä kaupungissamme oli tapahtunut. Kukaan ei tiennyt, miksi kaikki naapurit olivat lähteneet niin äkkiä. "
    turkish = "Dün akşam yeni filmi izlemek için sinemaya gittik ve sonra şehrimizde neler olduğunu uzun uzun konuştuk. Komşuların neden bu kadar ani ayrıldığını kimse bilmiyordu. "
    bad = [(polish * 3)[:512], (finnish * 3)[:512], (turkish * 4)[:512]]
    bad += [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (40, 80, 2000)]
    got = language_id.identify(make(list(enumerate([*bad, "one"]))), model).toPandas().set_index("doc_id").rejected
    assert got.loc[list(range(len(bad)))].all() and not got.loc[len(bad)]
    assert language_id.identify(docs, model).filter("rejected").count() == 0
    assert language_id.keep_identified(docs).count() == docs.count()


def test_shapes_of_ids_with_several_texts_do_not_overflow():
    """Two ids of several texts in one open bucket: any number of shared shingles is possible."""
    fields = [("rep", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("shape", pa.list_(pa.int32())), ("hub", pa.bool_())]
    rows = [{"rep": r, "component": r, "n": 5, "own": 0, "shape": [1 << 20] * 64, "hub": r == 1} for r in (1, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(pa.struct(fields)))], ["rows"])
    assert [b.to_pydict() for b in near_dup._possible(iter([batch]), 85)] == [{"a": [1], "b": [2]}]


def test_weights_are_learned_from_all_training_documents(make, monkeypatch):
    rows = [(i, prose(i, 30)) for i in range(12)]
    seen, fit = [], language_model.fit_weights
    monkeypatch.setattr(language_model, "fit_weights", lambda cells, n, v: seen.append(n.sum()) or fit(cells, n, v))
    language_model.score_documents(make(rows)).collect()
    assert seen == [31 * sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)]


def test_licence_query_with_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, "s", "Released under the MIT License."), (1, "s", "x")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "http://a/b", "<p>All rights reserved.</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.kind, r.id) for r in queries.op6_license_scan(spark, str(tmp_path)).collect()}
    assert got == {("doc", None), ("doc", 1), ("page", None)}
