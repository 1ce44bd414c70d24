"""Every operator on documents: nulls, blanks, very long texts, repeated rows, shared ids, clashing columns, empty tables; then brute force."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from relyframe.llm import decontaminate, language_id, language_model, licenses, line_dedup, near_dup, sentencepiece_codec, substring
from tests.llm.conftest import EDGES, LONG, PASSAGE, prose

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(seed, n_words, n_copies, edits):
    import random

    r = random.Random(seed)
    base = prose(seed, n_words).split()
    for _ in range(n_copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(n_words)] = f"edit{r.randrange(10**6)}"
        yield " ".join(w)


def components_of(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {i: find(i) for i in parent}


def test_near_duplicates_edges(make):
    got = near_dup.near_duplicates(make(EDGES)).toPandas()
    assert len(got) == len(EDGES)
    by = got[got.doc_id.notna()].drop_duplicates("doc_id").set_index("doc_id")
    want = components_of([e for e in EDGES if e[0] is not None])
    assert {int(k): int(v) for k, v in by.component_id.items()} == want
    assert by.loc[[1, 2, 3], "n_shingles"].tolist() == [0, 0, 0] and by.loc[4, "n_shingles"] == 1
    assert got[got.doc_id.isna()][["n_shingles", "kept"]].values.tolist() == [[len(shingle_set(PASSAGE)), True]]


def test_near_duplicates_brute_force(make):
    rows = list(enumerate([*near_copies(5, 90, 40, 6), *near_copies(6, 30, 15, 1), *near_copies(7, 12, 10, 1), *(prose(s, 40) for s in range(20))]))
    got = near_dup.near_duplicates(make(rows)).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == components_of(rows)
    assert (got.kept == (got.doc_id == got.component_id)).all()


@pytest.mark.parametrize(("hubs", "blocks"), [(64, (4_096, 1_024)), (2, (5, 3))])
def test_near_duplicates_in_hot_buckets(make, monkeypatch, hubs, blocks):
    """Large groups of copies that one star does not link: further rounds of hubs, in blocks, lose no link."""
    import random

    monkeypatch.setattr(near_dup, "FIRST_HUBS", hubs)
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", blocks[0])
    monkeypatch.setattr(near_dup, "BLOCK_HUBS", blocks[1])
    r, rows = random.Random(11), []
    for g in range(3):
        # Drifting versions: neighbours are near, the ends of a chain are not.
        w = prose(70 + g, 160).split()
        for k in range(60):
            if k % 2:
                w[r.randrange(len(w))] = f"drift{r.randrange(10**6)}"
            rows.append((1_000 * g + k, " ".join(w)))
    got = near_dup.near_duplicates(make(rows)).toPandas()
    want = components_of(rows)
    assert dict(zip(got.doc_id, got.component_id)) == want and 3 <= len(set(want.values())) < 60


def test_densify_keeps_values_and_fills():
    sets = [np.unique(np.random.default_rng(s).integers(1, 2**63, n, dtype=np.uint64)) for s, n in enumerate((1, 2, 7, 5000))]
    bins = np.full((4, near_dup.BINS), near_dup._FULL, np.uint64)
    for row, s in zip(bins, sets):
        np.minimum.at(row, (s % np.uint64(near_dup.BINS)).astype(int), s)
    before = bins.copy()
    near_dup.densify(bins)
    assert (bins != near_dup._FULL).all() and (bins[before != near_dup._FULL] == before[before != near_dup._FULL]).all()


def test_line_dedup(make):
    run = ["first shared line", "second shared line", "third shared line"]
    wide = prose(9, 45)
    rows = [
        *EDGES, (20, "\n".join(["own a", *run, "own b"])), (21, "\n".join(["own c", " " + run[0], "", *run[1:], "own d"])), (22, "\n".join(run[:2])),
        (23, wide + "\nx"), (24, "y\n" + wide), (25, "\n".join([*run, *run])),
    ]
    out = line_dedup.dedup_lines(make(rows), count_as="gone")
    assert out.columns == make(rows).columns + ["gone"]
    got = {(r.doc_id, r.text): r.gone for r in out.collect()}
    assert got[(20, "\n".join(["own a", *run, "own b"]))] == 0 and got[(21, "own c\n\nown d")] == 3 and got[(22, "")] == 2
    assert got[(23, wide + "\nx")] == 0 and got[(24, "y")] == 1 and got[(25, "")] == 6
    assert got[(6, PASSAGE)] == 0 and got[(7, "")] == 1 and got[(None, PASSAGE)] == 0 and got[(1, None)] == 0 and out.count() == len(rows)


def test_substring_edges_and_brute_force(make):
    mixed = " ".join([prose(31, 30), PASSAGE, prose(32, 15)])
    rows = [*EDGES, (30, mixed), (31, " ".join([prose(31, 30)[:80], " ".join(PASSAGE.split()[5:40]), "tail"])), (32, "la " * 90), (33, "la " * 25)]
    got = substring.remove_repeats(make(rows)).toPandas()
    assert len(got) == len(rows)
    seen, want = {}, {}
    for i, t in sorted((r for r in dict.fromkeys(rows) if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            seen[k] = min(seen.get(k, (i, p)), (i, p))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - 19) if i is not None else ():
            if seen[tuple(w[p : p + 20])] < (i, p):
                gone.update(range(p, p + 20))
        want.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(b" ".join(x for q, x in enumerate(w) if q not in gone)).hexdigest()))
    have = {}
    for r in got.itertuples():
        have.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_language_model(make):
    rows = [*EDGES, *((100 + s, prose(s, 80)) for s in range(60))]
    got = language_model.score_documents(make(rows)).toPandas()
    assert len(got) == len(rows)
    tokens = [(i, [*(t or "").encode().translate(LOWER).split(), None]) for i, t in rows]
    train = [t for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    assert set(got.train_tokens) == {n}
    base = sorted(round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6) for _, t in tokens)
    assert np.allclose(sorted(got.base_score), base, rtol=1e-9, atol=1e-5)
    assert sorted(got.n_known) == sorted(sum(c[x] > 0 for x in t) for _, t in tokens)
    assert (got.score < 0).all() and got.score.notna().all()


def test_language_model_sums_to_one():
    """Bigram, unigram and uniform parts each sum to one over the vocabulary and one unknown word."""
    rng = np.random.default_rng(3)
    text = rng.integers(0, 6, 400)
    c1, c2 = Counter(text.tolist()), Counter(zip(text.tolist(), text[1:].tolist()))
    ctx = Counter(text[:-1].tolist())
    cells = np.array([(3 << 16) | (2 << 8) | 4, (3 << 16) | (language_model._NONE << 8) | 6, (2 << 16) | (5 << 8) | language_model._NONE])
    lam = language_model.fit_weights(cells, np.array([50.0, 10.0, 5.0]), 6)
    assert np.allclose(lam.sum(axis=1), 1) and (lam[0, 0] == 0) and (lam[:, 2] > 0).all()
    for h in c1:
        w = lam[1 + int(math.log2(ctx[h]))]
        p = sum(w[0] * c2[h, x] / ctx[h] + w[1] * c1[x] / len(text) + w[2] / 7 for x in c1) + w[2] / 7
        assert abs(p - 1) < 1e-9


def test_language_id(make, spark):
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = language_id.identify(make(EDGES), model).toPandas()
    assert len(got) == len(EDGES)
    by = got[got.doc_id.notna()].drop_duplicates("doc_id").set_index("doc_id")
    assert (by.loc[[1, 2, 3, 10], "lang_pred"] == "und").all() and by.loc[[1, 2, 3, 10], "rejected"].all() and (by.loc[[1, 2, 3, 10], "score"] == 0).all()
    assert by.loc[[4, 5, 12], "lang_pred"].isin(["en", "de", "fr", "es"]).all() and got.score.between(0, 1).all()
    held = language_id.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model).filter("held_out").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = held.merge(lang, on="doc_id")
    assert (both.lang == both.lang_pred).mean() >= 0.98 and not both.rejected.any()


def test_sentencepiece(make, spark):
    got = sentencepiece_codec.encode_documents(make(EDGES), with_ids=True).toPandas()
    assert len(got) == len(EDGES) and got.parity.all() and got.round_trip.all()
    assert (got.n_tokens == got.ids.map(len)).all() and got[got.doc_id == 1].n_tokens.tolist() == [0]


def test_sentencepiece_words_give_whole_texts(monkeypatch):
    """Ids put together from words are those that sentencepiece gives for whole texts."""
    own = sentencepiece_codec.Codec(open(sentencepiece_codec.MODEL, "rb").read())
    texts = [*(t or "" for _, t in EDGES), "  a  b\n\tc ", "<s> </s> <unk> <0x0A> x", " ", "   ", "é́ \x00 z", "a▁b ▁ c", "ends in space ", "a\n\n b \n", "\n", "\nword\n word\r\nword"]
    for room in (1 << 24, 200, 0):
        monkeypatch.setattr(sentencepiece_codec, "KNOWN_BYTES", room)
        ids = own.encode(texts)
        assert own.by_word and [x.tolist() for x in ids] == own.judge.encode(texts, num_threads=1) and all(own.parity(texts, ids))
        assert all(own.decode(x) == t for x, t in zip(ids, texts) if "▁" not in t)


def test_parity_compares_whole_texts():
    """A normaliser that changes texts must show in the parity."""
    own = sentencepiece_codec.Codec(open(sentencepiece_codec.MODEL, "rb").read())
    plain = own.normalized
    own.normalized = lambda t: plain(t).lower().replace("x", "y")
    texts = ["Upper Case", "an x here", "unchanged words"]
    assert own.parity(texts, own.encode(texts)) == [False, False, True]


def test_sentencepiece_unigram_model(tmp_path):
    """A hand-written unigram model: normaliser with trimming, scores and byte fallback agree with sentencepiece."""

    def field(number, wire, data):
        key = bytes([number << 3 | wire]) if number < 16 else bytes([(number << 3 | wire) & 127 | 128, number >> 4])
        return key + (bytes([len(data)]) + data if wire == 2 else data)

    import struct

    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    entries += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("▁ab", -5.0, 1), ("ab", -6.0, 1), ("ba", -5.5, 1), ("▁aba", -7.0, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))) for p, s, t in entries)
    data += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x01") + field(5, 0, b"\x01"))
    own = sentencepiece_codec.Codec(data)
    texts = ["aba ba", "  abab   aba ", "", "é a", "b", "zab"]
    ids = own.encode(texts)
    assert all(own.parity(texts, ids)) and own.decode(ids[0]) == "aba ba" and own.decode(ids[3]) == "é a"


def test_decontamination(make, spark):
    item = "Mr. Olsen buys 12 apples and 7 pears at the market for Karla and walks 3 km home with Karla before noon"
    asked_again = "Mr. Garcia buys 30 apples and 4 pears at the market for Britta and walks 9 miles home with Britta before noon"
    other_slots = "Mr. Garcia buys 30 apples and 4 pears at the market for Britta and walks 9 miles home with Svenja before noon"
    rows = [*EDGES, (50, f"{prose(40, 30)}. {item}. {prose(41, 30)}"), (51, f"Intro words here.\n{asked_again}."), (52, f"Intro words here.\n{other_slots}."), (53, prose(42, 60)), (54, "what is two plus two")]
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, ""), (4, "What is two plus two"), (5, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(make(rows), bench).collect()}
    assert {k for k in got if k[1] == 1} == {(50, 1), (51, 1)} and (54, 4) in got and len(got) == 3
    assert got[(51, 1)].slots > 0 and got[(51, 1)].consistent
    left = decontaminate.drop_contaminated(make(rows), bench)
    assert left.columns == make(rows).columns and left.count() == len(rows) - 3
    assert decontaminate.contaminated(make(rows), bench.limit(0)).count() == 0


def test_decontamination_is_exact_on_verbatim_items(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    texts, items = docs.select("doc_id", "text").collect(), bench.collect()
    assert got == {(d.doc_id, i.item_id) for d in texts for i in items if i.text in d.text}


def test_licences(spark):
    rows = [
        ("f1", "repo/a/b/x.py", "import os\n# Licensed under the Apache License, Version 2.0.\n"), ("f2", "repo/a/b/y.py", "nothing here"), ("f3", "repo/a/LICENSE", "Released under the MIT License."),
        ("f4", "repo/a/c/d/z.py", None), ("f5", "other/q.py", ""), ("f6", None, "All rights reserved."), ("f2", "repo/a/b/y.py", "nothing here"), ("f7", "repo/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("f8", "repo/e/r.py", LONG), ("f9", "repo/a/w.py", "a licence is a fine thing to have when nobody asks for it at the door"),
    ]
    got = {r.file: (r.licence, r.origin) for r in licenses.scan_licences(spark.createDataFrame(rows, "file string, path string, text string")).collect()}
    assert got == {
        "f1": ("Apache-2.0", "own"), "f2": ("MIT", "inherited"), "f3": ("MIT", "own"), "f4": ("MIT", "inherited"), "f5": (None, None), "f6": ("proprietary", "own"), "f7": ("GPL-3.0", "own"),
        "f8": ("GPL-3.0", "inherited"), "f9": ("MIT", "inherited"),
    }


def test_licences_stated_and_told_apart(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    third = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [
        ("a", "a.py", "# SPDX-License-Identifier: MIT\n"), ("b", "b.py", "// SPDX-License-Identifier: Apache-2.0\n// Released under the MIT License"), ("c", "c.c", "/* SPDX-License-Identifier: GPL-2.0-only */"),
        ("d", "u/UNLICENSE", "This is free and unencumbered software released into the public domain."), ("e", "x/LICENSE", f"{bsd}\n1. one\n2. two"), ("f", "y/LICENSE", f"{bsd}\n1. one\n2. two\n3. {third}"), ("g", "y/z.py", "code"),
    ]
    got = {r.file: (r.licence, r.origin) for r in licenses.scan_licences(spark.createDataFrame(rows, "file string, path string, text string")).collect()}
    assert got == {
        "a": ("MIT", "own"), "b": ("Apache-2.0", "own"), "c": ("GPL-2.0-only", "own"), "d": ("Unlicense", "own"), "e": ("BSD-2-Clause", "own"), "f": ("BSD-3-Clause", "own"), "g": ("BSD-3-Clause", "inherited"),
    }


@pytest.mark.parametrize("op", [
    near_dup.near_duplicates, line_dedup.dedup_lines, substring.remove_repeats, language_model.score_documents, language_id.identify, language_id.keep_identified,
    sentencepiece_codec.encode_documents, lambda d: licenses.scan_licences(d.selectExpr("source AS file", "source AS path", "text")),
    lambda d: decontaminate.contaminated(d, d.selectExpr("doc_id AS item_id", "text")),
])
def test_empty_table(make, op):
    assert op(make([])).count() == 0
