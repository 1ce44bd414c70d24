"""Spelling variants, periodic runs and SimHash against brute force, with nulls, blanks, long texts, repeated rows, clashing columns and hot groups."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from relyframe.llm import periods, simhash, spelling
from relyframe.llm.text import words
from tests.llm.conftest import EDGES, LONG, PASSAGE, prose

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def letter_runs(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
            run += c.lower() if c.isascii() else c
        elif run:
            out.append(run)
            run = ""
    return out


def variants(rows, every):
    n = Counter()
    for i, t in rows:
        for run in letter_runs(t):
            h = zlib.crc32(f"{i}:{run}".encode())
            if every and i is not None and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelt(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_edges(make):
    rows = [*EDGES, (20, "x" * 100_000 + " " + "x" * 99_999), (21, ("x" * 100_000 + " ") * 3), (22, ("x" * 99_999 + " ") * 2), (23, "Élévé élévé éléve ÉLÉVÉ " * 5), (24, "caf×÷s caf×÷ " * 4)]
    for every in (0, 7):
        assert spelt(spelling.spelling_variants(make(rows), delete_every=every)) == variants(rows, every)
    assert spelling.spelling_variants(make([])).count() == 0


@pytest.mark.parametrize(("frequent", "most"), [(5_000, 4_096), (40, 12), (3, 2)])
def test_spelling_brute_force_with_hot_lists(make, frequent, most):
    r = random.Random(4)
    base = ["".join(r.choice("abst") for _ in range(r.randint(5, 9))) for _ in range(60)]
    words_ = []
    for w in base:
        for _ in range(6):
            k = r.randrange(len(w))
            words_ += [r.choice((w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]))] * r.randint(3, 9)
        words_ += [w] * r.randint(3, 30)
    r.shuffle(words_)
    rows = [(i, " ".join(words_[i::20])) for i in range(20)]
    assert spelt(spelling.spelling_variants(make(rows), frequent=frequent, most=most)) == variants(rows, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=5, max_size=9), min_size=2, max_size=12, unique=True), st.integers(1, 30))
def test_bound_of_affected_grams_holds(held, frequent):
    count = Counter(p[i : i + q] for p in map(spelling.padded, held) for q in (2, 3, 4) for i in range(len(p) - q + 1))
    places = sum(n for g, n in count.items() if len(g) == 2)
    kept = [g for g in count if all(count[g[:k]] > places / frequent for k in range(2, len(g)))]
    grams = spelling.Grams(sorted(kept))
    parts = {w: [spelling.padded(w)[a : b + 1] for a, b in grams.decompose(spelling.padded(w))] for w in held}
    for a, b in itertools.permutations(held, 2):
        if is_near(a, b):
            p = spelling.padded(a)
            bound = grams.affected(p, grams.decompose(p))
            assert len(set(parts[a]) & set(parts[b])) >= len(set(parts[a])) - bound


def runs_of(w):
    """All runs of at least 6 words and 4 periods, by trying every period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(doc_id, text, repeat):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if repeat and doc_id is not None and w and h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_of(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return len(w), len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], runs, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def test_periods_edges_and_brute_force(make):
    r = random.Random(9)
    small = [(100 + k, " ".join(r.choice("ab") for _ in range(r.randint(5, 60)))) for k in range(80)]
    nested = [(300, "a b " * 5 + "c " + ("x y z " + "q " * 9) * 6), (301, "one two three " * 500), (302, "a a a b " * 7 + "b " * 8 + "a a a b " * 2)]
    rows = [*(e for e in EDGES if e[1] != LONG), (5, prose(1, 3_000)), *small, *nested]
    for repeat in (False, True):
        got = periods.periodic_runs(make(rows), repeat).collect()
        have = [(r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, list(zip(r.starts, r.lengths, r.periods)), r.text) for r in got]
        assert sorted(have, key=repr) == sorted(((i, *periodic(i, t, repeat)) for i, t in rows), key=repr)
    assert periods.periodic_runs(make([])).count() == 0


def test_periods_very_long_text(make):
    got = periods.periodic_runs(make([(1, LONG + " again and again" * 5_000)])).first()
    assert (got.n_runs, got.length, got.period) == (1, 10_000, 2) if LONG.endswith("again") else got.n_runs == 1
    assert got.text.split()[-2:] == ["again", "and"] or got.text.split()[-1] == "again"


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=24))
def test_lyndon_array(s):
    line = [ord(c) for c in s]
    want = [max(n for n in range(1, len(s) - i + 1) if all(s[i : i + n] < s[i + k : i + n] for k in range(1, n))) for i in range(len(s))]
    assert periods.lyndon_array(line) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=60))
def test_runs_of_a_piece(s):
    text = " ".join(s)
    piece = next(words(pa.array([text])))
    assert [tuple(x) for x in periods.find_runs(piece.row, piece.hash).tolist()] == runs_of(list(s))


def print_of(text):
    w = (text or "").encode().translate(LOWER).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_edges(make):
    rows = [e for e in EDGES if e[1] != LONG] + [(30, "Same THREE words"), (31, "same three  words"), (32, None), (33, "two words")]
    got = simhash.near_duplicates(make(rows)).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got if r.doc_id is not None) == sorted((i, f"{print_of(t):016x}") for i, t in rows if i is not None)
    one = {r.doc_id: r.component_id for r in got}
    # Null and blank texts share the fingerprint zero; both texts of document 8 hang together, and with the copy of one.
    assert [one[i] for i in (1, 2, 3, 32)] == [1] * 4 and one[7] == one[6] == 6 and one[9] == one[8] == 8 and one[31] == 30
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.fingerprint(LONG.encode()) == print_of(LONG)


@pytest.mark.parametrize("group", [8192, 40])
def test_links_by_planes_with_hot_buckets(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(group)
    values = {0, 1, (1 << 64) - 1}
    for _ in range(12):
        base = r.getrandbits(64)
        values |= {base ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 5))}) for _ in range(60)}
    # A hot bucket: one part of the bits is the same for many.
    values |= {(7 << 43) | r.getrandbits(21) for _ in range(300)}
    values = sorted(values)
    rows = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    at = {simhash.signed(v): v for v in values}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash.near_links(rows).collect():
        parent[find(at[a])] = find(at[b])
    got = {v: find(v) for v in values}
    parent = {v: v for v in values}
    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    groups = lambda f: sorted(sorted(v for v in values if f[v] == x) for x in set(f.values()))
    assert groups(got) == groups({v: find(v) for v in values})


def test_simhash_near_copies(make):
    base = prose(41, 400).split()
    rows = [(k, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(0, 400, 40)] + [(1000 + s, prose(s, 60)) for s in range(10)] + [(7, PASSAGE), (8, PASSAGE)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make(rows)).collect()}
    prints = {i: print_of(t) for i, t in rows}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_checksums_of_spans():
    text = ("héllo wörld " + "y" * 200 + " the of a b").encode()
    b = np.frombuffer(text, np.uint8)
    start, end = spelling._runs(b, np.array([0, len(b)]))
    state = np.full(len(start), zlib.crc32(b"12:"), np.uint32)
    assert spelling._checksums(b, start, end, state).tolist() == [zlib.crc32(b"12:" + text[s:e]) for s, e in zip(start, end)]
