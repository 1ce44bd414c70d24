"""Periodic runs of words: Lyndon arrays by Baier's grouping, roots extended by longest common extensions.

The first phase of Baier's suffix sorter groups suffixes by their longest
Lyndon prefix: groups are taken in descending order, and the positions left of
a group's members take them in, by which their Lyndon prefix grows. The lengths
of these prefixes are the Lyndon array. Every run has, under the order of
symbols or its reverse, a root that is the longest Lyndon prefix at its places;
so the two arrays name all periods that need to be looked at, and each is
extended both ways by binary search over hashes of spans.

Stretches that cannot hold a run are left out first, by an exact bound: a run
of at least four periods and six words holds each of its word triples three
times.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relyframe.llm.text import U64, mix, powers, shingles, trim, words

MIN_WORDS, MIN_PERIODS = 6, 4
_TRIPLE = 3

RUNS = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "starts array<long>, lengths array<long>, periods array<long>, text string"
)


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place of ``symbols``, whose end counts as smaller than any symbol."""
    n = len(symbols)
    ordered = sorted(set(symbols))
    rank = {s: g for g, s in enumerate(ordered)}
    group = [rank[s] for s in symbols]
    members: list[set[int]] = [set() for _ in ordered]
    for i, g in enumerate(group):
        members[g].add(i)
    context = [1] * len(ordered)
    # Groups as a list linked downwards; new ones stand right above the group they leave.
    below = list(range(-1, len(ordered) - 1))
    above = [g + 1 for g in range(len(ordered))]
    above[-1:] = [-1]
    lyndon = [0] * n
    # The nearest place at or left of each that is in a group still to come, counted from 1.
    left = list(range(n + 1))
    top = len(ordered) - 1
    while top >= 0:
        size = context[top]
        mine = members[top]
        for i in mine:
            lyndon[i] = size
            left[i + 1] = i
        seen: dict[int, int] = {}
        for i in mine:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            if j:
                seen[j - 1] = seen.get(j - 1, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for j, k in seen.items():
            moves.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(moves, reverse=True):
            for g, those in moves[k].items():
                fresh = len(members)
                members.append(set(those))
                members[g].difference_update(those)
                context.append(context[g] + k * size)
                up = above[g]
                below.append(g)
                above.append(up)
                above[g] = fresh
                if up >= 0:
                    below[up] = fresh
                for j in those:
                    group[j] = fresh
        members[top] = set()
        # Groups that this one made stand below it, so the next is right under it.
        top = below[top]
    return lyndon


def _split(row: np.ndarray, h: np.ndarray, at: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``at`` (ascending) and their segments, without those that no run can hold."""
    while len(at):
        # Triples inside one segment, and how often each occurs there.
        n = len(at) - _TRIPLE + 1
        if n <= 0:
            return at[:0], segment[:0]
        gram = shingles(h[at], _TRIPLE)
        inside = segment[:n] == segment[_TRIPLE - 1 :]
        key = mix(gram ^ mix(segment[:n].astype(U64)))
        _, which, many = np.unique(key, return_inverse=True, return_counts=True)
        active = np.flatnonzero(inside & (many[which] >= MIN_PERIODS - 1))
        if not len(active):
            return at[:0], segment[:0]
        head = np.flatnonzero((np.diff(active, prepend=-2) != 1) | (np.diff(segment[active], prepend=-1) != 0))
        first = active[head]
        last = active[np.append(head[1:], len(active)) - 1] + _TRIPLE
        wide = last - first >= MIN_WORDS
        first, last = first[wide], last[wide]
        size = last - first
        keep = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # Neighbouring stretches may share words at their ends, so lengths tell whether anything changed.
        stable = len(keep) == len(at)
        at, segment = at[keep], np.repeat(np.arange(len(size)), size)
        if stable:
            return at, segment
    return at, segment


class Spans:
    """Equality of spans of an array of hashes by their own hashes."""

    def __init__(self, h: np.ndarray):
        up, self.down = powers(len(h) + 1)
        self.total = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h) * up[: len(h)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of places a and b, at most ``most``."""
        lo, hi = np.zeros(len(a), np.int64), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.of(a, a + mid) == self.of(b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same to the left: of what ends before a and before b."""
        lo, hi = np.zeros(len(a), np.int64), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.of(a - mid, a) == self.of(b - mid, b)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


def find_runs(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows (place, length, period) of all runs of a piece; ``row`` names the text of each word hash."""
    at, segment = _split(row, h, np.arange(len(h)), row)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # Segments one after another, each closed by the symbol 0, below all others in both orders.
    gap = np.concatenate(([0], np.cumsum(np.diff(segment) != 0)))
    slot = np.arange(len(at)) + gap
    n = int(slot[-1]) + 2
    _, rank = np.unique(h[at], return_inverse=True)
    text = np.zeros(n, U64)
    text[slot] = h[at]
    ends = np.append(slot[np.flatnonzero(np.diff(segment))], slot[-1]) + 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans, found = Spans(text), []
    for symbol in (rank + 1, rank.max() + 1 - rank):
        line = np.zeros(n, np.int64)
        line[slot] = symbol
        lyndon = np.array(lyndon_array(line.tolist()), np.int64)
        i = np.flatnonzero(line > 0)
        p = lyndon[i]
        near = i + p < n
        i, p = i[near], p[near]
        # Four periods hold three roots in a row.
        i, p = (x[lyndon[i + p] == p] for x in (i, p))
        here = np.searchsorted(ends, i)
        right = spans.forward(i, i + p, ends[here] - i - p)
        left = spans.backward(i, i + p, i - begins[here])
        found.append(np.stack([i - left, left + p + right, p], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[(runs[:, 1] >= MIN_WORDS) & (runs[:, 1] >= MIN_PERIODS * runs[:, 2])]
    place = np.zeros(n, np.int64)
    place[slot] = at
    runs[:, 0] = place[runs[:, 0]]
    # Stretches that overlap hold a run at most once each.
    return np.unique(runs, axis=0)


def planted(doc_id: int, n: int) -> tuple[int, int] | None:
    """For a tenth of the ids, where a text of n words starts to repeat and with which period."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _repeated(ids: list, w) -> np.ndarray:
    """Indexes of a piece's words after the words of the chosen ids are made periodic."""
    index = np.arange(len(w.hash))
    upto = np.concatenate(([0], np.cumsum(w.per_row())))
    for r in range(w.count):
        i = ids[w.first + r]
        plan = planted(i, int(upto[r + 1] - upto[r])) if i is not None else None
        if plan:
            a, p = plan
            index[upto[r] + a : upto[r + 1]] = upto[r] + a + np.arange(upto[r + 1] - upto[r] - a) % p
    return index


def _collapse(batches: Iterator[pa.RecordBatch], repeat: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for w in words(batch.column(1)):
            index = _repeated(ids, w) if repeat else np.arange(len(w.hash))
            runs = find_runs(w.row, w.hash[index])
            upto = np.concatenate(([0], np.cumsum(w.per_row())))
            of = w.row[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
            drop = np.zeros(len(index) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(drop[:-1]) == 0
            raw = w.bytes.tobytes()
            rows = []
            cut = np.searchsorted(of, np.arange(w.count + 1))
            for r in range(w.count):
                a, z = int(upto[r]), int(upto[r + 1])
                mine = runs[cut[r] : cut[r + 1]]
                start, length, period = mine[:, 0] - a, mine[:, 1], mine[:, 2]
                use = index[a:z][kept[a:z]]
                text = b" ".join([raw[s:e] for s, e in zip(w.start[use].tolist(), w.end[use].tolist(), strict=True)])
                best = np.lexsort((period, start, -length))[:1]
                top = [int(x[best[0]]) if len(best) else None for x in (start, length, period)]
                rows.append((ids[w.first + r], z - a, len(mine), *top, 1000 * top[1] // top[2] if top[0] is not None else None, start.tolist(), length.tolist(), period.tolist(), text.decode()))
            yield pa.RecordBatch.from_pydict(dict(zip(COLUMNS, map(list, zip(*rows, strict=True)), strict=True)), schema=_SCHEMA)
        trim()


COLUMNS = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "starts", "lengths", "periods", "text"]
_SCHEMA = pa.schema([(c, pa.list_(pa.int64()) if c in ("starts", "lengths", "periods") else pa.string() if c == "text" else pa.int64()) for c in COLUMNS])


def periodic_runs(docs: DataFrame, repeat: bool = False) -> DataFrame:
    """One row per document (RUNS): its runs by start and period, the longest of them, and its words without repetitions.

    Words are numbered from 0. A run is a stretch of at least MIN_WORDS words
    and MIN_PERIODS of its smallest period that no neighbouring word extends; of
    each run the words after its first period are dropped. The longest run is
    the one that starts first among equals, then that of the smallest period. A
    null or blank text has no words, no runs and the empty text. Rows with one
    doc_id are documents of their own, and so are rows with a null doc_id.
    ``repeat`` first makes the words of the ids that ``planted`` names periodic;
    it plants nothing in rows with a null doc_id.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _collapse(batches, repeat), RUNS)
