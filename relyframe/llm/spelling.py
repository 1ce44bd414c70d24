"""Spelling variants of frequent words by a variable-length gram index.

Grams of GRAM_MIN to GRAM_MAX code points are counted over all words; one that
is frequent is extended, one that is not stays as it is, so the dictionary is
pruned by frequency and bounded by the alphabet. A word, padded at both ends, is
decomposed into the longest dictionary grams at its places, without those that
an earlier gram contains. For each word a bound tells how many of its grams one
edit can affect; two near words share all others, so they meet in a list of one
of their rarest grams, one more than the bound. Lists are merged by the place of
the gram (equal from the start or from the end) and by length, and what meets is
verified. A list of more than LIST words is divided by place, length and a
second common gram, and what is then still long by pairs of word blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.llm.store import stored
from relyframe.llm.text import _SYMBOL, LOWER, buffers, pieces, span_hash, trim

DELETE_EVERY = 97
MIN_LETTERS, MIN_COUNT, FORM_RATIO = 5, 3, 2
GRAM_MIN, GRAM_MAX = 2, 4
PAD = GRAM_MAX - 1
# A gram is frequent when it holds more than one in so many places: at most 5,000 grams of a length are,
# and the dictionary has at most 92^2 + 2 * 92 * 5,000 entries with 90 letters and two pads.
FREQUENT = 5_000
# Words of a list that are merged in one piece.
LIST = 4_096
BEGIN, END = "\x01", "\x02"
_PAIRS = 1 << 19
_WIDE = 24
# The checksum's table by one byte, from the checksum of that byte alone.
_TABLE = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _runs(b: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal letter runs of UTF-8 bytes; letters beyond ASCII are 0xC3 and the byte after it."""
    lead = b == 0xC3
    letter = _LETTER[b] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(b) + 1, bool)
    edge[cut] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~letter[:-1]
    after[:-1] |= ~letter[1:]
    return np.flatnonzero(letter & before), np.flatnonzero(letter & after) + 1


def _checksums(b: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from the checksum ``state`` of what stands before it."""
    out = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(start - end, kind="stable")
    size = (end - start)[order]
    short = int(np.searchsorted(-size, -64))
    for i in order[:short]:
        out[i] = zlib.crc32(b[start[i] : end[i]].tobytes(), int(state[i])) ^ 0xFFFFFFFF
    order, size = order[short:], size[short:]
    crc, first = out[order], start[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))
        crc[:n] = _TABLE[(crc[:n] ^ b[first[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out[order] = crc
    return out ^ np.uint32(0xFFFFFFFF)


def _count(batches: Iterator[pa.RecordBatch], delete_every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, offsets = buffers(batch.column(1))
        for lo, hi in pieces(offsets):
            base = offsets[lo]
            b = LOWER[data[base : offsets[hi]]]
            cut = offsets[lo : hi + 1] - base
            start, end = _runs(b, cut)
            if not len(start):
                continue
            row = np.searchsorted(cut, start, side="right") - 1
            change = np.zeros(len(start), bool)
            if delete_every:
                named = np.array([i is not None for i in ids[lo:hi]])
                state = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[lo:hi]], np.uint32)
                h = _checksums(b, start, end, state[row])
                change = named[row] & (h % delete_every == 0)
            key = span_hash(_SYMBOL[b], start, end)
            found: Counter[str] = Counter()
            raw = b.tobytes()
            _, at, many = np.unique(key[~change], return_index=True, return_counts=True)
            s, e = start[~change][at], end[~change][at]
            for x, z, n in zip(s.tolist(), e.tolist(), many.tolist(), strict=True):
                found[raw[x:z].decode()] += n
            for i in np.flatnonzero(change):
                word = raw[start[i] : end[i]].decode()
                j = int(h[i]) % len(word)
                found[word[:j] + word[j + 1 :]] += 1
            kept = [(w, n) for w, n in found.items() if len(w) >= MIN_LETTERS]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])
    trim()


def word_counts(docs: DataFrame, delete_every: int = 0) -> DataFrame:
    """Rows (word, n), stored: letter runs of at least MIN_LETTERS that occur MIN_COUNT times, A-Z lower-cased.

    ``delete_every`` takes one code point out of the runs whose crc32, with the
    doc_id before it, it divides; none from rows with a null doc_id.
    """
    found = docs.select("doc_id", "text").mapInArrow(lambda batches: _count(batches, delete_every), "word string, n long")
    return stored(found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT), "words")


def padded(word: str) -> str:
    return BEGIN * PAD + word + END * PAD


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: Counter[str] = Counter()
        for i, word in enumerate(batch.column(0).to_pylist()):
            p = padded(word)
            for q in range(GRAM_MIN, GRAM_MAX + 1):
                held.update([p[j : j + q] for j in range(len(p) - q + 1)])
            if len(held) > 100_000 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])
                held = Counter()


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT) -> list[str]:
    """The grams of the dictionary, rarest first; its size is bounded by the alphabet and ``frequent``."""
    grams = stored(words.select("word").mapInArrow(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    places = grams.filter(F.length("gram") == GRAM_MIN).agg(F.sum("n")).first()[0] or 0
    often = {r[0] for r in grams.filter((F.col("n") > places / frequent) & (F.length("gram") < GRAM_MAX)).select("gram").collect()}
    kept = grams
    for q in range(GRAM_MIN, GRAM_MAX):
        kept = kept.filter((F.length("gram") <= q) | F.substring("gram", 1, q).isin(*sorted(often & {g for g in often if len(g) == q}) or [""]))
    rows = kept.toArrow()
    return [g for _, g in sorted(zip(rows["n"].to_pylist(), rows["gram"].to_pylist(), strict=True))]


class Grams:
    def __init__(self, dictionary: list[str]):
        self.order = {g: i for i, g in enumerate(dictionary)}
        self.starts = {g[:k] for g in dictionary for k in range(1, len(g))}
        self.ends = {g[k:] for g in dictionary for k in range(1, len(g))}

    def decompose(self, p: str) -> list[tuple[int, int]]:
        """Places (first, last) of the grams of a padded word."""
        out, end, order = [], -1, self.order
        for i in range(len(p) - GRAM_MIN + 1):
            q = next((q for q in range(min(GRAM_MAX, len(p) - i), GRAM_MIN, -1) if p[i : i + q] in order), GRAM_MIN)
            if i + q - 1 > end:
                end = i + q - 1
                out.append((i, end))
        return out

    def affected(self, p: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit of the word can affect.

        A gram is affected when the edit lies inside it, when a longer gram
        could start at or before its place and reach the edit, or when a gram
        from left of the edit could reach over it and contain the gram. Parts of
        grams are parts of longer ones too, so each gram is affected at a range
        of places. A letter put in affects no more than one of those beside it.
        """
        last = len(p) - PAD - 1
        step = [0] * (len(p) + 2)
        for a, b in grams:
            lo, hi = a, b
            while lo > PAD and p[lo : b + 1] in self.ends:
                lo -= 1
            while hi < last and any(p[x : hi + 1] in self.starts for x in range(max(0, hi - GRAM_MAX + 2), a + 1)):
                hi += 1
            step[max(lo, PAD)] += 1
            step[max(hi, PAD - 1) + 1] -= 1
        return max(accumulate(step[PAD : last + 1]))


INDEX = "gram int, word string, n long, first int, last int, later array<int>, lone boolean"


def _index(batches: Iterator[pa.RecordBatch], grams: Grams) -> Iterator[pa.RecordBatch]:
    """Rows of the lists of each word: its rarest grams, and for each the grams after it that may be the second common one.

    Up to a gram that an edit to its right leaves as it is, two near words have
    the same grams, so its first place in both is the same; likewise the last
    place of one to the right of the edit, counted from the end.
    """
    for batch in batches:
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p = padded(word)
            places = grams.decompose(p)
            found: dict[int, list[int]] = {}
            for a, b in places:
                found.setdefault(grams.order[p[a : b + 1]], []).append(a)
            bound = grams.affected(p, places)
            ranked = sorted(found)
            second = ranked[: bound + 2]
            for r, g in enumerate(ranked[: bound + 1]):
                rows.append((g, word, n, found[g][0], found[g][-1], second[r + 1 :], len(ranked) - bound < 2))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _INDEX_TYPES, strict=True)], ["gram", "word", "n", "first", "last", "later", "lone"])


_INDEX_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_()]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes a into b, which is not shorter."""
    if a == b or len(b) - len(a) > 1:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x != y[: len(x)])
    i = int(differ[0]) if len(differ) else len(x)
    return a[i if len(b) > len(a) else i + 1 :] == b[i + 1 :]


def verified(words: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of words, rows of 64-bit pieces of one byte a letter, are one edit apart; j is as long as i or one longer."""
    longer = size[j] > size[i]
    changes = np.zeros(len(i), np.uint8)
    fits, seen = np.ones(len(i), bool), np.zeros(len(i), bool)
    ones, low7 = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F)
    for w in range(words.shape[1]):
        a, b = words[i, w], words[j, w]
        x = a ^ b
        # Only the letters that the shorter word has count on the left.
        x &= np.where(longer & (size[i] // 8 <= w), (np.uint64(1) << (8 * np.clip(size[i] - 8 * w, 0, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
        differ = ((((x & low7) + low7) | x) >> np.uint64(7)) & ones
        changes += np.bitwise_count(differ)
        ahead = words[j, w + 1] << np.uint64(56) if w + 1 < words.shape[1] else np.uint64(0)
        moved = a ^ ((b >> np.uint64(8)) | ahead)
        first = differ & (np.uint64(0) - differ)
        fits &= np.where(seen, moved == 0, (differ == 0) | (moved < first))
        seen |= differ != 0
    return np.where(longer, fits, changes == 1)


def near_within(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the flattened lists that share a list, the place of its gram, and are one edit apart."""
    rows = lists.flatten()
    of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    spelt = [w.encode("latin-1") for w in rows.field("word").to_pylist()]
    first, last = (rows.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
    size = np.array([len(w) for w in spelt], np.int64)
    wide = size <= _WIDE
    width = _WIDE // 8
    packed = np.zeros((len(spelt), width), np.uint64)
    if wide.any():
        packed[wide] = np.array([w for w, ok in zip(spelt, wide.tolist(), strict=True) if ok], f"S{_WIDE}").view(np.uint64).reshape(-1, width)
    # One bit a letter: an edit changes at most two of them.
    letters = np.zeros(len(spelt), np.uint64)
    every = np.frombuffer(b"".join(spelt), np.uint8)
    np.bitwise_or.at(letters, np.repeat(np.arange(len(spelt)), size), np.uint64(1) << (every & np.uint8(63)).astype(np.uint64))
    for offset in (first, size - last + (1 << 31)):
        key = of << 32 | offset
        order = np.lexsort((size, key))
        _, spot = np.unique(key[order], return_inverse=True)
        key, bag = (spot << 32) + size[order], letters[order]
        # Each word meets those after it in its place, of its own length and one more.
        upto = np.searchsorted(key, key + 1, side="right")
        many = np.cumsum(upto - np.arange(len(key)) - 1)
        lo = 0
        while lo < len(key):
            before = many[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(many, before + _PAIRS, side="right")))
            each = np.diff(many[lo:hi], prepend=before)
            j = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - np.arange(lo, hi) - 1, each)
            like = np.flatnonzero(np.bitwise_count(np.repeat(bag[lo:hi], each) ^ bag[j]) <= 2)
            i, j = order[np.searchsorted(np.cumsum(each), like, side="right") + lo], order[j[like]]
            slim = wide[j] & wide[i]
            a, b = i[slim], j[slim]
            ok = verified(packed, size, a, b)
            yield a[ok], b[ok]
            long = [(x, y) for x, y in zip(i[~slim].tolist(), j[~slim].tolist(), strict=True) if one_edit(spelt[x], spelt[y])]
            if long:
                yield tuple(np.array(x) for x in zip(*long, strict=True))
            lo = hi


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        upto = np.asarray(lists.offsets)
        lo = 0
        while lo < len(lists):
            # Short lists are merged together, up to the size of a long one.
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + 4 * LIST, side="right")) - 1)
            part = pa.concat_arrays([lists.slice(lo, hi - lo)])
            rows, met = part.flatten(), set()
            word, n = rows.field("word"), rows.field("n")
            for a, b in near_within(part):
                met.update(zip(a.tolist(), b.tolist(), strict=True))
            if met:
                a, b = (pa.array(x, pa.int64()) for x in zip(*met, strict=True))
                yield pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], ["a", "na", "b", "nb"])
            lo = hi
    trim()


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    lists = rows.groupBy(*keys).agg(F.collect_list(F.struct("word", "n", "first", "last")).alias("words"))
    return lists.select("words").mapInArrow(_near, "a string, na long, b string, nb long")


def _sized(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    size = rows.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1")
    return stored(rows.join(size, keys), label)


def near_words(words: DataFrame, frequent: int = FREQUENT, most: int = LIST) -> DataFrame:
    """Pairs (a, na, b, nb), stored, each once: words one edit apart and their counts."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, frequent))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _index(batches, Grams(shared.value))

    met = _sized(words.mapInArrow(build, INDEX), ["gram"], "lists")
    found = _merged(met.filter(F.col("size") <= most), ["gram"])
    hot = met.filter(F.col("size") > most)
    if not hot.isEmpty():
        # Two near words share the gram's place from one end, a length up to one, and a second gram unless both have one safe gram only.
        length = F.length("word")
        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("at")), F.struct(F.lit(1).alias("side"), (length - F.col("last")).alias("at")))
        seconds = F.when(F.col("lone"), F.concat("later", F.array(F.lit(-1)))).otherwise(F.col("later"))
        finer = (
            hot.drop("size").withColumn("s", F.explode(sides)).withColumn("long", F.explode(F.array(length, length - 1))).withColumn("second", F.explode(seconds))
            .select("gram", "s.side", "s.at", "long", "second", "word", "n", "first", "last")
        )
        keys = ["gram", "side", "at", "long", "second"]
        met = _sized(finer, keys, "finer")
        found = found.union(_merged(met.filter(F.col("size") <= most), keys))
        blocks = F.ceil(2 * F.col("size") / most).cast("int")
        mine = F.pmod(F.hash("word"), blocks)
        both = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, mine).alias("x"), F.greatest(j, mine).alias("y")))
        split = met.filter(F.col("size") > most).withColumn("p", F.explode(both))
        found = found.union(_merged(split, [*keys, "p.x", "p.y"]))
    first = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return stored(found.select(pick("a", "b").alias("a"), pick("na", "nb").alias("na"), pick("b", "a").alias("b"), pick("nb", "na").alias("nb")).distinct(), "near")


def spelling_variants(docs: DataFrame, delete_every: int = 0, frequent: int = FREQUENT, most: int = LIST) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of all words of ``word_counts``.

    The form of a word is its near word that is most frequent (ties: smallest
    in code-point order) and at least FORM_RATIO times as frequent as it; root
    is the last form of its chain, the word itself without any. Null and empty
    texts have no words, and each of several rows with one doc_id counts.
    """
    words = word_counts(docs, delete_every)
    near = near_words(words, frequent, most)
    sides = near.select("a", "b", "nb").union(near.select("b", "a", "na")).toDF("word", "other", "m")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    whole = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= FORM_RATIO * F.col("n")
    whole = stored(
        whole.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    # Counts double along a chain, so chains are short; following them in doubling steps takes a few rounds.
    chain = whole.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = stored(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        if chain.filter("moved").isEmpty():
            break
        chain = chain.select("word", "root")
    out = whole.join(chain.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
