"""Near-duplicate documents by SimHash and bit-sliced comparison.

A fingerprint is the majority of the hashes of a text's word shingles, bit by
bit. Equal fingerprints are one class. Two fingerprints within the radius agree
in at least one of three parts of their bits, so the parts are bucket keys.
Inside a bucket the fingerprints are stored as bit planes, 64 of them to a
word; the distances of one fingerprint to 64 others are counted at once by
carry-save bitwise counters, plane by plane, and words are abandoned once all
their distances exceed the radius. A bucket of more than GROUP fingerprints is
divided by the parts of its remaining bits. As fingerprints are distinct, the
bits left bound every bucket after three divisions, whatever the data. A bucket
returns the links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from relyframe.llm.components import components
from relyframe.llm.store import stored
from relyframe.llm.text import LOWER, trim

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
# Links at this many differing bits or fewer; the counters hold up to 3.
RADIUS = 2
# The most fingerprints of a bucket that are compared at once, at least 2^13: so many have no more than 13 free bits.
GROUP = 8192
_ALL = (1 << BITS) - 1
_FULL = np.uint64(_ALL)
_SLICE = 1 << 15
_LOWER = LOWER.tobytes()


def fingerprint(text: bytes | None) -> int:
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[j:] for j in range(SHINGLE_WORDS)), strict=False))
    n = len(words) - SHINGLE_WORDS + 1
    h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, _SLICE):
        ones += np.unpackbits(h[lo : lo + _SLICE].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1).cast(pa.large_binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
    trim()


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def divided(mask: int) -> list[int]:
    """Three masks that fix the bits of ``mask`` and a third of the others each."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    step = -(-len(free) // 3)
    return [mask | sum(1 << b for b in free[i * step : (i + 1) * step]) for i in range(3)]


def planes(values: np.ndarray, bits: list[int]) -> dict[int, np.ndarray]:
    """For each bit the words of its plane: slot k of ``values`` is bit k % 64 of word k // 64."""
    return {b: np.packbits(((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in bits}


def near_slots(values: np.ndarray, valid: np.ndarray, query: np.ndarray, word: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots (query slot, later slot of one of the query's words) that differ in at most RADIUS of ``bits``."""
    plane = planes(values, bits)
    live = np.packbits(valid.astype(np.uint8), bitorder="little").view(np.uint64)
    dead = ~live[word]
    own = word == query // BITS
    # Slots up to the query's own are met from their side.
    upto = (_FULL >> (np.uint64(BITS - 1) - (query[own] % BITS).astype(np.uint64)))
    dead[own] |= upto
    low, high = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    mine = values[query]
    for turn, b in enumerate(bits):
        differ = plane[b][word] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & np.uint64(1)))
        carry = low & differ
        low ^= differ
        high ^= carry
        dead |= low & high
        if turn % 4 == 3:
            alive = np.flatnonzero(dead != _FULL)
            if len(alive) < 0.8 * len(dead):
                query, word, mine, low, high, dead = query[alive], word[alive], mine[alive], low[alive], high[alive], dead[alive]
            if not len(dead):
                break
    near = np.unpackbits((~dead).view(np.uint8), bitorder="little").reshape(-1, BITS) if len(dead) else np.zeros((0, BITS), np.uint8)
    row, slot = np.nonzero(near)
    return query[row], word[row] * BITS + slot


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest slot reachable from each of n slots."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def links_within(lists: pa.ListArray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, a fingerprint of the same component of its bucket), one for each member that is linked."""
    bits = [b for b in range(BITS) if not mask >> b & 1]
    size = np.diff(np.asarray(lists.offsets))
    held = lists.flatten().to_numpy().view(np.uint64)
    wide = -(-size // BITS)
    first = np.concatenate(([0], np.cumsum(wide)))
    values, valid = np.zeros(first[-1] * BITS, np.uint64), np.zeros(first[-1] * BITS, bool)
    begin = np.cumsum(size) - size
    slot = np.repeat(first[:-1] * BITS - begin, size) + np.arange(len(held))
    values[slot], valid[slot] = held, True
    # A member asks the words from its own on to the last of its bucket.
    last = np.repeat(first[1:], size)
    many = last - slot // BITS
    query = np.repeat(slot, many)
    word = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + query // BITS
    a, b = near_slots(values, valid, query, word, bits)
    label = forest(len(values), a, b)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked], values[label[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = np.asarray(batch.column(0))
        for mask in np.unique(masks):
            lists = batch.column(2).filter(pa.array(masks == mask))
            # Buckets are taken together until their comparisons fill about a million words.
            work = np.cumsum(np.diff(np.asarray(lists.offsets)).astype(np.int64) ** 2 // BITS + 1)
            lo = 0
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + (1 << 20))))
                a, b = links_within(pa.concat_arrays([lists.slice(lo, hi - lo)]), int(mask) & _ALL)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                lo = hi
    trim()


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within RADIUS bits; ``prints`` has one row per fingerprint ``fp``."""
    masks = divided(0)
    rows = prints.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    found = None
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        size = rows.groupBy("mask", "value").agg(F.count("*").alias("size")).filter("size > 1")
        met = stored(rows.join(size, ["mask", "value"]), "buckets")
        whole = met.filter(F.col("size") <= GROUP).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"))
        links = whole.mapInArrow(_links, "a long, b long")
        found = links if found is None else found.union(links)
        hot = met.filter(F.col("size") > GROUP)
        if hot.isEmpty():
            return stored(found, "links")
        finer = F.create_map(*[x for m in masks for x in (F.lit(signed(m)), F.array(*[F.lit(signed(d)) for d in divided(m)]))])
        rows = hot.select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask")).distinct()
        masks = sorted({d for m in masks for d in divided(m)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    A null or blank text has the fingerprint zero and links like any other. Rows
    that share a doc_id are one document with the links of all its texts, and
    each row is returned. A null doc_id links with nothing, has no component and
    is kept.
    """
    sig = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    named = sig.filter("doc_id IS NOT NULL")
    classes = stored(named.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = near_links(classes)
    # Texts of one doc_id hang together.
    several = named.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).filter("b < hi").select("doc_id", "b")
    same = stored(named.join(several, "doc_id").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct(), "same")
    label = components(links.union(same))
    member = classes.join(label.withColumnRenamed("node", "fp"), "fp")
    lowest = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    moved = stored(member.join(lowest, "component").select("fp", "component_id"), "moved")
    whole = classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = sig.join(whole, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
