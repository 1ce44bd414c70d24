"""Near-duplicate documents by one-permutation hashing.

One hash of every word shingle fills the bins of a signature; bins that stay
empty borrow from a bin that optimal densification picks. Bands of bins are
bucket keys, each bucket sends one edge from its most central member to every
other member (a star), and edges are confirmed on the full shingle sets.
Shingles that no other candidate has, and the numbers of others in slices of
the hash range, bound the similarity of a pair exactly, so members with too
many of their own and pairs that cannot reach the limit are left out first. A
star is enough where its members turn out linked. In a bucket that still holds
several components, further members serve as hubs against the members of other
components, more of them in each round, until no pair that the bound allows is
left unchecked; no bucket is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.llm.components import components
from relyframe.llm.store import sized, slim, stored
from relyframe.llm.text import U64, mix, shingles, trim, words

SHINGLE_WORDS = 5
BANDS, BAND_BINS = 42, 6
BINS = BANDS * BAND_BINS
# Link when 100 * intersection >= percent * union; op1's contract is PERCENT. At
# 85 % a band of 6 bins agrees with probability 0.38, and all 42 miss with
# probability 2e-9; at 80 % with 0.26, and 3e-6.
PERCENT = 85
FIRST_HUBS = 64
SLICES = 64
BLOCK_MEMBERS, BLOCK_HUBS = 4_096, 1_024
_FULL = U64(2**64 - 1)
_TRIES = 32


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """For each attempt and bin, the bin that an empty one asks."""
    t = np.arange(4096, dtype=np.uint64)[:, None] * U64(BINS) + np.arange(BINS, dtype=np.uint64)
    return (mix(t + U64(1)) % U64(BINS)).astype(np.int32)


def densify(bins: np.ndarray) -> None:
    """Fill empty bins in place; rows without any value stay empty."""
    filled = bins != _FULL
    rows, cols = np.nonzero(~filled & filled.any(axis=1)[:, None])
    ask = _donors()
    for t in range(_TRIES):
        if not len(rows):
            return
        donor = ask[t, cols]
        ok = filled[rows, donor]
        bins[rows[ok], cols[ok]] = bins[rows[ok], donor[ok]]
        rows, cols = rows[~ok], cols[~ok]
    for r in np.unique(rows):
        mine, have = cols[rows == r], filled[r]
        hit = have[ask[:, mine]]
        first = np.where(hit.any(axis=0), hit.argmax(axis=0), -1)
        # An attempt list that never hits falls back to the first filled bin.
        donor = np.where(first >= 0, ask[first, mine], np.flatnonzero(have)[0])
        bins[r, mine] = bins[r, donor]


def shingle_sets(column: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row, in row order."""
    for w in words(column, lower=True):
        s = shingles(w.hash, k)
        upto = np.concatenate(([0], np.cumsum(w.per_row())))
        for i in range(w.count):
            a, z = upto[i], upto[i + 1]
            if z - a >= k:
                yield np.unique(s[a : z - k + 1])
            else:
                yield shingles(w.hash[a:z], int(z - a)) if z > a else np.zeros(0, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(s) for s in sets])
    bins = np.full((len(sets), BINS), _FULL, np.uint64)
    v = mix(np.concatenate(sets) + U64(0x5851F42D4C957F2D))
    slot = ((v >> U64(32)) * U64(BINS)) >> U64(32)
    np.minimum.at(bins.reshape(-1), np.repeat(np.arange(len(sets)) * BINS, n) + slot.astype(np.int64), v)
    densify(bins)
    bands = bins.reshape(len(sets), BANDS, BAND_BINS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
    for j in range(BAND_BINS):
        key = mix(key * U64(0x100000001B3) ^ bands[:, :, j])
    return key


SIGNATURE = "doc_id long, n long, h1 long, h2 long, keys array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, held, first = batch.column(0), [], 0
        for s in shingle_sets(batch.column(1)):
            held.append(s)
            if len(held) == 512:
                yield _signed(ids.slice(first, len(held)), held)
                first, held = first + len(held), []
        if held:
            yield _signed(ids.slice(first, len(held)), held)
    trim()


def _signed(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    n = np.array([len(s) for s in sets], np.int64)
    h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    h2 = np.array([mix(s ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    keys = band_keys(sets).view(np.int64)[n > 0].reshape(-1)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((n > 0) * BANDS))), pa.int32()), pa.array(keys))
    return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(h1), pa.array(h2), lists], ["doc_id", "n", "h1", "h2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, first = [], 0
        for s in [*shingle_sets(batch.column(1)), None]:
            if s is not None:
                held.append(s)
            if held and (s is None or len(held) == 512):
                at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in held]))), pa.int32())
                values = pa.array(np.concatenate(held).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.ListArray.from_arrays(at, values)], ["id", "shingles"])
                first, held = first + len(held), []
    trim()


def confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) whose full shingle sets are similar enough."""
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
        .filter(F.col("both") * 100 >= F.col("either") * percent)
        .select("a", "b")
    )


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, shapes = [], []
        for texts, mine, alone in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if texts > 1:
                own.append(0)
                shapes.append(np.full(SLICES, 1 << 20))
                continue
            total = np.bincount(mine.values.to_numpy() & (SLICES - 1), minlength=SLICES)
            mine_alone = alone.values.to_numpy() if alone.is_valid else np.zeros(0, np.int64)
            own.append(len(mine_alone))
            shapes.append(total - np.bincount(mine_alone & (SLICES - 1), minlength=SLICES))
        at = pa.array(np.arange(len(shapes) + 1) * SLICES, pa.int32())
        values = pa.array(np.concatenate(shapes) if shapes else np.zeros(0), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64()), pa.ListArray.from_arrays(at, values)], ["rep", "own", "shape"])


def own_shingles(sets: DataFrame) -> DataFrame:
    """rep, own, shape: how many shingles of a candidate no other candidate has, and how many others it has in each slice of the hashes.

    Ids with several texts count none as their own, and any number of others.
    """
    alone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1")
    mine = alone.groupBy("id").agg(F.collect_list("s").alias("alone"))
    one = sets.groupBy("id").agg(F.count("*").alias("texts"), F.first("shingles").alias("shingles"))
    return one.join(mine, "id", "left").select("id", "texts", "shingles", "alone").mapInArrow(_shapes, "rep long, own long, shape array<int>")


def can_link(n: str, own: str, m: str, its: str, percent: int):
    """Exact bound: a pair shares at most the smaller count of shingles that are not its own."""
    shared = F.least(F.col(n) - F.col(own), F.col(m) - F.col(its))
    return shared * 100 >= (F.col(n) + F.col(m) - shared) * percent


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a hub and a member of another component that both bounds allow, for lists of members and hubs of one bucket."""
    for batch in batches:
        lists = batch.column(0)
        upto, rows = np.asarray(lists.offsets), lists.flatten()
        rep, component, n, own, hub = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "n", "own", "hub"))
        shape = rows.field("shape").flatten().to_numpy().reshape(-1, SLICES)
        found = []
        for lo, hi in zip(upto[:-1], upto[1:], strict=True):
            members, hubs = (lo + np.flatnonzero(hub[lo:hi] == side) for side in (False, True))
            for h in hubs:
                m = members[component[members] != component[h]]
                most = np.minimum(n[m] - own[m], n[h] - own[h])
                m = m[most * 100 >= (n[m] + n[h] - most) * percent]
                # In each slice of the hashes a pair shares at most the smaller number.
                most = np.minimum(shape[m], shape[h]).sum(axis=1, dtype=np.int64)
                m = m[most * 100 >= (n[m] + n[h] - most) * percent]
                if len(m):
                    found.append(np.stack([np.minimum(rep[m], rep[h]), np.maximum(rep[m], rep[h])]))
        if found:
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    trim()


def hub_pairs(open_rows: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of hubs and members of the same bucket; both are dealt out in blocks, so no list is longer than two blocks."""
    columns = ["rep", "component", "n", "own", "shape"]
    size = open_rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("mine"))
    size = size.join(chosen.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_HUBS).cast("int").alias("theirs")), "key")
    rows = open_rows.count()
    size = stored(slim(size, rows), "blocks")

    def dealt(rows: DataFrame, own: str, its: str, hub: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("rep"), own).cast("int").alias("own_block")
        wide = rows.join(size, "key").select("key", *columns, block, F.explode(F.sequence(F.lit(0), F.col(its) - 1)).alias("its_block"))
        blocks = ("its_block", "own_block") if hub else ("own_block", "its_block")
        return wide.select("key", F.col(blocks[0]).alias("x"), F.col(blocks[1]).alias("y"), *columns, F.lit(hub).alias("hub"))

    both = dealt(open_rows, "mine", "theirs", False).union(dealt(chosen, "theirs", "mine", True))
    lists = both.groupBy("key", "x", "y").agg(F.collect_list(F.struct(*columns, "hub")).alias("rows")).select("rows")
    return slim(slim(lists, 8 * rows).mapInArrow(lambda batches: _possible(batches, percent), "a long, b long").distinct(), rows)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_links.

    Null or blank texts have an empty set and link with nothing. Rows that
    share a doc_id are one node that has the links of all of them, and each
    row is returned. A null doc_id links with nothing and is kept. ``n_links``
    counts the confirmed links of the document's class of equal sets. Sets link
    when their intersection is at least ``percent`` of their union.
    """
    docs = docs.select("doc_id", "text")
    sig = stored(docs.mapInArrow(_signatures, SIGNATURE), "signatures")
    named = sig.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(named.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = named.join(classes.select(F.col("rep").alias("doc_id"), "n", "h1", "h2").distinct(), ["doc_id", "n", "h1", "h2"], "left_semi").dropDuplicates(["doc_id", "n", "h1", "h2"])
    rows = stored(reps.select(F.col("doc_id").alias("rep"), "n", F.explode("keys").alias("key")), "bands")
    several = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    found = stored(rows.join(several, "key"), "members")
    size = found.count()  # tables of candidates are no longer than this
    ids = stored(slim(found.select(F.col("rep").alias("doc_id")).distinct(), size // BANDS), "candidates")
    few = ids.count()
    texts = docs.join(sized(ids), "doc_id", "left_semi").select("doc_id", "text")
    sets = stored(texts.mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    # A candidate with more than 100 - percent % shingles of its own can link with none.
    owned = stored(slim(own_shingles(sets), 8 * few), "own")
    alive = found.join(owned.select("rep", "own"), "rep").filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)
    alive = stored(slim(alive.select("key", "rep", "n", "own"), size), "alive")
    # The hub is the member with the fewest shingles of its own: the most central copy.
    hubs = alive.groupBy("key").agg(F.min(F.struct("own", "rep", "n")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = hubs.select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.own").alias("hub_own"))
    members = stored(slim(alive.join(hubs, "key"), size), "members")

    # Nodes of one doc_id with several texts hang together.
    repeated = named.groupBy("doc_id").agg(F.countDistinct("n", "h1", "h2").alias("texts")).filter("texts > 1")
    same = named.join(repeated, "doc_id").join(classes, ["n", "h1", "h2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    same = stored(slim(same.filter("a <> b").distinct(), few), "same")

    star = members.filter((F.col("hub") != F.col("rep")) & can_link("n", "own", "hub_n", "hub_own", percent))
    star = stored(star.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct().transform(slim, 4 * few), "pairs")
    confirmed = stored(slim(confirm(sets, star, percent), 32 * few), "confirmed")
    links = confirmed if same.isEmpty() else confirmed.union(same)
    label = components(links)

    # Rounds for buckets that hold several components.
    shapes = owned.select("rep", "shape")
    pending, wide = members.filter("rep <> hub").select("key", "rep", "n", "own"), FIRST_HUBS
    while True:
        now = pending.join(label.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        open_rows = stored(slim(now.join(mixed, "key").join(shapes, "rep").select("key", "rep", "n", "own", "component", "shape"), 8 * size), "open")
        size = open_rows.count()
        if not size:
            break
        turn = F.row_number().over(Window.partitionBy("key").orderBy("own", "rep"))
        chosen = stored(slim(open_rows.withColumn("turn", turn).filter(F.col("turn") <= wide).drop("turn"), size), "hubs")
        wide *= 64
        pairs = stored(hub_pairs(open_rows, chosen, percent), "pairs")
        pending = stored(slim(open_rows.join(chosen.select("key", "rep"), ["key", "rep"], "left_anti").select("key", "rep", "n", "own"), size), "pending")
        more = stored(slim(confirm(sets, pairs, percent), 32 * pairs.count()), "confirmed")
        if not more.isEmpty():
            confirmed = confirmed.union(more)
            links = links.union(more)
            label = components(links)

    confirmed = confirmed.distinct()
    degree = confirmed.select(F.col("a").alias("rep")).union(confirmed.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    named_class = (
        classes.join(label.toDF("rep", "component"), "rep", "left").join(degree, "rep", "left")
        .select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    out = sig.select("doc_id", "n", "h1", "h2").join(named_class, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
