"""Repeated passages by relative Lempel-Ziv parsing.

The reference is the corpus itself: hash buckets index every candidate window
of WINDOW words by its first place (smallest document, then smallest start),
and every document is factored greedily against all of them: a factor starts
at a window known from an earlier place and grows while the next window's
first place is the next word of the same reference text. Where a factor ends,
the window at its boundary has been looked up in every bucket as well, so a
repeat that straddles two factors, or continues in another reference, starts a
factor of its own and no repeated window is missed.

Candidates: the smallest 8-word hash inside a window (its anchor) is the same
wherever the window occurs, so only windows whose anchor occurs twice in the
corpus are indexed. Whole copies of an earlier document need no parsing: all
their windows start earlier, and none of theirs is a first place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.llm import blocks as B
from relyframe.llm.store import sized, stored
from relyframe.llm.text import U64, mix, shingles, words

WINDOW = 20
ANCHOR = 8
_SPAN = WINDOW - ANCHOR + 1
ANCHORS, CANDIDATES, PLACES = 0, 1, 2

DIGEST = "doc_id long, version long, n_words long, sha string"
FACTORS = "doc_id long, version long, starts array<int>, lengths array<int>, ref_docs array<long>, ref_starts array<int>"


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for text in batch.column(2):
            w = split_words(text.as_py())
            n.append(len(w))
            sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha)], ["doc_id", "version", "n_words", "sha"])


def _windows(column: pa.Array) -> Iterator[tuple]:
    """For each piece of a column: row, start and least 8-word hash of every window, its index, all 8-word hashes, all word hashes."""
    for w in words(column):
        n = len(w.hash) - WINDOW + 1
        if n <= 0:
            continue
        inside = np.flatnonzero(w.row[:n] == w.row[WINDOW - 1 :])
        if not len(inside):
            continue
        gram = shingles(w.hash, ANCHOR)
        low = gram[:n].copy()
        for j in range(1, _SPAN):
            np.minimum(low, gram[j : j + n], out=low)
        begin = np.concatenate(([0], np.cumsum(w.per_row())))
        yield w.first + w.row[inside], inside - begin[w.row[inside]], low[inside], inside, gram, w.hash


def _anchor_question(block: int, table: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    found = []
    for _, _, low, inside, gram, _ in _windows(table["text"]):
        # A place is chosen if its hash is the least of some window over it.
        most = np.zeros(len(gram), np.uint64)
        for j in range(_SPAN):
            most[inside + j] = np.maximum(most[inside + j], low)
        found.append(gram[(most == gram) & (most > 0)])
    if found:
        anchor, n = np.unique(np.concatenate(found), return_counts=True)
        yield B.split(ANCHORS, block, anchor, buckets, lambda s: _flags(n[s] > 1) + B.six_bytes(anchor[s]))


def _flags(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + np.packbits(x).tobytes()


def _unflag(part: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(part[:4], "little")
    size = 4 + (n + 7) // 8
    return np.unpackbits(np.frombuffer(part[4:size], np.uint8), count=n).astype(bool), part[size:]


def _anchor_reply(_: list[int], parts: list[bytes]) -> list[bytes]:
    """For each part, which of its anchors occur at two places or more."""
    flags, hashes = zip(*(_unflag(p) for p in parts), strict=True)
    anchor, which = np.unique(B.from_six(list(hashes)), return_inverse=True)
    seen = np.bincount(which, weights=1 + np.concatenate(flags), minlength=len(anchor)) > 1
    upto = np.concatenate(([0], np.cumsum([len(f) for f in flags])))
    hit = seen[which]
    return [_flags(hit[a:z]) for a, z in zip(upto[:-1], upto[1:], strict=True)]


def _candidates(block: int, payload: bytes, answers: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """The block's windows whose anchor is repeated: their hashes to the buckets, their places kept for the parse."""
    table = B.unpack(payload)
    rows = sorted(zip(answers["bucket"].to_pylist(), answers["part"].to_pylist(), strict=True))
    if not rows:
        return
    repeated = np.concatenate([_unflag(p)[0] for _, p in rows])
    held = [(row, start, low, inside, h) for row, start, low, inside, _, h in _windows(table["text"])]
    anchors = np.unique(np.concatenate([x[2] for x in held]))
    ids = np.asarray(table["doc_id"])
    pick: list[list[np.ndarray]] = [[], [], [], []]
    for row, start, low, inside, h in held:
        # A window's least hash is an anchor of its block by construction.
        at = np.flatnonzero(repeated[np.searchsorted(anchors, low)])
        if len(at):
            full = shingles(h, WINDOW)
            again = shingles(mix(h ^ U64(0x6A09E667F3BCC909)), WINDOW)
            for to, x in zip(pick, (full[inside[at]], again[inside[at]] >> U64(32), row[at], start[at]), strict=True):
                to.append(x)
    if not pick[0]:
        return
    h1, h2, row, start = (np.concatenate(x) for x in pick)
    order = np.lexsort((start, ids[row], h2, h1))
    h1, h2, row, start = h1[order], h2[order], row[order], start[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)
    g1, g2, doc, at = h1[first], h2[first].astype(np.uint32), ids[row[first]], start[first].astype(np.int32)
    yield B.split(PLACES, block, g1, buckets, lambda s: len(g1[s]).to_bytes(4, "little") + B.six_bytes(g1[s]) + g2[s].tobytes() + doc[s].tobytes() + at[s].tobytes())
    used = np.unique(row)
    keep = B.dump({
        "window": (np.cumsum(new) - 1).astype(np.uint32), "row": np.searchsorted(used, row).astype(np.uint32), "start": start.astype(np.uint32),
        "doc": ids[used], "version": np.asarray(table["version"])[used],
    })
    yield pa.RecordBatch.from_arrays([pa.array([CANDIDATES], pa.int32()), pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.array([keep], pa.binary())], schema=B.PART_ARROW)


def _places_reply(_: list[int], parts: list[bytes]) -> list[bytes]:
    """For each window of each part its first place in the corpus: documents, then starts."""
    size = [int.from_bytes(p[:4], "little") for p in parts]
    cut = lambda p, n, a, z: p[4 + a * n : 4 + z * n]
    h1 = B.from_six([cut(p, n, 0, 6) for p, n in zip(parts, size, strict=True)])
    h2 = np.frombuffer(b"".join(cut(p, n, 6, 10) for p, n in zip(parts, size, strict=True)), np.uint32)
    doc = np.frombuffer(b"".join(cut(p, n, 10, 18) for p, n in zip(parts, size, strict=True)), np.int64)
    at = np.frombuffer(b"".join(cut(p, n, 18, 22) for p, n in zip(parts, size, strict=True)), np.int32)
    order = np.lexsort((at, doc, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    ref_doc, ref_at = np.empty_like(doc), np.empty_like(at)
    ref_doc[order], ref_at[order] = doc[first], at[first]
    upto = np.concatenate(([0], np.cumsum(size)))
    return [n.to_bytes(4, "little") + ref_doc[a:z].tobytes() + ref_at[a:z].tobytes() for n, a, z in zip(size, upto[:-1], upto[1:], strict=True)]


def _parse(block: int, payload: bytes, answers: pa.Table) -> Iterator[pa.RecordBatch]:
    """Greedy factors of the block's documents from the first places of their windows."""
    rows = sorted(zip(answers["bucket"].to_pylist(), answers["part"].to_pylist(), strict=True))
    size = [int.from_bytes(p[:4], "little") for _, p in rows]
    ref_doc = np.frombuffer(b"".join(p[4 : 4 + 8 * n] for (_, p), n in zip(rows, size, strict=True)), np.int64)
    ref_at = np.frombuffer(b"".join(p[4 + 8 * n :] for (_, p), n in zip(rows, size, strict=True)), np.int32)
    own = B.load(payload)
    order = np.lexsort((own["start"], own["row"]))
    row, start, window = own["row"][order].astype(np.int64), own["start"][order].astype(np.int64), own["window"][order]
    sd, sa, doc = ref_doc[window], ref_at[window].astype(np.int64), own["doc"][row]
    late = (sd < doc) | ((sd == doc) & (sa < start))
    row, start, sd, sa = row[late], start[late], sd[late], sa[late]
    if not len(row):
        return
    grows = np.zeros(len(row), bool)
    grows[1:] = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1) & (sd[1:] == sd[:-1]) & (sa[1:] == sa[:-1] + 1)
    head = np.flatnonzero(~grows)
    length = np.diff(np.append(head, len(row))) + WINDOW - 1
    docs, count = np.unique(row[head], return_counts=True)
    at = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((start[head], pa.int32()), (length, pa.int32()), (sd[head], pa.int64()), (sa[head], pa.int32()))]
    yield pa.RecordBatch.from_arrays([pa.array(own["doc"][docs]), pa.array(own["version"][docs]), *lists], schema=_FACTORS_ARROW)


_FACTORS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("version", pa.int64()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())),
    ("ref_docs", pa.list_(pa.int64())), ("ref_starts", pa.list_(pa.int32())),
])


def with_version(docs: DataFrame) -> DataFrame:
    """doc_id, version, text; the version tells rows of one doc_id with different texts apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text")


def digests(docs: DataFrame) -> DataFrame:
    """Per row the number of words, the digest of its words, and whether it is a copy of an earlier document."""
    found = stored(with_version(docs).mapInArrow(_digests, DIGEST), "digests")
    first = found.filter(f"n_words >= {WINDOW} AND doc_id IS NOT NULL").groupBy("sha", "n_words").agg(F.min("doc_id").alias("first_id"))
    return found.join(first, ["sha", "n_words"], "left").select("doc_id", "version", "n_words", "sha", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)).alias("copy"))


def factors(docs: DataFrame, info: DataFrame) -> DataFrame:
    """Factors of every document that is not a whole copy: rows of FACTORS, stored."""
    copies = stored(info.filter("copy").select("doc_id", "version").distinct(), "copies")
    texts = with_version(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    own = B.make_blocks(texts.join(sized(copies), ["doc_id", "version"], "left_anti"), "blocks")
    buckets = B.bucket_count(own)
    repeated = B.answer(B.ask(own, lambda block, t: _anchor_question(block, t, buckets)), _anchor_reply, "anchors")
    found = stored(B.meet(own, repeated, lambda b, p, a: _candidates(b, p, a, buckets), B.PART), "windows")
    places = B.answer(found.filter(f"kind = {PLACES}"), _places_reply, "places")
    kept = found.filter(f"kind = {CANDIDATES}").select("block", F.col("part").alias("payload"))
    return stored(B.meet(kept, places, _parse, FACTORS), "factors")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, versions, removed, sha, kept = [], [], [], [], []
        for r in batch.to_pylist():
            w = split_words(r["text"])
            gone = np.zeros(len(w) + 1, np.int64)
            np.add.at(gone, r["starts"], 1)
            np.add.at(gone, np.add(r["starts"], r["lengths"]), -1)
            gone = np.cumsum(gone)[:-1] > 0
            left = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
            ids.append(r["doc_id"])
            versions.append(r["version"])
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "version", "n_removed", "sha", "kept"])


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts of the documents that have factors, without the words that factors cover: doc_id, version, n_removed, sha, kept."""
    spans = spans.select("doc_id", "version", "starts", "lengths").dropDuplicates(["doc_id", "version"])
    rows = with_version(docs).join(sized(spans), ["doc_id", "version"])
    return rows.select("doc_id", "version", "text", "starts", "lengths").mapInArrow(_cut, "doc_id long, version long, n_removed long, sha string, kept string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_factors.

    A null or blank text has no words. Texts below 20 words are kept whole.
    A null doc_id has no place in the order: its text is kept and is no
    reference. Equal rows are one document; rows of one doc_id with different
    texts are compared by their starts.
    """
    info = stored(digests(docs), "info")
    spans = factors(docs, info)
    done = cut(docs, spans).select("doc_id", "version", "n_removed", F.col("sha").alias("cut_sha")).dropDuplicates(["doc_id", "version"])
    count = spans.select("doc_id", "version", F.size("starts").cast("long").alias("n_factors")).dropDuplicates(["doc_id", "version"])
    blank = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        info.join(done, ["doc_id", "version"], "left").join(count, ["doc_id", "version"], "left")
        .select(
            "doc_id", "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), blank).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_factors", F.lit(0))).alias("n_factors"),
        )
    )
