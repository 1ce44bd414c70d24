"""Bigram language model by deleted interpolation, learned and applied in blocks.

P(w | h) = a[b] * c(h, w) / c(h) + u[b] * c(w) / N + z[b] / (V + 1), where b is
the bucket floor(log2 c(h)) of the context's frequency (bucket 0: unseen). The
weights of every bucket are learned by expectation-maximisation on all
training documents, each seen with its own counts deleted from the corpus
counts. Counts cover all training documents. The corpus is never
gathered: hash buckets add up the counts of all blocks, and the maximisation
sees a histogram over a fixed grid of (bucket, bigram estimate, unigram
estimate).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.llm import blocks as B
from relyframe.llm.text import U64, mix, words

FOLDS, HELD_OUT = 7, 2
UNIGRAM, BIGRAM = 0, 1
END, BEGIN = U64(0x3C6EF372FE94F82B), U64(0xBB67AE8584CAA73B)
_STEPS = 2  # grid lines per factor of two in the estimates
_NONE = 255
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a block (words, then one end per document), their rows, and the hash of (token before, token)."""
    n = len(table)
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in words(table["text"], lower=True):
        hashes.append(w.hash)
        rows.append(w.first + w.row)
    word, row = np.concatenate(hashes), np.concatenate(rows)
    size = np.bincount(row, minlength=n) + 1
    token = np.full(len(word) + n, END, np.uint64)
    token[np.arange(len(word)) + row] = word
    doc = np.repeat(np.arange(n), size)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(size) - size] = BEGIN
    pair = mix(before * U64(0x9FB21C651E98DF25) + token)
    return token, doc, pair


def _narrow(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in ("u1", "u2", "u4", "u8") if top < 256 ** int(k[1]))
    return kind.encode() + x.astype(kind).tobytes()


def _wide(part: bytes, n: int) -> np.ndarray:
    kind = part[:2].decode()
    return np.frombuffer(part, kind, n, 2).astype(np.int64)


def _question(block: int, table: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    token, doc, pair = _tokens(table)
    train = np.asarray(table["train"]).astype(bool)[doc]
    for kind, x, width in ((UNIGRAM, token, 8), (BIGRAM, pair, 6)):
        h, which = np.unique(x, return_inverse=True)
        n = np.bincount(which, weights=train, minlength=len(h)).astype(np.int64)

        def part(s: slice, h=h, n=n, width=width) -> bytes:
            body = B.six_bytes(h[s]) if width == 6 else h[s].tobytes()
            return struct.pack("<BI", width, len(n[s])) + body + _narrow(n[s])

        yield B.split(kind, block, h, buckets, part)


def _reply(_: list[int], parts: list[bytes]) -> list[bytes]:
    """For each part the training counts of its hashes; before them the bucket's distinct and total tokens."""
    heads = [struct.unpack_from("<BI", p) for p in parts]
    bodies = [p[5 : 5 + width * n] for p, (width, n) in zip(parts, heads, strict=True)]
    h = B.from_six(bodies) if heads[0][0] == 6 else np.frombuffer(b"".join(bodies), np.uint64)
    own = np.concatenate([_wide(p[5 + width * n :], n) for p, (width, n) in zip(parts, heads, strict=True)])
    known, which = np.unique(h, return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, which, own)
    summary = struct.pack("<qq", int((total > 0).sum()), int(total.sum()))
    at = np.concatenate(([0], np.cumsum([n for _, n in heads])))
    back = total[which]
    return [summary + struct.pack("<I", z - a) + _narrow(back[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]


def _counts(answers: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((b, p) for k, b, p in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["part"].to_pylist(), strict=True) if k == kind)
    return np.concatenate([np.zeros(0, np.int64), *(_wide(p[20:], struct.unpack_from("<I", p, 16)[0]) for _, p in rows)])


def _seen(payload: bytes, answers: pa.Table) -> tuple:
    """Table, row of each token, and the corpus counts of each token, its context and its bigram; with the ids to delete by."""
    table = B.unpack(payload)
    token, doc, pair = _tokens(table)
    _, one = np.unique(token, return_inverse=True)
    c1 = _counts(answers, UNIGRAM)[one]
    _, two = np.unique(pair, return_inverse=True)
    c2 = _counts(answers, BIGRAM)[two]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    last = np.append(first[1:], len(doc)) - 1
    before = np.empty_like(one)
    before[1:] = one[:-1]
    context = np.empty_like(c1)
    context[1:] = c1[:-1]
    # A text begins as often as one ends.
    before[first], context[first] = one[last], c1[last]
    return table, doc, one, two, before, c1, c2, context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), 0)


def _own(doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How often each token's id occurs in its own document."""
    _, which, n = np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
    return n[which]


def _grid(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.rint(-np.log2(p) * _STEPS)
    return np.where(np.isfinite(x), np.minimum(x, _NONE - 1), _NONE).astype(np.int64)


def _histogram(block: int, payload: bytes, answers: pa.Table, n_all: int) -> Iterator[pa.RecordBatch]:
    """Held-out events of the training documents by (context bucket, grid cells of both estimates)."""
    _, doc, one, two, before, c1, c2, context = _seen(payload, answers)
    size = np.bincount(doc)[doc]
    own_one = _own(doc, one)
    c1, c2, rest = c1 - own_one, c2 - _own(doc, two), n_all - size
    # A word's occurrences as a context in its document are those as a token.
    key = doc * (int(one.max()) + 1)
    ids, place = np.unique(key + one, return_index=True)
    context = context - own_one[place[np.searchsorted(ids, key + before)]]
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(context > 0, c2 / np.maximum(context, 1), 0.0)
        p1 = c1 / np.maximum(rest, 1)
    cell = (_bucket(context) << 16) | (_grid(p2) << 8) | _grid(p1)
    cells, n = np.unique(cell, return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])


def fit_weights(cells: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of 64 context buckets by expectation-maximisation; buckets without events take those of all events."""
    def value(x):
        return np.where(x == _NONE, 0.0, 2.0 ** (-x / _STEPS))

    b = cells >> 16
    p = np.stack([value((cells >> 8) & 255), value(cells & 255), np.full(len(cells), 1.0 / (vocabulary + 1))], axis=1)

    def climb(p, n, seen):
        lam = np.array([0.4, 0.4, 0.2]) if seen else np.array([0.0, 0.6, 0.4])
        for _ in range(rounds if len(n) else 0):
            share = lam * p
            share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            lam = share.sum(axis=0) / max(share.sum(), 1e-300)
        if not seen:
            lam[0] = 0.0
        lam = np.maximum(lam, [0.0, 0.0, 1e-6])
        return lam / lam.sum()

    out = np.tile(climb(p, n, True), (64, 1))
    out[0] = climb(p[b == 0], n[b == 0], False)
    for k in np.unique(b[b > 0]):
        out[k] = climb(p[b == k], n[b == k], True)
    return out


def _score(block: int, payload: bytes, answers: pa.Table, n_all: int, vocabulary: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    table, doc, _, _, _, c1, c2, context = _seen(payload, answers)
    lam = weights[_bucket(context)]
    p = lam[:, 0] * c2 / np.maximum(context, 1) + lam[:, 1] * c1 / max(n_all, 1) + lam[:, 2] / (vocabulary + 1)
    rows = len(table)
    total = lambda x: np.bincount(doc, weights=x, minlength=rows)
    base = total(np.log10((c1 + 1) / (n_all + vocabulary + 1)))
    yield pa.RecordBatch.from_arrays(
        [
            table["doc_id"].combine_chunks(), pa.array(~np.asarray(table["train"]).astype(bool)), pa.array(np.bincount(doc, minlength=rows), pa.int64()),
            pa.array(total(c1 > 0).astype(np.int64)), pa.array(base), pa.array(total(np.log10(p))),
        ],
        ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = [struct.unpack_from("<qq", p.as_py()[:16]) for p in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in v], pa.int64()), pa.array([x for _, x in v], pa.int64())], ["bucket", "types", "tokens"])


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: SCORES and train_tokens.

    Learned from documents whose crc32(doc_id as text) modulo 7 is not 2. A
    null text is empty: its only token is the end. A null doc_id is held out.
    Repeated rows count, and are scored, as often as they occur. An empty
    table gives no rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    train = F.coalesce(fold != HELD_OUT, F.lit(False))
    own = B.make_blocks(docs.select("doc_id", "text", train.alias("train")), "blocks", apart="train")
    buckets = B.bucket_count(own)
    answers = B.answer(B.ask(own, lambda block, t: _question(block, t, buckets)), _reply, "counts")
    heads = answers.filter(f"kind = {UNIGRAM}").select("bucket", F.substring("part", 1, 16).alias("part")).mapInArrow(_summaries, "bucket int, types long, tokens long")
    vocabulary, n_all = heads.distinct().agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    tuning = B.meet(own.filter("block < 0"), answers.filter("block < 0"), lambda b, p, a: _histogram(b, p, a, n_all), "cell long, n long")
    grid = tuning.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most one row per cell of the fixed grid
    weights = fit_weights(grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(np.float64), vocabulary)
    scored = B.meet(own, answers, lambda b, p, a: _score(b, p, a, n_all, vocabulary, weights), SCORES)
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))
