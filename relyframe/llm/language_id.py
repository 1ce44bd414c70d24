"""Language identification by nearest centroid.

A text is the vector of its hashed 1- to 3-byte grams (lower case, everything
but letters read as a space), weighted log(1 + count) * idf and scaled to
length one. Document frequencies cover all training documents. Each language
has up to CENTROIDS centroids, found by spherical k-means on at most
SAMPLE training documents of the language (those with the smallest hash of
their id): the classifier's documented bound. A text takes the language of the
centroid with the largest cosine, and is rejected when that cosine is below
REACH times what all but a hundredth of the language's sample texts reach, or,
from LENGTHS characters on, NEAR times what all but a hundredth of the sample's
texts reach when they are cut to that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.llm.store import stored
from relyframe.llm.text import buffers, pieces, trim

FOLDS, HELD_OUT = 4, 2
DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 500
PIECE_ROWS = 256
UNKNOWN = "und"
# Cosine below which nothing is trusted, and the share of a language's lowest
# usual cosine that still counts as near. Clean texts of one or two words have
# cosines from about 0.15 on and stay; text of another kind has less.
LEAST_COSINE, REACH = 0.05, 0.25
# Longer texts come nearer to their language, and gibberish and other languages
# do not, so the limit rises with the length in characters. A length needs
# ENOUGH sample texts; beyond the last one with them the limit stays.
LENGTHS, NEAR, ENOUGH = (32, 64, 128, 256, 512, 1024, 2048), 0.6, 20

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def gram_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts (rows, DIMENSIONS) of the hashed grams, a few hundred rows at a time."""
    data, offsets = buffers(column)
    for lo, hi in pieces(offsets, rows=PIECE_ROWS):
        hi_lo = hi - lo
        b = _LETTER[data[offsets[lo] : offsets[hi]]].astype(np.uint32)
        row = np.repeat(np.arange(hi_lo, dtype=np.int64) * DIMENSIONS, np.diff(offsets[lo : hi + 1]))
        counts = np.zeros(hi_lo * DIMENSIONS, np.int64)
        code = b + np.uint32(1)
        for n in range(1, 4):
            if n > 1:
                code = code[:-1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
            if not len(code):
                break
            inside = row[: len(code)] == row[n - 1 :]
            slot = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            counts += np.bincount((row[: len(code)] + slot)[inside], minlength=len(counts))
        yield counts.reshape(hi_lo, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    plain = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)
    return np.asarray(plain).astype(bool)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for counts in gram_counts(batch.column(0)):
            df += (counts > 0).sum(axis=0)
            n += len(counts)
    trim()
    slots = np.append(np.arange(DIMENSIONS), -1)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(np.append(df, n))], ["slot", "n"])


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; centroids and the cosines of all rows to them.

    Seeds are rows at even ranks of closeness to the mean, so neither outliers
    nor chance choose them.
    """
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    seeds = np.unique(order[(np.arange(k) * 2 + 1) * len(x) // (2 * k)])
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, x @ c.T


def rising_limits(column: pa.ChunkedArray, idf: np.ndarray, centroids: np.ndarray, lowest: float) -> list[float]:
    """The limit at half of the first of LENGTHS and at each of them; it never falls."""
    limits, size = [lowest], np.asarray(pc.utf8_length(column))
    for n in LENGTHS:
        texts = pc.utf8_slice_codeunits(column.filter(pa.array(size >= n)), 0, n)
        if len(texts) < ENOUGH:
            limits.append(limits[-1])
            continue
        cosines = np.concatenate([(vectors(c, idf) @ centroids.T).max(axis=1) for c in gram_counts(texts)])
        limits.append(max(limits[-1], float(np.quantile(cosines, 0.01)) * NEAR))
    return limits


def fold(docs: DataFrame):
    """Whether a row is held out; a null doc_id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def fit(docs: DataFrame) -> dict:
    """Idf and centroids from text and lang of the training rows; plain arrays, a few per language."""
    train = docs.select("doc_id", "text", "lang").filter(~fold(docs) & F.col("text").rlike(r"\p{L}"))
    rows = train.select("text").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    n = {r["slot"]: r["n"] for r in rows}
    idf = np.log((1 + n.get(-1, 0)) / (1 + np.array([n.get(i, 0) for i in range(DIMENSIONS)]))) + 1
    idf = idf.astype(np.float32)

    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "version"), "doc_id", "version")
    versioned = train.filter("lang IS NOT NULL").withColumn("version", F.xxhash64("text"))
    chosen = versioned.select("doc_id", "version", "lang").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE)
    picked = stored(chosen.select("doc_id", "version", "lang"), "sample")
    # At most SAMPLE rows per language, so the hint is bounded.
    sample = versioned.join(F.broadcast(picked), ["doc_id", "version", "lang"], "left_semi").dropDuplicates(["doc_id", "version", "lang"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("version", "ascending")])
        x = np.concatenate([vectors(c, idf) for c in gram_counts(table["text"])])
        centroids, cosines = kmeans(x, CENTROIDS)
        least = [float(np.quantile(cosines.max(axis=1), 0.01))] * len(centroids)
        limits = rising_limits(table["text"], idf, centroids, max(least[0] * REACH, LEAST_COSINE))
        lang = table["lang"][0].as_py()
        del x
        trim()
        return pa.table({"lang": pa.array([lang] * len(centroids), pa.string()), "least": pa.array(least, pa.float64()), "limits": pa.array([limits] * len(centroids), pa.list_(pa.float64())), "centroid": pa.array([c.astype("<f4").tobytes() for c in centroids], pa.binary())})

    found = sample.select("doc_id", "version", "lang", "text").groupBy("lang").applyInArrow(learn, "lang string, least double, limits array<double>, centroid binary").collect()
    found = sorted(found, key=lambda r: (r["lang"], bytes(r["centroid"])))
    matrix = np.stack([np.frombuffer(bytes(r["centroid"]), "<f4") for r in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
    return {"idf": idf, "centroids": matrix, "langs": [r["lang"] for r in found], "least": np.array([r["least"] for r in found]), "limits": [r["limits"] for r in found]}


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def predictor(model: dict):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model["langs"], UNKNOWN], object)
        steps = np.log2([LENGTHS[0] / 2, *LENGTHS])
        for batch in batches:
            known = has_letter(batch.column(2)) & (len(model["langs"]) > 0)
            best, cosine = np.full(len(batch), len(langs) - 1), np.zeros(len(batch))
            at = 0
            for counts in gram_counts(batch.column(2)) if len(model["langs"]) else ():
                near = vectors(counts, model["idf"]) @ model["centroids"].T
                best[at : at + len(counts)] = near.argmax(axis=1)
                cosine[at : at + len(counts)] = near.max(axis=1)
                at += len(counts)
            best[~known], cosine[~known] = len(langs) - 1, 0.0
            cosine = np.clip(cosine.astype(np.float64), 0.0, 1.0)
            size = np.log2(np.maximum(np.asarray(pc.fill_null(pc.utf8_length(batch.column(2)), 0)), 1))
            limit = np.full(len(batch), 2.0)
            for k, limits in enumerate(model["limits"]):
                limit[best == k] = np.interp(size[best == k], steps, limits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs[best].tolist(), pa.string()), pa.array(cosine), pa.array(cosine < limit)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )
        trim()

    return predict


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per document: PREDICTED.

    A null text, or one without a letter of any script, is ``und`` with score
    0 and rejected; so is every text when nothing could be learned. A null
    doc_id is held out and still gets a prediction. Ties go to the first
    language in alphabetical order.
    """
    model = model or fit(docs)
    return docs.select("doc_id", fold(docs).alias("held_out"), "text").mapInArrow(predictor(model), PREDICTED)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected."""
    model = fit(docs)
    judge = predictor(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            three = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.bool_()), batch.column(batch.schema.get_field_index("text"))], ["doc_id", "held_out", "text"])
            for found in judge(iter([three])):
                yield batch.filter(pc.invert(found.column(4)))

    return docs.mapInArrow(keep, docs.schema)
