"""Repeated runs of lines by winnowing.

A line's key is its text without surrounding white space; blank lines do not
count. A run is at least RUN_WORDS words or WINDOW_LINES lines long, a single
line of so many words among them. A window is a least run: it starts at a line
and ends at the first line that makes it long enough, or ends at a line and
starts at the last one that does, so its extent depends on its own lines alone
and the windows of both kinds inside a maximal run cover all of it. The least
line hash of a window is its fingerprint, a guaranteed one: wherever the window
occurs, the same line is chosen. Occurrences of fingerprints that occur once
are dropped; from the others the match is extended both ways over all windows
around the chosen line, every such window is compared with its first place
(smallest doc_id, then smallest line), and the lines of windows that start
earlier somewhere are deleted, so that the whole later run goes. A line of
fewer words goes by itself when SHARED documents hold it and it stands earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from relyframe.llm.store import sized, stored
from relyframe.llm.text import _SYMBOL, U64, mix, shingles, span_hash, trim, words

WINDOW_LINES = 3
RUN_WORDS, SHARED = 4, 20

# One row per chosen line: the windows it stands for begin at the lines `starts`.
FINGERPRINTS = "fingerprint long, doc_id long, version long, starts array<int>, sizes array<int>, h1 array<long>, h2 array<long>, few array<boolean>, lines array<array<int>>"


def _lines(w) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece's non-blank lines: row, number within the row, words, hash."""
    breaks = np.concatenate(([0], np.cumsum(w.bytes == 10)))
    number = breaks[w.start] - breaks[w.offsets[w.row]]
    first = np.flatnonzero((np.diff(w.row, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    last = np.append(first[1:], len(number)) - 1
    return w.row[first], number[first], last - first + 1, span_hash(_SYMBOL[w.bytes], w.start[first], w.end[last])


def _windows(row: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes in lines of all windows that are complete."""
    n = len(row)
    size = np.zeros(n, np.int64)
    total = np.zeros(n, np.int64)
    for k in range(1, WINDOW_LINES + 1):
        at = np.arange(n - k + 1)
        at = at[(size[: n - k + 1] == 0) & (row[at] == row[at + k - 1])] if len(at) else at
        total[at] += n_words[at + k - 1]
        size[at[(total[at] >= RUN_WORDS) | (k == WINDOW_LINES)]] = k
    start = np.flatnonzero(size)
    return start, size[start]


def _all_windows(row: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least windows from each line on and up to each line, and every line of few words by itself."""
    start, size = _windows(row, n_words)
    back, back_size = _windows(row[::-1], n_words[::-1])
    few = np.flatnonzero(n_words < RUN_WORDS)
    start = np.concatenate((start, len(row) - back - back_size, few))
    size = np.concatenate((size, back_size, np.ones(len(few), np.int64)))
    both = np.unique(start * (WINDOW_LINES + 1) + size)
    return both // (WINDOW_LINES + 1), both % (WINDOW_LINES + 1)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, versions = batch.column(0), batch.column(1)
        for w in words(batch.column(2)):
            if not len(w.hash):
                continue
            row, number, n_words, h = _lines(w)
            start, size = _all_windows(row, n_words)
            if not len(start):
                continue
            chosen, h1, h2 = start.copy(), np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
            again = mix(h ^ U64(0x1F83D9ABFB41BD6B))
            for k in range(1, WINDOW_LINES + 1):
                of = np.flatnonzero(size >= k)
                better = of[h[start[of] + k - 1] < h[chosen[of]]]
                chosen[better] = start[better] + k - 1
                same = np.flatnonzero(size == k)
                h1[same], h2[same] = shingles(h, k)[start[same]], shingles(again, k)[start[same]]
            order = np.argsort(chosen, kind="stable")
            chosen, start, size, h1, h2 = chosen[order], start[order], size[order], h1[order], h2[order]
            head = np.flatnonzero(np.diff(chosen, prepend=-1))
            at = pa.array(np.append(head, len(chosen)), pa.int32())
            inner = np.concatenate(([0], np.cumsum(size)))
            member = np.repeat(start - inner[:-1], size) + np.arange(inner[-1])
            covered = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(number[member], pa.int32()))
            lists = [pa.ListArray.from_arrays(at, v) for v in (pa.array(number[start], pa.int32()), pa.array(size, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), covered)]
            few = (size == 1) & (n_words[start] < RUN_WORDS)
            lists.insert(4, pa.ListArray.from_arrays(at, pa.array(few)))
            rows = pa.array(w.first + row[chosen[head]])
            yield pa.RecordBatch.from_arrays([pa.array(h[chosen[head]].view(np.int64)), ids.take(rows), versions.take(rows), *lists], ["fingerprint", "doc_id", "version", "starts", "sizes", "h1", "h2", "few", "lines"])
    trim()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, version, lines): the numbers, from 0, of the lines to delete; stored."""
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text")
    prints = stored(texts.mapInArrow(_fingerprints, FINGERPRINTS), "fingerprints")
    # A window can repeat inside one choice: several windows count as two places.
    often = prints.groupBy("fingerprint").agg(F.sum(F.size("starts")).alias("n")).filter("n > 1").select("fingerprint")
    near = prints.join(often, "fingerprint", "left_semi")
    windows = stored(
        near.select("doc_id", "version", F.explode(F.arrays_zip("starts", "h1", "h2", "few", "lines")).alias("w"))
        .select("doc_id", "version", "w.starts", "w.h1", "w.h2", "w.few", "w.lines"),
        "windows",
    )
    place = F.struct("doc_id", F.col("starts").alias("start"))
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("few").alias("few")).filter("n > 1").select("h1", "h2", "few", "first")
    shared = windows.filter("few").select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED)
    first = first.filter("NOT few").union(first.filter("few").join(shared, ["h1", "h2"], "left_semi"))
    late = windows.join(first.drop("few"), ["h1", "h2"]).filter(place > F.col("first"))
    runs = late.select("doc_id", "version", F.explode("lines").alias("line")).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return stored(runs, "runs")


def _delete(batches: Iterator[pa.RecordBatch], count_as: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        gone_at = batch.schema.get_field_index("relyframe_lines")
        texts = []
        for text, gone in zip(batch.column(at), batch.column(gone_at), strict=True):
            text, gone = text.as_py(), gone.as_py()
            if gone:
                drop = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns) if i != gone_at]
        names = [f.name for i, f in enumerate(batch.schema) if i != gone_at]
        if count_as:
            columns.append(pc.fill_null(pc.list_value_length(batch.column(gone_at)), 0).cast(pa.int32()))
            names.append(count_as)
        yield pa.RecordBatch.from_arrays(columns, names)
    trim()


def dedup_lines(docs: DataFrame, count_as: str | None = None) -> DataFrame:
    """The rows of docs, all columns, with repeated runs of lines deleted from ``text``; ``count_as`` names a column for their number.

    Null and blank texts stay as they are, and so do rows with a null doc_id.
    Rows of one doc_id with equal texts are one document and keep their lines.
    Blank lines are never deleted. A text whose lines all repeat becomes what
    its blank lines leave, at least the empty text.
    """
    runs = repeated_lines(docs)
    keyed = docs.withColumn("relyframe_version", F.xxhash64("text"))
    lines = sized(runs).select(F.col("doc_id").alias("relyframe_id"), F.col("version").alias("relyframe_version"), F.col("lines").alias("relyframe_lines"))
    joined = keyed.join(lines, (keyed["doc_id"] == lines["relyframe_id"]) & (keyed["relyframe_version"] == lines["relyframe_version"]), "left")
    return joined.select(*[keyed[f"`{c}`"] for c in docs.columns], "relyframe_lines").mapInArrow(
        lambda batches: _delete(batches, count_as), StructType([*docs.schema.fields, *([StructField(count_as, IntegerType())] if count_as else [])])
    )
