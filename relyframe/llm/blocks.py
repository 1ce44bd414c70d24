"""Texts in compressed blocks that ask hash buckets about what they contain.

A corpus-wide count or lookup of every n-gram would shuffle one row per
occurrence. Here each block of documents sends the distinct hashes it holds,
cut by hash range into one binary per bucket; a bucket combines the parts of
all blocks and answers each part in its order; a block later reads the answers
next to its text. So hot n-grams arrive once per block, buckets are even by
hash, and both sides are bounded by the block size, whatever the corpus holds.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from relyframe.llm.store import stored

BLOCK_BYTES = 6 << 20
BLOCK = "block long, payload binary"
PART = "kind int, bucket int, block long, part binary"
PART_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("part", pa.binary())])


def dump(value) -> bytes:
    return zstandard.ZstdCompressor(3).compress(pickle.dumps(value, protocol=5))


def load(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _block_row(table: pa.Table) -> pa.RecordBatch:
    name = uuid.uuid4().int >> 65
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([_pack(table)], pa.binary())], ["block", "payload"])


def make_blocks(docs: DataFrame, label: str, apart: str | None = None) -> DataFrame:
    """Rows (block, payload), stored: about BLOCK_BYTES of text each, whatever the number of documents.

    Rows whose boolean column ``apart`` holds get blocks of their own, named
    by negative numbers. Block names are drawn once; the table is stored
    before anything reads them.
    """
    at = docs.columns.index("text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.Table]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def close(side: bool) -> pa.RecordBatch:
            row = _block_row(pa.concat_tables(held[side]))
            held[side], size[side] = [], 0
            if side:
                row = row.set_column(0, "block", pa.array([-1 - row.column(0)[0].as_py()], pa.int64()))
            return row

        for batch in batches:
            table = pa.Table.from_batches([batch])
            sides = {False: table} if apart is None else {v: table.filter(pc.equal(table[apart], v)) for v in (False, True)}
            for side, rows in sides.items():
                upto = np.cumsum(pc.fill_null(pc.binary_length(rows.column(at)), 0).to_numpy().astype(np.int64))
                lo = 0
                while lo < len(rows):
                    before = upto[lo - 1] if lo else 0
                    hi = min(len(rows), int(np.searchsorted(upto, before + BLOCK_BYTES - size[side])) + 1)
                    held[side].append(rows.slice(lo, hi - lo))
                    size[side] += int(upto[hi - 1] - before)
                    lo = hi
                    if size[side] >= BLOCK_BYTES:
                        yield close(side)
        for side in (False, True):
            if held[side]:
                yield close(side)

    return stored(docs.mapInArrow(build, BLOCK), label)


def split(kind: int, block: int, hashes: np.ndarray, buckets: int, parts: Callable[[slice], bytes]) -> pa.RecordBatch:
    """Rows (kind, bucket, block, part) of one block: ``hashes`` ascend, ``parts`` encodes a slice of them."""
    bucket = bucket_of(hashes, buckets)
    lo = np.flatnonzero(np.diff(bucket, prepend=-1))
    hi = np.append(lo[1:], len(hashes))
    full = bucket[lo].tolist()
    rows = [parts(slice(int(a), int(z))) for a, z in zip(lo, hi, strict=True)]
    n = len(full)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(full, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(rows, pa.binary())], schema=PART_ARROW)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def six_bytes(hashes: np.ndarray) -> bytes:
    """The low 48 bits; with the bucket, which the high bits choose, 48 bits and the logarithm of the bucket number stay."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(parts: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).reshape(-1)


def ask(blocks: DataFrame, question: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from question(block, unpack(payload.as_py()))
                pa.default_memory_pool().release_unused()

    return blocks.mapInArrow(run, PART)


def answer(parts: DataFrame, reply: Callable[[list[int], list[bytes]], list[bytes]], label: str) -> DataFrame:
    """Every part's reply, from one call per kind and bucket; stored."""

    def run(table: pa.Table) -> pa.Table:
        back = reply(table["block"].to_pylist(), table["part"].to_pylist())
        return pa.table([table["kind"], table["bucket"], table["block"], pa.array(back, pa.binary())], schema=PART_ARROW)

    return stored(parts.groupBy("kind", "bucket").applyInArrow(run, PART), label)


def meet(blocks: DataFrame, answers: DataFrame, use: Callable[[int, bytes, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Call ``use(block, payload, answers)`` for every block, next to its answers."""

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(use(left["block"][0].as_py(), left["payload"][0].as_py(), right)) if len(left) else []
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(found) if found else empty

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def bucket_count(blocks: DataFrame) -> int:
    """As many buckets as blocks, so that a bucket's share stays about a block's."""
    return max(8, blocks.select(F.count("*")).first()[0])
