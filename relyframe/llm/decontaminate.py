"""Benchmark decontamination over canonical templates.

Numbers, names and units become typed placeholders, so a question that was
asked again with other values keeps its template. Windows of template tokens of
benchmark items and documents meet in a hash join; matched windows on one
diagonal (document place minus item place) form an alignment, and each value
of the item behind a placeholder must always stand for the same value in the
document. Windows of an alignment that is not consistent count only as
far as they hold no placeholder. Every window with placeholders is also joined
by its own tokens, so that a verbatim copy is found whatever it is made of. A
token is a word, a number, or one character of a script without spaces. Items
shorter than a window are one window, with placeholders as well.

Capitalised words are typed in two ways: those that open a sentence are words,
or they are names too and names side by side (with particles such as "van"
before them) are one placeholder. Each way has its own alignments; those of the
second are formed on one diagonal and on diagonals that differ by up
to DRIFT tokens, as values of another length shift what follows them.

A document is contaminated by an item if the best alignment covers at least
COVER of the item's tokens and at least LEAST tokens (or the whole item, if it
is shorter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.llm.store import sized, stored
from relyframe.llm.text import _SYMBOL, LOWER, U64, buffers, mix, pieces, shingles, span_hash, trim

WINDOW = 8
# Literal tokens that a template needs: of a window, and of a whole item that is shorter (of it also half).
LITERALS, SHORT_LITERALS = 4, 3
LEAST, COVER = 13, 0.5
SHORTEST = 3
# Diagonals at most this far apart add up.
DRIFT = 16
# The benchmark's window hashes are sent to the tasks as a filter while they are this few; beyond, all windows go to the join.
FILTER_ROWS = 2_000_000
# Unit words.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs oz gram grams kilogram kilograms "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ml cl dl l liter liters litre litres "
    "hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n pa kpa bar k c f degree degrees percent dollar dollars euro euros cent cents usd eur gbp"
).split()
PARTICLES = "van von der den de del della di da dos du la le el al bin ibn zu zur".split()
# The typing that a window belongs to.
BOTH, FIRST, SECOND = 0, 1, 2
NUMBER, NAME, UNIT = U64(0x11), U64(0x22), U64(0x33)

_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True
_JOINT = np.zeros(256, bool)
_JOINT[[32, 39, 45]] = True


def _hashes(fixed: list[str]) -> np.ndarray:
    data = "".join(fixed).encode()
    end = np.cumsum([len(u) for u in fixed])
    start = end - [len(u) for u in fixed]
    return np.sort(span_hash(_SYMBOL[np.frombuffer(data, np.uint8)], start, end))


def _is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _folded(own: np.ndarray, slot: np.ndarray, names: np.ndarray, joined: np.ndarray, particle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens, values and kinds when names side by side are one token; ``joined`` tells which tokens follow the one before directly."""
    part = names.copy()
    for _ in range(2):  # up to two particles before a name
        part[:-1] |= particle[:-1] & part[1:] & joined[1:]
    head = np.flatnonzero(~(part & np.concatenate(([False], part[:-1])) & joined))
    value = np.add.reduceat(mix(own), head)
    size = np.diff(np.append(head, len(own)))
    kind = np.where(part[head], np.uint8(2), slot[head]).astype(np.uint8)
    return head, np.where(size > 1, value, own[head]), kind


def templates(column: pa.Array) -> Iterator[tuple]:
    """Per piece of a column: first row, rows, and of every token its row, template hash, own hash, whether it is a placeholder; then the folded tokens' first tokens, values and kinds."""
    data, offsets = buffers(column)
    units, particles = _hashes(UNITS), _hashes(PARTICLES)
    for lo, hi in pieces(offsets):
        base = offsets[lo]
        b = data[base : offsets[hi]]
        cut = offsets[lo : hi + 1] - base
        kind = _KIND[b]
        if len(b) > 2:
            digit = kind == 2
            joint = ((b[1:-1] == 46) | (b[1:-1] == 44)) & digit[:-2] & digit[2:]
            kind[1:-1][joint] = 2
        # Scripts without spaces, whose characters are three bytes: every character is a token.
        lead = (b >= 0xE3) & (b <= 0xED)
        wide = lead.copy()
        wide[1:] |= lead[:-1]
        wide[2:] |= lead[:-2]
        kind[wide] = 4
        edge = np.zeros(len(b) + 1, bool)
        edge[cut] = True
        new = edge[:-1] | lead
        new[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(new & (kind > 0))
        stop = np.append(np.flatnonzero(new), len(b))
        end = stop[np.searchsorted(stop, start, side="right")]
        row = np.searchsorted(cut, start, side="right") - 1
        own = span_hash(_SYMBOL[LOWER[b]], start, end)
        slot = np.zeros(len(start), np.uint8)
        number = kind[start] == 2
        slot[number] = 1
        folded = np.zeros(0, np.int64), own, slot
        if len(start):
            before = np.concatenate(([False], number[:-1] & (row[1:] == row[:-1])))
            slot[~number & before & _is_in(own, units)] = 3
            stops = np.concatenate(([0], np.cumsum(_STOP[b])))
            opens = np.concatenate(([True], (row[1:] != row[:-1]) | (stops[start[1:]] > stops[end[:-1]])))
            second = b[np.minimum(start + 1, len(b) - 1)]
            capital = ((b[start] >= 65) & (b[start] <= 90)) | ((b[start] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            names = (slot == 0) & ~number & capital & (end - start > 1)
            slot[names & ~opens] = 2
            joined = np.concatenate(([False], (row[1:] == row[:-1]) & (start[1:] - end[:-1] == 1) & _JOINT[b[end[:-1].clip(max=len(b) - 1)]]))
            folded = _folded(own, slot, names, joined, _is_in(own, particles))
        yield lo, hi - lo, row, _template(own, slot), own, slot, *folded


def _template(own: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return np.select([slot == 1, slot == 2, slot == 3], [NUMBER, NAME, UNIT], own)


def _alike(start: np.ndarray, size: int, slot: np.ndarray) -> np.ndarray:
    """Whether a window has enough literal tokens to tell anything."""
    literal = np.concatenate(([0], np.cumsum(slot == 0)))
    return literal[start + size] - literal[start] >= (LITERALS if size >= WINDOW else max(SHORT_LITERALS, -(-size // 2)))


WINDOWS = "id long, version long, size int, window long, at int, span int, typing int, slot_values array<long>"
_ARROW = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("size", pa.int32()), ("window", pa.int64()), ("at", pa.int32()), ("span", pa.int32()), ("typing", pa.int32()), ("slot_values", pa.list_(pa.int64()))])


def _rows(ids: pa.Array, versions: pa.Array, doc: np.ndarray, size: int, start: np.ndarray, at: np.ndarray, span: np.ndarray, typing: np.ndarray, hashes: np.ndarray, own: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    inside = start[:, None] + np.arange(size)
    held = slot[inside] > 0
    upto = pa.array(np.concatenate(([0], np.cumsum(held.sum(axis=1)))), pa.int32())
    typed = mix(own[inside[held]] ^ slot[inside[held]].astype(np.uint64))
    doc = pa.array(doc)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(doc), versions.take(doc), pa.array(np.full(len(start), size), pa.int32()), pa.array(hashes.view(np.int64)), pa.array(at, pa.int32()), pa.array(span, pa.int32()),
            pa.array(typing, pa.int32()), pa.ListArray.from_arrays(upto, pa.array(typed.view(np.int64))),
        ],
        schema=_ARROW,
    )


def _starts(row: np.ndarray, size: int, whole_only: bool) -> np.ndarray:
    n = len(row) - size + 1
    start = np.flatnonzero(row[: max(n, 0)] == row[size - 1 :])
    if whole_only and size < WINDOW:
        start = start[np.bincount(row)[row[start]] == size]
    return start


def window_rows(sizes: list[int], wanted: np.ndarray | None, whole_only: bool = False):
    """Windows of the given sizes: all, or those whose hash is in ``wanted``; with ``whole_only`` a size below WINDOW only as a whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, row, token, own, slot, head, value, kind in templates(batch.column(2)):
                begin = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=count))))
                every, place = np.arange(len(row)), np.append(head, len(row))
                other = (kind != slot[head]) | (np.diff(place) > 1)
                changed = np.concatenate(([0], np.cumsum(other)))
                narrow = np.concatenate(([0], np.cumsum(np.repeat(other, np.diff(place)))))
                held = np.concatenate(([0], np.cumsum(slot > 0)))
                for size in sizes:
                    # Windows by their template, those with placeholders by their own tokens, and those that the second typing changes.
                    start = _starts(row, size, whole_only)
                    ways = [(start[_alike(start, size, slot)], row, token, own, slot, every, FIRST)]
                    ways.append((start[held[start + size] > held[start]], row, own, own, np.zeros_like(slot), every, BOTH))
                    start = _starts(row[head], size, whole_only)
                    start = start[changed[start + size] > changed[start]]
                    ways.append((start[_alike(start, size, kind)], row[head], _template(value, kind), value, kind, place, SECOND))
                    for start, of, by, values, kinds, to, typed in ways:
                        hashes = shingles(by, size)[start]
                        if wanted is not None and len(start):
                            hit = _is_in(hashes, wanted)
                            start, hashes = start[hit], hashes[hit]
                        if len(start):
                            first_token = to[start]
                            last = to[start + size] if typed == SECOND else start + size
                            typing = np.full(len(start), typed)
                            if typed == FIRST:
                                typing[narrow[start + size] == narrow[start]] = BOTH
                            yield _rows(batch.column(0), batch.column(1), first + of[start], size, start, first_token - begin[of[start]], last - first_token, typing, hashes, values, kinds)
        trim()

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, count, row, *_ in templates(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), pa.array(np.bincount(row, minlength=count), pa.int32())], ["item_id", "item_tokens"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, version, item_id, covered, item_tokens, slots, consistent) of contaminated documents, stored.

    Null and blank texts match nothing, nor do items below 3 tokens or null
    ids. Items shorter than a window are looked for as a whole. Repeated rows
    give one result; the version tells texts of one doc_id apart.
    """
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    lengths = items.mapInArrow(_lengths, "item_id long, item_tokens int").groupBy("item_id").agg(F.max("item_tokens").alias("item_tokens")).filter(f"item_tokens >= {SHORTEST}")
    lengths = stored(lengths, "items")
    sizes = [*range(SHORTEST, WINDOW), WINDOW]
    bench = stored(items.select("item_id", F.xxhash64("text").alias("version"), "text").mapInArrow(window_rows(sizes, None, whole_only=True), WINDOWS).drop("version"), "windows")
    asked = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most WINDOW values
    n = bench.count()
    wanted = None
    if n <= FILTER_ROWS:
        wanted = np.unique(np.array([r["window"] for r in bench.select("window").distinct().collect()], np.int64).view(np.uint64)) if n else np.zeros(1, np.uint64)
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text")
    own = texts.mapInArrow(window_rows(asked, wanted), WINDOWS)
    left = own.select(F.col("id").alias("doc_id"), "version", "size", "window", F.col("at").alias("doc_at"), F.col("typing").alias("doc_typing"), F.col("slot_values").alias("doc_values"))
    right = bench.select(F.col("id").alias("item_id"), "size", "window", F.col("at").alias("item_at"), "span", "typing", F.col("slot_values").alias("item_values"))
    met = left.join(right, ["size", "window"]).filter(F.size("item_values") == F.size("doc_values")).withColumn("diagonal", F.col("doc_at") - F.col("item_at"))
    # Kinds of alignments: 0 and 1 on one diagonal by the first and the second typing; 2 by the second in overlapping bands, of which one holds any diagonals within DRIFT.
    band = F.floor(F.col("diagonal") / DRIFT).cast("int")
    kinds = [F.struct(F.lit(kind).alias("kind"), on.alias("on")) for kind, on in ((0, F.col("diagonal")), (1, F.col("diagonal")), (2, band), (2, band + 1))]
    fits = [(F.col("typing") != t) & (F.col("doc_typing") != t) for t in (SECOND, FIRST)]
    ways = F.concat(F.when(fits[0], F.array(kinds[0])).otherwise(F.filter(F.array(*kinds[:1]), lambda k: F.lit(False))), F.when(fits[1], F.array(*kinds[1:])).otherwise(F.filter(F.array(*kinds[:1]), lambda k: F.lit(False))))
    spread = met.withColumn("way", F.explode(ways))
    # One alignment holds at most as many windows as its item, for each way of typing and each diagonal.
    aligned = spread.groupBy("doc_id", "version", "item_id", "way").agg(
        F.collect_set(F.struct("item_at", "span", F.size("item_values").alias("n"))).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_values", "doc_values")))).alias("pairs"),
    )
    one_value = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_values"]))) == F.size("pairs")
    counted = aligned.withColumn("consistent", one_value).withColumn("windows", F.when(F.col("consistent"), F.col("windows")).otherwise(F.filter("windows", lambda w: w["n"] == 0)))
    places = F.flatten(F.transform("windows", lambda w: F.sequence(w["item_at"], w["item_at"] + w["span"] - 1)))
    covered = counted.select("doc_id", "version", "item_id", F.size(F.array_distinct(places)).alias("covered"), F.size("pairs").alias("slots"), "consistent")
    best = covered.groupBy("doc_id", "version", "item_id").agg(F.max(F.struct("covered", "consistent", "slots")).alias("b")).select("doc_id", "version", "item_id", "b.*")
    judged = best.join(lengths, "item_id").filter((F.col("covered") >= F.col("item_tokens") * COVER) & (F.col("covered") >= F.least(F.col("item_tokens"), F.lit(LEAST))))
    return stored(judged.select("doc_id", "version", "item_id", "covered", "item_tokens", "slots", "consistent"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that no benchmark item contaminates; rows with a null doc_id stay."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("relyframe_id"), F.col("version").alias("relyframe_version")).distinct()
    return docs.join(sized(found), (docs["doc_id"] == F.col("relyframe_id")) & (F.xxhash64(docs["text"]) == F.col("relyframe_version")), "left_anti")
