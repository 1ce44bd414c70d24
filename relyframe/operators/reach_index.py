"""Strongly connected components, and a reachability index that answers tables of roots without walking.

Nodes of one component reach the same nodes, so only the condensed graph counts.
Its components are numbered along a spanning forest such that each one's nodes
take consecutive places and a component's descendants in the forest follow it
without gaps; what a component reaches is then a short list of ranges of places,
joined from the lists of its successors. Counts are lengths of ranges, and no
(root, node) pair is formed before it is asked for.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from relyframe.operators.quantiles import rank_in_groups
from relyframe.session import settle

# Links of a graph that one task takes, and ranges that it holds, at 16 bytes each.
ONE_TASK = 1_000_000
MOST_RANGES = 10_000_000
# Rows of an answer that are sent at a time.
SENT_ROWS = 50_000


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = pa.Table.from_batches(held)
    return tuple(t.column(i).to_numpy() for i in (0, 1))


def _numbers(values: np.ndarray) -> array:
    """Numbers for loops: eight bytes each, where a list holds an object for each."""
    return array("q", np.ascontiguousarray(values, np.int64).tobytes())


def _outgoing(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[array, array]:
    """Where each node's successors begin in the list of all successors."""
    order = np.argsort(src, kind="stable")
    return _numbers(np.searchsorted(src[order], np.arange(n + 1))), _numbers(dst[order])


def tarjan(n: int, src: np.ndarray, dst: np.ndarray) -> array:
    """Component number of each of n nodes; a component's number is above those of all that it reaches."""
    begin, to = _outgoing(n, src, dst)
    at, low, number, found = begin[:-1], array("q", bytes(8 * n)), array("q", bytes(8 * n)), array("q", [-1]) * n
    clock, count, path, open_ = 0, 0, array("q"), array("q")
    for start in range(n):
        if number[start]:
            continue
        path.append(start)
        while path:
            v = path[-1]
            if not number[v]:
                clock += 1
                number[v] = low[v] = clock
                open_.append(v)
            if at[v] < begin[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not number[w]:
                    path.append(w)
                elif found[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
                continue
            path.pop()
            if low[v] == number[v]:
                while True:
                    w = open_.pop()
                    found[w] = count
                    if w == v:
                        break
                count += 1
            if path and found[v] < 0 and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
    return found


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    src, dst = _rows(batches)
    if len(src):
        nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
        comp = np.frombuffer(tarjan(len(nodes), ends[: len(src)], ends[len(src) :]), np.int64)
        name = np.zeros(comp.max() + 1, np.int64)
        np.maximum.at(name, comp, np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[name[comp]])], ["node", "component"])


def _typed(edges: DataFrame, *names: str) -> StructType:
    return StructType([StructField(c, edges.schema["src"].dataType) for c in names])


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the largest node of each node's strongly connected component.

    Graphs of up to ONE_TASK links are done by one task. Larger ones lose nodes
    without a way in or out, then every node takes the largest node that reaches
    it as its colour, and what reaches that node within the colour is its
    component; links between colours go, and the rest is done again. Links with
    a null end are left out.
    """
    edges = settle(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    nodes = _nodes(edges)
    live, done = settle(edges.where("src <> dst")), None
    size = live.count()
    while size > ONE_TASK:
        ways_out, ways_in = live.select(F.col("src").alias("dst")).distinct(), live.select(F.col("dst").alias("src")).distinct()
        trimmed = settle(live.join(ways_out, "dst", "left_semi").join(ways_in, "src", "left_semi").select("src", "dst"))
        before, size = size, trimmed.count()
        live = trimmed
        if size < 0.9 * before:
            continue
        colour = settle(_nodes(live).withColumn("colour", F.col("node")))
        while True:
            seen = live.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("seen"))
            step = settle(colour.join(seen, "node", "left").select("node", F.greatest("colour", "seen").alias("colour"), (F.col("seen") > F.col("colour")).alias("up")))
            colour = step.select("node", "colour")
            if not step.where("up").take(1):
                break
        ends = live.join(colour.toDF("src", "colour"), "src").join(colour.toDF("dst", "other"), "dst").where("colour = other")
        same = settle(ends.select("src", "dst", "colour"))
        member = fresh = settle(colour.where("node = colour"))
        while fresh.take(1):
            back = same.join(fresh.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "colour").distinct()
            fresh = settle(back.join(member, "node", "left_anti"))
            member = settle(member.union(fresh))
        found = member.select("node", F.col("colour").alias("component"))
        done = found if done is None else done.union(found)
        gone = member.select("node")
        live = same.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        live = settle(live.select("src", "dst"))
        size = live.count()
    found = settle(live.coalesce(1).mapInArrow(_local, _typed(edges, "node", "component")))
    done = found if done is None else done.union(found)
    return settle(nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps or neighbours."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def ranges_of(n: int, src: np.ndarray, dst: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """First place of each node of an acyclic graph, and the ranges of places that it reaches, its own first; None above ``most`` ranges.

    Ranges are numbers in a row: node v's are those from the second array's v-th
    to the third's, of the fourth, a low and a high one after the other.
    """
    order = _numbers(np.argsort(np.frombuffer(tarjan(n, src, dst), np.int64)))  # successors first
    begin, to = _outgoing(n, src, dst)
    # Each node hangs below one of its predecessors; a walk through this forest gives the places.
    parent = array("q", [-1]) * n
    for v in reversed(order):
        for i in range(begin[v], begin[v + 1]):
            if parent[to[i]] < 0:
                parent[to[i]] = v
    above = np.frombuffer(parent, np.int64)
    child = np.flatnonzero(above >= 0)
    below_at, below = _outgoing(n, above[child], child)
    first, end, width, place = array("q", bytes(8 * n)), array("q", bytes(8 * n)), _numbers(size), 0
    for root in np.flatnonzero(above < 0).tolist():
        path = array("q", [root])
        while path:
            v = path.pop()
            if v < 0:
                end[~v] = place
                continue
            first[v] = place
            place += width[v]
            path.append(~v)
            path.extend(below[below_at[v] : below_at[v + 1]])
    lows, highs, held = array("q", bytes(8 * n)), array("q", bytes(8 * n)), array("q")
    for v in order:
        lo, hi = first[v], end[v]
        mine = [(lo, hi)]
        for i in range(begin[v], begin[v + 1]):
            w = to[i]
            for k in range(lows[w], highs[w], 2):
                if parent[w] != v or not (lo <= held[k] and held[k + 1] <= hi):
                    mine.append((held[k], held[k + 1]))
        lows[v] = len(held)
        for r in mine if len(mine) == 1 else _joined(mine):
            held.extend(r)
        highs[v] = len(held)
        if len(held) > 2 * most:
            return None
    return tuple(np.frombuffer(x, np.int64) for x in (first, lows, highs, held))


def _sent(names: np.ndarray, first: np.ndarray, size: np.ndarray, loop: np.ndarray, meets: np.ndarray, lows: np.ndarray, highs: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of RANGES, a batch at a time."""
    at = 0
    counts = (highs - lows) // 2
    while at < len(names):
        # As many rows as hold up to SENT_ROWS ranges, one at least.
        part = slice(at, at + max(1, int(np.searchsorted(np.cumsum(counts[at : at + SENT_ROWS]), SENT_ROWS, side="right"))))
        n = counts[part]
        upto = np.concatenate(([0], np.cumsum(n)))
        own = np.repeat(lows[part] - 2 * upto[:-1], n) + 2 * np.arange(upto[-1])
        lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(held[own + side])) for side in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[part]), pa.array(first[part]), pa.array(size[part]), pa.array(loop[part]), pa.array(meets[part]), *lists],
            ["component", "first", "size", "loops", "meets", "lo", "hi"],
        )
        at = part.stop


RANGES = "first long, size long, loops boolean, meets boolean, lo array<long>, hi array<long>"


@dataclass(frozen=True)
class ReachIndex:
    """``parts``: component, first place, size, whether it is a cycle and whether it meets one, the ranges it reaches; ``places``: place, node, component. Both stored."""

    parts: DataFrame
    places: DataFrame

    def counts(self) -> DataFrame:
        """Rows (node, reached, itself): distinct nodes at the end of a path of at least one link, and whether the node is one of them."""
        width = F.aggregate(F.zip_with("lo", "hi", lambda a, z: z - a), F.lit(0).cast("long"), lambda t, x: t + x)
        n = self.parts.select("component", F.when(F.col("loops"), width).otherwise(width - 1).alias("reached"), F.col("loops").alias("itself"))
        return self.places.select("node", "component").join(n, "component").select("node", "reached", "itself")

    def meets_cycle(self) -> DataFrame:
        """Rows (node, meets_cycle): whether a walk from the node can come to a cycle."""
        return self.places.join(self.parts.select("component", F.col("meets").alias("meets_cycle")), "component").select("node", "meets_cycle")

    def pairs(self, roots: DataFrame) -> DataFrame:
        """(root, node) for every root of ``roots``: work in proportion to the pairs."""
        asked = roots.select("root").distinct().join(self.places.select(F.col("node").alias("root"), "place", "component"), "root")
        met = asked.join(self.parts, "component")
        span = F.explode(F.transform(F.arrays_zip("lo", "hi"), lambda r: F.sequence(r["lo"], r["hi"] - 1)))
        wide = met.select("root", F.col("place").alias("own"), "loops", span.alias("span")).select("root", "own", "loops", F.explode("span").alias("place"))
        return wide.where("loops OR place <> own").join(self.places.select("place", "node"), "place").select("root", "node")


def build_index(edges: DataFrame, most: int = MOST_RANGES) -> ReachIndex | None:
    """The index of a graph whose condensed form has at most ONE_TASK links and ``most`` ranges; None beyond."""
    edges = settle(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    member = strong_components(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    size = member.join(loops, "node", "left").groupBy("component").agg(F.count("*").alias("size"), (F.count("loop") > 0).alias("loop"))
    parts = settle(size.select("component", "size", (F.col("loop") | (F.col("size") > 1)).alias("loops")))
    ends = edges.join(member.toDF("src", "a"), "src").join(member.toDF("dst", "b"), "dst")
    links = settle(ends.where("a <> b").select("a", "b").distinct())
    if links.count() > ONE_TASK or parts.count() > ONE_TASK:
        return None
    kind = edges.schema["src"].dataType
    # One row per component and per link for the task that numbers them.
    fed = parts.select(F.col("component").alias("a"), F.lit(None).cast(kind).alias("b"), "size", "loops").union(links.select("a", "b", F.lit(None).cast("long"), F.lit(None).cast("boolean")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        own = t.filter(t["size"].is_valid())
        names, at = np.unique(own["a"].to_numpy(), return_index=True)
        size_, loop = own["size"].to_numpy()[at], own["loops"].to_numpy(zero_copy_only=False)[at].astype(bool)
        link = t.filter(t["size"].is_null())
        src, dst = (np.searchsorted(names, link[c].to_numpy()) for c in ("a", "b"))
        del held, t, own, at, link
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        begin = np.searchsorted(src, np.arange(len(names) + 1))
        found = ranges_of(len(names), src, dst, size_, most)
        if found:
            first, *ranges = found
            meets = loop.copy()
            for v in np.argsort(np.frombuffer(tarjan(len(names), src, dst), np.int64)):
                meets[v] |= meets[dst[begin[v] : begin[v + 1]]].any()
            yield from _sent(names, first, size_, loop, meets, *ranges)

    schema = StructType([StructField("component", kind), *StructType.fromDDL(RANGES).fields])
    numbered = settle(fed.coalesce(1).mapInArrow(number, schema))
    if not numbered.take(1) and parts.take(1):
        return None
    # Nodes of a component take its places; a large component is numbered over sorted ranges, not in one window.
    ordered = member.join(numbered.select("component", "first", "size"), "component")
    single = ordered.where("size = 1").select(F.col("first").alias("place"), "node", "component")
    several = rank_in_groups(ordered.where("size > 1"), ["component"], [F.col("node")], "nth")
    wide = several.select((F.col("first") + F.col("nth") - 1).alias("place"), "node", "component")
    return ReachIndex(numbered, settle(single.unionByName(wide)))
