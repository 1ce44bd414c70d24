"""Exact top-k inner products with an M-tree, best first.

Vectors are made integer and given one more coordinate so that all have the
same length; the largest inner product is then the smallest Euclidean
distance, a metric. Each shard of rows is one M-tree: leaf pages of objects
with their distance to the page's routing object, inner nodes of routing
objects with covering radius and distance to their parent. A query walks the
nodes in order of their least possible distance, skips whatever the stored
triangle-inequality bounds exclude before any distance is computed, and stops
when no node can hold a better score than its k-th.

Shards hold at most SHARD_ROWS distinct vectors that lie near one of at most
PIVOTS pivots. Every query first searches the shards of its nearest pivot; with
the k-th score as a bound it is sent on only to pivots whose covering ball can
hold a better one. Queries are packed into blocks by their nearest pivot. Block
after block is sent to the stored trees that it needs, never a tree to the
queries: a task holds one block and one tree and carries the block's best from
tree to tree, so what is written grows with the queries and the tasks, not with
queries times shards. Equal vectors are one object, of which the k + 1 smallest
ids can matter; equal queries are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.llm.blocks import dump, load
from relyframe.llm.store import sized, small_batches, stored
from relyframe.session import scratch

SCALE = 64
TOP = 20
QUERY_STEP = 20
PAGE = 256
FANOUT = 8
SHARD_ROWS = 16_384
# The most pivots: their balls are all that the driver holds and sends to the tasks.
PIVOTS = 4_096
# Queries that walk a tree together, and how many times as many are sent to the trees at once.
QUERY_BLOCK = 1_024
WALKS = 64
# The most trees in a file: files are what the tasks of a search are dealt.
FILE_TREES = 8
# Distances come from differences of squares in doubles; bounds that are this
# close, relative to the vectors' lengths, do not prune.
SLACK = 1e-6
_NOTHING, _LAST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id, v: floor(64 * x) of every component; rows with null or non-finite parts are left out.

    Of rows that share a vec_id the least vector takes part.
    """
    inf = float("inf")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(good).groupBy("vec_id").agg(F.min(whole).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray | list) -> np.ndarray:
    """Integer lists as one array; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.Array):
        size = pc.list_value_length(column).to_numpy()
        if len(size) and (size == size[0]).all():
            return column.flatten().to_numpy().reshape(len(size), int(size[0]))
        column = column.to_pylist()
    width = max((len(r) for r in column), default=0)
    out = np.zeros((len(column), width), np.int64)
    for i, r in enumerate(column):
        out[i, : len(r)] = r
    return out


def _fit_width(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a[:, :width], ((0, 0), (0, max(0, width - a.shape[1]))))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    lo, hi = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def _unpack(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows packed by ``_place`` as one array; shorter ones end in zeros."""
    rows = [np.frombuffer(r, kind) for r in column.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _longest(x: np.ndarray) -> float:
    """The largest length of a row."""
    return max((float((x[lo : lo + QUERY_BLOCK].astype(np.float64) ** 2).sum(axis=1).max()) for lo in range(0, len(x), QUERY_BLOCK)), default=0.0) ** 0.5


def _exact(a: float, b: float) -> type:
    """The fastest type in which inner products of rows of these lengths, and every sum on the way, are exact."""
    most = max(a, b, a * b)
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


class MTree:
    """A bulk-loaded tree over the rows of x; arrays only, so that it can be stored."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], top: float = 0.0):
        """``top`` is the largest squared length of all trees, so that they share one space."""
        self.x = x.astype(np.float64)
        norms = (self.x**2).sum(axis=1)
        self.top = max(top, float(norms.max(initial=0.0)))
        self.lift = np.sqrt(np.maximum(self.top - norms, 0.0))
        # Node: (routing row, radius, distance to parent, children nodes or None, member rows, members' distances)
        self.nodes: list[tuple] = []
        self.root = self._load(np.arange(len(x)), self._middle(np.arange(len(x))), 0.0) if len(x) else None
        self.ball = (x[self.nodes[self.root][0]], self.nodes[self.root][1], float(self.lift[self.nodes[self.root][0]])) if len(x) else None
        self._join_children(x, ids)
        del self.x, self.lift, self.nodes

    def _distance(self, row: int, rows: np.ndarray) -> np.ndarray:
        d2 = ((self.x[rows] - self.x[row]) ** 2).sum(axis=1) + (self.lift[rows] - self.lift[row]) ** 2
        return np.sqrt(d2)

    def _middle(self, rows: np.ndarray) -> int:
        """The row nearest to the mean, whose ball over all rows is small."""
        off = ((self.x[rows] - self.x[rows].mean(axis=0)) ** 2).sum(axis=1) + (self.lift[rows] - self.lift[rows].mean()) ** 2
        return int(rows[int(off.argmin())])

    def _load(self, rows: np.ndarray, route: int, to_parent: float) -> int:
        far = self._distance(route, rows)
        if len(rows) <= PAGE:
            order = np.argsort(far, kind="stable")
            self.nodes.append((route, float(far.max()), to_parent, None, rows[order], far[order]))
            return len(self.nodes) - 1
        pivots = [int(rows[int(far.argmax())])]
        near = self._distance(pivots[0], rows)
        own = np.zeros(len(rows), np.int64)
        while len(pivots) < min(FANOUT, 1 + len(rows) // PAGE) and near.max() > 0:  # full pages
            pivots.append(int(rows[int(near.argmax())]))
            d = self._distance(pivots[-1], rows)
            own[d < near] = len(pivots) - 1
            near = np.minimum(near, d)
        if np.bincount(own).max() > 0.95 * len(rows):  # hardly any split: deal the rows out by distance
            own = np.arange(len(rows)) * FANOUT // len(rows)
            own[np.argsort(near, kind="stable")] = own.copy()
        children = []
        for j in np.unique(own):
            part = rows[own == j]
            center = self._middle(part)
            children.append(self._load(part, center, float(self._distance(route, np.array([center]))[0])))
        self.nodes.append((route, float(far.max()), to_parent, children, None, None))
        return len(self.nodes) - 1

    def _join_children(self, x: np.ndarray, ids: list[list[int]]) -> None:
        """Objects in the order of their pages: page i holds rows from pages[i][0] on, object j the names from starts[j] on."""
        order = np.concatenate([np.zeros(0, np.int64), *(n[4] for n in self.nodes if n[3] is None)])
        place = np.argsort(order)
        self.objects, self.longest = _narrow(x[order]), _longest(x)
        self.starts = np.cumsum([0, *(len(ids[r]) for r in order)])
        self.names = np.array([name for r in order for name in ids[r]], np.int64)
        self.below, self.pages, at = {}, {}, 0
        for i, (_, _, _, children, rows, far) in enumerate(self.nodes):
            if children is None:
                self.pages[i] = (at, far)
                at += len(rows)
            else:
                own = [self.nodes[c] for c in children]
                self.below[i] = (np.array(children), place[[n[0] for n in own]], np.array([n[1] for n in own]), np.array([n[2] for n in own]))
        self.route, self.radius = (int(place[self.nodes[self.root][0]]), self.nodes[self.root][1]) if order.size else (0, 0.0)

    def search(self, queries: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best (scores, ids) of every query, best first, of scores not below its bound; and how many distances each needed.

        Places without a result hold the id -1.
        """
        best = Best(queries, k, bounds)
        best.visit(self)
        return best.scores, np.where(best.scores == _NOTHING, -1, best.ids), best.computed


class Best:
    """The best (scores, ids) that a block of queries has found so far, carried from tree to tree."""

    def __init__(self, queries: np.ndarray, k: int, bounds: np.ndarray | None = None):
        n = len(queries)
        self.queries, self.k, self.longest = queries, k, _longest(queries)
        self.scores, self.ids = np.full((n, k), _NOTHING), np.full((n, k), _LAST)
        self.computed = np.zeros(n, np.int64)
        floor = np.full(n, -np.inf) if bounds is None else bounds.astype(np.float64)
        #: No score below it can matter.
        self.least = np.where(np.isfinite(floor), np.ceil(floor), _NOTHING).astype(np.int64)

    def visit(self, tree: MTree, who: np.ndarray | None = None) -> None:
        """Queries ``who`` walk the tree, QUERY_BLOCK at a time."""
        who = np.arange(len(self.queries)) if who is None else who
        if tree.root is None or not len(who):
            return
        x = tree.objects.astype(_exact(self.longest, tree.longest))
        for lo in range(0, len(who), QUERY_BLOCK):
            self._walk(tree, x, who[lo : lo + QUERY_BLOCK])

    def _walk(self, tree: MTree, x: np.ndarray, block: np.ndarray) -> None:
        """A block of queries walks the tree together: nodes come in the order of
        the least distance that any of them may find there, and at each node
        only those queries stay whose own bounds allow it.
        """
        q = _fit_width(self.queries[block], x.shape[1]).astype(x.dtype)
        real = q if x.dtype != np.int64 else q.astype(np.float64)  # distances may be rounded, scores not
        qq = (q.astype(np.float64) ** 2).sum(axis=1)
        base, slack = qq + tree.top, SLACK * np.sqrt(qq + tree.top)
        low = self._low(block)
        limit = _reach(base, low, slack)

        def away(who: np.ndarray, row: int) -> np.ndarray:
            self.computed[block[who]] += 1
            return np.sqrt(np.maximum(base[who] - 2 * (real[who] @ x[row].astype(real.dtype)).astype(np.float64), 0.0))

        everyone = np.arange(len(block))
        d = away(everyone, tree.route)
        least = np.maximum(d - tree.radius, 0.0)
        queue = [(float(least.min()), tree.root, everyone, least, d)]
        while queue:
            _, i, who, least, d = heapq.heappop(queue)
            stay = least <= limit[who]
            if not stay.all():
                who, d = who[stay], d[stay]
            if not len(who):
                continue
            if i in tree.pages:
                start, far = tree.pages[i]
                lo, hi = np.searchsorted(far, (d - limit[who]).min()), np.searchsorted(far, (d + limit[who]).max(), side="right")
                if lo < hi and self._page(tree, x, q, low, block, who, start + int(lo), start + int(hi)):
                    low[who] = self._low(block[who])
                    limit[who] = _reach(base[who], low[who], slack[who])
                continue
            nodes, routes, radius, to_parent = tree.below[i]
            for node, route, r, far in zip(nodes.tolist(), routes.tolist(), radius.tolist(), to_parent.tolist(), strict=True):
                near = np.abs(d - far) - r <= limit[who]  # stored bounds, before any distance
                some = who if near.all() else who[near]
                if len(some):
                    there = away(some, route)
                    gap = np.maximum(there - r, 0.0)
                    heapq.heappush(queue, (float(gap.min()), node, some, gap, there))

    def _low(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[who, -1], self.least[who])

    def _page(self, tree: MTree, x: np.ndarray, q: np.ndarray, low: np.ndarray, block: np.ndarray, who: np.ndarray, lo: int, hi: int) -> bool:
        """Scores of a page's objects that the distances to its routing object do not exclude, merged into the best."""
        self.computed[block[who]] += hi - lo
        found = (q if len(who) == len(q) else q[who]) @ x[lo:hi].T
        low = low[who].astype(x.dtype)
        some = np.flatnonzero(found.max(axis=1) >= low)
        if not len(some):
            return False
        who, found = who[some], found[some]
        good = found >= low[some, None]
        if hi - lo > self.k and np.count_nonzero(good) > 2 * self.k * len(who):  # an object below the k-th of its page cannot be among the k best
            good &= found >= np.partition(found, hi - lo - self.k, axis=1)[:, hi - lo - self.k][:, None]
        row, column = np.divmod(np.flatnonzero(good.reshape(-1)), hi - lo)
        count = tree.starts[lo + column + 1] - tree.starts[lo + column]
        each = np.repeat(np.arange(len(row)), count)
        name = tree.names[np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + tree.starts[lo + column][each]]
        self._merge(block[who[row]][each], found[row, column].astype(np.int64)[each], name)
        return True

    def _merge(self, query: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        mine = np.unique(query)
        query = np.concatenate([np.repeat(mine, self.k), query])
        score = np.concatenate([self.scores[mine].reshape(-1), score])
        name = np.concatenate([self.ids[mine].reshape(-1), name])
        order = np.lexsort((name, -score, query))
        first = np.searchsorted(query[order], mine)
        keep = order[first[:, None] + np.arange(self.k)]
        self.scores[mine], self.ids[mine] = score[keep], name[keep]


def _reach(base: np.ndarray, low: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """The largest distance at which a score that is not below ``low`` can lie."""
    return np.where(low == _NOTHING, np.inf, np.sqrt(np.maximum(base - 2 * np.where(low == _NOTHING, 0, low).astype(np.float64), 0.0)) + slack)


HITS = "qkey long, vec_id long, score long, computed long"
FOUND = "part int, found binary"


def _search(payload: bytes, k: int, own_only: bool):
    """A block of queries against the trees of a task: a row for each QUERY_BLOCK of them, with the best of all these trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = home = keys = None
        for batch in batches:
            for pivot, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if best is None:
                    keys, x, home, bounds = load(payload)
                    best = Best(x, k, bounds)
                best.visit(load(tree.as_py()), np.flatnonzero((home == pivot) == own_only))
        if best is None:
            return
        for part, lo in enumerate(range(0, len(keys), QUERY_BLOCK)):
            cut = slice(lo, lo + QUERY_BLOCK)
            row, place = np.nonzero(best.scores[cut] != _NOTHING)
            if len(row):
                found = dump((keys[cut], best.computed[cut], row.astype(np.int32), _narrow(best.scores[cut][row, place]), best.ids[cut][row, place]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found], pa.binary())], ["part", "found"])

    return run


def _together(table: pa.Table, k: int) -> pa.Table:
    """The k best of the same queries from all tasks."""
    rows, scores, ids, work = [], [], [], 0
    for found in table["found"]:
        keys, computed, row, score, name = load(found.as_py())
        rows, scores, ids, work = [*rows, row], [*scores, score.astype(np.int64)], [*ids, name], work + computed
    row, score, name = (np.concatenate(c) for c in (rows, scores, ids))
    order = np.lexsort((name, -score, row))
    row, score, name = row[order], score[order], name[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    row = row[keep]
    return pa.table({"qkey": pa.array(keys[row]), "vec_id": pa.array(name[keep]), "score": pa.array(score[keep]), "computed": pa.array(work[row])})


def _nearest(pivots: np.ndarray):
    """Nearest pivot of every row, by plain distance."""
    sq = (pivots.astype(np.float64) ** 2).sum(axis=1)

    def place(x: np.ndarray) -> np.ndarray:
        near = np.zeros(len(x), np.int64)
        for lo in range(0, len(x), QUERY_BLOCK):
            part = _fit_width(x[lo : lo + QUERY_BLOCK], pivots.shape[1]).astype(np.float64)
            near[lo : lo + len(part)] = np.argmin(sq - 2 * (part @ pivots.T.astype(np.float64)), axis=1)
        return near

    return place


def _place(pivots: np.ndarray, kind: str):
    """Rows (h, x, ids, pivot): every object packed as numbers of type ``kind``, with its nearest pivot."""
    nearest = _nearest(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2), pa.array(nearest(x), pa.int32())], ["h", "x", "ids", "pivot"])

    return run


def _build(table: pa.Table, kind: str, top: float) -> pa.Table:
    tree = MTree(_unpack(table["x"], kind), table["ids"].to_pylist(), top)
    center, radius, lift = tree.ball
    return pa.table({
        "shard": table["shard"][:1], "pivot": table["pivot"][:1], "tree": pa.array([dump(tree)], pa.binary()),
        "center": pa.array([center.tolist()], pa.list_(pa.int64())), "radius": pa.array([radius]), "lift": pa.array([lift]),
    })


def _cover(table: pa.Table) -> pa.Table:
    """One ball around the trees of a pivot: about the first one's center."""
    center = matrix(table["center"]).astype(np.float64)
    lift, radius = table["lift"].to_numpy(), table["radius"].to_numpy()
    away = np.sqrt(((center - center[0]) ** 2).sum(axis=1) + (lift - lift[0]) ** 2)
    return pa.table({"pivot": table["pivot"][:1], "center": table["center"][:1], "radius": pa.array([float((away + radius).max())]), "lift": table["lift"][:1]})


class Balls:
    """The pivots' covering balls, which tell the queries where to go."""

    def __init__(self, heads: list, top: float):
        self.center = matrix([h["center"] for h in heads]).astype(np.float64)
        self.radius, self.lift = (np.array([h[c] for h in heads]) for c in ("radius", "lift"))
        self.pivot, self.top = np.array([h["pivot"] for h in heads], np.int32), top

    def _away(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _fit_width(x, self.center.shape[1]).astype(np.float64)
        qq = (x**2).sum(axis=1)[:, None]
        return qq, np.sqrt(np.maximum(qq + (self.center**2).sum(axis=1) - 2 * x @ self.center.T, 0.0) + self.lift**2)

    def first(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivot of every query."""
        return np.concatenate([np.zeros(0, np.int32), *(self.pivot[np.argmin(self._away(x[lo : lo + QUERY_BLOCK])[1], axis=1)] for lo in range(0, len(x), QUERY_BLOCK))])

    def others(self, x: np.ndarray, home: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The pivots that the bound of some query does not exclude, besides its nearest."""
        some = np.zeros(len(self.pivot), bool)
        for lo in range(0, len(x), QUERY_BLOCK):
            cut = slice(lo, lo + QUERY_BLOCK)
            qq, away = self._away(x[cut])
            limit = np.sqrt(np.maximum(qq + self.top - 2 * bound[cut, None], 0.0))
            some |= ((away - self.radius <= limit + 2 * SLACK * np.sqrt(qq + self.top)) & (home[cut, None] != self.pivot)).any(axis=0)
        return self.pivot[some]


def _homes(balls: Balls):
    """Rows (qkey, v, home): every query with its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(balls.first(matrix(batch.column(1))), pa.int32())], ["qkey", "v", "home"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """One row (block, payload): keys, vectors, nearest pivots and bounds of a block of queries, those of a pivot side by side."""
    table = table.sort_by([("home", "ascending"), ("qkey", "ascending")])
    bounds = pc.fill_null(table["bound"], -np.inf).to_numpy()
    payload = dump((table["qkey"].to_numpy(), _narrow(matrix(table["v"])), table["home"].to_numpy(), bounds))
    return pa.table({"block": table["block"][:1], "payload": pa.array([payload], pa.binary())})


def _route(balls: Balls, own_only: bool):
    """Rows (block, pivot): the nearest pivots of a block's queries, or the others that a bound of theirs does not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, x, home, bounds = load(payload.as_py())
                pivots = np.unique(home) if own_only else balls.others(x, home, bounds)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(pivots), pa.int32()), pa.array(pivots, pa.int32())], ["block", "pivot"])

    return run


def dealt(counts: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """(pivot, first block, blocks) of pivots with so many queries: small ones share a block, large ones get several."""
    out, at, filled = [], 0, 0
    for pivot, n in counts:
        parts = -(-n // size)
        if filled + n > size and filled:
            at, filled = at + 1, 0
        out.append((pivot, at, parts))
        at, filled = (at + parts, 0) if parts > 1 else (at, filled + n)
    return out


def meetings(routed: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (block, shard) that meet, and the trees by these pairs: a tree for each block that needs it and for no other."""
    near = stored(routed.join(trees.select("pivot", "shard"), "pivot").select("block", "shard"), "near")
    return near, trees.select("shard", "pivot", "tree").join(sized(near), "shard")


def first_objects(objects: DataFrame, total: int, n: int) -> list:
    """The n rows with the least hashes; of the others few are sorted or sent."""
    cut = min(2**63 - 1, round(2**64 * min(1.0, (2 * n + 64) / total)) - 2**63)
    rows = objects.filter(F.col("h") <= cut).orderBy("h", "v").limit(n).collect()
    return rows if len(rows) == min(n, total) else objects.orderBy("h", "v").limit(n).collect()


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """For queries (vec_id, v) among vectors (vec_id, v): query_id, rank, vec_id, score of the k best other rows.

    Ties go to the smaller vec_id. Fewer rows than k give all. ``computed`` is
    the number of inner products that the query needed in the shards it visited,
    those of its nearest pivot or the others.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = stored(vectors.select("vec_id", "v"), "vectors")
    least = Window.partitionBy("v").orderBy("vec_id")
    objects = stored(
        vectors.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("h", F.xxhash64("v")),
        "objects",
    )
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    total, top, low, high = objects.agg(F.count("*"), F.max(length), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    out = "query_id long, rank int, vec_id long, score long, computed long"
    if not total:
        return spark.createDataFrame([], out)
    # The index is fitted on one pivot for each shard, PIVOTS at most; every row is in it.
    pivots = matrix([r["v"] for r in first_objects(objects, total, min(-(-total // SHARD_ROWS), PIVOTS))])
    kind = _narrow(np.array([low or 0, high or 0])).dtype.str
    placed = stored(objects.select("h", "v", "ids").mapInArrow(_place(pivots, kind), "h long, x binary, ids array<long>, pivot int"), "placed")
    parts, shards, cores = [], 0, spark.sparkContext.defaultParallelism
    for pivot, n in sorted((r["pivot"], r["count"]) for r in placed.groupBy("pivot").count().collect()):
        parts.append((pivot, shards, -(-n // SHARD_ROWS)))
        shards += parts[-1][2]
    named = placed.join(F.broadcast(spark.createDataFrame(parts, "pivot int, first long, parts long")), "pivot").withColumn("shard", F.col("first") + F.pmod("h", "parts"))
    ball = "center array<long>, radius double, lift double"
    trees = named.select("shard", "pivot", "x", "ids").groupBy("shard").applyInArrow(lambda t: _build(t, kind, top), f"shard long, pivot int, tree binary, {ball}")
    files = max(min(shards, 12 * cores), -(-shards // FILE_TREES))
    trees = stored(trees.repartitionById(files, F.pmod("shard", F.lit(files)).cast("int")), "trees")
    balls = Balls([r.asDict() for r in trees.drop("tree").groupBy("pivot").applyInArrow(_cover, f"pivot int, {ball}").orderBy("pivot").collect()], top)

    asked = queries.groupBy("v").agg(F.min("vec_id").alias("qkey")).select("qkey", "v")
    asked = stored(asked.mapInArrow(_homes(balls), "qkey long, v array<long>, home int"), "asked")
    counts = sorted((r["home"], r["count"]) for r in asked.groupBy("home").count().collect())  # a row for each pivot
    blocks = spark.createDataFrame(dealt(counts, WALKS * QUERY_BLOCK), "home int, first int, blocks int")
    dealt_out = asked.join(F.broadcast(blocks), "home").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("qkey"), "blocks")).cast("int"))

    def visit(rows: DataFrame, own_only: bool) -> DataFrame:
        """The best of every query from the trees that its block meets; one block after the other is sent to them."""
        packed = stored(rows.select("block", "qkey", "v", "home", "bound").groupBy("block").applyInArrow(_pack, "block int, payload binary"), "asked")
        near, own = meetings(packed.mapInArrow(_route(balls, own_only), "block int, pivot int"), trees)
        path = scratch(spark, "hits")
        for (block,) in sorted(near.select("block").distinct().collect()):
            payload = packed.filter(F.col("block") == block).first()["payload"]
            met = own.filter(F.col("block") == block).select("pivot", "tree").coalesce(3 * cores)
            found = met.mapInArrow(_search(payload, k + 1, own_only), FOUND).groupBy("part").applyInArrow(lambda t: _together(t, k + 1), HITS)
            found.write.mode("append").parquet(path)
        spark.createDataFrame([], HITS).write.mode("append").parquet(path)
        return spark.read.schema(HITS).parquet(path)

    one = visit(dealt_out.withColumn("bound", F.lit(None).cast("double")), True)
    kth = one.groupBy("qkey").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("qkey", F.when(F.col("n") > k, F.col("low").cast("double")).alias("bound"))
    two = visit(dealt_out.join(kth, "qkey", "left"), False)
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    hits = one.union(two).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    rows = queries.select(F.col("vec_id").alias("query_id"), "v").join(asked.select("qkey", "v"), "v").join(hits, "qkey").filter("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy("place")
    return rows.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "computed")
