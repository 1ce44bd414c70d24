"""Local outlier factor with exact nearest neighbours found cell by cell.

Breunig, Kriegel, Ng, Sander: LOF, SIGMOD 2000.

Equal rows become one weighted point, so a value held by a third of the table
costs one point. Space is cut into cells of some hundred points by repeated
quantile splits; each point first looks in its own cell, and only points whose
search radius leaves it ask the cells that it touches. Each cell is given once
the outside points that are among the nearest of one of its own. Distances,
densities and factors are then figures of a cell and those points, so one
number per point moves between the steps and no list of pairs is stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.operators.profile import impute_median
from relyframe.operators.quantiles import exact_quantiles
from relyframe.session import settle, with_broadcast

NEIGHBOURS = 20
CELL = 512
FANOUT = 16
_MAX_LEVELS = 14
# Distances held at once by a task, and points that one split is fitted on while cells are far above their size.
_PAIRS = 1 << 16
_PER_SPLIT = 4096
_WIDER = 1 + 1e-9
_ASKS = "home bigint, x array<double>, radius double"
_OUTSIDE = "home bigint, id bigint, x array<double>, cnt bigint"


def _nearest(q: np.ndarray, p: np.ndarray, w: np.ndarray, k: int, own: np.ndarray | None = None, reach: np.ndarray | None = None) -> Iterator[tuple]:
    """The k nearest of the weighted points p for blocks of rows of q: slice of q, its row, place in p, distance, weight; nearest first.

    ``own`` holds each query's position in p: it counts once less there.
    Points beyond ``reach`` are left out. Ties go by the order of p.
    """
    m = min(len(p), k + 1)
    step = max(1, _PAIRS // len(p))
    sides, held = [np.ascontiguousarray(p[:, j]) for j in range(p.shape[1])], np.empty((2, min(step, len(q)), len(p)))
    for start in range(0, len(q), step):
        part = q[start : start + step]
        dist, gap = held[0][: len(part)], held[1][: len(part)]
        for j, side in enumerate(sides):
            np.subtract(part[:, j, None], side, out=gap)
            np.multiply(gap, gap, out=gap if j else dist)
            if j:
                dist += gap
        np.sqrt(dist, out=dist)
        edge = np.partition(dist, m - 1, axis=1)[:, m - 1]
        if reach is not None:
            edge = np.minimum(edge, reach[start : start + step])
        row, col = np.nonzero(dist <= edge[:, None])
        d = dist[row, col]
        order = np.lexsort((d, row))
        row, col, d = row[order], col[order], d[order]
        weight = w[col]
        if own is not None:
            weight = weight - (col == own[start + row])
        have = np.concatenate([[0], np.cumsum(weight)])
        before = have[:-1] - have[np.searchsorted(row, np.arange(len(part)))][row]
        take = (weight > 0) & (before < k)
        yield slice(start, start + len(part)), row[take], col[take], d[take], np.minimum(weight, k - before)[take]


def _radius(n: int, row: np.ndarray, d: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Distance of the k-th neighbour of each of n queries; infinite where there are fewer."""
    last = np.searchsorted(row, np.arange(n), side="right") - 1
    enough = np.bincount(row, weight, n) >= k
    out = np.full(n, np.inf)
    out[enough] = d[last[enough]]
    return out


def _points(t: pa.Table, dims: int) -> np.ndarray:
    return t["x"].combine_chunks().flatten().to_numpy().reshape(-1, dims)


def _place(rows: DataFrame, splits: list[DataFrame], reach: str | None = None) -> DataFrame:
    """Send rows down the split levels; with a radius a row can enter several cells.

    Without one, ``slack`` becomes the distance to the nearest cut.
    """
    for s in splits:
        rows = rows.join(s, "cell", "left")
        v = F.element_at("x", F.col("dim"))
        below = lambda e: F.size(F.filter("cuts", lambda c: c <= e))
        if reach is None:
            rows = rows.withColumn("_b", F.when(F.col("dim").isNotNull(), below(v)))
            near = F.least("slack", v - F.get("cuts", F.col("_b") - 1), F.get("cuts", F.col("_b")) - v)  # skips nulls
            step = F.when(F.col("dim").isNull(), F.col("cell")).otherwise(F.col("cell") * (FANOUT + 1) + 1 + F.col("_b"))
            rows = rows.withColumn("slack", near).withColumn("cell", step).drop("_b")
        else:
            wide = F.col(reach) * _WIDER
            inside = F.transform(F.sequence(below(v - wide), below(v + wide)), lambda i: F.col("cell") * (FANOUT + 1) + 1 + i)
            rows = rows.withColumn("cell", F.explode(F.when(F.col("dim").isNull(), F.array("cell")).otherwise(inside)))
        rows = rows.drop("dim", "cuts")
    return rows


def _at_root(points: DataFrame) -> DataFrame:
    return points.withColumns({"cell": F.lit(0).cast("bigint"), "slack": F.lit(float("inf"))})


def _split_levels(points: DataFrame, dims: int, cell: int) -> list[DataFrame]:
    """Quantile splits of every cell above ``cell`` points, level by level.

    While cells are far too large, a level is fitted on some points of each,
    chosen by hash. It ends when counts of all points find no cell too large.
    """
    at = [i / FANOUT for i in range(1, FANOUT)]
    total, splits, share = points.count(), [], 0.0
    base = _at_root(points.select("id", "x"))
    while len(splits) < _MAX_LEVELS:
        share = 1.0 if share == 1.0 else min(1.0, _PER_SPLIT * FANOUT ** len(splits) / total)
        some = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1.0 else base
        placed = _place(some, splits)
        if share == 1.0:
            full = with_broadcast(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell))
            placed = placed.join(full.select("cell"), "cell", "left_semi")
        cuts = [F.array_distinct(F.percentile_approx(F.element_at("x", d + 1), at, 1_000)).alias(f"c{d}") for d in range(dims)]
        each = placed.groupBy("cell").agg((F.count(F.lit(1)) / share).alias("n"), *cuts)
        # Cut the widest side; a side whose quantiles are all equal has no width.
        choice = F.array_max(
            F.array(
                *[
                    F.struct((F.array_max(f"c{d}") - F.array_min(f"c{d}")).alias("width"), F.lit(d + 1).alias("dim"), F.col(f"c{d}").alias("cuts"))
                    for d in range(dims)
                ]
            )
        )
        big = each.where(F.col("n") > cell).withColumn("s", choice).where("s.width > 0").select("cell", "n", "s.dim", "s.cuts")
        # No more strips than give cells three quarters full.
        strips = F.least(F.ceil(F.col("n") / (0.75 * cell)), F.lit(FANOUT)).cast("int")
        picked = F.transform(F.sequence(F.lit(1), strips - 1), lambda i: F.element_at("cuts", F.greatest(F.lit(1), (i * (F.size("cuts") + 1) / strips).cast("int"))))
        level = with_broadcast(big.select("cell", "dim", F.array_distinct(picked).alias("cuts")))
        if level.take(1):
            splits.append(level)
        elif share == 1.0:
            break
        else:
            share = 1.0
    return splits


def local_outlier_factor(
    df: DataFrame, row_key: list[str], cols: list[str], contamination: float = 0.05, k: int = NEIGHBOURS, cell: int = CELL
) -> DataFrame:
    """LOF of every row: row key, ``x``, ``lof``."""
    filled = impute_median(df.select(*row_key, *cols), [], cols)
    rows = filled.select(*row_key, F.transform(F.array(*cols), lambda v: v + F.lit(0.0)).alias("x"))
    n = df.count()
    if n < 5 or not cols:
        return rows.withColumn("lof", F.lit(0.0)).where("false")
    k = min(k, n - 1)
    # Numbers ascend with the coordinates, so ties go by coordinates.
    distinct = rows.groupBy("x").agg(F.count(F.lit(1)).alias("cnt"))
    points = settle(distinct.orderBy("x").withColumn("id", F.monotonically_increasing_id()))
    splits = _split_levels(points, len(cols), cell)
    placed = settle(_place(_at_root(points), splits))
    outside = outside_points(points, placed, splits, len(cols), k, cell)

    def figures(kind: str, own: DataFrame, held: DataFrame) -> DataFrame:
        schema = "x array<double>, lof double" if kind == "factor" else "id bigint, v double"
        return own.groupBy("cell").cogroup(held.groupBy("home")).applyInArrow(_figures(kind, len(cols), k), schema)

    own = placed.select("cell", "id", "x", "cnt")
    far = settle(figures("distance", own, outside))
    near = settle(figures("density", own.join(far, "id"), outside.join(far.toDF("id", "v"), "id")))
    factor = figures("factor", own.join(near, "id"), outside.join(near.toDF("id", "v"), "id"))
    return rows.join(factor, "x").select(*row_key, "x", "lof")


def _figures(kind: str, dims: int, k: int):
    """A figure of each of a cell's points: distance of the k-th neighbour, from those the density, from that the factor."""

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        n, column = own.num_rows, lambda c: np.concatenate([own[c].to_numpy(), held[c].to_numpy()])
        ids, order = np.unique(column("id"), return_index=True)
        at = np.searchsorted(ids, own["id"].to_numpy())
        q = _points(own, dims)
        p, w = np.concatenate([q, _points(held, dims)])[order], column("cnt")[order]
        v = column("v")[order] if kind != "distance" else None
        out = np.empty(n)
        for part, row, col, d, weight in _nearest(q, p, w, k, at):
            m = len(out[part])
            if kind == "distance":
                out[part] = _radius(m, row, d, weight, k)
            elif kind == "density":
                out[part] = 1.0 / (np.bincount(row, weight * np.maximum(v[col], d), m) / k + 1e-10)
            else:
                out[part] = np.bincount(row, weight * v[col], m) / k / v[at[part]]
        if kind == "factor":
            return pa.table({"x": own["x"], "lof": out})
        return pa.table({"id": own["id"], "v": out})

    return run


def outside_points(points: DataFrame, placed: DataFrame, splits: list[DataFrame], dims: int, k: int, cell: int) -> DataFrame:
    """Rows (home, id, x, cnt): for each cell, once, the points of other cells that are among the k nearest of one of its points.

    A cell asked by many points answers in slices.
    """
    if not splits:
        return placed.where("false").select("cell", "id", "x", "cnt").toDF("home", "id", "x", "cnt")
    # A bounded set of points that gives cells with too few neighbours a search radius.
    probe = [(r.x, r.cnt) for r in points.orderBy(F.xxhash64("x"), "x").limit(max(64, 2 * k + 2)).collect()]
    probe_x, probe_w = np.array([p[0] for p in probe]), np.array([p[1] for p in probe])

    def leaving(t: pa.Table) -> pa.Table:
        p, w, radius = _points(t, dims), t["cnt"].to_numpy(), np.empty(t.num_rows)
        for part, row, _, d, weight in _nearest(p, p, w, k, np.arange(len(p))):
            radius[part] = _radius(len(radius[part]), row, d, weight, k)
        short = np.flatnonzero(~np.isfinite(radius))
        for part, row, _, d, weight in _nearest(p[short], probe_x, probe_w, k + 1):
            radius[short[part]] = _radius(len(short[part]), row, d, weight, k + 1)  # k + 1 of them, as the point may be one itself
        asks = pa.array(np.flatnonzero(~(radius * _WIDER < t["slack"].to_numpy())))
        return pa.table({"home": t["cell"].take(asks), "x": t["x"].take(asks), "radius": pa.array(radius).take(asks)})

    asks = placed.groupBy("cell").applyInArrow(leaving, _ASKS).withColumn("cell", F.lit(0).cast("bigint"))
    asks = settle(_place(settle(asks), splits, "radius").where("cell <> home"))
    load = with_broadcast(
        asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(4 * cell))).cast("int").alias("slices"))
    )
    asked = asks.join(load, "cell").select("cell", F.pmod(F.xxhash64("x"), "slices").cast("int").alias("slice"), "home", "x", "radius")
    served = placed.join(load, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "id", "x", "cnt"
    )

    def answer(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return pa.table({"home": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64())), "cnt": pa.array([], pa.int64())})
        p = p.sort_by("id")
        homes, code = np.unique(q["home"].to_numpy(), return_inverse=True)
        found = [
            np.unique(code[part][row] * p.num_rows + col)
            for part, row, col, _, _ in _nearest(_points(q, dims), _points(p, dims), p["cnt"].to_numpy(), k, reach=q["radius"].to_numpy())
        ]
        home, at = np.divmod(np.unique(np.concatenate(found)), p.num_rows)
        return p.select(["id", "x", "cnt"]).take(pa.array(at)).add_column(0, "home", pa.array(homes[home]))

    found = asked.groupBy("cell", "slice").cogroup(served.groupBy("cell", "slice")).applyInArrow(answer, _OUTSIDE)
    return settle(found.dropDuplicates(["home", "id"]))


def lof_anomalies(df: DataFrame, row_key: list[str], cols: list[str], contamination: float = 0.05, k: int = NEIGHBOURS, cell: int = CELL) -> DataFrame:
    """Rows whose LOF lies beyond the ``contamination`` quantile."""
    scored = settle(local_outlier_factor(df, row_key, cols, contamination, k, cell).withColumn("_s", -F.col("lof")))
    limit = exact_quantiles(scored, [], "_s", [contamination]).select(F.get("q", F.lit(0))).first()
    if limit is None:
        return scored.select(*row_key, "x", F.col("lof").alias("score"), F.lit("LOCAL_OUTLIER_FACTOR").alias("anomaly_type"))
    return scored.where(F.col("_s") < limit[0]).select(
        *row_key, "x", F.col("lof").alias("score"), F.lit("LOCAL_OUTLIER_FACTOR").alias("anomaly_type")
    )
