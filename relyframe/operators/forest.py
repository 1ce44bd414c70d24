"""Isolation forest: many small trees on sampled rows, all rows scored in parallel.

Liu, Ting, Zhou: Isolation Forest, ICDM 2008.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.operators.profile import impute_median
from relyframe.operators.quantiles import exact_quantiles
from relyframe.session import settle

TREES, SAMPLE, SEED = 100, 256, 42
_EULER = 0.5772156649015329
_TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tree from at most SAMPLE rows, as parallel node arrays."""
    tree = int(pdf["tree"].iloc[0])
    x = np.array(pdf["x"].tolist(), dtype=float)
    rng = np.random.default_rng([SEED, tree])
    top = math.ceil(math.log2(max(len(x), 2)))
    feature, cut, left, right, depth = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, level, parent, is_right = todo.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        split = level < top and len(usable) > 0
        f = int(rng.choice(usable)) if split else -1
        c = float(rng.uniform(low[f], high[f])) if split else 0.0
        feature.append(f)
        cut.append(c)
        left.append(node)
        right.append(node)
        depth.append(level + mean_path(len(rows)))
        if split:
            below = x[rows, f] <= c
            todo.append((rows[~below], level + 1, node, True))
            todo.append((rows[below], level + 1, node, False))
    return pd.DataFrame([{"tree": tree, "feature": feature, "cut": cut, "left": left, "right": right, "depth": depth}])


def _sample(rows: DataFrame, n: int, order: list[str], trees: int, sample: int) -> DataFrame:
    """Up to ``sample`` rows for each tree, chosen by the hash of row and tree.

    Every tree draws from all rows, whatever their number; a threshold on the
    hash keeps about twice the rows needed before anything is shuffled.
    """
    span = 1 << 62
    below = int(min(1.0, 2.0 * sample / n) * span)
    hashed = rows.select(F.xxhash64(F.lit(SEED), *order, "x").alias("h"), "x")
    # A row per tree that is dropped at once runs as compiled code, a lambda over the trees does not.
    each = hashed.select("h", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    drawn = each.where(F.pmod(F.xxhash64("h", "tree"), F.lit(span)) < below)
    w = Window.partitionBy("tree").orderBy(F.xxhash64("h", "tree"), "x")
    return drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample).select("tree", "x")


def isolation_forest(
    df: DataFrame, row_key: list[str], cols: list[str], contamination: float = 0.05, trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """The rows easiest to isolate: about ``contamination`` of all rows.

    Returns the row key, the values, ``score`` (how far past the cut-off) and
    ``anomaly_type``. Fewer than five rows give no result.
    """
    filled = impute_median(df.select(*row_key, *cols), [], cols)
    rows = filled.select(*row_key, F.array(*cols).alias("x"))
    n = df.count()
    schema_only = rows.select(*row_key, "x", F.lit(0.0).alias("score"), F.lit("ISOLATION_FOREST").alias("anomaly_type"))
    if n < 5 or not cols:
        return schema_only.where("false")
    grown = _sample(rows, n, row_key, trees, sample).groupBy("tree").applyInPandas(_grow, _TREE)
    # At most trees x (2 x sample - 1) nodes: a bounded model, sent to every executor.
    forest = [
        (np.array(t.feature), np.array(t.cut), np.array(t.left), np.array(t.right), np.array(t.depth))
        for t in grown.orderBy("tree").collect()
    ]
    per_tree = min(sample, n)
    model = df.sparkSession.sparkContext.broadcast(forest)
    norm, levels = mean_path(per_tree), math.ceil(math.log2(max(per_tree, 2)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            x = b.to_numpy(dtype=float)
            path, at = np.zeros(len(x)), np.arange(len(x))
            for feature, cut, left, right, depth in model.value:
                node = np.zeros(len(x), dtype=int)
                for _ in range(levels):
                    f = feature[node]
                    go_left = x[at, np.maximum(f, 0)] <= cut[node]
                    node = np.where(go_left, left[node], right[node])
                path += depth[node]
            yield pd.Series(np.power(2.0, -path / (len(model.value) * norm)))

    numbers = F.struct(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(cols)])
    scored = settle(rows.withColumn("_s", -F.pandas_udf(score, "double")(numbers)))
    limit = exact_quantiles(scored, [], "_s", [contamination]).select(F.get("q", F.lit(0))).first()[0]
    return scored.where(F.col("_s") < limit).select(
        *row_key, "x", (F.lit(limit) - F.col("_s")).alias("score"), F.lit("ISOLATION_FOREST").alias("anomaly_type")
    )
