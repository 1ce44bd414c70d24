"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.llm.store import stored

# Links that one task takes: about 100 MB of its memory.
ONE_TASK = 500_000


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        # The labels of both ends go down as well as the ends, so that chains collapse.
        for at in (x, y, before[x], before[y]):
            np.minimum.at(label, at, low)
        label = label[label]
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if held:
        node, low = lowest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in links (a, b): rows (node, component).

    Each round takes the smallest label among a node and its neighbours and
    then follows that label once, so stars need two rounds and chains a number
    that grows with the logarithm of their length. Labels are stored between
    rounds. A hub's edges are combined before they are shuffled. Up to ONE_TASK
    links, counted first, are labelled by one task instead of rounds.
    """
    links = stored(links.select("a", "b").filter("a <> b"), "links")
    if links.count() <= ONE_TASK:
        return stored(links.coalesce(1).mapInArrow(_one_task, "node long, component long"), "labels")
    both = stored(links.union(links.select("b", "a")).distinct().toDF("node", "other"), "links")
    label = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component"))
    while True:
        label = stored(label, "labels")
        near = both.join(label.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        step = label.join(near, "node").select("node", "component", F.least("component", "seen").alias("low"))
        step = stored(step, "labels")
        if step.filter("low < component").isEmpty():
            return label
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("far"))
        label = step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("component"))
