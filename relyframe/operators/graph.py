"""Reachability over dependency edges (columns src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.operators.reach_index import build_index
from relyframe.session import settle


def _any(df: DataFrame) -> bool:
    return bool(df.take(1))


def reach_all(edges: DataFrame) -> DataFrame:
    """Every (root, node) pair joined by a path of at least one edge.

    Each round doubles the path length: pairs found last are extended by all
    pairs known so far. A long chain of n edges needs about log2(n) rounds, and
    a cycle ends once it adds no new pair. Rounds are stored, so lost executors
    only repeat the current one.
    """
    fresh = settle(edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct())
    known = [fresh]
    while _any(fresh):
        total = reduce(DataFrame.union, known)
        step = (
            fresh.withColumnRenamed("node", "mid")
            .join(total.select(F.col("root").alias("mid"), "node"), "mid")
            .select("root", "node")
            .distinct()
        )
        fresh = settle(step.join(total, ["root", "node"], "left_anti"))
        known.append(fresh)
    return reduce(DataFrame.union, known)


def reach_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) pairs for the given roots only: one hop per round."""
    links = edges.select("src", "dst").distinct()
    fresh = settle(roots.select("root").distinct().join(links, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node")).distinct())
    known = [fresh]
    while _any(fresh):
        total = reduce(DataFrame.union, known)
        step = fresh.join(links, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        fresh = settle(step.join(total, ["root", "node"], "left_anti"))
        known.append(fresh)
    return reduce(DataFrame.union, known)


def flipped(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_d", "dst": "_s"}).withColumnsRenamed({"_d": "dst", "_s": "src"})


def closure_edges(edges: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges met on a walk from each root: those leaving the root or a reached node."""
    starts = pairs.select("root", F.col("node").alias("src")).unionByName(roots.select("root", F.col("root").alias("src")))
    return starts.distinct().join(edges, "src").select("root", *edges.columns)


def reach_counts(edges: DataFrame) -> DataFrame:
    """Rows (node, reached, itself): distinct nodes behind each node, and whether it is one of them.

    From the reachability index; where the condensed graph is too large for
    one, from all pairs of its nodes.
    """
    index = build_index(edges)
    if index:
        return index.counts()
    pairs = reach_all(edges)
    return pairs.groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("reached"), (F.count_if(F.col("root") == F.col("node")) > 0).alias("itself"))


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) pairs for the given roots: read from the index, or walked where there can be none."""
    index = build_index(edges)
    return index.pairs(roots) if index else reach_from(edges, roots)


def blast_radius(counts: DataFrame) -> DataFrame:
    """Distinct nodes behind each root that has any (a root inside a loop counts itself)."""
    return counts.where("reached > 0").select(F.col("node").alias("root"), F.col("reached").alias("blast_radius"))


def impact(counts: DataFrame, nodes: DataFrame, change_type: Column) -> DataFrame:
    """Affected nodes other than the root, the risk, and the reports involved."""
    hit = counts.select(F.col("node").alias("root"), (F.col("reached") - F.col("itself").cast("long")).alias("n"))
    n = F.coalesce("n", F.lit(0))
    risk = (
        F.when(n > 3, "CRITICAL")
        .when((n > 1) | ((change_type == "schema_change") & (n > 0)), "HIGH")
        .when(n == 1, "MEDIUM")
        .otherwise("LOW")
    )
    return nodes.join(hit, "root", "left").select(
        "root", change_type.alias("change_type"), n.alias("affected"), (n * 2).alias("affected_reports"), risk.alias("risk")
    )


def _chain_ends(single: DataFrame) -> DataFrame:
    """(src, dst): where the chain of single ways out that starts at src ends; NULL if it never does.

    Every round doubles the steps taken twice, so a chain of n nodes is
    followed in log4(n) stored rounds; what still moves after more steps than
    there are nodes runs in a loop.
    """
    steps, n = settle(single), single.count()

    def double(s: DataFrame) -> DataFrame:
        ahead = s.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        return s.select("src", "dst").join(ahead, "dst", "left").select("src", F.coalesce("far", "dst").alias("dst"), F.col("far").isNotNull().alias("moves"))

    for _ in range(max(1, n).bit_length() // 2 + 1):
        steps = settle(double(double(steps)))
        if not _any(steps.where("moves")):
            break
    still = steps.join(single.select(F.col("src").alias("dst"), F.lit(True).alias("on")), "dst", "left")
    return still.select("src", F.when(F.col("on").isNull(), F.col("dst")).alias("dst"))


def _peeled(live: DataFrame, loops: DataFrame, peels: int = 4) -> DataFrame:
    """Edges that are left when those into nodes without a way out go, several times over."""
    for _ in range(peels):
        onward = live.select(F.col("src").alias("dst")).union(loops.select(F.col("node").alias("dst"))).distinct()
        live = live.join(onward, "dst", "left_semi").select("src", "dst")
    return live


def meets_cycle(edges: DataFrame) -> DataFrame:
    """For each node, whether a walk from it can come to a cycle.

    Read from the reachability index where there can be one. Else, edges into dead ends are dropped, and chains of nodes with one way out are
    followed to their end at once, in turns; what remains in the end leads to a
    cycle. No path pairs are formed.
    """
    index = build_index(edges)
    if index:
        return index.meets_cycle()
    live = settle(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    loops = nodes.where("false")  # nodes known to meet a cycle
    ends: list[DataFrame] = []  # per turn: (src, dst) of the chains followed
    while True:
        before, live = live.count(), settle(_peeled(live, loops))
        left = live.count()
        if not left:
            break
        if left < 0.9 * before:
            continue  # dropping is still quick, as in wide, flat graphs
        single = settle(live.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).where("n = 1").select("src", "dst"))
        if not _any(single):
            if left < before:
                continue
            # Nothing to follow and nothing to drop: every way goes on for ever.
            loops = settle(loops.union(live.select(F.col("src").alias("node"))).distinct())
            break
        chains = settle(_chain_ends(single))
        ends.append(chains)
        # Ways out of branching nodes, followed through chains; a way into a loop decides.
        wide = live.join(single.select("src"), "src", "left_anti")
        far = chains.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.lit(True).alias("chained"))
        onward = settle(wide.join(far, "dst", "left").select("src", F.when(F.col("chained"), F.col("far")).otherwise(F.col("dst")).alias("dst")).distinct())
        looped = chains.where("dst IS NULL").select(F.col("src").alias("node"))
        hit = onward.where("dst IS NULL").select(F.col("src").alias("node"))
        known = onward.join(loops.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
        loops = settle(loops.union(looped).union(hit).union(known).distinct())
        live = settle(onward.where("dst IS NOT NULL").join(loops.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
    for chains in reversed(ends):
        found = chains.join(loops.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
        loops = settle(loops.union(found).distinct())
    return nodes.join(loops.withColumn("_c", F.lit(True)), "node", "left").select("node", F.coalesce("_c", F.lit(False)).alias("meets_cycle"))


def version_lineage(versions: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Parent of each version: the one named, else the version before it."""
    w = Window.partitionBy("dataset_id").orderBy("version_number")
    df = versions.withColumn("_prev", F.lag("version_number").over(w))
    parent = F.col("_prev")
    if explicit is not None:
        df = df.join(explicit.select("dataset_id", "version_number", F.col("parent_version").alias("_ask")), ["dataset_id", "version_number"], "left")
        parent = F.coalesce("_ask", "_prev")
    return df.select("dataset_id", "version_number", parent.alias("parent_version"))
