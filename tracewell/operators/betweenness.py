"""Betweenness of all nodes: shortest paths counted from many sources at a time, level by level.

The state of a batch of sources is one row per source and node that it reaches: the distance and the number of
shortest paths. A level is a join of the last one with the edges; when no new node is reached, dependencies are summed back from the
farthest level to the nearest, again one join a level. Every level is written, so a lost executor costs its tasks only, and no task
holds a graph or a source's whole state. A batch holds ``batch`` sources, which bounds its tables at so many times the nodes.

The pairs of source and node are the square of the nodes, so joins would move far more than any input. While edges and nodes are few enough to be
copied, as a table that is broadcast is (``LARGEST``), only they move: sources are dealt to ``SHARES`` tasks, each gets the edges once, counts the
paths of its sources in arrays of a fixed size and sends one sum a node. Larger graphs take the joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .ranks import numbered

#: Edges, and nodes, of a graph that is copied to all shares of the sources, and the number of these.
LARGEST, SHARES = 4_000_000, 96
#: Edges of a row while they are copied, and pairs of source and edge that a task holds at a time.
ROW, HELD = 65_536, 1 << 20


def reached(edges: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Per distance from 0 on: (source, node, paths) of the nodes at it and the number of shortest paths to them."""
    level = staged(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("source", "node")
    while True:
        step = level.join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = staged(step.join(seen, ["source", "node"], "left_anti"))
        if level.isEmpty():
            return levels
        levels.append(level)
        seen = seen.unionByName(level.select("source", "node"))


def dependencies(edges: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(id, amount): what the batch's sources depend on each node, themselves not counted."""
    below, parts = None, []
    for level, before in zip(levels[:0:-1], levels[-2::-1], strict=True):
        told = level.withColumn("depends", F.lit(0.0)) if below is None else level.join(below, ["source", "node"], "left").fillna({"depends": 0.0})
        told = staged(told)
        parts.append(told.groupBy(F.col("node").alias("id")).agg(F.sum("depends").alias("amount")))
        share = told.select("source", "node", ((1 + F.col("depends")) / F.col("paths")).alias("share")).join(edges, F.col("node") == F.col("dst")).select("source", F.col("src").alias("node"), "share")
        below = share.join(before, ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("share") * F.col("paths")).alias("depends"))
    if not parts:
        return levels[0].select(F.col("node").alias("id"), F.lit(0.0).alias("amount")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("id").agg(F.sum("amount").alias("amount"))


def depended(first: np.ndarray, targets: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What ``sources`` depend on each node, themselves not counted; node i's edges lead to targets[first[i]:first[i + 1]].

    A cell is a source's place and a node; all sources walk together, a level at a time, and each looks at an edge once.
    """
    n = len(first) - 1
    paths, depends = np.zeros(n * len(sources)), np.zeros(n * len(sources))
    seen, last = np.zeros(len(paths), bool), np.empty(len(paths), np.int64)
    own = np.arange(len(sources)) * n + sources
    level, arcs = own, []
    paths[own], seen[own] = 1.0, True
    while len(level):
        node = level % n
        begin, degree = first[node], first[node + 1] - first[node]
        origin = np.repeat(level, degree)
        at = np.arange(len(origin)) + np.repeat(begin - np.cumsum(degree) + degree, degree)
        target = np.repeat(level - node, degree) + targets[at]
        new = ~seen[target]
        origin, target = origin[new], target[new]
        np.add.at(paths, target, paths[origin])
        last[target] = np.arange(len(target))
        level = target[last[target] == np.arange(len(target))]  # each cell once
        seen[level] = True
        arcs.append((origin, target))
    for origin, target in reversed(arcs):
        np.add.at(depends, origin, paths[origin] * ((1 + depends[target]) / paths[target]))
    depends[own] = 0.0
    return depends.reshape(len(sources), n).sum(axis=0)


def in_shares(nodes: DataFrame, edges: DataFrame, n: int, m: int) -> DataFrame:
    """(id, amount): what all of the ``n`` nodes depend on each, the ``m`` edges copied to each share of the sources."""
    places = staged(numbered(nodes, [], ["id"], "at").withColumn("at", F.col("at") - 1))
    ends = edges.join(places.select(F.col("id").alias("src"), F.col("at").alias("a")), "src").join(places.select(F.col("id").alias("dst"), F.col("at").alias("b")), "dst")
    rows = staged(ends.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(-(-m // ROW))).alias("row")).agg(F.collect_list(F.struct("a", "b")).alias("e")).select(F.col("e.a").alias("a"), F.col("e.b").alias("b")))
    shares = min(SHARES, n)
    copies = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(3 * shares, "share")

    def told(edges_of_share: pa.Table) -> pa.Table:
        a, b = (edges_of_share.column(c).combine_chunks().flatten().to_numpy() for c in ("a", "b"))
        first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
        targets = b[np.argsort(a, kind="stable")]
        mine = np.arange(edges_of_share.column("share")[0].as_py(), n, shares)
        at_once = max(1, HELD // max(n, len(a)))
        total = np.zeros(n)
        for i in range(0, len(mine), at_once):
            total += depended(first, targets, mine[i : i + at_once])
        return pa.table({"at": np.arange(n), "amount": total})

    sums = copies.groupBy("share").applyInArrow(told, "at long, amount double").groupBy("at").agg(F.sum("amount").alias("amount"))
    return places.join(sums, "at").select("id", "amount")


def betweenness(edges: DataFrame, directed: bool = True, batch: int = 1024, largest: int = LARGEST) -> DataFrame:
    """(id, betweenness): the share of all ordered pairs whose shortest paths pass a node, paths of equal length counting in parts.

    All nodes that an edge touches are sources. Repeated edges and edges from a node to itself count for nothing; with ``directed`` false, edges lead
    both ways. Graphs of fewer than three nodes have no pairs, so 0. Graphs of more than ``largest`` edges or nodes are met by joins, ``batch`` sources at a time.
    """
    ends = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = staged(ends.select(F.col("src").alias("id")).union(ends.select("dst")).distinct())
    both = ends if directed else ends.union(ends.select("dst", "src"))
    known = staged(both.where("src <> dst").distinct())
    n, m = nodes.count(), known.count()
    if 0 < m <= largest and n <= largest:
        sums = in_shares(nodes, known, n, m)
    else:
        batches = max(1, -(-n // batch))
        total = None
        for i in range(batches):
            sources = nodes.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i) if batches > 1 else nodes
            part = staged(dependencies(known, reached(known, sources)))
            total = part if total is None else total.unionByName(part)
        sums = total.groupBy("id").agg(F.sum("amount").alias("amount"))
    pairs = float((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(sums, "id", "left").select("id", (F.coalesce("amount", F.lit(0.0)) / pairs).alias("betweenness"))
