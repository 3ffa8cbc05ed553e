"""Property-graph operators over nodes(id, type) and edges(src, dst, type, weight)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .blocks import best_in_blocks
from .relational import shared_counts
from .retrieval import millionths, top_k


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): the last by ``seq``, as in a simple directed graph."""
    return edges.groupBy("src", "dst").agg(F.max(F.struct("seq", "type", "weight")).alias("e")).select("src", "dst", "e.type", "e.weight")


def degrees(edges: DataFrame) -> DataFrame:
    """Per node: distinct neighbours, in- and out-edges."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("out")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(0).alias("out")))
    return ends.groupBy("id").agg(F.countDistinct("other").alias("degree"), F.sum("out").alias("out_degree"), F.sum(1 - F.col("out")).alias("in_degree"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """Weighted PageRank of all nodes that an edge touches; dangling mass is spread evenly.

    Edges are normalised once and keep their partitioning by source. Ranks are checkpointed every few rounds so
    that plans stay short; what moves in a round is one partial sum per node and map task.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    dangling = nodes.join(flow.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    for i in range(iterations):
        moved = ranks.join(flow, ranks["id"] == flow["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        lost = ranks.join(dangling, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        ranks = nodes.join(moved, "id", "left").crossJoin(F.broadcast(lost)).select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (i + 1) % every == 0:
            ranks = cut(ranks)
    return ranks


def two_hop(edges: DataFrame, via: str, least: int = 1) -> DataFrame:
    """Unordered pairs of sources that share destinations of one edge type, with how many they share; hubs are met block against block."""
    return shared_counts(edges.where(F.col("type") == via), "dst", "src", "shared").where(F.col("shared") >= least)


def metapath(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct pairs src - dst over first(src, mid) and second(mid, dst), with their number of paths."""
    return first.groupBy("src", "mid").agg(F.count(F.lit(1)).alias("n")).join(second.groupBy("mid", "dst").agg(F.count(F.lit(1)).alias("m")), "mid").groupBy("src", "dst").agg(F.sum(F.col("n") * F.col("m")).alias("paths"))


def subgraph(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges among the seeds and what one hop reaches from them."""
    hop = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    kept = seeds.select("id").union(hop).distinct()
    return edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")


def view_filter(nodes: DataFrame, edges: DataFrame, hidden: list[str], least: float) -> DataFrame:
    """Visible nodes that keep an edge: both ends visible, and confidence reached unless observed."""
    shown = nodes.where(~F.col("type").isin(hidden)).select("id", "type")
    kept = edges.where(F.col("observed") | (F.col("confidence") >= least))
    kept = kept.join(shown.select(F.col("id").alias("src")), "src", "left_semi").join(shown.select(F.col("id").alias("dst")), "dst", "left_semi")
    ends = kept.select(F.col("src").alias("id")).union(kept.select("dst")).distinct()
    return shown.join(ends, "id", "left_semi")


def symmetric(pairs: DataFrame, close: float = 0.02) -> DataFrame:
    """One row per unordered pair: the better direction, marked bidirectional if both scores are close."""
    key = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    g = pairs.select(*key, "src", "score").groupBy("a", "b").agg(F.max(F.struct("score", "src")).alias("best"), F.min("score").alias("low"), F.countDistinct("src").alias("n"))
    return g.select("a", "b", F.col("best.score").alias("score"), ((F.col("n") == 2) & (F.round(F.col("best.score") - F.col("low"), 9) <= close)).alias("bidirectional"))


def mutual(wins: DataFrame) -> DataFrame:
    """Contradictions: pairs that claim to beat each other in the same cell."""
    w = wins.groupBy("metric", "dataset", "condition", "winner", "loser").agg(F.count(F.lit(1)).alias("n"), F.max("margin").alias("margin"))
    back = w.select("metric", "dataset", "condition", F.col("loser").alias("winner"), F.col("winner").alias("loser"), F.col("n").alias("n_back"), F.col("margin").alias("margin_back"))
    return w.join(back, ["metric", "dataset", "condition", "winner", "loser"]).where("winner < loser")


def distmult(pairs: DataFrame, vectors: DataFrame, relation: list[float]) -> DataFrame:
    """Sigmoid of sum(src * relation * dst) for candidate pairs of vectors."""
    v = vectors.select("id", F.col("vector").cast("array<double>").alias("x"))
    met = pairs.join(v.select(F.col("id").alias("src"), F.col("x").alias("p")), "src").join(v.select(F.col("id").alias("dst"), F.col("x").alias("q")), "dst")
    weight = F.array(*[F.lit(float(r)) for r in relation])
    raw = F.aggregate(F.zip_with(F.zip_with("p", weight, lambda a, b: a * b), "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return met.select("src", "dst", F.round(1 / (1 + F.exp(-raw)), 6).alias("score"))


def top_predictions(scored: DataFrame, known: DataFrame, k: int, least: float) -> DataFrame:
    """The k best new links of each source: not known, not to itself, at least ``least``."""
    new = scored.where((F.col("src") != F.col("dst")) & (F.col("score") >= least)).join(known, ["src", "dst"], "left_anti")
    return new.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("rank") <= k)


def best_links(vectors: DataFrame, sources: DataFrame, relation: list[float], known: DataFrame, k: int, least: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, score, rank): of ``sources`` and the ``vectors`` of equal ``within``, what ``top_predictions`` of ``distmult`` finds, without a row a pair.

    Both are met block by block, known links (src, dst) go where their pair is scored. Vectors that are null, hold null or have another length than ``relation`` link with nothing.
    """
    weight = np.array(relation, float)

    def whole(df: DataFrame) -> DataFrame:
        return df.where((F.size("embedding") == len(relation)) & F.forall("embedding", lambda x: x.isNotNull()))

    def score(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-((p * weight) @ q.T)))

    links = known.select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"))
    found = best_in_blocks(whole(vectors), whole(sources), k, score, millionths, list(within), known=links).withColumn("score", F.round("score", 6))
    best = top_k(found.where(F.col("score") >= least), k, ["query_id"], "vec_id")
    return best.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "score", "rank")
