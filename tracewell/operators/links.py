"""Edges between chunks, items and clusters that are alike: by meaning, by predicted links, by shared values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import met, split_values
from .retrieval import nearest

# Roles whose chunks are linked to those of their own role.
LINKABLE = ("problem_statement", "algorithm_description", "experimental_setup", "result", "limitation")


def semantic_edges(chunks: DataFrame, k: int = 5, least: float = 0.72, role_k: int = 3, role_least: float = 0.66, roles: tuple[str, ...] = LINKABLE) -> DataFrame:
    """(src, dst, score, relation): each chunk's ``k`` nearest of other papers, and for the roles told its ``role_k`` nearest of other papers and its own role.

    ``chunks`` has vec_id, paper, role and embedding. Thresholds apply after the nearest are chosen, so a chunk has fewer edges, never other
    ones. Chunks of one paper are never linked; a chunk without a paper is linked with any. An edge that both rules give is a role edge.
    """
    any_role = nearest(chunks, chunks, k, apart="paper").where(F.col("score") >= least).select("query_id", "vec_id", "score", F.lit(0).alias("by_role"))
    kept = chunks.where(F.col("role").isin(*roles))
    own_role = nearest(kept, kept, role_k, ("role",), apart="paper").where(F.col("score") >= role_least).select("query_id", "vec_id", "score", F.lit(1).alias("by_role"))
    both = any_role.unionByName(own_role).groupBy(F.col("query_id").alias("src"), F.col("vec_id").alias("dst")).agg(F.max("score").alias("score"), F.max("by_role").alias("by_role"))
    return both.select("src", "dst", "score", F.when(F.col("by_role") == 1, "same_role").otherwise("similar_to").alias("relation"))


def predicted_links(scored: DataFrame, known: DataFrame, vectors: DataFrame, k: int = 5, least: float = 0.5, alike: float = 0.3) -> DataFrame:
    """(src, relation, dst, score, similarity, rank): each source's ``k`` best new links of a relation, not to itself and not ``known``.

    ``scored`` has src, relation, dst, score, src_type and dst_type. Links between nodes of one type must also be alike in meaning, by cosine of
    their vectors (id, vector); without a vector they go. The filter follows the choice, so it leaves fewer links, never other ones.
    """
    new = scored.where((F.col("src") != F.col("dst")) & (F.col("score") >= least)).join(known.select("src", "relation", "dst"), ["src", "relation", "dst"], "left_anti")
    best = new.withColumn("rank", F.row_number().over(W.partitionBy("src", "relation").orderBy(F.desc("score"), "dst"))).where(F.col("rank") <= k)
    own = vectors.select("id", F.col("vector").cast("array<double>").alias("v"))
    met_ = best.join(own.select(F.col("id").alias("src"), F.col("v").alias("a")), "src", "left").join(own.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst", "left")

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    scale = F.sqrt(dot("a", "a") * dot("b", "b"))
    told = met_.withColumn("similarity", F.round(dot("a", "b") / F.when(scale > 0, scale), 6))
    return told.where((F.col("src_type") != F.col("dst_type")) | (F.col("similarity") >= alike)).select("src", "relation", "dst", "score", "similarity", "rank")


def cluster_overlap(items: DataFrame, cluster: str, columns: tuple[str, ...], least: float = 0.05) -> DataFrame:
    """(a, b, overlap): pairs of clusters with the mean over all ``columns`` of the Jaccard similarity of their value sets, where it exceeds ``least``.

    Cells hold several values. Clusters without a value in a column share nothing there; the mean is over all columns.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), split_values(F.coalesce(F.col(c), F.lit(""))).alias("values")) for c in columns])
    told = items.select(F.col(cluster).alias("cluster"), F.explode(cells).alias("c")).select("cluster", "c.column", F.explode("c.values").alias("value"))
    sets = told.withColumn("value", F.lower("value")).distinct().withColumn("item", F.concat_ws("|", "column", "value"))
    sizes = sets.groupBy("cluster", "column").agg(F.count(F.lit(1)).alias("n"))
    common = met(sets, "item", "cluster").groupBy("a", "b", F.split_part("item", F.lit("|"), F.lit(1)).alias("column")).agg(F.count(F.lit(1)).alias("common"))
    both = common.join(sizes.select(F.col("cluster").alias("a"), "column", F.col("n").alias("na")), ["a", "column"]).join(sizes.select(F.col("cluster").alias("b"), "column", F.col("n").alias("nb")), ["b", "column"])
    scored = both.groupBy("a", "b").agg(F.round(F.sum(F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))) / len(columns), 6).alias("overlap"))
    return scored.where(F.col("overlap") > least)


def cross_cluster_edges(items: DataFrame, key: str, cluster: str, columns: tuple[str, ...], least: int = 3) -> DataFrame:
    """(a, b, shared): pairs of items of different clusters that share a value in ``least`` columns or more; a column counts once."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), split_values(F.coalesce(F.col(c), F.lit(""))).alias("values")) for c in columns])
    told = items.select(F.col(key).alias("key"), F.explode(cells).alias("c")).select("key", "c.column", F.explode("c.values").alias("value"))
    rows = told.select("key", F.concat_ws("|", "column", F.lower("value")).alias("item"))
    shared = met(rows, "item", "key").groupBy("a", "b").agg(F.countDistinct(F.split_part("item", F.lit("|"), F.lit(1))).alias("shared")).where(F.col("shared") >= least)
    own = items.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"))
    ends = shared.join(own.select(F.col("key").alias("a"), F.col("cluster").alias("ca")), "a").join(own.select(F.col("key").alias("b"), F.col("cluster").alias("cb")), "b")
    return ends.where(~F.col("ca").eqNullSafe(F.col("cb"))).select("a", "b", "shared")


def content_channels(chunks: DataFrame, paper: str, roles: tuple[str, ...], contents: tuple[str, ...], densities: tuple[str, ...], topics: tuple[str, ...]) -> DataFrame:
    """(paper, channels): per paper the shares of its chunks' roles and contents, the mean ``densities`` up to 1, and whether any chunk has each topic, in that order.

    ``chunks`` has role, content, columns of counts per word named in ``densities`` and topics, an array. A paper's row is one aggregate.
    """
    n = F.count(F.lit(1))
    parts: list[Column] = [F.count_if(F.col("role") == r) / n for r in roles] + [F.count_if(F.col("content") == c) / n for c in contents]
    parts += [F.least(F.lit(1.0), F.coalesce(F.avg(d), F.lit(0.0))) for d in densities]
    parts += [F.max(F.coalesce(F.array_contains("topics", t), F.lit(False)).cast("double")) for t in topics]
    return chunks.groupBy(F.col(paper).alias("paper")).agg(F.array(*[F.round(p, 6) for p in parts]).alias("channels"))


def dropped_edges(edges: DataFrame, share: float, seed: str = "0") -> DataFrame:
    """Edges that stay when ``share`` of all are dropped: a seeded digest of an edge decides, so reruns agree and no task counts."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "src", "dst", "type")), 1, 8), 16, 10).cast("double") / 2.0**32
    return edges.where(digest >= share)


def masked_features(nodes: DataFrame, share: float, seed: str = "0") -> DataFrame:
    """Nodes with about ``share`` of the dimensions of their features set to 0, the same ones for all nodes; which, a seeded digest says."""
    def kept(i: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), i.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32 >= share

    return nodes.withColumn("features", F.transform("features", lambda x, i: F.when(kept(i), x.cast("double")).otherwise(0.0)))


def unmatched(methods: DataFrame, papers: DataFrame, matches: DataFrame) -> DataFrame:
    """(side, name): methods without a paper and papers without a method, of what was matched (method, paper)."""
    lone = [methods.select("method").distinct().join(matches.select("method"), "method", "left_anti").select(F.lit("method").alias("side"), F.col("method").alias("name")),
            papers.select("paper").distinct().join(matches.select("paper"), "paper", "left_anti").select(F.lit("paper").alias("side"), F.col("paper").alias("name"))]
    return reduce(DataFrame.unionByName, lone)
