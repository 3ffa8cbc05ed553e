"""The part of a knowledge graph that a question needs: neighbours by kind, what shares a technique, citations, and claims within a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged


@dataclass(frozen=True)
class Focus:
    """Kinds of neighbours that are taken, edges to claims that are taken first, how many claims a paper shows, and edges that fill up the rest."""

    structural: tuple[str, ...]
    claims: tuple[str, ...]
    most: int
    fallback: tuple[str, ...] = ("has_limitation", "compares", "contributes", "addresses_problem")


# What each intent looks at.
FOCUS = {
    "comparison": Focus(("paper", "method", "technique"), ("compares", "outperforms", "contributes"), 8),
    "limitation": Focus(("paper", "method", "technique"), ("has_limitation", "addresses_problem", "contributes"), 10),
    "hardware": Focus(("paper", "method", "technique", "hardware"), ("contributes", "compares"), 5),
    "technical": Focus(("paper", "method", "technique"), ("contributes", "implements_step", "addresses_problem"), 8),
    "evaluation": Focus(("paper", "method", "technique", "hardware"), ("compares", "outperforms", "contributes"), 8),
}
GENERAL = Focus(("paper", "method", "technique", "hardware"), ("has_limitation", "compares", "contributes", "addresses_problem"), 5)
CLAIMS = ("contribution", "comparison", "limitation", "problem")


def typed(nodes: DataFrame, ids: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return ids.join(nodes.where(F.col("type").isin(*kinds)).select("id"), "id", "left_semi").select("id")


def into(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Sources of edges that lead to ``ids``."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("id"))


def frontier(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, focus: Focus) -> DataFrame:
    """(id): seeds; their neighbours of the kinds wanted; papers that touch a technique among these, and the methods of those papers; papers cited by and citing a seed."""
    out = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), "type")
    back = edges.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "type")
    near = staged(seeds.select("id").union(typed(nodes, out.union(back).select("id").distinct(), focus.structural)).distinct())
    sharing = staged(typed(nodes, into(edges, typed(nodes, near, ("technique",))).distinct(), ("paper",)))
    methods = typed(nodes, into(edges, sharing).distinct(), ("method",))
    cited = out.union(back).where("type = 'cites'").select("id")
    return near.union(sharing).union(methods).union(cited).distinct()


def claims_within(edges: DataFrame, seeds: DataFrame, known: DataFrame, focus: Focus) -> DataFrame:
    """(id): per seed its first ``most`` claims, and where it has fewer, what other edges lead to, first edges first, until there are as many.

    A filling target counts only if nothing before took it: not what is ``known``, nor a claim of this or an earlier seed, nor a filling of an earlier one. Seeds
    are settled all at once and again with what the earlier ones took, until nothing changes; that is after as many rounds as there are
    seeds that depend on each other.
    """
    own = edges.join(seeds.select(F.col("id").alias("src"), "place"), "src")
    order = W.partitionBy("src").orderBy("seq")  # the edges of one seed
    first = own.where(F.col("type").isin(*focus.claims)).withColumn("at", F.row_number().over(order)).where(F.col("at") <= focus.most)
    first = staged(first.select("src", "place", F.col("dst").alias("id")))
    left = seeds.select(F.col("id").alias("src"), "place").join(first.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src", "left").select("src", (F.lit(focus.most) - F.coalesce("n", F.lit(0))).alias("left"))
    filling = own.where(F.col("type").isin(*focus.fallback)).select("src", "place", F.col("dst").alias("id"), "seq").join(known.select("id"), "id", "left_anti")
    earliest = first.groupBy("id").agg(F.min("place").alias("taken"))
    open_ = filling.join(earliest, "id", "left").where(F.col("taken").isNull() | (F.col("taken") > F.col("place"))).drop("taken")
    open_ = staged(open_.groupBy("src", "place", "id").agg(F.min("seq").alias("seq")).join(left.where("left > 0"), "src"))
    chosen = staged(open_.select("id", "place").limit(0))
    while True:
        before = chosen.groupBy("id").agg(F.min("place").alias("taken"))
        free = open_.join(before, "id", "left").where(F.col("taken").isNull() | (F.col("taken") >= F.col("place")))
        now = staged(free.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("left")).select("id", "place"))
        if now.exceptAll(chosen).isEmpty() and chosen.exceptAll(now).isEmpty():
            return first.select("id").union(chosen.select("id")).distinct()
        chosen = now


def focused(nodes: DataFrame, edges: DataFrame, papers: DataFrame, intent: str = "general", focus: Focus | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, type, subtype, degree), (src, dst, type)): the nodes and links that a question about ``papers`` (id, place) needs.

    ``nodes`` has id and type, ``edges`` src, dst, type and seq, which orders them. Claims of any kind are of type claim, their kind the
    subtype. A degree counts the neighbours that are shown too. Of edges between two nodes the first stays. Papers that are not in the graph are left out.
    """
    focus = focus or FOCUS.get(intent, GENERAL)
    seeds = staged(papers.join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.min("place").alias("place")))
    known = staged(frontier(nodes, edges, seeds, focus))
    shown = staged(known.union(claims_within(edges, seeds, known, focus)).distinct().join(nodes.select("id"), "id", "left_semi"))
    inside = edges.join(shown.select(F.col("id").alias("src")), "src", "left_semi").join(shown.select(F.col("id").alias("dst")), "dst", "left_semi")
    links = staged(inside.groupBy("src", "dst").agg(F.min(F.struct("seq", "type")).alias("e")).select("src", "dst", F.col("e.type").alias("type")))
    ends = links.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(links.select("dst", "src")).distinct()
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    kind = F.when(F.col("type").isin(*CLAIMS), "claim").otherwise(F.col("type"))
    found = nodes.join(shown, "id", "left_semi").join(degree, "id", "left").select("id", kind.alias("type"), F.col("type").alias("subtype"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return found, links
