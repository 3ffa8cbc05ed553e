"""Corpus facts, reports and orders over nodes, edges, records and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .kg import first_ones
from .ranks import numbered


def histogram(rows: DataFrame, column: str, claims: tuple[str, ...] = ()) -> DataFrame:
    """(item, n, is_claim): counts by type."""
    return rows.groupBy(F.col(column).alias("item")).agg(F.count(F.lit(1)).alias("n")).withColumn("is_claim", F.col("item").isin(*claims) if claims else F.lit(False))


def top_targets(edges: DataFrame, nodes: DataFrame, relation: str, k: int, least: int = 1) -> DataFrame:
    """(label, n, place): the labels that most edges of a relation point at; a top-k report."""
    told = edges.where(F.col("type") == relation).join(nodes.select(F.col("id").alias("dst"), "label"), "dst").where("label <> ''")
    counts = told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "label").limit(k)
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "label")))


def top_by_papers(edges: DataFrame, nodes: DataFrame, relation: str, k: int, shown: int, least: int = 1) -> DataFrame:
    """(label, n, papers): the targets of a relation with most different papers, and the first few of these; a top-k report."""
    told = edges.where(F.col("type") == relation).join(nodes.select(F.col("id").alias("dst"), "label"), "dst").select("label", F.col("src").alias("paper")).distinct()
    best = told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "label").limit(k)
    few = first_ones(told, ["label"], [F.col("paper")], shown).groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("paper")), ",").alias("papers"))
    return best.join(few, "label")


def corpus_facts(nodes: DataFrame, edges: DataFrame, boards: DataFrame, methods: DataFrame) -> DataFrame:
    """(fact, name, amount): most cited, most central, most compared and most benchmarked, newest and oldest; ties go to the smaller name.

    ``nodes`` has pagerank and n_comparisons, ``methods`` name and year.
    """
    def most(rows: DataFrame, fact: str, amount: Column, name: str) -> DataFrame:
        best = rows.select(amount.cast("double").alias("amount"), F.col(name).alias("name")).where("amount IS NOT NULL").agg(F.min(F.struct((-F.col("amount")).alias("a"), "name")).alias("b"))
        return best.where("b IS NOT NULL").select(F.lit(fact).alias("fact"), "b.name", (-F.col("b.a")).alias("amount"))

    papers = nodes.where("type = 'paper'")
    cited = edges.where("type = 'cites'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(papers.select("id", "label"), "id")
    facts = [
        most(cited, "most_cited", F.col("n"), "label"), most(papers, "most_influential", F.col("pagerank"), "label"), most(papers.where("n_comparisons > 0"), "most_compared", F.col("n_comparisons"), "label"),
        most(boards.groupBy("method").agg(F.count(F.lit(1)).alias("n")), "most_benchmarked", F.col("n"), "method"), most(methods, "newest", F.col("year"), "name"), most(methods, "oldest", -F.col("year"), "name"),
    ]
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return out.withColumn("amount", F.abs("amount"))


def retrieved_analytics(chunks: DataFrame, k: dict[str, int]) -> DataFrame:
    """(facet, item, n): counts of retrieved chunks by each facet, the ``k`` most frequent (all where k is 0); a top-k report."""
    items = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("item")) for c in k])
    counts = chunks.select(F.explode(items).alias("x")).select("x.*").where("item IS NOT NULL").groupBy("facet", "item").agg(F.count(F.lit(1)).alias("n"))
    most = F.coalesce(*[F.when(F.col("facet") == c, F.lit(n or 2**31 - 1)) for c, n in k.items()])
    ranked = counts.withColumn("place", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "item")))
    return ranked.where(F.col("place") <= most).drop("place")


def citation_counts(chunks: DataFrame, k: int) -> DataFrame:
    """(citation, n, n_docs): author-year citations by how often they stand and in how many documents; a top-k report."""
    pattern = r"(\([A-Z][a-z]+(?:\s+(?:et\s+al\.|and\s+[A-Z][a-z]+))?[.,]*\s*\d{4}\))"
    found = chunks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("citation"))
    return found.groupBy("citation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).orderBy(F.desc("n"), "citation").limit(k)


def fractions(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, item, n, share): counts of a column's values in each group and their share of it."""
    counts = rows.groupBy(key, F.col(column).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(key)), 6))


def cluster_labels(rows: DataFrame, cluster: str, columns: tuple[str, ...], k: int = 3) -> DataFrame:
    """(cluster, column, place, item, n): the ``k`` most frequent values of each column in each cluster."""
    long = rows.select(F.col(cluster).alias("cluster"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("item")) for c in columns])).alias("x"))
    counts = long.groupBy("cluster", "x.column", "x.item").agg(F.count(F.lit(1)).alias("n"))
    return first_ones(counts, ["cluster", "column"], [F.desc("n"), F.col("item")], k)


def majority_cluster(rows: DataFrame, cluster: str, column: str) -> DataFrame:
    """(item, cluster, n): for each value the cluster that most of its rows are in."""
    counts = rows.groupBy(F.col(column).alias("item"), F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("item").agg(F.min(F.struct((-F.col("n")).alias("a"), "cluster")).alias("b")).select("item", "b.cluster", (-F.col("b.a")).alias("n"))


def centroids(rows: DataFrame, group: str, *axes: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(a), 6).alias(a) for a in axes])


def entity_detail(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """(relation, n, first_year, last_year, dominant): a node's neighbours by relation, the span of their years, and whether it is the most frequent one."""
    ends = edges.where((F.col("src") == node) | (F.col("dst") == node)).select("type", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
    told = ends.join(nodes.select("id", "year"), "id").groupBy(F.col("type").alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return told.withColumn("dominant", F.row_number().over(W.orderBy(F.desc("n"), "relation")) == 1)


def connections(edges: DataFrame, nodes: DataFrame, node: str, order: tuple[str, ...]) -> DataFrame:
    """(place, relation, ids): a node's distinct neighbours by relation, relations in a fixed order, others after it by name."""
    ends = edges.where((F.col("src") == node) | (F.col("dst") == node)).select("type", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id")).join(nodes.select("id"), "id", "left_semi")
    groups = ends.groupBy("type").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))
    at = F.coalesce(*[F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(order)], F.lit(len(order)))
    return groups.select(F.row_number().over(W.orderBy(at, "type")).alias("place"), F.col("type").alias("relation"), "ids")


def counts_over(edges: DataFrame, least: float) -> DataFrame:
    """(type, n) of predictions at or over a confidence."""
    return edges.where(F.col("confidence") >= least).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def node_rollups(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...], shown: int) -> DataFrame:
    """(id, label, shared_by, papers): how many papers point at each node of ``kinds``, none included, and the first few of them."""
    told = edges.select(F.col("dst").alias("id"), "src").distinct()
    counts = told.groupBy("id").agg(F.count(F.lit(1)).alias("shared_by"))
    few = first_ones(told, ["id"], [F.col("src")], shown).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("papers"))
    rows = nodes.where(F.col("type").isin(*kinds)).select("id", "label")
    return rows.join(counts, "id", "left").join(few, "id", "left").fillna({"shared_by": 0, "papers": ""})


def relation_weights(edges: DataFrame, left_out: tuple[str, ...]) -> DataFrame:
    """(type, n, weight): 1 / ln(1 + n) over its mean, so rare relations weigh more; ``left_out`` relations have no weight."""
    counts = edges.where(~F.col("type").isin(*left_out)).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("raw", 1 / F.log1p("n"))
    return counts.withColumn("weight", F.round(F.col("raw") / F.avg("raw").over(W.partitionBy()), 6)).drop("raw")  # one row per relation


def edges_at(edges: DataFrame, nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, n): edges whose either end has the anchor's label; an edge between equal labels counts once."""
    named = nodes.join(anchors.select(F.col("label"), F.col("label").alias("anchor")), "label").select("id", "anchor")
    ends = edges.withColumn("edge", F.xxhash64("src", "dst", "type")).select("edge", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(named, "id").select("anchor", "edge").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))


def totals(wins: DataFrame, boards: DataFrame, validations: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: numbers of comparisons, leaderboards, validations, indexed methods, grade A and quarantined records."""
    methods = boards.select("method").union(validations.select("method")).union(wins.select(F.col("winner").alias("method"))).distinct()
    one = [
        wins.agg(F.count(F.lit(1)).alias("n_comparisons")), boards.select("metric", "dataset", "condition").distinct().agg(F.count(F.lit(1)).alias("n_leaderboards")),
        validations.agg(F.count(F.lit(1)).alias("n_validations"), F.count_if(F.col("grade") == "A").alias("n_grade_a")), methods.agg(F.count(F.lit(1)).alias("n_methods")), unresolved.agg(F.count(F.lit(1)).alias("n_quarantined")),
    ]
    out = one[0]
    for row in one[1:]:
        out = out.crossJoin(row)  # rows of totals
    return out


def by_strength(results: DataFrame) -> DataFrame:
    """``place`` by evidence: resolved first, then grade A, B, C, none, then method and metric; also by method and label, and by paper."""
    grade = F.when(F.col("grade") == "A", 0).when(F.col("grade") == "B", 1).when(F.col("grade") == "C", 2).otherwise(3)
    needed = ["record_id", "metric", "method", "value", "condition", "paper"]
    results = staged(results.select(*needed, "resolved", grade.alias("grade")))  # ordered three times, and sampled for it
    orders = {
        "by_evidence": [F.desc("resolved"), "grade", F.lower("method"), "record_id", "value", "condition", "paper"],
        "by_method": [F.lower("method"), F.lower("metric"), "record_id", "value", "condition", "paper"],
        "by_protocol": [F.concat_ws("|", "condition", "paper", F.lower("method")), "record_id", "value"],
    }
    for name, order in orders.items():
        results = numbered(results, ["metric"], order, name).drop("resolved", "grade")
    return results.select("record_id", "metric", *orders)


def positions(chunks: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """(key, order, position): each chunk's ordinal over the number of chunks, to two digits, halves up."""
    w = W.partitionBy(key)
    rows = chunks.select(key, order, (F.row_number().over(w.orderBy(order)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.select(key, order, (F.floor((200 * F.col("i") + F.col("n")) / (2 * F.col("n"))) / 100).alias("position"))


def topic_breaks(sentences: DataFrame, least: float, key: str = "doc_id") -> DataFrame:
    """(key, seq, segment): sentences grouped between places where neighbours are less alike than ``least``; ``vector`` of each sentence."""
    w = W.partitionBy(key).orderBy("seq")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    before = F.lag("vector").over(w)
    rows = sentences.withColumn("before", before)
    scale = F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("before"), F.col("before")))
    alike = dot(F.col("vector"), F.col("before")) / F.when(scale == 0, 1.0).otherwise(scale)
    cut = F.when(F.col("before").isNotNull() & (F.round(alike, 9) < least), 1).otherwise(0)
    return rows.select(key, "seq", cut.alias("cut")).select(key, "seq", F.sum("cut").over(w).alias("segment"))


def ranked_candidates(candidates: DataFrame, filtered: DataFrame, papers: DataFrame, cited: list[str], query: str) -> DataFrame:
    """(name, points, place): 4 points if filtered, 3 if one of the retrieved papers is its own, 2 for a cited and 1 for a query word in its name; ties keep their order.

    ``candidates`` has name, paper, place.
    """
    words = F.regexp_extract_all(F.lower("name"), F.lit("([a-z0-9]+)"), 1)
    points = (
        F.when(F.col("is_filtered"), 4).otherwise(0) + F.when(F.col("is_paper"), 3).otherwise(0)
        + F.when(F.arrays_overlap(words, F.array(*map(F.lit, cited))), 2).otherwise(0) + F.when(F.arrays_overlap(words, F.array(*map(F.lit, query.lower().split()))), 1).otherwise(0)
    )
    rows = candidates.join(filtered.select("name", F.lit(True).alias("is_filtered")).distinct(), "name", "left").join(papers.select("paper", F.lit(True).alias("is_paper")).distinct(), "paper", "left")
    return numbered(rows.select("name", "place", points.alias("points")), [], [F.desc("points"), "place", "name"], "rank").select("name", "points", "rank")


def anchors(scored: DataFrame, group: str, k: int = 4, least: float = 0.5) -> DataFrame:
    """The ``k`` best rows of a group among those of ``least`` or more; where fewer than two reach it, the ``k`` best of all."""
    w = W.partitionBy(group)
    rows = scored.withColumn("passing", F.count_if(F.col("score") >= least).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    return rows.where((F.col("place") <= k) & ((F.col("passing") < 2) | (F.col("score") >= least))).drop("passing")


def top_quotes(quotes: DataFrame, anchor: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` best quotes, of anchor papers if these have two or more, else of all; a top-k report."""
    marked = quotes.join(anchor.select("paper", F.lit(True).alias("is_anchor")).distinct(), "paper", "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    some = marked.agg(F.count_if("is_anchor").alias("n_anchor"))
    kept = marked.crossJoin(F.broadcast(some)).where((F.col("n_anchor") < 2) | F.col("is_anchor"))
    return kept.orderBy(F.desc("score"), "quote_id").limit(k).select("quote_id", "paper", "score")


def split_edges(edges: DataFrame, seed: str = "0") -> DataFrame:
    """Edges with part train, valid or test: 80, 10 and 10 in a hundred of each relation in a seeded order, all train under five edges."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), "src", "dst", "type"))
    rows = numbered(edges.select("src", "dst", "type", digest.alias("digest")), ["type"], ["digest", "src", "dst"], "i", "n").withColumn("i", F.col("i") - 1)
    part = F.when(F.col("n") < 5, "train").when(F.col("i") * 10 < F.col("n") * 8, "train").when(F.col("i") * 10 < F.col("n") * 9, "valid").otherwise("test")
    return rows.select("src", "dst", "type", part.alias("part"))


def negatives(edges: DataFrame, nodes: DataFrame, per_edge: int, seed: str = "0") -> DataFrame:
    """(src, dst, type): for each edge up to ``per_edge`` targets of the same node type that it does not have; which ones a seeded digest says.

    Nodes of a type are numbered, so a corrupted target is found by an equi-join on type and number.
    """
    known = numbered(nodes.select("id", F.col("type").alias("kind")), ["kind"], ["id"], "number").withColumn("number", F.col("number") - 1)
    sizes = nodes.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("size"))
    aimed = edges.join(nodes.select(F.col("id").alias("dst"), F.col("type").alias("kind")), "dst").join(sizes, "kind")
    drawn = aimed.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(per_edge)))).withColumn("digest", F.md5(F.concat_ws("|", F.lit(seed), "src", "dst", "type", "turn")))
    number = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.col("size"))
    found = drawn.withColumn("number", number).join(known, ["kind", "number"]).select("src", F.col("id").alias("dst"), "type").where("src <> dst").distinct()
    return found.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")


def consolidated(edges: DataFrame, nodes: DataFrame, node_types: dict[str, str], relations: dict[str, str]) -> DataFrame:
    """(source_type, relation, target_type, n, index): the triples of consolidated types and relations that occur, numbered."""
    def mapped(c: str, names: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in names.items()], F.col(c))

    kinds = nodes.select("id", mapped("type", node_types).alias("kind"))
    told = edges.select("src", "dst", mapped("type", relations).alias("relation")).join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("source_type")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("target_type")), "dst")
    counts = told.groupBy("source_type", "relation", "target_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("index", F.row_number().over(W.orderBy("source_type", "relation", "target_type")) - 1)


def channels(rows: DataFrame, key: str, column: str, items: tuple[str, ...]) -> DataFrame:
    """(key, channels): the share of each of ``items`` among a group's rows, in their order."""
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(F.array(*[F.round(F.count_if(F.col(column) == i) / n, 6) for i in items]).alias("channels"))


def weighted_features(rows: DataFrame, key: str, blocks: dict[str, float]) -> DataFrame:
    """(key, features): column blocks times the root of their weight, one after the other; blocks of weight 0 are left out."""
    def scaled(column: str, weight: float) -> Column:
        return F.transform(column, lambda x: F.round(x * F.sqrt(F.lit(float(weight))), 6))

    return rows.select(key, F.concat(*[scaled(c, w) for c, w in blocks.items() if w]).alias("features"))


def reproducibility(results: DataFrame, key: tuple[str, ...] = ("method", "metric", "condition")) -> DataFrame:
    """(key, n_papers, tier, spread): reproduced where two papers or more agree within a tenth, single-full where the one says how well, else single-partial or disputed."""
    g = results.groupBy(*key).agg(F.countDistinct("paper").alias("n_papers"), F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.col("std").isNotNull()).alias("full"))
    spread = F.round((F.col("high") - F.col("low")) / F.greatest(F.abs("high"), F.lit(1e-9)), 6)
    tier = F.when((F.col("n_papers") >= 2) & (spread <= 0.1), "reproduced").when(F.col("n_papers") >= 2, "disputed").when(F.col("full"), "single-full").otherwise("single-partial")
    return g.select(*key, "n_papers", tier.alias("tier"), spread.alias("spread"))


def stale_papers(cached: DataFrame, present: DataFrame, published: DataFrame) -> DataFrame:
    """(paper, reason): papers that a rebuild is due for: not cached, no longer there, or cached but not published."""
    def lacking(a: DataFrame, b: DataFrame, reason: str) -> DataFrame:
        return a.select("paper").distinct().join(b.select("paper"), "paper", "left_anti").withColumn("reason", F.lit(reason))

    return lacking(present, cached, "uncached").unionByName(lacking(cached, present, "removed")).unionByName(lacking(cached.join(present.select("paper"), "paper", "left_semi"), published, "unpublished"))
