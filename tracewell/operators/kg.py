"""Building and asking a knowledge graph: nodes(id, type, label, paper_id) and edges(src, dst, type, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import staged
from .relational import met, shared_counts

#: Relations that hold both ways.
SYMMETRIC = ("similar_to", "co_authored", "shares_bibliography")


def first_ones(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group of ``keys`` with their ``place``."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_label, source_type, target_label and target_type; dangling ones go."""
    ends = nodes.select("id", "label", F.col("type").alias("kind"))
    a, b = (ends.select(F.col("id").alias(end), F.col("label").alias(f"{name}_label"), F.col("kind").alias(f"{name}_type")) for end, name in (("src", "source"), ("dst", "target")))
    return edges.join(a, "src").join(b, "dst")


def papers_using(edges: DataFrame, nodes: DataFrame, term: str) -> DataFrame:
    """(paper, technique) of papers with an edge to a technique whose label contains ``term``, without regard to case."""
    found = nodes.where((F.col("type") == "technique") & F.lower("label").contains(term.lower())).select(F.col("id").alias("dst"), F.col("label").alias("technique"))
    return edges.join(found, "dst").join(nodes.where("type = 'paper'").select(F.col("id").alias("src")), "src").select(F.col("src").alias("paper"), "technique").distinct()


def successors_of(edges: DataFrame, nodes: DataFrame, paper: str, kinds: tuple[str, ...]) -> DataFrame:
    """(type, id, label) of what a paper points at, of the node types asked for."""
    return edges.where(F.col("src") == paper).select(F.col("dst").alias("id")).distinct().join(nodes.where(F.col("type").isin(*kinds)), "id").select("type", "id", "label")


def comparisons_involving(nodes: DataFrame, edges: DataFrame, method: str) -> DataFrame:
    """(id, label, paper) of comparison nodes that name the method, with the paper they belong to, if any."""
    named = nodes.where((F.col("type") == "comparison") & F.lower("label").contains(method.lower())).select("id", "label")
    owner = edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("paper"))
    return named.join(owner, "id", "left")


def problems_addressed(edges: DataFrame, nodes: DataFrame, shown: int = 5) -> DataFrame:
    """(problem, n_papers, papers): how many papers address each problem, and the first few of them."""
    told = edges.where("type = 'addresses_problem'").select("src", F.col("dst").alias("id")).distinct().join(nodes.select("id", F.col("label").alias("problem")), "id")
    counts = told.groupBy("problem").agg(F.count(F.lit(1)).alias("n_papers"))
    few = first_ones(told.select("problem", "src"), ["problem"], [F.col("src")], shown).groupBy("problem").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("papers"))
    return counts.join(few, "problem")


def pairs_in(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, weight) in both directions: items that share a key, by how many keys they share."""
    pairs = shared_counts(rows, key, item, "weight")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def works_on(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(author, concept, n): in how many of an author's papers a concept stands at the end of an edge of ``kinds``."""
    by = edges.where("type = 'authored_by'").select(F.col("src").alias("paper"), F.col("dst").alias("author")).distinct()
    on = edges.where(F.col("type").isin(*kinds)).select(F.col("src").alias("paper"), F.col("dst").alias("concept")).distinct()
    return by.join(on, "paper").groupBy("author", "concept").agg(F.count(F.lit(1)).alias("n"))


def fan_out(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(type, id, label): what one hop in either direction reaches from the seeds, the seeds themselves left out."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    reached = both.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seeds.select("id"), "id", "left_anti")
    return reached.join(nodes, "id").select("type", "id", "label")


def claim_rails(edges: DataFrame, nodes: DataFrame, node: str, rails: dict[str, tuple[str, ...]], most: int) -> DataFrame:
    """(rail, place, dst, label, confidence): a node's edges by the rail of their type, most confident first, ``most`` a rail."""
    rail = F.coalesce(*[F.when(F.col("type").isin(*kinds), F.lit(name)) for name, kinds in rails.items()])
    rows = edges.where(F.col("src") == node).withColumn("rail", rail).where("rail IS NOT NULL").groupBy("rail", "dst").agg(F.max("confidence").alias("confidence"))
    named = rows.join(nodes.select(F.col("id").alias("dst"), "label"), "dst")
    return first_ones(named, ["rail"], [F.desc("confidence"), F.col("dst")], most).select("rail", "place", "dst", "label", "confidence")


def merged_predictions(predicted: DataFrame, least: float = 0.01) -> DataFrame:
    """(id, other, relations, confidence, bidirectional): one row per node and partner.

    Symmetric relations count for both ends, by the higher confidence, and are marked if both directions were predicted;
    then the relations of a partner are listed with the highest confidence, over ``least``.
    """
    both = F.col("type").isin(*SYMMETRIC)
    turned = predicted.where(both).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence", F.lit(True).alias("turned"))
    rows = predicted.select("src", "dst", "type", "confidence", F.lit(False).alias("turned")).unionByName(turned)
    one = rows.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), (F.countDistinct("turned") == 2).alias("bidirectional"))
    out = one.groupBy(F.col("src").alias("id"), F.col("dst").alias("other")).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("relations"), F.max("confidence").alias("confidence"), F.max("bidirectional").alias("bidirectional"))
    return out.where(F.col("confidence") > least)


def extra_neighbours(edges: DataFrame, nodes: DataFrame, node: str, shown: DataFrame) -> DataFrame:
    """(type, n, ids): neighbours of a node that the current view lacks, by type, the largest group first in ``place``."""
    ends = edges.where((F.col("src") == node) | (F.col("dst") == node)).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
    missing = ends.join(shown.select("id"), "id", "left_anti").join(nodes.select("id", "type"), "id")
    groups = missing.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return groups.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "type")))


def serialised(edges: DataFrame, highlighted: list[str], signal: tuple[str, ...], triples: int = 11, claims: int = 7) -> DataFrame:
    """(place, line): up to ``triples`` triples and ``claims`` claims, what one list lacks going to the other, taken in turns.

    A triple scores 2 for an end that is highlighted and 1 for a relation of ``signal``. ``edges`` has claim, true for claims.
    """
    score = F.when(F.col("src").isin(*highlighted) | F.col("dst").isin(*highlighted), 2).otherwise(0) + F.when(F.col("type").isin(*signal), 1).otherwise(0)
    rows = edges.select("claim", score.alias("score"), F.concat_ws(" ", "src", "type", "dst").alias("line"))
    ranked = first_ones(rows, ["claim"], [F.desc("score"), F.col("line")], triples + claims)
    sizes = rows.agg(F.count_if("claim").alias("n_claims"), F.count_if(~F.col("claim")).alias("n_triples"))
    room_claims = claims + F.greatest(F.lit(0), triples - F.col("n_triples"))
    room_triples = triples + F.greatest(F.lit(0), claims - F.col("n_claims"))
    kept = ranked.crossJoin(F.broadcast(sizes)).where(F.col("place") <= F.when(F.col("claim"), room_claims).otherwise(room_triples))
    return kept.select(F.row_number().over(W.orderBy("place", "claim")).alias("line_no"), "line")


def explode_columns(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(src, dst, type, label): an edge from each row to a value node of each value in its multi-valued cells."""
    cells = F.array(*[F.struct(F.lit(c).alias("type"), F.col(c).cast("string").alias("cell")) for c in columns])
    long = rows.select(F.col(key).alias("src"), F.explode(cells).alias("c")).select("src", "c.type", F.explode(F.split("c.cell", r"\s*[,;]\s*")).alias("label")).where("label <> ''")
    return long.select("src", F.concat_ws(":", "type", F.lower("label")).alias("dst"), "type", "label").distinct()


def verified_edges(triples: DataFrame, papers: DataFrame) -> DataFrame:
    """(src, dst, type, label, kind, quote): edges of quoted triples whose paper is known, by the naming rule of each relation.

    Techniques and datasets are named by themselves, hardware and problems by a digest, limitations by paper and digest.
    """
    short = lambda c: F.substring(F.md5(c), 1, 8)
    relation, thing = F.col("relation"), F.trim("object")
    kind = F.when(relation.isin("uses_backbone", "uses_loss"), "technique").when(relation.isin("trained_on", "evaluated_on"), "dataset").when(relation == "uses_hardware", "hardware").when(relation == "addresses_problem", "problem").when(relation == "has_limitation", "limitation")
    sub = F.when(relation == "uses_backbone", "backbone").otherwise("loss")
    node = (
        F.when(kind == "technique", F.concat_ws(":", F.lit("tech"), sub, thing)).when(kind == "dataset", F.concat(F.lit("dataset:"), F.lower(thing))).when(kind == "hardware", F.concat(F.lit("hw:"), short(thing)))
        .when(kind == "problem", F.concat(F.lit("problem:"), short(thing))).when(kind == "limitation", F.concat_ws(":", F.lit("lim"), "paper_id", short(thing)))
    )
    good = triples.where("paper_id IS NOT NULL AND relation IS NOT NULL AND object <> '' AND quote <> ''").join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    return good.select(F.concat(F.lit("paper:"), "paper_id").alias("src"), node.alias("dst"), relation.alias("type"), F.substring(thing, 1, 60).alias("label"), kind.alias("kind"), F.substring("quote", 1, 300).alias("quote")).where("dst IS NOT NULL")


def built_graph(papers: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of papers and their extracted facts; facts of low confidence, under ten characters or saying that there is none are skipped.

    ``facts`` has paper_id, kind, value, confidence; equal values of one kind are one node.
    """
    good = facts.where((F.col("confidence") != "low") & (F.length(F.trim("value")) >= 10) & ~F.lower("value").rlike("not explicitly|no specific"))
    ends = good.select(F.concat(F.lit("paper:"), "paper_id").alias("src"), F.concat_ws(":", "kind", F.substring(F.md5(F.lower(F.trim("value"))), 1, 8)).alias("dst"), F.concat(F.lit("has_"), "kind").alias("type"), F.trim("value").alias("label"), "kind")
    known = papers.select(F.concat(F.lit("paper:"), "paper_id").alias("id"), F.lit("paper").alias("type"), F.col("title").alias("label"))
    values = ends.groupBy(F.col("dst").alias("id"), F.col("kind").alias("type")).agg(F.min("label").alias("label"))
    edges = ends.select("src", "dst", "type").distinct().join(known.select(F.col("id").alias("src")), "src", "left_semi")
    return known.unionByName(values.join(edges.select(F.col("dst").alias("id")), "id", "left_semi").select("id", "type", "label")), edges


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): a document's chunks, its figures (captions of over 20 characters) and its tables (over 30)."""
    doc, at = F.concat(F.lit("paper:"), "doc_id"), F.concat_ws(":", "doc_id", "seq")
    kinds = F.array(
        F.struct(F.lit("contains_chunk").alias("type"), F.lit("chunk").alias("kind"), F.lit(True).alias("ok")),
        F.struct(F.lit("has_figure").alias("type"), F.lit("figure").alias("kind"), (F.col("text").rlike("^(Fig|Figure)") & (F.length("text") > 20)).alias("ok")),
        F.struct(F.lit("has_table").alias("type"), F.lit("table").alias("kind"), (F.col("text").rlike("^Table") & (F.length("text") > 30)).alias("ok")),
    )
    return chunks.select(doc.alias("src"), at.alias("at"), F.explode(F.filter(kinds, lambda k: k["ok"])).alias("k")).select("src", F.concat_ws(":", "k.kind", "at").alias("dst"), "k.type")


def aggregated_citations(mentions: DataFrame, kept: int = 3) -> DataFrame:
    """(src, dst, mentions, sentiment, contexts): citations of one paper by another, the most frequent sentiment and the first contexts."""
    counts = mentions.groupBy("src", "dst", "sentiment").agg(F.count(F.lit(1)).alias("n"))
    told = counts.groupBy("src", "dst").agg(F.sum("n").alias("mentions"), F.max(F.struct("n", "sentiment")).alias("m"))
    few = first_ones(mentions, ["src", "dst"], [F.col("seq")], kept).groupBy("src", "dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "context"))), lambda c: c["context"]), " | ").alias("contexts"))
    return told.join(few, ["src", "dst"]).select("src", "dst", "mentions", F.col("m.sentiment").alias("sentiment"), "contexts")


def weighted_attachments(rows: DataFrame, owner: str, term: str, weight: str, relation: str, k: int) -> DataFrame:
    """(src, dst, type, weight): the ``k`` strongest terms of each owner as nodes with weighted edges."""
    return first_ones(rows, [owner], [F.desc(weight), F.col(term)], k).select(F.col(owner).alias("src"), F.concat_ws(":", F.lit(relation), F.lower(term)).alias("dst"), F.lit(relation).alias("type"), F.round(weight, 6).alias("weight"))


def dataset_edges(tables: DataFrame, texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(src, dst, via): datasets that a paper names, in table cells of up to 40 characters or in words of its text; the table counts first.

    ``tables`` has paper and cell, ``texts`` paper and text, ``vocabulary`` one-word datasets; both sides meet on the word.
    """
    word = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)))
    cells = tables.where(F.length("cell") <= 40).select("paper", word(F.col("cell")).alias("dataset"), F.lit(0).alias("rank"))
    said = texts.select("paper", word(F.col("text")).alias("dataset"), F.lit(1).alias("rank"))
    met = cells.unionByName(said).join(vocabulary.select(F.lower("dataset").alias("dataset")).distinct(), "dataset", "left_semi")
    return met.groupBy(F.col("paper").alias("src"), F.concat(F.lit("dataset:"), "dataset").alias("dst")).agg(F.when(F.min("rank") == 0, "table").otherwise("text").alias("via"))


def derived_edges(wins: DataFrame, papers: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept`` edges without derived ones, and one derived edge per directed pair of papers whose methods beat each other.

    Each has the number of comparisons, of metrics, and the best grade with one of its metrics. ``papers`` has method and paper.
    """
    a, b = papers.select(F.col("method").alias("winner"), F.col("paper").alias("src")), papers.select(F.col("method").alias("loser"), F.col("paper").alias("dst"))
    told = wins.join(a, "winner").join(b, "loser").where("src <> dst")
    new = told.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("metric").alias("n_metrics"), F.min(F.struct("grade", "metric")).alias("best"))
    new = new.select("src", "dst", F.lit("outperforms_benchmark").alias("type"), "n", "n_metrics", "best.grade", "best.metric")
    old = kept.where("type <> 'outperforms_benchmark'").select("src", "dst", "type", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("n_metrics"), F.lit(None).cast("string").alias("grade"), F.lit(None).cast("string").alias("metric"))
    return old.unionByName(new)


def with_intents(edges: DataFrame, intents: DataFrame, least: float = 0.8) -> DataFrame:
    """Citation edges with the most confident intent found for them, if it is new or surer; results from ``least`` on add a comparison edge."""
    best = intents.groupBy("src", "dst").agg(F.max(F.struct("conf", "intent")).alias("b"))
    joined = edges.join(best, ["src", "dst"], "left")
    newer = F.col("b").isNotNull() & (F.col("intent_conf").isNull() | (F.col("b.conf") > F.col("intent_conf")))
    told = joined.select("src", "dst", "type", F.when(newer, F.col("b.intent")).otherwise(F.col("intent")).alias("intent"), F.when(newer, F.col("b.conf")).otherwise(F.col("intent_conf")).alias("intent_conf"))
    against = told.where((F.col("intent") == "result") & (F.col("intent_conf") >= least)).select("src", "dst", F.lit("compared_against").alias("type"), "intent", "intent_conf")
    return told.unionByName(against)


def refreshed(records: DataFrame, resolved: DataFrame, own: DataFrame) -> DataFrame:
    """Records whose null method is resolved again by its name, own rows by their paper; what is known stays."""
    found = records.join(resolved.select(F.col("mention").alias("method_raw"), F.col("method").alias("again")), "method_raw", "left").join(own.select("paper", F.col("method").alias("of_paper")), "paper", "left")
    return found.withColumn("method", F.coalesce("method", F.when(F.col("is_own"), F.col("of_paper")), "again")).drop("again", "of_paper")


def method_papers(methods: DataFrame, papers: DataFrame, overrides: DataFrame) -> DataFrame:
    """(method, paper, how): by an override, an equal slug, or two common words of a name (or one of over three letters); the first paper.

    ``papers`` has paper and title. Words meet by an equi-join; a null paper marks what nothing matches.
    """
    papers = papers.where("title IS NOT NULL").groupBy("title").agg(F.min(F.struct("paper")).alias("m")).select("title", "m.paper")  # papers of equal titles match alike, so the first of them stands for all
    known = methods.select("method").distinct()
    fixed = known.join(overrides, "method").select("method", "paper", F.lit(1).alias("rank"), F.lit("override").alias("how"))
    slugs = known.withColumn("slug", L.slug(F.col("method"))).join(papers.select("paper", L.slug(F.col("title")).alias("slug")), "slug").select("method", "paper", F.lit(2).alias("rank"), F.lit("slug").alias("how"))
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)))
    met = known.withColumn("word", words(F.col("method"))).join(papers.select("paper", words(F.col("title")).alias("word")), "word")
    near = met.groupBy("method", "paper").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("word")).alias("longest")).where("n >= 2 OR longest > 3").select("method", "paper", F.lit(3).alias("rank"), F.lit("words").alias("how"))
    best = fixed.unionByName(slugs).unionByName(near).groupBy("method").agg(F.min(F.struct("rank", "paper", "how")).alias("b"))
    return known.join(best, "method", "left").select("method", "b.paper", "b.how")


def matched_titles(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """(entry, paper): the paper of an equal title, else the first whose title (of over 10 characters) contains the entry's or is contained in it.

    ``entries`` has entry and title, ``titles`` paper and title; titles are compared folded. Containment meets on ten characters.
    """
    from .records import contained

    asked = entries.select("entry", folded(F.col("title")).alias("said")).where("said <> ''")
    known = titles.select("paper", folded(F.col("title")).alias("key")).where(F.length("key") > 5)
    same = asked.join(known, F.col("said") == F.col("key")).select("entry", "paper", F.lit(0).alias("rank"))
    rest = asked.where(F.length("said") > 10)
    inside = contained(rest, "said", known, "key", 6).select("entry", "paper", F.lit(1).alias("rank"))
    around = contained(known, "key", rest.where(F.length("said") > 20), "said", 6).select("entry", "paper", F.lit(1).alias("rank"))
    return same.unionByName(inside).unionByName(around).groupBy("entry").agg(F.min(F.struct("rank", "paper")).alias("m")).select("entry", "m.paper")


def folded(c: Column) -> Column:
    """Lower case without accents; what is neither letter nor digit as one blank, none around."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^\\x00-\\x7f]", ""), "[^a-z0-9]+", " "))


STOP_WORDS = ("the", "a", "an", "is", "are", "of", "in", "to", "and", "for", "with", "on")


def claim_conflicts(claims: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(paper_a, paper_b, shared, limitation, claim): papers that share a technique where a limitation of one and a claim of the other have ``least`` words in common.

    ``claims`` has claim_id, paper, kind, value; the pair's best match stays. Only papers that claim something are paired. Equal sets of words are compared
    once, however many claims and pairs have them, and meet on their rarer words: of ``least`` common words one is not among the ``least - 1`` most frequent ones of either set.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("value"), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))))
    kept = claims.where(F.col("kind").isin("limitation", "contribution", "comparison")).select("paper", (F.col("kind") == "limitation").alias("limits"), words.alias("words"), "claim_id")
    kept = kept.where(F.size("words") >= least).withColumn("words", F.array_join("words", " "))
    told = staged(kept.groupBy("paper", "limits", "words").agg(F.min(F.struct("claim_id")).alias("m")).select("paper", "limits", "words", "m.claim_id"))
    claiming = edges.where("type = 'uses_technique'").join(told.select(F.col("paper").alias("src")).distinct(), "src", "left_semi")
    both = met(claiming, "dst", "src").select("a", "b").distinct()
    pairs = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))

    each = told.select("limits", "words").distinct().withColumn("word", F.explode(F.split("words", " ")))
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(often, "word").groupBy("limits", "words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("met"))
    seeds = rarest.select("limits", "words", F.explode(F.slice("met.word", F.lit(1), F.size("met") - (least - 1))).alias("word"))
    alike = seeds.where("limits").select("word", F.col("words").alias("own")).join(seeds.where("NOT limits").select("word", F.col("words").alias("other")), "word").select("own", "other").distinct()
    alike = alike.withColumn("n", F.size(F.array_intersect(F.split("own", " "), F.split("other", " ")))).where(F.col("n") >= least)

    limits = told.where("limits").select(F.col("paper").alias("a"), F.col("words").alias("own"), F.col("claim_id").alias("limitation"))
    said = told.where("NOT limits").select(F.col("paper").alias("b"), F.col("words").alias("other"), F.col("claim_id").alias("claim"))
    near = limits.join(alike, "own").groupBy("a", "other").agg(F.min(F.struct((-F.col("n")).alias("n"), "limitation")).alias("m"))  # all that a paper's limitations say to a set
    best = near.join(said, "other").join(pairs, ["a", "b"]).groupBy("a", "b").agg(F.min(F.struct("m.n", "m.limitation", "claim")).alias("m"))
    return best.select(F.col("a").alias("paper_a"), F.col("b").alias("paper_b"), (-F.col("m.n")).cast("long").alias("shared"), "m.limitation", "m.claim")


def explained_predictions(predicted: DataFrame, edges: DataFrame, kinds: tuple[str, ...], least: float = 0.55, shown: int = 12) -> DataFrame:
    """(a, b, confidence, n_shared, shared): predictions of ``least`` or more, one a pair, with the neighbours of ``kinds`` of edges that both ends have, the first few of them."""
    key = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    pairs = predicted.where(F.col("confidence") >= least).select(*key, "confidence").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    near = edges.where(F.col("type").isin(*kinds)).select("src", F.col("dst").alias("via")).distinct()
    common = pairs.join(near.withColumnRenamed("src", "a"), "a").join(near.withColumnRenamed("src", "b"), ["b", "via"]).select("a", "b", "via")
    counts = common.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))
    few = first_ones(common, ["a", "b"], [F.col("via")], shown).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("via")), ",").alias("shared"))
    return pairs.join(counts, ["a", "b"], "left").join(few, ["a", "b"], "left").fillna({"n_shared": 0, "shared": ""})


def cell_links(entries: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(metric, condition, src, dst, type): edges of ``kinds`` between papers that report the same cell. ``entries`` has metric, condition, paper."""
    told = entries.select("metric", "condition", "paper").distinct()
    kept = edges.where(F.col("type").isin(*kinds)).select("src", "dst", "type").distinct()
    return kept.join(told.withColumnRenamed("paper", "src"), "src").join(told.withColumnRenamed("paper", "dst"), ["metric", "condition", "dst"]).select("metric", "condition", "src", "dst", "type")
