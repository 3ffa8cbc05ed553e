"""What a corpus's front page and an entity's page tell: datasets and years covered, references outside the corpus, citation flow, companions, and where anchors agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kg import first_ones
from .ranks import numbered

#: Sentiments that a citation flow always names.
FLOW = ("builds_on", "differs_from", "neutral")


def dataset_coverage(methods: DataFrame, k: int = 12, shown: int = 50) -> DataFrame:
    """(dataset, n, methods): the datasets that most methods name, and the first ``shown`` of these by place; a top-k report.

    ``methods`` has place, name and datasets, a comma-separated cell. A method that names a dataset twice counts twice.
    """
    parts = F.filter(F.transform(F.split(F.coalesce("datasets", F.lit("")), ","), lambda p: F.trim(p)), lambda p: (p != "") & (F.lower(p) != "nan"))
    told = methods.select("place", "name", F.explode(parts).alias("dataset"))
    best = told.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dataset").limit(k)
    kept = told.join(F.broadcast(best.select("dataset")), "dataset", "left_semi")  # ``k`` rows
    few = numbered(kept, ["dataset"], ["place", "name"], "at").where(F.col("at") <= shown)
    names = few.groupBy("dataset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), ", ").alias("methods"))
    return best.join(names, "dataset")


def years_covered(methods: DataFrame, first: int = 2005, last: int = 2030) -> DataFrame:
    """(year, n) of methods by their year, written as a number or as text; others than ``first`` to ``last`` are left out."""
    year = F.expr("try_cast(try_cast(year AS DOUBLE) AS INT)")
    return methods.select(year.alias("year")).where(F.col("year").between(first, last)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def external_references(edges: DataFrame, nodes: DataFrame, k: int = 10, least: int = 2) -> DataFrame:
    """(label, n, year, venue): works outside the corpus that are cited most, ``least`` times at least, with what their first node says; a top-k report."""
    cited = edges.where("type = 'cites_external'").join(nodes.where("label <> ''").select(F.col("id").alias("dst"), "label", "year", "venue"), "dst")
    counts = cited.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("dst", "year", "venue")).alias("first"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "label").limit(k).select("label", "n", "first.year", "first.venue")


def citation_flow(edges: DataFrame) -> DataFrame:
    """(sentiment, n) of citations; the usual ones also where there are none, a missing one is neutral."""
    counts = edges.where("type = 'cites'").groupBy(F.coalesce("sentiment", F.lit("neutral")).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))
    usual = edges.sparkSession.createDataFrame([(s, 0) for s in FLOW], "sentiment string, n long")
    return counts.unionByName(usual).groupBy("sentiment").agg(F.sum("n").alias("n"))


def companions(edges: DataFrame, node: str, relations: tuple[str, ...], k: int = 3) -> DataFrame:
    """(id, n): the techniques that papers which use a technique use with it most often; a top-k report. A paper's edges count each."""
    used = edges.where(F.col("type").isin(*relations))
    papers = used.where(F.col("dst") == node).select("src").distinct()
    return used.where(F.col("dst") != node).join(papers, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(k)


def dimension_status(anchors: DataFrame, group: str, dimensions: tuple[str, ...], empty: tuple[str, ...] = ("", "not reported", "n/a", "-")) -> DataFrame:
    """(group, dimension, status, filled, anchors): per group of anchors and dimension gap, partial, shared or differs, by the values that are told, case apart.

    Every dimension of every group has a row, also where no anchor tells it.
    """
    def value(c: str) -> Column:
        v = F.trim(F.col(c).cast("string"))
        return F.when(~F.lower(v).isin(*empty), F.lower(v))

    long = anchors.select(group, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), value(d).alias("value")) for d in dimensions])).alias("x")).select(group, "x.*")
    counts = long.groupBy(group, "dimension").agg(F.count(F.lit(1)).alias("anchors"), F.count("value").alias("filled"), F.min("value").alias("low"), F.max("value").alias("high"))
    status = F.when(F.col("filled") == 0, "gap").when(F.col("filled") < F.col("anchors"), "partial").when(F.col("low") == F.col("high"), "shared").otherwise("differs")
    return counts.select(group, "dimension", status.alias("status"), "filled", "anchors")


def coverage(status: DataFrame, group: str) -> DataFrame:
    """(group, covered, total, shared, differs, partial, gap): how many dimensions anchors tell at all, and how many of each status."""
    tally = [F.count_if(F.col("status") == s).alias(s) for s in ("shared", "differs", "partial", "gap")]
    return status.groupBy(group).agg(F.count_if(F.col("status") != "gap").alias("covered"), F.count(F.lit(1)).alias("total"), *tally)


def shared_items(edges: DataFrame, relation: str, a: str, b: str) -> DataFrame:
    """(id): what two nodes both have by a relation."""
    own = edges.where(F.col("type") == relation)
    return own.where(F.col("src") == a).select(F.col("dst").alias("id")).distinct().join(own.where(F.col("src") == b).select(F.col("dst").alias("id")), "id", "left_semi")


def first_shared(pairs: DataFrame, edges: DataFrame, relation: str, k: int = 3) -> DataFrame:
    """(a, b, n, items): how many targets of a relation the two of each pair share, and the first ``k``."""
    own = edges.where(F.col("type") == relation).select("src", "dst").distinct()
    met = pairs.select("a", "b").distinct().join(own.select(F.col("src").alias("a"), "dst"), "a").join(own.select(F.col("src").alias("b"), "dst"), ["b", "dst"])
    counts = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    few = first_ones(met, ["a", "b"], [F.col("dst")], k).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("items"))
    return counts.join(few, ["a", "b"])
