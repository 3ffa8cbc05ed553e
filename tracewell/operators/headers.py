"""Clusters of unresolved table headers by the words they share, and what to propose for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .ranks import numbered, running

# Words of a header that say nothing of its metric.
EMPTY_WORDS = ("the", "of", "in", "on", "per", "rate", "avg", "average", "mean")


def header_clusters(headers: DataFrame) -> DataFrame:
    """(place, raw, n, cluster): headers clustered as if read one by one: each joins the first cluster that has one of its words, and gives it all of its own.

    ``headers`` has place (unique), raw and n; ``cluster`` is the place of the header that founded it. A header's cluster is the least place
    that a chain of ever earlier headers, each sharing a word with the next, reaches from it. So labels start as places, and in a
    round each header takes the least label among the earlier headers of each of its words, and then the label of that
    header; chains double their length, so rounds grow with the logarithm of the longest. A word that a third of all headers
    have is spread over tasks, as its running least is taken over ranges of places. Headers without telling words stay alone.
    """
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("raw", F.lit(""))), F.lit("([a-z0-9]+)"), 1)), F.array(*map(F.lit, EMPTY_WORDS)))
    said = staged(headers.select("place", F.explode(words).alias("word")))
    labels = staged(headers.select("place", F.col("place").alias("cluster")))
    while True:
        least = running(said.join(labels, "place"), ["word"], ["place"], "cluster", "least", along=F.min).groupBy("place").agg(F.min("least").alias("cluster"))
        step = staged(labels.select("place").join(least, "place", "left").select("place", F.coalesce("cluster", "place").alias("cluster")))
        jumped = staged(step.join(step.select(F.col("place").alias("cluster"), F.col("cluster").alias("further")), "cluster").select("place", F.col("further").alias("cluster")))
        if jumped.exceptAll(labels).isEmpty():
            return headers.select("place", "raw", "n").join(labels, "place")
        labels = jumped


def alias_proposals(clustered: DataFrame, most: int = 40, shown: int = 10) -> DataFrame:
    """(rank, cluster, n_headers, n, headers): of the first ``most`` clusters, those with most quarantined records first, and the first headers of each; a top-k report."""
    founded = clustered.where(F.col("place") == F.col("cluster"))
    first = founded.select("cluster").orderBy("cluster").limit(most)
    kept = clustered.join(F.broadcast(first), "cluster")  # ``most`` rows
    sums = kept.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_headers"), F.sum("n").alias("n"))
    few = numbered(kept, ["cluster"], ["place"], "at").where(F.col("at") <= shown).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), " | ").alias("headers"))
    return numbered(sums.join(few, "cluster"), [], [F.desc("n"), "cluster"], "rank")
