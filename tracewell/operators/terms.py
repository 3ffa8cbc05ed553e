"""Weights of words and two-word terms over a bounded vocabulary, and the terms that stand out in each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import dealt, staged

#: Words, at most, that go to all tasks as the only ones whose pairs can be frequent enough.
FREQUENT = 4096
WORD = r"([\p{L}\p{N}_]{2,})"


def words_of(text: Column, stop_words: tuple[str, ...]) -> Column:
    """Words of two characters or more in lower case, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def pairs_of(words: Column, among: list[str] | None = None) -> Column:
    """Each two words that follow each other; of those, both in ``among`` where it is given."""
    marked = words if among is None else F.transform(words, lambda w: F.when(w.isin(*among), w))
    return F.array_compact(F.zip_with(marked, F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def counted(rows: DataFrame, terms: Column) -> DataFrame:
    """(term, tf, df): places and rows of each of the ``terms``, by partial sums; nothing is grouped by row."""
    lists = rows.select(terms.alias("terms")).select(F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    return lists.select("once", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(1 - F.col("once")).alias("tf"), F.sum("once").alias("df"))


def vocabulary(rows: DataFrame, features: int, least: int = 1, most: float = 1.0) -> DataFrame:
    """(term, df, n): of the words and pairs in ``least`` rows or more and in no more than a share ``most`` of all n ``rows`` (words), the ``features`` with the most places, then first in order.

    Words alone say how many places a term needs at least, and a pair has no more places than either of its words; so only pairs of words with so many
    are counted, unless these are more than ``FREQUENT``: then all pairs are.
    """
    n = rows.count()

    def best(sums: DataFrame) -> DataFrame:
        return sums.where((F.col("df") >= least) & (F.col("df") <= F.lit(float(most)) * n)).orderBy(F.desc("tf"), "term").limit(features)

    single = staged(counted(rows, F.col("words")))
    reached = best(single).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
    needed = reached["tf"] if reached["n"] == features else 1
    frequent = [r["term"] for r in single.where(F.col("tf") >= needed).select("term").limit(FREQUENT + 1).collect()]
    both = single.unionByName(counted(rows, pairs_of(F.col("words"), frequent if len(frequent) <= FREQUENT else None))) if frequent else single
    return best(both).select("term", "df", F.lit(n).alias("n"))


def term_weights(rows: DataFrame, key: str, text: str, features: int = 50, stop_words: tuple[str, ...] = (), least: int = 1, most: float = 1.0) -> DataFrame:
    """(key, term, weight): smooth idf weights of a row's terms that are among the ``features``, rows of unit length.

    Rows without such terms, null texts among them, have no weights but count as rows; rows that repeat a key are one text
    for their weights. Texts are dealt to tasks and read once, their words written. The vocabulary, ``features`` rows at most, goes to all tasks, so only
    places of its terms are listed.
    """
    texts = dealt(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text")
    split = staged(texts.select("key", words_of(F.col("text"), stop_words).alias("words")))
    known = staged(vocabulary(split, features, least, most))
    names = [r["term"] for r in known.select("term").collect()]
    single, pairs = [t for t in names if " " not in t], [t for t in names if " " in t]
    listed = F.filter("words", lambda w: w.isin(*single))
    if pairs:
        listed = F.concat(listed, F.filter(pairs_of(F.col("words"), sorted({w for p in pairs for w in p.split(" ")})), lambda p: p.isin(*pairs)))
    tf = split.select("key", F.explode(listed).alias("term")).join(F.broadcast(known), "term").groupBy("key", "term", "df", "n").agg(F.count(F.lit(1)).alias("tf"))
    weighted = tf.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") ** 2).over(W.partitionBy("key")))  # ``features`` rows at most
    return weighted.select(F.col("key").alias(key), "term", (F.col("w") / length).alias("weight"))


def top_terms(weights: DataFrame, key: str, k: int = 15) -> DataFrame:
    """(key, rank, term, weight): the k weightiest terms of each row, ties by term."""
    near = F.round("weight", 9)
    return weights.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(near.desc(), "term"))).where(F.col("rank") <= k).select(key, "rank", "term", F.round(near, 4).alias("weight"))
