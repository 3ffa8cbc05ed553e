"""Retrieval: BM25, vector neighbours, rank fusion, budgets and near-duplicate suppression."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .blocks import best_in_blocks
from .ranks import matched, numbered, running

def equal_to(word: str):
    return lambda token: token == F.lit(word)


def bm25(docs: DataFrame, terms: dict[str, float], *, preferred: str | None = None, k1: float = 1.5, b: float = 0.75, boost: float = 1.15) -> DataFrame:
    """Scores of all documents that match a term (weights by term; a preferred layer is boosted).

    Term counts and lengths come from one projection; the corpus statistics are one row, and nothing
    but it is joined, so scoring needs no shuffle of documents.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9-]+)"), 1)
    rows = docs.select("doc_id", "layer", tokens.alias("tokens")).select(
        "doc_id", "layer", F.size("tokens").alias("dl"), *[F.size(F.filter("tokens", equal_to(w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    )
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = rows.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, weight in enumerate(terms.values()):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + weight * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    if preferred:
        score = score * F.when(F.col("layer") == preferred, boost).otherwise(1.0)
    return joined.select("doc_id", "layer", F.round(score, 6).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The k best rows, of each group if ``by`` names any, with their rank."""
    order = [F.desc("score"), F.col(id_col)]
    if not by:
        return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def millionths(scores: np.ndarray) -> np.ndarray:
    """``scores`` in millionths, rounded as SQL rounds to 6 digits: the written value, half away from zero."""
    scaled = scores * 1e6
    whole = np.floor(scaled + 0.5)
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    if near.any():
        values, at = np.unique(scores[near], return_inverse=True)
        whole[near] = np.array([float(Decimal(repr(float(x))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP)) for x in values])[at]
    return whole


def usable(vectors: DataFrame) -> DataFrame:
    """``vectors`` without null, zero and non-finite ones."""
    return vectors.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, within: tuple[str, ...] = (), apart: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k most cosine-similar other vectors of its length, with equal columns ``within`` and another value of ``apart``.

    Queries and vectors are met block by block in tasks, which keep the k best of a block (by score as rounded, then id) for
    each query; the final rank is over those. Null, zero and non-finite vectors match nothing.
    """
    found = best_in_blocks(usable(vectors), usable(queries), k, lambda q, v: q @ v.T, millionths, list(within), apart, prepared=units)
    return top_k(found.withColumn("score", F.round("score", 6)), k, ["query_id"], "vec_id")


def outliers(vectors: DataFrame) -> DataFrame:
    """(vec_id, mean_similarity, percentile, reading): each vector's mean cosine to all others, and the share of vectors that are more like the rest.

    The mean over all pairs of one vector is its product with the sum of all unit vectors, so two passes over the vectors do; tasks
    send one partial sum each. Means are compared to nine digits. Zero vectors are like nothing; null and non-finite ones, and those of another length
    than most, are left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    sizes = rows.groupBy(F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes["dim"]:
        return rows.select("vec_id", F.lit(0.0).alias("mean_similarity"), F.lit(0.0).alias("percentile"), F.lit("typical").alias("reading")).limit(0)
    dim, n = sizes["dim"], sizes["n"]

    def units(batch) -> np.ndarray:
        x = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = x / np.maximum(np.abs(x).max(axis=1), np.finfo(float).tiny)[:, None]
        length = np.linalg.norm(x, axis=1)
        return x / np.where(length > 0, length, 1.0)[:, None]

    def summed(batches):
        total, lost = np.zeros(dim), np.zeros(dim)  # what rounding loses is added back
        for batch in batches:
            if batch.num_rows:
                part = units(batch).sum(axis=0) - lost
                now = total + part
                lost, total = (now - total) - part, now
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], ["i", "s"])

    kept = rows.where(F.size("e") == dim)
    whole = np.array([r["s"] for r in kept.mapInArrow(summed, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()])

    def compared(batches):
        for batch in batches:
            if batch.num_rows:
                u = units(batch)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array((u @ whole - np.einsum("ij,ij->i", u, u)) / max(1, n - 1))], ["vec_id", "mean"])

    means = staged(kept.mapInArrow(compared, f"vec_id {dict(rows.dtypes)['vec_id']}, mean double").withColumn("mean", F.round("mean", 9)))
    levels = running(means.groupBy("mean").agg(F.count(F.lit(1)).alias("n_equal")), [], ["mean"], "n_equal", "upto", "whole")
    share = levels.select("mean", F.round(100 * (F.col("whole") - F.col("upto")) / F.col("whole"), 1).alias("percentile"))
    reading = F.when(F.col("percentile") < 70, "typical").when(F.col("percentile") < 90, "somewhat unusual").otherwise("outlier")
    return means.join(share, "mean").select("vec_id", F.round("mean", 6).alias("mean_similarity"), "percentile", reading.alias("reading"))


def pairwise(vectors: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, similarity, distance, reading) of the named vectors, ten at most; ``vectors`` has name and embedding. Zero vectors are like nothing."""
    if len(names) > 10:
        raise ValueError("more than ten names")
    v = vectors.where(F.col("name").isin(names)).select("name", F.col("embedding").cast("array<double>").alias("e"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    pairs = v.select(F.col("name").alias("a"), F.col("e").alias("x")).join(v.select(F.col("name").alias("b"), F.col("e").alias("y")), F.col("a") < F.col("b"))
    scale = F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))
    rows = pairs.select("a", "b", F.round(dot(F.col("x"), F.col("y")) / F.when(scale == 0, 1.0).otherwise(scale), 6).alias("similarity"))
    return rows.withColumn("distance", F.round(1 - F.col("similarity"), 6)).withColumn("reading", F.when(F.col("similarity") > 0.8, "very similar").when(F.col("similarity") > 0.5, "similar").otherwise("different"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60, id_col: str = "doc_id") -> DataFrame:
    """Sum over lists of 1 / (k + rank from 0)."""
    rows = None
    for ranked in lists:
        part = ranked.select(id_col, (1 / (F.lit(k) + F.col("rank") - 1)).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(id_col).agg(F.round(F.sum("part"), 8).alias("score"))


def token_budget(ranked: DataFrame, budget: int, by: str) -> DataFrame:
    """Rows in rank order while their running token sum stays in the budget; the first is always kept."""
    run = W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("tokens").over(run)).withColumn("over", F.max((F.col("used") > budget).cast("int")).over(run)).where("over = 0 OR rank = 1").drop("over")


def suppress_near(chunks: DataFrame, prefix: int = 240) -> DataFrame:
    """Chunks without those whose normalised prefix equals, contains or is contained in that of a better one of their document.

    Better is a higher score, then a finer layer (fine, mid, coarse), then the first. Chunks without letters or digits
    stay; prefixes of under five characters are only compared as a whole. Contained prefixes are met by their first
    five characters, so a document's chunks are not compared all with all.
    """
    norm = F.substring(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), 1, prefix)
    worth = F.struct(-F.col("score"), F.when(F.col("layer") == "fine", 0).when(F.col("layer") == "mid", 1).otherwise(2), F.col("seq"))
    rows = chunks.select("doc_id", "seq", norm.alias("norm"), worth.alias("worth")).where("norm <> ''")
    seeds = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("norm") - 4)), lambda i: F.substring(F.col("norm"), i, F.lit(5)))
    starts = F.collect_set(F.substring("norm", 1, 5)).over(W.partitionBy("doc_id"))  # a text offers only what a text of its document begins with
    offered = rows.withColumn("starts", starts).withColumn("seed", F.explode(F.array_intersect(seeds, "starts"))).drop("starts")
    asked = rows.select("doc_id", F.substring("norm", 1, 5).alias("seed"), *(F.col(c).alias(f"own_{c}") for c in ("seq", "norm", "worth")))
    met = offered.join(asked, ["doc_id", "seed"]).where((F.col("seq") != F.col("own_seq")) & ((F.col("norm") == F.col("own_norm")) | ((F.length("own_norm") >= 5) & F.col("norm").contains(F.col("own_norm")))))
    lost = met.select("doc_id", F.when(F.col("worth") < F.col("own_worth"), F.col("own_seq")).otherwise(F.col("seq")).alias("seq")).distinct()
    return chunks.join(lost, ["doc_id", "seq"], "left_anti")


def tf_idf(rows: DataFrame, key: str, words: str) -> DataFrame:
    """(key, word, weight): smooth idf, rows of unit length."""
    tf = rows.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))  # one row
    weighted = tf.join(df, "word").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return weighted.join(norm, key).select(key, "word", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def ranking_metrics(scored: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """AUC, average precision, MRR, NDCG at ten, hits, precision, recall, F1 and accuracy of scored rows, by group.

    Ties count half for the AUC; the other metrics order ties by id. Places and running counts come from ranges of
    the order, so a group may hold all rows.
    """
    hit = F.col("label") == 1
    ranked = staged(numbered(scored.select("group", "id", "score", "label"), ["group"], [F.desc("score"), "id"], "rank"))
    found = numbered(ranked.where(hit).select("group", "rank"), ["group"], ["rank"], "seen")
    at_ten = F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ideal = F.when(F.col("seen") <= 10, 1 / F.log2(F.col("seen") + 1)).otherwise(0.0)
    good = found.groupBy("group").agg(
        F.round(F.avg(F.col("seen") / F.col("rank")), 6).alias("average_precision"), F.round(1 / F.min("rank"), 6).alias("mrr"), F.round(F.sum(at_ten) / F.sum(ideal), 6).alias("ndcg_at_10"),
    )

    levels = ranked.groupBy("group", "score").agg(F.sum("label").alias("p"), (F.count(F.lit(1)) - F.sum("label")).alias("q"))
    below = running(levels, ["group"], ["score"], "q", "upto")
    wins = below.groupBy("group").agg(F.sum(F.col("p") * (2 * F.col("upto") - F.col("q"))).alias("twice"))

    guess = (F.col("score") >= 0.5).cast("int")
    pos, n, right, claimed = F.sum("label"), F.count(F.lit(1)), F.sum(guess * F.col("label")), F.sum(guess)
    whole = ranked.groupBy("group").agg(
        (2 * pos * (n - pos)).alias("pairs"), F.round(right / F.nullif(claimed, F.lit(0)), 6).alias("precision"), F.round(right / F.nullif(pos, F.lit(0)), 6).alias("recall"),
        F.round(2 * right / F.nullif(claimed + pos, F.lit(0)), 6).alias("f1"), F.round(F.avg((guess == F.col("label")).cast("int")), 6).alias("accuracy"),
        *[F.round(F.sum(F.when(F.col("rank") <= c, F.col("label")).otherwise(0)) / c, 6).alias(f"hits_at_{c}") for c in cutoffs],
    )
    return matched(matched(whole, wins, ["group"]), good, ["group"], "left").withColumn("auc", F.round(F.col("twice") / F.nullif(F.col("pairs"), F.lit(0)), 6)).drop("twice", "pairs")
