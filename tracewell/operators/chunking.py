"""Ways to cut documents into chunks, by name; each gives (doc_id, seq, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    """Decorator: makes a function of documents (doc_id, text) and its own parameters a way to chunk them."""

    def wrap(cut: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        STRATEGIES[name] = cut
        return cut

    return wrap


def chunked(docs: DataFrame, name: str, **parameters) -> DataFrame:
    """Documents cut by the strategy of that name."""
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r} among {sorted(STRATEGIES)}")
    return STRATEGIES[name](docs, **parameters)


def paragraphs(text: Column) -> Column:
    """Cut at blank lines; trimmed, empties dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def _numbered(docs: DataFrame, parts: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(parts).alias("seq", "text"))


@strategy("coarse")
def coarse(docs: DataFrame, words: int = 400) -> DataFrame:
    """The first ``words`` words of each document, as one chunk; that limit is the feature of the layer."""
    said = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    return _numbered(docs, F.filter(F.array(F.array_join(F.slice(said, 1, words), " ")), lambda p: p != ""))


@strategy("semantic")
def semantic(docs: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.35) -> DataFrame:
    """Paragraphs; with ``embed``, which adds a vector to rows of sentences, sentences grouped where neighbours are alike."""
    if embed is None:
        return _numbered(docs, paragraphs(F.col("text")))
    from .reports import topic_breaks

    rows = embed(fine(docs))
    segments = topic_breaks(rows, least).join(rows.select("doc_id", "seq", "text"), ["doc_id", "seq"])
    grouped = segments.groupBy("doc_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))
    return grouped.select("doc_id", F.col("segment").alias("seq"), "text")


@strategy("structural")
def structural(docs: DataFrame, most: int = 200) -> DataFrame:
    """Paragraphs packed greedily in order up to ``most`` words."""
    from .resolution import packed

    rows = semantic(docs).withColumn("tokens", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    packs = packed(rows, most).withColumn("at", F.explode(F.sequence("first", "last")))
    joined = packs.join(rows.select("doc_id", F.col("seq").alias("at"), "text"), ["doc_id", "at"])
    grouped = joined.groupBy("doc_id", "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return grouped.select("doc_id", F.col("pack").alias("seq"), "text")


@strategy("fine")
def fine(docs: DataFrame) -> DataFrame:
    """Sentences of paragraphs."""
    return _numbered(docs, F.filter(F.flatten(F.transform(paragraphs(F.col("text")), sentences_of)), lambda s: s != ""))


def sentences_of(paragraph: Column) -> Column:
    return F.transform(sentences(paragraph), lambda s: F.trim(s))
