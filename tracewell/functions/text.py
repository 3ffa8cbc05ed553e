"""Text normalisation, parsing and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import ascii_words, bound

def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"^[^A-Za-z0-9]+", "")), "[^a-z0-9]+", "-"), F.lit("-"))


def compact(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def sentences(text: Column) -> Column:
    """Cut after . ! or ? before white space and a capital."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def stem(word: Column) -> Column:
    """The word without a common English ending, where enough of it is left."""
    n = F.length(word)

    def without(k: int) -> Column:
        return F.left(word, n - k)

    return (
        F.when(word.endswith("ing") & (n > 6), without(3))
        .when(word.endswith("ies") & (n > 5), F.concat(without(3), F.lit("y")))
        .when(word.endswith("ed") & (n > 5), without(2))
        .when(word.endswith("es") & (n > 4), without(2))
        .when(word.endswith("s") & (n > 4) & ~word.endswith("ss"), without(1))
        .otherwise(word)
    )


def role(text: Column, patterns: dict[str, tuple[str, ...]], default: str) -> Column:
    """The role with the most matching patterns; the first of equals, the default if none match."""
    def counted(low: Column) -> Column:
        return F.array(*[sum((low.rlike(ascii_words(p)).cast("int") for p in ps), F.lit(0)) for ps in patterns.values()])

    def chosen(counts: Column) -> Column:
        most = F.array_max(counts)
        return F.when(most > 0, F.get(F.array(*map(F.lit, patterns)), F.array_position(counts, most).cast("int") - 1)).otherwise(F.lit(default))

    return bound(bound(F.lower(text), counted), chosen)  # each pattern is tried once


def snippet(text: Column, size: int) -> Column:
    """At most ``size`` characters, cut at a word where it must be, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, size), r"\s+\S*\z", "")
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("…")))
