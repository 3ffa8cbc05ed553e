"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent character n-grams (1 to 3) in order of frequency. A document
is compared by the out-of-place distance: for each of its own most frequent n-grams, how far its
rank is from the profile's, or ``size`` if the profile lacks it. N-grams come from lower-cased text
where each run of characters other than letters and marks is one space; none has a space inside.

Counting runs over all training rows: tasks count with sorted arrays and send one row per language
and n-gram, which Spark sums. Profiles have ``size`` rows a language, and languages are checked to
be at most ``max_languages``, which bounds what the driver and the tasks hold.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, pick, read

SIZE = 300
MAX_LANGUAGES = 1000
#: A task counts n-grams when it holds this many, and sends its counts on when they are as many.
HELD = 1_000_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 2 letter, 1 mark, 0 other."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def grams(text: str | None) -> np.ndarray | None:
    """All 1- to 3-grams of a text as integers (21 bits a character); None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes]
    if not (kind == 2).any():
        return None
    c = np.concatenate(([32], np.where(kind > 0, codes, 32), [32])).astype(np.int64)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    pairs = c[:-1] | c[1:] << 21
    return np.concatenate((c[c != 32], pairs, (pairs[:-1] | c[2:] << 42)[c[1:-1] != 32]))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    s = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.diff(np.append(at, len(s)))


def ranked(values: np.ndarray, size: int) -> np.ndarray:
    """The most frequent values first, at most ``size``; equal counts by value."""
    found, n = counted(values)
    return found[np.lexsort((found, -n))[:size]]


def profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", size: int = SIZE, max_languages: int = MAX_LANGUAGES) -> dict[str, list[int]]:
    """Language -> its n-grams, most frequent first, from all rows with text and a language."""
    rows = pick(docs, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def fold(parts_of) -> int:
            rows = 0
            for lang, parts in parts_of.items():
                held.setdefault(lang, []).append(one := counted(np.concatenate(parts)))
                rows += len(one[0])
            return rows

        def sent():
            for lang, parts in held.items():
                values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(sums)], ["lang", "gram", "n"])

        raw: dict[str, list[np.ndarray]] = {}
        n_raw = 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                if (found := grams(text.as_py())) is None:
                    continue
                raw.setdefault(lang, []).append(found)
                n_raw += len(found)
                if n_raw > HELD:
                    n += fold(raw)
                    raw, n_raw = {}, 0
                if n > HELD:
                    yield from sent()
                    held, n = {}, 0
        fold(raw)
        yield from sent()

    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in top.limit(size * max_languages + 1).collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    if len(out) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {lang: [g for _, g in sorted(ranks)] for lang, ranks in sorted(out.items())}


class Distances:
    """Out-of-place distances of a document to every profile."""

    def __init__(self, known: dict[str, list[int]], size: int):
        self.langs, self.size = list(known), size
        self.grams = np.array(sorted({g for ranks in known.values() for g in ranks}), np.int64)
        self.ranks = np.full((len(known), len(self.grams)), -1, np.int64)
        for i, ranks in enumerate(known.values()):
            self.ranks[i, np.searchsorted(self.grams, np.array(ranks, np.int64))] = np.arange(len(ranks))

    def of(self, values: np.ndarray) -> np.ndarray:
        own = ranked(values, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = np.where(self.grams[at] == own, self.ranks[:, at], -1)
        return np.where(there < 0, self.size, np.abs(there - np.arange(len(own)))).sum(axis=1)


def identify(docs: DataFrame, known: dict[str, list[int]], *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    The nearest profile wins, the first by name of equals; score is the second distance's share of
    the two smallest (1 less the relative distance if one language is known). Null texts and texts
    without a letter, or no known language, give ``und`` and 0. Whole texts count, however long.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)

    def predict(batches):
        measure = Distances(known, size) if known else None
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text"):
                values = grams(text.as_py()) if measure else None
                if values is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                d = measure.of(values)
                best = int(np.argmin(d))
                langs.append(measure.langs[best])
                if len(d) == 1:
                    scores.append(1.0 - d[0] / (size * min(size, len(values))))
                else:
                    first, second = np.partition(d, 1)[:2]
                    scores.append(float(second / (first + second)) if second else 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = profiles(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, known).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
