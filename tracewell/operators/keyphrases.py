"""Keyphrases without a model: phrases weighted over the corpus, then picked for relevance and against each other."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

# English words that begin, end or make no phrase.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did", "do", "does", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "he", "her", "here", "his", "how", "if", "in", "into", "is", "it", "its", "just", "more", "most", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you", "your",
)
TASK_WORDS = 250_000  # of the documents of one task
STEP_WORDS = 100_000  # of the documents whose phrases are counted at once
PHRASE = "doc_id long, phrase string, relevance double, place int"
CANDIDATE = "doc_id long, phrase string, relevance double, weights array<struct<word: string, idf: double>>"


def alike(a: dict[str, float], b: dict[str, float]) -> float:
    """Cosine of two phrases over the weights of their words."""
    common = sum(w * b[t] for t, w in a.items() if t in b)
    return common / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if common else 0.0


def picked(rows: Iterator[tuple[str, float, dict[str, float]]], k: int, diversity: float) -> list[tuple[str, float]]:
    """Up to k phrases: each time the one with the best balance of relevance and unlikeness to those picked; the earlier of equals.

    Rows come by falling relevance and are read only as far as they can still win, since likeness only lowers a balance.
    """
    held: list[list] = []  # phrase, relevance, weights, likeness to the nearest one picked
    out: list[list] = []
    last = math.inf
    while len(out) < k:
        def balance(row: list) -> float:
            return (1 - diversity) * row[1] - diversity * row[3]

        best = max(held, key=balance, default=None)
        while best is None or (1 - diversity) * last > balance(best):
            following = next(rows, None)
            if following is None:
                break
            row = [*following, max((alike(following[2], x[2]) for x in out), default=0.0)]
            held.append(row)
            last = row[1]
            if best is None or balance(row) > balance(best):
                best = row
        if best is None:
            break
        held.remove(best)
        out.append(best)
        for row in held:
            row[3] = max(row[3], alike(row[2], best[2]))
    return [(x[0], x[1]) for x in out]


def ranked(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[int, Iterator[tuple[str, float, dict[str, float]]]]]:
    """Each document of a batch (doc_id, words, valued) with its phrases by falling relevance, equal ones by their letters; phrases are spelt only as far as they are read."""
    sizes = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False)
    begin = 0
    while begin < batch.num_rows:
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), STEP_WORDS, "right")))
        part = batch.slice(begin, min(end, batch.num_rows) - begin)
        yield from _ranked(part, sizes[begin : begin + part.num_rows], longest)
        begin += part.num_rows


def _ranked(part: pa.RecordBatch, sizes: np.ndarray, longest: int):
    words = part.column("words").flatten()
    known, worth = (pc.struct_field(part.column("valued").flatten(), name) for name in ("word", "idf"))
    coded = pa.concat_arrays([words, known]).dictionary_encode()
    spelt, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    word, idf = codes[: len(words)], np.zeros(len(spelt))
    idf[codes[len(words) :]] = worth.to_numpy(zero_copy_only=False)  # a word weighs the same in all documents
    doc = np.repeat(np.arange(part.num_rows), sizes)
    at, ids = np.arange(len(word)), doc  # where phrases of a length begin, and the number of what comes before their last word
    found = []
    for length in range(1, longest + 1):
        last = word[at + length - 1]
        _, first, ids, times = np.unique(ids * len(spelt) + last, return_index=True, return_inverse=True, return_counts=True)
        first = at[first]
        mean = sum((idf[word[first + i]] for i in range(length)), np.zeros(len(first))) / length
        found.append((doc[first], first, np.full(len(first), length), np.log1p(times) * mean))
        fits = at + length < len(word)
        at, ids = at[fits], ids[fits]
        fits = (doc[at] == doc[at + length]) & np.logical_and.reduce([word[at + i] != word[at + length] for i in range(length)])  # a phrase whose words repeat is none
        at, ids = at[fits], ids[fits]
    own, start, length, raw = map(np.concatenate, zip(*found))
    top = np.zeros(part.num_rows)
    np.maximum.at(top, own, raw)
    relevance = np.floor(raw / top[own] * 1e6 + 0.5) / 1e6
    order = np.lexsort((-relevance, own))
    start, length, relevance = start[order], length[order], relevance[order]
    ends = np.searchsorted(own[order], np.arange(part.num_rows), "right")

    def rows(at: int, end: int):
        falling = -relevance[at:end]
        begin = at
        while at < end:
            equal = begin + int(np.searchsorted(falling, falling[at - begin], "right"))
            phrases = [[int(c) for c in word[s : s + n]] for s, n in zip(start[at:equal].tolist(), length[at:equal].tolist())]
            for phrase, own in sorted((" ".join(spelt[c] for c in p), p) for p in phrases):
                yield phrase, float(relevance[at]), {spelt[c]: float(idf[c]) for c in own}
            at = equal

    for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
        yield doc_id, rows(int(ends[i - 1]) if i else 0, int(ends[i]))


def worded(texts: DataFrame) -> DataFrame:
    """(doc_id, words, valued): a text's words without stop words in order, and its different ones with their inverse document frequencies; texts without words are left out.

    A document's words move once, as a whole, and its different words with their frequencies; all else is done where they lie.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)
    words = staged(texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(tokens, lambda w: ~w.isin(*STOP_WORDS)).alias("words")))
    known = words.select("doc_id", F.explode(F.array_distinct("words")).alias("word"))
    n = texts.agg(F.count(F.lit(1)).alias("docs"))  # one row
    idf = known.groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("word", F.round(F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1, 9).alias("idf"))
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0  # phrases take many times their words' room, so tasks are dealt by words
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS))
    valued = known.join(idf, "word").repartition(tasks, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("word", "idf")).alias("valued"))  # dealt alike, or the join would have the default number of tasks
    return words.repartition(tasks, "doc_id").join(valued, "doc_id").select("doc_id", "words", "valued")


def candidates(texts: DataFrame, longest: int = 3) -> DataFrame:
    """(doc_id, phrase, relevance, weights): phrases of a text's words without stop words, and the inverse document frequencies of their words.

    Relevance is the number of times, damped by its logarithm, times the mean weight of the words, over the largest of the document. A
    phrase whose words repeat is none. All phrases of a document lie in one partition.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("phrase", pa.string()), ("relevance", pa.float64()), ("weights", pa.list_(pa.struct([("word", pa.string()), ("idf", pa.float64())])))])

    def told(batches):
        for batch in batches:
            for doc, rows in ranked(batch, longest):
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "phrase": p, "relevance": r, "weights": [{"word": w, "idf": v} for w, v in weights.items()]} for p, r, weights in rows], schema)

    return worded(texts).mapInArrow(told, CANDIDATE)


def keyphrases(texts: DataFrame, k: int = 10, diversity: float = 0.5, longest: int = 3) -> DataFrame:
    """(doc_id, phrase, relevance, place): the k phrases of each text that are most relevant and least alike, whole texts read; a top-k report.

    ``texts`` has doc_id (not null, unique) and text. The phrases of a document are read in the order of relevance by one task, which stops
    looking where no phrase left can win. Texts without words have no phrases.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("phrase", pa.string()), ("relevance", pa.float64()), ("place", pa.int32())])

    def choose(batches):
        for batch in batches:
            found = [(doc, *row, place) for doc, rows in ranked(batch, longest) for place, row in enumerate(picked(rows, k, diversity), 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    return worded(texts).mapInArrow(choose, PHRASE)
