"""Quality classification by a factorisation machine.

Inputs of a document are its distinct hashed words (equal values, unit length), binned statistics of
its structure, and its metadata (stated length). The score is the logistic of

    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which is all pairwise interactions in time linear in the inputs.

The model is fitted on a sample of labelled rows: all of them up to ``max_rows``, beyond that a
hash sample of about that many. Sample rows are found by a broadcast of their ids (bounded by
``max_rows``), so no text is shuffled. Fitting is iterative parameter mixing: ``SHARDS`` tasks each make
a few passes of mini-batches from the same parameters, and the driver averages what they return (about 1 MB each,
whatever the corpus).
"""

from __future__ import annotations

import re
import zlib
from itertools import product
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, held_out, pick, place_of, read, staged

#: Hashed words share this many inputs; inputs of the binned statistics follow them.
WORDS = 1 << 14
BINS = 24
STATISTICS = 14
FACTORS = 8
MAX_ROWS = 12_000
THRESHOLD = 0.7
SHARDS = 4
ROUNDS = 5
#: Passes over its rows that a task makes in a round.
PASSES = 4
BATCH = 128
RATE = 0.1
DECAY = 1e-5

_tail = re.compile(r"[^\w\s]{2,}(?!\S)")
_classes = np.zeros(256, np.intp)
for _i in range(256):
    _c = chr(_i)
    _classes[_i] = 0 if _i >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == "\n" else 5 if _c.isspace() else 6


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, values) of one document; a null text counts as empty."""
    text = text or ""
    words = text.split()
    n = len(words)
    distinct = {zlib.crc32(w.encode("utf-8", "replace")) % WORDS for w in {w.lower() for w in words}}
    raw = np.bincount(_classes[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=7)
    size, letters = max(1, int(raw.sum())), max(1, int(raw[:3].sum()))

    def share(part: float, whole: float) -> int:
        return min(BINS - 1, int(BINS * part / max(1, whole)))

    def log(x: float) -> int:
        return min(BINS - 1, int(1.5 * np.log2(x + 1)))

    lines = text.split("\n")
    binned = (
        log(n), log(sum(map(len, words)) / max(1, n)), share(len(set(words)), n), share(sum(map(eq, words, words[1:])), n - 1),
        share(sum(map(str.isupper, words)), n), share(sum(map(str.isalpha, words)), n), share(len(_tail.findall(text)), n), share(raw[6], size),
        share(raw[3], size), share(raw[2], letters), share(raw[5], size), log(len(lines)), share(len(set(lines)), len(lines)),
        BINS - 1 if n_chars is None else min(BINS - 2, log(max(0, n_chars))),
    )
    inputs = np.concatenate((np.fromiter(sorted(distinct), np.int64, len(distinct)), WORDS + np.arange(STATISTICS) * BINS + np.array(binned)))
    values = np.concatenate((np.full(len(distinct), 1 / np.sqrt(max(1, len(distinct)))), np.full(STATISTICS, 0.5)))
    return inputs, values


class Machine:
    """Parameters of the machine: bias, weights and factors, with the squared gradients of each."""

    def __init__(self) -> None:
        size = WORDS + STATISTICS * BINS
        self.p = np.zeros((size, 1 + FACTORS))  # column 0: weights
        self.p[:, 1:] = np.random.default_rng(0).normal(0, 0.05, (size, FACTORS))
        self.bias = 0.0
        self.seen = np.full((size, 1 + FACTORS), 1e-6)
        self.bias_seen = 1e-6

    def forward(self, inputs, values, starts):
        x = self.p[inputs] * values[:, None]
        sums = np.add.reduceat(x, starts)
        squares = np.add.reduceat(x[:, 1:] ** 2, starts)
        z = self.bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), x, sums

    def step(self, inputs, values, starts, labels) -> None:
        score, x, sums = self.forward(inputs, values, starts)
        rows = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(inputs))))
        error = (score - labels) / len(labels)
        slope = np.empty_like(x)
        slope[:, 0] = values
        slope[:, 1:] = (sums[rows, 1:] - x[:, 1:]) * values[:, None]
        slope *= error[rows, None]
        used, at = np.unique(inputs, return_inverse=True)
        grad = np.stack([np.bincount(at, slope[:, f], len(used)) for f in range(1 + FACTORS)], axis=1) + DECAY * self.p[used]
        self.seen[used] += grad**2
        self.p[used] -= RATE * grad / np.sqrt(self.seen[used])
        self.bias_seen += error.sum() ** 2
        self.bias -= RATE * error.sum() / np.sqrt(self.bias_seen)

    def flat(self) -> np.ndarray:
        return np.concatenate((self.p.ravel(), self.seen.ravel(), [self.bias, self.bias_seen])).astype(np.float32)

    @classmethod
    def of(cls, flat: np.ndarray) -> Machine:
        out = cls()
        half = out.p.size
        out.p, out.seen = flat[:half].reshape(out.p.shape).astype(float), flat[half : 2 * half].reshape(out.p.shape).astype(float)
        out.bias, out.bias_seen = float(flat[-2]), float(flat[-1])
        return out


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    """(doc_id, label, inputs, values) of the labelled rows that are learned from.

    Rows with a null id or label are not learned from; of repeated labels the mean counts.
    """
    usable = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    share = min(1.0, max_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = pick(docs, doc_id=id_col, text=text_col, n_chars=chars_col).join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        for batch in batches:
            found = [features(t.as_py(), n) for t, n in zip(batch.column("text"), batch.column("n_chars").to_pylist(), strict=True)]
            arrays = [batch.column("doc_id"), batch.column("label"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "inputs", "values"])

    found = rows.mapInArrow(extract, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label double, inputs array<long>, values array<double>")
    return staged(found.repartition(SHARDS, "doc_id").sortWithinPartitions(F.xxhash64("doc_id")), "quality-sample")


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> np.ndarray:
    """The fitted parameters as one flat array; without labelled rows, those of an unfitted machine."""
    rows = sample(docs, labels, max_rows, id_col, text_col, chars_col).coalesce(SHARDS).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    flat = Machine().flat()
    for _ in range(rounds):

        def epoch(batches, flat=flat):
            machine, n = Machine.of(flat), 0
            for batch in batches:
                for _, at in product(range(PASSES), range(0, batch.num_rows, BATCH)):
                    part = batch.slice(at, BATCH)
                    inputs, values = part.column("inputs"), part.column("values")
                    ends = np.cumsum([len(v) for v in inputs])
                    machine.step(inputs.flatten().to_numpy(), values.flatten().to_numpy(), np.concatenate(([0], ends[:-1])), part.column("label").to_numpy())
                n += batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([machine.flat().tobytes()])], ["n", "flat"])

        found = rows.mapInArrow(epoch, "n long, flat binary").collect()  # a row per shard
        if not found:
            break
        weights = np.array([r["n"] for r in found], float)
        flat = np.average([np.frombuffer(r["flat"], np.float32) for r in found], axis=0, weights=weights).astype(np.float32)
    return flat


def score(docs: DataFrame, flat: np.ndarray, *, text_col: str = "text", chars_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs``, its columns as c0, c1, ... in their order, with score (0 to 1) and accepted.

    Every row is scored by its own text and metadata, null text counting as empty, so repeated rows
    score alike and null ids do not matter. An empty table gives no rows. Columns are taken by place:
    extra ones of any name, even two of one name, stay as they are.
    """
    half = (flat.size - 2) // 2
    small = flat.copy()
    small[half : 2 * half] = 0

    @F.pandas_udf("double")
    def scored(texts, chars):
        import pandas as pd

        machine = Machine.of(small)
        out = np.empty(len(texts))
        for at in range(0, len(texts), 512):
            found = [features(t, None if pd.isna(n) else int(n)) for t, n in zip(texts[at : at + 512], chars[at : at + 512], strict=True)]
            ends = np.cumsum([len(f[0]) for f in found])
            out[at : at + 512] = machine.forward(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate(([0], ends[:-1])))[0]
        return pd.Series(out)

    found = scored(F.coalesce(F.col(place_of(docs, text_col)), F.lit("")), F.col(place_of(docs, chars_col)).cast("double"))
    return by_place(docs).withColumn("score", found).withColumn("accepted", F.col("score") >= threshold)


def accepted(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows of ``docs`` that the fitted machine accepts, with all their columns: the pipeline's form of the operator.

    Rows with a null id or text and repeated rows are judged like others; extra columns of any name stay.
    """
    return score(docs, fit(docs, labels, **fitting)).where("accepted").drop("score", "accepted").toDF(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    docs = pick(docs, "doc_id", "text", "n_chars")
    found = score(docs, fit(docs, labels))
    doc_id = F.col(place_of(docs, "doc_id"))
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", F.col("accepted").cast("int").alias("predicted"))
