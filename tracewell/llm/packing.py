"""Best-fit packing planned on the histogram of piece lengths.

Documents are encoded once, where they are read; what leaves a task is one short row per piece, with
the piece's rank among the equal lengths of its partition. The histogram has at most ``size`` rows
and is planned on the driver: best-fit decreasing over counts, where sequences with equal room are
handled as ranges. The plan is a list of runs (length, ranks, sequences, offset). Each length splits
at most one range and opens one, so ranges number at most 3 * size, and a range is filled by falling
distinct lengths whose sum is at most ``size``, under sqrt(2 * size) of them: the plan's size has a
bound that the corpus does not move. Pieces take their slots by joining on length and rank.

Ranks need no sort and no task per length: counts by (partition, length) are summed over partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, read, staged
from .tokens import default_path, encoder

PIECES = "piece int, start long, length int, ids_crc32 long, part int, local_rank long"
RUNS = "run_length int, first_rank long, end_rank long, first_sequence long, per_sequence long, run_offset long"
END = (0).to_bytes(4, "little")


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Longest first; a piece goes to a sequence with the least room that holds it, else to a new one.
    The k-th piece of a run lies in sequence ``first + k // per`` at ``offset + k % per * length``.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs, opened = [], 0

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first = size, opened
                n = -(-(count - rank) // (size // length))
                opened += n
            per = left // length
            full = min(n, (count - rank) // per)
            if full:
                runs.append((length, rank, rank + full * per, first, per, size - left))
                leave(left - per * length, first, full)
                rank, first, n = rank + full * per, first + full, n - full
            if n and rank < count:
                rest = count - rank
                runs.append((length, rank, count, first, per, size - left))
                leave(left - rest * length, first, 1)
                rank, first, n = count, first + 1, n - 1
            leave(left, first, n)
    return runs


def pieces_of(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    def cut(batches):
        ids_of, part, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), {}
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column("text")):
                ids = ids_of(text.as_py() or "") + END
                total, start, piece = len(ids) // 4, 0, 0
                end = total % size or size
                while start < total:
                    length = end - start
                    rank = seen[length] = seen.get(length, -1) + 1
                    out.append((row, piece, start, length, zlib.crc32(ids[4 * start : 4 * end]), part, rank))
                    start, end, piece = end, end + size, piece + 1
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", *(f.split()[0] for f in PIECES.split(", "))]
            rows, *columns = (pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), *columns], names)

    texts = pick(docs, "doc_id", "text")
    return texts.mapInArrow(cut, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def pack(docs: DataFrame, *, tokenizer: str | None = None, size: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0, so a null or empty text is one piece of one token. Longer
    documents are cut into pieces of ``size``, of which the first may be shorter. Rows that repeat
    an id, or have none, are documents of their own. Ids may be of any type. Extra columns, whatever their
    names, are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = staged(pieces_of(docs, tokenizer or default_path(), size), "pack-pieces")
    counts = pieces.groupBy(F.col("part").alias("p"), F.col("length").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("l").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.select("p", "l", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    histogram = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = spark.createDataFrame(best_fit(histogram, size), RUNS)

    ranked = pieces.join(ahead, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("local_rank") + F.col("ahead"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    k = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        F.expr("first_sequence + (rank - first_rank) div per_sequence").alias("sequence_id"),
        (F.col("run_offset") + F.pmod(k, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
