"""Each query's best vectors by a score of the two, met block by block.

A group's queries and vectors are dealt to blocks of about ``FEW`` rows, but to no more than ``MOST``: every row then moves ``MOST`` times at most, however
many there are, and only the pairs that are computed are quadratic. Blocks of more than ``LARGEST`` components are cut further, so
that the memory of a task is bounded; from there on copies grow too (at ``MOST`` blocks of 64 components, from two million vectors a group).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

FEW, MOST, LARGEST = 8192, 8, 1 << 24
#: Queries and vectors that are scored at a time within a task.
TILE = (256, 4096)
FOUND = "query_id long, vec_id long, score double"


def spans(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``wanted``, place in the sorted ``ids``) of all that are equal."""
    low, high = np.searchsorted(ids, wanted, "left"), np.searchsorted(ids, wanted, "right")
    n = high - low
    return np.repeat(np.arange(len(wanted)), n), np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def best_of(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, score: Callable, ranked: Callable, hidden: tuple, parts: tuple | None):
    """(query's place, id, score) of each query's k best by ``ranked`` score, then id; ``ids`` ascend. ``hidden`` pairs of places, by query, do not count, nor do equal ``parts``."""
    tall, wide = TILE
    for at in range(0, len(q), tall):
        mine = q[at : at + tall]
        row, place, own, found = np.empty(0, int), np.empty(0), np.empty(0, ids.dtype), np.empty(0)
        here = slice(*np.searchsorted(hidden[0], (at, at + tall)))
        hidden_row, hidden_col = hidden[0][here] - at, hidden[1][here]
        for begin in range(0, len(v), wide):
            s = score(mine, v[begin : begin + wide])
            off = (hidden_col >= begin) & (hidden_col < begin + wide)
            s[hidden_row[off], hidden_col[off] - begin] = -np.inf
            if parts is not None:
                part = parts[0][at : at + tall, None]
                s[(part == parts[1][None, begin : begin + wide]) & (part >= 0)] = -np.inf
            full = np.bincount(row, minlength=len(mine)) >= k
            bar = np.full(len(mine), -np.inf)
            if not full.all() and s.shape[1] > k:
                bar = np.partition(s, -k, axis=1)[:, -k] - 2e-6  # may round to the same
            last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else row
            bar[full] = (place[last] / 1e6)[full[row[last]]]  # later ids must be better
            r, c = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
            if not len(r):
                continue
            new = ranked(s[r, c])
            row, place, own, found = (np.concatenate(x) for x in ((row, r), (place, new), (own, ids[begin + c]), (found, s[r, c])))
            order = np.lexsort((own, -place, row))
            start = np.searchsorted(row[order], row[order])
            order = order[np.arange(len(order)) - start < k]
            row, place, own, found = row[order], place[order], own[order], found[order]
        yield at + row, own, found


def best_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, score: Callable, ranked: Callable, within: list[str], apart: str | None = None, known: DataFrame | None = None, prepared: Callable = lambda x: x) -> DataFrame:
    """``FOUND``: for each query and block of vectors of its length and equal ``within`` the k best others, with another value of ``apart`` and not ``known`` (query_id, vec_id).

    ``score`` of two matrices, ``prepared`` before, is a new matrix, greatest first; NaN counts as greatest. ``ranked`` scores decide.
    """
    keys = ["dim", *within]
    kinds = {df.schema["embedding"].dataType.simpleString() for df in (vectors, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"

    def rows(df: DataFrame) -> DataFrame:
        part = F.col(apart).cast("string") if apart else F.lit(None).cast("string")
        return df.where("vec_id IS NOT NULL").select(F.size("embedding").alias("dim"), *within, F.col("vec_id").cast("long").alias("id"), F.lit(None).cast("long").alias("other"), part.alias("part"), F.col("embedding").cast(kind).alias("e"))

    def cuts() -> Column:
        n = F.count(F.lit(1))
        return F.greatest(F.least(F.ceil(n / FEW), F.lit(MOST)), F.ceil(n * F.max(F.col("dim")) / LARGEST)).cast("int")

    asked, held = rows(queries), rows(vectors)
    sizes = staged(asked.groupBy(*keys).agg(cuts().alias("n_q")).join(held.groupBy(*keys).agg(cuts().alias("n_v")), keys))
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n_q").cast("long") * F.col("n_v")), F.lit(0))).first()[0]

    def block(of: str, n: str) -> Column:
        return F.pmod(F.xxhash64(of), F.col(n)).cast("int")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    columns = [*keys, "q_block", "v_block", "side", "id", "other", "part", "e"]
    sides = [
        asked.join(sizes, keys).withColumn("side", F.lit(0)).withColumn("q_block", block("id", "n_q")).withColumn("v_block", all_of("n_v")).select(*columns),
        held.join(sizes, keys).withColumn("side", F.lit(1)).withColumn("v_block", block("id", "n_v")).withColumn("q_block", all_of("n_q")).select(*columns),
    ]
    if known is not None:  # a known pair moves once, to the one pair of blocks that may find it
        told = known.select(F.col("query_id").cast("long").alias("id"), F.col("vec_id").cast("long").alias("other")).join(asked.select(*keys, "id").distinct(), "id").join(sizes, keys)
        sides.append(told.select(*keys, block("id", "n_q").alias("q_block"), block("other", "n_v").alias("v_block"), F.lit(2).alias("side"), "id", "other", F.lit(None).cast("string").alias("part"), F.lit(None).cast(kind).alias("e")))
    met = sides[0]
    for side in sides[1:]:
        met = met.unionByName(side)
    places = [*keys, "q_block", "v_block"]

    def found(t: pa.Table) -> pa.Table:
        def of(side: int):
            x = t.filter(pc.equal(t["side"], side))
            ids = x["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            return x, ids[order], order

        def matrix(x: pa.Table, order: np.ndarray) -> np.ndarray:
            flat = x["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            return prepared(flat.reshape(x.num_rows, -1)[order])

        t = t.set_column(t.schema.get_field_index("part"), "part", pc.fill_null(t["part"].combine_chunks().dictionary_encode().indices, -1))
        (x, q_ids, q_order), (y, v_ids, v_order), (z, _, _) = of(0), of(1), of(2)
        if not x.num_rows or not y.num_rows:
            return pa.table({"query_id": pa.array([], "int64"), "vec_id": pa.array([], "int64"), "score": pa.array([], "float64")})
        row, col = spans(v_ids, q_ids)
        if z.num_rows:
            told, to = spans(v_ids, z["other"].to_numpy())
            again, by = spans(q_ids, z["id"].to_numpy()[told])
            row, col = np.append(row, by), np.append(col, to[again])
        hidden = np.argsort(row, kind="stable")
        parts = (x["part"].to_numpy()[q_order], y["part"].to_numpy()[v_order]) if apart else None

        def scored(a, b):
            s = score(a, b)
            s[np.isnan(s)] = np.inf
            return s

        with np.errstate(over="ignore", invalid="ignore"):
            got = [np.concatenate(c) for c in zip(*best_of(matrix(x, q_order), matrix(y, v_order), v_ids, k, scored, ranked, (row[hidden], col[hidden]), parts), strict=True)]
        return pa.table({"query_id": q_ids[got[0]], "vec_id": got[1], "score": np.where(np.isinf(got[2]), np.nan, got[2])})

    return met.repartition(max(1, min(3 * pairs, 4096)), *places).groupBy(*places).applyInArrow(found, FOUND)
