"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

A row x becomes x' = (x, sqrt(M - |x|^2)), where M is the largest squared norm, and an anchor q becomes (q, 0). Then
|q' - x'|^2 = |q|^2 + M - 2 q.x: the nearest rows are those of the largest inner product, and a window of scores is
an annulus of distances around the anchor. Scores themselves are integers and exact; distances only decide what need not be
looked at, with a margin (``SLACK``) far above their rounding.

The top of the tree is built on the driver from a sample of at most ``SAMPLE`` rows (vantage points and median radii); every row is
routed through it to a block of about ``BLOCK`` rows at most. A block that is still larger, as one that holds
thousands of copies, is dealt in parts by a hash of the row. In its task a block's rows become a tree of their own. Anchors are sent only to blocks
that can hold an answer, and walk a block's leaves nearest first, doubling the number of leaves at each step, until
no leaf that is left can be nearer than the answers found.

Two passes bring anchors and blocks together: the first finds the nearest rows of the anchor's label (the
sample's own rows of that label bound how far they can be), the second, for each of these positives, the first rows of other labels
inside its annulus. Each block answers with at most a few rows per anchor, of which the best are taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, pick, read, staged

#: Rows from which the top of the tree is built, at most.
SAMPLE = 16_384
#: Rows of a block at least and at most.
LEAST, BLOCK = 2048, 65_536
#: Rows of a leaf, and splits above it at most: what copies leave unsplit is a larger leaf.
LEAF, DEPTH = 128, 64
#: Anchors whose distances to a block's vantage points are held at once.
HELD = 1024
#: Squared norms stay below this, so that a hundred times a score fits a long.
LARGEST = 1 << 56
#: Part of the largest norm by which a distance may be wrong.
SLACK = 1e-6
LAST = np.iinfo(np.int64).max


def augmented(x: np.ndarray, m: int) -> np.ndarray:
    x = x.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, m - np.einsum("ij,ij->i", x, x)))[:, None]], axis=1)


def reach(q: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Distances of anchors (q, 0) to augmented rows ``x``."""
    q = q.astype(float)
    return np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", q, q)[:, None] + m - 2 * q @ x[:, :-1].T))


class Tree:
    """A vantage-point tree: nodes in the order of a walk, each with the bounds of its two sides; leaves hold runs of ``order``."""

    def __init__(self, x: np.ndarray, m: int, leaf: int):
        """``x``: augmented rows; equal distances stay on one side, so copies may make a leaf larger than ``leaf``."""
        self.m, self.order, self.starts, self.nodes = m, np.arange(len(x)), [], []
        self.vantage: list[np.ndarray] = []
        self._split(x, 0, len(x), leaf)
        self.starts.append(len(x))
        self.points = np.array(self.vantage) if self.vantage else np.empty((0, x.shape[1]))

    def _split(self, x: np.ndarray, at: int, end: int, leaf: int, depth: int = 0) -> tuple[str, int]:
        rows = self.order[at:end]
        if len(rows) > leaf and depth < DEPTH:
            own = x[rows]
            spread = own[:: max(1, len(rows) // 64)]
            start = ((own - spread.mean(axis=0)) ** 2).sum(axis=1).argmax()  # a row at the rim parts better than one in the middle
            d = np.sqrt(((own - own[start]) ** 2).sum(axis=1))
            median = np.median(d)
            inside = d <= median
            if inside.all():
                inside = d < median
            if inside.any():
                number = len(self.nodes)
                self.nodes.append(None)
                self.vantage.append(own[start])
                order, near, far = np.concatenate([rows[inside], rows[~inside]]), d[inside], d[~inside]
                self.order[at:end] = order
                sides = [self._split(x, at, at + len(near), leaf, depth + 1), self._split(x, at + len(near), end, leaf, depth + 1)]
                self.nodes[number] = (sides, [(near.min(), near.max()), (far.min(), far.max())], median)
                return "node", number
        self.starts.append(at)
        return "leaf", len(self.starts) - 1

    def bounds(self, q: np.ndarray, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of each anchor to the rows of each leaf; ``loose``: of rows that the tree was not built from."""
        n, margin = len(self.starts) - 1, SLACK * math.sqrt(self.m)
        low, high = np.zeros((len(q), n)), np.full((len(q), n), np.inf)
        d = reach(q, self.points, self.m)
        todo = [("node", 0, low[:, 0], high[:, 0])] if self.nodes else []
        while todo:
            _, i, least, most = todo.pop()
            sides, spans, median = self.nodes[i]
            for side, (kind, j) in enumerate(sides):
                lo, hi = ((0.0, median) if side == 0 else (median, np.inf)) if loose else spans[side]
                a, b = np.maximum(least, np.maximum(d[:, i] - hi, lo - d[:, i]) - margin), np.minimum(most, d[:, i] + hi + margin)
                if kind == "node":
                    todo.append((kind, j, a, b))
                else:
                    low[:, j], high[:, j] = a, b
        return low, high

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each augmented row belongs to by the medians."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            i, rows = todo.pop()
            sides, _, median = self.nodes[i]
            inside = np.sqrt(((x[rows] - self.points[i]) ** 2).sum(axis=1)) <= median
            for (kind, j), part in zip(sides, (rows[inside], rows[~inside]), strict=True):
                if kind == "node":
                    todo.append((j, part))
                else:
                    out[part] = j
        return out


class Top:
    """The top of the tree over rows of one length, with the sample it was built from."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, m: int, blocks: int):
        self.sample, self.labels, self.m = sample, labels, m
        self.tree = Tree(augmented(sample, m), m, max(4, -(-len(sample) // blocks)))

    def near(self, q: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each anchor has k rows of its label besides itself; infinite if the sample cannot tell."""
        out = np.full(len(q), np.inf)
        norms = np.einsum("ij,ij->i", q.astype(float), q.astype(float))
        for label in np.unique(labels):
            rows, known = np.flatnonzero(labels == label), self.sample[self.labels == label]
            if len(known) > k:  # one of them may be the anchor itself
                scores = q[rows].astype(float) @ known.T.astype(float)
                kth = np.partition(scores, len(known) - k - 1, axis=1)[:, len(known) - k - 1]
                out[rows] = np.sqrt(np.maximum(0.0, norms[rows] + self.m - 2 * kth))
        return out


def tables(batch) -> dict[str, np.ndarray]:
    """The columns of a batch as arrays; null ids come last in every order, as the largest long."""
    ids = batch.column("vec_id")
    return {
        "v": batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1),
        "id": ids.fill_null(LAST).to_numpy(zero_copy_only=False), "label": batch.column("label").to_numpy(), "row": batch.column("row").to_numpy(),
    }


def by_length(batch):
    """(length, the rows of a batch whose vectors have it)."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch


def first_k(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Of ``places``, the first k by score, then id."""
    if len(places) > 4 * k:  # all that tie with the k-th
        places = places[scores[places] >= np.partition(scores[places], len(places) - k)[len(places) - k]]
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


class Block:
    """One block's rows as a tree, with what anchors ask of it."""

    def __init__(self, rows: dict[str, np.ndarray], m: int):
        self.m = m
        self.tree = Tree(augmented(rows["v"], m), m, LEAF)
        order = self.tree.order
        self.id, self.label, self.row = rows["id"][order], rows["label"][order], rows["row"][order]
        self.v = rows["v"][order].astype(float if m < 1 << 53 else np.int64)  # sums of products below 2**53 are exact in floats
        self.leaf_starts = np.array(self.tree.starts[:-1])
        self.leaf_ends = np.append(self.leaf_starts[1:], len(order))

    def asked(self, anchors: dict[str, np.ndarray]):
        """(place of the anchor, its scores function, least and largest distance to each leaf)."""
        for at in range(0, len(anchors["v"]), HELD):
            q = anchors["v"][at : at + HELD]
            low, high = self.tree.bounds(q)
            for i in range(len(q)):
                yield at + i, Scores(self, q[i]), low[i], high[i]


class Scores:
    """The scores of one anchor with a block, computed leaf by leaf as they are asked for."""

    def __init__(self, block: Block, q: np.ndarray):
        self.block, self.q = block, q.astype(block.v.dtype)
        self.square = float(q.astype(float) @ q.astype(float))
        self.scores, self.known = np.zeros(len(block.id), np.int64), np.zeros(len(block.leaf_starts), bool)

    def distance(self, score: float) -> float:
        return math.sqrt(max(0.0, self.square + self.block.m - 2.0 * score))

    def first(self, leaves: np.ndarray, low: np.ndarray, fits, k: int) -> np.ndarray:
        """The first k rows that ``fits``, of leaves sorted nearest first: stops when no leaf left can hold a nearer one."""
        b, found, at, step = self.block, np.empty(0, np.int64), 0, 1
        margin = SLACK * math.sqrt(b.m)
        while at < len(leaves):
            if len(found) == k and low[leaves[at]] > self.distance(self.scores[found[-1]]) + margin:
                break
            some = leaves[at : at + step]
            for leaf in some[~self.known[some]]:
                s, e = b.leaf_starts[leaf], b.leaf_ends[leaf]
                self.scores[s:e] = b.v[s:e] @ self.q
                self.known[leaf] = True
            places = np.concatenate([np.arange(b.leaf_starts[leaf], b.leaf_ends[leaf]) for leaf in some])
            places = places[fits(self.scores[places], places)]
            found = first_k(self.scores, b.id, np.concatenate([found, places]), k)
            at, step = at + step, 2 * step
        return found


def blocks_of(batches, m: int):
    """(block, anchors) for each block of rows sorted by block and kind: rows (kind 0) come whole, anchors in batches as they come."""
    name, held, block = None, [], None
    for batch in batches:
        names, kinds = batch.column("block").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(names)], strict=True):
            if s == e:
                continue
            if names[s] != name:
                name, held, block = names[s], [], None
            if kinds[s] == 0:
                held.append(batch.slice(s, e - s))
            elif held or block:
                if block is None:
                    block, held = Block(tables(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), m), []
                yield block, batch.slice(s, e - s)


ANSWER = "row long, place int, found long, vec_id long, score long"


def positives_in(batches, m: int, k: int):
    """Per anchor its first k other rows of its label in each block."""
    for block, batch in blocks_of(batches, m):
        a, out = tables(batch), []
        for i, scores, low, _ in block.asked(a):
            def fits(_, places, label=a["label"][i], row=a["row"][i]):
                return (block.label[places] == label) & (block.row[places] != row)

            order = np.argsort(low, kind="stable")
            found = scores.first(order, low, fits, k)
            out.append((np.full(len(found), a["row"][i]), np.zeros(len(found), np.int32), block.row[found], block.id[found], scores.scores[found]))
        yield from answers(out)


def negatives_in(batches, m: int, k: int, window: tuple[int, int]):
    """Per anchor and positive the first k rows of other labels in each block whose scores lie in the window."""
    for block, batch in blocks_of(batches, m):
        a, out, wanted = tables(batch), [], batch.column("wanted").to_pylist()
        for i, scores, low, high in block.asked(a):
            for place, best in enumerate(wanted[i]):
                if best < 0:
                    continue
                near, far = scores.distance(window[1] * best / 100), scores.distance(window[0] * best / 100)
                margin = SLACK * math.sqrt(m)
                leaves = np.flatnonzero((low <= far + margin) & (high >= near - margin))

                def fits(found, places, best=best, label=a["label"][i]):
                    return (block.label[places] != label) & (100 * found >= window[0] * best) & (100 * found <= window[1] * best)

                found = scores.first(leaves[np.argsort(low[leaves], kind="stable")], low, fits, k)
                out.append((np.full(len(found), a["row"][i]), np.full(len(found), place, np.int32), block.row[found], block.id[found], scores.scores[found]))
        yield from answers(out)


def answers(out: list):
    if out:
        row, place, found, ids, score = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(place), pa.array(found), pa.array(ids, mask=ids == LAST), pa.array(score)], ["row", "place", "found", "vec_id", "score"])


def usable(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v, dim, row) of the rows that take part; ``row`` tells rows apart that repeat an id."""
    rows = pick(table, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.coalesce(F.col("label").isNotNull() & finite & (F.size("e") > 0), F.lit(False)))
    whole = kept.withColumn("w", F.transform("e", lambda x: F.floor(x * float(scale)).cast("double")))
    small = F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x) < float(LARGEST)
    checked = F.when(small, F.lit(True)).otherwise(F.raise_error(F.lit(f"a squared norm times {scale * scale} must be below {LARGEST}, or scores do not fit a long")).cast("boolean"))
    return whole.where(checked).select("vec_id", "label", F.col("w").cast("array<int>").alias("v"), F.size("e").alias("dim"), F.monotonically_increasing_id().alias("row"))


def tops(rows: DataFrame, m: int) -> dict[int, Top]:
    """The top of the tree for each length of which there are more rows than fit a block."""
    found = {}
    n_parts = partitions(rows.sparkSession)
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAST).collect():
        size = max(LEAST, min(BLOCK, r["n"] // n_parts))
        sample = rows.where(F.col("dim") == r["dim"]).select("label", "v").orderBy(F.xxhash64("row", "v")).limit(min(SAMPLE, r["n"])).toArrow()
        v = sample.column("v").combine_chunks().flatten().to_numpy().astype(np.int32).reshape(sample.num_rows, -1)
        found[r["dim"]] = Top(v, sample.column("label").to_numpy(), m, -(-r["n"] // size))
    return found


def routed(rows: DataFrame, found: dict[int, Top]) -> DataFrame:
    """``rows`` with the leaf of the top that each belongs to."""
    def run(batches):
        for batch in batches:
            for dim, part in by_length(batch):
                top = found.get(dim)
                leaf = top.tree.leaf_of(augmented(tables(part)["v"], top.m)) if top else np.zeros(part.num_rows, np.int32)
                yield part.append_column("leaf", pa.array(leaf))

    return rows.mapInArrow(run, f"{rows_schema(rows)}, leaf int")


def rows_schema(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def sent(anchors: DataFrame, found: dict[int, Top], parts: dict[tuple[int, int], int], reached) -> DataFrame:
    """A copy of each anchor for every block that ``reached(top, batch, low, high)`` says it must see."""
    def run(batches):
        for batch in batches:
            for dim, part in by_length(batch):
                top = found.get(dim)
                if top:
                    ask, leaf = np.nonzero(reached(top, part, *top.tree.bounds(tables(part)["v"], loose=True)))
                else:
                    ask, leaf = np.arange(part.num_rows), np.zeros(part.num_rows, int)
                times = np.array([parts.get((dim, int(x)), 1) for x in leaf], int)
                number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                out = part.take(pa.array(np.repeat(ask, times)))
                yield out.append_column("leaf", pa.array(np.repeat(leaf, times).astype(np.int32))).append_column("part", pa.array(number.astype(np.int32)))

    return anchors.mapInArrow(run, f"{rows_schema(anchors)}, leaf int, part int")


def met(rows: DataFrame, anchors: DataFrame, run) -> DataFrame:
    """What ``run`` answers when blocks of rows meet the anchors sent to them."""
    name = F.concat_ws("/", "dim", "leaf", "part").alias("block")
    shared = ["vec_id", "label", "v", "row", "dim"]
    wanted = F.lit(None).cast("array<long>") if "wanted" not in anchors.columns else F.col("wanted")
    both = rows.select(name, F.lit(0).alias("kind"), *shared, F.lit(None).cast("array<long>").alias("wanted")).unionByName(anchors.select(name, F.lit(1).alias("kind"), *shared, wanted.alias("wanted")))
    return both.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block", "kind").mapInArrow(run, ANSWER)


def hard_negatives(rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of :func:`usable` for which ``anchors`` holds.

    Scores are inner products; higher ones come first, ties by smaller id, null ids last. An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels with window[0] * positive_score <=
    100 * score <= window[1] * positive_score are returned. Rows whose vectors differ in length do not meet. Rows that repeat an
    id are rows of their own. An anchor without positives, and a positive without negatives, gives no rows.
    """
    rows = staged(rows, "negatives-rows")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    m = rows.agg(F.max(norm)).first()[0]
    if m is None:
        return rows.select(*[F.lit(None).cast(t).alias(n) for n, t in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))])
    m = max(1, m)
    found = tops(rows, m)
    placed = staged(routed(rows, found), "negatives-placed")
    many = {(r["dim"], r["leaf"]): -(-r["n"] // BLOCK) for r in placed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).collect()}
    parts = F.lit(1)
    for (dim, leaf), n in many.items():
        parts = F.when((F.col("dim") == dim) & (F.col("leaf") == leaf), n).otherwise(parts)
    data = placed.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
    asking = placed.where(F.coalesce(anchors, F.lit(False))).drop("leaf")

    def nearer(top, batch, low, high):
        a = tables(batch)
        return low <= (top.near(a["v"], a["label"], positives) + SLACK * math.sqrt(m))[:, None]

    best = met(data, sent(asking, found, many, nearer), lambda b: positives_in(b, m, positives))
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "found"]
    ranked = best.withColumn("place", F.row_number().over(W.partitionBy("row").orderBy(*order)) - 1).where(F.col("place") < positives)
    chosen = staged(ranked.select("row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    wanted = chosen.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("wanted"))

    def around(top, batch, low, high):
        q = tables(batch)["v"].astype(float)
        square, margin, out = np.einsum("ij,ij->i", q, q), SLACK * math.sqrt(m), np.zeros(low.shape, bool)
        for i, scores in enumerate(batch.column("wanted").to_pylist()):
            for best in scores:
                if best >= 0:
                    near, far = (math.sqrt(max(0.0, square[i] + m - 2.0 * s * best / 100)) for s in (window[1], window[0]))
                    out[i] |= (low[i] <= far + margin) & (high[i] >= near - margin)
        return out

    told = met(data, sent(staged(asking.join(wanted, "row"), "negatives-asking"), found, many, around), lambda b: negatives_in(b, m, negatives, window))
    ranked = told.withColumn("rank", F.row_number().over(W.partitionBy("row", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    named = ranked.select("row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["row", "place"])
    ids = asking.select("row", F.col("vec_id").alias("anchor_id"))
    return named.join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(table: DataFrame, *, scale: int = 256, every: int = 50, noisy: int = 7, labels: int = 10) -> DataFrame:
    """:func:`hard_negatives` of the usable rows, with every ``every``-th id an anchor and the label of every ``noisy``-th id moved on by one.

    Rows with a null label, a null or empty vector, or a null or non-finite component take no part; components become floor(scale * x). Labels
    are whole numbers. Null ids are no anchors and keep their labels. A squared norm of 2**56 / scale**2 or more
    is an error, since scores would not fit a long. An empty table gives no rows. Extra columns, whatever their names, are not read.
    """
    moved = F.when(F.col("vec_id") % noisy == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return hard_negatives(usable(table, scale).withColumn("label", moved), F.col("vec_id") % every == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
