"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Unit vectors u, v with cosine c lie sqrt(2 - 2c) apart, so on a random unit direction they differ by
about that over sqrt(dimension). On each of ``PROJECTIONS`` directions the vectors are sorted and each is the
centre of a window; a pair's count is on how many directions one falls into the window of the
other. Window and count are set so that a pair at exactly the threshold passes with probability
``recall``. Passing pairs are verified by cosine in double precision.

A window must be so wide (a near pair keeps 0.95 of its collisions) that it holds a fifth of unrelated vectors
too, so walking the windows of a whole label would be quadratic in it. Labels of more than ``CELL`` vectors are
therefore first cut into cells: ``keys`` further directions, each cut into ranges with a random offset, of which
``keys`` grows with the logarithm of the largest label until a cell holds about ``CELL`` vectors; the ``tables``
cuts that the recall wanted needs follow from that. Windows are walked inside cells. A pair that shares cells of
several tables counts in the first of them, so nothing is emitted per pair: a task sends one row of
counts per vector and a spanning forest of its links.

Equal vectors are folded beforehand. What is moved per table is an id and a cell; vectors are joined to these once
the cells are known. A cell with more than ``BLOCK`` vectors is compared block against block in as many tasks
as it has pairs of blocks.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, partitions, pick, read, staged
from .components import components, forest

PROJECTIONS = 24
#: Vectors that a cell should hold.
CELL = 512
BLOCK = 1024
#: Width of a cell's ranges in units of the distance of a pair at the threshold over sqrt(dimension).
WIDTH = 8.0
#: Half width of the query-centred windows in the same units.
WINDOW = 2.0
#: Links and counters that a task holds at once.
HELD = 2_000_000
COUNTERS = 1 << 24
#: Cells of over BLOCK vectors are broadcast if they are at most so many.
BROADCAST_CELLS = 100_000


def least_count(recall: float) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(WINDOW / math.sqrt(2))
    total = 0.0
    for k in range(PROJECTIONS, -1, -1):
        total += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if total >= recall:
            return k
    return 0


def shape(rows: int, recall: float) -> tuple[int, int]:
    """(directions a cell, tables) for labels of up to ``rows`` vectors.

    Ranges of WIDTH share a pair at the threshold with probability 1 - E|d| / WIDTH for a standard
    normal d, and an unrelated pair with about half of that.
    """
    keys = max(0, math.ceil(math.log(max(1, rows) / CELL) / math.log(2.2)))
    together = (1 - math.sqrt(2 / math.pi) / WIDTH) ** keys
    return keys, math.ceil(math.log(1 - recall) / math.log(1 - together)) if keys else 1


@lru_cache(maxsize=8)
def directions(dim: int, n: int, seed: int) -> np.ndarray:
    a = np.random.default_rng([seed, dim]).normal(size=(dim, n))
    return a / np.linalg.norm(a, axis=0)


def units(column) -> np.ndarray:
    """The vectors of a column of equal lengths, scaled by their largest component first so that no norm overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def cells(unit: np.ndarray, keys: int, tables: int, reach: float) -> np.ndarray:
    """The cell of each vector in each table; one cell if there are no ``keys``."""
    dim = unit.shape[1]
    if not keys:
        return np.zeros((len(unit), tables), np.int64)
    rng = np.random.default_rng([7, dim, keys, tables])
    offset, mix = rng.uniform(size=keys * tables), rng.integers(1, 1 << 62, size=keys, dtype=np.int64) | 1
    at = np.floor(unit @ directions(dim, keys * tables, 1) / (WIDTH * reach / math.sqrt(dim)) + offset).astype(np.int64)
    with np.errstate(over="ignore"):
        h = (at.reshape(len(unit), tables, keys) * mix).sum(axis=2)
        return (h ^ (h >> 29)) * np.int64(0x5851F42D4C957F2D)


def by_dimension(batch):
    """(rows, vectors) of a batch for each length of vectors in it."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        column = batch.column("embedding").take(pa.array(rows))
        yield rows, units(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def collided(seen: np.ndarray, run: np.ndarray, window: float, least: int):
    """Rows (a, b), a < b, of one run that lie in each other's window on ``least`` columns of ``seen`` or more.

    Runs are rows that follow each other. Each column is sorted run by run, and each row's window walked
    upwards, which meets every pair of neighbours once; only these are counted.
    """
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, len(run)))
    cost = np.cumsum(sizes**2)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + COUNTERS, "right")))
        low, high = starts[at], starts[end - 1] + sizes[end - 1]
        first, size = (np.repeat(x[at:end], sizes[at:end]) for x in (starts - low, sizes))
        base = np.cumsum(size) - size - first  # the counter of (a, b) is base[a] + b
        counts = np.zeros(int(size.sum()), np.uint8)
        shift = 4.0 * np.repeat(np.arange(end - at), sizes[at:end])  # no window reaches from one run into the next
        for x in seen[low:high].T:
            x = x + shift
            order = np.argsort(x, kind="stable")
            x = x[order]
            after = np.searchsorted(x, x + window, "right") - np.arange(len(x)) - 1
            upto = np.cumsum(after)
            k = 0
            while k < len(x):
                j = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + HELD, "right")))
                own = np.repeat(np.arange(k, j), after[k:j])
                other = own + 1 + np.arange(len(own)) - np.repeat(upto[k:j] - after[k:j] - (upto[k - 1] if k else 0), after[k:j])
                own, other = order[own], order[other]
                counts[base[np.minimum(own, other)] + np.maximum(own, other)] += 1
                k = j
        hit = np.flatnonzero(counts >= least)
        a = np.searchsorted(np.cumsum(size), hit, "right")
        yield low + a, low + hit - base[a]
        at = end


def links(vectors: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(kind, u, v): kind 0 has the number v of vectors linked to u, kind 1 the forest edge u - v.

    ``vectors`` has label, dim, rep (unique), times and embedding.
    """
    largest = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    keys, tables = shape(largest, recall)
    reach = math.sqrt(2 - 2 * threshold)
    least = least_count(recall)

    def place(batches):
        for batch in batches:
            for rows, unit in by_dimension(batch):
                part = batch.select(["label", "dim", "rep"]).take(pa.array(np.repeat(rows, tables)))
                t = np.tile(np.arange(tables, dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(t), pa.array(cells(unit, keys, tables, reach).ravel())], ["label", "dim", "rep", "t", "cell"])

    shared = ["label", "dim", "t", "cell"]
    kind = vectors.select("label", "dim", "rep", "embedding").schema
    placed = vectors.select("label", "dim", "rep", "embedding").mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind if f.name != "embedding") + ", t int, cell long")
    crowded = staged(
        placed.groupBy(*shared).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(*shared, F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")), "embedding-crowded"
    )
    few = crowded.count() <= BROADCAST_CELLS
    dealt = (
        placed.join(F.broadcast(crowded) if few else crowded, shared, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "t", "cell", F.xxhash64(*shared, F.least("block", "other"), F.greatest("block", "other")).alias("g"), "block", (F.col("block") != F.col("other")).alias("crossed"))
    )
    # rows of two groups may share an id g by chance: label, table and cell tell their runs apart
    whole = dealt.join(vectors.select("rep", "label", "dim", "times", "embedding"), "rep")
    sorted_rows = whole.repartition(partitions(vectors.sparkSession), "g").sortWithinPartitions("g", "dim", "label", "t", "cell", "rep")

    def compare(batches):
        def met(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            g, rep, times, t, cell, block, crossed = (table.column(c).to_numpy() for c in ("g", "rep", "times", "t", "cell", "block", "crossed"))
            label = table.column("label").to_numpy()
            ids, own = np.unique(rep, return_inverse=True)
            counts, found, n_found = np.zeros(len(ids), np.int64), [], 0
            for rows, unit in by_dimension(table):
                new = np.concatenate(([True], np.any([x[rows][1:] != x[rows][:-1] for x in (g, label, t, cell)], axis=0)))
                everywhere = cells(unit, keys, tables, reach)
                window = WINDOW * reach / math.sqrt(unit.shape[1])
                for a, b in collided(unit @ directions(unit.shape[1], PROJECTIONS, 2), np.cumsum(new), window, least):
                    for at in range(0, len(a), 1 << 16):
                        p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                        x, y = rows[p], rows[q]
                        ok = ~crossed[x] | (block[x] != block[y])
                        ok &= np.argmax(everywhere[p] == everywhere[q], axis=1) == t[x]
                        p, q, x, y = p[ok], q[ok], x[ok], y[ok]
                        near = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                        x, y = x[near], y[near]
                        counts += np.bincount(own[x], times[y], len(ids)).astype(np.int64) + np.bincount(own[y], times[x], len(ids)).astype(np.int64)
                        found.append((own[x], own[y]))
                        n_found += len(x)
                        if n_found > HELD:
                            root = forest(*(np.concatenate(s) for s in zip(*found, strict=True)), len(ids))
                            found = [(np.flatnonzero(root != np.arange(len(ids))), root[root != np.arange(len(ids))])]
                            n_found = len(found[0][0])
            some = np.flatnonzero(counts)
            out = [(np.zeros(len(some), np.int32), ids[some], counts[some])]
            if found:
                root = forest(*(np.concatenate(s) for s in zip(*found, strict=True)), len(ids))
                leaf = np.flatnonzero(root != np.arange(len(ids)))
                out.append((np.ones(len(leaf), np.int32), ids[leaf], ids[root[leaf]]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int64))], ["kind", "u", "v"])

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            if cut or (held and held[-1].column("g")[-1].as_py() != g[0]):
                if cut:
                    held.append(batch.slice(0, cut))
                yield met(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield met(held)

    return sorted_rows.mapInArrow(compare, "kind int, u long, v long")


def near_dedup(table: DataFrame, *, threshold: float = 0.98, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and their lengths agree. Null, empty and
    zero vectors, and those with a null or non-finite component, link with nothing: n_links 0, their
    own component. Rows that repeat a vector link with each other; rows that repeat an id are vectors of their
    own. Null ids link like others and lose to any id; a component of null ids only has a null
    component_id. An empty table gives no rows. Extra columns, whatever their names, are not read.
    """
    rows = pick(table, vec_id=id_col, embedding=vector_col, label=label_col).withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    fold = ["fold_a", "fold_b"]  # 128 bits that stand for label and vector where documents are looked up
    rows = rows.withColumns({"usable": usable, "fold_a": F.xxhash64("label", "embedding"), "fold_b": F.xxhash64(F.lit("b"), "embedding", "label")})
    folded = staged(
        rows.where("usable").groupBy(*fold, "label", "embedding").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("times"))
        .withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")),
        "embedding-folded",
    )
    found = staged(links(folded, threshold, recall), "embedding-links")
    counts = found.where("kind = 0").groupBy("u").agg(F.sum("v").alias("links"))
    member = components(found.where("kind = 1").select("u", "v"))
    classes = staged(
        folded.select(*fold, "smallest", "times", "rep").join(counts.withColumnRenamed("u", "rep"), "rep", "left").join(member.withColumnRenamed("id", "rep"), "rep", "left")
        .select(*fold, "smallest", "times", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "embedding-classes",
    )
    smallest = classes.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = lookup(classes.drop("smallest"), smallest, ["component"], "n")
    linked = lookup(rows.where("usable").select("vec_id", *fold), named.drop("component"), fold, "times").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
smallest AS (SELECT u, min(v) AS low FROM reached GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN degree ON degree.u = vec_id LEFT JOIN smallest ON smallest.u = vec_id
"""
