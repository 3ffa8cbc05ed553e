"""Centroid clustering by ball k-means over integer vectors.

A cluster is a ball: its centroid and a radius that no member exceeds. Centroids i and j are neighbours when half their
distance is at most the radius of i; members of i never move to others. Of a ball, the members nearer to the centroid than half
the way to the nearest neighbour are its stable core and stay without a comparison. Neighbours sorted by distance cut the
rest into annuli: a member of the m-th annulus is compared with the m nearest neighbours only. Distances are
squared integers, so every one of these tests is exact: j can win x from i only if
|ci - cj|^2 <= 4 |x - ci|^2. Radii come from the last assignment: its farthest member, and how far the centroid has moved since.

A round is one job: tasks assign their vectors and send one row of counts, sums and radius for each of their clusters. Which cluster a
vector was in before is not stored but replayed from the earlier centroids (``k`` rows a round, closed over
by the task), which costs about one distance a round; every ``replayed`` rounds the assignment is written, so the
replay stays bounded. Centroids are k rows of the vectors' length on the driver, k at most ``MOST``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read, staged

#: Clusters at most: the driver holds their centroids and the distances between them.
MOST = 2048
#: Components at most, as a power of two: squared distances of 64 of these still fit a long.
LARGEST = 1 << 27
#: No squared distance is over four times this.
FAR = 1 << 60
#: Vectors of which a task holds the differences to a centroid at once.
HELD = 1 << 16


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to ``c`` (one row, or one for each row of x)."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), HELD):
        d = x[at : at + HELD] - (c if c.ndim == 1 else c[at : at + HELD])
        out[at : at + HELD] = np.einsum("ij,ij->i", d, d)
    return out


class Balls:
    """Centroids of a round with the neighbours of each, nearest first."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None):
        """``radii`` bound the squared distance of members to these centroids; None: there are no members yet."""
        self.centroids = centroids
        self.neighbours = []
        for i, c in enumerate(centroids if radii is not None else []):
            apart = squares(centroids, c)
            near = np.flatnonzero((apart <= 4 * min(radii[i], FAR)) & (np.arange(len(centroids)) != i)) if radii[i] >= 0 else np.empty(0, int)
            near = near[np.argsort(apart[near], kind="stable")]
            self.neighbours.append((near, apart[near]))

    def assign(self, x: np.ndarray, cluster: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row, and the number of distances computed; ``cluster``: where rows were before."""
        if cluster is None:
            best, own = np.zeros(len(x), np.int32), squares(x, self.centroids[0])
            for j in range(1, len(self.centroids)):
                d = squares(x, self.centroids[j])
                best, own = np.where(d < own, np.int32(j), best), np.minimum(d, own)
            return best, own, len(x) * len(self.centroids)
        own = squares(x, self.centroids[cluster])
        best, low, met = cluster.copy(), own.copy(), len(x)
        for i in np.unique(cluster):
            near, apart = self.neighbours[i]
            rows = np.flatnonzero(cluster == i)
            annulus = np.searchsorted(apart, 4 * np.minimum(own[rows], FAR), "right")  # 0: the stable core
            for m, j in enumerate(near):
                asked = rows[annulus > m]
                if not len(asked):
                    break
                d = squares(x[asked], self.centroids[j])
                wins = (d < low[asked]) | ((d == low[asked]) & (j < best[asked]))
                best[asked[wins]], low[asked[wins]] = j, d[wins]
                met += len(asked)
        return best, low, met


def vectors_of(batch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def replay(batch, x: np.ndarray, history: list[Balls]) -> tuple[np.ndarray, np.ndarray, int]:
    """The assignment of a batch in the last round of ``history``, from the one that it carries, if any."""
    carried = batch.column("cluster").to_numpy(zero_copy_only=False)
    cluster = None if len(carried) and carried[0] < 0 else carried.astype(np.int32)
    low, met = np.zeros(len(x), np.int64), 0
    for balls in history:
        cluster, low, n = balls.assign(x, cluster)
        met += n
    return cluster, low, met


def tallied(points: DataFrame, history: list[Balls]) -> dict[int, tuple[int, int, list[int], int]]:
    """Per non-empty cluster of the last round: members, largest squared distance, sums of components and distances computed."""
    k, dim = history[-1].centroids.shape

    def run(batches):
        n, far, sums, met = np.zeros(k, np.int64), np.full(k, -1, np.int64), np.zeros((k, dim), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch)
                cluster, low, m = replay(batch, x, history)
                met += m
                n += np.bincount(cluster, minlength=k)
                np.maximum.at(far, cluster, low)
                for i in np.unique(cluster):
                    sums[i] += x[cluster == i].sum(axis=0)
        some = np.flatnonzero(n)
        if len(some):
            split = np.full(len(some), 0, np.int64)
            split[0] = met
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(far[some]), pa.array(split), *[pa.array(sums[some, i]) for i in range(dim)]],
                ["cluster", "n", "far", "met", *[f"s{i}" for i in range(dim)]],
            )

    schema = "cluster int, n long, far long, met long, " + ", ".join(f"s{i} long" for i in range(dim))
    total = [F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    rows = points.mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("met").alias("met"), *total).collect()
    return {r["cluster"]: (r["n"], r["far"], [int(r[f"s{i}"]) for i in range(dim)], r["met"]) for r in rows}


def assigned(points: DataFrame, history: list[Balls]) -> DataFrame:
    """``points`` (vec_id, v, cluster) with the clusters of the last round of ``history``, and the distances."""
    def run(batches):
        for batch in batches:
            cluster, low, _ = replay(batch, vectors_of(batch), history) if batch.num_rows else (np.empty(0, np.int32), np.empty(0, np.int64), 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(low)], ["vec_id", "v", "cluster", "distance"])

    kind = dict(points.dtypes)
    return points.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind['vec_id']}, v array<int>, cluster int, distance long")


def moved(radius: int, old: np.ndarray, new: np.ndarray) -> int:
    """A bound on the squared radius around a centroid that moved, from the one before."""
    if radius < 0:
        return -1
    shift = int(sum(int(a - b) ** 2 for a, b in zip(old.tolist(), new.tolist(), strict=True)))
    return (math.isqrt(radius) + 1 + math.isqrt(shift) + 1) ** 2 if shift else radius


def points_of(table: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v, cluster -1) of the usable vectors, components floor(scale * x)."""
    rows = pick(table, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x * float(scale)))
    fits = F.forall("embedding", lambda x: F.abs(x) * float(scale) < float(LARGEST))
    kept = rows.where(F.coalesce((F.size("embedding") == dim) & finite, F.lit(False)))
    checked = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit(f"a component times {scale} must be below {LARGEST}, or distances do not fit a long")).cast("boolean"))
    return kept.where(checked).select("vec_id", whole.cast("array<int>").alias("v"), F.lit(-1).alias("cluster"))


def ball_kmeans(table: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, replayed: int = 10) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of ``dim`` finite components take part, as integers floor(scale * x). Centroids start as the ``k`` vectors with the smallest
    sha256 of ``seed:vec_id`` (all, if fewer; null ids last; of rows that repeat an id, the smaller vector first) and are numbered in that order;
    equal vectors may seed two clusters, of which the second stays empty. Each round assigns every vector to its nearest centroid (ties: the smaller
    number) and replaces centroids with members by the exact floor of their mean. Rounds end early when no centroid changes. No usable
    vector gives no rows. A component of 2**27 / scale or more is an error, since distances would not fit a long. Extra columns, whatever their names, are not read.
    """
    if not 1 <= k <= MOST:
        raise ValueError(f"k must lie between 1 and {MOST}")
    points = staged(points_of(table, dim, scale), "ball-points")
    named = points.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    seeds = [r["v"] for r in named.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()]
    if not seeds:
        return points.select("vec_id", "cluster", *[F.lit(None).cast(t).alias(n) for n, t in (("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    history = [Balls(np.array(seeds, np.int64), None)]
    for done in range(1, rounds + 1):
        old = history[-1].centroids
        found = tallied(points, history)
        new = np.array([[s // found[i][0] for s in found[i][2]] if i in found else old[i].tolist() for i in range(len(old))], np.int64)
        radii = [moved(found[i][1] if i in found else -1, old[i], new[i]) for i in range(len(old))]
        if len(history) > replayed:
            points, history = staged(assigned(points, history).drop("distance"), "ball-points"), []
        history.append(Balls(new, radii))
        if np.array_equal(old, new):
            break
    final = staged(assigned(points, history).drop("v"), "ball-assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].centroids.tolist()]
    rows = [(i, s, sum(inertia.values()), digests[i]) for i, s in inertia.items()]
    told = final.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(read(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The rounds written out one after the other: assignment a0, centroids c1, assignment a1, ..."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, e AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, e, cluster, distance FROM (
          SELECT vec_id, e, cluster, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v, c{r})
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT cluster, i, sum(e[i]) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY cluster, i),
            c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN
              (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster) m USING (cluster))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, CAST(a.cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} USING (cluster)"""


SQL = _sql()
