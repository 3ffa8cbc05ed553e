"""Density clusters: single-linkage trees over a neighbour graph, condensed, cut where clusters last longest, noise to its nearest cluster.

Density is read with one neighbour (the distance of two points is then their mutual reachability), clusters hold a fixed share
of their group at least, and so a group's condensed tree has a bounded number of clusters, whatever its size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .ranks import numbered

#: Vectors of a block.
BLOCK = 2048
#: Neighbours that a point's list holds.
NEIGHBOURS = 16
#: Edges of a group that a task merges at once.
HELD = 1_000_000
#: A distance below this counts as this much where it divides.
NIL = 1e-12


def points_of(vectors: DataFrame, id_col: str, vector_col: str, within: tuple[str, ...]) -> DataFrame:
    """(part, id, comp, e, n): usable vectors, their group, themselves as component, and the size of the group; vectors of different lengths never share one."""
    e = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    group = F.to_json(F.struct(F.size(e).alias("_dim"), *[F.col(c) for c in within]), {"ignoreNullFields": "false"})
    rows = vectors.where(fine).select(group.alias("part"), F.col(id_col).cast("long").alias("id"), e.alias("e")).groupBy("part", "id").agg(F.min("e").alias("e"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return staged(rows.join(sizes, "part").select("part", "id", F.col("id").alias("comp"), "e", "n"))


def dealt(points: DataFrame, name: str) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
    rows = points.groupBy("part", block.alias(f"{name}_block")).agg(F.collect_list(F.struct("id", "comp", "e")).alias("own"))
    return rows.select("part", f"{name}_block", *(F.col(f"own.{c}").alias(f"{name}_{c}") for c in ("id", "comp")), F.flatten("own.e").alias(f"{name}_e"))


def closest(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(part, id, other, d2): for each query its k nearest points of its group and of other components than its own, by squared distance, then id.

    Blocks meet blocks in tasks, as many pairs as there are; a task keeps the k nearest of its block. A squared distance is summed
    component after component, so that it is the same in either direction.
    """
    pairs = dealt(queries, "query").join(dealt(points, "other"), "part").repartition("part", "query_block", "other_block")

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, mine = (np.array(batch.column(c)[i].values) for c in ("query_id", "query_comp"))
                own, theirs = (np.array(batch.column(c)[i].values) for c in ("other_id", "other_comp"))
                q = np.array(batch.column("query_e")[i].values).reshape(len(ids), -1)
                by_id = np.argsort(own, kind="stable")
                own, theirs, v = own[by_id], theirs[by_id], np.array(batch.column("other_e")[i].values).reshape(len(own), -1)[by_id].T.copy()
                for at in range(0, len(ids), 256):
                    d = np.zeros((len(ids[at : at + 256]), len(own)))
                    for column, other in zip(q[at : at + 256].T, v, strict=True):
                        d += (column[:, None] - other[None, :]) ** 2
                    apart = mine[at : at + 256, None] != theirs[None, :]
                    best = np.lexsort((np.broadcast_to(np.arange(len(own)), d.shape), d, ~apart), axis=1)[:, :k]
                    row, col = np.repeat(np.arange(len(d)), best.shape[1]), best.ravel()
                    good = apart[row, col]
                    row, col = row[good], col[good]
                    part = pa.array([batch.column("part")[i].as_py()] * len(row), pa.string())
                    yield pa.RecordBatch.from_arrays([part, pa.array(ids[at + row]), pa.array(own[col]), pa.array(d[row, col])], ["part", "id", "other", "d2"])

    found = pairs.mapInArrow(score, "part string, id long, other long, d2 double")
    return found.withColumn("at", F.row_number().over(W.partitionBy("part", "id").orderBy("d2", "other"))).where(F.col("at") <= k).drop("at")


def jumped(up: DataFrame) -> DataFrame:
    """(part, comp, root): pointers followed to their ends, four times as far in each round; every end points to itself."""
    now = staged(up.select("part", "comp", "root"))
    while True:
        once = now.select("part", F.col("comp").alias("root"), F.col("root").alias("next"))
        twice = now.select("part", F.col("comp").alias("next"), F.col("root").alias("far"))
        thrice = now.select("part", F.col("comp").alias("far"), F.col("root").alias("end"))
        step = staged(now.join(once, ["part", "root"]).join(twice, ["part", "next"]).join(thrice, ["part", "far"]).select("part", "comp", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def spanning_tree(points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(part, a, b, d2): each group's minimum spanning tree, of equal distances the edge of the smaller ids first.

    In a round every component takes its shortest edge to another one. It is among the open entries of its points' lists, unless a
    point whose list is used up ended it nearer than that; such points, and no others, ask for their next neighbours outside of
    their component. So the tree is exact with lists of any length; rounds grow with the logarithm of a group.
    """
    near = staged(closest(points, points, k))
    full = near.groupBy("part", "id").agg(F.max("d2").alias("far"), F.count(F.lit(1)).alias("k")).where(F.col("k") == k).drop("k")
    label, chosen = staged(points.select("part", "id", "comp")), []
    while True:
        several = label.select("part", "comp").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("comps")).where("comps > 1").select("part")
        if several.isEmpty():
            return reduce(DataFrame.union, chosen) if chosen else near.select("part", F.col("id").alias("a"), F.col("other").alias("b"), "d2").limit(0)
        others = label.select("part", F.col("id").alias("other"), F.col("comp").alias("other_comp"))

        def shortest(rows):
            lo, hi = F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")
            return rows.groupBy("part", "comp").agg(F.min(F.struct("d2", lo, hi, "other_comp")).alias("e")).select("part", "comp", "e.*")

        open_ = staged(near.join(label, ["part", "id"]).join(others, ["part", "other"]).where("comp <> other_comp"))
        used_up = full.join(label.join(several, "part", "left_semi"), ["part", "id"]).join(open_.select("part", "id"), ["part", "id"], "left_anti")
        asks = used_up.join(shortest(open_).select("part", "comp", "d2"), ["part", "comp"], "left").where("d2 is null or d2 >= far")
        asks = staged(asks.select("part", "id"))
        if not asks.isEmpty():
            current = points.drop("comp").join(label, ["part", "id"])
            fresh = staged(closest(current.join(asks.select("part"), "part", "left_semi"), current.join(asks, ["part", "id"], "left_semi"), k))
            ends = fresh.groupBy("part", "id").agg(F.max("d2").alias("far"), F.count(F.lit(1)).alias("k")).where(F.col("k") == k).drop("k")
            full = staged(full.join(asks, ["part", "id"], "left_anti").unionByName(ends))
            open_ = open_.unionByName(fresh.join(label, ["part", "id"]).join(others, ["part", "other"]))
        best = staged(shortest(open_))
        chosen.append(staged(best.select("part", "a", "b", "d2").distinct()))
        back = best.select("part", F.col("comp").alias("other_comp"), F.col("other_comp").alias("answer"))
        first = (F.col("answer") == F.col("comp")) & (F.col("comp") < F.col("other_comp"))  # of two that chose each other
        roots = jumped(best.join(back, ["part", "other_comp"]).select("part", "comp", F.when(first, F.col("comp")).otherwise(F.col("other_comp")).alias("root")))
        label = staged(label.join(roots, ["part", "comp"], "left").select("part", "id", F.coalesce("root", "comp").alias("comp")))
        near = open_.select("part", "id", "other", "d2")


_MERGED = "part string, comp long, into long, size long, big long, first long, rank long, chain long, d2 double, n_left long, n_right long, big_left long, big_right long"


def merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges of a stretch of a group's order, merged one by one: what became of each component, and the merges that made or enlarged a big one.

    A chain is named by the merge that begins it: one of small components, or of two big ones; a big component goes by its chain.
    """
    part, least = rows["part"].iloc[0], int(rows["least"].iloc[0])
    root, size, big, first, small, out = {}, {}, {}, {}, {}, []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ends = rows.sort_values("rank")
    big_a, big_b = (ends[c].astype("Int64") for c in ("big_a", "big_b"))
    for rank, d2, *both in zip(ends["rank"], ends["d2"], ends["comp_a"], ends["size_a"], big_a, ends["comp_b"], ends["size_b"], big_b, strict=True):
        for x, n, top in (both[:3], both[3:]):
            if x not in root:
                root[x], size[x], big[x] = x, n, None if pd.isna(top) else int(top)
                if n < least:
                    small[x] = [x]
        a, b = sorted((find(both[0]), find(both[3])))
        n = size[a] + size[b]
        if n >= least:
            sides = [big[x] for x in (a, b) if big[x] is not None]
            chain = sides[0] if len(sides) == 1 else rank
            out.append((part, None, None, None, None, None, rank, chain, d2, size[a], size[b], big[a], big[b]))
            for side in (a, b):
                for x in small.pop(side, ()):
                    first[x] = rank
            big[a] = chain
        else:
            more, less = sorted((small.pop(a), small.pop(b)), key=len, reverse=True)
            more.extend(less)
            small[a] = more
        root[b], size[a] = a, n
    out += [(part, x, find(x), size[find(x)], big[find(x)], first.get(x)) + (None,) * 7 for x in root]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _MERGED.split(", ")], dtype=object)


def big_merges(points: DataFrame, tree: DataFrame, parts: int, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """((part, id, first), (part, rank, chain, d2, n_left, n_right, big_left, big_right)): merges into components of a group's least size or more, and the first that each point is in.

    Edges are merged in the order of their lengths, ``held`` of a group at once in a task; between two such stretches points are looked
    up by the component that they have come to, so no task holds a whole group.
    """
    edges = staged(numbered(tree, ["part"], ["d2", "a", "b"], "rank").withColumn("stretch", F.expr(f"(rank - 1) div {held}")))
    stretches = edges.agg(F.coalesce(F.max("stretch"), F.lit(-1))).first()[0] + 1
    none = F.lit(None).cast("long")
    state = points.select("part", "id", F.greatest(F.lit(3), F.expr(f"n div {parts}")).cast("long").alias("least"), F.col("id").alias("comp"), F.lit(1).cast("long").alias("size"), none.alias("big"), none.alias("first"))
    merges = []
    for i in range(stretches):
        rows = edges.where(F.col("stretch") == i)
        for end in "ab":
            rows = rows.join(state.select("part", "least", *(F.col(c).alias(f"{c}_{end}") for c in ("comp", "size", "big")), F.col("id").alias(end)).drop(*(["least"] if end == "b" else [])), ["part", end])
        done = staged(rows.groupBy("part").applyInPandas(merged, _MERGED))
        merges.append(done.where("rank is not null").select("part", "rank", "chain", "d2", "n_left", "n_right", "big_left", "big_right"))
        news = done.where("rank is null").select("part", "comp", "into", F.col("size").alias("to_size"), F.col("big").alias("to_big"), F.col("first").alias("to_first"))
        state = staged(
            state.join(news, ["part", "comp"], "left").select(
                "part", "id", "least", F.coalesce("into", "comp").alias("comp"), F.coalesce("to_size", "size").alias("size"), F.coalesce("to_big", "big").alias("big"), F.coalesce("first", "to_first").alias("first")
            )
        )
    empty = tree.sparkSession.createDataFrame([], "part string, rank long, chain long, d2 double, n_left long, n_right long, big_left long, big_right long")
    return state.select("part", "id", "first"), reduce(DataFrame.unionByName, merges, empty)


def longest_lasting(rows: pd.DataFrame) -> pd.DataFrame:
    """A group's clusters with the chosen one that each lies in: a cluster gives way to those below it where these together last longer. The root is never chosen."""
    below, worth, chosen = {}, {}, set()
    for top, parent, lasts in sorted(zip(rows["top"], rows["parent"], rows["lasts"], strict=True)):  # smaller merges first: children before parents
        if pd.isna(parent):
            continue
        under = sum(worth[c] for c in below.get(top, ()))
        if under <= lasts:
            chosen.add(top)
        worth[top] = max(under, lasts)
        below.setdefault(parent, []).append(top)
    named = {}
    for top, parent in sorted(zip(rows["top"], rows["parent"], strict=True), reverse=True):
        above = named.get(parent)
        named[top] = above if above is not None else top if top in chosen else None
    return pd.DataFrame([(rows["part"].iloc[0], top, name) for top, name in named.items()], columns=["part", "top", "chosen"], dtype=object)


def condensed(merges: DataFrame) -> DataFrame:
    """(part, rank, chosen): for each merge the chosen cluster that its component lies in, or null.

    A cluster is a chain of merges that each enlarge one big component by a small one. It begins where two
    big ones meet and lasts, for each of its points, from there (as 1 / distance) to where the point leaves.
    """
    merges = merges.withColumn("density", 1 / F.greatest(F.sqrt("d2"), F.lit(NIL)))
    sides = F.col("big_left").isNotNull().cast("int") + F.col("big_right").isNotNull().cast("int")
    leaving = F.when(sides == 1, F.when(F.col("big_left").isNull(), F.col("n_left")).otherwise(F.col("n_right"))).otherwise(F.col("n_left") + F.col("n_right"))
    sums = merges.groupBy("part", F.col("chain").alias("top")).agg(F.sum(leaving * F.col("density")).alias("mass"), F.max(F.col("n_left") + F.col("n_right")).alias("size"))
    parents = merges.where(sides == 2).select("part", F.explode(F.array("big_left", "big_right")).alias("top"), F.col("chain").alias("parent"), F.col("density").alias("birth"))
    clusters = sums.join(parents, ["part", "top"], "left").select("part", "top", "parent", (F.col("mass") - F.col("size") * F.coalesce("birth", F.lit(0.0))).alias("lasts"))
    chosen = clusters.groupBy("part").applyInPandas(longest_lasting, "part string, top long, chosen long")  # at most twice ``parts`` rows of a group
    return merges.select("part", "rank", F.col("chain").alias("top")).join(staged(chosen), ["part", "top"]).select("part", "rank", "chosen")


def density_clusters(vectors: DataFrame, within: tuple[str, ...] = (), parts: int = 15, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, held: int = HELD) -> DataFrame:
    """(id, *within, cluster, noise): the density cluster of each usable vector among those with equal ``within`` (null equals null).

    A cluster has at least 3 points and a ``parts``-th of its group, and is named by its smallest id before noise joins it. Noise takes
    the cluster of the nearest point that has one; a group without clusters is one, all noise. Null, empty and
    non-finite vectors and null ids take no part; of rows that repeat an id in a group the least vector counts. Copies lie at no
    distance from each other. Work is quadratic in a group, a pass over blocks for the lists and one for those that must ask again.
    """
    points = points_of(vectors, id_col, vector_col, within)
    first, merges = big_merges(points, staged(spanning_tree(points, k)), parts, held)
    found = first.join(condensed(merges).withColumnRenamed("rank", "first"), ["part", "first"], "left")
    cores = found.where("chosen is not null").groupBy("part", "chosen").agg(F.min("id").alias("cluster"))
    placed = staged(found.join(cores, ["part", "chosen"], "left").select("part", "id", "cluster"))
    known = points.join(placed.where("cluster is not null").select("part", "id"), ["part", "id"], "left_semi")
    lost = points.join(placed.where("cluster is null").select("part", "id"), ["part", "id"], "left_semi")
    nearest = closest(known, lost, 1).select("part", "id", F.col("other").alias("by"))
    nearest = nearest.join(placed.select("part", F.col("id").alias("by"), F.col("cluster").alias("joined")), ["part", "by"]).drop("by")
    alone = points.groupBy("part").agg(F.min("id").alias("all"))
    named = placed.join(nearest, ["part", "id"], "left").join(alone, "part")
    groups = vectors.schema
    columns = [F.from_json("part", ", ".join(f"`{c}` {groups[c].dataType.simpleString()}" for c in within)).getField(c).alias(c) for c in within]
    return named.select(F.col("id").alias(id_col), *columns, F.coalesce("cluster", "joined", "all").alias("cluster"), F.col("cluster").isNull().alias("noise"))
