"""Density clusters against a sequential version: all pairs sorted, merged one by one, the condensed tree walked from its root."""

import math
import random

import pytest

from tracewell.operators import density


def sequential(points, parts):
    """{id: (cluster, noise)} of {id: vector}."""
    ids = sorted(points)
    least = max(3, len(ids) // parts)

    def dist(a, b):
        total = 0.0
        for x, y in zip(points[a], points[b], strict=True):
            total += (x - y) ** 2
        return total

    edges = sorted((dist(a, b), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    of = {i: ("point", i) for i in ids}
    members = {("point", i): [i] for i in ids}
    tree = {}
    for d, a, b in edges:
        x, y = of[a], of[b]
        if x != y:
            node = ("merge", len(tree))
            tree[node] = (d, x, y)
            members[node] = members[x] + members[y]
            of.update(dict.fromkeys(members[node], node))
    if not tree:
        return {i: (ids[0], True) for i in ids}
    clusters = []  # (parent, birth, {point: density at which it leaves})

    def walk(node, parent, birth):
        number = len(clusters)
        clusters.append([parent, birth, {}])
        while True:
            d, x, y = tree[node]
            rate = 1 / max(math.sqrt(d), density.NIL)
            big = [s for s in (x, y) if len(members[s]) >= least]
            left = [p for s in (x, y) if len(big) != 1 or s not in big for p in members[s]]
            clusters[number][2].update(dict.fromkeys(left, rate))
            if len(big) == 2:
                for s in big:
                    walk(s, number, rate)
            if len(big) != 1:
                return
            node = big[0]

    if len(ids) >= least:
        walk(of[ids[0]], None, 0.0)
    children = {i: [j for j, c in enumerate(clusters) if c[0] == i] for i in range(len(clusters))}

    def best(i):
        under = [best(j) for j in children[i]]
        own = sum(rate - clusters[i][1] for rate in clusters[i][2].values())
        total = sum(u[0] for u in under)
        return (own, [i]) if own >= total and i else (total, [c for u in under for c in u[1]])

    def every(i):
        return list(dict.fromkeys([*clusters[i][2], *(p for j in children[i] for p in every(j))]))

    chosen = best(0)[1] if clusters else []
    named = {p: min(every(c)) for c in chosen for p in every(c)}
    out = {}
    for i in ids:
        near = min(((dist(i, p), p) for p in named), default=None)
        out[i] = (named[i], False) if i in named else (named[near[1]] if near else ids[0], True)
    return out


def blobs(seed, n, centres, spread, stray):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        at = rng.choice(centres)
        out[i * 3 + 1] = [rng.uniform(-9, 9) for _ in at] if rng.random() < stray else [c + rng.gauss(0, spread) for c in at]
    return out


GROUPS = {
    "blobs": blobs(1, 150, [(0.0, 0.0, 0.0), (5.0, 5.0, 5.0), (-6.0, 4.0, 1.0), (5.5, 5.5, 7.0)], 0.4, 0.1),
    "uneven": blobs(2, 120, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.5)], 0.9, 0.25),
    "copies": {i: [float(i % 4), float(i % 3)] for i in range(40)},
    "three": {7: [0.0, 0.0], 8: [1.0, 0.0], 2: [9.0, 9.0]},
    "one": {5: [0.5, 0.5]},
}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(g, i, v) for g, points in GROUPS.items() for i, v in points.items()]
    rows += [(None, i, v) for i, v in GROUPS["uneven"].items()]
    rows += [("blobs", 9001, None), ("blobs", 9002, []), ("blobs", 9003, [1.0, None, 2.0]), ("blobs", 9004, [float("nan"), 0.0, 0.0]), ("blobs", None, [0.0, 0.0, 0.0]), ("three", 7, [0.0, 0.0])]
    return spark.createDataFrame(rows, "label string, vec_id long, embedding array<double>")


@pytest.mark.parametrize(("k", "held"), [(16, 1_000_000), (2, 40)])
def test_clusters_are_those_of_the_sequential_version(spark, vectors, monkeypatch, k, held):
    if k == 2:
        monkeypatch.setattr(density, "BLOCK", 32)
    got = {}
    for r in density.density_clusters(vectors, ("label",), k=k, held=held).collect():
        got.setdefault(r["label"], {})[r["vec_id"]] = (r["cluster"], r["noise"])
    want = {g: sequential(points, 15) for g, points in GROUPS.items()}
    want[None] = want["uneven"]
    for name in want:
        assert got[name] == want[name], name
    assert set(got) == set(want)
    assert len({c for c, _ in got["blobs"].values()}) >= 3


def test_spanning_tree_is_the_least_one(spark, vectors):
    points = density.points_of(vectors.where("label = 'uneven'"), "vec_id", "embedding", ("label",))
    got = sorted((r["d2"], r["a"], r["b"]) for r in density.spanning_tree(points, 3).collect())
    root, want = {i: i for i in GROUPS["uneven"]}, []

    def find(x):
        return x if root[x] == x else find(root[x])

    rows = GROUPS["uneven"]
    for d, a, b in sorted(((rows[a][0] - rows[b][0]) ** 2 + (rows[a][1] - rows[b][1]) ** 2, a, b) for a in rows for b in rows if a < b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((d, a, b))
    assert got == want


def test_no_rows_give_no_clusters(spark, vectors):
    assert density.density_clusters(vectors.where("1 = 0"), ("label",)).collect() == []
