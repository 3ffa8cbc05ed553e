"""Edges by meaning, predictions, overlaps and channels against plain loops."""

import math
import random

import numpy as np
import pytest

from tracewell.operators import links as X


def cosine(a, b):
    return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def test_semantic_edges(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(4, 6))
    rows = [(i, f"p{i % 9}" if i % 11 else None, ["result", "limitation", "other"][i % 3], middle[i % 4] + 0.8 * rng.normal(size=6)) for i in range(120)]
    df = spark.createDataFrame([(i, p, r, v.tolist()) for i, p, r, v in rows], "vec_id long, paper string, role string, embedding array<double>")
    want = {}
    for i, p, r, v in rows:
        others = [(-cosine(v, w), j, s) for j, q, s, w in rows if j != i and (p is None or q != p)]
        for score, j, _ in sorted(others)[:5]:
            if -score >= 0.72:
                want[i, j] = (-score, "similar_to")
        if r in X.LINKABLE:
            for score, j, _ in sorted(o for o in others if o[2] == r)[:3]:
                if -score >= 0.66:
                    want[i, j] = (-score, "same_role")
    got = {(r["src"], r["dst"]): (r["score"], r["relation"]) for r in X.semantic_edges(df).collect()}
    assert got == want and {r for _, r in want.values()} == {"similar_to", "same_role"}


def test_predicted_links(spark):
    rng = random.Random(4)
    kind = {f"n{i}": "paper" if i % 2 else "method" for i in range(20)}
    vectors = {n: [rng.gauss(0, 1) for _ in range(4)] for n in kind if n != "n3"} | {"n5": [0.0] * 4}
    scored = [(a, r, b, round(rng.random(), 3), kind[a], kind[b]) for a in kind for b in kind for r in ("uses", "cites") if rng.random() < 0.7]
    known = {(a, r, b) for a, r, b, *_ in scored if rng.random() < 0.1}

    def like(a, b):
        x, y = vectors.get(a), vectors.get(b)
        if x is None or y is None or not any(x) or not any(y):
            return None
        return round(sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)), 6)

    want = set()
    for a in kind:
        for r in ("uses", "cites"):
            best = sorted((-s, b) for x, q, b, s, *_ in scored if x == a and q == r and b != a and s >= 0.5 and (a, r, b) not in known)[:5]
            for n, (_, b) in enumerate(best, 1):
                if kind[a] != kind[b] or (like(a, b) is not None and like(a, b) >= 0.3):
                    want.add((a, r, b, n))
    got = X.predicted_links(
        spark.createDataFrame(scored, "src string, relation string, dst string, score double, src_type string, dst_type string"), spark.createDataFrame(sorted(known), "src string, relation string, dst string"),
        spark.createDataFrame(sorted(vectors.items()), "id string, vector array<double>"),
    )
    assert {(r["src"], r["relation"], r["dst"], r["rank"]) for r in got.collect()} == want


def cells():
    rng = random.Random(5)
    word = lambda: ", ".join(rng.choice(["red", "blue", "Green", "x", "nan", "grey and blue"]) for _ in range(rng.randrange(3)))
    return [(i, f"k{i % 5}" if i % 13 else None, word() or None, word(), word()) for i in range(60)]


def values(cell):
    import re

    return {p.strip().lower() for p in re.split(r"[,;]|\s+and\s+", cell or "") if p.strip().lower() not in ("nan", "", "-", "n/a", "none") and len(p.strip()) > 1}


def test_cluster_overlap_and_edges(spark):
    rows = cells()
    df = spark.createDataFrame(rows, "id int, cluster string, a string, b string, c string")
    sets = {}
    for _, k, *own in rows:
        if k is not None:
            for n, cell in enumerate(own):
                sets.setdefault((k, n), set()).update(values(cell))
    clusters = sorted({k for k, _ in sets})
    want = {}
    for i, x in enumerate(clusters):
        for y in clusters[i + 1 :]:
            mean = sum(len(sets[x, n] & sets[y, n]) / max(1, len(sets[x, n] | sets[y, n])) for n in range(3)) / 3
            if round(mean, 6) > 0.05:
                want[x, y] = round(mean, 6)
    got = {(r["a"], r["b"]): r["overlap"] for r in X.cluster_overlap(df.where("cluster IS NOT NULL"), "cluster", ("a", "b", "c")).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    edges = {(r["a"], r["b"], r["shared"]) for r in X.cross_cluster_edges(df, "id", "cluster", ("a", "b", "c"), 2).collect()}
    brute = set()
    for i, k, *own in rows:
        for j, q, *other in rows:
            n = sum(bool(values(x) & values(y)) for x, y in zip(own, other, strict=True))
            if i < j and k != q and n >= 2:
                brute.add((i, j, n))
    assert edges == brute and brute


def test_channels_and_augmentation(spark):
    rows = [("p", "result", "theory", 0.5, 3.0, ["grasp"]), ("p", "other", "theory", 0.0, 0.0, None), ("q", None, None, None, None, [])]
    got = {r["paper"]: r["channels"] for r in X.content_channels(spark.createDataFrame(rows, "doc string, role string, content string, cites double, maths double, topics array<string>"), "doc", ("result",), ("theory", "x"), ("cites", "maths"), ("grasp", "plan")).collect()}
    assert got == {"p": [0.5, 1.0, 0.0, 0.25, 1.0, 1.0, 0.0], "q": [0.0] * 7}
    edges = spark.createDataFrame([(f"a{i}", f"b{i}", "t") for i in range(2000)], "src string, dst string, type string")
    kept = X.dropped_edges(edges, 0.3)
    assert 1300 < kept.count() < 1500 and kept.exceptAll(X.dropped_edges(edges, 0.3)).isEmpty() and X.dropped_edges(edges, 0.0).count() == 2000
    masked = X.masked_features(spark.createDataFrame([(1, [1.0] * 200), (2, [2.0] * 200)], "id int, features array<double>"), 0.2).orderBy("id").collect()
    assert [x * 2 for x in masked[0]["features"]] == masked[1]["features"] and 20 < masked[0]["features"].count(0.0) < 60
    lone = X.unmatched(spark.createDataFrame([("m",), ("n",)], "method string"), spark.createDataFrame([("p",), ("q",)], "paper string"), spark.createDataFrame([("m", "q")], "method string, paper string"))
    assert sorted(map(tuple, lone.collect())) == [("method", "n"), ("paper", "p")]
