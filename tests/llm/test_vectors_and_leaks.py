"""Ball k-means, hard negatives and benchmark decontamination: brute force and awkward rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tracewell.llm import ball_kmeans, decontaminate, hard_negatives
from tracewell.llm.common import read

SF = "/root/testdata/sf0.01"
WIDE = "vec_id long, label int, embedding array<float>, LABEL string, cluster string, v int, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, label, e, "x", "y", 1, 2) for i, label, e in rows], WIDE)


# ball k-means


def lloyd(rows, k=8, rounds=10, scale=1024):
    """vec_id -> (cluster, distance), and the centroids, by comparing everything in Python integers."""
    points = [(i, [math.floor(float(np.float32(x)) * scale) for x in e]) for i, e in rows]
    centroids = [v for _, v in sorted(points, key=lambda p: (hashlib.sha256(f"3:{p[0]}".encode()).hexdigest(), p[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in points:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    return [(i, *nearest(v)[::-1]) for i, v in points], centroids


@pytest.mark.parametrize("replayed", [1, 3, 10])
def test_ball_kmeans_agrees_with_comparing_everything(spark, replayed):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 4))
    rows = [(i, (middles[i % 6] + rng.normal(size=4) * 0.3).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 500)]  # copies
    rows += [(500 + i, np.float32([i % 3, 0, 0, 0]).tolist()) for i in range(60)]  # ties
    want, centroids = lloyd(rows)
    got = ball_kmeans.ball_kmeans(table(spark, [(i, 0, e) for i, e in rows]).repartition(5), dim=4, replayed=replayed).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_balls_skip_what_cannot_win():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-9, 9, (300, 8)) + 1000 * c for c in range(6)])
    centroids = np.array([[1000 * c] * 8 for c in range(6)])
    cluster, low, met = ball_kmeans.Balls(centroids, None).assign(x, None)
    assert met == 6 * len(x)
    radii = [int(low[cluster == i].max()) for i in range(6)]
    again, same, met = ball_kmeans.Balls(centroids, radii).assign(x, cluster)
    assert (again == cluster).all() and (same == low).all() and met == len(x)  # all members are in stable cores


def test_radius_bound_holds_after_a_move():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, a, b = rng.integers(-50, 50, (20, 3)), rng.integers(-50, 50, 3), rng.integers(-50, 50, 3)
        far = int(((x - a) ** 2).sum(axis=1).max())
        assert ((x - b) ** 2).sum(axis=1).max() <= ball_kmeans.moved(far, a, b)


def test_ball_kmeans_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, 2.0]), (None, 0, [1.0, 2.0]), (1, None, [1.0, 2.0]), (2, 0, None), (3, 0, []), (4, 0, [1.0, None]), (5, 0, [nan, 1.0]), (6, 0, [1.0, inf]), (7, 0, [1.0, 2.0, 3.0]), (8, 0, [0.0, 0.0])]
    got = ball_kmeans.ball_kmeans(table(spark, rows), dim=2).collect()
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in got) == [(0, 0), (1, 0), (1, 0), (8, 0)]
    assert len({r["cluster"] for r in got if r["vec_id"] != 8}) == 1  # copies share the smaller number
    empty = ball_kmeans.ball_kmeans(table(spark, rows).where("vec_id = 2"), dim=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="must be below"):
        ball_kmeans.ball_kmeans(table(spark, [(1, 0, [1e9, 0.0])]), dim=2)


# hard negatives


def mine(rows):
    """Every pair compared, in Python integers."""
    kept = [(n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(float(np.float32(x)) * 256) for x in e])
            for n, (i, label, e) in enumerate(rows) if label is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, i, label, q in kept:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0, other) for m, j, other, v in kept if m != n and len(v) == len(q)), key=lambda s: s[:3])
        for best, _, j, _ in [s for s in scored if s[3] == label][:5]:
            fits = [s for s in scored if s[3] != label and 50 * -best <= -100 * s[0] <= 95 * -best][:3]
            out += [(i, j, rank, s[2], -best, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple((x or 0) for x in r) for r in hard_negatives.mined(df).collect())


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_hard_negatives_agree_with_comparing_everything(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "LEAST", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK", 128)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(10, 6))
    rows = [(i, i % 10, (middles[(i * 7) % 10] + spread * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, 1, rows[3][2]) for i in range(900, 1250)]  # copies of one label
    rows += [(i, i % 4, rows[5][2]) for i in range(1250, 1300)]  # and of several
    got = mined(table(spark, rows).repartition(6))
    assert got == mine(rows) and len(got) > 100


def test_blocks_are_routed_and_left_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST", 64)
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [10.0 * f(i % 16 * math.pi / 8) + 0.01 * float(rng.normal()) for f in (math.cos, math.sin)]) for i in range(1600)]
    usable = hard_negatives.staged(hard_negatives.usable(table(spark, rows), 256), "test-usable")
    m = int(max((np.array(r["v"], int) ** 2).sum() for r in usable.collect()))
    found = hard_negatives.tops(usable, m)
    assert set(found) == {2} and len(found[2].tree.starts) > 4
    asked = usable.where("vec_id % 50 = 0").collect()
    q = np.array([r["v"] for r in asked])
    low, _ = found[2].tree.bounds(q, loose=True)
    near = found[2].near(q, np.array([r["label"] for r in asked]), 5)
    assert (low <= near[:, None]).any(axis=1).all() and (low <= near[:, None]).mean() < 0.7


def test_tree_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (500, 5))
    x[100:220] = x[0]
    m = int((x**2).sum(axis=1).max())
    tree = hard_negatives.Tree(hard_negatives.augmented(x, m), m, 16)
    q = rng.integers(-300, 300, (40, 5))
    assert sorted(tree.order.tolist()) == list(range(500))
    d = hard_negatives.reach(q, hard_negatives.augmented(x, m), m)
    assert np.allclose(d**2, (q**2).sum(axis=1)[:, None] + m - 2 * q @ x.T)
    for low, high in (tree.bounds(q), tree.bounds(q, loose=True)):
        for leaf, (s, e) in enumerate(zip(tree.starts, tree.starts[1:], strict=False)):
            of = d[:, tree.order[s:e]]
            assert (low[:, leaf] <= of.min(axis=1)).all() and (high[:, leaf] >= of.max(axis=1)).all()


def test_hard_negatives_awkward_rows(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 1.0]), (50, 1, [1.0, 1.0]), (50, 1, [1.0, 1.0]), (None, 1, [1.0, 0.9]), (None, 2, [0.9, 0.9]), (3, 2, [0.8, 0.9]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, []), (8, 2, [1.0, nan]),
            (9, 2, [1.0, None]), (100, 2, [1.0, 1.0, 1.0]), (11, 2, [-1.0, -1.0]), (150, 5, [0.0, 0.0]), (151, 5, [0.0, 0.0]), (152, 6, [0.0, 0.0])]
    assert mined(table(spark, rows)) == mine(rows)
    assert hard_negatives.mined(table(spark, rows).limit(0)).count() == 0
    assert hard_negatives.mined(table(spark, rows).where("vec_id = 3")).count() == 0


# decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaked(docs, items, window=10):
    """Every window of every item looked for at every word."""
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        ids = sorted(str(f) for f in found if f is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], "doc_id long, text string, TEXT string, digest string, words int"),
        spark.createDataFrame([(i, t, "x", "y", 1) for i, t in items], "item_id long, text string, gram string, hash string, items int"),
    )


def planted():
    rng = random.Random(8)
    some = lambda n, of=60: " ".join(rng.choice([f"w{rng.randrange(of)}", f"É{rng.randrange(of)}", f"W{rng.randrange(of)}"]) for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 9, 10, 11, 40]))) for i in range(40)]
    shared = some(30)
    items += [(100 + i, f"{some(4)} {shared} {some(4)}") for i in range(30)] + [(140, items[5][1]), (5, "again " + items[7][1])]
    items += [(None, some(12)), (150, None), (151, ""), (152, "..."), (153, "a a a a a a a a a a a a"), (154, "one two")]
    docs = [(i, some(rng.randrange(1, 200))) for i in range(60)]
    docs += [(100 + i, f"{some(20)}. {shared.upper()}! {some(rng.randrange(30))}") for i in range(50)]
    docs += [(200 + i, f"{some(5)} {rng.choice(items)[1]} {some(5)} {items[-6][1]}") for i in range(60)]
    docs += [(300, None), (301, ""), (302, "a " * 500), (303, "One, TWO"), (304, "one"), (None, shared), (None, shared), (305, "x" * 70000), (306, " ".join([shared] * 40))]
    docs += [(400 + i, docs[70][1]) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contamination_agrees_with_looking_everywhere(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    docs, items = planted()
    found = decontaminate.contamination(*leak_tables(spark, docs, items))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == leaked(docs, items) and sum(r[5] for r in got) > 100


def test_leaks_name_places_and_items(spark):
    docs, items = planted()
    rows = decontaminate.leaks(*leak_tables(spark, docs[70:71], items)).collect()
    w = words(docs[70][1])
    by_id = {}
    for i, t in items:
        by_id.setdefault(i, []).append(" ".join(words(t)))
    assert rows
    for r in rows:
        assert r["items"] and all(any(" ".join(w[r["start"] : r["start"] + r["length"]]) in t for t in by_id[i]) for i in r["items"])


def test_contamination_of_empty_tables(spark):
    docs, items = leak_tables(spark, *planted())
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    clean = decontaminate.contamination(docs, items.limit(0))
    assert clean.count() == docs.count() and clean.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


@pytest.mark.parametrize("window, k", [(6, 6), (5, 1), (12, 4)])
def test_other_windows(spark, window, k):
    docs, items = planted()
    docs, items = docs[:120], items[:60]
    got = sorted((tuple(r) for r in decontaminate.contamination(*leak_tables(spark, docs, items), window=window, k=k).collect()), key=repr)
    assert got == leaked(docs, items, window)


def test_no_python_in_the_plan_of_decontamination(spark):
    plan = decontaminate.op13_decontaminate(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and read(spark, SF, "benchmark").count() > 0
