"""Best vectors of queries over many blocks: the same as over all pairs, and no more copies for more rows."""

import numpy as np
import pytest

from tracewell.operators import blocks, retrieval


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 4)
    monkeypatch.setattr(blocks, "TILE", (5, 7))


def test_nearest_over_many_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)).astype("float32")
    rows = [(i, base[i % 40 if i % 3 else 0].tolist(), None if i % 17 == 0 else f"g{i % 2}", None if i % 5 == 0 else f"p{i % 7}") for i in range(150)]  # many equal vectors
    df = spark.createDataFrame([*rows, (None, [1.0] * 6, "g0", "p0"), (900, [0.0] * 6, "g0", "p0"), (901, None, "g0", "p0"), (902, [1.0] * 5, "g0", "p0")], "vec_id long, embedding array<float>, label string, paper string")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in rows}
    for within, apart in (((), None), (("label",), None), ((), "paper"), (("label",), "paper")):
        want = set()
        for i, _, g, p in rows:
            others = [(-round(float(unit[i] @ unit[j]), 6), j) for j, _, h, q in rows if j != i and (not within or g == h and g) and not (apart and p and p == q)]
            want |= {(i, j, -s, n) for n, (s, j) in enumerate(sorted(others)[:3], 1)}
        assert {(r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in retrieval.nearest(df, df, 3, within, apart).collect()} == want


def test_copies_do_not_grow_with_the_rows(spark, small_blocks):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    for n in (100, 200):
        part = df.where(f"vec_id < {n}")
        found = blocks.best_in_blocks(part, part, 1, lambda q, v: q @ v.T, retrieval.millionths, [])
        assert found.count() == n * blocks.MOST
