"""Predicted links met block by block are those of scored pairs, with no vectors on pairs."""

import numpy as np

from tracewell.operators import blocks, graph


def test_best_links_are_the_top_predictions(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 9)
    monkeypatch.setattr(blocks, "TILE", (3, 5))
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).round(1).tolist(), i % 3 if i % 13 else None) for i in range(90)]
    rows += [(90, [float("nan"), 1.0, 1.0, 1.0], 0), (91, [float("inf"), 1.0, 1.0, 1.0], 0), (92, None, 0), (93, [1.0, None, 1.0, 1.0], 0), (94, [1.0, 2.0], 0), (None, [1.0] * 4, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    known = spark.createDataFrame([(i, j) for i in range(0, 96, 2) for j in range(0, 90, 4)] + [(0, 3), (0, 3), (None, 3), (0, None), (0, 5000)], "src long, dst long")
    relation = [3.0, -1.0, 2.0, 5.0]
    ends = v.select("vec_id", "label").where("vec_id IS NOT NULL")
    pairs = ends.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "src").join(ends.withColumnRenamed("vec_id", "dst"), "label").select("src", "dst")
    # null scores fall to ``least``; pairs that NaN reaches sort first
    want = graph.top_predictions(graph.distmult(pairs, v.withColumnsRenamed({"vec_id": "id", "embedding": "vector"}).where("id IS NOT NULL"), relation), known, 4, 0.5)
    got = graph.best_links(v, v.where("vec_id % 2 = 0"), relation, known, 4, 0.5, ("label",))
    assert got.columns == want.columns
    told = [sorted((r["src"], r["dst"], str(r["score"]), r["rank"]) for r in df.collect()) for df in (got, want)]
    assert told[0] == told[1] and len(told[0]) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "FlatMapGroupsInArrow" in plan
