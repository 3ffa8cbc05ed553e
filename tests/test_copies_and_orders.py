"""Suspected copies and orders of evidence move and write no more than they need."""

from tracewell.operators import evidence, ranks, reports


def test_copies_move_once(spark):
    rows = [("m", "c", "a", 1.0, 0.5), ("m", "c", "b", 1.0, 0.5), ("n", "c", "a", 1.0, 0.5), ("n", "c", "b", 1.0, 0.6), ("o", None, "a", 0.0, 1.0), ("o", None, "b", -0.0, 1.0), ("o", None, "b", 0.0, None), ("p", "c", "a", 1.0, 0.5), ("p", "c", "a", 1.0, 0.5)]
    made = evidence.suspected_copies(spark.createDataFrame([("t", "d", *r) for r in rows], "metric string, dataset string, method string, condition string, paper string, value double, std double"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["method"], r["n_papers"], r["value"]) for r in made.collect()) == [("m", 2, 1.0), ("o", 2, 0.0)]


def test_orders_write_only_what_they_need(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "staged", lambda df, own=ranks.staged: written.append(df.columns) or own(df))
    rows = spark.createDataFrame([(i, "m", "ab"[i % 2], float(i), None, "s", True, "B", "long words") for i in range(9)], "record_id long, metric string, method string, value double, condition string, paper string, resolved boolean, grade string, caption string")
    made = reports.by_strength(rows).collect()
    assert not any("caption" in c for c in written) and sum("grade" in c for c in written) == 1
    assert {r["record_id"]: (r["by_evidence"], r["by_method"]) for r in made}[1] == (6, 6) and len(made) == 9
