"""Entries of few records are ordered where they are, large ones are spread; both say the same."""

import random

from tracewell.operators import evidence, ranks


def records(spark):
    rng = random.Random(7)
    rows = [(rng.choice("mn"), rng.choice(["d", None]), "c", rng.choice("xyz"), f"s{rng.randrange(6)}", float(rng.randrange(30)), None if i % 3 else 0.5, i % 2 == 0, "high", i) for i in range(700)]
    return spark.createDataFrame(rows, "metric string, dataset string, condition string, method string, paper string, value double, std double, verified boolean, confidence string, record_id long").selectExpr("*", "metric = 'm' AS higher_is_better")


def test_boards_of_few_and_many_records_agree(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "staged", lambda df, own=ranks.staged: written.append(1) or own(df))
    few = sorted(map(str, evidence.leaderboard(records(spark)).collect()))
    assert not written and len(few) == 12  # nothing is put in ranges
    monkeypatch.setattr(evidence, "FEW", 50)
    assert sorted(map(str, evidence.leaderboard(records(spark)).collect())) == few and written
