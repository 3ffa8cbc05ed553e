"""Places, running sums and quantiles agree with sorting everything, and no task gets a whole key."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import browse, evidence, ranks, reports, retrieval


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, float(rng.randrange(40)), None if rng.random() < 0.1 else rng.random()) for i in range(3000)]


@pytest.fixture
def df(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, "k string, id long, v double, w double").repartition(7)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_places_and_running_sums(df, rows):
    got = ranks.numbered(df, ["k"], [F.desc("v"), "id"], "place", "n").collect()
    summed = ranks.running(df, ["k"], ["v", "id"], "id", "upto", "whole").collect()
    for k, own in by_key(rows).items():
        own = sorted(own, key=lambda r: (-r[2], r[1]))
        assert sorted((r["place"], r["id"], r["n"]) for r in got if r["k"] == k) == [(i, r[1], len(own)) for i, r in enumerate(own, 1)]
        own = sorted(own, key=lambda r: (r[2], r[1]))
        assert sorted((r["upto"], r["id"], r["whole"]) for r in summed if r["k"] == k) == sorted(zip(np.cumsum([r[1] for r in own]).tolist(), [r[1] for r in own], [sum(r[1] for r in own)] * len(own), strict=True))
    whole = ranks.numbered(df, [], ["id"]).collect()
    assert sorted((r["place"], r["id"]) for r in whole) == [(i + 1, i) for i in range(3000)]


def test_no_task_numbers_a_whole_key(df):
    placed = ranks.ranged(df, ["k"], ["v", "id"])
    spread = placed.where("k = 'hot'").groupBy("part_of_range").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 1400


def test_quantiles(df, rows):
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], "w", {"low": 0.0, "mid": 0.5, "far": 0.95, "top": 1.0}).collect()}
    for k, own in by_key(rows).items():
        w = [r[3] for r in own if r[3] is not None]
        assert [got[k][n] for n in ("low", "mid", "far", "top")] == pytest.approx([min(w), statistics.median(w), np.quantile(w, 0.95), max(w)])
    assert ranks.medians(df.where("w IS NULL"), ["k"], "w", "m").count() == 0


@pytest.mark.parametrize("use", ["board", "order", "split", "search", "metrics"])
def test_no_plan_orders_a_key_in_one_task(df, use):
    rows = df.select(F.lit("m").alias("metric"), F.lit("c").alias("condition"), F.col("id").cast("string").alias("paper"), F.col("k").alias("method"), F.col("v").alias("value"), F.lit(True).alias("higher_is_better"),
                     F.lit("high").alias("confidence"), F.lit(True).alias("verified"), F.col("id").alias("record_id"), F.lit(True).alias("resolved"), F.lit("A").alias("grade"))
    made = {
        "board": lambda: evidence.leaderboard(rows), "order": lambda: reports.by_strength(rows), "split": lambda: reports.split_edges(df.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("t").alias("type"))),
        "search": lambda: browse.table_search(rows.select("paper", "method"), "paper", ("method",), "1", {}, []), "metrics": lambda: retrieval.ranking_metrics(df.select(F.lit("g").alias("group"), "id", F.col("v").alias("score"), (F.col("id") % 2).alias("label"))),
    }[use]()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile" not in plan
    for line in plan.splitlines():
        if "Window [" in line and use != "board":  # the rank of a board is over the methods of a cell
            assert "part_of_range" in line


def test_ranking_metrics(spark):
    rows = [("g", 1, 0.9, 1), ("g", 2, 0.8, 0), ("g", 3, 0.8, 1), ("g", 4, 0.1, 0), ("none", 5, 0.6, 0)]
    got = {r["group"]: r for r in retrieval.ranking_metrics(spark.createDataFrame(rows, "group string, id long, score double, label int")).collect()}
    assert got["g"]["auc"] == 0.875 and got["g"]["mrr"] == 1.0 and got["g"]["average_precision"] == round((1 + 2 / 3) / 2, 6)
    assert got["g"]["ndcg_at_10"] == pytest.approx((1 + 0.5) / (1 + 1 / np.log2(3)), abs=1e-6)
    assert got["none"]["auc"] is None and got["none"]["ndcg_at_10"] is None


def records(spark, rows):
    names = "record_id long, paper string, method string, metric string, dataset string, condition string, value double, std double, kind string, higher_is_better boolean, is_own boolean, verified boolean, confidence string, caption string"
    return spark.createDataFrame([(i, p, "m", "score", d, c, v, s, kind, True, False, True, "high", text) for i, (p, d, c, v, s, kind, text) in enumerate(rows)], names)


def test_two_datasets_do_not_pool(spark):
    rows = records(spark, [("p", "a", "x", 90.0, None, "rate", None), ("q", "b", "x", 40.0, None, "rate", None)])
    assert evidence.cross_validation(rows).count() == 0
    pooled = evidence.cross_validation(rows.drop("dataset")).collect()  # without the column there is one dataset
    assert [(r["n_papers"], r["status"], r["grade"]) for r in pooled] == [(2, "high_variance", "C")]


@pytest.mark.parametrize("kind, status", [("rate", "high_variance"), ("time", "consistent"), ("count", "consistent"), (None, "consistent"), ("other", "consistent")])
def test_thresholds_are_those_of_the_metrics_type(spark, kind, status):
    rows = records(spark, [("p", None, None, 100.0, None, kind, None), ("q", None, None, 76.0, None, kind, None)])  # cv 0.136
    found, = evidence.cross_validation(rows).collect()
    assert found["status"] == status and found["grade"] == ("A" if status == "consistent" else "C")


def test_copies_are_no_corroboration(spark):
    same = [("p", None, None, 90.0, 1.5, "rate", None), ("q", None, None, 90.0, 1.5, "rate", None)]
    said = [("p", None, None, 90.0, None, "rate", None), ("q", None, None, 91.0, None, "rate", "Results are taken from [4]")]
    for rows, word in ((same, "identical_values_suspected_copy"), (said, "independent")):
        found, = evidence.cross_validation(records(spark, rows)).collect()
        assert (found["grade"], found["corroboration"]) == ("B", word)
    kept, = evidence.cross_validation(records(spark, [(*r[:4], None, *r[5:]) for r in same])).collect()
    assert kept["grade"] == "A"  # without a deviation equal values prove nothing


def test_nearest_cells_of_unequal_conditions(spark):
    cells = spark.createDataFrame([("m", "d", c, 2) for c in ("pile:gsr", "pile", "pile:gsr:extra", None, "packed:gsr", "simulation:gsr")], "metric string, dataset string, condition string, n_methods long")
    boards = cells.select("metric", "dataset", "condition", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("method"))

    def nearest(asked, methods=()):
        return {r["condition"]: (r["matched"], r["differs_by"]) for r in evidence.nearest_cells(cells, boards, "m", asked, methods).collect()}

    assert nearest({"Scene": "pile", "Success criterion": "gsr"}) == {"pile:gsr": (True, []), "pile:gsr:extra": (True, [])}
    assert nearest({"Scene": "sim"}) == {"simulation:gsr": (True, [])}
    far = nearest({"Scene": "real", "Success criterion": "gsr"}, ("x", "y"))
    assert far["pile"] == (False, ["Scene", "Success criterion"]) == far[None] and far["packed:gsr"] == (False, ["Scene"]) and len(far) == 6
    assert nearest({"Scene": "pile"}, ("x", "z")) == {}
