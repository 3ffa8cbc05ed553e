"""Betweenness of graphs that are copied to shares of the sources: no job a level, and the same as by joins."""

import random

import pytest

from tests.test_discovery import brandes
from tracewell.operators import betweenness


def test_a_long_ring_takes_few_jobs(spark):
    edges = [(f"n{i}", f"n{(i + 1) % 60}") for i in range(60)] + [("n0", "n30"), ("n7", "n7"), ("n0", "n30")]
    spark.sparkContext.setJobGroup("ring", "ring")
    got = {r["id"]: r["betweenness"] for r in betweenness.betweenness(spark.createDataFrame(edges, "src string, dst string")).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ring"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = brandes(edges, True)
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-12) for v in want)
    assert jobs < 40  # a level took two jobs at least, and the ring has 59


def test_shares_agree_with_joins(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randrange(150), int(150 * rng.random() ** 3)) for _ in range(400)], "src long, dst long")
    shares, joins = ({r["id"]: r["betweenness"] for r in betweenness.betweenness(edges, largest=most).collect()} for most in (betweenness.LARGEST, 0))
    assert shares.keys() == joins.keys() and all(shares[v] == pytest.approx(joins[v], abs=1e-12) for v in joins)
