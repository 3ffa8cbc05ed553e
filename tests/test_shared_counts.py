"""Counts of shared items agree with counting by hand, and no row of a pair and item moves."""

import random
import re
from collections import Counter
from itertools import combinations

from tracewell.operators import graph, relational


def test_counts_of_shared_items(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, 3, None]), rng.choice([*map(str, range(40)), None])) for _ in range(600)]
    want = Counter()
    for item in (1, 2, 3):
        want.update(combinations(sorted({k for i, k in rows if i == item and k is not None}), 2))
    made = spark.createDataFrame(rows, "item int, key string")
    for block in (7, 512):
        got = relational.shared_counts(made, "item", "key", "n", block=block).collect()
        assert {(r["a"], r["b"]): r["n"] for r in got} == want and len(got) == len(want)


def test_pairs_are_counted_where_they_arise(spark):
    edges = spark.createDataFrame([("s1", "p", "ships"), ("s2", "p", "ships"), ("s3", "q", "ships"), ("s2", "p", "other")], "src string, dst string, type string")
    for made in (graph.two_hop(edges, "ships"), relational.shared_values(edges, "src", "dst", "src", 0.1)):
        assert not re.search(r"hashpartitioning\(a#\d+, b#\d+", made._jdf.queryExecution().executedPlan().toString())
    assert [tuple(r) for r in graph.two_hop(edges, "ships").collect()] == [("s1", "s2", 1)]
