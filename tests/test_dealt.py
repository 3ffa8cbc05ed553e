"""Heavy work on small inputs is dealt to tasks, whatever files the input has, and says the same."""

import random

from tracewell.operators import browse, facts, mentions


def is_dealt(made):
    return "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_facts_are_dealt(spark):
    made = facts.facts(spark.createDataFrame([(1, 0, "It achieves 92.5% on YCB."), (2, 0, None), (3, 0, "nothing")], "doc_id long, seq int, text string").coalesce(1))
    assert is_dealt(made) and sorted((r["doc_id"], r["kind"], r["value"]) for r in made.collect()) == [(1, "dataset", "YCB"), (1, "metric", "92.5")]


def test_named_methods_are_dealt(spark):
    asked = spark.createDataFrame([(1, "is Alpha or ring better"), (2, None), (3, "ringed")], "query_id long, query string").coalesce(1)
    made = mentions.named_in(asked, spark.createDataFrame([("Alpha",), ("Ring",)], "method string"))
    assert is_dealt(made) and sorted(map(tuple, made.collect())) == [(1, "Alpha"), (1, "Ring")]


def test_best_chunks_of_equal_words(spark):
    rng = random.Random(2)
    words = ["they", "grasp", "pile", "robot", "scene", "a", "loss"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(5)))) for i in range(90)]
    claims = [(i, " ".join(rng.choices(words, k=4))) for i in range(12)]
    made = browse.best_chunks(spark.createDataFrame(claims, "claim_id long, text string"), spark.createDataFrame(texts[::-1], "chunk_id long, text string").coalesce(1))
    want = set()
    for c, said in claims:
        own = {w for w in said.split() if len(w) >= 4}
        n, chunk = max((len(own & set(t.split())), -i) for i, t in texts)
        if n:
            want.add((c, -chunk, n, round(n / len(own), 6)))
    assert is_dealt(made) and {tuple(r) for r in made.collect()} == want
