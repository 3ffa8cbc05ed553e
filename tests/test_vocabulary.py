"""The vocabulary of words and pairs against plain counts; texts are split once."""

import random
from collections import Counter

import pytest

from tracewell.operators import terms


@pytest.mark.parametrize("frequent", [4096, 3, 0])
@pytest.mark.parametrize("features, least, most", [(7, 2, 0.5), (12, 1, 1.0), (500, 1, 1.0), (1, 3, 0.9)])
def test_pairs_of_frequent_words_are_enough(spark, monkeypatch, frequent, features, least, most):
    monkeypatch.setattr(terms, "FREQUENT", frequent)
    rng = random.Random(features)
    texts = [[f"w{int(40 * rng.random() ** 3)}" for _ in range(rng.randrange(12))] + ["all", "same"] for _ in range(60)] + [[], ["w39", "w39", "w39"]]
    places, held = Counter(), Counter()
    for words in texts:
        own = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        places.update(own)
        held.update(set(own))
    kept = sorted((t for t in places if least <= held[t] <= most * len(texts)), key=lambda t: (-places[t], t))[:features]
    got = terms.vocabulary(spark.createDataFrame([(w,) for w in texts], "words array<string>"), features, least, most).collect()
    assert {(r["term"], r["df"], r["n"]) for r in got} == {(t, held[t], len(texts)) for t in kept}


def test_texts_are_split_once_and_rare_pairs_are_not_listed(spark):
    df = spark.createDataFrame([(i, f"red fox rare{i} red fox") for i in range(20)], "id int, text string")
    weights = terms.term_weights(df, "id", "text", 2)
    assert "regexp_extract_all" not in weights._jdf.queryExecution().toString()
    row = spark.createDataFrame([(["red", "fox", "rare1", "red", "fox"],)], "words array<string>")
    assert row.select(terms.pairs_of(row["words"], ["red", "fox"])).first()[0] == ["red fox", "red fox"]
