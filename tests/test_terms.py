"""Term weights on rows without words, with repeated words and with ties."""

import math

from tracewell.operators import terms


def test_weights_of_awkward_rows(spark):
    rows = [(1, "Red-red a RED"), (2, None), (3, ""), (4, "x y z"), (5, "blue the red"), (6, "ünder_1 blue")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in terms.term_weights(df, "id", "text", 4, ("the",)).collect()}
    # places: red 4, blue 2, red red 2, then the first in order of those with one
    df_of = {"red": 2, "blue": 2, "red red": 1, "blue red": 1}
    idf = {t: math.log(7 / (1 + k)) + 1 for t, k in df_of.items()}
    raw = {1: {"red": 3 * idf["red"], "red red": 2 * idf["red red"]}, 5: {"blue": idf["blue"], "red": idf["red"], "blue red": idf["blue red"]}, 6: {"blue": idf["blue"]}}
    want = {(i, t): w / math.sqrt(sum(x * x for x in own.values())) for i, own in raw.items() for t, w in own.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    best = terms.top_terms(terms.term_weights(df, "id", "text", 4, ("the",)), "id", 2).where("id = 5").orderBy("rank").collect()
    assert [r["term"] for r in best] == ["blue red", "blue"]
    assert terms.term_weights(df.where("id > 9"), "id", "text").collect() == []
