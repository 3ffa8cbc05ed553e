"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import pytest

from tests.compare import connection, same
from tracewell.plans import registered

SF = "/root/testdata/sf0.001"
QUERIES = registered()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_agrees_with_sql(spark, duck, name):
    query, sql = QUERIES[name]
    same(query(spark, SF), sql, duck)


def test_rate_limit_admits_by_refill(spark):
    rows = QUERIES["st_rate_limit"][0](spark, SF).collect()
    by_id = {r["event_id"]: r["admitted"] for r in rows}
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    state = {}
    for e in events:
        now = e["ts"].timestamp()
        tokens, last = state.get(e["user_id"], (3.0, now))
        tokens = min(3.0, tokens + max(0.0, now - last) / 3600)
        assert by_id[e["event_id"]] == (tokens >= 1)
        state[e["user_id"]] = (tokens - (tokens >= 1), now)
    assert len(by_id) == len(events)


def test_entry_returns_ranked_rows(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)


def test_nearest_takes_the_smallest_ids_of_equal_scores(spark):
    from tracewell.operators.retrieval import nearest

    rows = [(i, [1.0, (201 - i) * 1e-6 if i else 0.0]) for i in range(200, -1, -1)]  # equal after rounding, larger ids first and closer
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    found = nearest(vectors, vectors.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"], r["rank"]) for r in found] == [(i, 1.0, i) for i in range(1, 6)]
