"""Rate limits over batches that are out of order, against the sorted events one by one."""

import random
from datetime import datetime, timedelta

from tracewell.streaming import events as S
from tracewell.streaming import ordered as O


def one_by_one(rows, capacity, per_second):
    state, out = {}, {}
    for at, event, user in sorted(rows):
        tokens, last = state.get(user, (capacity, at))
        tokens = min(capacity, tokens + (at - last).total_seconds() * per_second)
        out[event] = tokens >= 1
        state[user] = (tokens - (tokens >= 1), at)
    return out


def test_batches_out_of_order_are_admitted_as_sorted_ones(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=rng.randrange(6 * 3600)), i, rng.choice([1, 1, 1, 2, 3])) for i in range(300)]
    rows += [(rows[i][0], 1000 + i, rows[i][2]) for i in range(0, 300, 25)]  # ties
    batches = {}
    for at, event, user in rows:  # up to two hours late
        batches.setdefault((at + timedelta(seconds=rng.randrange(2 * 3600))).hour, []).append((at, event, user))
    schema = "ts timestamp, event_id long, user_id long"
    folder = str(tmp_path / "in")
    for hour in sorted(batches):
        extra = [(None, 9000 + hour, 1), (start, None, 1), (start + timedelta(hours=hour), 9100, None)]
        spark.createDataFrame(batches[hour] + extra, schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(start + timedelta(days=2), 5000, 9), (start - timedelta(days=2), 5001, 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = [(r["event_id"], r["admitted"]) for r in S.drained(O.in_order(stream, 3.0, 1 / 600, "3 hours"), store=O.ROCKS).collect()]
    assert spark.conf.get(S.STORE, "") != O.ROCKS
    want = one_by_one(rows, 3.0, 1 / 600)
    assert sorted(e for e, _ in got) == sorted(want)  # each once; what came too late, and what still waits, is not there
    assert dict(got) == want
    assert 0 < sum(want.values()) < len(want)
