"""Registered streaming and incremental queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.versions import Versions
from ..sources.views import table
from ..streaming import events as S
from ..streaming import ordered as O
from .given import given


def salted(s, d, salt):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"), F.when(F.col("lang") == salt, "v2").otherwise("v1").alias("salt"))


def versioned(s, d):
    """Orders as chunks of customers: made, changed and added to, customers deleted, orphans dropped; what the last version holds."""
    t = Versions(s, f"{shared_dir(s)}/tracewell/versions-{uuid.uuid4().hex}", "paper", "chunk", buckets=8)
    orders = given(s, d, "SELECT o_custkey AS paper, o_orderkey AS chunk, o_totalprice AS price FROM {orders}")
    t.apply(orders)
    t.apply(orders.where("chunk % 10 = 3").withColumn("price", F.lit(-1.0)).unionByName(given(s, d, "SELECT c_custkey AS paper, CAST(-1 AS BIGINT) AS chunk, c_acctbal AS price FROM {customer} WHERE c_custkey % 13 = 0")))
    t.apply(deletes=given(s, d, "SELECT c_custkey AS paper FROM {customer} WHERE c_custkey % 7 = 0"))
    t.retain(given(s, d, "SELECT c_custkey AS paper FROM {customer} WHERE c_custkey % 11 <> 0"))
    return t.read()


QUERIES = {
    "st_window_counts": (
        lambda s, d: S.run(lambda e: S.windowed(e, "1 day", "1 day"), s, d, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total")),
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    ),
    "st_sessions": (
        lambda s, d: S.run(lambda e: S.sessions(e, "30 minutes", "1 hour"), s, d, "complete").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest")),
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY ALL)
        SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM c GROUP BY user_id""",
    ),
    "st_rate_limit": (
        lambda s, d: S.run(lambda e: S.rate_limited(e, 3, 1 / 3600), s, d),
        """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, n, t, 3.0::DOUBLE AS tokens FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.t, least(3.0::DOUBLE, r.tokens - CASE WHEN r.tokens >= 1 THEN 1 ELSE 0 END + greatest(0.0::DOUBLE, e.t - r.t) * (1.0::DOUBLE / 3600)) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT event_id, user_id, tokens >= 1 AS admitted FROM r""",
    ),
    "st_rate_limit_in_order": (
        lambda s, d: S.run(lambda e: O.in_order(e, 3.0, 1 / 3600, "2 days"), s, d, store=O.ROCKS),
        """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY),
        r AS (SELECT user_id, event_id, n, t, 3.0::DOUBLE AS tokens FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.t, least(3.0::DOUBLE, r.tokens - CASE WHEN r.tokens >= 1 THEN 1 ELSE 0 END + greatest(0.0::DOUBLE, e.t - r.t) * (1.0::DOUBLE / 3600)) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT event_id, user_id, tokens >= 1 AS admitted FROM r""",
    ),
    "st_versioned_upsert": (
        versioned,
        """SELECT o_custkey AS paper, o_orderkey AS chunk, CASE WHEN o_orderkey % 10 = 3 THEN -1.0::DOUBLE ELSE o_totalprice END AS price FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 UNION ALL SELECT c_custkey, -1, c_acctbal FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0""",
    ),
    "st_dedup": (lambda s, d: S.run(lambda e: S.distinct_events(e, ["user_id", "event_type"], "3650 days"), s, d).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n")), "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS n FROM events GROUP BY event_type"),
    "st_changed_only": (
        lambda s, d: S.changed_only(salted(s, d, "none"), salted(s, d, "fr"), "doc_id", ["content", "salt"]).select("doc_id", "salt"),
        "SELECT doc_id, 'v2' AS salt FROM documents WHERE lang = 'fr'",
    ),
    "st_upsert": (
        lambda s, d: S.upsert(table(s, d, "labels").select("doc_id", "quality"), table(s, d, "documents").where("source = 'src1'").select("doc_id", F.lit(9).alias("quality")), "doc_id"),
        "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1') UNION ALL SELECT doc_id, 9 FROM documents WHERE source = 'src1'",
    ),
}
