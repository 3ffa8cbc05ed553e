"""Registered queries over graphs of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import graph as G
from ..operators.relational import shared_values
from ..sources.views import RESULTS, results, table
from .evidence import WINS


def supply(s, d):
    """Edges supplier -> part by how often a supplier ships a part."""
    return table(s, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight")).withColumn("type", F.lit("ships"))


SUPPLY = "supply AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL)"


def trade(s, d):
    """Weighted edges from supplier nations to customer nations."""
    sup = table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    cust = table(s, d, "customer").select("c_custkey", "c_nationkey")
    lines = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


TRADE = "trade AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
_rounds = ", ".join(
    f"r{i + 1} AS (SELECT n.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce((SELECT sum(r.rank * f.p) FROM r{i} r JOIN flow f ON r.id = f.src WHERE f.dst = n.id), 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM flow)) / c.n) AS rank FROM ids n, c)"
    for i in range(10)
)
RANKS = f"{TRADE}, flow AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM trade), ids AS (SELECT src AS id FROM trade UNION SELECT dst FROM trade), c AS (SELECT count(*) AS n FROM ids), r0 AS (SELECT id, 1.0::DOUBLE / c.n AS rank FROM ids, c), {_rounds}"


def orders_edges(s, d):
    o = table(s, d, "orders")
    return o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("m"), F.month("o_orderdate").cast("string")).alias("dst"), F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("weight"), F.col("o_orderkey").alias("seq"))


def view(s, d):
    nodes = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"))
    edges = table(s, d, "orders").select((F.col("o_custkey") - 1).alias("src"), F.col("o_custkey").alias("dst"), (F.col("o_orderstatus") == "F").alias("observed"), (F.col("o_totalprice") / 500000).alias("confidence"))
    return G.view_filter(nodes, edges, ["MACHINERY", "HOUSEHOLD"], 0.8)


def predicted(s, d):
    v = table(s, d, "embeddings")
    known = v.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 10).alias("dst"))
    return G.best_links(v, v.where("vec_id % 100 = 0"), [10.0] * 64, known, 5, 0.5, ("label",))  # the stated query set


QUERIES = {
    "gr_coupling": (
        lambda s, d: shared_values(supply(s, d), "src", "dst", "src", 0.08),
        f"""WITH {SUPPLY}, z AS (SELECT src, count(*) AS n FROM supply GROUP BY src), c AS (SELECT x.src AS a, y.src AS b, count(*) AS common FROM supply x JOIN supply y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL)
        SELECT a, b, common, round(common / (za.n + zb.n - common), 6) AS jaccard FROM c JOIN z za ON za.src = a JOIN z zb ON zb.src = b WHERE round(common / (za.n + zb.n - common), 6) > 0.08""",
    ),
    "gr_hardware_overlap": (
        lambda s, d: G.two_hop(supply(s, d), "ships", 3),
        f"WITH {SUPPLY} SELECT x.src AS a, y.src AS b, count(*) AS shared FROM supply x JOIN supply y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING count(*) >= 3",
    ),
    "gr_degrees": (
        lambda s, d: G.degrees(supply(s, d)),
        f"WITH {SUPPLY}, e AS (SELECT src AS id, dst AS other, 1 AS o FROM supply UNION ALL SELECT dst, src, 0 FROM supply) SELECT id, count(DISTINCT other) AS degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(1 - o) AS BIGINT) AS in_degree FROM e GROUP BY id",
    ),
    "gr_pagerank": (lambda s, d: G.pagerank(trade(s, d)).select("id", F.round("rank", 8).alias("rank")), f"WITH {RANKS} SELECT id, round(rank, 8) AS rank FROM r10"),
    "gr_collapse_edges": (
        lambda s, d: G.collapse_edges(orders_edges(s, d)),
        "SELECT 'c' || o_custkey AS src, 'm' || month(o_orderdate) AS dst, arg_max(o_orderpriority, o_orderkey) AS type, arg_max(o_totalprice, o_orderkey) AS weight FROM orders GROUP BY ALL",
    ),
    "gr_metapath": (
        lambda s, d: G.metapath(
            table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("mid")),
            table(s, d, "part").select(F.col("p_partkey").alias("mid"), F.col("p_brand").alias("dst")),
        ),
        "SELECT o_custkey AS src, p_brand AS dst, count(*) AS paths FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    ),
    "gr_subgraph": (
        lambda s, d: G.subgraph(trade(s, d), table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))),
        f"WITH {TRADE}, seeds AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 2), kept AS (SELECT id FROM seeds UNION SELECT dst FROM trade WHERE src IN (SELECT id FROM seeds)) SELECT * FROM trade WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)",
    ),
    "ft_graph_view": (
        view,
        """WITH e AS (SELECT o_custkey - 1 AS src, o_custkey AS dst FROM orders WHERE o_orderstatus = 'F' OR o_totalprice / 500000 >= 0.8), n AS (SELECT c_custkey AS id, c_mktsegment AS type FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')),
        k AS (SELECT * FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) SELECT * FROM n WHERE id IN (SELECT src FROM k UNION SELECT dst FROM k)""",
    ),
    "wn_symmetric_pairs": (
        lambda s, d: G.symmetric(trade(s, d).where("src <> dst").select("src", "dst", (F.col("weight") / 1000).alias("score"))),
        f"""WITH {TRADE}, t AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, src, weight / 1000 AS score FROM trade WHERE src <> dst)
        SELECT a, b, max(score) AS score, count(DISTINCT src) = 2 AND round(max(score) - min(score), 9) <= 0.02 AS bidirectional FROM t GROUP BY a, b""",
    ),
    "gr_contradictions": (
        lambda s, d: G.mutual(E.pairwise_wins(results(s, d))),
        f"""WITH {RESULTS}, {WINS}, w AS (SELECT metric, dataset, condition, winner, loser, count(*) AS n, max(margin) AS margin FROM wins GROUP BY ALL)
        SELECT w.*, x.n AS n_back, x.margin AS margin_back FROM w JOIN w x ON w.metric = x.metric AND w.dataset = x.dataset AND w.condition = x.condition AND w.winner = x.loser AND w.loser = x.winner WHERE w.winner < w.loser""",
    ),
    "gr_link_scores": (
        predicted,
        """WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(1 / (1 + exp(-10 * list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.vec_id <> a.vec_id + 10 WHERE a.vec_id % 100 = 0)
        SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p WHERE score >= 0.5 QUALIFY rank <= 5""",
    ),
}
