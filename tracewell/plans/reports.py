"""Registered queries of corpus facts, reports and orders, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import reports as R
from ..sources.views import CHUNKS, RESULTS, chunks, results, table
from .evidence import BOARD, BOTH, WINS
from .given import given, named
from .kg import GRAPH, edges, nodes

CITING = "SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' (Smith et al., 2020) and (Lee, 2019)' WHEN 1 THEN ' (Lee, 2019)' WHEN 2 THEN ' (Adams and Brown, 2021).' ELSE ' [12]' END) AS text FROM {documents}"
SENTENCES = "SELECT vec_id % 40 AS doc_id, vec_id AS seq, embedding AS vector FROM {embeddings}"
QUOTES = "SELECT o_orderkey AS quote_id, concat('c', o_custkey % 50) AS paper, CAST(o_orderkey * 31 % 1009 AS DOUBLE) / 1009 AS score FROM {orders}"


def fold_results(s, d):
    return results(s, d).withColumn("resolved", F.col("record_id") % 5 != 0).withColumn("grade", F.when(F.col("confidence") == "high", "A").when(F.col("confidence") == "medium", "B").when(F.col("verified"), "C"))


QUERIES = {
    "ag_type_histogram": (lambda s, d: R.histogram(edges(s, d), "type", ("claims", "cites")), f"WITH {GRAPH} SELECT type AS item, count(*) AS n, type IN ('claims', 'cites') AS is_claim FROM edges GROUP BY type"),
    "ag_top_cited": (lambda s, d: R.top_targets(edges(s, d), nodes(s, d), "cites", 10), f"WITH {GRAPH}, c AS (SELECT label, count(*) AS n FROM edges JOIN nodes ON id = dst WHERE edges.type = 'cites' GROUP BY label) SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INT) AS place FROM c QUALIFY place <= 10"),
    "ag_top_authors": (
        lambda s, d: R.top_by_papers(edges(s, d), nodes(s, d), "authored_by", 10, 4, 2),
        f"WITH {GRAPH}, a AS (SELECT label, count(DISTINCT src) AS n, array_to_string(list_sort(list_distinct(list(src)))[:4], ',') AS papers FROM edges JOIN nodes ON id = dst WHERE edges.type = 'authored_by' GROUP BY label) SELECT * FROM a WHERE n >= 2 ORDER BY n DESC, label LIMIT 10",
    ),
    "ag_top_institutions": (
        lambda s, d: R.top_by_papers(edges(s, d), nodes(s, d), "published_from", 12, 6),
        "WITH a AS (SELECT n_name AS label, count(*) AS n, array_to_string(list_sort(list('c' || c_custkey))[:6], ',') AS papers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) SELECT * FROM a ORDER BY n DESC, label LIMIT 12",
    ),
    "ag_corpus_facts": (
        lambda s, d: R.corpus_facts(nodes(s, d), edges(s, d), E.leaderboard(results(s, d)), given(s, d, "SELECT p_name AS name, 1990 + p_size AS year FROM {part}")),
        f"""WITH {BOARD}, {GRAPH}, f AS (SELECT 'most_cited' AS fact, label AS name, count(*)::DOUBLE AS amount FROM edges JOIN nodes ON id = dst WHERE edges.type = 'cites' AND nodes.type = 'paper' GROUP BY id, label UNION ALL SELECT 'most_influential', label, pagerank FROM nodes WHERE type = 'paper' UNION ALL SELECT 'most_compared', label, n_comparisons FROM nodes WHERE n_comparisons > 0
        UNION ALL SELECT 'most_benchmarked', method, count(*) FROM board GROUP BY method UNION ALL SELECT 'newest', p_name, 1990 + p_size FROM part UNION ALL SELECT 'oldest', p_name, -(1990 + p_size) FROM part) SELECT fact, name, abs(amount) AS amount FROM f QUALIFY row_number() OVER (PARTITION BY fact ORDER BY f.amount DESC, name) = 1""",
    ),
    "ag_retrieved": (
        lambda s, d: R.retrieved_analytics(table(s, d, "documents"), {"lang": 0, "source": 3}),
        "WITH c AS (SELECT 'lang' AS facet, lang AS item, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT * FROM (SELECT 'source', source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 3)) SELECT * FROM c WHERE item IS NOT NULL",
    ),
    "ag_author_year": (
        lambda s, d: R.citation_counts(given(s, d, CITING), 20),
        f"SELECT c AS citation, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\([A-Z][a-z]+(?:\\s+(?:et\\s+al\\.|and\\s+[A-Z][a-z]+))?[.,]*\\s*\\d{{4}}\\)')) AS c FROM ({named(CITING)})) GROUP BY c ORDER BY n DESC, c LIMIT 20",
    ),
    "ag_fractions": (lambda s, d: R.fractions(table(s, d, "documents"), "source", "lang"), "SELECT source, lang AS item, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang"),
    "ag_cluster_labels": (
        lambda s, d: R.cluster_labels(table(s, d, "part").withColumn("cluster", F.col("p_size") % 4), "cluster", ("p_brand", "p_type")),
        "WITH c AS (SELECT p_size % 4 AS cluster, 'p_brand' AS \"column\", p_brand AS item, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT p_size % 4, 'p_type', p_type, count(*) FROM part GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY cluster, \"column\" ORDER BY n DESC, item) AS INT) AS place FROM c QUALIFY place <= 3",
    ),
    "ag_majority_cluster": (lambda s, d: R.majority_cluster(table(s, d, "part").withColumn("cluster", F.col("p_size") % 4), "cluster", "p_brand"), "WITH c AS (SELECT p_brand AS item, p_size % 4 AS cluster, count(*) AS n FROM part GROUP BY ALL) SELECT item, cluster, n FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, cluster) = 1"),
    "ag_centroids": (lambda s, d: R.centroids(table(s, d, "part"), "p_brand", "p_size", "p_retailprice"), "SELECT p_brand, count(*) AS n, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY p_brand"),
    "ag_entity_detail": (
        lambda s, d: R.entity_detail(edges(s, d), nodes(s, d), "t:Brand#11"),
        f"WITH {GRAPH}, e AS (SELECT DISTINCT edges.type, CASE WHEN src = 't:Brand#11' THEN dst ELSE src END AS id FROM edges WHERE src = 't:Brand#11' OR dst = 't:Brand#11'), g AS (SELECT e.type AS relation, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM e JOIN nodes USING (id) GROUP BY e.type) SELECT *, row_number() OVER (ORDER BY n DESC, relation) = 1 AS dominant FROM g",
    ),
    "ag_connections": (
        lambda s, d: R.connections(edges(s, d), nodes(s, d), "c4", ("cites", "claims")),
        f"WITH {GRAPH}, e AS (SELECT DISTINCT edges.type AS t, CASE WHEN src = 'c4' THEN dst ELSE src END AS id FROM edges WHERE src = 'c4' OR dst = 'c4'), g AS (SELECT t, string_agg(id, ',' ORDER BY id) AS ids FROM e WHERE id IN (SELECT id FROM nodes) GROUP BY t) SELECT CAST(row_number() OVER (ORDER BY CASE t WHEN 'cites' THEN 0 WHEN 'claims' THEN 1 ELSE 2 END, t) AS INT) AS place, t AS relation, ids FROM g",
    ),
    "ag_predicted_counts": (lambda s, d: R.counts_over(edges(s, d), 0.4), f"WITH {GRAPH} SELECT type, count(*) AS n FROM edges WHERE confidence >= 0.4 GROUP BY type"),
    "ag_node_rollups": (
        lambda s, d: R.node_rollups(edges(s, d), nodes(s, d), ("technique", "author"), 3),
        f"WITH {GRAPH} SELECT id, label, count(DISTINCT src) AS shared_by, coalesce(array_to_string(list_sort(list_distinct(list(src)))[:3], ','), '') AS papers FROM nodes LEFT JOIN edges ON dst = id WHERE nodes.type IN ('technique', 'author') GROUP BY id, label",
    ),
    "ag_relation_weights": (
        lambda s, d: R.relation_weights(edges(s, d), ("cites",)),
        f"WITH {GRAPH}, c AS (SELECT type, count(*) AS n FROM edges WHERE type <> 'cites' GROUP BY type) SELECT type, n, round((1 / ln(1 + n)) / avg(1 / ln(1 + n)) OVER (), 6) AS weight FROM c",
    ),
    "ag_edges_at": (
        lambda s, d: R.edges_at(edges(s, d), nodes(s, d), given(s, d, "SELECT p_brand AS label FROM {part} WHERE p_partkey < 9 UNION SELECT c_name FROM {customer} WHERE c_custkey < 9")),
        f"WITH {GRAPH}, a AS (SELECT p_brand AS label FROM part WHERE p_partkey < 9 UNION SELECT c_name FROM customer WHERE c_custkey < 9), x AS (SELECT id, label FROM nodes JOIN a USING (label)), e AS (SELECT DISTINCT label, src, dst, type FROM x JOIN edges ON src = id OR dst = id) SELECT label AS anchor, count(*) AS n FROM e GROUP BY label",
    ),
    "ag_totals": (
        lambda s, d: R.totals(E.pairwise_wins(results(s, d)), E.leaderboard(results(s, d)), E.cross_validation(results(s, d)), results(s, d).where("confidence = 'low'")),
        f"""WITH {BOTH}, {WINS} SELECT (SELECT count(*) FROM wins) AS n_comparisons, (SELECT count(DISTINCT (metric, dataset, condition)) FROM board) AS n_leaderboards, (SELECT count(*) FROM validated) AS n_validations, (SELECT count(*) FROM validated WHERE grade = 'A') AS n_grade_a,
        (SELECT count(DISTINCT m) FROM (SELECT method AS m FROM board UNION SELECT method FROM validated UNION SELECT winner FROM wins)) AS n_methods, (SELECT count(*) FROM results WHERE confidence = 'low') AS n_quarantined""",
    ),
    "wn_evidence_order": (
        lambda s, d: R.by_strength(fold_results(s, d)),
        f"""WITH {RESULTS}, r AS (SELECT *, record_id % 5 <> 0 AS resolved, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE CASE WHEN verified THEN 2 ELSE 3 END END AS g FROM results)
        SELECT record_id, metric, row_number() OVER (PARTITION BY metric ORDER BY resolved DESC, g, lower(method), record_id, value, condition, paper) AS by_evidence, row_number() OVER (PARTITION BY metric ORDER BY lower(method), lower(metric), record_id, value, condition, paper) AS by_method, row_number() OVER (PARTITION BY metric ORDER BY condition || '|' || paper || '|' || lower(method), record_id, value) AS by_protocol FROM r""",
    ),
    "wn_positions": (lambda s, d: R.positions(chunks(s, d)), f"WITH {CHUNKS} SELECT doc_id, seq, ((200 * (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) + count(*) OVER (PARTITION BY doc_id)) // (2 * count(*) OVER (PARTITION BY doc_id)))::DOUBLE / 100 AS position FROM chunks"),
    "wn_topic_breaks": (
        lambda s, d: R.topic_breaks(given(s, d, SENTENCES).withColumn("vector", F.col("vector").cast("array<double>")), 0.05),
        f"""WITH x AS (SELECT doc_id, seq, CAST(vector AS DOUBLE[]) AS v, lag(CAST(vector AS DOUBLE[])) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM ({named(SENTENCES)}))
        SELECT doc_id, seq, CAST(sum(CASE WHEN b IS NOT NULL AND round(list_cosine_similarity(v, b), 9) < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS segment FROM x""",
    ),
    "wn_candidates": (
        lambda s, d: R.ranked_candidates(given(s, d, "SELECT p_name AS name, concat('c', p_size) AS paper, p_partkey AS place FROM {part}"), given(s, d, "SELECT p_name AS name FROM {part} WHERE p_brand = 'Brand#13'"), given(s, d, "SELECT concat('c', p_size) AS paper FROM {part} WHERE p_size < 10"), ["red", "blue"], "small green ring"),
        """WITH p AS (SELECT p_name AS name, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#13') THEN 4 ELSE 0 END + CASE WHEN p_size IN (SELECT p_size FROM part WHERE p_size < 10) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(p_name, '\\b(red|blue)\\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(p_name, '\\b(small|green|ring)\\b') THEN 1 ELSE 0 END AS points, p_partkey FROM part)
        SELECT name, points, CAST(row_number() OVER (ORDER BY points DESC, p_partkey) AS INT) AS rank FROM p""",
    ),
    "wn_anchors": (
        lambda s, d: R.anchors(given(s, d, "SELECT p_brand AS brand, p_partkey AS id, CAST(p_partkey * 37 % 101 AS DOUBLE) / 150 AS score FROM {part}"), "brand"),
        """WITH p AS (SELECT p_brand AS brand, p_partkey AS id, (p_partkey * 37 % 101)::DOUBLE / 150 AS score FROM part), n AS (SELECT *, count(*) FILTER (score >= 0.5) OVER (PARTITION BY brand) AS k, row_number() OVER (PARTITION BY brand ORDER BY score DESC, id) AS r FROM p)
        SELECT brand, id, score, CAST(r AS INT) AS place FROM n WHERE r <= 4 AND (k < 2 OR score >= 0.5)""",
    ),
    "wn_top_quotes": (
        lambda s, d: R.top_quotes(given(s, d, QUOTES), given(s, d, "SELECT concat('c', c_custkey) AS paper FROM {customer} WHERE c_custkey IN (3, 7)")),
        f"SELECT quote_id, paper, score FROM ({named(QUOTES)}) WHERE paper IN ('c3', 'c7') ORDER BY score DESC, quote_id LIMIT 4",
    ),
    "ml_edge_split": (
        lambda s, d: R.split_edges(edges(s, d)),
        f"""WITH {GRAPH}, o AS (SELECT src, dst, type, count(*) OVER (PARTITION BY type) AS n, row_number() OVER (PARTITION BY type ORDER BY md5('0|' || src || '|' || dst || '|' || type)) - 1 AS i FROM edges)
        SELECT src, dst, type, CASE WHEN n < 5 OR i * 10 < n * 8 THEN 'train' WHEN i * 10 < n * 9 THEN 'valid' ELSE 'test' END AS part FROM o""",
    ),
    "ml_negatives": (
        lambda s, d: R.negatives(edges(s, d), nodes(s, d), 2),
        f"""WITH {GRAPH}, k AS (SELECT id, type AS kind, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS number FROM nodes), z AS (SELECT type AS kind, count(*) AS size FROM nodes GROUP BY type),
        e AS (SELECT src, dst, edges.type, n.type AS kind, size, t, md5('0|' || src || '|' || dst || '|' || edges.type || '|' || t) AS h FROM edges JOIN nodes n ON n.id = dst JOIN z ON z.kind = n.type, (VALUES (1), (2)) v(t))
        SELECT DISTINCT e.src, k.id AS dst, e.type FROM e JOIN k ON k.kind = e.kind AND k.number = CAST('0x' || substr(h, 1, 8) AS BIGINT) % size WHERE e.src <> k.id AND (e.src, k.id, e.type) NOT IN (SELECT (src, dst, type) FROM edges)""",
    ),
    "ml_meta_relations": (
        lambda s, d: R.consolidated(edges(s, d), nodes(s, d), {"problem": "concept", "technique": "concept"}, {"uses_technique": "about", "addresses_problem": "about"}),
        f"""WITH {GRAPH}, c AS (SELECT CASE WHEN a.type IN ('problem', 'technique') THEN 'concept' ELSE a.type END AS source_type, CASE WHEN e.type IN ('uses_technique', 'addresses_problem') THEN 'about' ELSE e.type END AS relation, CASE WHEN b.type IN ('problem', 'technique') THEN 'concept' ELSE b.type END AS target_type, count(*) AS n
        FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY source_type, relation, target_type) - 1 AS INT) AS index FROM c""",
    ),
    "ml_channels": (
        lambda s, d: R.channels(table(s, d, "documents"), "source", "lang", ("en", "de", "fr", "es")).select("source", F.array_join(F.transform("channels", lambda x: F.format_string("%.6f", x)), ",").alias("channels")),
        "SELECT source, concat_ws(',', " + ", ".join(f"printf('%.6f', count(*) FILTER (lang = '{x}') / count(*)::DOUBLE)" for x in ("en", "de", "fr", "es")) + ") AS channels FROM documents GROUP BY source",
    ),
    "ml_weighted_features": (
        lambda s, d: R.weighted_features(given(s, d, "SELECT p_partkey, array(CAST(p_size AS DOUBLE), p_retailprice) AS a, array(CAST(p_size % 3 AS DOUBLE)) AS b, array(CAST(1 AS DOUBLE)) AS c FROM {part}"), "p_partkey", {"a": 4.0, "b": 2.0, "c": 0.0}),
        "SELECT p_partkey, [round(p_size * 2.0::DOUBLE, 6), round(p_retailprice * 2, 6), round((p_size % 3) * sqrt(2.0::DOUBLE), 6)] AS features FROM part",
    ),
    "bm_reproducibility": (
        lambda s, d: R.reproducibility(results(s, d)),
        f"""WITH {RESULTS}, g AS (SELECT method, metric, condition, count(DISTINCT paper) AS n_papers, min(value) AS lo, max(value) AS hi, bool_or(std IS NOT NULL) AS f FROM results GROUP BY ALL), s AS (SELECT *, round((hi - lo) / greatest(abs(hi), 1e-9), 6) AS spread FROM g)
        SELECT method, metric, condition, n_papers, CASE WHEN n_papers >= 2 AND spread <= 0.1 THEN 'reproduced' WHEN n_papers >= 2 THEN 'disputed' WHEN f THEN 'single-full' ELSE 'single-partial' END AS tier, spread FROM s""",
    ),
    "bm_stale_papers": (
        lambda s, d: R.stale_papers(*(given(s, d, f"SELECT c_custkey AS paper FROM {{customer}} WHERE {w}") for w in ("c_custkey % 2 = 0", "c_custkey % 3 <> 0", "c_custkey % 5 <> 0"))),
        "SELECT c_custkey AS paper, 'uncached' AS reason FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, 'removed' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'unpublished' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 = 0",
    ),
}
