"""Registered queries that build and ask a knowledge graph over the star schema, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import focus as X
from ..operators import kg as K
from ..operators.focus import Focus
from ..sources.views import CHUNKS, chunks
from .given import given, named

NODES = """SELECT concat('c', c_custkey) AS id, 'paper' AS type, c_name AS label, CAST(2005 + c_custkey % 20 AS INT) AS year, c_acctbal / 1000 AS pagerank, c_nationkey AS n_comparisons FROM {customer}
  UNION ALL SELECT concat('t:', p_brand), 'technique', p_brand, NULL, NULL, NULL FROM (SELECT DISTINCT p_brand FROM {part}) t UNION ALL SELECT concat('s', s_suppkey), 'author', s_name, NULL, NULL, NULL FROM {supplier}
  UNION ALL SELECT concat('n', n_nationkey), 'institution', n_name, NULL, NULL, NULL FROM {nation} UNION ALL SELECT concat('g:', c_mktsegment), 'problem', c_mktsegment, NULL, NULL, NULL FROM (SELECT DISTINCT c_mktsegment FROM {customer}) g
  UNION ALL SELECT concat('x', p_partkey), 'comparison', concat('beats ', p_name), NULL, NULL, NULL FROM {part}"""
EDGES = """SELECT DISTINCT concat('c', o_custkey) AS src, concat('t:', p_brand) AS dst, 'uses_technique' AS type, CAST(o_custkey % 100 AS DOUBLE) / 100 AS confidence FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey WHERE l_linenumber = 1
  UNION ALL SELECT DISTINCT concat('c', o_custkey), concat('s', l_suppkey), 'authored_by', CAST(l_suppkey % 100 AS DOUBLE) / 100 FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderkey % 5 = 0
  UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 'published_from', CAST(c_custkey % 100 AS DOUBLE) / 100 FROM {customer}
  UNION ALL SELECT concat('c', c_custkey), concat('g:', c_mktsegment), 'addresses_problem', CAST(c_custkey % 100 AS DOUBLE) / 100 FROM {customer}
  UNION ALL SELECT DISTINCT concat('c', o_custkey), concat('c', 1 + o_orderkey * 7 % 150), 'cites', CAST(o_orderkey * 7 % 50 AS DOUBLE) / 100 FROM {orders} WHERE o_custkey <> 1 + o_orderkey * 7 % 150
  UNION ALL SELECT concat('c', 1 + p_partkey % 100), concat('x', p_partkey), 'claims', CAST(p_partkey % 100 AS DOUBLE) / 100 FROM {part}"""
GRAPH = f"nodes AS ({named(NODES)}), edges AS ({named(EDGES)})"
TRIPLES = """SELECT o_custkey AS pid, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('c', o_custkey) END AS paper_id, CASE o_orderkey % 7 WHEN 0 THEN 'uses_backbone' WHEN 1 THEN 'uses_loss' WHEN 2 THEN 'trained_on' WHEN 3 THEN 'evaluated_on' WHEN 4 THEN 'uses_hardware' WHEN 5 THEN 'has_limitation' ELSE 'unknown' END AS relation,
  concat('Thing ', CAST(o_orderkey % 40 AS STRING)) AS object, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('quoted ', o_orderpriority) END AS quote FROM {orders}"""
FACTS = """SELECT concat('c', o_custkey) AS paper_id, CASE WHEN o_orderkey % 2 = 0 THEN 'contribution' ELSE 'limitation' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'Not explicitly stated in it' WHEN 2 THEN concat(' A new way of ', CAST(o_orderkey % 30 AS STRING)) WHEN 3 THEN concat('a NEW way of ', CAST(o_orderkey % 30 AS STRING)) ELSE concat('No specific limits ', o_orderstatus) END AS value,
  CASE WHEN o_orderkey % 9 = 0 THEN 'low' ELSE 'high' END AS confidence FROM {orders}"""
PREDICTED = """SELECT concat('c', o_custkey) AS src, concat('c', 1 + o_orderkey % 150) AS dst, CASE o_orderkey % 3 WHEN 0 THEN 'similar_to' WHEN 1 THEN 'outperforms' ELSE 'uses' END AS type, CAST(o_orderkey % 101 AS DOUBLE) / 200 AS confidence FROM {orders} WHERE o_custkey <> 1 + o_orderkey % 150"""
CITED = """SELECT concat('c', o_custkey % 20) AS src, concat('c', o_orderkey % 15) AS dst, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'builds_on' WHEN o_orderkey % 7 = 0 THEN 'differs_from' ELSE 'neutral' END AS sentiment, concat('as in ', CAST(o_orderkey AS STRING)) AS context FROM {orders}"""
WON = """SELECT concat('m', p_partkey) AS winner, concat('m', 1 + p_partkey * 3 % 200) AS loser, p_type AS metric, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS grade FROM {part}"""
OWNED = "SELECT concat('m', p_partkey) AS method, concat('c', 1 + p_partkey % 30) AS paper FROM {part}"
LINKED = """SELECT DISTINCT concat('c', o_custkey) AS src, concat('c', 1 + o_orderkey % 150) AS dst, 'cites' AS type, CASE WHEN o_custkey % 4 = 0 THEN 'background' END AS intent, CASE WHEN o_custkey % 4 = 0 THEN CAST(0.7 AS DOUBLE) END AS intent_conf FROM {orders}"""
INTENTS = """SELECT concat('c', o_custkey) AS src, concat('c', 1 + o_orderkey % 150) AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'result' ELSE 'method' END AS intent, CAST(o_orderkey % 20 AS DOUBLE) / 20 AS conf FROM {orders} WHERE o_orderkey % 3 = 0"""
TITLES = "SELECT concat('c', c_custkey) AS paper, CASE WHEN c_custkey % 2 = 0 THEN concat('Customér ', CAST(c_custkey AS STRING), ': a Study of Things') ELSE concat('A study, ', CAST(c_custkey AS STRING)) END AS title FROM {customer} WHERE c_custkey <= 60"
ENTRIES = "SELECT c_custkey AS entry, CASE c_custkey % 3 WHEN 0 THEN concat('customer ', CAST(c_custkey AS STRING), ' - A STUDY of things') WHEN 1 THEN concat('Customer ', CAST(c_custkey AS STRING), ' a study of') ELSE concat('see also: A Study ', CAST(c_custkey AS STRING), ' (extended)') END AS title FROM {customer} WHERE c_custkey <= 90"
SAID = "SELECT p_partkey AS claim_id, concat('c', 1 + p_size % 30) AS paper, CASE p_partkey % 3 WHEN 0 THEN 'limitation' WHEN 1 THEN 'contribution' ELSE 'comparison' END AS kind, concat('The ', p_name, ' is of ', p_type, ' with ', p_name) AS value FROM {part}"
_FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_MD5 = "substr(md5({0}), 1, 8)"


def nodes(s, d):
    return given(s, d, NODES)


def edges(s, d):
    return given(s, d, EDGES)


def graph_of_facts(s, d):
    papers = given(s, d, "SELECT concat('c', c_custkey) AS paper_id, c_name AS title FROM {customer} WHERE c_custkey % 3 > 0")
    return K.built_graph(papers, given(s, d, FACTS))


_BUILT = f"""facts AS ({named(FACTS)}), papers AS (SELECT 'c' || c_custkey AS paper_id, c_name AS title FROM customer WHERE c_custkey % 3 > 0),
good AS (SELECT 'paper:' || f.paper_id AS src, kind || ':' || {_MD5.format('lower(trim(value))')} AS dst, 'has_' || kind AS type, trim(value) AS label, kind FROM facts f JOIN papers USING (paper_id) WHERE confidence <> 'low' AND length(trim(value)) >= 10 AND NOT regexp_matches(lower(value), 'not explicitly|no specific')),
every AS (SELECT kind || ':' || {_MD5.format('lower(trim(value))')} AS id, kind AS type, min(trim(value)) AS label FROM facts WHERE confidence <> 'low' AND length(trim(value)) >= 10 AND NOT regexp_matches(lower(value), 'not explicitly|no specific') GROUP BY ALL)"""

ASKED = Focus(("paper", "technique", "institution"), ("claims",), 4, ("addresses_problem", "claims"))
_SEEDS = "('c1', 'c2', 'c3', 'c5', 'c8', 'c13')"
FOCUSED = f"""{GRAPH}, e AS (SELECT *, md5(src || '|' || dst || '|' || type) AS seq FROM edges), near AS (SELECT id FROM nodes WHERE id IN {_SEEDS} UNION SELECT n.id FROM e JOIN nodes n ON (src IN {_SEEDS} AND dst = n.id) OR (dst IN {_SEEDS} AND src = n.id) WHERE n.type IN ('paper', 'technique', 'institution')),
base AS (SELECT id FROM near UNION SELECT p.id FROM e JOIN near t ON t.id = e.dst JOIN nodes k ON k.id = t.id AND k.type = 'technique' JOIN nodes p ON p.id = e.src AND p.type = 'paper' UNION SELECT dst FROM e WHERE type = 'cites' AND src IN {_SEEDS} UNION SELECT src FROM e WHERE type = 'cites' AND dst IN {_SEEDS}),
told AS (SELECT src, dst FROM e WHERE type = 'claims' AND src IN {_SEEDS} QUALIFY row_number() OVER (PARTITION BY src ORDER BY seq) <= 4), few AS (SELECT id FROM nodes WHERE id IN {_SEEDS} AND (SELECT count(*) FROM told WHERE src = id) < 4),
shown AS (SELECT id FROM (SELECT id FROM base UNION SELECT dst FROM told UNION SELECT dst FROM e WHERE type = 'addresses_problem' AND src IN (SELECT id FROM few)) WHERE id IN (SELECT id FROM nodes)),
links AS (SELECT src, dst, arg_min(type, seq) AS type FROM e WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown) GROUP BY src, dst), ends AS (SELECT src AS id, dst AS other FROM links UNION SELECT dst, src FROM links)"""


def focused(s, d, part):
    seeds = given(s, d, f"SELECT concat('c', c_custkey) AS id, c_custkey AS place FROM {{customer}} WHERE concat('c', c_custkey) IN {_SEEDS}")  # the papers of an answer
    return X.focused(nodes(s, d), edges(s, d).withColumn("seq", F.md5(F.concat_ws("|", "src", "dst", "type"))), seeds, focus=ASKED)[part]


QUERIES = {
    "gr_focused_nodes": (
        lambda s, d: focused(s, d, 0),
        f"WITH {FOCUSED} SELECT id, CASE WHEN type IN ('comparison', 'problem') THEN 'claim' ELSE type END AS type, type AS subtype, (SELECT count(*) FROM ends WHERE ends.id = nodes.id) AS degree FROM nodes WHERE id IN (SELECT id FROM shown)",
    ),
    "gr_focused_links": (lambda s, d: focused(s, d, 1), f"WITH {FOCUSED} SELECT * FROM links"),
    "gr_papers_using": (lambda s, d: K.papers_using(edges(s, d), nodes(s, d), "brand#1"), f"WITH {GRAPH} SELECT DISTINCT src AS paper, label AS technique FROM edges JOIN nodes ON id = dst WHERE nodes.type = 'technique' AND contains(lower(label), 'brand#1')"),
    "gr_successors": (lambda s, d: K.successors_of(edges(s, d), nodes(s, d), "c7", ("technique", "problem", "comparison")), f"WITH {GRAPH} SELECT DISTINCT nodes.type, id, label FROM edges JOIN nodes ON id = dst WHERE src = 'c7' AND nodes.type IN ('technique', 'problem', 'comparison')"),
    "gr_comparisons_involving": (lambda s, d: K.comparisons_involving(nodes(s, d), edges(s, d), "RED"), f"WITH {GRAPH} SELECT id, label, (SELECT min(src) FROM edges WHERE dst = id) AS paper FROM nodes WHERE type = 'comparison' AND contains(lower(label), 'red')"),
    "gr_problems_addressed": (lambda s, d: K.problems_addressed(edges(s, d), nodes(s, d)), "SELECT c_mktsegment AS problem, count(*) AS n_papers, array_to_string(list_sort(list('c' || c_custkey))[:5], ',') AS papers FROM customer GROUP BY c_mktsegment"),
    "gr_coauthors": (
        lambda s, d: K.pairs_in(edges(s, d).where("type = 'authored_by'"), "src", "dst"),
        f"WITH {GRAPH}, e AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'authored_by') SELECT x.dst AS a, y.dst AS b, count(*) AS weight FROM e x JOIN e y ON x.src = y.src AND x.dst <> y.dst GROUP BY ALL",
    ),
    "gr_works_on": (
        lambda s, d: K.works_on(edges(s, d), ("uses_technique", "addresses_problem")),
        f"WITH {GRAPH} SELECT a.dst AS author, o.dst AS concept, count(DISTINCT a.src) AS n FROM edges a JOIN edges o ON a.src = o.src WHERE a.type = 'authored_by' AND o.type IN ('uses_technique', 'addresses_problem') GROUP BY ALL",
    ),
    "gr_fan_out": (
        lambda s, d: K.fan_out(edges(s, d), nodes(s, d), given(s, d, "SELECT concat('c', c_custkey) AS id FROM {customer} WHERE c_custkey IN (3, 5)")),
        f"WITH {GRAPH} SELECT DISTINCT n.type, n.id, label FROM nodes n JOIN edges e ON (e.src = n.id AND e.dst IN ('c3', 'c5')) OR (e.dst = n.id AND e.src IN ('c3', 'c5')) WHERE n.id NOT IN ('c3', 'c5')",
    ),
    "gr_claim_rails": (
        lambda s, d: K.claim_rails(edges(s, d), nodes(s, d), "c4", {"claims": ("claims",), "compared": ("cites", "uses_technique")}, 5).select("rail", "place", "dst", "label", "confidence"),
        f"WITH {GRAPH}, r AS (SELECT CASE type WHEN 'claims' THEN 'claims' ELSE 'compared' END AS rail, dst, max(confidence) AS confidence FROM edges WHERE src = 'c4' AND type IN ('claims', 'cites', 'uses_technique') GROUP BY ALL) SELECT rail, CAST(row_number() OVER (PARTITION BY rail ORDER BY confidence DESC, dst) AS INT) AS place, dst, label, confidence FROM r JOIN nodes ON id = dst QUALIFY place <= 5",
    ),
    "gr_merged_predictions": (
        lambda s, d: K.merged_predictions(given(s, d, PREDICTED)),
        f"""WITH p AS ({named(PREDICTED)}), b AS (SELECT src, dst, type, confidence, 0 AS t FROM p UNION ALL SELECT dst, src, type, confidence, 1 FROM p WHERE type = 'similar_to'), o AS (SELECT src, dst, type, max(confidence) AS c, count(DISTINCT t) = 2 AS bi FROM b GROUP BY ALL)
        SELECT src AS id, dst AS other, string_agg(type, ',' ORDER BY type) AS relations, max(c) AS confidence, bool_or(bi) AS bidirectional FROM o GROUP BY ALL HAVING max(c) > 0.01""",
    ),
    "gr_extra_neighbours": (
        lambda s, d: K.extra_neighbours(edges(s, d), nodes(s, d), "c4", given(s, d, "SELECT concat('c', c_custkey) AS id FROM {customer} WHERE c_custkey % 2 = 0")),
        f"WITH {GRAPH}, e AS (SELECT DISTINCT CASE WHEN src = 'c4' THEN dst ELSE src END AS id FROM edges WHERE src = 'c4' OR dst = 'c4'), g AS (SELECT type, count(*) AS n, min(id) AS first FROM e JOIN nodes USING (id) WHERE id NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY type) SELECT *, row_number() OVER (ORDER BY n DESC, type) AS place FROM g",
    ),
    "gr_serialised": (
        lambda s, d: K.serialised(edges(s, d).where("src IN ('c4', 'c5') AND type <> 'authored_by'").withColumn("claim", F.col("type") == "claims"), ["c5", "t:Brand#11"], ("cites",)),
        f"""WITH {GRAPH}, r AS (SELECT type = 'claims' AS claim, CASE WHEN src IN ('c5', 't:Brand#11') OR dst IN ('c5', 't:Brand#11') THEN 2 ELSE 0 END + CASE WHEN type = 'cites' THEN 1 ELSE 0 END AS score, concat_ws(' ', src, type, dst) AS line FROM edges WHERE src IN ('c4', 'c5') AND type <> 'authored_by'),
        k AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY score DESC, line) AS place, count(*) FILTER (claim) OVER () AS nc, count(*) FILTER (NOT claim) OVER () AS nt FROM r)
        SELECT CAST(row_number() OVER (ORDER BY place, claim) AS INT) AS line_no, line FROM k WHERE place <= CASE WHEN claim THEN 7 + greatest(0, 11 - nt) ELSE 11 + greatest(0, 7 - nc) END""",
    ),
    "gr_exploded_columns": (
        lambda s, d: K.explode_columns(given(s, d, "SELECT concat('m', p_partkey) AS id, concat(p_type, ', ', p_brand) AS kind, replace(p_name, ' ', ' ; ') AS words FROM {part}"), "id", ("kind", "words")),
        "WITH x AS (SELECT 'm' || p_partkey AS src, 'kind' AS type, unnest([p_type, p_brand]) AS label FROM part UNION ALL SELECT 'm' || p_partkey, 'words', unnest(string_split(p_name, ' ')) FROM part) SELECT DISTINCT src, type || ':' || lower(label) AS dst, type, label FROM x",
    ),
    "gr_verified_triples": (
        lambda s, d: K.verified_edges(given(s, d, TRIPLES), given(s, d, "SELECT concat('c', c_custkey) AS paper_id FROM {customer} WHERE c_custkey % 2 = 0")),
        f"""SELECT 'paper:' || paper_id AS src, CASE relation WHEN 'uses_backbone' THEN 'tech:backbone:' || object WHEN 'uses_loss' THEN 'tech:loss:' || object WHEN 'uses_hardware' THEN 'hw:' || {_MD5.format('object')} WHEN 'has_limitation' THEN 'lim:' || paper_id || ':' || {_MD5.format('object')} ELSE 'dataset:' || lower(object) END AS dst,
        relation AS type, object AS label, CASE relation WHEN 'uses_backbone' THEN 'technique' WHEN 'uses_loss' THEN 'technique' WHEN 'uses_hardware' THEN 'hardware' WHEN 'has_limitation' THEN 'limitation' ELSE 'dataset' END AS kind, quote FROM ({named(TRIPLES)}) WHERE paper_id IS NOT NULL AND pid % 2 = 0 AND quote <> '' AND relation <> 'unknown'""",
    ),
    "gr_build_nodes": (lambda s, d: graph_of_facts(s, d)[0], f"WITH {_BUILT} SELECT 'paper:' || paper_id AS id, 'paper' AS type, title AS label FROM papers UNION ALL SELECT id, type, label FROM every WHERE id IN (SELECT dst FROM good)"),
    "gr_build_edges": (lambda s, d: graph_of_facts(s, d)[1].select("src", "dst", "type"), f"WITH {_BUILT} SELECT DISTINCT src, dst, type FROM good"),
    "gr_chunk_nodes": (
        lambda s, d: K.chunk_nodes(chunks(s, d).withColumn("text", F.concat(F.when(F.col("seq") % 5 == 0, "Figure 2: ").when(F.col("seq") % 5 == 1, "Table ").otherwise(""), F.substring("text", 1, 24)))),
        f"""WITH {CHUNKS}, t AS (SELECT doc_id, seq, CASE seq % 5 WHEN 0 THEN 'Figure 2: ' WHEN 1 THEN 'Table ' ELSE '' END || substr(text, 1, 24) AS x FROM chunks) SELECT 'paper:' || doc_id AS src, 'chunk:' || doc_id || ':' || seq AS dst, 'contains_chunk' AS type FROM t
        UNION ALL SELECT 'paper:' || doc_id, 'figure:' || doc_id || ':' || seq, 'has_figure' FROM t WHERE regexp_matches(x, '^(Fig|Figure)') AND length(x) > 20 UNION ALL SELECT 'paper:' || doc_id, 'table:' || doc_id || ':' || seq, 'has_table' FROM t WHERE regexp_matches(x, '^Table') AND length(x) > 30""",
    ),
    "gr_aggregated_citations": (
        lambda s, d: K.aggregated_citations(given(s, d, CITED)),
        f"""WITH m AS ({named(CITED)}), c AS (SELECT src, dst, sentiment, count(*) AS n FROM m GROUP BY ALL) SELECT src, dst, CAST(sum(n) AS BIGINT) AS mentions, arg_max(sentiment, (n, sentiment)) AS sentiment,
        (SELECT string_agg(context, ' | ' ORDER BY seq) FROM (SELECT * FROM m WHERE m.src = c.src AND m.dst = c.dst ORDER BY seq LIMIT 3)) AS contexts FROM c GROUP BY src, dst""",
    ),
    "gr_attached_terms": (
        lambda s, d: K.weighted_attachments(given(s, d, "SELECT p_brand AS owner, p_name AS term, sum(p_retailprice) AS weight FROM {part} GROUP BY p_brand, p_name"), "owner", "term", "weight", "has_term", 3),
        "WITH t AS (SELECT p_brand AS o, p_name AS t, sum(p_retailprice) AS w FROM part GROUP BY ALL) SELECT o AS src, 'has_term:' || lower(t) AS dst, 'has_term' AS type, round(w, 6) AS weight FROM t QUALIFY row_number() OVER (PARTITION BY o ORDER BY w DESC, t) <= 3",
    ),
    "gr_dataset_edges": (
        lambda s, d: K.dataset_edges(given(s, d, "SELECT concat('c', l_suppkey) AS paper, p_name AS cell FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"), given(s, d, "SELECT concat('c', p_size) AS paper, concat('we test on ', p_name, ', and more') AS text FROM {part}"), given(s, d, "SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS dataset FROM {part} WHERE p_size < 20")),
        """WITH v AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS v FROM part WHERE p_size < 20), x AS (SELECT 'c' || l_suppkey AS p, unnest(string_split(p_name, ' ')) AS w, 0 AS r FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'c' || p_size, unnest(string_split('we test on ' || p_name || ' and more', ' ')), 1 FROM part)
        SELECT p AS src, 'dataset:' || w AS dst, CASE WHEN min(r) = 0 THEN 'table' ELSE 'text' END AS via FROM x WHERE w IN (SELECT v FROM v) GROUP BY ALL""",
    ),
    "jn_derived_edges": (
        lambda s, d: K.derived_edges(given(s, d, WON), given(s, d, OWNED), given(s, d, "SELECT concat('c', p_size) AS src, concat('c', p_partkey) AS dst, CASE WHEN p_size % 2 = 0 THEN 'cites' ELSE 'outperforms_benchmark' END AS type FROM {part}")),
        f"""WITH w AS ({named(WON)}), o AS ({named(OWNED)}) SELECT a.paper AS src, b.paper AS dst, 'outperforms_benchmark' AS type, count(*) AS n, count(DISTINCT metric) AS n_metrics, min(grade) AS grade, arg_min(metric, (grade, metric)) AS metric FROM w JOIN o a ON a.method = winner JOIN o b ON b.method = loser WHERE a.paper <> b.paper GROUP BY ALL
        UNION ALL SELECT 'c' || p_size, 'c' || p_partkey, 'cites', NULL, NULL, NULL, NULL FROM part WHERE p_size % 2 = 0""",
    ),
    "jn_citation_intents": (
        lambda s, d: K.with_intents(given(s, d, LINKED), given(s, d, INTENTS)),
        f"""WITH e AS ({named(LINKED)}), i AS ({named(INTENTS)}), b AS (SELECT src, dst, max(conf) AS conf, arg_max(intent, (conf, intent)) AS intent FROM i GROUP BY ALL), t AS (SELECT e.src, e.dst, type, CASE WHEN b.conf IS NOT NULL AND (intent_conf IS NULL OR b.conf > intent_conf) THEN b.intent ELSE e.intent END AS intent, CASE WHEN b.conf IS NOT NULL AND (intent_conf IS NULL OR b.conf > intent_conf) THEN b.conf ELSE intent_conf END AS intent_conf FROM e LEFT JOIN b ON e.src = b.src AND e.dst = b.dst)
        SELECT * FROM t UNION ALL SELECT src, dst, 'compared_against', intent, intent_conf FROM t WHERE intent = 'result' AND intent_conf >= 0.8""",
    ),
    "jn_refreshed": (
        lambda s, d: K.refreshed(
            given(s, d, "SELECT p_partkey AS record_id, CASE WHEN p_size % 3 = 0 THEN p_name END AS method, p_brand AS method_raw, concat('c', p_size) AS paper, p_size % 4 = 1 AS is_own FROM {part}"),
            given(s, d, "SELECT DISTINCT p_brand AS mention, concat('of ', p_brand) AS method FROM {part} WHERE p_size > 20"), given(s, d, "SELECT DISTINCT concat('c', p_size) AS paper, concat('own ', CAST(p_size AS STRING)) AS method FROM {part} WHERE p_size % 2 = 1"),
        ).select("record_id", "method"),
        "SELECT p_partkey AS record_id, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 4 = 1 THEN 'own ' || p_size WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 20) THEN 'of ' || p_brand END AS method FROM part",
    ),
    "jn_method_papers": (
        lambda s, d: K.method_papers(given(s, d, "SELECT p_name AS method FROM {part}"), given(s, d, "SELECT concat('c', c_custkey) AS paper, CASE WHEN p_size % 2 = 0 THEN concat(' ', upper(p_name), '!') ELSE concat('On ', split_part(p_name, ' ', 1), ' things') END AS title FROM {customer} JOIN {part} ON p_partkey = c_custkey"), given(s, d, "SELECT p_name AS method, 'fixed' AS paper FROM {part} WHERE p_partkey = 9")),
        """WITH m AS (SELECT DISTINCT p_name AS method FROM part), t AS (SELECT 'c' || c_custkey AS paper, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE 'On ' || split_part(p_name, ' ', 1) || ' things' END AS title FROM customer JOIN part ON p_partkey = c_custkey),
        x AS (SELECT p_name AS method, 'fixed' AS paper, 1 AS r, 'override' AS how FROM part WHERE p_partkey = 9 UNION ALL SELECT method, paper, 2, 'slug' FROM m JOIN t ON lower(title) = lower(method) UNION ALL SELECT method, paper, 3, 'words' FROM (SELECT *, list_intersect(string_split(lower(method), ' '), string_split(lower(title), ' ')) AS c FROM m, t) WHERE len(c) >= 2 OR len(list_filter(c, lambda w: length(w) > 3)) > 0)
        SELECT method, paper, how FROM m LEFT JOIN (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY method ORDER BY r, paper) = 1) USING (method)""".replace("SELECT * FROM x QUALIFY", "SELECT method, paper, how FROM x QUALIFY"),
    ),
    "jn_bibliography": (
        lambda s, d: K.matched_titles(given(s, d, ENTRIES), given(s, d, TITLES)),
        f"""WITH e AS (SELECT entry, {_FOLD.format('title')} AS s FROM ({named(ENTRIES)})), t AS (SELECT paper, {_FOLD.format('title')} AS k FROM ({named(TITLES)})),
        m AS (SELECT entry, paper, CASE WHEN s = k THEN 0 ELSE 1 END AS r FROM e JOIN t ON length(k) > 5 AND (s = k OR (length(s) > 10 AND contains(s, k)) OR (length(s) > 20 AND contains(k, s)))) SELECT entry, arg_min(paper, (r, paper)) AS paper FROM m GROUP BY entry""",
    ),
    "gr_claim_conflicts": (
        lambda s, d: K.claim_conflicts(given(s, d, SAID), edges(s, d)),
        f"""WITH {GRAPH}, c AS ({named(SAID)}), t AS (SELECT DISTINCT x.src AS a, y.src AS b FROM edges x JOIN edges y ON x.dst = y.dst AND x.src <> y.src WHERE x.type = 'uses_technique' AND y.type = 'uses_technique'),
        w AS (SELECT claim_id, paper, kind, list_distinct(list_filter(string_split(lower(value), ' '), lambda x: x NOT IN ('the', 'a', 'an', 'is', 'are', 'of', 'in', 'to', 'and', 'for', 'with', 'on'))) AS w FROM c),
        m AS (SELECT a, b, l.claim_id AS limitation, k.claim_id AS claim, len(list_intersect(l.w, k.w)) AS shared FROM w l JOIN t ON t.a = l.paper JOIN w k ON k.paper = t.b WHERE l.kind = 'limitation' AND k.kind IN ('contribution', 'comparison'))
        SELECT a AS paper_a, b AS paper_b, shared, limitation, claim FROM m WHERE shared >= 3 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY shared DESC, limitation, claim) = 1""",
    ),
    "gr_explained_predictions": (
        lambda s, d: K.explained_predictions(given(s, d, PREDICTED), edges(s, d), ("uses_technique", "addresses_problem"), 0.4, 2),
        f"""WITH {GRAPH}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(confidence) AS confidence FROM ({named(PREDICTED)}) WHERE confidence >= 0.4 GROUP BY ALL), n AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('uses_technique', 'addresses_problem'))
        SELECT a, b, confidence, count(y.dst) AS n_shared, coalesce(array_to_string(list_sort(list(y.dst) FILTER (y.dst IS NOT NULL))[:2], ','), '') AS shared FROM p LEFT JOIN n x ON x.src = a LEFT JOIN n y ON y.src = b AND y.dst = x.dst GROUP BY a, b, confidence""",
    ),
    "jn_cell_links": (
        lambda s, d: K.cell_links(given(s, d, "SELECT p_type AS metric, p_brand AS condition, concat('c', p_size) AS paper FROM {part}"), edges(s, d), ("cites",)),
        f"WITH {GRAPH}, e AS (SELECT DISTINCT p_type AS metric, p_brand AS condition, 'c' || p_size AS paper FROM part) SELECT DISTINCT a.metric, a.condition, src, dst, edges.type FROM edges JOIN e a ON a.paper = src JOIN e b ON b.paper = dst AND a.metric = b.metric AND a.condition = b.condition WHERE edges.type = 'cites'",
    ),
    "str_folded": (
        lambda s, d: given(s, d, "SELECT doc_id, substring(text, 1, 200) AS head FROM {documents}").select("doc_id", K.folded(F.col("head")).alias("folded")),
        f"SELECT doc_id, {_FOLD.format('substr(text, 1, 200)')} AS folded FROM documents",
    ),
}
