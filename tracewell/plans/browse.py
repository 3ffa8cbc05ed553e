"""Registered queries of a browser of methods, cells, records and chunks, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import chunking as C
from ..operators import evidence as E
from ..operators import retrieval as R
from ..sources.views import CHUNKS, RESULTS, chunks, results, table
from .evidence import BOARD
from .given import given, named

ATTRIBUTES = "SELECT concat('★ ', p_name) AS name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS a, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE p_brand END AS b FROM {part} WHERE p_partkey % 2 = 0"
DESCRIBED = "SELECT concat('m', p_partkey) AS src, concat('c', p_size) AS dst, 'described_in' AS type FROM {part}"
SAID = "SELECT p_partkey AS answer_id, concat('Here it is: [{{\"relation\": \"uses_loss\", \"object\": \"', p_name, '\", \"quote\": \"q\", \"more\": 1}}, {{\"relation\": \"', p_type, '\", \"object\": \"x\", \"quote\": \"y\"}}, {{\"relation\": \"uses_loss\", \"object\": \" \", \"quote\": \"z\"}}] and so on') AS answer FROM {part}"
PAYLOADS = "SELECT p_partkey AS payload_id, concat('[{{\"method\": \"', p_name, '\", \"value_str\": \"', CAST(p_size AS STRING), ' . 5\", \"other\": {{\"a\": 1}}}}, {{\"value\": 2.5}}]') AS payload FROM {part}"
TAGGED = "SELECT p_partkey AS record_id, p_name AS method, CASE WHEN p_size % 2 = 0 THEN 'Latency (ms)' ELSE 'success_rate' END AS metric, CASE p_size % 4 WHEN 0 THEN 'latency:pile' WHEN 1 THEN 'sim:success-rate-k:ycb' WHEN 2 THEN 'inference-time' ELSE NULL END AS condition, CASE WHEN p_size > 9 THEN p_brand END AS grade, p_size % 3 = 0 AS is_own FROM {part}"
ASKED = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'fastest planning time in a pile' WHEN 1 THEN 'best success rate' WHEN 2 THEN 'GPD or a gripper in sim' WHEN 3 THEN 'shortest path length' ELSE p_name END AS query FROM {part}"
KEYWORDS = {"success_rate": ["success rate", "best", "success"], "latency": ["planning time", "fastest", "time"], "path": ["path length", "shortest"]}
CLAIMS = "SELECT p_partkey AS claim_id, concat('they say ', p_name, ' is promo material') AS text FROM {part} WHERE p_partkey <= 60"
HAY = "SELECT p_partkey AS chunk_id, concat(p_name, ' and ', p_type, ' material of them') AS text FROM {part}"
CITES = "SELECT p_partkey, concat(CASE p_size % 3 WHEN 0 THEN 'J. K. Müller, A. Bee, ' WHEN 1 THEN 'O''Neil, P., ' ELSE '' END, CASE WHEN p_size % 4 = 0 THEN 'no title' ELSE concat('\"On ', p_name, ',\"') END, ' in Things, 2020') AS citation FROM {part}"
PAIRS = "SELECT p_partkey AS paper, p_name AS winner, p_brand AS loser, CASE p_size % 3 WHEN 0 THEN 'SR Packed  Scene' WHEN 1 THEN 'SR pile' ELSE 'SR' END AS metric, p_retailprice AS winner_value, p_retailprice - 1 AS loser_value FROM {part}"
_BARE = "lower(trim(regexp_replace({0}, '^[^\\p{{L}}\\p{{N}}]+', '')))"
SPACED = "SELECT doc_id, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM {documents}"
SECTIONED = "SELECT doc_id, seq, text, CAST(floor(seq / 3) AS INT) AS section FROM {rows}"


def tagged(s, d):
    return B.tags(given(s, d, TAGGED))


_TAGS = f"""t AS ({named(TAGGED)}), k AS (SELECT record_id, metric, unnest(string_split(condition, ':')) AS token FROM t WHERE condition IS NOT NULL),
tags AS (SELECT record_id, 'Method' AS category, method AS value FROM t UNION SELECT record_id, 'Metric', metric FROM t UNION SELECT record_id, 'Evidence grade', grade FROM t WHERE grade IS NOT NULL UNION SELECT record_id, 'Reported by', CASE WHEN is_own THEN 'self' ELSE 'third-party' END FROM t
UNION SELECT record_id, CASE WHEN token IN ('pile', 'sim') THEN 'Scene' WHEN token = 'ycb' THEN 'Object set' ELSE 'Measurement scope' END, token FROM k WHERE NOT (token = 'latency' AND metric LIKE 'Latency%'))"""

QUERIES = {
    "ft_table_search": (
        lambda s, d: B.table_search(table(s, d, "part"), "p_name", ("p_brand", "p_type"), "RED", {"p_type": "promo"}, ["red ring", "cold red"]).select("p_partkey", "p_name", "place"),
        "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name IN ('red ring', 'cold red') DESC, lower(p_name), p_name, p_partkey) AS place FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND lower(p_type) = 'promo'",
    ),
    "ft_record_search": (
        lambda s, d: B.record_search(results(s, d), ("method", "metric", "paper"), "brand#1", results(s, d).where("value > 49").select("method")).select("record_id", "method"),
        f"WITH {RESULTS} SELECT record_id, method FROM results WHERE contains(lower(method || ' ' || metric || ' ' || paper), 'brand#1') AND method IN (SELECT method FROM results WHERE value > 49)",
    ),
    "ft_legend": (lambda s, d: B.legend_filter(given(s, d, "SELECT p_partkey, concat(p_type, ' , ', p_brand) AS v FROM {part}"), "v", "Brand#11").select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'"),
    "ft_evidence": (
        lambda s, d: B.evidence_filter(given(s, d, "SELECT p_partkey, p_type AS role, p_brand AS content, p_size AS paper FROM {part}"), "PROMO", None, given(s, d, "SELECT p_size AS paper FROM {part} WHERE p_type = 'PROMO' AND p_size < 20")).select("p_partkey"),
        "SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size < 20",
    ),
    "ft_cells": (
        lambda s, d: B.filter_cells(results(s, d).select("metric", "condition").distinct(), results(s, d).where("value > 45").select("metric", "condition", "method"), given(s, d, "SELECT DISTINCT p_brand AS method, CASE WHEN p_brand < 'Brand#2' THEN 'Low' ELSE 'High' END AS level, p_brand AS b FROM {part}"), {"condition": "a:f"}, {"level": "low", "b": "brand#13"}),
        f"WITH {RESULTS} SELECT DISTINCT metric, condition FROM results WHERE condition = 'a:f' AND value > 45 AND method = 'Brand#13'",
    ),
    "jn_method_attributes": (
        lambda s, d: B.method_attributes(given(s, d, "SELECT p_partkey, upper(p_name) AS method FROM {part}"), given(s, d, ATTRIBUTES), {"kind": ("a", "b")}),
        f"""WITH m AS ({named(ATTRIBUTES)}), k AS (SELECT {_BARE.format('name')} AS n, min(a) AS a, min(b) AS b FROM m GROUP BY ALL) SELECT p_partkey, upper(p_name) AS method, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), 'not reported') AS kind FROM part LEFT JOIN k ON n = lower(p_name)""",
    ),
    "jn_paper_of_method": (
        lambda s, d: B.paper_of_method(given(s, d, "SELECT p_name AS method FROM {part} WHERE p_size < 25"), given(s, d, "SELECT concat('m', p_partkey) AS id, 'method' AS type, p_name AS label FROM {part}"), given(s, d, DESCRIBED)),
        "SELECT p_name AS method, min('c' || p_size) AS paper FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size < 25) GROUP BY p_name",
    ),
    "wn_summaries": (
        lambda s, d: B.summaries(given(s, d, "SELECT concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name, p_partkey AS place, p_type, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE ' ' END AS p_brand FROM {part}"), ["cold anvil 50", "no such"], {"p_type": "t", "p_brand": "b"}, 12),
        """SELECT CAST(row_number() OVER (ORDER BY CASE WHEN p_name || ' ' || p_partkey = 'cold anvil 50' THEN 1 ELSE 3 END, p_partkey) AS INT) AS place, p_name || ' ' || p_partkey AS name, 't=' || p_type || CASE WHEN p_size % 2 = 0 THEN '; b=' || p_brand ELSE '' END AS summary FROM part QUALIFY place <= 12""",
    ),
    "tx_best_chunks": (
        lambda s, d: B.best_chunks(given(s, d, CLAIMS), given(s, d, HAY)),
        f"""WITH c AS (SELECT claim_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}'))) AS w FROM ({named(CLAIMS)})), h AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}'))) AS w FROM ({named(HAY)})), n AS (SELECT claim_id, count(*) AS n FROM c GROUP BY claim_id),
        m AS (SELECT claim_id, chunk_id, count(*) AS shared FROM c JOIN h USING (w) GROUP BY ALL) SELECT claim_id, chunk_id, shared, round(shared / n::DOUBLE, 6) AS support FROM m JOIN n USING (claim_id) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY shared DESC, chunk_id) = 1""",
    ),
    "str_parsed_triples": (lambda s, d: B.parsed_triples(given(s, d, SAID), ("uses_loss", "PROMO")), "SELECT p_partkey AS answer_id, 0 AS i, 'uses_loss' AS relation, p_name AS object, 'q' AS quote FROM part UNION ALL SELECT p_partkey, 1, 'PROMO', 'x', 'y' FROM part WHERE p_type = 'PROMO'"),
    "src_json_records": (
        lambda s, d: B.records_of_json(given(s, d, PAYLOADS), "method: string, value_str: string, value: double"),
        "SELECT p_partkey AS payload_id, p_name AS method, p_size || '.5' AS value_str, NULL::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, NULL, NULL, 2.5 FROM part",
    ),
    "src_comparison_records": (
        lambda s, d: B.records_of_comparisons(results(s, d).withColumn("grade", F.when(F.col("confidence") == "high", "A").when(F.col("confidence") == "medium", "B").otherwise("C"))),
        f"WITH {RESULTS} SELECT record_id, method, metric, condition, value, confidence <> 'low' AS verified, 'medium' AS confidence, NULL::DOUBLE AS std FROM results",
    ),
    "src_pair_records": (
        lambda s, d: B.records_of_pairs(given(s, d, PAIRS)),
        f"""WITH p AS (SELECT *, CASE WHEN metric = 'SR' THEN NULL WHEN metric = 'SR pile' THEN 'pile' ELSE 'packed:scene' END AS c FROM ({named(PAIRS)})) SELECT DISTINCT paper, method, 'success rate' AS metric, c AS condition, value FROM (SELECT paper, winner AS method, c, winner_value AS value FROM p UNION ALL SELECT paper, loser, c, loser_value FROM p)""",
    ),
    "bm_verified_values": (
        lambda s, d: B.verified_values(given(s, d, "SELECT p_partkey AS record_id, p_size AS table_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(CAST(p_size AS STRING), ' . 5') END AS value_str FROM {part}"), given(s, d, "SELECT DISTINCT p_size AS table_id, concat('row ', CAST(p_size AS STRING), '.5 and') AS crop_text FROM {part} WHERE p_size < 30")),
        "SELECT p_partkey AS record_id, p_size AS table_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_size || ' . 5' END AS value_str, p_size < 30 AND p_partkey % 5 <> 0 AS verified, CASE WHEN p_size < 30 AND p_partkey % 5 <> 0 THEN 'high' ELSE 'low' END AS confidence FROM part",
    ),
    "bm_tags": (tagged, f"WITH {_TAGS} SELECT * FROM tags"),
    "ft_tags": (
        lambda s, d: B.filter_by_tags(tagged(s, d), {"Scene": ["pile", "sim"], "Reported by": ["self"]}),
        "SELECT p_partkey AS record_id FROM part WHERE p_size % 4 IN (0, 1) AND p_size % 3 = 0",
    ),
    "str_facets": (
        lambda s, d: given(s, d, TAGGED).select("record_id", B.facets(F.concat(F.col("condition"), F.lit(":real:x:Simulation"))).alias("f")).select("record_id", *[F.element_at("f", k).alias(k.lower().replace(" ", "_")) for k in ("Scene", "Object set", "rest")]),
        "SELECT p_partkey AS record_id, CASE p_size % 4 WHEN 0 THEN 'pile' WHEN 1 THEN 'sim' WHEN 2 THEN 'real' END AS scene, CASE WHEN p_size % 4 = 1 THEN 'ycb' END AS object_set, CASE p_size % 4 WHEN 0 THEN 'latency:x' WHEN 1 THEN 'success-rate-k:x' WHEN 2 THEN 'inference-time:x' END AS rest FROM part",
    ),
    "str_canonical_names": (
        lambda s, d: given(s, d, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' Cross Entropy' WHEN 1 THEN 'focal-loss' WHEN 2 THEN 'u-net' ELSE replace(p_name, ' ', '_-') END AS name FROM {part}").select("p_partkey", B.canonical(F.col("name"), {"cross-entropy": "Cross-Entropy", "focal loss": "Focal Loss", "u-net": "U-Net"}).alias("name"), B.contained_alias(F.concat("name", F.lit(" it. More")), {"loss": "a loss"}).alias("other")),
        "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Cross-Entropy' WHEN 1 THEN 'Focal Loss' WHEN 2 THEN 'U-Net' ELSE upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) END AS name, CASE p_size % 4 WHEN 0 THEN 'Cross Entropy it' WHEN 1 THEN 'a loss' WHEN 2 THEN 'u-net it' ELSE replace(p_name, ' ', '_-') || ' it' END AS other FROM part",
    ),
    "str_expanded_terms": (
        lambda s, d: given(s, d, ASKED).select("p_partkey", F.array_join(B.expanded_terms(F.col("query"), {"GPD": "grasp pose detection"}), " ").alias("terms")).where("p_partkey IS NOT NULL"),
        """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'a clutter cluttered fast fastest in latency pile piled plan planner planning runtime speed time' WHEN 1 THEN 'accuracy best precision rate success' WHEN 2 THEN 'a detection end-effector gpd grasp gripper hand in or pose sim simulated simulation' WHEN 3 THEN 'length path shortest' ELSE array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') END AS terms FROM part""",
    ),
    "str_routed_metrics": (lambda s, d: given(s, d, ASKED).select("p_partkey", B.routed_metric(F.col("query"), KEYWORDS).alias("metric")), "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'latency' WHEN 1 THEN 'success_rate' WHEN 3 THEN 'path' END AS metric FROM part"),
    "bm_board_lines": (
        lambda s, d: B.board_lines(E.leaderboard(results(s, d)), "PROMO", "n:o"),
        f"""WITH {BOARD}, b AS (SELECT * FROM board WHERE metric = 'PROMO' AND rank <= 6), c AS (SELECT dataset, condition FROM b GROUP BY dataset, condition ORDER BY condition <> 'n:o', count(*) DESC, condition, dataset LIMIT 2)
        SELECT metric, dataset, condition, rank || '. ' || method || ' ' || printf('%.2f', value) || ' ' || grade AS line FROM b WHERE (dataset, condition) IN (SELECT (dataset, condition) FROM c)""",
    ),
    "snk_manifest": (
        lambda s, d: B.manifest(given(s, d, "SELECT c_custkey AS paper, md5(c_name) AS sha FROM {customer}"), given(s, d, "SELECT c_custkey AS paper, 'cache' AS source FROM {customer} WHERE c_custkey % 2 = 0")),
        "SELECT c_custkey AS paper, substr(md5(c_name), 1, 12) AS digest, CASE WHEN c_custkey % 2 = 0 THEN 'cache' ELSE 'unknown' END AS source FROM customer",
    ),
    "tx_found_facts": (
        lambda s, d: B.found_facts(given(s, d, "SELECT p_size AS doc_id, p_partkey AS seq, concat('it has ', CAST(p_size % 7 AS STRING), '.5% success, ', p_type, 'Net and L', CAST(p_partkey % 3 AS STRING), ' loss') AS text FROM {part}"), {"metric": r"\d+(?:\.\d+)?%", "architecture": r"[A-Z]+Net\b", "loss": r"L\d loss"}, 10, {"architecture": 2}),
        """WITH h AS (SELECT p_size AS doc_id, p_partkey AS seq, 'it has ' || (p_size % 7) || '.5% success, ' || p_type || 'Net and L' || (p_partkey % 3) || ' loss' AS text, p_type || 'Net' AS a, (p_size % 7) || '.5%' AS m, 'L' || (p_partkey % 3) || ' loss' AS l FROM part),
        x AS (SELECT doc_id, seq, text, 'metric' AS kind, m AS value FROM h UNION ALL SELECT doc_id, seq, text, 'architecture', a FROM h UNION ALL SELECT doc_id, seq, text, 'loss', l FROM h), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, kind, lower(value) ORDER BY seq) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY seq) AS i, strpos(text, value) AS pos FROM f) SELECT doc_id, kind, value, substr(text, greatest(1, pos - 10), pos - greatest(1, pos - 10) + length(value) + 10) AS context FROM r WHERE kind <> 'architecture' OR i <= 2""",
    ),
    "str_derived_features": (
        lambda s, d: B.derived_features(table(s, d, "part").select("p_partkey", "p_type"), {"era": (("new", "promo|eco"), ("old", "std|standard")), "size": (("small", "^SMALL$"),)}, "p_type").drop("p_type"),
        "SELECT p_partkey, CASE WHEN contains(p_type, 'PROMO') OR contains(p_type, 'ECO') THEN 'new' WHEN contains(p_type, 'STD') OR contains(p_type, 'STANDARD') THEN 'old' ELSE 'Other' END AS era, CASE WHEN p_type = 'SMALL' THEN 'small' ELSE 'Other' END AS size FROM part",
    ),
    "tx_highlights": (
        lambda s, d: B.highlighted(table(s, d, "documents"), given(s, d, "SELECT 'Thened' AS term, CAST(2.5 AS DOUBLE) AS idf UNION ALL SELECT 'that', 3.0 UNION ALL SELECT 'the', 9.0 UNION ALL SELECT 'with', 1.0")),
        "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9-]+')) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM w WHERE term IN ('thened', 'that') GROUP BY ALL",
    ),
    "str_title_parts": (
        lambda s, d: given(s, d, CITES).select("p_partkey", B.title_parts(F.col("citation"))[0].alias("title"), B.title_parts(F.col("citation"))[1].alias("surname")),
        "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'On ' || p_name END AS title, CASE p_size % 3 WHEN 0 THEN 'Müller' WHEN 1 THEN 'O''Neil' ELSE CASE WHEN p_size % 4 = 0 THEN 'Things' END END AS surname FROM part",
    ),
    "tx_tail_overlap": (
        lambda s, d: B.tail_overlap(given(s, d, SECTIONED, rows=chunks(s, d))),
        f"""WITH RECURSIVE {CHUNKS}, q AS (SELECT doc_id, seq, text, CAST(floor(seq / 3) AS INT) AS section, lag(text) OVER w AS b, CAST(floor(lag(seq) OVER w / 3) AS INT) AS sb FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
        p AS (SELECT *, list_reverse(string_split(regexp_replace(b, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s, CAST(floor(len(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> '')) * 0.15::DOUBLE) AS INT) AS room FROM q),
        f AS (SELECT doc_id, seq, 0 AS i, '' AS kept, 0 AS n FROM p WHERE b IS NOT NULL UNION ALL SELECT f.doc_id, f.seq, f.i + 1, CASE WHEN f.kept = '' THEN trim(s[f.i + 1]) ELSE trim(s[f.i + 1]) || ' ' || f.kept END, f.n + len(list_filter(regexp_split_to_array(s[f.i + 1], '\\s+'), lambda w: w <> '')) FROM f JOIN p ON p.doc_id = f.doc_id AND p.seq = f.seq WHERE f.i < len(s) AND f.n + len(list_filter(regexp_split_to_array(s[f.i + 1], '\\s+'), lambda w: w <> '')) <= room),
        g AS (SELECT doc_id, seq, arg_max(kept, i) AS kept FROM f GROUP BY ALL) SELECT doc_id, seq, CASE WHEN section = sb AND room >= 10 AND coalesce(kept, '') <> '' THEN kept || ' ' || text ELSE text END AS text, coalesce(section = sb AND room >= 10 AND coalesce(kept, '') <> '', false) AS has_overlap FROM p LEFT JOIN g USING (doc_id, seq)""",
    ),
    "ml_pairwise": (
        lambda s, d: R.pairwise(given(s, d, "SELECT concat('v', CAST(vec_id AS STRING)) AS name, embedding FROM {embeddings}"), ["v1", "v2", "v30", "v4"]),
        """WITH v AS (SELECT 'v' || vec_id AS name, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (1, 2, 30, 4)), p AS (SELECT a.name AS a, b.name AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.name < b.name)
        SELECT *, round(1 - similarity, 6) AS distance, CASE WHEN similarity > 0.8 THEN 'very similar' WHEN similarity > 0.5 THEN 'similar' ELSE 'different' END AS reading FROM p""",
    ),
    "tx_chunk_strategies": (
        lambda s, d: C.chunked(given(s, d, SPACED), "structural", most=60).select("doc_id", F.lit("structural").alias("strategy"), "seq", "text").unionByName(C.chunked(given(s, d, SPACED), "semantic").select("doc_id", F.lit("semantic").alias("strategy"), "seq", "text"))
        .unionByName(C.chunked(given(s, d, SPACED), "coarse", words=20).select("doc_id", F.lit("coarse").alias("strategy"), "seq", "text")),
        f"""WITH RECURSIVE d AS ({named(SPACED)}), p AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS seq, t AS text, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i, trim(unnest(string_split(text, chr(10) || chr(10))), ' ' || chr(10) || chr(9)) AS t FROM d) WHERE t <> ''),
        f AS (SELECT doc_id, seq, 0 AS pack, n AS held FROM p WHERE seq = 0 UNION ALL SELECT p.doc_id, p.seq, CASE WHEN held + n <= 60 THEN pack ELSE pack + 1 END, CASE WHEN held + n <= 60 THEN held + n ELSE n END FROM f JOIN p ON p.doc_id = f.doc_id AND p.seq = f.seq + 1)
        SELECT doc_id, 'structural' AS strategy, pack AS seq, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM f JOIN p USING (doc_id, seq) GROUP BY doc_id, pack UNION ALL SELECT doc_id, 'semantic', seq, text FROM p
        UNION ALL SELECT doc_id, 'coarse', 0, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[:20], ' ') FROM d WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 0""",
    ),
    "ft_verified_matches": (
        lambda s, d: B.verified_matches(given(s, d, "SELECT p_partkey, concat('A study of ', p_name) AS title, concat(p_name, ' of a study', CASE WHEN p_size % 2 = 0 THEN '' ELSE ' and of many other altogether different things' END) AS candidate, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Lee' END AS surname, CASE WHEN p_size % 5 = 0 THEN 'Bo Leeds' ELSE 'Ann Lee' END AS authors FROM {part}")).select("p_partkey", F.round("ratio", 6).alias("ratio")),
        None,
    ),
    "ml_clusters": (lambda s, d: B.clustered(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 6), None),
}
