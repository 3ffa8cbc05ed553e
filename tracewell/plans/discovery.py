"""Registered queries of betweenness, mentions, header clusters, keyphrases, density clusters and outliers, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import betweenness as B
from ..operators import density as D
from ..operators import headers as H
from ..operators import keyphrases as K
from ..operators import mentions as M
from ..operators import retrieval as R
from ..operators import terms as T
from ..sources.views import table
from .given import given, named

# suppliers in a ring that also jumps, each tied both ways to its nation, and nations to their regions
ROADS = """SELECT concat('s', s_suppkey) AS src, concat('s', 1 + s_suppkey % (SELECT count(*) FROM {supplier})) AS dst FROM {supplier} UNION ALL SELECT concat('s', s_suppkey), concat('s', 1 + s_suppkey * 7 % (SELECT count(*) FROM {supplier})) FROM {supplier} WHERE s_suppkey % 3 = 0
  UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM {supplier} UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM {supplier} WHERE s_suppkey % 2 = 0 UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM {nation} UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey) FROM {nation} WHERE n_nationkey % 4 = 1"""
_LEVELS = 14
_walk = ", ".join(
    f"l{i} AS MATERIALIZED (SELECT s, e.dst AS t, {i} AS d, sum(n) AS n FROM l{i - 1} JOIN e ON e.src = l{i - 1}.t WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT s, t FROM l{j}' for j in range(i))}) o WHERE o.s = l{i - 1}.s AND o.t = e.dst) GROUP BY ALL)"
    for i in range(1, _LEVELS + 1)
)
_BETWEEN = f"""WITH e AS (SELECT DISTINCT src, dst FROM ({named(ROADS)}) WHERE src <> dst), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), l0 AS (SELECT id AS s, id AS t, 0 AS d, 1.0::DOUBLE AS n FROM v), {_walk},
p AS MATERIALIZED ({" UNION ALL ".join(f"SELECT s, t, d, n FROM l{i}" for i in range(1, _LEVELS + 1))}), c AS (SELECT a.t AS id, sum(a.n * b.n / w.n) AS amount FROM p a JOIN p b ON b.s = a.t JOIN p w ON w.s = a.s AND w.t = b.t AND w.d = a.d + b.d GROUP BY a.t)
SELECT id, round(coalesce(amount, 0) / (((SELECT count(*) FROM v) - 1) * ((SELECT count(*) FROM v) - 2)), 8) AS betweenness FROM v LEFT JOIN c USING (id)"""

# every document may name parts and itself: aliases of two words and of one, in capitals, within words and across punctuation
TALK = """SELECT concat('c', doc_id) AS source, concat(text, ' It beats the ', (SELECT max(p_name) FROM {part}), ', unlike reds or RED', CASE WHEN doc_id % 3 = 0 THEN '-ring; ' ELSE ' ring ' END, 'c', CAST(doc_id AS STRING)) AS text FROM {documents}"""
CALLED = """SELECT concat('b', p_brand) AS target, max(p_name) AS alias FROM {part} GROUP BY p_brand UNION SELECT 'ring', 'red' UNION SELECT 'ring', 'Red Ring' UNION SELECT 'ring', 'ring' UNION SELECT concat('c', n_nationkey), concat('c', CAST(n_nationkey AS STRING)) FROM {nation}"""
ASKED = """SELECT p_partkey AS query_id, CASE p_size % 5 WHEN 0 THEN concat('Compare ', upper(p_name), ' to all') WHEN 1 THEN concat('is M', CAST(p_partkey % 9 AS STRING), 'X better, or ', p_name, '?') WHEN 2 THEN concat('what of (', p_name, ')') WHEN 3 THEN concat('m', CAST(p_partkey % 9 AS STRING), 'xs and ring') ELSE NULL END AS query FROM {part}"""
CALLABLE = """SELECT DISTINCT concat('* ', p_name, ' (M', CAST(p_partkey % 9 AS STRING), 'X)') AS method FROM {part} UNION SELECT 'Ring' UNION SELECT 'Of'"""
# headers share a brand or a size, which chains some of them only by way of others
HEADERS = """SELECT p_partkey AS place, CASE p_partkey % 4 WHEN 0 THEN concat('Mean ', p_name) WHEN 1 THEN concat('rate of ', CAST(p_partkey % 37 AS STRING), 'k / ', CAST(p_partkey % 11 AS STRING), 'm') WHEN 2 THEN concat(CAST(p_partkey % 37 AS STRING), 'k avg') ELSE '% (mean)' END AS raw, p_size AS n FROM {part}"""
_TOLD = "list_distinct(list_filter(regexp_extract_all(lower(raw), '[a-z0-9]+'), lambda w: w NOT IN ('the', 'of', 'in', 'on', 'per', 'rate', 'avg', 'average', 'mean')))"
_CLUSTERS = f"""h AS ({named(HEADERS).replace(' AS STRING', ' AS VARCHAR')}), w AS (SELECT place, unnest({_TOLD}) AS word FROM h), near AS (SELECT DISTINCT a.place AS i, b.place AS j FROM w a JOIN w b ON a.word = b.word AND b.place < a.place),
reach AS (SELECT i, j FROM near UNION SELECT r.i, n.j FROM reach r JOIN near n ON n.i = r.j), clusters AS (SELECT place, raw, n, coalesce((SELECT min(j) FROM reach WHERE i = place), place) AS cluster FROM h)"""

_COMMON = ("the", "of", "and", "to", "in", "is", "for", "der", "die", "und", "de", "la", "le", "les", "el", "en")


def _weights(texts, features, common=(), least=1, most=1.0):
    kept = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]{{2,}}'), lambda w: w NOT IN ('', {', '.join(repr(c) for c in common) or repr('')}))"
    return f"""d AS (SELECT row_number() OVER () AS r, id, {kept} AS w FROM ({texts})), t AS (SELECT r, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d), n AS (SELECT count(*) AS n FROM d),
v AS (SELECT term, count(DISTINCT r) AS df, count(*) AS places FROM t GROUP BY term HAVING df >= {least} AND df <= {most}::DOUBLE * (SELECT n FROM n) ORDER BY places DESC, term LIMIT {features}),
f AS (SELECT id, term, df, count(*) AS tf FROM t JOIN v USING (term) GROUP BY ALL), w AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM f, n), x AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"""


QUERIES = {
    "gr_betweenness": (lambda s, d: B.betweenness(given(s, d, ROADS), batch=512).withColumn("betweenness", F.round("betweenness", 8)), _BETWEEN),
    "jn_mention_contexts": (
        lambda s, d: M.mentions(given(s, d, TALK), given(s, d, CALLED)).withColumn("contexts", F.array_join("contexts", " / ")).drop("sentiment"),
        rf"""WITH t AS ({named(TALK).replace(' AS STRING', ' AS VARCHAR')}), a AS ({named(CALLED).replace(' AS STRING', ' AS VARCHAR')}), g AS (SELECT target, '(?i)\b(' || string_agg(regexp_escape(alias), '|' ORDER BY length(alias) DESC, alias) || ')\b' AS p FROM a GROUP BY target),
        m AS (SELECT source, target, text, regexp_extract_all(text, p) AS hits, string_split_regex(text, p) AS gaps FROM t JOIN g ON source <> target AND regexp_matches(text, p) WHERE length(text) >= 100),
        x AS (SELECT source, target, hits, text, i, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda z: length(z))), 0) AS b FROM m, range(1, 4) r(i) WHERE i <= len(hits))
        SELECT source, target, CAST(any_value(len(hits)) AS INT) AS mentions, any_value(hits[1]) AS matched, string_agg(trim(replace(substr(text, CAST(greatest(0, b - 100) AS BIGINT) + 1, CAST(b + length(hit) + 100 - greatest(0, b - 100) AS BIGINT)), chr(10), ' ')), ' / ' ORDER BY i) AS contexts FROM x GROUP BY source, target""",
    ),
    "jn_named_methods": (
        lambda s, d: M.named_in(given(s, d, ASKED), given(s, d, CALLABLE)),
        f"""WITH q AS (SELECT query_id, ' ' || lower(coalesce(query, '')) || ' ' AS q FROM ({named(ASKED).replace(' AS STRING', ' AS VARCHAR')})), k AS (SELECT method, lower(regexp_replace(method, '^[^A-Za-z0-9]+', '')) AS n FROM ({named(CALLABLE).replace(' AS STRING', ' AS VARCHAR')})),
        f AS (SELECT method, n AS alias FROM k UNION SELECT method, regexp_extract(n, '\\(([^)]+)\\)', 1) FROM k UNION SELECT method, trim(regexp_replace(n, '\\s*\\([^)]*\\)\\s*', ' ', 'g')) FROM k)
        SELECT DISTINCT query_id, method FROM q JOIN f ON alias <> '' AND ((regexp_full_match(alias, '[a-z0-9]{{3,}}') AND list_contains(regexp_extract_all(q, '[a-z0-9]+'), alias)) OR (length(alias) >= 5 AND contains(q, ' ' || alias || ' ')))""",
    ),
    "str_header_clusters": (lambda s, d: H.header_clusters(given(s, d, HEADERS)), f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM clusters"),
    "str_alias_proposals": (
        lambda s, d: H.alias_proposals(H.header_clusters(given(s, d, HEADERS))),
        f"""WITH RECURSIVE {_CLUSTERS}, f AS (SELECT cluster FROM clusters WHERE place = cluster ORDER BY cluster LIMIT 40), g AS (SELECT cluster, count(*) AS n_headers, CAST(sum(n) AS BIGINT) AS n, array_to_string(list(raw ORDER BY place)[:10], ' | ') AS headers FROM clusters WHERE cluster IN (SELECT cluster FROM f) GROUP BY cluster)
        SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS rank FROM g""",
    ),
    "tx_keyphrases": (lambda s, d: K.keyphrases(table(s, d, "documents").select("doc_id", "text")), None),  # greedy choice: tested against brute force
    "ml_term_weights": (
        lambda s, d: T.term_weights(given(s, d, "SELECT p_partkey AS id, concat(p_name, ', ', p_type, '-', p_brand) AS text FROM {part}"), "id", "text").withColumn("weight", F.round("weight", 6)),
        f"WITH {_weights("SELECT p_partkey AS id, concat(p_name, ', ', p_type, '-', p_brand) AS text FROM part", 50)} SELECT id, term, round(weight, 6) AS weight FROM x",
    ),
    "tx_top_terms": (
        lambda s, d: T.top_terms(T.term_weights(table(s, d, "documents"), "doc_id", "text", 500, _COMMON, 2, 0.8), "doc_id"),
        f"WITH {_weights('SELECT doc_id AS id, text FROM documents', 500, _COMMON, 2, 0.8)} SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS rank, term, round(round(weight, 9), 4) AS weight FROM x QUALIFY rank <= 15",
    ),
    "ml_density_clusters": (lambda s, d: D.density_clusters(table(s, d, "embeddings"), ("label",)), None),  # merges one by one: tested against a sequential version
    "ml_outliers": (
        lambda s, d: R.outliers(table(s, d, "embeddings")),
        """WITH m AS (SELECT a.vec_id, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 9) AS mean FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id), p AS (SELECT vec_id, mean, round(100.0::DOUBLE * (count(*) OVER () - count(*) OVER (ORDER BY mean)) / count(*) OVER (), 1) AS percentile FROM m)
        SELECT vec_id, round(mean, 6) AS mean_similarity, percentile, CASE WHEN percentile < 70 THEN 'typical' WHEN percentile < 90 THEN 'somewhat unusual' ELSE 'outlier' END AS reading FROM p""",
    ),
}
