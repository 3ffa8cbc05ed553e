"""Registered query of context bundles over the star schema's graph, with the SQL that it must agree with."""

from __future__ import annotations

from ..operators import bundle as B
from .given import given, named
from .kg import EDGES, NODES, PREDICTED

QUESTIONS = """SELECT p_partkey AS query_id, CASE p_size % 4 WHEN 0 THEN concat('Who made ', p_name, '?') WHEN 1 THEN concat('which robot for ', p_brand) ELSE concat('on ', p_name) END AS query,
  CASE p_partkey % 6 WHEN 0 THEN 'BROAD' WHEN 1 THEN 'TECHNICAL' WHEN 2 THEN 'EVALUATION' WHEN 3 THEN 'COMPARISON' WHEN 4 THEN 'LIMITATION' ELSE 'PEOPLE' END AS intent FROM {part}"""
RANKED = "SELECT p_partkey AS query_id, concat('c', CAST(1 + p_partkey * (3 + n_nationkey) % 155 AS STRING)) AS paper, n_nationkey AS place FROM {part} CROSS JOIN {nation} WHERE n_nationkey < 7"
KNOWN = f"""SELECT id, CASE WHEN type = 'comparison' AND id LIKE '%3' THEN 'contribution' WHEN type = 'comparison' AND id LIKE '%7' THEN 'hardware' WHEN type = 'problem' THEN 'limitation' ELSE type END AS type,
  CASE WHEN type = 'comparison' THEN concat(label, ' by 3.5 in all of the scenes') ELSE label END AS label, substr(id, 1, 1) AS subtype, CASE WHEN id LIKE '%1' THEN 'low' ELSE 'high' END AS confidence, id LIKE '%13' AS is_methodology, CAST(NULL AS STRING) AS year FROM ({NODES}) n"""
TIED = f"""SELECT src, dst, min(type) AS type, max(CAST(round(confidence * 100) AS BIGINT)) AS seq, max(CAST(round(confidence * 10) AS INT)) AS mentions, CASE WHEN min(type) <> 'cites' THEN NULL WHEN dst LIKE '%2' THEN 'builds_on' WHEN dst LIKE '%5' THEN 'differs_from' ELSE 'neutral' END AS sentiment FROM ({EDGES}) e GROUP BY src, dst"""
GUESSED = f"SELECT src AS paper, type, dst AS label, max(confidence) AS confidence, max(0.2 + confidence) AS relevance, CAST(max(confidence * 200) AS BIGINT) AS seq FROM ({PREDICTED}) p GROUP BY src, type, dst"

_HARD, _WHO = ("(" + " OR ".join(f"contains(lower(query), '{w}')" for w in words) + ")" for words in (B.HARDWARE, B.PEOPLE))
_each = "row_number() OVER (PARTITION BY query_id, paper ORDER BY seq, line) AS own"
# (section, rows as line, k1, k2, k3)
_SECTIONS = {
    0: f"SELECT query_id, line, place, 0, seq FROM (SELECT *, '- ' || name || ': ' || label AS line, {_each} FROM met WHERE place <= 3 AND intent IN ('BROAD', 'TECHNICAL') AND kind = 'contribution' AND NOT is_methodology AND confidence = 'high' AND length(label) > 30) WHERE own <= 2",
    1: "SELECT query_id, '- ' || name || ': ' || label, place, 0, seq FROM met WHERE place <= 3 AND intent IN ('EVALUATION', 'COMPARISON') AND kind = 'comparison' AND confidence <> 'low'",
    2: f"SELECT query_id, line, place, 0, seq FROM (SELECT *, '- ' || name || ': ' || label AS line, {_each} FROM met WHERE intent = 'LIMITATION' AND kind = 'limitation') WHERE own <= 2",
    3: "SELECT query_id, '- ' || label || ' (' || subtype || '): used by ' || string_agg(name, ', ' ORDER BY place), -count(*), min(place), arg_min(seq, place) FROM met WHERE kind = 'technique' GROUP BY query_id, query, other, label, subtype HAVING count(*) >= 2 OR contains(lower(query), lower(label))",
    4: f"SELECT query_id, '- ' || name || ': ' || label, place, 0, seq FROM met WHERE {_HARD} AND kind = 'hardware'",
    5: """SELECT query_id, line, k[1], k[2], k[3] FROM (SELECT query_id, line, min([place, way, seq]) AS k FROM (SELECT query_id, '- ' || name || ' cites ' || label || ' (' || mentions || ' mentions)' AS line, place, 0 AS way, seq FROM met WHERE type = 'cites'
      UNION ALL SELECT query_id, '- ' || n.label || ' cites ' || name || ' (' || mentions || ' mentions)', place, 1, seq FROM top JOIN e ON e.dst = paper AND e.type = 'cites' JOIN n ON n.id = e.src) GROUP BY ALL)""",
    6: "SELECT query_id, line, k[1], 0, k[2] FROM (SELECT query_id, '- ' || name || ' ' || replace(sentiment, '_', ' ') || ' ' || label AS line, min([place, seq]) AS k FROM met WHERE place <= 4 AND intent IN ('COMPARISON', 'BROAD') AND type = 'cites' AND sentiment <> 'neutral' GROUP BY ALL)",
    7: f"SELECT query_id, '- ' || name || ': ' || array_to_string(list(label ORDER BY seq, label)[:5], ', ') || CASE WHEN count(*) > 5 THEN ' +' || (count(*) - 5) ELSE '' END, place, 0, min(seq) FROM met WHERE (intent = 'PEOPLE' OR {_WHO}) AND kind = 'author' GROUP BY query_id, paper, name, place",
    8: f"SELECT query_id, '- ' || label || ' (' || count(*) || ' papers)', -count(*), min(place), arg_min(seq, place) FROM met WHERE (intent = 'PEOPLE' OR {_WHO}) AND kind = 'institution' GROUP BY query_id, label",
    11: "SELECT query_id, '- ' || name || ' likely ' || replace(type, '_', ' ') || ': ' || label || ' (' || CAST(round_even(confidence * 100, 0) AS INT) || '% graph confidence, ' || CAST(round_even(relevance * 100, 0) AS INT) || '% semantic match)', place, 0, seq FROM g JOIN top USING (paper) WHERE type <> 'outperforms' AND relevance >= 0.35",
}
_LINES = " UNION ALL ".join(f"SELECT query_id, {i} AS section, line, row_number() OVER (PARTITION BY query_id ORDER BY k1, k2, k3, line) AS nr FROM ({rows}) l(query_id, line, k1, k2, k3) QUALIFY nr <= {B.SECTIONS[i][1]}" for i, rows in _SECTIONS.items())
_TITLES = ", ".join(f"({i}, '{title}')" for i, (title, _) in enumerate(B.SECTIONS))
_SQL = f"""WITH n AS MATERIALIZED ({named(KNOWN)}), e AS MATERIALIZED ({named(TIED)}), g AS ({named(GUESSED)}), q AS ({named(QUESTIONS)}), r AS ({named(RANKED)}),
top AS MATERIALIZED (SELECT query_id, query, intent, paper, name, row_number() OVER (PARTITION BY query_id ORDER BY first, paper) AS place FROM (SELECT query_id, paper, label AS name, min(place) AS first FROM r JOIN n ON id = paper AND type = 'paper' GROUP BY ALL) JOIN q USING (query_id) QUALIFY place <= 5),
met AS MATERIALIZED (SELECT top.*, e.dst AS other, e.type, e.seq, e.mentions, e.sentiment, n.type AS kind, n.label, n.subtype, n.confidence, n.is_methodology FROM top JOIN e ON e.src = paper JOIN n ON n.id = e.dst),
lines AS ({_LINES}), texts AS (SELECT query_id, section, string_agg(line, chr(10) ORDER BY nr) AS text FROM lines GROUP BY ALL),
whole AS (SELECT query_id, string_agg(title || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY section) AS text, count(*) AS n FROM texts JOIN (VALUES {_TITLES}) t(section, title) USING (section) GROUP BY query_id),
split AS (SELECT query_id, coalesce(text, '') AS text, coalesce(n, 0) AS n, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM q LEFT JOIN whole USING (query_id))
SELECT query_id, CASE WHEN len(w) > 120 THEN array_to_string(w[:120], ' ') ELSE text END AS context, least(len(w), 120) AS n_words, n AS n_sections FROM split"""

QUERIES = {"gr_context_bundles": (lambda s, d: B.context_bundles(*(given(s, d, x) for x in (QUESTIONS, RANKED, KNOWN, TIED, GUESSED)), words=120), _SQL)}
