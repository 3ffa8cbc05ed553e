"""Registered queries of facts, citation places, questions, derived features and cards, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import evidence as E
from ..operators import facts as X
from ..operators import features as A
from ..operators import landing as G
from ..operators import questions as Q
from ..operators import resolution as R
from ..operators import table_wins as T
from ..session import staged
from ..sources.views import results, table
from .evidence import VALID
from .given import given, named

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
STATED = r"""SELECT p_partkey AS doc_id, p_size AS seq, concat('We report. ', CASE p_size % 6 WHEN 0 THEN concat('It achieves ', CAST(p_size AS STRING), '.5% on YCB. It has 92.5 parts, ') WHEN 1 THEN 'a success rate of 92.5 % and accuracy: 41%, ' WHEN 2 THEN 'PointNet++ with focal loss, Focal-Loss and AdamW. ' WHEN 3 THEN 'as $E = mc^2$, $the loss function here is$ and L_g = x + y * 2 + z. ' WHEN 4 THEN '12,000 training scenes of EGAD, the ycb set and Egad. ' ELSE concat(chr(92), 'begin', chr(123), 'align', chr(125), 'a &= b + c', chr(92), 'end', chr(123), 'align', chr(125), ' R = 10 - 3 + x/2 ') END,
  p_name, ' net NetworkX. ', CASE p_size % 7 WHEN 0 THEN 'A ResNet-50 reached a 94.5%. $x = [12] + y$ $ab = wordRunTogether$' WHEN 1 THEN 'a resnet-50, 94.5% completion' WHEN 2 THEN concat('YCB and $', p_brand, ' = 1$ $a=b+1$ $a=b+2$ $a=b+3$ $a=b+4$ $a=b+5$ $a=b+1$') ELSE p_type END) AS text FROM {part}"""


def _hits(kind: str, number: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return rf"""SELECT doc_id, seq, text, '{kind}' AS kind, {number} AS number, CAST(list_sum(list_transform(gaps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS pos, length(hits[i]) AS len, {_TRIM.format('vals[i]')} AS value
    FROM (SELECT *, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS vals, string_split_regex(text, '{p}') AS gaps FROM t), range(1, len(hits) + 1) r(i)"""


_NEAR = _TRIM.format("substr(text, greatest(0, pos - {0}) + 1, pos + len + {0} - greatest(0, pos - {0}))")
_KINDS = [("metric", n, p, 1) for n, p in enumerate(X.METRIC_PATTERNS)] + [(k, 0, p, 0) for k, p in X.ARCHITECTURE_PATTERNS.items()] + [("equation", n, p, 1) for n, p in enumerate(X.EQUATION_PATTERNS)] + [("dataset", 0, rf"(?i)\b({'|'.join(X.DATASETS)})\b", 0)]
_VALID_EQ = r"""length(e) BETWEEN 5 AND 300 AND regexp_matches(e, '[=+\-*/^_{}\\∑∫∂∇αβγδεζηθλμνξπρστφχψω]') AND NOT (len(string_split_regex(e, '\s+')) > 3 AND len(list_filter(string_split_regex(e, '\s+'), lambda w: regexp_full_match(w, '\p{L}{4,}'))) / len(string_split_regex(e, '\s+'))::DOUBLE > 0.6) AND NOT regexp_matches(e, '[a-z]{3}[A-Z][a-z]{3}|\[\d+\]|Table\s+[IVX]+')"""
_FACTS = rf"""t AS ({named(STATED).replace(' AS STRING', ' AS VARCHAR')}), h AS ({" UNION ALL ".join(_hits(*k) for k in _KINDS)}), g AS (SELECT *, value AS e, {_NEAR.format(100)} AS near FROM h),
v AS (SELECT *, CASE WHEN kind IN ('metric', 'equation') THEN value ELSE lower(value) END AS key, array_to_string(list_filter(string_split(near, '.'), lambda z: contains(z, value)), '. ') AS said FROM g WHERE kind <> 'equation' OR ({_VALID_EQ})),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq, kind ORDER BY number, pos) AS place FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, seq, kind, key ORDER BY number, pos) = 1))
SELECT doc_id, seq, kind, value, CASE WHEN kind = 'metric' THEN CASE WHEN contains(substr(text, pos + 1, len + 5), '%') THEN '%' ELSE '' END END AS unit,
CASE kind WHEN 'metric' THEN left(CASE WHEN contains(near, '.') AND said <> '' THEN {_TRIM.format('said')} ELSE near END, 200) WHEN 'equation' THEN left({_TRIM.format(f"string_split({_TRIM.format('substr(text, greatest(0, pos - 60) + 1, pos - greatest(0, pos - 60))')}, '.')[-1]")}, 100) WHEN 'dataset' THEN left({_NEAR.format(60)}, 200) ELSE left({_NEAR.format(80)}, 200) END AS context
FROM o WHERE kind <> 'equation' OR place <= 5"""
EQUATIONS = r"SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN concat(' a = ', p_name, ' ') WHEN 1 THEN 'x=1' WHEN 2 THEN concat('loss of the whole model as said = ', p_type) WHEN 3 THEN 'x = y [3]' WHEN 4 THEN concat('wordRunTogether + ', p_name) WHEN 5 THEN p_name WHEN 6 THEN '∑ x y z w' ELSE NULL END AS e FROM {part}"
CITED = "SELECT doc_id, concat(text, ' [7] said so. Others [7], [70]') AS text FROM {documents}"
DIALOGUE = """SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 4 = 0 THEN concat('How fast is it? ', text) WHEN role = 'user' AND turn % 4 = 2 THEN concat('what about ', text) WHEN role <> 'user' AND conv_id % 2 = 0 THEN concat('Use **Alpha** or **beta**, **ALPHA** and ** Gamma **: ', text) ELSE text END AS text FROM {conversations}"""
PUZZLES = """SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN concat('Which methods are best for ', p_type, '?') WHEN 1 THEN 'Give an overview of the field' WHEN 2 THEN concat(p_name, ' vs others, which is the better') WHEN 3 THEN 'Who wrote it, and what lab or team?' WHEN 4 THEN 'loss and network of the benchmark result' WHEN 5 THEN 'suitable methods for piles' WHEN 6 THEN 'What problem or gap is left as future work' WHEN 7 THEN NULL ELSE p_name END AS query FROM {part}"""
METHODS = """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '6-DoF pose' WHEN 1 THEN '7-DoF' WHEN 2 THEN '2D grasp' WHEN 3 THEN 'Grasp policy' WHEN 4 THEN 'Grasp success' WHEN 5 THEN NULL ELSE p_name END AS output, CASE p_partkey % 6 WHEN 0 THEN 'Analytical, Sampling' WHEN 1 THEN 'Reinforcement learning, Sampling' WHEN 2 THEN 'Generative' WHEN 3 THEN 'Sampling, Direct regression' WHEN 4 THEN NULL ELSE p_name END AS planning,
  CASE WHEN p_partkey % 11 = 0 THEN 'Training-less' ELSE p_type END AS training, CASE p_partkey % 7 WHEN 0 THEN 'Point Cloud' WHEN 1 THEN 'RGB, Depth' WHEN 2 THEN 'RGBD image' WHEN 3 THEN 'Depth' WHEN 4 THEN 'Natural Language' WHEN 5 THEN 'RGB' ELSE NULL END AS inputs, CASE p_partkey % 5 WHEN 0 THEN 'Singulated, Packed' WHEN 1 THEN 'Stacked' WHEN 2 THEN 'Structured' WHEN 3 THEN 'Cluttered,Odd' ELSE p_name END AS scene,
  CASE p_size % 6 WHEN 0 THEN 'Two-finger' WHEN 1 THEN 'Suction cup' WHEN 2 THEN 'Three-finger' WHEN 3 THEN 'Two-finger, Suction' WHEN 4 THEN 'Multi-finger' ELSE p_type END AS hardware, CASE p_size % 4 WHEN 0 THEN 'Python, Keras' WHEN 1 THEN 'TensorFlow/PyTorch' WHEN 2 THEN 'TensorFlow' ELSE 'C++' END AS language, CASE WHEN p_size % 10 = 3 THEN NULL ELSE 2014 + p_size % 12 END AS year FROM {part}"""
_SCENES = "CASE condition WHEN 'a:f' THEN 'pile:gsr:ycb' WHEN 'n:f' THEN 'Simulation:fixedview:noretrain' WHEN 'n:o' THEN 'gsr' WHEN 'r:f' THEN 'odd:pile:gaussnoise:sr' WHEN 'r:o' THEN 'isolated' ELSE {0} END"
_SHOWN = "do_not_compare"


def tried(s, d):
    return results(s, d).withColumn("condition", F.expr(_SCENES.format("NULL"))).withColumn("trials", F.expr("CASE WHEN record_id % 4 = 0 THEN record_id % 3 END"))


def cards(s, d):
    rows = staged(tried(s, d))
    return A.cards(rows, E.cross_validation(rows)).withColumn(_SHOWN, F.array_join(_SHOWN, "; "))


def _without(missing: str) -> str:
    return f"'{missing} not reported — do not compare across it'"


_CARDS = f"""{VALID},
g AS (SELECT method, metric, dataset, condition, count(DISTINCT paper) AS papers, arg_min(record_id % 3, record_id) FILTER (record_id % 4 = 0 AND record_id % 3 > 0) AS tried FROM results GROUP BY ALL),
c AS (SELECT g.*, coalesce(v.n_papers, papers) AS n_papers, v.status, CASE g.condition WHEN 'a:f' THEN 'pile' WHEN 'n:f' THEN 'sim' WHEN 'r:f' THEN 'pile' WHEN 'r:o' THEN 'isolated' END AS scene, CASE g.condition WHEN 'a:f' THEN 'gsr' WHEN 'n:o' THEN 'gsr' WHEN 'r:f' THEN 'sr' END AS crit, CASE g.condition WHEN 'a:f' THEN 'ycb' END AS objects,
  CASE g.condition WHEN 'n:f' THEN 'Fixed camera · No retrain (OOD)' WHEN 'r:f' THEN 'Gaussian noise' END AS protocol FROM g LEFT JOIN validated v USING (method, metric, dataset, condition)),
k AS (SELECT *, CASE WHEN status = 'consistent' AND n_papers >= 2 THEN 'reproduced' WHEN scene IS NOT NULL AND crit IS NOT NULL THEN 'single-full' ELSE 'single-partial' END AS tier FROM c)
SELECT method, metric, dataset, {_SCENES.format('NULL')} AS condition, n_papers, tier, CASE tier WHEN 'reproduced' THEN 'Reproduced (≥2 papers agree)' WHEN 'single-full' THEN 'Single paper, full protocol' ELSE 'Single paper, partial protocol' END AS tier_label,
coalesce(objects, 'not reported') AS object_set, 'not reported' AS gripper, 'not reported' AS arm, 'not reported' AS sensor, coalesce(scene, 'not reported') AS scene, coalesce(crit, 'not reported') AS success_criterion, coalesce(CAST(tried AS VARCHAR), 'not reported') AS trials, coalesce(protocol, 'not reported') AS protocol,
concat_ws('; ', CASE WHEN objects IS NULL THEN {_without('object_set')} END, {_without('gripper')}, {_without('arm')}, {_without('sensor')}, CASE WHEN scene IS NULL THEN {_without('scene')} END, CASE WHEN crit IS NULL THEN {_without('success_criterion')} END, CASE WHEN tried IS NULL THEN {_without('trials')} END, CASE WHEN protocol IS NULL THEN {_without('protocol')} END) AS do_not_compare,
CASE condition WHEN 'a:f' THEN 'Pile · Grasp success rate (GSR) · YCB objects' WHEN 'n:f' THEN 'Simulation · Fixed camera · No retrain (OOD)' WHEN 'n:o' THEN 'Grasp success rate (GSR)' WHEN 'r:f' THEN 'Odd · Pile · Gaussian noise · Success rate (SR)' WHEN 'r:o' THEN 'Isolated' ELSE 'All conditions' END AS condition_label FROM k"""

COVERED = "SELECT p_partkey AS place, p_name AS name, CASE p_size % 5 WHEN 0 THEN concat(p_brand, ', ', p_type, ',') WHEN 1 THEN p_type WHEN 2 THEN 'nan' WHEN 3 THEN NULL ELSE concat(' ', p_brand, ' ,', p_brand) END AS datasets, CASE p_size % 4 WHEN 0 THEN CAST(1990 + p_size AS STRING) WHEN 1 THEN concat(CAST(2000 + p_size % 29 AS STRING), '.0') WHEN 2 THEN 'soon' END AS year FROM {part}"
OUTSIDE = "SELECT concat('c', o_custkey) AS src, concat('w', o_orderkey % 97) AS dst, CASE o_orderkey % 3 WHEN 0 THEN 'cites_external' WHEN 1 THEN 'cites' ELSE 'about' END AS type, CASE o_orderkey % 5 WHEN 0 THEN 'builds_on' WHEN 1 THEN 'differs_from' WHEN 2 THEN 'other' END AS sentiment FROM {orders}"
WORKS = "SELECT concat('w', p_partkey) AS id, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat('Work ', CAST(p_partkey % 40 AS STRING)) END AS label, 1990 + p_size AS year, p_brand AS venue FROM {part}"
USES = "SELECT o_custkey AS src, p_brand AS dst, CASE o_orderkey % 4 WHEN 0 THEN 'uses_loss' WHEN 1 THEN 'about' ELSE 'uses_technique' END AS type FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey WHERE l_linenumber = 1"
ANCHORS = "SELECT p_brand AS label, CASE WHEN p_size % 3 = 0 THEN ' N/A' ELSE p_type END AS a, 'Not reported' AS b, CASE WHEN p_size % 2 = 0 THEN ' One' ELSE 'ONE ' END AS c, p_type AS e FROM {part}"
REPLIES = """SELECT p_partkey AS answer_id, concat(CASE p_size % 5 WHEN 0 THEN concat('Sure:', chr(10), '```json', chr(10)) WHEN 1 THEN 'The list is ' WHEN 2 THEN '{"a": ' ELSE '' END, '[', chr(123), '"type": "loss", "value": "', p_name, ' ', repeat('x', 40 * (p_size % 9)), '", "confidence": "high"', chr(125), ', ', chr(123), '"type": "other", "value": "long enough"', chr(125), ', ', chr(123), '"type": "dataset", "value": "the ', p_type, '"', chr(125), ', ', chr(123), '"type": "loss", "value": "short"', chr(125),
  CASE p_size % 5 WHEN 0 THEN concat(']', chr(10), '```') WHEN 1 THEN '] as said' WHEN 2 THEN ' cut off' WHEN 3 THEN ', {]' ELSE '' END) AS answer FROM {part}""".replace("'{\"a\": '", "'a: '").replace("', {]'", "', (]'")
STRUCTURED = """SELECT p_partkey AS answer_id, CASE p_size % 4 WHEN 0 THEN concat('```json', chr(10), chr(123), '"answer": " It is ', p_name, '", "discussed": ["', p_name, '", ', chr(123), '"id": "', p_brand, '", "why": "x"', chr(125), ', ""], "citations": [', chr(123), '"marker": "[1]"', chr(125), ', ', chr(123), '"paper_id": "p2", "paper_title": "T"', chr(125), ']', chr(125), chr(10), '```')
  WHEN 1 THEN concat('So: ', chr(123), '"answer": "It is ', p_name, '", "methods": [', chr(123), '"method": "', p_type, '"', chr(125), ']', chr(125), ' done') WHEN 2 THEN concat(chr(123), '"answer": "  "', chr(125)) ELSE p_name END AS answer FROM {part}"""
_LINES = "(SELECT o_custkey, l_orderkey, l_quantity, l_linenumber, p_brand, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_brand, l_quantity, o_custkey) AS INT) AS n FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey) t"
_COLUMNS = "(SELECT 0 AS col UNION ALL SELECT 1 UNION ALL SELECT 2) h"
GRIDS = f"""SELECT concat('paper:c', o_custkey) AS paper, o_orderkey AS table_id, 0 AS row, col, CASE col WHEN 0 THEN 'Method' WHEN 1 THEN 'Score ↑' ELSE 'Time (lower)' END AS text FROM {{orders}}, {_COLUMNS}
  UNION ALL SELECT concat('paper:c', o_custkey), l_orderkey, n, col, CASE col WHEN 0 THEN CASE WHEN l_linenumber % 4 = 0 THEN 'Ours' ELSE concat(p_brand, ' [3]') END WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '%') ELSE CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE concat(CAST(CAST(l_quantity AS INT) * 2 AS STRING), '.5 ± 1 ms') END END FROM {_LINES}, {_COLUMNS}"""
BRANDS = "SELECT concat('method:', p_brand) AS id, 'method' AS type, p_brand AS label, min(p_partkey) AS place FROM {part} GROUP BY p_brand"
WEIGHTS = {"output": 11, "scene": 8, "other": 5}
WORDS = {"output": ("loss", "network", "method", "o"), "scene": ("pile", "field")}
GROUPS = "SELECT o_custkey AS doc_id, o_orderkey AS seq, l_linenumber AS i, CAST(l_quantity AS INT) AS n FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"

QUERIES = {
    "tx_facts": (lambda s, d: X.facts(given(s, d, STATED)), f"WITH {_FACTS}"),
    "ft_equations": (lambda s, d: given(s, d, EQUATIONS).select("p_partkey", X.valid_equation(F.col("e")).alias("valid")), f"SELECT p_partkey, coalesce({_VALID_EQ}, false) AS valid FROM (SELECT p_partkey, trim(e) AS e FROM ({named(EQUATIONS)}))"),
    "tx_citation_places": (
        lambda s, d: X.citations(given(s, d, CITED), given(s, d, "SELECT doc_id, '[7]' AS marker FROM {documents} UNION ALL SELECT doc_id, '[70]' FROM {documents} WHERE doc_id % 2 = 0")),
        rf"""WITH t AS ({named(CITED)}), m AS (SELECT doc_id, text, unnest(CASE WHEN doc_id % 2 = 0 THEN ['[7]', '[70]'] ELSE ['[7]'] END) AS marker FROM t), q AS (SELECT *, length(marker) AS k, list_transform(string_split(text, marker), lambda z: length(z)) AS gaps FROM m), p AS (SELECT doc_id, text, marker, k, CAST(list_sum(gaps[1:i]) AS BIGINT) + (i - 1) * k AS pos FROM q, range(1, len(gaps)) r(i)),
        a AS (SELECT *, greatest(0, pos - 200) AS g, substr(text, greatest(0, pos - 200) + 1, pos - greatest(0, pos - 200)) AS bef, substr(text, pos + k + 1, 200) AS aft FROM p), b AS (SELECT *, length(regexp_extract(bef, '^(?s:.*?)[.?!]\s+')) AS lead, length(bef) + k + length(aft) AS size, strpos(bef, ' ') AS sp FROM a),
        c AS (SELECT *, substr(bef, 1 + CASE WHEN g = 0 THEN 0 WHEN lead > 0 AND lead < size * 0.5 THEN lead WHEN sp BETWEEN 2 AND 20 THEN sp ELSE 0 END) AS opened, length(regexp_extract(aft, '^((?s:.*)[.?!]) ', 1)) AS fin FROM b)
        SELECT doc_id, marker, CAST(pos AS INT) AS at, opened || '【' || marker || '】' || CASE WHEN fin > 0 AND length(opened) + k + fin - 1 > (length(opened) + k + length(aft)) * 0.5 THEN substr(aft, 1, fin) ELSE aft END AS context FROM c""",
    ),
    "str_routed_intents": (
        lambda s, d: given(s, d, PUZZLES).select("p_partkey", Q.routed_intent(F.col("query")).alias("intent"), Q.answer_shape(F.col("query")).alias("shape")),
        """SELECT p_partkey, CASE p_size % 9 WHEN 2 THEN 'COMPARISON' WHEN 3 THEN 'PEOPLE' WHEN 4 THEN 'TECHNICAL' WHEN 5 THEN 'EVALUATION' WHEN 6 THEN 'LIMITATION' ELSE 'BROAD' END AS intent,
        CASE p_size % 9 WHEN 0 THEN 'ranking' WHEN 1 THEN 'overview' WHEN 2 THEN 'comparison' WHEN 5 THEN 'recommendation' ELSE 'default' END AS shape FROM part""",
    ),
    "str_rewritten_questions": (
        lambda s, d: Q.conversation_queries(given(s, d, DIALOGUE)).select("conv_id", "turn", "query"),
        rf"""WITH t AS ({named(DIALOGUE)}), w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER o AS b, last_value(CASE WHEN role <> 'user' THEN text END IGNORE NULLS) OVER o AS a FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        p AS (SELECT conv_id, turn, text, coalesce(b, '') AS b, CASE WHEN starts_with(coalesce(a, ''), 'Use **Alpha**') THEN 'Alpha and beta and Gamma' ELSE b END AS topic FROM w WHERE role = 'user')
        SELECT conv_id, turn, CASE WHEN b = '' THEN text WHEN regexp_matches(text, '\b(it|its|it''s|they|their|them|those|these|that one|the first one|the second one|the last one)\b', 'i') THEN regexp_replace(text, '\b(it|its|it''s|they|their|them|those|these|that one|the first one|the second one|the last one)\b', replace(topic, '\', '\\'), 'i')
        WHEN regexp_matches(text, '^\s*(what about|and\b|how about)', 'i') THEN text || ' (regarding ' || topic || ')' ELSE text END AS query FROM p""",
    ),
    "str_method_features": (
        lambda s, d: given(s, d, METHODS).select("p_partkey", *[c.alias(n) for n, c in A.derived(*map(F.col, ("output", "planning", "training", "inputs", "scene", "hardware", "language", "year"))).items()]),
        f"""WITH m AS ({named(METHODS)}) SELECT p_partkey, CASE WHEN starts_with(output, '6') THEN '6-DoF' WHEN starts_with(output, '7') THEN '7-DoF' WHEN output = '2D grasp' THEN '2D' WHEN output = 'Grasp policy' THEN 'Policy' WHEN output = 'Grasp success' THEN 'Evaluation' ELSE 'Other' END AS dimensionality,
        CASE WHEN p_partkey % 11 = 0 OR p_partkey % 6 = 0 THEN 'Classical' WHEN p_partkey % 6 = 1 THEN 'RL-based' WHEN p_partkey % 6 IN (2, 3) THEN 'Learning-based' ELSE 'Hybrid' END AS paradigm, CASE p_partkey % 7 WHEN 0 THEN '3D' WHEN 1 THEN 'Multimodal' WHEN 2 THEN '2.5D' WHEN 4 THEN 'Multimodal' WHEN 6 THEN 'Other' ELSE '2D' END AS sensor_complexity,
        CASE p_partkey % 5 WHEN 0 THEN 'Packed' WHEN 1 THEN 'Piled' WHEN 2 THEN 'Structured' WHEN 3 THEN 'Cluttered' ELSE 'Unknown' END AS scene_difficulty, CASE hardware WHEN 'Two-finger' THEN 'Parallel-jaw' WHEN 'Suction cup' THEN 'Suction' WHEN 'Three-finger' THEN 'Dexterous' WHEN 'Multi-finger' THEN 'Dexterous' WHEN 'Two-finger, Suction' THEN 'Multi-gripper' ELSE 'Unknown' END AS gripper_type,
        CASE language WHEN 'Python, Keras' THEN 'Keras' WHEN 'TensorFlow/PyTorch' THEN 'PyTorch' WHEN 'TensorFlow' THEN 'TensorFlow' ELSE 'None' END AS framework, CASE WHEN year IS NULL THEN 'Unknown' WHEN year < 2019 THEN 'Pioneer (2016-2018)' WHEN year < 2022 THEN 'Growth (2019-2021)' ELSE 'Modern (2022+)' END AS era FROM m""",
    ),
    "ag_dataset_coverage": (
        lambda s, d: G.dataset_coverage(given(s, d, COVERED), 12, 5),
        f"WITH m AS ({named(COVERED)}), t AS (SELECT place, name, unnest(list_filter(list_transform(string_split(coalesce(datasets, ''), ','), lambda p: trim(p)), lambda p: p <> '' AND lower(p) <> 'nan')) AS dataset FROM m) SELECT dataset, count(*) AS n, array_to_string(list(name ORDER BY place)[:5], ', ') AS methods FROM t GROUP BY dataset ORDER BY n DESC, dataset LIMIT 12",
    ),
    "ag_years_covered": (lambda s, d: G.years_covered(given(s, d, COVERED)), f"SELECT y AS year, count(*) AS n FROM (SELECT TRY_CAST(trunc(TRY_CAST(year AS DOUBLE)) AS INT) AS y FROM ({named(COVERED).replace(' AS STRING', ' AS VARCHAR')})) WHERE y BETWEEN 2005 AND 2030 GROUP BY y"),
    "ag_external_references": (
        lambda s, d: G.external_references(given(s, d, OUTSIDE), given(s, d, WORKS)),
        f"WITH e AS ({named(OUTSIDE)}), w AS ({named(WORKS).replace(' AS STRING', ' AS VARCHAR')}) SELECT label, count(*) AS n, arg_min(year, id) AS year, arg_min(venue, id) AS venue FROM e JOIN w ON id = dst WHERE type = 'cites_external' AND label <> '' GROUP BY label HAVING count(*) >= 2 ORDER BY n DESC, label LIMIT 10",
    ),
    "ag_citation_flow": (lambda s, d: G.citation_flow(given(s, d, OUTSIDE)), f"WITH e AS ({named(OUTSIDE)}), c AS (SELECT coalesce(sentiment, 'neutral') AS s FROM e WHERE type = 'cites' UNION ALL SELECT NULL) SELECT v.s AS sentiment, (SELECT count(*) FROM c WHERE c.s = v.s) AS n FROM (SELECT 'builds_on' AS s UNION SELECT 'differs_from' UNION SELECT 'neutral' UNION SELECT s FROM c WHERE s IS NOT NULL) v"),
    "ag_companions": (lambda s, d: G.companions(given(s, d, USES), "Brand#11", ("uses_technique", "uses_loss"), 3), f"WITH u AS ({named(USES)}) SELECT dst AS id, count(*) AS n FROM u WHERE type <> 'about' AND dst <> 'Brand#11' AND src IN (SELECT src FROM u WHERE dst = 'Brand#11' AND type <> 'about') GROUP BY dst ORDER BY n DESC, id LIMIT 3"),
    "ag_dimension_status": (
        lambda s, d: G.dimension_status(given(s, d, ANCHORS), "label", ("a", "b", "c", "e")),
        f"WITH m AS ({named(ANCHORS)}), t AS (SELECT label, unnest(['a', 'b', 'c', 'e']) AS dimension, unnest([a, b, c, e]) AS v FROM m), l AS (SELECT label, dimension, CASE WHEN lower(trim(v)) NOT IN ('', 'not reported', 'n/a', '-') THEN lower(trim(v)) END AS v FROM t) SELECT label, dimension, CASE WHEN count(v) = 0 THEN 'gap' WHEN count(v) < count(*) THEN 'partial' WHEN count(DISTINCT v) = 1 THEN 'shared' ELSE 'differs' END AS status, count(v) AS filled, count(*) AS anchors FROM l GROUP BY label, dimension",
    ),
    "gr_shared_items": (
        lambda s, d: G.first_shared(given(s, d, "SELECT concat('c', o_custkey) AS a, concat('c', o_custkey % 20 + 1) AS b FROM {orders}"), given(s, d, USES).withColumn("src", F.concat(F.lit("c"), "src")), "uses_technique"),
        f"WITH u AS (SELECT DISTINCT 'c' || src AS src, dst FROM ({named(USES)}) WHERE type = 'uses_technique'), p AS (SELECT DISTINCT 'c' || o_custkey AS a, 'c' || (o_custkey % 20 + 1) AS b FROM orders), m AS (SELECT a, b, x.dst FROM p JOIN u x ON x.src = a JOIN u y ON y.src = b AND y.dst = x.dst) SELECT a, b, count(*) AS n, array_to_string(list_sort(list(dst))[:3], ',') AS items FROM m GROUP BY a, b",
    ),
    "str_parsed_entities": (
        lambda s, d: B.parsed_entities(given(s, d, REPLIES), ("loss", "dataset")),
        "SELECT p_partkey AS answer_id, 0 AS i, 'loss' AS type, left(p_name || ' ' || repeat('x', 40 * (p_size % 9)), 300) AS value, 'high' AS confidence FROM part WHERE p_size % 5 IN (0, 1) UNION ALL SELECT p_partkey, 2, 'dataset', 'the ' || p_type, 'medium' FROM part WHERE p_size % 5 IN (0, 1)",
    ),
    "str_structured_answers": (
        lambda s, d: B.structured_answers(given(s, d, STRUCTURED)).select("answer_id", "answer", F.array_join("discussed", "|").alias("discussed"), F.array_join(F.transform("citations", lambda c: F.concat_ws("/", c["marker"], c["paper_id"], c["paper_title"])), "|").alias("citations")),
        "SELECT p_partkey AS answer_id, 'It is ' || p_name AS answer, CASE WHEN p_size % 4 = 0 THEN p_name || '|' || p_brand ELSE p_type END AS discussed, CASE WHEN p_size % 4 = 0 THEN '[1]/[1]/|p2/p2/T' ELSE '' END AS citations FROM part WHERE p_size % 4 IN (0, 1)",
    ),
    "str_column_weights": (
        lambda s, d: given(s, d, PUZZLES).select("p_partkey", *[c.alias(n) for n, c in Q.column_weights(F.col("query"), WEIGHTS, WORDS).items()], Q.color_by(F.col("query"), WORDS, Q.column_weights(F.col("query"), WEIGHTS, WORDS), WEIGHTS).alias("color")),
        f"""WITH q AS (SELECT p_partkey, lower(coalesce(query, '')) AS q FROM ({named(PUZZLES)})), h AS (SELECT p_partkey, contains(q, 'loss')::INT + contains(q, 'network')::INT + contains(q, 'method')::INT + contains(q, 'o')::INT AS a, contains(q, 'pile')::INT + contains(q, 'field')::INT AS b FROM q)
        SELECT p_partkey, CASE WHEN a > 0 THEN least(16, 11.0::DOUBLE + least(2 * a, 6)) ELSE 11.0::DOUBLE END AS output, CASE WHEN b > 0 THEN least(16, 8.0::DOUBLE + least(2 * b, 6)) ELSE 8.0::DOUBLE END AS scene, 5.0::DOUBLE AS other, CASE WHEN a = 0 AND b = 0 THEN 'cluster' WHEN a >= b THEN 'output' ELSE 'scene' END AS color FROM h""",
    ),
    "gr_table_wins": (
        lambda s, d: T.outperforms(given(s, d, GRIDS), given(s, d, BRANDS)),
        rf"""WITH c AS ({named(GRIDS).replace(' AS STRING', ' AS VARCHAR')}), n AS (SELECT paper, table_id, row, max(CASE WHEN col = 0 THEN CASE WHEN text = 'Ours' THEN paper ELSE 'method:' || split_part(text, ' ', 1) END END) AS id FROM c WHERE row > 0 GROUP BY ALL),
        v AS (SELECT paper, table_id, row, col, CASE col WHEN 1 THEN 'Score ↑' ELSE 'Time (lower)' END AS metric, CAST(nullif(regexp_extract(text, '\d+(\.\d+)?'), '') AS DOUBLE) AS x FROM c WHERE row > 0 AND col > 0 AND text <> '-'),
        g AS (SELECT paper, table_id FROM n GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT id) >= 2), r AS (SELECT v.*, id FROM v JOIN n USING (paper, table_id, row) JOIN g USING (paper, table_id)),
        w AS (SELECT a.id AS src, b.id AS dst, a.metric, a.col = 1 AS higher_is_better, true AS confident, a.x AS winner_value, b.x AS loser_value, round(abs(a.x - b.x) / greatest(abs(a.x), abs(b.x), 1e-6), 4) AS margin, a.paper, a.table_id, a.col, a.row AS i, b.row AS j FROM r a JOIN r b ON a.paper = b.paper AND a.table_id = b.table_id AND a.col = b.col AND a.id <> b.id AND CASE WHEN a.col = 1 THEN a.x > b.x ELSE a.x < b.x END)
        SELECT src, dst, metric, higher_is_better, confident, winner_value, loser_value, margin, paper, table_id FROM w QUALIFY row_number() OVER (PARTITION BY src, dst, metric ORDER BY margin DESC, paper, table_id, col, i, j) = 1""",
    ),
    "wn_merged_groups": (
        lambda s, d: R.merged_groups(given(s, d, GROUPS).groupBy("doc_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("sizes")), 40, 120), None,  # a fold: tested against a plain loop
    ),
    "bm_cards": (cards, f"WITH {_CARDS}"),
}
