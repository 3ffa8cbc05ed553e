"""Registered queries of prose rules, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions import text as X
from ..sources.views import CHUNKS, chunks
from .given import given, named

#: What follows a paragraph, by its place; the corpus itself has little of what the rules look for.
TAILS = (
    " We propose our method, unlike prior work (Smith et al., 2020) [12].", " Results show that we achieve x = 3 + y * 12 - z over the baseline. See table 2.", " However it does not improve [1, 2], [3], [4] and [5] (Lee et al., 2019).",
    " mail: ann@example.org", " $a+b$ and $c$ and $d$; we define it formally.", " It builds on and extends (Lee, 2019) and (Adams and Brown, 2021).", " The goal is to grasp in clutter; a limitation is the failure of step 2.", " We evaluate on one dataset, training details follow.",
    "", " pages 12 arXiv isbn [1] [2] [3] [4] Conference on", " Ann Bee * Carl Dee * MIT Lab", " | a | b |\n|---|---|\n| 1 | 2 |",
)
_TAIL = "CASE (doc_id + seq) % 12 " + " ".join("WHEN {} THEN '{}'".format(i, t.replace("\n", "' || chr(10) || '")) for i, t in enumerate(TAILS)) + " END"
PROSE = f"{CHUNKS}, prose AS (SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN text ELSE substr(text, 1, 90) END || {_TAIL} AS text, CASE seq % 5 WHEN 0 THEN 'Experiments' WHEN 1 THEN '2. Method' WHEN 2 THEN 'Implementation details' WHEN 3 THEN 'Table of runs' ELSE 'Other' END AS section FROM chunks)"
LINES = """SELECT p_partkey, CASE p_size % 14 WHEN 0 THEN '12' WHEN 1 THEN 'ETH Zurich' WHEN 2 THEN '3.1 Dynamics Model' WHEN 3 THEN 'Related Work:' WHEN 4 THEN 'IV. Results' WHEN 5 THEN 'ann@example.org' WHEN 6 THEN 'arXiv:2101.01234v2 [cs.RO] 4 Jan 2021' WHEN 7 THEN 'Preprint of things'
  WHEN 8 THEN '4 Department of Things' WHEN 9 THEN concat('this line is about ', p_name, ' and says so.') WHEN 10 THEN 'B. Runs' WHEN 11 THEN 'A. Nguyen, "Open words"' WHEN 12 THEN concat('big ', p_name) ELSE 'write to me: bob@example.org now' END AS line, CAST(CASE WHEN p_partkey % 3 = 0 THEN 12 ELSE 10 END AS DOUBLE) AS size FROM {part}"""
RAW = "SELECT p_partkey, concat('  a ﬁne ﬂow of chal-', chr(10), ' lenging  ', p_name, ' and co- op', chr(10), chr(10), chr(10), chr(10), 'end', chr(9), 'x  ') AS text FROM {part}"
QUERIES_ASKED = """SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'Which methods are suitable for clutter?' WHEN 1 THEN 'Compare GPD versus VGN' WHEN 2 THEN 'What limits it, which methods fail' WHEN 3 THEN 'show me the best accuracy' WHEN 4 THEN 'its loss and backbone' WHEN 5 THEN 'Who made it' WHEN 6 THEN concat('I need ', p_name) ELSE 'tell me more' END AS query FROM {part}"""
MARKED = "SELECT doc_id, concat(substring(text, 1, 400), ' [7] ', substring(text, 401, 300)) AS text, '[7]' AS marker FROM {documents}"
LABELS = "SELECT p_partkey, substring(concat(p_name, ' is a thing of which much more could be said than would fit into a label of its node '), 1, 45) AS label, substring(concat(p_name, ' is a thing of which much more could be said than would fit into a label of its node '), 1, 40 + p_size * 2) AS value FROM {part}"
ANSWERS = "SELECT p_partkey, concat('PointNet and GPD beat ', upper(p_type), ', not ', p_name, ' or YoloX') AS answer FROM {part}"
TABLE = "SELECT p_partkey, concat('Table ', CAST(p_size AS STRING), ': runs', chr(10), '| name | ', p_type, ' |', chr(10), '|---|:--|', chr(10), '| ', p_name, CASE WHEN p_size % 2 = 0 THEN ' | 1 | extra |' ELSE ' |' END) AS text, CASE WHEN p_size % 3 = 0 THEN 'Tables' ELSE '' END AS section FROM {part}"


def prose(s, d):
    tail = F.coalesce(*[F.when((F.col("doc_id") + F.col("seq")) % 12 == i, F.lit(t)) for i, t in enumerate(TAILS)])
    section = F.element_at(F.array(*map(F.lit, ("Experiments", "2. Method", "Implementation details", "Table of runs", "Other"))), (F.col("seq") % 5 + 1).cast("int"))
    return chunks(s, d).select("doc_id", "seq", F.concat(F.when(F.col("seq") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 90)), tail).alias("text"), section.alias("section"))


def _rows(*columns):
    return lambda s, d: prose(s, d).select("doc_id", "seq", *[c() for c in columns])


def _count(p, text="text"):
    return f"len(regexp_extract_all({text}, '{p}'))"


def _score(cues):
    return " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT)" for p in cues)


_N = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_ROLE_SCORES = ", ".join(f"{_score(ps)} AS {name}" for name, ps in P.ROLES.items())
_ROLE = "CASE WHEN greatest({0}) = 0 THEN 'general' {1} END".format(", ".join(P.ROLES), " ".join(f"WHEN {r} = greatest({', '.join(P.ROLES)}) THEN '{r}'" for r in P.ROLES))
_CONTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(section), '{p}') THEN '{t}'" for t, p in P.CONTENT_OF_SECTION) + " " + " ".join(f"WHEN role = '{r}' THEN '{t}'" for r, t in P.CONTENT_OF_ROLE.items()) + " ELSE 'general' END"
_EQUATION = P.EQUATION.replace("(?s)", "")
_NOISE = rf"(l <> '' AND (regexp_matches(l, '^arXiv:\d{{4}}\.\d+v?\d*\s*\[.*?\]\s*\d+\s+\w+\s+\d{{4}}$') OR regexp_matches(l, '^(?:IEEE\s+TRANSACTIONS\s+ON|Proceedings\s+of|JOURNAL\s+OF\s+LATEX\s+CLASS\s+FILES|Accepted\s+in|Published\s+in|Preprint)', 'i') OR regexp_matches(l, '^\d{{1,3}}$') OR regexp_matches(l, '^{P.EMAIL}$') OR (regexp_matches(l, '{P.EMAIL}') AND length(l) < 60) OR length(l) <= 3 OR (length(l) < 40 AND NOT regexp_matches(l, '[.!?:;]') AND NOT regexp_matches(l, '\d{{4}}') AND len(string_split(l, ' ')) <= 5 AND len(list_filter(string_split(l, ' '), lambda w: NOT regexp_matches(w, '^[A-Z]|^[^A-Za-zÀ-ÿ]'))) = 0)))"

_REF = r"\[\d{1,3}\]"

QUERIES = {
    "src_clean_text": (lambda s, d: given(s, d, RAW).select("p_partkey", P.clean_extracted(F.col("text")).alias("text")), "SELECT p_partkey, 'a fine flow of challenging ' || p_name || ' and coop' || chr(10) || chr(10) || 'end x' AS text FROM part"),
    "src_noise_lines": (lambda s, d: given(s, d, LINES).select("p_partkey", P.noise_line(F.col("line")).alias("noise")), f"SELECT p_partkey, {_NOISE} AS noise FROM (SELECT p_partkey, trim(line) AS l FROM ({named(LINES)}))"),
    "src_header_lines": (
        lambda s, d: given(s, d, LINES).select("p_partkey", P.header_level(F.col("line"), F.col("size"), F.lit(10.0)).alias("level")),
        "SELECT p_partkey, CASE p_size % 14 WHEN 2 THEN CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 10 THEN 1 WHEN 11 THEN CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END WHEN 12 THEN CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS level FROM part",
    ),
    "src_section_types": (
        lambda s, d: given(s, d, "SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'Abstract' WHEN 1 THEN '1. Introduction' WHEN 2 THEN ' Prior  work ' WHEN 3 THEN 'Our model and results' WHEN 4 THEN 'Empirical study' WHEN 5 THEN 'Error analysis' WHEN 6 THEN 'Discussion' WHEN 7 THEN 'Bibliography' ELSE p_name END AS title FROM {part}").select("p_partkey", P.section_type(F.col("title")).alias("kind")),
        "SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'abstract' WHEN 1 THEN 'introduction' WHEN 2 THEN 'related_work' WHEN 3 THEN 'method' WHEN 4 THEN 'experiments' WHEN 5 THEN 'ablation' WHEN 6 THEN 'limitations' WHEN 7 THEN 'references' ELSE 'other' END AS kind FROM part",
    ),
    "src_table_grids": (
        lambda s, d: given(s, d, TABLE).select("p_partkey", P.table_grid(F.col("text")).alias("g")).select("p_partkey", F.array_join(F.transform("g", lambda r: F.array_join(r, ",")), ";").alias("grid"), F.array_join(P.table_lines(F.col("g"), F.size(F.col("g")[0])), "\n").alias("text")),
        "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'name,' || p_type || ',;' || p_name || ',1,extra' ELSE 'name,' || p_type || ';' || p_name || ',' END AS grid, CASE WHEN p_size % 2 = 0 THEN '| name | ' || p_type || ' |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || p_name || ' | 1 | extra |' ELSE '| name | ' || p_type || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' |  |' END AS text FROM part",
    ),
    "src_ablation_tables": (
        lambda s, d: given(s, d, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Ablating parts' WHEN 1 THEN 'Main runs' ELSE 'Components removed' END AS caption, CASE WHEN p_size % 5 = 0 THEN 'Ablation' ELSE 'Results' END AS section, p_name AS header FROM {part}").select("p_partkey", P.ablation(F.col("caption"), F.col("section"), F.col("header"), ("ablation", "removed")).alias("is_ablation")),
        "SELECT p_partkey, p_size % 4 <> 1 OR p_size % 5 = 0 AS is_ablation FROM part",
    ),
    "tx_rhetorical_roles": (
        _rows(lambda: X.role(F.col("text"), P.ROLES, "general").alias("role"), lambda: P.content_type(X.role(F.col("text"), P.ROLES, "general"), F.col("section")).alias("content")),
        f"WITH {PROSE}, s AS (SELECT doc_id, seq, section, {_ROLE_SCORES} FROM prose), r AS (SELECT doc_id, seq, section, {_ROLE} AS role FROM s) SELECT doc_id, seq, role, {_CONTENT} AS content FROM r",
    ),
    "tx_chunk_types": (
        _rows(lambda: P.chunk_type(F.col("text")).alias("kind")),
        f"WITH {PROSE}, c AS (SELECT doc_id, seq, {_N} AS n, {_count(_EQUATION)} AS e, {_count(P.CITATION)} AS c FROM prose) SELECT doc_id, seq, CASE WHEN n = 0 THEN 'plain' WHEN e / n::DOUBLE > 0.02 OR e >= 3 THEN 'equation' WHEN c / n::DOUBLE > 0.03 OR c >= 4 THEN 'citation_context' ELSE 'plain' END AS kind FROM c",
    ),
    "tx_inline_citations": (
        _rows(lambda: F.array_join(P.inline_citations(F.col("text")), ";").alias("citations"), lambda: P.sentiment(F.col("text")).alias("sentiment")),
        f"""WITH {PROSE}, c AS (SELECT doc_id, seq, {_score(P.POSITIVE_CUES)} AS p, {_score(P.NEGATIVE_CUES)} AS n, regexp_extract_all(text, '{P.AUTHOR_YEAR}') AS x FROM prose)
        SELECT doc_id, seq, array_to_string(list_filter(x, lambda y, i: list_position(x, y) = i), ';') AS citations, CASE WHEN p = 0 AND n = 0 THEN 'neutral' WHEN p >= n THEN 'builds_on' ELSE 'differs_from' END AS sentiment FROM c""",
    ),
    "ft_valid_chunks": (
        _rows(lambda: P.valid_chunk(F.col("text")).alias("valid")),
        rf"""WITH {PROSE}, w AS (SELECT doc_id, seq, trim(text) AS text, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS w FROM prose), f AS (SELECT *, len(w) AS n, {_count(_REF)} + {_count('arxiv', 'lower(text)')} + {_count('isbn', 'lower(text)')} + {_count('pages' + chr(92) + 's+' + chr(92) + 'd+')} + {_count('In' + chr(92) + 's+' + chr(92) + 'd{4}' + chr(92) + 's+' + chr(92) + 'w+')} + {_count('Conference on')} AS sg FROM w)
        SELECT doc_id, seq, n > 15 AND NOT (regexp_matches(text, '{P.EMAIL}') AND length(trim(regexp_replace(text, '{P.EMAIL}', '', 'g'))) < 50) AND NOT (n < 80 AND len(list_filter(w, lambda x: length(x) <= 4)) / n::DOUBLE > 0.7) AND NOT (sg > 4 AND sg / greatest(n / 10::DOUBLE, 1.0) > 0.3) AND NOT (NOT contains(text, '.') AND length(text) < 100)
        AND NOT (n BETWEEN 5 AND 60 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-ZÀ-Þ]'))) / n::DOUBLE > 0.6 AND NOT regexp_matches(lower(text), '{P.SENTENCE_WORDS}') AND ({_count(chr(92) + '*')} >= 2 OR regexp_matches(text, '{P.AFFILIATION}'))) AS valid FROM f""",
    ),
    "ft_table_texts": (
        _rows(lambda: P.looks_like_table(F.col("text"), F.col("section")).alias("is_table")),
        rf"""WITH {PROSE}, l AS (SELECT *, string_split(text, chr(10)) AS l FROM prose) SELECT doc_id, seq, NOT regexp_matches(text, '\\begin|\\frac|\$\$') AND ((len(list_filter(l, lambda x: regexp_matches(x, '^\s*\|?[\s:|-]*-{{3,}}[\s:|-]*$'))) > 0 AND len(list_filter(l, lambda x: contains(x, '|'))) >= 2) OR (starts_with(lower(section), 'table') AND len(list_filter(l, lambda x: contains(x, '|'))) >= 3)) AS is_table FROM l""",
    ),
    "tx_topics": (
        _rows(lambda: F.array_join(P.topics(F.col("text"), ("baseline", "grasp in clutter", "method", "grasp", "table")), ",").alias("topics")),
        f"WITH {PROSE} SELECT doc_id, seq, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '\\bbaseline\\b') THEN 'baseline' END, CASE WHEN contains(lower(text), 'grasp in clutter') THEN 'grasp in clutter' END, CASE WHEN regexp_matches(lower(text), '\\bmethod\\b') THEN 'method' END, CASE WHEN regexp_matches(lower(text), '\\bgrasp\\b') THEN 'grasp' END, CASE WHEN regexp_matches(lower(text), '\\btable\\b') THEN 'table' END], lambda x: x IS NOT NULL), ',') AS topics FROM prose",
    ),
    "tx_citation_contexts": (
        lambda s, d: given(s, d, MARKED).select("doc_id", P.citation_context(F.col("text"), F.col("marker")).alias("context")),
        rf"""WITH m AS (SELECT doc_id, text, strpos(text, '[7]') AS a FROM ({named(MARKED)})), w AS (SELECT *, greatest(1, a - 200) AS b, substr(text, greatest(1, a - 200), a - greatest(1, a - 200) + 203) AS x FROM m),
        o AS (SELECT *, length(regexp_extract(x, '^(?s:.*?)[.?!]\s+')) AS l, strpos(x, ' ') AS sp FROM w), p AS (SELECT doc_id, CASE WHEN b = 1 THEN x WHEN l > 0 AND l < length(x) * 0.5 THEN substr(x, l + 1) WHEN sp BETWEEN 2 AND 20 THEN substr(x, sp + 1) ELSE x END AS y FROM o),
        q AS (SELECT *, length(regexp_extract(y, '^((?s:.*)[.?!]) ', 1)) AS e FROM p) SELECT doc_id, replace(CASE WHEN e - 1 > length(y) * 0.5 THEN substr(y, 1, e) ELSE y END, '[7]', '【[7]】') AS context FROM q""",
    ),
    "str_intents": (
        lambda s, d: given(s, d, QUERIES_ASKED).select("p_partkey", P.intent(F.col("query")).alias("intent"), P.should_filter(F.col("query")).alias("filters")),
        "SELECT p_partkey, CASE p_size % 8 WHEN 1 THEN 'COMPARISON' WHEN 2 THEN 'LIMITATION' WHEN 3 THEN 'EVALUATION' WHEN 4 THEN 'TECHNICAL' WHEN 5 THEN 'PEOPLE' ELSE 'BROAD' END AS intent, p_size % 8 IN (0, 2, 3, 6) AS filters FROM part",
    ),
    "snk_full_labels": (
        lambda s, d: given(s, d, LABELS).select("p_partkey", P.full_label(F.col("label"), F.col("value")).alias("label")),
        f"SELECT p_partkey, CASE WHEN length(value) > length(label) AND substr(label, 1, 40) = substr(value, 1, 40) THEN CASE WHEN length(value) <= 90 THEN value ELSE regexp_replace(substr(value, 1, 90), '\\s+\\S*$', '') || '…' END ELSE label END AS label FROM ({named(LABELS)})",
    ),
    "str_table_captions": (lambda s, d: given(s, d, TABLE).select("p_partkey", P.table_caption(F.col("text"), F.col("section")).alias("caption"), P.table_caption(F.lit("first line\nmore"), F.col("section")).alias("other")), "SELECT p_partkey, 'Table ' || p_size || ': runs' AS caption, CASE WHEN p_size % 3 = 0 THEN 'Tables' ELSE 'first line' END AS other FROM part"),
    "str_short_hashes": (
        lambda s, d: given(s, d, "SELECT p_partkey, p_name, p_size FROM {part}").select("p_partkey", P.short_hash(F.col("p_name")).alias("short"), P.salt(F.col("p_name"), F.col("p_size")).alias("salt")),
        "SELECT p_partkey, substr(md5(p_name), 1, 8) AS short, substr(sha256('[\"' || p_name || '\",\"' || p_size || '\"]'), 1, 16) AS salt FROM part",
    ),
    "str_ungrounded_names": (
        lambda s, d: given(s, d, ANSWERS).select("p_partkey", F.array_join(P.ungrounded_names(F.col("answer"), F.array(F.lit("GPD"), F.lit("PROMO"))), ",").alias("names")),
        "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'PointNet,YoloX' WHEN p_type < 'PointNet' THEN upper(p_type) || ',PointNet,YoloX' ELSE 'PointNet,' || upper(p_type) || ',YoloX' END AS names FROM part",
    ),
    "str_query_weights": (
        lambda s, d: given(s, d, "SELECT p_partkey, CAST(p_size % 17 AS DOUBLE) AS weight, p_size % 5 AS hits FROM {part}").select("p_partkey", P.adjusted_weight(F.col("weight"), F.col("hits")).alias("weight")),
        "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN least(16.0, p_size % 17 + least(2 * (p_size % 5), 6)) ELSE greatest(2.0, round((p_size % 17) * 0.7::DOUBLE)) END AS weight FROM part",
    ),
}
