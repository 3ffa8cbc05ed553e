"""Registered queries of sources and of name, quote and number resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution as R
from ..sources import files
from ..sources.views import CHUNKS, chunks, table
from .given import given


def resolved(s, d):
    part = table(s, d, "part")
    registry = part.select("p_name", F.col("p_name").alias("method"), F.col("p_name").alias("name")).distinct()
    spelled = part.select(F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.regexp_replace("p_name", " ", "")).otherwise(F.concat(F.lit("our "), "p_name", F.lit(" (N = 3) tuned"))).alias("mention"))
    return R.resolve_methods(spelled, registry)


def grounded(s, d):
    rows = table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("scored "), F.col("l_quantity").cast("string"), F.lit(" of 7 in 1999, at "), F.col("l_discount").cast("string")).alias("answer"),
        F.concat(F.lit("table: "), F.col("l_quantity").cast("int").cast("string"), F.lit(" and 0.05")).alias("evidence"),
    )
    return rows.select("l_orderkey", "l_linenumber", F.array_join(R.ungrounded_numbers(F.col("answer"), F.col("evidence")), ",").alias("missing"))


def spelled(s, d):
    words = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    wrong = words.select(F.explode(F.array(F.concat(F.substring("w", 1, 2), F.lit("q"), F.expr("substr(w, 4)")), F.concat(F.lit("X"), F.expr("substr(w, 2)")), F.upper(F.concat("w", F.lit("z"))))).alias("word"))
    return R.corrected(wrong, words.select(F.col("w").alias("word")))


ACRONYMS = """SELECT p_partkey AS doc_id, CASE p_size % 5 WHEN 0 THEN concat('We use the Convolutional Neural ', initcap(p_type), 's (CN', substring(p_type, 1, 1), ') here') WHEN 1 THEN concat('a PB', substring(p_type, 1, 1), ' (Position Based ', initcap(p_type), ') is')
  WHEN 2 THEN concat('PBVS', substring(p_type, 1, 1), ', or Position Based Visual Servoing, works') WHEN 3 THEN 'no words of it (ZZZ) here' ELSE 'Some Other Words (QQQ) here' END AS text FROM {part}"""


QUERIES = {
    "src_page_structure": (
        lambda s, d: files.page_structure(table(s, d, "pages")),
        """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
        CAST(len(regexp_extract_all(html, '<a ')) AS INT) AS n_links, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS n_paragraphs FROM pages""",
    ),
    "jn_resolve_methods": (
        resolved,
        """SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '') ELSE 'our ' || p_name || ' (N = 3) tuned' END AS mention, p_name AS method,
        CASE p_size % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'compact' ELSE 'contained' END AS how FROM part""",
    ),
    "tx_verify_quote": (
        lambda s, d: R.verified_quotes(table(s, d, "benchmark"), table(s, d, "documents")),
        """WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q FROM benchmark), b AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS b FROM documents)
        SELECT doc_id, item_id FROM b JOIN q ON contains(b, q) WHERE length(q) >= 15""",
    ),
    "tx_ungrounded_numbers": (
        grounded,
        """WITH r AS (SELECT l_orderkey, l_linenumber, list_transform([CAST(l_quantity AS VARCHAR), '7', '1999', CAST(l_discount AS VARCHAR)], lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(x, '\\.?0+$', '') ELSE x END) AS a,
        [CAST(CAST(l_quantity AS INT) AS VARCHAR), '0.05'] AS e FROM lineitem)
        SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(e, x) AND NOT regexp_matches(x, '^(19|20)\\d\\d$') AND NOT regexp_matches(x, '^(\\d|10)$')))), ',') AS missing FROM r""",
    ),
    "str_levenshtein_correct": (
        spelled,
        """WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), x AS (SELECT substr(w, 1, 2) || 'q' || substr(w, 4) AS word FROM v UNION SELECT 'X' || substr(w, 2) FROM v UNION SELECT upper(w || 'z') FROM v),
        d AS (SELECT word, w, levenshtein(lower(word), w) AS distance FROM x JOIN v ON levenshtein(lower(word), w) <= CASE WHEN length(word) <= 4 THEN 1 WHEN length(word) <= 7 THEN 2 ELSE 3 END WHERE lower(word) NOT IN (SELECT w FROM v))
        SELECT word, CASE WHEN length(word) > 1 AND left(word, 1) = upper(left(word, 1)) AND substr(word, 2) = lower(substr(word, 2)) THEN upper(left(w, 1)) || substr(w, 2) WHEN length(word) > 1 AND word = upper(word) THEN upper(w) ELSE w END AS fixed, CAST(distance AS INT) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, w) = 1""",
    ),
    "tx_acronyms": (
        lambda s, d: R.acronyms(given(s, d, ACRONYMS)),
        """WITH a AS (SELECT p_partkey, left(p_type, 1) AS c, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS t, p_size % 5 AS k FROM part), x AS (SELECT p_partkey, CASE k WHEN 0 THEN 'CN' || c WHEN 1 THEN 'PB' || c ELSE 'PBVS' || c END AS acronym, CASE k WHEN 0 THEN 'Convolutional Neural ' || t || 's' WHEN 1 THEN 'Position Based ' || t ELSE 'Position Based Visual Servoing' END AS f FROM a WHERE k < 3)
        SELECT acronym, arg_min(f, p_partkey) AS full_form, count(*) AS n FROM x GROUP BY acronym""",
    ),
    "jn_mentions": (
        lambda s, d: R.mentions(table(s, d, "documents"), table(s, d, "part").select(F.explode(F.array(F.lit("the"), F.lit("que"), F.lit("und"), F.split("p_name", " ")[0])).alias("alias"))),
        """WITH a AS (SELECT 'the' AS alias UNION SELECT 'que' UNION SELECT 'und' UNION SELECT string_split(p_name, ' ')[1] FROM part), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS alias FROM documents)
        SELECT doc_id, alias, count(*) AS n FROM w WHERE alias IN (SELECT alias FROM a) GROUP BY ALL""",
    ),
    "tx_pack_mid": (
        lambda s, d: R.packed(chunks(s, d), 120),
        f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT doc_id, seq, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM chunks),
        f AS (SELECT doc_id, i, seq, tokens, CAST(0 AS INT) AS pack, tokens AS held FROM o WHERE i = 1
          UNION ALL SELECT o.doc_id, o.i, o.seq, o.tokens, CASE WHEN f.held + o.tokens <= 120 THEN f.pack ELSE f.pack + 1 END, CASE WHEN f.held + o.tokens <= 120 THEN f.held + o.tokens ELSE o.tokens END FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
        SELECT doc_id, pack, min(seq) AS first, max(seq) AS last, CAST(sum(tokens) AS INT) AS tokens FROM f GROUP BY doc_id, pack""",
    ),
}
