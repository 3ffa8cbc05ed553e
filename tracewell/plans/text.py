"""Registered queries over texts, chunks, retrieval and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import retrieval as R
from ..sources.views import CHUNKS, METHODS, RESULTS, chunks, methods, results, table

TERMS = {"thing": 1.0, "ered": 1.0, "with": 1.0, "from": 0.5}
ROLES = {"method": ("(^| )the( |$)", "(^| )with( |$)"), "result": ("(^| )from( |$)", "(^| )that( |$)", "[0-9]"), "limitation": ("(^| )not( |$)", "(^| )nicht( |$)", "(^| )pas( |$)")}


def layered(s, d):
    return table(s, d, "documents").select("doc_id", "text", F.col("source").alias("layer"))


def bm25(s, d):
    return R.top_k(R.bm25(layered(s, d), TERMS, preferred="src1"), 10)


def _tf(i, w):
    return f"CAST(len(list_filter(tokens, lambda t: t = '{w}')) AS BIGINT) AS tf{i}"


_score = " + ".join(f"{w} * ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))" for i, w in enumerate(TERMS.values()))
BM25 = f"""tok AS (SELECT doc_id, source AS layer, regexp_extract_all(lower(text), '[a-z0-9-]+') AS tokens FROM documents),
tfs AS (SELECT doc_id, layer, len(tokens) AS dl, {", ".join(_tf(i, w) for i, w in enumerate(TERMS))} FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avg_dl, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM tfs),
scored AS (SELECT doc_id, layer, round(({_score}) * CASE WHEN layer = 'src1' THEN 1.15::DOUBLE ELSE 1 END, 6) AS score FROM tfs, st),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 10)"""


def vectors(s, d):
    return table(s, d, "embeddings")


def neighbours(s, d, k=5):
    return R.nearest(vectors(s, d), vectors(s, d).where("vec_id % 100 = 0"), k)  # the stated query set


NEAR = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 5)"""


def fused(s, d):
    lexical = bm25(s, d)
    longest = R.top_k(table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), 10)
    return R.reciprocal_rank_fusion([lexical, longest])


def layers(s, d):
    layer = F.when(F.col("tokens") < 20, "fine").when(F.col("tokens") < 80, "mid").otherwise("coarse")
    return chunks(s, d).select("doc_id", "seq", "tokens", layer.alias("layer"))


def overlapping(s, d):
    """Each chunk with the last words of the one before it in its document: 15% of its tokens, at least 10."""
    order = W.partitionBy("doc_id").orderBy("seq")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    rows = chunks(s, d).select("doc_id", "seq", words.alias("words")).withColumn("before", F.lag("words").over(order))
    n = F.least(F.size("before"), F.greatest(F.lit(10), F.floor(F.size("before") * 0.15).cast("int")))
    return rows.where("before IS NOT NULL").select("doc_id", "seq", F.array_join(F.slice("before", F.size("before") - n + 1, n), " ").alias("overlap"))


def term_idf(s, d):
    c = chunks(s, d).select("doc_id", "seq", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1))).alias("term"))
    n = chunks(s, d).agg(F.count(F.lit(1)).alias("n"))
    df = c.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where("df >= 2 AND df <= n / 2")
    return df.select("term", "df", F.round(F.log(F.col("n") / (1 + F.col("df"))), 3).alias("idf")).orderBy(F.desc("df"), "term").limit(200)


def similarity_edges(s, d):
    """Every vector's 5 nearest from 0.2 on, and its 3 nearest of its own label from 0.15 on; one edge of both."""
    v = vectors(s, d)
    near = R.nearest(v, v, 5).where("score >= 0.2").select("query_id", "vec_id", "score")
    label = v.select("vec_id", "label")
    own = R.nearest(v, v, 3, ("label",)).where("score >= 0.15").select("query_id", "vec_id", "score")
    every = near.unionByName(own)
    ends = every.distinct().join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    return ends.select("query_id", "vec_id", "score", (F.col("label") == F.col("query_label")).alias("same_role"))


def budget(s, d):
    ranked = chunks(s, d).withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("tokens"), "seq"))).select("doc_id", "seq", "tokens", "rank")
    return R.token_budget(ranked, 150, "doc_id")


def near_suppressed(s, d):
    return R.suppress_near(chunks(s, d).select("doc_id", "seq", "text", F.col("tokens").cast("double").alias("score"), F.lit("fine").alias("layer"))).select("doc_id", "seq")


def metrics(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return R.ranking_metrics(rows.select(F.col("source").alias("group"), F.col("doc_id").alias("id"), (F.least(F.col("n_chars"), F.lit(4000)) / 4000).alias("score"), F.col("quality").alias("label")))


def followups(s, d):
    """User turns that lean on the turn before: short, or opening with a pronoun-like word; with that turn's first words."""
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = table(s, d, "conversations").withColumn("before", F.lag("text").over(order))
    return rows.where("role = 'user' AND before IS NOT NULL AND (length(text) < 200 OR lower(text) RLIKE '^(and|it|that|this|le|de) ')").select("conv_id", "turn", F.substring("before", 1, 40).alias("about"))


def cell(s, d):
    shape = F.col("l_linenumber") % 5
    n, t = F.col("l_quantity").cast("int").cast("string"), F.col("l_tax").cast("string")
    text = F.when(shape == 0, F.concat(n, F.lit(" . 5 ± "), t)).when(shape == 1, F.concat(n, F.lit("%"))).when(shape == 2, F.lit("N/A")).when(shape == 3, F.concat(n, F.lit(" (3)"))).otherwise(F.concat(F.lit("-"), n))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("cell"))


def parsed(s, d):
    value, deviation, unit = L.cell_value(F.col("cell"))
    return cell(s, d).select("l_orderkey", "l_linenumber", value.alias("value"), deviation.alias("deviation"), unit.alias("unit"))


def _names():
    return F.concat(F.lit("★ (2) "), F.col("p_name"), F.lit(" et al. [3, 4] baseline_v"), F.col("p_size").cast("string"), F.lit("† (N = 12)"))


def _caption():
    n = F.col("p_size")
    parts = [
        F.when(n % 2 == 0, "Real-World runs").otherwise("In simulation"), F.when(n % 3 == 0, "a random viewpoint").when(n % 3 == 1, "one Fixed camera").otherwise("no view"), F.when(n % 5 == 0, "Gamma noise").when(n % 5 == 1, "gaussian noise"),
        F.when(n % 7 == 0, "YCB objects").when(n % 7 == 1, "EGAD set").otherwise("egadx"), F.when(n % 4 == 0, "not re-trained"),
    ]
    return F.concat_ws(", ", *parts)


def _counts(name):
    return " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT)" for p in ROLES[name])


QUERIES = {
    "rt_bm25": (bm25, f"WITH {BM25} SELECT * FROM top"),
    "rt_bm25_scores": (lambda s, d: R.bm25(layered(s, d), TERMS, preferred="src1"), f"WITH {BM25} SELECT * FROM scored WHERE score > 0"),
    "rt_layered_topk": (
        lambda s, d: R.top_k(R.bm25(layered(s, d), TERMS), 3, ["layer"]),
        f"WITH {BM25.replace(' * CASE WHEN layer = ' + chr(39) + 'src1' + chr(39) + ' THEN 1.15::DOUBLE ELSE 1 END', '')} SELECT doc_id, layer, score, row_number() OVER (PARTITION BY layer ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 3",
    ),
    "rt_rrf": (
        fused,
        f"WITH {BM25}, l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10) SELECT doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 8) AS score FROM (SELECT doc_id, rank FROM top UNION ALL SELECT doc_id, rank FROM l) GROUP BY doc_id",
    ),
    "rt_cosine_topk": (neighbours, f"WITH {NEAR} SELECT * FROM near"),
    "ft_similarity_edges": (
        similarity_edges,
        """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score, q.label = v.label AS same_role FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id),
        a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5), b AS (SELECT * FROM p WHERE same_role QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 3)
        SELECT * FROM a WHERE score >= 0.2 UNION SELECT * FROM b WHERE score >= 0.15""",
    ),
    "rt_token_budget": (
        budget,
        f"""WITH {CHUNKS}, r AS (SELECT doc_id, seq, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, seq) AS rank FROM chunks),
        u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY doc_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM r) SELECT * FROM u WHERE used <= 150 OR rank = 1""",
    ),
    "rt_dedupe_near": (
        near_suppressed,
        f"""WITH {CHUNKS}, k AS (SELECT doc_id, seq, tokens, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 240) AS k FROM chunks)
        SELECT doc_id, seq FROM k WHERE k = '' OR NOT EXISTS (SELECT 1 FROM k o WHERE o.doc_id = k.doc_id AND o.seq <> k.seq AND o.k <> '' AND (o.k = k.k OR (length(o.k) >= 5 AND contains(k.k, o.k)) OR (length(k.k) >= 5 AND contains(o.k, k.k))) AND (o.tokens > k.tokens OR (o.tokens = k.tokens AND o.seq < k.seq)))""",
    ),
    "tx_chunks_layers": (layers, f"WITH {CHUNKS} SELECT doc_id, seq, tokens, CASE WHEN tokens < 20 THEN 'fine' WHEN tokens < 80 THEN 'mid' ELSE 'coarse' END AS layer FROM chunks"),
    "tx_sentences": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("seq", "sentence")).select("doc_id", "seq", "sentence"),
        "SELECT doc_id, CAST(i AS INT) AS seq, p[i + 1] AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents), range(len(p)) r(i)",
    ),
    "tx_overlap": (
        overlapping,
        f"""WITH {CHUNKS}, w AS (SELECT doc_id, seq, lag(list_filter(string_split(text, ' '), lambda w: w <> '')) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM chunks)
        SELECT doc_id, seq, array_to_string(b[len(b) - least(len(b), greatest(10, CAST(floor(len(b) * 0.15) AS INT))) + 1 :], ' ') AS overlap FROM w WHERE b IS NOT NULL""",
    ),
    "tx_roles": (
        lambda s, d: chunks(s, d).select("doc_id", "seq", X.role(F.col("text"), ROLES, "general").alias("role")),
        f"""WITH {CHUNKS}, c AS (SELECT doc_id, seq, {_counts('method')} AS a, {_counts('result')} AS b, {_counts('limitation')} AS c FROM chunks)
        SELECT doc_id, seq, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a = greatest(a, b, c) THEN 'method' WHEN b = greatest(a, b, c) THEN 'result' ELSE 'limitation' END AS role FROM c""",
    ),
    "tx_term_idf": (
        term_idf,
        f"""WITH {CHUNKS}, t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}'))) AS term FROM chunks), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM chunks)
        SELECT term, df, round(ln(n / (1 + df)::DOUBLE), 3) AS idf FROM f, n WHERE df >= 2 AND df <= n / 2.0 ORDER BY df DESC, term LIMIT 200""",
    ),
    "tx_snippets": (
        lambda s, d: table(s, d, "documents").select("doc_id", X.snippet(F.col("text"), 240).alias("snippet")),
        "SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE regexp_replace(substr(text, 1, 240), '\\s+\\S*$', '') || '…' END AS snippet FROM documents",
    ),
    "tx_followups": (
        followups,
        "SELECT conv_id, turn, substr(b, 1, 40) AS about FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE role = 'user' AND b IS NOT NULL AND (length(text) < 200 OR regexp_matches(lower(text), '^(and|it|that|this|le|de) '))",
    ),
    "str_parse_value": (
        parsed,
        """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN CAST(l_quantity AS INT) + 0.5::DOUBLE WHEN 1 THEN CAST(l_quantity AS INT)::DOUBLE WHEN 3 THEN CAST(l_quantity AS INT)::DOUBLE WHEN 4 THEN -CAST(l_quantity AS INT)::DOUBLE END AS value,
        CASE WHEN l_linenumber % 5 = 0 THEN l_tax END AS deviation, CASE WHEN l_linenumber % 5 = 1 THEN '%' END AS unit FROM lineitem""",
    ),
    "str_names": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.slug(_names()).alias("slug"), X.compact(_names()).alias("compact"), L.registry_key(_names()).alias("registry"), L.method_name(F.concat(F.lit("2) "), "p_name", F.lit(" et al. [3, 4]  v"), F.col("p_size").cast("string"), F.lit("† ,"))).alias("clean")),
        """SELECT p_partkey, '2-' || replace(p_name, ' ', '-') || '-et-al-3-4-baseline-v' || p_size || '-n-12' AS slug, '2' || replace(p_name, ' ', '') || 'etal34baselinev' || p_size || 'n12' AS compact,
        '★ 2 ' || p_name || ' et al. v' || p_size AS registry, p_name || ' v' || p_size AS clean FROM part""",
    ),
    "str_protocol_tokens": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(L.protocol_tokens(F.lit(None).cast("string"), _caption()), ",").alias("tokens")),
        """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'real' ELSE 'sim' END, CASE p_size % 3 WHEN 0 THEN 'randomview' WHEN 1 THEN 'fixedview' END, CASE p_size % 5 WHEN 0 THEN 'gammanoise' WHEN 1 THEN 'gaussnoise' END, CASE p_size % 7 WHEN 0 THEN 'ycb' WHEN 1 THEN 'egad' END, CASE WHEN p_size % 4 = 0 THEN 'noretrain' END) AS tokens FROM part""",
    ),
    "str_stems": (
        lambda s, d: table(s, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))).alias("w")).select("w").distinct().select("w", X.stem(F.col("w")).alias("stem")),
        """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT w, CASE WHEN w LIKE '%ing' AND length(w) > 6 THEN left(w, -3) WHEN w LIKE '%ies' AND length(w) > 5 THEN left(w, -3) || 'y'
        WHEN w LIKE '%ed' AND length(w) > 5 THEN left(w, -2) WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, -2) WHEN w LIKE '%s' AND length(w) > 4 AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END AS stem FROM t""",
    ),
    "ft_tfidf_column": (
        lambda s, d: R.tf_idf(methods(s, d), "method_id", "words"),
        f"""WITH {METHODS}, t AS (SELECT method_id, word, count(*) AS tf FROM (SELECT method_id, unnest(words) AS word FROM methods) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM t GROUP BY word), n AS (SELECT count(*) AS n FROM methods),
        w AS (SELECT method_id, word, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN f USING (word), n) SELECT method_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY method_id)), 6) AS weight FROM w""",
    ),
    "ml_ranking_metrics": (
        metrics,
        """WITH r AS (SELECT source AS "group", doc_id AS id, least(n_chars, 4000) / 4000.0::DOUBLE AS score, quality AS label FROM labels JOIN documents USING (doc_id)),
        k AS (SELECT *, row_number() OVER w AS rank, sum(label) OVER (PARTITION BY "group" ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS seen, rank() OVER (PARTITION BY "group" ORDER BY score) AS low, count(*) OVER (PARTITION BY "group", score) AS same FROM r WINDOW w AS (PARTITION BY "group" ORDER BY score DESC, id)),
        a AS (SELECT "group", sum(label)::DOUBLE AS pos, count(*) AS n, sum(CASE WHEN label = 1 THEN low + (same - 1) / 2.0::DOUBLE END) AS s, avg(CASE WHEN label = 1 THEN seen / rank::DOUBLE END) AS ap, min(CASE WHEN label = 1 THEN rank END) AS f,
          sum(CASE WHEN label = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN label = 1 AND seen <= 10 THEN 1 / log2(seen + 1) ELSE 0 END), 0) AS g,
          sum(CASE WHEN score >= 0.5 THEN label ELSE 0 END)::DOUBLE AS hit, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS claimed, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1 ELSE 0 END) AS acc,
          sum(CASE WHEN rank <= 1 THEN label ELSE 0 END) / 1.0::DOUBLE AS h1, sum(CASE WHEN rank <= 5 THEN label ELSE 0 END) / 5.0::DOUBLE AS h5, sum(CASE WHEN rank <= 10 THEN label ELSE 0 END) / 10.0::DOUBLE AS h10 FROM k GROUP BY "group")
        SELECT "group", round((s - pos * (pos + 1) / 2) / nullif(pos * (n - pos), 0), 6) AS auc, round(ap, 6) AS average_precision, round(1.0::DOUBLE / f, 6) AS mrr, round(hit / nullif(claimed, 0), 6) AS precision, round(hit / nullif(pos, 0), 6) AS recall, round(2 * hit / nullif(claimed + pos, 0), 6) AS f1, round(acc, 6) AS accuracy,
        round(h1, 6) AS hits_at_1, round(h5, 6) AS hits_at_5, round(h10, 6) AS hits_at_10, round(g, 6) AS ndcg_at_10 FROM a""",
    ),
}
