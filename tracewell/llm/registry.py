"""The registered queries of the training-data operators."""

from . import ball_kmeans, decontaminate, embedding_dedup, exact_dedup, hard_negatives, html_extract, jaccard_join, language_id, mixing, packing, quality, secret_scan, token_counts

_QUERIES = [
    (secret_scan.op1_secret_scan, None),
    (secret_scan.secret_base_spans, secret_scan.SQL),
    (language_id.op2_language_id, None),
    (quality.op3_quality, None),
    (embedding_dedup.op4_embedding_dedup, embedding_dedup.SQL),
    (packing.op5_packing, None),
    (token_counts.op6_token_counts, None),
    (mixing.op7_mixing, mixing.SQL),
    (html_extract.op8_html_extract, None),
    (exact_dedup.op9_exact_dedup, exact_dedup.SQL),
    (jaccard_join.op10_jaccard_join, jaccard_join.SQL),
    (ball_kmeans.op11_ball_kmeans, ball_kmeans.SQL),
    (hard_negatives.op12_hard_negatives, hard_negatives.SQL),
    (decontaminate.op13_decontaminate, decontaminate.SQL),
]


def queries():
    return {f.__name__: f for f, _ in _QUERIES}


def oracle_sql():
    return {f.__name__: sql for f, sql in _QUERIES if sql}
