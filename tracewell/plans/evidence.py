"""Registered queries over result records, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import evidence as E
from ..session import staged
from ..sources.views import RESULTS, results, table

_CELL = "metric, dataset, condition"
# per method and cell, over all values; a grade needs all of: a known extraction, a check, little spread for the metric's type
_EVIDENCE = f"""ev AS (SELECT *, CASE WHEN same THEN 'identical_values_suspected_copy' WHEN said THEN 'caption_copied_baseline' ELSE 'independent' END AS corroboration, CASE WHEN cv <= bound THEN 'consistent' ELSE 'high_variance' END AS status,
   CASE WHEN NOT sound OR cv > bound THEN 'C' WHEN n_papers >= 2 AND NOT same AND NOT said THEN 'A' ELSE 'B' END AS grade
   FROM (SELECT *, n_papers >= 2 AND least_v = most_v AND least_s = most_s AND n_s = n AS same, CASE kind WHEN 'rate' THEN 0.10 WHEN 'time' THEN 0.20 ELSE 0.15 END AS bound FROM
   (SELECT method, {_CELL}, max(kind) AS kind, count(DISTINCT paper) AS n_papers, avg(value) AS mean, CASE WHEN count(value) < 2 OR avg(value) = 0 THEN 0.0 ELSE stddev_pop(value) / abs(avg(value)) END AS cv, count(value) AS n, bool_or(copied) AS said,
   min(value) AS least_v, max(value) AS most_v, min(std) AS least_s, max(std) AS most_s, count(std) AS n_s, bool_or(verified) AND max(confidence) <> 'low' AS sound FROM results GROUP BY method, {_CELL})))"""
_SURE = "round(CASE grade WHEN 'A' THEN 0.92 WHEN 'B' THEN 0.78 ELSE 0.45 END * (1 - 0.3 * least(round(cv, 3), 1.0)), 2) AS confidence"
_BOARD = f"""per_paper AS (SELECT {_CELL}, method, paper, median(value) AS rep FROM results GROUP BY ALL),
heads AS (SELECT {_CELL}, method, round(median(rep), 2) AS value, round(max(rep), 2) AS hi, round(min(rep), 2) AS lo FROM per_paper GROUP BY ALL),
board AS (SELECT {_CELL}, row_number() OVER (PARTITION BY {_CELL} ORDER BY CASE WHEN metric <> 'ECONOMY' THEN -value ELSE value END, method) AS rank, method, value,
   CASE WHEN metric <> 'ECONOMY' THEN hi ELSE lo END AS best, n_papers AS n_reports, round(cv, 6) AS cv, grade, {_SURE}, corroboration
   FROM heads JOIN ev USING ({_CELL}, method) QUALIFY count(*) OVER (PARTITION BY {_CELL}) >= 2)"""
_VALID = f"""validated AS (SELECT method, {_CELL}, n_papers, round(mean, 6) AS mean, round(cv, 6) AS cv, status, grade, {_SURE}, CASE WHEN same THEN corroboration ELSE 'independent' END AS corroboration FROM ev WHERE n_papers >= 2)"""
BOARD = f"{RESULTS}, {_EVIDENCE}, {_BOARD}"
VALID = f"{RESULTS}, {_EVIDENCE}, {_VALID}"
BOTH = f"{RESULTS}, {_EVIDENCE}, {_BOARD}, {_VALID}"
WINS = f"""wins AS (SELECT o.paper, o.metric, o.dataset, o.condition, o.method AS winner, x.method AS loser, round(abs(o.value - x.value), 2) AS margin, o.record_id AS own_id, x.record_id AS other_id
  FROM results o JOIN results x ON o.paper = x.paper AND o.metric = x.metric AND o.dataset = x.dataset AND o.condition = x.condition
  WHERE o.is_own AND NOT x.is_own AND o.method <> x.method AND CASE WHEN o.higher_is_better THEN o.value > x.value ELSE o.value < x.value END)"""
CHOSEN = {"metric": ["PROMO", "SMALL"], "condition": ["a:f", "n:o"]}


def _priority(df):
    return df.withColumn("priority", F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1))


def wilson(s, d):
    lo, hi = stats.wilson(F.col("n_good"), F.col("n"))
    return table(s, d, "labels").groupBy(F.col("toxic")).agg(F.sum("quality").alias("n_good"), F.count("quality").alias("n")).select("toxic", "n_good", "n", F.round(lo, 8).alias("low"), F.round(hi, 8).alias("high"))


def trust(s, d):
    t = stats.trust_score(F.col("c_acctbal") / 10000, F.lit(0.92), F.lit(0.5))
    return table(s, d, "customer").select("c_custkey", F.round(t, 6).alias("trust"), F.round(0.25 + 0.75 * t, 6).alias("opacity"))


def found_cells(s, d):
    """Records are joined and written once; leaderboard, validations and wins each read them from there."""
    rows = staged(results(s, d))
    return E.cells(E.leaderboard(rows), E.cross_validation(rows), E.pairwise_wins(rows))


def nearest(s, d, asked):
    """Conditions of two, one and no facets; those of the second flag also under the name that another paper uses."""
    rows = staged(results(s, d)).withColumn("condition", F.expr("CASE condition WHEN 'a:f' THEN 'pile:gsr' WHEN 'n:f' THEN 'simulation' WHEN 'n:o' THEN 'gsr:pile' WHEN 'r:f' THEN NULL ELSE condition END"))
    boards = staged(E.leaderboard(rows))
    return E.nearest_cells(E.cells(boards, E.cross_validation(rows), E.pairwise_wins(rows)), boards, "PROMO", asked).withColumn("differs_by", F.array_join("differs_by", ","))


FACETED = f"""{BOARD.replace("lower(l_returnflag) || ':' || lower(l_linestatus)", "CASE lower(l_returnflag) || ':' || lower(l_linestatus) WHEN 'a:f' THEN 'pile:gsr' WHEN 'n:f' THEN 'simulation' WHEN 'n:o' THEN 'gsr:pile' WHEN 'r:f' THEN '' ELSE lower(l_returnflag) || ':' || lower(l_linestatus) END")},
n AS (SELECT metric, dataset, nullif(condition, '') AS condition, count(*) AS n_methods, CASE WHEN condition IN ('pile:gsr', 'gsr:pile') THEN [] ELSE ['Scene', 'Success criterion'] END AS differs_by FROM board WHERE metric = 'PROMO' GROUP BY ALL)"""

QUERIES = {
    "ag_leaderboard": (lambda s, d: E.leaderboard(results(s, d)), f"WITH {BOARD} SELECT * FROM board"),
    "ag_cross_validation": (lambda s, d: E.cross_validation(results(s, d)), f"WITH {VALID} SELECT * FROM validated"),
    "ag_pairwise_wins": (lambda s, d: E.pairwise_wins(results(s, d)), f"WITH {RESULTS}, {WINS} SELECT * FROM wins"),
    "ag_method_index": (
        lambda s, d: E.method_index(E.pairwise_wins(results(s, d)), E.cross_validation(results(s, d))),
        f"""WITH {VALID}, {WINS}, r AS (SELECT winner AS method, metric, 'w' AS k FROM wins UNION ALL SELECT loser, metric, 'l' FROM wins UNION ALL SELECT method, metric, 'v' FROM validated)
        SELECT method, count(*) FILTER (k = 'w') AS wins, count(*) FILTER (k = 'l') AS losses, count(*) FILTER (k = 'v') AS validations, count(DISTINCT metric) AS n_metrics FROM r GROUP BY method""",
    ),
    "ag_results_grade_join": (
        lambda s, d: E.inherit_grades(results(s, d), E.cross_validation(results(s, d))),
        f"""WITH {VALID} SELECT r.record_id, r.method, r.metric, r.dataset, r.condition, r.value, coalesce(v.grade, CASE WHEN r.confidence = 'low' OR NOT r.verified THEN 'C' ELSE 'B' END) AS grade, coalesce(v.n_papers, 1) AS n_papers
        FROM results r LEFT JOIN validated v ON r.method IS NOT DISTINCT FROM v.method AND r.metric = v.metric AND r.dataset = v.dataset AND r.condition = v.condition WHERE r.value IS NOT NULL""",
    ),
    "wn_merge_records": (
        lambda s, d: E.merge_records(_priority(results(s, d).where("verified")), _priority(results(s, d))).select("record_id", "method", "metric", "dataset", "condition", "value", "verified"),
        f"""WITH {RESULTS}, b AS (SELECT * FROM results WHERE verified UNION ALL SELECT * FROM results)
        SELECT record_id, method, metric, dataset, condition, value, verified FROM b
        QUALIFY row_number() OVER (PARTITION BY method, metric, dataset, condition, value ORDER BY verified DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, record_id) = 1""",
    ),
    "jn_merge_by_paper": (
        lambda s, d: E.merge_by_paper(results(s, d).where("metric = 'PROMO' AND condition = 'a:f' AND value = 50"), results(s, d).where("is_own"), results(s, d).where("metric <> 'PROMO'").select("paper")).select("record_id", "paper", "value"),
        f"""WITH {RESULTS}, base AS (SELECT * FROM results WHERE metric = 'PROMO' AND condition = 'a:f' AND value = 50)
        SELECT record_id, paper, value FROM (SELECT * FROM base UNION ALL SELECT * FROM results WHERE is_own AND paper NOT IN (SELECT paper FROM base)) WHERE paper IN (SELECT paper FROM results WHERE metric <> 'PROMO')""",
    ),
    "ag_quarantine_topn": (
        lambda s, d: E.quarantine(results(s, d), ["Brand#1", "Brand#2", "Brand#3"]),
        f"WITH {RESULTS} SELECT method, count(*) AS n FROM results WHERE method NOT IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY method ORDER BY n DESC, method LIMIT 50",
    ),
    "ag_suspected_copies": (
        lambda s, d: E.suspected_copies(results(s, d).withColumn("method", F.concat_ws("/", "method", "record_id")).unionByName(results(s, d).withColumns({"method": F.concat_ws("/", "method", "record_id"), "paper": F.concat(F.lit("x"), "paper")}))),
        f"""WITH {RESULTS}, b AS (SELECT method || '/' || record_id AS method, metric, dataset, condition, paper, value, std FROM results UNION ALL SELECT method || '/' || record_id, metric, dataset, condition, 'x' || paper, value, std FROM results)
        SELECT method, metric, dataset, condition, count(DISTINCT paper) AS n_papers, min(value) AS value FROM b WHERE value IS NOT NULL AND std IS NOT NULL GROUP BY ALL HAVING count(DISTINCT paper) >= 2 AND count(DISTINCT (value, std)) = 1""",
    ),
    "jn_cells": (
        found_cells,
        f"""WITH {BOTH}, {WINS},
        b AS (SELECT {_CELL}, count(*) AS n_methods, min(CASE WHEN rank = 1 THEN method END) AS leader FROM board GROUP BY ALL), v AS (SELECT {_CELL}, count(*) AS n_validations FROM validated GROUP BY ALL), c AS (SELECT {_CELL}, count(*) AS n_comparisons FROM wins GROUP BY ALL)
        SELECT {_CELL}, n_methods, leader, coalesce(n_validations, 0) AS n_validations, coalesce(n_comparisons, 0) AS n_comparisons FROM b LEFT JOIN v USING ({_CELL}) LEFT JOIN c USING ({_CELL})""",
    ),
    "ft_nearest_cells": (
        lambda s, d: nearest(s, d, {"Scene": "pile", "Success criterion": "gsr"}),
        f"""WITH {FACETED} SELECT {_CELL}, n_methods, array_to_string(differs_by, ',') AS differs_by, CAST(len(differs_by) AS INT) AS n_differing, len(differs_by) = 0 AS matched FROM n WHERE (len(differs_by) = 0) = (SELECT bool_or(len(differs_by) = 0) FROM n)""",
    ),
    "ft_absent_cells": (
        lambda s, d: nearest(s, d, {"Scene": "pile", "Success criterion": "gsr", "Training": "noretrain"}),
        f"""WITH {FACETED} SELECT {_CELL}, n_methods, array_to_string(list_append(differs_by, 'Training'), ',') AS differs_by, CAST(len(differs_by) + 1 AS INT) AS n_differing, false AS matched FROM n""",
    ),
    "ag_coverage_gaps": (
        lambda s, d: E.coverage_gaps(results(s, d).where("is_own AND value >= 48")),
        f"WITH {RESULTS} SELECT metric, dataset, condition, count(DISTINCT method) AS n_methods FROM results WHERE is_own AND value >= 48 GROUP BY ALL HAVING count(DISTINCT method) < 2",
    ),
    "ft_faceted_filter": (
        lambda s, d: E.faceted_filter(results(s, d), CHOSEN).select("record_id", "metric", "condition"),
        f"WITH {RESULTS} SELECT record_id, metric, condition FROM results WHERE metric IN ('PROMO', 'SMALL') AND condition IN ('a:f', 'n:o')",
    ),
    "ag_conditioned_facets": (
        lambda s, d: E.conditioned_facets(results(s, d), ("metric", "condition", "confidence"), CHOSEN),
        f"""WITH {RESULTS}, f AS (SELECT *, metric IN ('PROMO', 'SMALL') AS m, condition IN ('a:f', 'n:o') AS c FROM results)
        SELECT 'metric' AS category, metric AS item, count(*) FILTER (c) AS n FROM f GROUP BY metric UNION ALL SELECT 'condition', condition, count(*) FILTER (m) FROM f GROUP BY condition
        UNION ALL SELECT 'confidence', confidence, count(*) FILTER (m AND c) FROM f GROUP BY confidence""",
    ),
    "ml_wilson": (
        wilson,
        """WITH g AS (SELECT toxic, CAST(sum(quality) AS BIGINT) AS n_good, count(quality) AS n FROM labels GROUP BY toxic), p AS (SELECT *, n_good / n::DOUBLE AS p FROM g),
        q AS (SELECT *, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) AS w FROM p)
        SELECT toxic, n_good, n, round(greatest(0, (p + 3.8416::DOUBLE / (2 * n) - w) / (1 + 3.8416::DOUBLE / n)), 8) AS low, round(least(1, (p + 3.8416::DOUBLE / (2 * n) + w) / (1 + 3.8416::DOUBLE / n)), 8) AS high FROM q""",
    ),
    "ml_trust": (
        trust,
        """WITH t AS (SELECT c_custkey, (0.3::DOUBLE + 0.7::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal / 10000))) * (0.4::DOUBLE + 0.6::DOUBLE * 0.92::DOUBLE) * (0.4::DOUBLE + 0.6::DOUBLE * 0.5::DOUBLE) AS t FROM customer)
        SELECT c_custkey, round(t, 6) AS trust, round(0.25::DOUBLE + 0.75::DOUBLE * t, 6) AS opacity FROM t""",
    ),
}
