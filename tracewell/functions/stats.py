"""Statistics as column expressions: consistency, grades, confidence, trust, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coefficient_of_variation(value: str) -> Column:
    """Aggregate: population deviation over the absolute mean; 0 for fewer than two values or a zero mean."""
    mean = F.avg(value)
    return F.when((F.count(value) < 2) | (mean == 0), F.lit(0.0)).otherwise(F.stddev_pop(value) / F.abs(mean))


def consistency(cv: Column, kind: Column, thresholds: dict[str, float], default: float = 0.15) -> Column:
    limit = F.lit(default)
    for name, value in thresholds.items():
        limit = F.when(kind == name, F.lit(value)).otherwise(limit)
    return F.when(cv <= limit, "consistent").otherwise("high_variance")


def evidence_grade(low_or_unverified: Column, status: Column, papers: Column) -> Column:
    """A: two papers or more agree; B: one paper; C: weak, unverified or inconsistent evidence."""
    weak = low_or_unverified | status.isin("high_variance", "different_setup")
    return F.when(weak, "C").when((papers >= 2) & (status == "consistent"), "A").when(papers == 1, "B").otherwise("C")


def confidence(grade: Column, cv: Column) -> Column:
    base = F.when(grade == "A", 0.92).when(grade == "B", 0.78).otherwise(0.45)
    return F.round(base * (1 - 0.3 * F.least(cv, F.lit(1.0))), 2)


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval; null where counts make no sense."""
    good = (trials > 0) & (successes >= 0) & (successes <= trials)
    p = successes / F.when(good, trials)
    spread = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    centre, scale = p + z * z / (2 * trials), 1 + z * z / trials
    return F.greatest(F.lit(0.0), (centre - spread) / scale), F.least(F.lit(1.0), (centre + spread) / scale)


def trust_score(trust: Column, confidence: Column, reproduced: Column) -> Column:
    def clamp(c: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    return (0.3 + 0.7 * clamp(trust)) * (0.4 + 0.6 * clamp(confidence)) * (0.4 + 0.6 * clamp(reproduced))
