"""Benchmark evidence: leaderboards, cross-validation, pairwise wins, facets and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, stats
from ..session import staged
from .browse import facets
from .ranks import any_above, matched, medians, quantiles

#: What two numbers must share to be compared; a null dataset or condition equals a null one.
CELL = ("metric", "dataset", "condition")
#: The variation that each type of metric may have, others 0.15.
THRESHOLDS = {"rate": 0.10, "time": 0.20, "count": 0.15}
#: Records of one method in one cell that one task may order; more are spread.
FEW = 4_000_000


def complete(records: DataFrame) -> DataFrame:
    """``records`` with null columns for what they lack of dataset, condition, kind (the metric's type), std and caption."""
    lacking = {c: t for c, t in (("dataset", "string"), ("condition", "string"), ("kind", "string"), ("std", "double"), ("caption", "string")) if c not in records.columns}
    return records.withColumns({c: F.lit(None).cast(t) for c, t in lacking.items()})


def evidence_of(rows: DataFrame, key: tuple[str, ...], thresholds: dict[str, float]) -> DataFrame:
    """Per key, over all its values: papers, mean, variation, status, grade, confidence and corroboration.

    One paper that contradicts itself varies as two would. Grade A falls to B where all papers give one value with one and the same
    deviation, or a caption says that the method's numbers are another paper's.
    """
    found = rows.groupBy(*key).agg(
        F.countDistinct("paper").alias("n_papers"), F.avg("value").alias("mean"), stats.coefficient_of_variation("value").alias("cv"), F.count("value").alias("n"), F.max("kind").alias("kind"),
        F.max(F.col("verified").cast("int")).alias("verified"), F.max("confidence").alias("sure"),
        ((F.min("value") == F.max("value")) & (F.min("std") == F.max("std")) & (F.count("std") == F.count("value"))).alias("one"), F.max(labels.caption_copied(F.col("method"), F.col("caption"))).alias("said"),
    )
    status = stats.consistency(F.col("cv"), F.coalesce("kind", F.lit("default")), thresholds)
    same = F.coalesce((F.col("n_papers") >= 2) & F.col("one"), F.lit(False))
    grade = stats.evidence_grade((F.col("sure") == "low") | (F.col("verified") == 0), F.when(F.col("n") >= 2, F.col("status")).otherwise(""), F.col("n_papers"))
    demoted = F.when((same | F.col("said")) & (grade == "A"), "B").otherwise(grade)
    told = found.withColumn("status", status).withColumn("grade", demoted).withColumn("cv", F.round("cv", 6))
    word = F.when(same, "identical_values_suspected_copy").when(F.col("said"), "caption_copied_baseline").otherwise("independent")
    return told.select(*key, "n_papers", "mean", "cv", "status", "grade", stats.confidence(F.col("grade"), F.round("cv", 3)).alias("confidence"), word.alias("corroboration"))


def leaderboard(records: DataFrame, least_entries: int = 2, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per cell and method, ranked: the headline is the median over papers of each paper's median, ``best`` the best of these.

    Records are written once, as they are read several times. Medians are picked from counted values in order; entries of over ``FEW`` records are
    spread over tasks for it, so no task holds a large group. The rank orders at most the methods of a cell.
    """
    entry = (*CELL, "method")
    rows = staged(complete(records).where(F.col("value").isNotNull()).select(*entry, "paper", "value", "kind", "verified", "confidence", "std", "caption", "higher_is_better"))
    large = any_above(rows, list(entry), FEW)
    per_paper = medians(rows, [*entry, "paper"], "value", "rep", large)
    heads = quantiles(per_paper, list(entry), "rep", {"lo": 0.0, "value": 0.5, "hi": 1.0}, large)
    higher = rows.groupBy(*CELL).agg(F.coalesce(F.max("higher_is_better"), F.lit(True)).alias("higher_is_better"))
    graded = matched(matched(heads, evidence_of(rows, entry, THRESHOLDS if thresholds is None else thresholds), entry), higher, CELL).withColumn("value", F.round("value", 2))
    order = F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value"))
    cell = W.partitionBy(*CELL)
    return (
        graded.withColumn("size", F.count(F.lit(1)).over(cell))
        .where(F.col("size") >= least_entries)
        .withColumn("rank", F.row_number().over(cell.orderBy(order, "method")))
        .select(*CELL, "rank", "method", "value", F.round(F.when(F.col("higher_is_better"), F.col("hi")).otherwise(F.col("lo")), 2).alias("best"), F.col("n_papers").alias("n_reports"), "cv", "grade", "confidence", "corroboration")
    )


def cross_validation(records: DataFrame, least_papers: int = 2, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Cells of one method that several papers report: mean, variation, status by the metric's type, grade, confidence, corroboration."""
    found = evidence_of(complete(records).where(F.col("value").isNotNull()), ("method", *CELL), THRESHOLDS if thresholds is None else thresholds)
    word = F.when(F.col("corroboration") == "identical_values_suspected_copy", F.col("corroboration")).otherwise("independent")
    return found.where(F.col("n_papers") >= least_papers).withColumns({"mean": F.round("mean", 6), "corroboration": word})


def pairwise_wins(records: DataFrame) -> DataFrame:
    """Per paper and cell, own rows against other methods' rows that they beat; margins to two digits."""
    key = ("paper", *CELL)
    rows = complete(records).where(F.col("value").isNotNull())
    own = rows.where("is_own").select(*key, F.col("method").alias("winner"), F.col("value").alias("own_value"), F.coalesce("higher_is_better", F.lit(True)).alias("higher_is_better"), F.col("record_id").alias("own_id"))
    other = rows.where("NOT is_own").select(*key, F.col("method").alias("loser"), F.col("value").alias("other_value"), F.col("record_id").alias("other_id"))
    met = matched(own, other, key).where("winner <> loser")
    wins = F.when(F.col("higher_is_better"), F.col("own_value") > F.col("other_value")).otherwise(F.col("own_value") < F.col("other_value"))
    return met.where(wins).select(*key, "winner", "loser", F.round(F.abs(F.col("own_value") - F.col("other_value")), 2).alias("margin"), "own_id", "other_id")


def method_index(wins: DataFrame, validations: DataFrame) -> DataFrame:
    """Per method: wins, losses, validated cells and metrics seen. One pass over tagged rows."""
    rows = (
        wins.select(F.col("winner").alias("method"), "metric", F.lit("w").alias("kind"))
        .unionByName(wins.select(F.col("loser").alias("method"), "metric", F.lit("l").alias("kind")))
        .unionByName(validations.select("method", "metric", F.lit("v").alias("kind")))
    )
    return rows.groupBy("method").agg(
        F.count_if(F.col("kind") == "w").alias("wins"), F.count_if(F.col("kind") == "l").alias("losses"), F.count_if(F.col("kind") == "v").alias("validations"),
        F.countDistinct("metric").alias("n_metrics"),
    )


def inherit_grades(records: DataFrame, validations: DataFrame) -> DataFrame:
    """Every valued record with the grade and paper count of its method and cell; B and 1 without any."""
    key = ("method", *CELL)
    rows = complete(records).where(F.col("value").isNotNull()).select("record_id", *key, "value", ((F.col("confidence") == "low") | ~F.col("verified")).alias("weak"))
    met = matched(rows, validations.select(*key, "grade", "n_papers"), key, "left")
    return met.select("record_id", *key, "value", F.coalesce("grade", F.when(F.col("weak"), "C").otherwise("B")).alias("grade"), F.coalesce("n_papers", F.lit(1)).alias("n_papers"))


def merge_records(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union of two record sets, one row per measurement: verified first, then by source priority."""
    both = complete(base).unionByName(complete(fresh))
    best = W.partitionBy("method", *CELL, "value").orderBy(F.desc("verified"), F.desc("priority"), "record_id")
    return both.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def merge_by_paper(base: DataFrame, fresh: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """All rows of base, and of fresh those whose paper base lacks; only present papers if given."""
    merged = base.unionByName(fresh.join(base.select("paper").distinct(), "paper", "left_anti"))
    return merged if present is None else merged.join(present.select("paper").distinct(), "paper", "left_semi")


def quarantine(records: DataFrame, known: list[str], top: int = 50) -> DataFrame:
    """Most frequent methods that the registry does not know; a top-k report."""
    return records.where(~F.col("method").isin(known)).groupBy("method").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "method").limit(top)


def suspected_copies(records: DataFrame) -> DataFrame:
    """Cells where several papers report one and the same value with one and the same deviation. Records move once, to their method and cell."""
    key = ("method", *CELL)
    rows = complete(records).where("value IS NOT NULL AND std IS NOT NULL").select(*key, "paper", "value", "std").repartition(*key)
    one = (F.min("value") == F.max("value")) & (F.min("std") == F.max("std"))
    return rows.groupBy(*key).agg(F.countDistinct("paper").alias("n_papers"), F.min("value").alias("value"), one.alias("one")).where("n_papers >= 2 AND one").drop("one")


def cells(boards: DataFrame, validations: DataFrame, wins: DataFrame) -> DataFrame:
    """Leaderboard cells with counts of validations and comparisons (three-way join on the cell)."""
    b = boards.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_methods"), F.min(F.when(F.col("rank") == 1, F.col("method"))).alias("leader"))
    v = validations.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_validations"))
    c = wins.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_comparisons"))
    joined = matched(matched(b, v, CELL, "left"), c, CELL, "left")
    return joined.select(*CELL, "n_methods", "leader", F.coalesce("n_validations", F.lit(0)).alias("n_validations"), F.coalesce("n_comparisons", F.lit(0)).alias("n_comparisons"))


def differing(condition: Column, asked: dict[str, str]) -> Column:
    """The facets asked for that a condition does not have as asked, in their order; an absent facet differs."""
    known = facets(condition)
    return F.array_compact(F.array(*[F.when(~F.element_at(known, k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in asked.items()]).cast("array<string>"))


def nearest_cells(found: DataFrame, boards: DataFrame, metric: str | None, asked: dict[str, str], methods: tuple[str, ...] = ()) -> DataFrame:
    """(cell, n_methods, matched, differs_by, n_differing): the cells of a metric that have all ``methods`` and the facets asked for.

    Only where none has them all, the cells that differ are given, with the names of the facets in which they do; such a
    cell never counts as matched.
    """
    rows = found if metric is None else found.where(F.col("metric") == metric)
    if methods:
        present = boards.where(F.col("method").isin(*methods)).groupBy(*CELL).agg(F.countDistinct("method").alias("n_present")).where(F.col("n_present") == len(set(methods)))
        rows = matched(rows, present.drop("n_present"), CELL, "left_semi")
    told = staged(rows.select(*CELL, "n_methods", differing(F.col("condition"), asked).alias("differs_by")).withColumn("n_differing", F.size("differs_by")))
    exact = not told.where("n_differing = 0").isEmpty()
    return told.where("n_differing = 0" if exact else "n_differing > 0").withColumn("matched", F.lit(exact))


def coverage_gaps(records: DataFrame, least: int = 2) -> DataFrame:
    """Cells that fewer than ``least`` methods report."""
    return complete(records).groupBy(*CELL).agg(F.countDistinct("method").alias("n_methods")).where(F.col("n_methods") < least)


def faceted_filter(records: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Rows that match one chosen value in every category that has any."""
    for category, values in chosen.items():
        records = records.where(F.col(category).isin(values))
    return records


def conditioned_facets(records: DataFrame, categories: tuple[str, ...], chosen: dict[str, list[str]]) -> DataFrame:
    """Per category and value: rows that match the choices of all other categories, zeros kept.

    One pass: each row says which choices it fails; it counts for a category if it fails none, or only that one.
    """
    fails = {c: ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in chosen.items()}
    pairs = [
        F.struct(F.lit(c).alias("category"), F.col(c).alias("item"), (sum((f.cast("int") for k, f in fails.items() if k != c), F.lit(0)) == 0).cast("int").alias("hit"))
        for c in categories
    ]
    return records.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.category", "p.item").agg(F.sum("p.hit").alias("n"))
