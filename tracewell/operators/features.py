"""Columns derived from a method's attributes, readable names of condition tokens, and cards of what a number was measured under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .browse import NOT_REPORTED, facets
from .evidence import CELL, complete, matched
from .relational import smart_split

# What is read from which attribute, in the order in which it is looked for. --------------------
DIMENSIONALITY = (("6-DoF", "6-DoF"), ("7-DoF", "7-DoF"), ("2D grasp", "2D"), ("Grasp policy", "Policy"), ("Grasp success", "Evaluation"))
CLASSICAL = ("Analytical", "Sampling", "Optimization")
LEARNED = ("Direct regression", "Generative")
THREE_D = ("point cloud", "tsdf", "3d", "mesh", "voxel")
DIFFICULTY = {"Singulated": 1, "Structured": 2, "Cluttered": 3, "Packed": 4, "Piled": 5, "Stacked": 5}
DIFFICULTY_NAMES = ("Unknown", "Singulated", "Structured", "Cluttered", "Packed", "Piled")
FRAMEWORKS = ("PyTorch", "TensorFlow", "Keras")
ERAS = ((2018, "Pioneer (2016-2018)"), (2021, "Growth (2019-2021)"))
TOKEN_LABELS = {
    "gsr": "Grasp success rate (GSR)", "dr": "Declutter rate (DR)", "sr": "Success rate (SR)", "packed": "Packed", "pile": "Pile", "real": "Real-world", "isolated": "Isolated", "cluttered": "Cluttered", "sim": "Simulation", "fixedview": "Fixed camera", "randomview": "Random camera",
    "gammanoise": "Gamma noise", "gaussnoise": "Gaussian noise", "egad": "EGAD objects", "ycb": "YCB objects", "partnet": "PartNet objects", "noretrain": "No retrain (OOD)",
}
TIERS = {"reproduced": "Reproduced (≥2 papers agree)", "single-full": "Single paper, full protocol", "single-partial": "Single paper, partial protocol"}
FACTORS = ("object_set", "gripper", "arm", "sensor", "scene", "success_criterion", "trials", "protocol")
# -------------------------------------------------------------------------------------------------------------


def first_of(text: Column, pairs, default: str) -> Column:
    """The name of the first needle that a text contains."""
    return F.coalesce(*[F.when(text.contains(needle), F.lit(name)) for needle, name in pairs], F.lit(default))


def derived(output: Column, planning: Column, training: Column, inputs: Column, scene: Column, hardware: Column, language: Column, year: Column) -> dict[str, Column]:
    """Seven columns told by a method's attributes; null attributes count as empty."""
    output, planning, training, inputs, scene, hardware, language = (F.coalesce(c, F.lit("")) for c in (output, planning, training, inputs, scene, hardware, language))
    ways = F.transform(F.split(planning, ","), lambda p: F.trim(p))
    paradigm = (
        F.when((training == "Training-less") | F.forall(ways, lambda p: p.isin(*CLASSICAL)), "Classical").when(F.exists(ways, lambda p: p.contains("Reinforcement")), "RL-based")
        .when(F.exists(ways, lambda p: p.isin(*LEARNED)), "Learning-based").otherwise("Hybrid")
    )
    low = F.lower(inputs)
    sensing = F.when(low.contains("natural language") | (F.size(smart_split(inputs)) > 1), "Multimodal").otherwise(first_of(low, [*((n, "3D") for n in THREE_D), ("rgbd", "2.5D"), ("rgb", "2D"), ("depth", "2D")], "Other"))
    grades = F.transform(smart_split(scene), lambda p: F.coalesce(*[F.when(p == n, F.lit(g)) for n, g in DIFFICULTY.items()], F.lit(0)))
    hardest = F.get(F.array(*map(F.lit, DIFFICULTY_NAMES)), F.coalesce(F.array_max(grades), F.lit(0)))
    gripper = F.when(F.size(smart_split(hardware)) > 1, "Multi-gripper").otherwise(first_of(hardware, (("Multi-finger", "Dexterous"), ("Three-finger", "Dexterous"), ("Suction", "Suction"), ("Two-finger", "Parallel-jaw")), "Unknown"))
    era = F.coalesce(*[F.when(year <= last, F.lit(name)) for last, name in ERAS], F.when(year.isNotNull(), F.lit("Modern (2022+)")), F.lit("Unknown"))
    return {
        "dimensionality": first_of(output, DIMENSIONALITY, "Other"), "paradigm": paradigm, "sensor_complexity": sensing, "scene_difficulty": hardest, "gripper_type": gripper,
        "framework": first_of(language, [(f, f) for f in FRAMEWORKS], "None"), "era": era,
    }


def token_label(token: Column) -> Column:
    """A readable name of a condition's token; one that is not known begins with a capital."""
    key = F.lower(F.trim(token))
    return F.coalesce(*[F.when(key == t, F.lit(name)) for t, name in TOKEN_LABELS.items()], F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, F.lit(2), F.length(key))))


def condition_label(condition: Column) -> Column:
    """A condition's tokens by their readable names; all conditions where there is none."""
    names = F.filter(F.transform(F.split(condition, ":"), token_label), lambda n: n != "")
    return F.when(F.trim(F.coalesce(condition, F.lit(""))) == "", "All conditions").otherwise(F.array_join(names, " · "))


def cards(records: DataFrame, validations: DataFrame) -> DataFrame:
    """One card per method and cell: n_papers, tier and its label, the factors that the condition and the records report, and what not to compare across.

    A tier says how often a number was replicated, not how good it is: reproduced where a validation is consistent over two papers or
    more, else single-full where scene and success criterion are known. ``records`` may have trials; the first positive
    number of them, by record, counts. What nobody reports is never made up.
    """
    rows = complete(records).where(F.col("value").isNotNull())
    trials = F.col("trials").cast("long") if "trials" in rows.columns else F.lit(None).cast("long")
    key = ("method", *CELL)
    held = rows.groupBy(*key).agg(F.countDistinct("paper").alias("papers"), F.min(F.when(trials > 0, F.struct("record_id", trials.alias("trials")))).alias("tried"))
    told = matched(held, validations.select(*key, F.col("n_papers").alias("validated"), "status"), key, "left")
    f = facets(F.col("condition"))

    def of(category: str) -> Column:
        return F.element_at(f, category)

    setup = F.array_compact(F.array(of("Camera view"), of("Depth noise"), of("Training")))
    known = {
        "object_set": of("Object set"), "gripper": F.lit(None).cast("string"), "arm": F.lit(None).cast("string"), "sensor": F.lit(None).cast("string"), "scene": of("Scene"), "success_criterion": of("Success criterion"),
        "trials": F.col("tried.trials").cast("string"), "protocol": F.nullif(F.array_join(F.transform(setup, token_label), " · "), F.lit("")),
    }
    n = F.coalesce("validated", "papers")
    tier = F.when((F.col("status") == "consistent") & (n >= 2), "reproduced").when(of("Scene").isNotNull() & of("Success criterion").isNotNull(), "single-full").otherwise("single-partial")
    missing = F.array_compact(F.array(*[F.when(known[k].isNull(), F.lit(f"{k} not reported — do not compare across it")) for k in FACTORS]))
    label = F.coalesce(*[F.when(F.col("tier") == t, F.lit(name)) for t, name in TIERS.items()])
    made = told.select(*key, n.alias("n_papers"), tier.alias("tier"), *[F.coalesce(known[k], F.lit(NOT_REPORTED)).alias(k) for k in FACTORS], missing.alias("do_not_compare"))
    return made.withColumn("tier_label", label).withColumn("condition_label", condition_label(F.col("condition")))
