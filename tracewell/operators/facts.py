"""Facts that a chunk states: metric values, architecture, equations, datasets, and every place of a citation marker.

A place is where the match itself stands: what lies before it is the sum of the pieces that the pattern cuts the text into and of
the earlier matches, so a value that also stands elsewhere is never mistaken for it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import bound
from ..session import dealt

# Patterns that find facts, each with the group that holds the value. -------------------------
METRIC_PATTERNS = (
    r"(?i)(?:success\s+rate|accuracy|precision|recall|F1|mAP|AP|IoU|mIoU|AUC)[\s:=]*(?:of\s+)?(\d+\.?\d*)\s*%",
    r"(?i)(\d+\.?\d*)\s*%\s*(?:success\s+rate|accuracy|grasp\s+success|completion)",
    r"(?i)(?:achieve[sd]?|reach(?:es|ed)?|obtain[sed]*|report[sed]*)\s+(?:a\s+)?(\d+\.?\d*)\s*%",
    r"(?i)(?:achieve[sd]?|reach(?:es|ed)?)\s+(?:a\s+)?(?:success\s+rate\s+of\s+)?(\d+\.?\d*)",
)
ARCHITECTURE_PATTERNS = {
    "backbone": r"(?i)\b(PointNet\+?\+?|ResNet-?\d*|VGG-?\d*|ViT|DINOv?\d?|CLIP|transformer|U-Net|EfficientNet|MobileNet|Equiformer(?:V2)?|convolutional|fully.connected|GCN|GAT|graph.neural)\b",
    "loss_function": r"(?i)\b(cross.entropy|binary.cross.entropy|MSE|L[12]\s+loss|focal.loss|contrastive.loss|triplet.loss|InfoNCE|reconstruction.loss|KL.divergence|adversarial.loss|BCE|huber.loss)\b",
    "optimizer": r"(?i)\b(Adam(?:W)?|SGD|RMSprop|AdaGrad|LAMB|learning.rate\s*(?:of\s*)?\d+\.?\d*(?:e-?\d+)?)\b",
    "training_size": r"(?i)(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:K|M|million|thousand)?\s*(?:grasp|training|sample|example|scene|object)",
}
EQUATION_PATTERNS = (
    r"(?s)\\begin\{(?:equation|align|gather)\*?\}(.+?)\\end\{(?:equation|align|gather)\*?\}",
    r"\$([^$]{5,80})\$",
    r"(?m)(?:^|\s)((?:L|J|E|R|V|Q)\s*(?:[_]\w+)?\s*(?:\([^)]*\))?\s*=\s*[^,.\n]{8,80})",
)
DATASETS = (
    "YCB", "ShapeNet", r"Isaac\s*(?:Gym|Sim)", "MuJoCo", "PyBullet", "Gazebo", "CoppeliaSim", "SAPIEN", "Open3D", "MoveIt", "ROS", "Panda", "UR5", "Franka", "KUKA", "GraspNet-1Billion", "ACRONYM", "ContactDB", "BigBIRD", "KIT", "Cornell", "Jacquard", "EGAD", "DexGraspNet", "MultiDex",
    "MotionBenchMaker", "RoboBench", "OMPL",
)
MATH = "=+\\-*/^_{}\\\\∑∫∂∇αβγδεζηθλμνξπρστφχψω"
# -----------------------------------------------------------------------------------------------------------
#: Equations that a chunk shows; the limit is the feature.
EQUATIONS = 5


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern from left to right: array of (at, hit, value), ``at`` counting the characters before the hit."""
    whole = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"), F.split(text, pattern, -1).alias("pieces"))

    def lengths(x: Column) -> Column:
        return F.zip_with(x["pieces"], x["hits"], lambda p, h: F.struct(F.length(p).alias("piece"), F.coalesce(F.length(h), F.lit(0)).alias("hit")))

    def add(done: Column, n: Column) -> Column:
        at = done["upto"] + n["piece"]
        return F.struct(F.concat(done["starts"], F.array(at)).alias("starts"), (at + n["hit"]).alias("upto"))

    def told(x: Column) -> Column:
        starts = F.aggregate(lengths(x), F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("upto")), add)["starts"]
        return F.arrays_zip(F.slice(starts, F.lit(1), F.size(x["hits"])).alias("at"), x["hits"].alias("hit"), x["values"].alias("value"))

    return bound(whole, told)


def around(text: Column, at: Column, length: Column, reach: int, after: int | None = None) -> Column:
    """``reach`` characters on both sides of a stretch and it, stripped; ``after`` says how many follow it."""
    begin = F.greatest(F.lit(0), at - reach)
    return stripped(F.substring(text, begin + 1, at + length + (reach if after is None else after) - begin))


def valid_equation(equation: Column) -> Column:
    """Whether what looked like an equation is one: 5 to 300 characters with a sign of mathematics, no prose, no run-together words, no references."""
    eq = stripped(equation)
    words = F.filter(F.split(eq, r"\s+"), lambda w: w != "")
    prose = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}{4,}$")))
    return F.coalesce(
        F.length(eq).between(5, 300) & eq.rlike(f"[{MATH}]") & ~((F.size(words) > 3) & (prose / F.size(words) > 0.6)) & ~eq.rlike("[a-z]{3}[A-Z][a-z]{3}") & ~eq.rlike(r"\[\d+\]|Table\s+[IVX]+"), F.lit(False)
    )


def facts(chunks: DataFrame, datasets: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, seq, kind, value, unit, context): the facts of each chunk, each value of a kind once, where it stands first.

    Kinds are metric, equation, dataset and those of ``ARCHITECTURE_PATTERNS``. Values are told apart as written for metrics
    and equations, without regard to case for others. A metric's context are the sentences around it that hold the value, an equation's the start of its
    sentence. A chunk shows its first ``EQUATIONS`` equations. Chunks are dealt to tasks first, and nothing but them moves. ``datasets`` are names to look for besides the known ones. Null texts state nothing.
    """
    known = "|".join([*DATASETS, *map(re.escape, datasets)])
    kinds = [("metric", n, p, 1) for n, p in enumerate(METRIC_PATTERNS)] + [(k, 0, p, 0) for k, p in ARCHITECTURE_PATTERNS.items()] + [("equation", n, p, 1) for n, p in enumerate(EQUATION_PATTERNS)] + [("dataset", 0, rf"(?i)\b({known})\b", 0)]

    def tagged(kind: str, number: int, pattern: str, group: int) -> Column:
        return F.transform(places(F.col("text"), pattern, group), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(number).alias("number"), x["at"].alias("at"), F.length(x["hit"]).alias("length"), stripped(x["value"]).alias("value")))

    rows = dealt(chunks.where(F.col("text").isNotNull()).select("doc_id", "seq", "text"), "doc_id", "seq").select("doc_id", "seq", "text", F.explode_outer(F.concat(*[tagged(*k) for k in kinds])).alias("f")).where("f IS NOT NULL").select("doc_id", "seq", "text", "f.*")  # a plain explode would first ask whether there is a fact, at the same cost
    at, length, text = F.col("at"), F.col("length"), F.col("text")
    near = around(text, at, length, 100)
    said = F.array_join(F.filter(F.split(near, r"\."), lambda s: s.contains(F.col("value"))), ". ")
    sentences = F.when(near.contains(".") & (said != ""), stripped(said)).otherwise(near)
    lead = stripped(F.element_at(F.split(around(text, at, F.lit(0), 60, 0), r"\."), -1))
    contexts = F.when(F.col("kind") == "metric", F.substring(sentences, 1, 200)).when(F.col("kind") == "equation", F.substring(lead, 1, 100)).when(F.col("kind") == "dataset", F.substring(around(text, at, length, 60), 1, 200)).otherwise(F.substring(around(text, at, length, 80), 1, 200))
    unit = F.when(F.col("kind") == "metric", F.when(F.substring(text, at + 1, length + 5).contains("%"), "%").otherwise(""))
    good = rows.where((F.col("kind") != "equation") | valid_equation(F.col("value")))
    value = F.when(F.col("kind") == "equation", F.substring("value", 1, 200)).otherwise(F.col("value"))
    told = good.select("doc_id", "seq", "kind", "number", "at", value.alias("value"), F.when(F.col("kind").isin("metric", "equation"), value).otherwise(F.lower(value)).alias("key"), unit.alias("unit"), contexts.alias("context"))
    first = told.groupBy("doc_id", "seq", "kind", "key").agg(F.min(F.struct("number", "at", "value", "unit", "context")).alias("m"))
    few = first.groupBy("doc_id", "seq", "kind").agg(F.array_sort(F.collect_list("m")).alias("all"))
    shown = F.when(F.col("kind") == "equation", F.slice("all", 1, EQUATIONS)).otherwise(F.col("all"))
    return few.select("doc_id", "seq", "kind", F.explode(shown).alias("m")).select("doc_id", "seq", "kind", "m.value", "m.unit", "m.context")


def citations(texts: DataFrame, markers: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, marker, at, context): every place of each of a text's markers, with up to ``reach`` characters on both sides and this place in 【】.

    ``texts`` has doc_id and text, ``markers`` doc_id and marker. A context begins with the first sentence that starts in its first half and ends
    with the last that ends in its second half, else at a word; those at a text's start begin there.
    """
    met = texts.join(markers.where(F.col("marker") != "").select("doc_id", "marker").distinct(), "doc_id")
    quoted = F.regexp_replace("marker", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    cut = F.split(F.col("text"), quoted, F.lit(-1))
    rows = met.select("doc_id", "text", "marker", F.posexplode(F.aggregate(F.slice(cut, F.lit(1), F.size(cut) - 1), F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("upto")), lambda d, p: F.struct(F.concat(d["starts"], F.array(d["upto"] + F.length(p))).alias("starts"), (d["upto"] + F.length(p) + F.length("marker")).alias("upto")))["starts"]).alias("i", "at"))
    begin = F.greatest(F.lit(0), F.col("at") - reach)
    before, after = F.substring(F.col("text"), begin + 1, F.col("at") - begin), F.substring(F.col("text"), F.col("at") + F.length("marker") + 1, F.lit(reach))
    parts = rows.select("doc_id", "marker", "at", before.alias("before"), after.alias("after"), (begin == 0).alias("whole")).withColumn("size", F.length("before") + F.length("marker") + F.length("after"))
    lead = F.length(F.regexp_extract("before", r"(?s)^(.*?[.?!]\s+)", 1))
    space = F.locate(" ", F.col("before"))
    opened = parts.withColumn("lead", lead).withColumn("begin", F.when(F.col("whole"), 0).when((F.col("lead") > 0) & (F.col("lead") < F.col("size") * 0.5), F.col("lead")).when(space.between(2, 20), space).otherwise(0))
    kept = opened.withColumn("before", F.substring(F.col("before"), F.col("begin") + 1, F.length("before"))).withColumn("size", F.length("before") + F.length("marker") + F.length("after"))
    last = F.length(F.regexp_extract("after", r"(?s)^(.*[.?!]) ", 1))
    ended = kept.withColumn("last", last).withColumn("after", F.when((F.col("last") > 0) & (F.length("before") + F.length("marker") + F.col("last") - 1 > F.col("size") * 0.5), F.substring(F.col("after"), F.lit(1), F.col("last"))).otherwise(F.col("after")))
    return ended.select("doc_id", "marker", "at", F.concat("before", F.lit("【"), "marker", F.lit("】"), "after").alias("context"))
