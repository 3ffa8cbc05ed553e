"""What a question asks for: the intent that decides where to look, the shape of the answer, and follow-ups made whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prose import first_match

# Cues of each intent, the sections where each is answered, and patterns of the answer's shape. ---------------
KEYWORDS = {
    "TECHNICAL": ("equation", "loss", "reward", "objective", "architecture", "algorithm", "network", "model", "training", "backbone", "policy", "dynamics", "controller", "optimization", "gradient", "inference", "pipeline"),
    "EVALUATION": ("benchmark", "dataset", "result", "accuracy", "success rate", "real-world", "experiment", "ablation", "baseline", "metric", "performance", "evaluation", "table", "figure", "demo"),
    "COMPARISON": ("compare", "comparison", "differ", "difference", "vs", "versus", "better", "worse", "advantage", "disadvantage", "trade-off"),
    "LIMITATION": ("limitation", "failure", "gap", "future", "weakness", "drawback", "challenge", "issue", "problem", "cannot", "unable"),
    "PEOPLE": ("author", "wrote", "published", "research group", "lab", "university", "institution", "team", "affiliation", "who", "researcher", "scientist", "faculty", "phd", "advised"),
}
SECTIONS = {"TECHNICAL": ("method", "introduction"), "EVALUATION": ("experiments", "ablation", "table"), "COMPARISON": ("related_work", "introduction", "experiments"), "LIMITATION": ("limitations", "conclusion")}
SHAPES = (
    ("overview", r"\b(overview|landscape|survey|taxonomy|summar\w*|the field|the literature|all (the |available )?(methods|approaches|algorithms|techniques)|(list|show) (me )?(all|the|every|methods|approaches|algorithms)|what (methods|approaches|algorithms) (are|exist))\b"),
    ("comparison", r"\b(vs\.?|versus|compared?|comparison|difference between|differ\w*|trade-?offs?|better than|worse than|perform\w*\s+(?:better|worse)|which\b[^?]*\b(?:better|worse))\b"),
    ("ranking", r"\b(best|fastest|highest|top|rank(ing)?|outperform\w*|state[- ]of[- ]the[- ]art|sota|success rate|accuracy|most accurate|perform\w* best|better|worse)\b"),
    ("recommendation", r"\b(which|recommend|methods? for|approaches? for|list|options?|suitable|suited|good for|use for)\b"),
)
PRONOUN = r"(?i)\b(it|its|it's|they|their|them|those|these|that one|the first one|the second one|the last one)\b"
LEAD = r"(?i)^\s*(what about|and\b|how about)"
# ----------------------------------------------------------------------------------------------------------------------------
BROAD = "BROAD"


def routed_intent(query: Column) -> Column:
    """The intent with most cues in the question, the first of equals; BROAD without any."""
    low = F.lower(F.coalesce(query, F.lit("")))
    scores = F.array(*[F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(KEYWORDS.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(BROAD))


def sections_of(intent: Column) -> Column:
    """The section types that an intent is answered from; null where any will do."""
    return F.coalesce(*[F.when(intent == name, F.array(*map(F.lit, kinds))) for name, kinds in SECTIONS.items()])


def routed_chunks(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, doc_id, seq): chunks of the sections that each question's intent is answered from; all chunks where any section will do.

    ``queries`` has query_id and query, ``chunks`` doc_id, seq and section. Questions meet chunks by section, so this is as large as its result.
    """
    asked = queries.select("query_id", sections_of(routed_intent(F.col("query"))).alias("kinds"))
    narrow = asked.where("kinds IS NOT NULL").select("query_id", F.explode("kinds").alias("section")).join(chunks.select("doc_id", "seq", "section"), "section")
    return narrow.select("query_id", "doc_id", "seq")


def answer_shape(query: Column) -> Column:
    """The shape that an answer takes: overview, comparison, ranking, recommendation or default, the first that a cue asks for."""
    return first_match(F.lower(F.coalesce(query, F.lit(""))), SHAPES, F.lit("default"))


def discussed(answer: Column, most: int) -> Column:
    """The first ``most`` different names that an answer sets in bold."""
    names = F.filter(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\*\*([^*]{2,80})\*\*"), F.lit(1)), lambda n: F.trim(n)), lambda n: n != "")
    lower = F.transform(names, lambda n: F.lower(n))
    return F.slice(F.filter(names, lambda n, i: F.array_position(lower, F.lower(n)) == i + 1), 1, most)


def rewritten(query: Column, before: Column, answer: Column, most: int = 3) -> Column:
    """A question that leans on the turn before, anchored to the names that its answer discussed, or to its question where there are none.

    The first pronoun is replaced; a question that only opens like a follow-up says what it is about at its end. Others, and first questions, stay.
    """
    q = F.coalesce(query, F.lit(""))
    names = discussed(answer, most)
    topic = F.when(F.size(names) > 0, F.array_join(names, " and ")).otherwise(before)
    parts = F.split(q, PRONOUN, 2)
    said = F.when(q.rlike(PRONOUN), F.concat(F.get(parts, F.lit(0)), topic, F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).when(q.rlike(LEAD), F.concat(q, F.lit(" (regarding "), topic, F.lit(")"))).otherwise(q)
    return F.when(F.coalesce(before, F.lit("")) == "", q).otherwise(said)


def conversation_queries(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, query, shape, intent): the questions of conversations made whole by the user turn and the answer before them.

    ``turns`` has conv_id, turn, role and text; a conversation's turns are put in order by one task, as they are one dialogue.
    """
    order = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    told = turns.withColumn("before", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order)).withColumn("answer", F.last(F.when(F.col("role") != "user", F.col("text")), ignorenulls=True).over(order))
    whole = told.where("role = 'user'").select("conv_id", "turn", rewritten(F.col("text"), F.col("before"), F.col("answer")).alias("query"))
    return whole.withColumns({"shape": answer_shape(F.col("query")), "intent": routed_intent(F.col("query"))})


def column_hits(query: Column, keywords: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """How many of each column's keywords a question names."""
    low = F.lower(F.coalesce(query, F.lit("")))
    return {c: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for c, words in keywords.items()}


def column_weights(query: Column, weights: dict[str, float], keywords: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Weights of columns for a question: two more for each keyword named, six at most, and 16 in all; others stay."""
    hits = column_hits(query, keywords)
    return {c: F.when(hits[c] > 0, F.least(F.lit(16.0), F.lit(float(w)) + F.least(hits[c] * 2, F.lit(6)))).otherwise(F.lit(float(w))) if c in hits else F.lit(float(w)) for c, w in weights.items()}


def color_by(query: Column, keywords: dict[str, tuple[str, ...]], boosted: dict[str, Column] | None = None, weights: dict[str, float] | None = None) -> Column:
    """The column with most keywords in the question, the first of equals; without any, the one whose weight grew most, else cluster."""
    def most(scores: dict[str, Column]) -> Column:
        best = F.array_max(F.array(*[F.struct(s.cast("double").alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, s) in enumerate(scores.items())]))
        return F.when(best["s"] > 0, best["c"])

    grown = {c: b - F.lit(float((weights or {}).get(c, 10))) for c, b in (boosted or {}).items() if c in keywords}
    return F.coalesce(most(column_hits(query, keywords)), *([most(grown)] if grown else []), F.lit("cluster"))
