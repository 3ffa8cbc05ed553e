"""Names, labels, values and captions of result tables as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the cells of result tables are told apart by.
NULL_CELLS = ("-", "n/a", "—", "–", "/", "", "none")
UNIT_TOKENS = ("k", "m", "b", "n", "g", "kg", "mg", "mm", "cm", "ms", "s", "hz", "khz", "fps")
CONDITION_WORDS = ("pile", "piled", "packed", "isolated", "singulated", "sim", "simulation", "simulated", "real", "cluttered", "clutter")
INDEX_TOKENS = ("no", "#", "rank", "id", "idx", "index", "")
HEADER_TOKENS = ("method", "model", "approach", "algorithm", "name", "type", "input", "backbone", "training", "param", "publication", "year", "dataset", "object", "category", "planner", "#")
SUMMARY_ROWS = ("method", "model", "approach", "total", "average", "mean", "all", "baseline")
UNIT_PATTERN = r"(?i)[(\[]\s*(?:%|(?:ms|s|cm|mm|m|km|g|kg|mg|fps|hz|khz|db|bits?|px|rad|deg|j|w|n)\b|°)"
METRIC_PATTERN = (
    r"(?i)\b(rate|success|precision|recall|accuracy|acc|time|latency|error|err|depth|penetration|entropy|cost|score|iou|map|ap|f1|coverage|quality|distance|dist|"
    r"throughput|speed|mae|rmse|mse|psnr|ssim|auc|ugr|completion|declutter|clearance|reward|return|epe|chamfer|collision|smoothness|jerk|energy|torque|force|"
    r"displacement|deviation|margin|ratio|percentage|number|count|steps?)\b"
)
ABLATION_PATTERN = r"(?i)^\s*(?:[+±]|(?:without|with|w/o|w/)\s)"
#: Protocol axes in their order; the first pattern of an axis that matches gives its token.
PROTOCOL_AXES = (
    (("real", r"real[\s-]?world|in the real world|real[\s-]?robot|physical (?:robot|experiment)|real world experiment"), ("sim", r"simulat\w+|\bin simulation\b|pybullet|isaac")),
    (("fixedview", r"fixed[\s-]?(?:camera|view|pose)"), ("randomview", r"random[\s-]?(?:camera|view\s?point|view|pose)")),
    (("gammanoise", r"gamma[\s-]?noise"), ("gaussnoise", r"gaussian[\s-]?noise|\bgauss\w*")),
    (("egad", r"\begad\b"), ("ycb", r"\bycb\b"), ("partnet", r"\bpartnet\b")),
    (("noretrain", r"not\s+(?:be\s+)?re-?trained|without re-?training|directly (?:tested|evaluated|applied)|zero-?shot"),),
)
COPY_PATTERN = (
    r"(?i)\bresults?\b[^.]{0,90}?\bare\s+from\b|\b(?:taken|obtained|adopted|quoted|reproduced|copied|borrowed)\s+from\b"
    r"|\breported\s+(?:in|by)\b|\bresults?\b[^.]{0,50}?\bfrom\s*\[\d+\]"
)
EXCEPT_PATTERN = r"(?i)except\s+(.+?)\s+(?:are|is|were|was)\s+from"


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    """``c`` after one regular replacement after the other."""
    return reduce(lambda out, step: F.regexp_replace(out, *step), steps, c)


def bound(c: Column, use) -> Column:
    """``use`` of a column that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def ascii_words(pattern: str) -> str:
    r"""``pattern`` with its \b between ASCII words only, as SQL has it: Spark's counts all letters, so that after one with an accent no word would begin."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def registry_key(name: Column) -> Column:
    """Lower case without citation marks, counts, markers and 'baseline(s)'; brackets, percent signs and separators as one space."""
    steps = ((r"\[[\d,\s\-]+\]", " "), (r"\(\s*n\s*=\s*\d+\s*\)", " "), (r"[*†‡✓✗()%]", " "), (r"[-_/]", " "), (r"\bbaselines?\b", " "), (r"\s+", " "))
    return F.trim(replaced(F.lower(F.coalesce(name, F.lit(""))), *steps))


def slug(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-"))


def metric_label(label: Column) -> Column:
    """Without arrows and deltas, runs of blanks as one, no punctuation around."""
    return replaced(label, (r"[↑↓∆∇]", ""), (r"\s{2,}", " "), (r"^[ ,;:|-]+|[ ,;:|-]+$", ""))


def valid_metric_label(label: Column, metric_id: Column) -> Column:
    """A known metric, or a label of over two characters with a unit or a metric's word that is no value and no bare condition."""
    shown = F.trim(label)
    looks = shown.rlike(UNIT_PATTERN) | shown.rlike(METRIC_PATTERN)
    return F.coalesce(metric_id.isNotNull() | ((F.length(shown) > 2) & ~shown.rlike(r"^[\d.,%±()\s/+\-]+$") & ~F.lower(shown).isin(*CONDITION_WORDS) & looks), F.lit(False))


def method_name(cell: Column) -> Column:
    """A method cell without citation marks, 'et al', daggers and the number of its row."""
    steps = ((r"\s*\[\d+(?:\s*[,;]\s*\d+)*\]", ""), (r"(?i)\bet\s+al\b\.?", ""), (r"[*†‡]", ""), (r"^\s*\d+\s*[.)]?\s+", ""), (r"\s{2,}", " "), (r"^[ ,;:·-]+|[ ,;:·-]+$", ""))
    return replaced(F.coalesce(cell, F.lit("")), *steps)


def valid_method_name(name: Column) -> Column:
    """Two characters or more with letters that are not just a unit, and no component added to or left out of a method."""
    letters = F.regexp_replace(name, r"[^\p{L}]+", "")
    return (F.length(F.trim(name)) >= 2) & ~name.rlike(ABLATION_PATTERN) & (letters != "") & ~F.lower(letters).isin(*UNIT_TOKENS)


def parsed_cell(cell: Column) -> Column:
    """Value, deviation and unit of a table cell in one struct; a cell of several numbers before its bracket or deviation has no value."""
    number = F.lit(r"(-?\d+\.?\d*)")
    text = F.trim(F.coalesce(cell, F.lit("")))

    def parts(fixed: Column) -> Column:
        none = F.lower(fixed).isin(*NULL_CELLS)
        leading = F.regexp_extract_all(F.split(fixed, r"[(±]", 2)[0], number, 1)
        first = bound(leading, lambda n: F.when(F.size(n) == 1, n[0]).when(F.size(n) == 0, F.get(F.regexp_extract_all(fixed, number, 1), F.lit(0))))
        value = F.when(~none, first.try_cast("double"))
        return F.struct(value.alias("value"), F.nullif(F.regexp_extract(fixed, r"±\s*(\d+\.?\d*)", 1), F.lit("")).try_cast("double").alias("deviation"), F.when(~none & fixed.contains("%"), F.lit("%")).alias("unit"))

    def told(said: Column) -> Column:  # most cells are a bare number or have none
        plain = F.struct(said.try_cast("double").alias("value"), F.lit(None).cast("double").alias("deviation"), F.lit(None).cast("string").alias("unit"))
        none = F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("deviation"), F.when(said.contains("%"), F.lit("%")).alias("unit"))
        whole = bound(F.regexp_replace(said, r"(\d)\s*\.\s*(\d)", "$1.$2"), parts)
        return F.when(said.rlike(r"^-?\d+(\.\d+)?$"), plain).when(~said.rlike("[0-9]"), none).otherwise(whole)

    return bound(text, told)


def cell_value(cell: Column) -> tuple[Column, Column, Column]:
    """(value, deviation, unit) of a table cell."""
    found = parsed_cell(cell)
    return found["value"], F.when(found["value"].isNotNull(), found["deviation"]), found["unit"]


def with_parsed(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the struct of :func:`parsed_cell` of the column ``text``, those without a value left out; for many cells, as steps between columns are compiled and lambdas are not."""
    number = F.lit(r"(-?\d+\.?\d*)")
    said = rows.withColumn("said_", F.trim(F.coalesce(text, F.lit(""))))
    said = said.withColumn("plain_", F.col("said_").rlike(r"^-?\d+(\.\d+)?$"))
    said = said.withColumn("fixed_", F.when(~F.col("plain_") & F.col("said_").rlike("[0-9]"), F.when(F.col("said_").contains("."), F.regexp_replace("said_", r"(\d)\s*\.\s*(\d)", "$1.$2")).otherwise(F.col("said_"))))
    said = said.withColumn("leading_", F.when(~F.lower("fixed_").isin(*NULL_CELLS), F.regexp_extract_all(F.regexp_extract("fixed_", r"^[^(±]*", 0), number, 1)))
    first = F.when(F.size("leading_") == 1, F.get("leading_", F.lit(0))).when(F.size("leading_") == 0, F.nullif(F.regexp_extract("fixed_", r"-?\d+\.?\d*", 0), F.lit("")))
    said = said.withColumn("value_", F.when(F.col("plain_"), F.col("said_")).otherwise(first).try_cast("double"))
    deviation = F.nullif(F.regexp_extract("fixed_", r"±\s*(\d+\.?\d*)", 1), F.lit("")).try_cast("double")  # an empty text costs an exception each
    unit = F.when(F.col("fixed_").contains("%"), F.lit("%"))
    cell = F.when(F.col("value_").isNotNull(), F.array(F.struct(F.col("value_").alias("value"), deviation.alias("deviation"), unit.alias("unit"))))
    told = said.select(*rows.columns, F.explode_outer(cell).alias("cell"))  # a plain where would be put below all steps, and these done twice
    return told.where("cell IS NOT NULL")


def time_scope(label: Column) -> Column:
    """A latency header as a slug of its words, without what stands in brackets; null if nothing is left."""
    words = F.trim(replaced(F.lower(label), (r"\(.*?\)", " "), ("[^a-z]+", " ")))
    return F.nullif(F.regexp_replace(words, r"\s+", "-"), F.lit(""))


def protocol_tokens(header: Column, caption: Column) -> Column:
    """Tokens of the protocol axes that a header or caption names, in axis order; an axis that is not named has none."""
    said = F.concat_ws(" || ", F.coalesce(header, F.lit("")), F.coalesce(caption, F.lit("")))
    return F.array_compact(F.array(*[F.coalesce(*[F.when(said.rlike("(?i)" + p), F.lit(t)) for t, p in axis], F.lit(None).cast("string")) for axis in PROTOCOL_AXES]))


def protocol_places(text: Column) -> Column:
    """For each protocol axis the place of its first pattern that ``text`` matches, null for none.

    No pattern matches a bar, so the places of a header and its caption, or of labels joined by bars, are the least of theirs, and each can be settled alone.
    """
    return F.array(*[F.coalesce(*[F.when(text.rlike("(?i)" + p), F.lit(i)) for i, (_, p) in enumerate(axis)], F.lit(None).cast("int")) for axis in PROTOCOL_AXES])


def least_places(several: Column) -> Column:
    """The least place of each axis in an array of places."""
    return F.array(*[F.array_min(F.transform(several, lambda one: one[n])) for n in range(len(PROTOCOL_AXES))])


def tokens_at(places: Column, others: Column) -> Column:
    """The tokens of :func:`protocol_tokens` by the places of a header and of its caption."""
    at = [F.least(F.get(places, F.lit(n)), F.get(others, F.lit(n))) for n in range(len(PROTOCOL_AXES))]
    return F.array_compact(F.array(*[F.coalesce(*[F.when(x == i, F.lit(t)) for i, (t, _) in enumerate(axis)], F.lit(None).cast("string")) for x, axis in zip(at, PROTOCOL_AXES)]))


def with_tokens(condition: Column, tokens: Column) -> Column:
    """The condition's tokens and then the new ones among ``tokens``, joined by colons; null if there are none."""
    own = F.array_remove(F.split(F.coalesce(condition, F.lit("")), ":"), "")
    return F.nullif(F.array_join(F.concat(own, F.array_except(tokens, own)), ":"), F.lit(""))


def copy_status(caption: Column) -> Column:
    """all, except or ambiguous if a caption says that results are another paper's; null if it does not."""
    said = F.coalesce(caption, F.lit(""))
    return F.when(said.rlike(COPY_PATTERN), F.when(said.rlike(EXCEPT_PATTERN), "except").when(said.contains("*"), "ambiguous").otherwise("all"))


def caption_copied(method: Column, caption: Column) -> Column:
    """Whether the caption says that this method's numbers are copied; excepted names match as whole tokens."""
    names = F.filter(F.transform(F.split(F.regexp_extract(caption, EXCEPT_PATTERN, 1), r"\s+and\s+|,"), lambda n: F.trim(n)), lambda n: n != "")

    def flat(c):
        return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

    def tokens(c):
        return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)

    same = F.exists(names, lambda n: (flat(n) != "") & (flat(method) != "") & ((flat(n) == flat(method)) | F.array_contains(tokens(method), flat(n)) | F.array_contains(tokens(n), flat(method))))
    status = copy_status(caption)
    return F.coalesce((status == "all") | ((status == "except") & ~same), F.lit(False))


def header_first(first: Column) -> Column:
    """Whether a row's first cell is one that begins headers: blank, or naming a column."""
    said = F.lower(F.trim(F.coalesce(first, F.lit(""))))
    return (said == "") | reduce(lambda a, b: a | b, [said.contains(t) for t in HEADER_TOKENS])


def header_row(first: Column, numbers_after: Column) -> Column:
    """Whether a row is a header: its first cell is blank or names a column, and no later cell is a number."""
    return header_first(first) & (numbers_after == 0)


def metric_of(label: Column, metrics: list[dict]) -> Column:
    """The id of the metric that a label names: by an alias as a whole, else by the longest alias of four characters or more in it."""
    keyed = [(m["id"], _plain_key(a)) for m in metrics for a in (m["id"], *m.get("aliases", ()))]

    def named(key: Column) -> Column:
        whole = [F.when(key == a, F.lit(i)) for i, a in keyed]
        inside = [F.when(key.contains(a), F.lit(i)) for i, a in sorted(keyed, key=lambda x: -len(x[1])) if len(a) >= 4]
        return F.coalesce(*whole, *inside, F.lit(None).cast("string"))

    return bound(registry_key(label), named)


def condition_of(label: Column, conditions: list[dict]) -> Column:
    """The id of the condition that a label names: by an alias as a whole, else by the first alias of four characters or more in it."""
    keyed = [(c["id"], _plain_key(a)) for c in conditions for a in (c["id"], *c.get("aliases", ()))]

    def named(key: Column) -> Column:
        return F.coalesce(*[F.when(key == a, F.lit(i)) for i, a in keyed], *[F.when(key.contains(a), F.lit(i)) for i, a in keyed if len(a) >= 4], F.lit(None).cast("string"))

    return bound(registry_key(label), named)


def unit_of(label: Column, default: Column) -> Column:
    """The unit that a label names itself, else the metric's."""
    said = F.lower(label)
    return F.when(said.rlike(r"\(ms\)|\bms\b"), "ms").when(said.rlike(r"\(s\)|\bs\b|\(sec\)|\bseconds?\b"), "s").when(said.rlike(r"\(fps\)|\bfps\b"), "fps").otherwise(default)


def _plain_key(alias: str) -> str:
    """An alias of a configuration, which has neither marks nor counts, as :func:`registry_key` writes it."""
    return " ".join(alias.lower().replace("-", " ").replace("_", " ").replace("/", " ").replace("%", " ").replace("(", " ").replace(")", " ").split())
