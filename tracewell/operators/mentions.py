"""Mentions of names of many words in texts, by one automaton over all aliases, and methods that a question names.

All aliases of a task are one automaton, so a text is read once however many there are. Up to ``CHARACTERS`` characters of
aliases go to every task as they are; more are dealt into shards by a hash of the target, each a task's automaton,
and texts are met with every shard. All aliases of one target share a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prose import sentiment
from ..session import dealt, staged

#: Characters of aliases in one automaton, which takes some hundred bytes for each.
CHARACTERS = 1_000_000
#: Text blocks that a shard is met with.
BLOCKS = 64
MENTION = "source string, target string, mentions int, contexts array<string>, matched string"


def lowered(text: str) -> str:
    """Lower case, place by place: characters that would become two stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def automaton(aliases: list[tuple[str, str]]):
    """An automaton whose words carry the targets that they name; None without aliases."""
    named: dict[str, set[str]] = {}
    for target, alias in aliases:
        if alias:
            named.setdefault(lowered(alias), set()).add(target)
    found = ahocorasick.Automaton()
    for alias, targets in named.items():
        found.add_word(alias, (alias, tuple(sorted(targets))))
    if not named:
        return None
    found.make_automaton()
    return found


def found_in(source: str, text: str, names, reach: int, shown: int) -> Iterator[tuple]:
    """One row per target other than the source that the text names: whole words, the longest alias at a place, none inside another."""
    low, places = lowered(text), {}
    for end, (alias, targets) in names.iter(low):
        start, end = end - len(alias) + 1, end + 1
        if (start and wordy(low[start - 1]) == wordy(alias[0])) or (end < len(low) and wordy(low[end]) == wordy(alias[-1])):
            continue  # no word's border on one side
        if (not start and not wordy(alias[0])) or (end == len(low) and not wordy(alias[-1])):
            continue
        for target in targets:
            if target != source:
                places.setdefault(target, []).append((start, -end))
    for target, hits in places.items():
        kept, last = [], 0
        for start, end in sorted(hits):
            if start >= last:
                kept.append((start, -end))
                last = -end
        contexts = [text[max(0, s - reach) : e + reach].replace("\n", " ").strip() for s, e in kept[:shown]]
        yield source, target, len(kept), contexts, text[kept[0][0] : kept[0][1]]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["source", "target", "mentions", "contexts", "matched"])


def mentions(texts: DataFrame, aliases: DataFrame, *, least: int = 100, reach: int = 100, shown: int = 3, characters: int = CHARACTERS) -> DataFrame:
    """(source, target, mentions, contexts, matched, sentiment): how often each text names each target, by whole aliases without regard to case.

    ``texts`` has source and text, ``aliases`` target and alias. A text of under ``least`` characters names nothing, and none names itself.
    Where aliases of one target overlap, the first, and of those that start together the longest, counts. The first ``shown``
    places come with ``reach`` characters on both sides, and the sentiment is that of these. Null texts and aliases count for nothing.
    """
    rows = texts.where(F.length("text") >= least).select(F.col("source").cast("string").alias("source"), "text")
    known = staged(aliases.where(F.col("alias") != "").select(F.col("target").cast("string").alias("target"), "alias").distinct())
    size = known.agg(F.sum(F.length("alias"))).first()[0] or 0
    if size <= characters:
        pairs = [(r["target"], r["alias"]) for r in known.collect()]

        def read(batches):
            names = automaton(pairs)
            for batch in batches:
                out = [m for s, t in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in found_in(s, t, names, reach, shown)] if names else []
                if out:
                    yield batch_of(out)

        found = rows.mapInArrow(read, MENTION)
    else:
        shards = -(-size // characters)
        cells = known.withColumn("shard", F.pmod(F.xxhash64("target"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
        asked = rows.withColumn("block", F.pmod(F.xxhash64("source", "text"), F.lit(BLOCKS)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        both = cells.select("shard", "block", F.lit(0).alias("kind"), F.col("target").alias("source"), F.col("alias").alias("text")).unionByName(asked.select("shard", "block", F.lit(1).alias("kind"), "source", "text"))

        def met(batches):
            cell, names, held = None, None, []
            for batch in batches:
                out = []
                for shard, block, kind, source, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "kind", "source", "text")), strict=True):
                    if (shard, block) != cell:
                        cell, names, held = (shard, block), None, []
                    if kind == 0:
                        held.append((source, text))
                    elif held or names:
                        if held:
                            names, held = automaton(held), []
                        out.extend(found_in(source, text, names, reach, shown))
                if out:
                    yield batch_of(out)

        found = both.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind").mapInArrow(met, MENTION)
    return found.withColumn("sentiment", sentiment(F.array_join("contexts", " ")))


def name_forms(name: Column) -> Column:
    """Aliases of a name of three characters or more, in lower case: itself, hyphens as blanks and as nothing, blanks as hyphens, words of a camel-case name apart, a bracketed acronym in capitals."""
    low = F.lower(name)
    camel = F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"))
    acronym = F.lower(F.regexp_extract(name, r"\(([A-Z]{2,})\)", 1))
    return F.filter(F.array_distinct(F.array(low, F.replace(low, F.lit("-"), F.lit(" ")), F.replace(low, F.lit("-"), F.lit("")), F.replace(low, F.lit(" "), F.lit("-")), camel, acronym)), lambda a: F.length(a) >= 3)


def named_in(queries: DataFrame, methods: DataFrame) -> DataFrame:
    """(query_id, method): the methods that a question names by their name, bracketed short form or name without brackets.

    An alias of one word and three characters or more must be a word of the question, one of five characters or more may also stand between blanks. Both
    are equi-joins: on the question's words, and on its runs of blank-separated words as long as an alias. Questions are dealt to tasks first, so that what
    they name stays with them.
    """
    name = F.lower(F.trim(F.regexp_replace("method", r"^[^\p{L}\p{N}]+", "")))
    short = F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), 1), lambda a: F.trim(F.regexp_replace(a, "[()]", "")))
    forms = F.filter(F.array_distinct(F.concat(F.array(name), short, F.array(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "))))), lambda a: a != "")
    known = staged(methods.select("method", F.explode(forms).alias("alias")).distinct())
    asked = dealt(queries.select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("low")), "query_id")
    words = asked.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("([a-z0-9]+)"), 1))).alias("alias"))
    by_word = words.join(known.where(F.col("alias").rlike("^[a-z0-9]{3,}$")), "alias")
    longer = known.where(F.length("alias") >= 5).withColumn("n", F.size(F.split("alias", " ")))
    most = longer.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))  # one row
    parts = asked.crossJoin(F.broadcast(most)).withColumn("parts", F.split("low", " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.col("most"), F.size("parts") - i + 1)), lambda n: F.array_join(F.slice("parts", i, n), " "))))
    by_run = parts.where("most > 0").select("query_id", F.explode(F.array_distinct(runs)).alias("alias")).join(longer.drop("n"), "alias")
    return by_word.unionByName(by_run).select("query_id", "method").distinct()


def first_mentions(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` targets that each source mentions most; a top-k report."""
    return found.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("mentions"), "target"))).where(F.col("place") <= k)
