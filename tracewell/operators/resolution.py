"""Resolving names, metrics, conditions and quotes against vocabularies and texts."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L


#: So many quotes are broadcast to the documents at most; more are met by a shuffle of hashes.
BROADCAST_QUOTES = 20_000


def resolve_methods(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """(mention, method, how): exact key, then key without separators, then a known name inside the mention.

    Each step is an equi-join on what the step compares; for containment both sides are met by the words of the registry name.
    Only mentions that a step leaves open go on.
    """
    known = registry.select("method", L.registry_key(F.col("name")).alias("key")).groupBy("key").agg(F.min("method").alias("method"))
    asked = mentions.select("mention").distinct().withColumn("key", L.registry_key(F.col("mention")))
    exact = asked.join(known, "key").select("mention", "method", F.lit("exact").alias("how"))
    rest = asked.join(exact, "mention", "left_anti")
    tight = known.withColumn("tight", F.regexp_replace("key", " ", "")).where(F.length("tight") >= 5).groupBy("tight").agg(F.min("method").alias("method"))
    compact = rest.withColumn("tight", F.regexp_replace("key", " ", "")).join(tight, "tight").select("mention", "method", F.lit("compact").alias("how"))
    rest = rest.join(compact, "mention", "left_anti")
    words = rest.select("mention", "key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    first = known.where(F.length("key") >= 5).withColumn("word", F.split("key", " ")[0])
    inside = words.join(first.select("word", F.col("key").alias("name_key"), "method"), "word").where(F.concat(F.lit(" "), "key", F.lit(" ")).contains(F.concat(F.lit(" "), "name_key", F.lit(" "))))
    best = inside.groupBy("mention").agg(F.max(F.struct(F.length("name_key").alias("n"), F.col("method"))).alias("m")).select("mention", F.col("m.method").alias("method"), F.lit("contained").alias("how"))
    return exact.unionByName(compact).unionByName(best)


def hash_of_words(width: int):
    return lambda at: F.xxhash64(F.array_join(F.slice("words", at, F.lit(width)), " "))


def verified_quotes(quotes: DataFrame, docs: DataFrame, width: int = 8) -> DataFrame:
    """Quotes that stand in a document: equal after white space and case are folded, 15 characters at least.

    Candidates meet on the hash of a quote's first ``width`` words, which each document offers for each of its
    places; containment is then checked in full. Quotes of fewer words meet on all their words.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q = quotes.select("item_id", fold(F.col("text")).alias("quote")).where(F.length("quote") >= 15).withColumn("words", F.split("quote", " "))
    q = q.withColumn("width", F.least(F.lit(width), F.size("words"))).withColumn("key", F.xxhash64(F.array_join(F.slice("words", 1, F.col("width")), " ")))
    sizes = q.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``width`` rows
    widths = [r["width"] for r in sizes]
    few = sum(r["n"] for r in sizes) <= BROADCAST_QUOTES
    d = docs.select("doc_id", fold(F.col("text")).alias("body")).withColumn("words", F.split("body", " "))
    found = None
    for n in widths:
        places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - n + 1)), hash_of_words(n))
        keys = d.select("doc_id", F.explode(F.array_distinct(places)).alias("key"))
        asked = q.where(F.col("width") == n).select("item_id", "quote", "key")
        met = keys.join(F.broadcast(asked) if few else asked, "key").select("doc_id", "item_id", "quote").distinct()
        found = met if found is None else found.unionByName(met)
    if found is None:
        return quotes.sparkSession.createDataFrame([], "doc_id long, item_id long")
    return found.join(d.select("doc_id", "body"), "doc_id").where(F.col("body").contains(F.col("quote"))).select("doc_id", "item_id")


def ungrounded_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers of the answer that the evidence lacks; years and integers up to ten are exempt."""
    def numbers(c: Column) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))

    exempt = lambda x: x.rlike(r"^(19|20)\d\d$") | x.rlike(r"^(\d|10)$")
    return F.array_sort(F.array_distinct(F.filter(F.array_except(numbers(answer), numbers(evidence)), lambda x: ~exempt(x))))


def shortened(words: DataFrame, word: str, most: Column) -> DataFrame:
    """``words`` with each string (``key``) that up to ``most`` deletions, three at most, leave of them; its own too."""
    level = words.withColumn("key", F.col(word)).withColumn("gone", F.lit(0))
    every = level
    for n in range(1, 4):
        places = F.sequence(F.lit(1), F.length("key"))
        cuts = F.transform(places, lambda i: F.concat(F.substring(F.col("key"), F.lit(1), i - 1), F.substring(F.col("key"), i + 1, F.length("key"))))
        level = level.where((most >= n) & (F.length("key") > 0)).withColumn("key", F.explode(F.array_distinct(cuts))).withColumn("gone", F.lit(n)).distinct()
        every = every.unionByName(level)
    return every.drop("gone").distinct()


def corrected(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, fixed, distance): the closest vocabulary word within 1, 2 or 3 edits for words up to 4, 7 or more letters.

    Words within k edits share a string that k deletions or fewer leave of both, on which they meet; the exact
    distance is checked after. Ties go to the smaller word. Words of the vocabulary are left alone; capitals are restored.
    """
    edits = F.when(F.length("low") <= 4, 1).when(F.length("low") <= 7, 2).otherwise(3)
    v = vocabulary.select(F.lower("word").alias("known")).distinct()
    w = words.select("word", F.lower("word").alias("low")).distinct().withColumn("edits", edits).join(v, F.col("low") == F.col("known"), "left_anti")
    met = shortened(w, "low", F.col("edits")).join(shortened(v, "known", F.lit(3)), "key").where(F.abs(F.length("low") - F.length("known")) <= F.col("edits")).select("word", "low", "edits", "known").distinct()
    near = met.withColumn("distance", F.levenshtein("low", "known")).where("distance <= edits")
    best = near.groupBy("word").agg(F.min(F.struct("distance", "known")).alias("m"))
    rest = F.substring(F.col("word"), F.lit(2), F.length("word"))
    title = (F.length("word") > 1) & (F.substring("word", 1, 1) == F.upper(F.substring("word", 1, 1))) & (rest == F.lower(rest))
    capital = (F.length("word") > 1) & (F.col("word") == F.upper("word"))
    fixed = F.when(title, F.concat(F.upper(F.substring("m.known", 1, 1)), F.substring(F.col("m.known"), F.lit(2), F.length("m.known")))).when(capital, F.upper("m.known")).otherwise(F.col("m.known"))
    return best.select("word", fixed.alias("fixed"), F.col("m.distance").alias("distance"))


#: Ways to define an acronym: (pattern, group of the acronym, group of the full form, whether letters must agree).
ACRONYM_FORMS = (
    (r"((?:[\p{L}-]+ ){2,7})\(([A-Z][A-Za-z]{1,7})\)", 2, 1, True),
    (r"\b([A-Z]{2,8}) \(([A-Z][\p{L}-]+(?: [\p{L}-]+){1,6})\)", 1, 2, True),
    (r"\b([A-Z]{2,8}),? or ([A-Z][\p{L}-]+(?: [A-Z][\p{L}-]+){1,6})", 1, 2, False),
)


def acronyms(docs: DataFrame) -> DataFrame:
    """(acronym, full_form, n): acronyms defined before or after their full form or by 'or'; the first definition wins, n documents define it.

    In a bracketed form the acronym's letters are the initials of the words, or half of them are initials of capitalised or
    long words; of words before the brackets only the last ones, as many as the acronym has letters, count.
    """
    every = None
    for pattern, acronym, full, agrees in ACRONYM_FORMS:
        hits = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("at", "hit"))
        part = hits.select("doc_id", "at", F.regexp_extract("hit", pattern, acronym).alias("acronym"), F.split(F.trim(F.regexp_extract("hit", pattern, full)), " ").alias("words"))
        if acronym > full:
            n = F.length("acronym")
            part = part.withColumn("words", F.slice("words", F.greatest(F.lit(1), F.size("words") - n + 1), n))
        if agrees:
            initials = F.array_join(F.transform(F.filter("words", lambda w: w.rlike("^[A-Z]") | (F.length(w) > 3)), lambda w: F.upper(F.substring(w, 1, 1))), "")
            letters = F.split(F.upper("acronym"), "")
            plain = F.upper(F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), ""))
            half = F.size(F.filter(letters, lambda c: initials.contains(c) & (c != ""))) >= F.length("acronym") * 0.5
            part = part.where((F.size("words") >= 2) & ((plain == F.upper("acronym")) | half))
        part = part.select("acronym", "doc_id", "at", F.array_join("words", " ").alias("full"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("acronym").agg(F.min(F.struct("doc_id", "at", "full")).alias("m"), F.countDistinct("doc_id").alias("n")).select("acronym", F.col("m.full").alias("full_form"), "n")


def mentions(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, alias, n): how often each one-word alias stands in each document, by an equi-join on words."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("alias")).groupBy("doc_id", "alias").agg(F.count(F.lit(1)).alias("n"))
    return words.join(aliases.select(F.lower("alias").alias("alias")).distinct(), "alias")


def packed(chunks: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Greedy packs of consecutive chunks of up to ``most`` tokens: (key, pack, first, last, tokens).

    Sizes are sorted by document and read as a stream, in time linear in the chunks; texts do not move.
    """
    kind = dict(chunks.dtypes)[key]

    def packs(batches):
        now, out = None, []  # [key, pack, first, last, tokens]
        for batch in batches:
            for k, seq, tokens in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "tokens")), strict=True):
                if now is not None and now[0] == k and now[4] + tokens <= most:
                    now[3:] = [seq, now[4] + tokens]
                else:
                    if now is not None:
                        out.append(now)
                    now = [k, now[1] + 1 if now is not None and now[0] == k else 0, seq, seq, tokens]
            if len(out) > 4096:
                yield rows(out, batch.schema.field("key").type)
                out = []
        if now is not None:
            yield rows([*out, now], batch.schema.field("key").type)

    def rows(found, key_type):
        kinds = (key_type, pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [key, "pack", "first", "last", "tokens"])

    sizes = chunks.select(F.col(key).alias("key"), F.col("seq").cast("int"), F.col("tokens").cast("int")).repartition("key").sortWithinPartitions("key", "seq")
    return sizes.mapInArrow(packs, f"{key} {kind}, pack int, first int, last int, tokens int")


def merged_groups(groups: DataFrame, least: int, most: int, key: str = "doc_id") -> DataFrame:
    """(key, seq, sentence, pack): groups of sentences merged into packs of ``least`` to ``most`` tokens, in one pass over each document.

    ``groups`` has key, seq and sizes, the tokens of a group's sentences. Groups join the open pack while they fit. Where one does not, a pack that is
    large enough is closed; one that is too small absorbs the group, whatever its size, and is closed if it is large enough then. A group
    larger than a pack is cut between sentences. What is open at the end is closed if large enough or alone, else it joins the last pack.
    """
    kind = dict(groups.dtypes)[key]

    class Fold:
        def __init__(self) -> None:
            self.packs: list[list[tuple[int, int]]] = []
            self.open: list[tuple[int, int]] = []
            self.tokens = 0

        def close(self) -> None:
            self.packs.append(self.open)
            self.open, self.tokens = [], 0

        def add(self, seq: int, sizes: list[int]) -> None:
            total, own = sum(sizes), [(seq, i) for i in range(len(sizes))]
            if self.tokens + total <= most:
                self.open, self.tokens = self.open + own, self.tokens + total
                return
            if self.open and self.tokens < least:
                self.open, self.tokens = self.open + own, self.tokens + total
                if self.tokens >= least:
                    self.close()
                return
            if self.open:
                self.close()
            for place, size in zip(own, sizes, strict=True):
                if total > most and self.tokens + size > most and self.open:
                    self.close()
                self.open.append(place)
                self.tokens += size

        def end(self) -> list[list[tuple[int, int]]]:
            if self.open:
                if self.tokens >= least or not self.packs:
                    self.close()
                else:
                    self.packs[-1] = self.packs[-1] + self.open
            return self.packs

    def fold(batches):
        def stream():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "sizes")), strict=True)

        for name, own in groupby(stream(), key=lambda r: r[0]):
            f = Fold()
            for _, seq, sizes in own:
                f.add(seq, sizes)
            rows = [(name, seq, i, n) for n, pack in enumerate(f.end()) for seq, i in pack]
            if rows:
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0], *[c.cast(pa.int32()) for c in columns[1:]]], [key, "seq", "sentence", "pack"])

    rows = groups.where(F.size("sizes") > 0).select(F.col(key).alias("key"), F.col("seq").cast("int"), F.col("sizes").cast("array<int>")).repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInArrow(fold, f"{key} {kind}, seq int, sentence int, pack int")


def first_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)
