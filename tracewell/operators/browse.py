"""What a browser of methods, cells, records and chunks asks for: searches, facets, tags, summaries, texts for an answer."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dealt, staged
from .facts import places
from .ranks import numbered

NOT_REPORTED = "not reported"
# What condition tokens are called, and synonyms that widen a question.
TOKEN_CATEGORIES = (
    ("Scene", ("packed", "pile", "real", "sim", "isolated", "cluttered")), ("Success criterion", ("gsr", "dr", "sr")), ("Camera view", ("fixedview", "randomview")), ("Depth noise", ("gammanoise", "gaussnoise")),
    ("Object set", ("egad", "ycb", "partnet")), ("Training", ("noretrain",)),
)
TOKEN_ALIASES = {"simulation": "sim"}
SYNONYMS = (
    ("gripper", "end-effector", "hand"), ("fast", "speed", "latency", "runtime", "time"), ("accuracy", "success", "precision"), ("clutter", "cluttered", "pile", "piled"), ("sim", "simulation", "simulated"),
    ("real", "physical", "real-world"), ("grasp", "grasping"), ("plan", "planner", "planning"),
)


def table_search(methods: DataFrame, name: str, attributes: tuple[str, ...], term: str, filters: dict[str, str], highlighted: list[str]) -> DataFrame:
    """Rows whose name or any attribute contains the term and whose columns have the values asked for; ``place``: highlighted ones first, then by name."""
    text = F.lower(F.concat_ws(" ", name, *attributes))
    kept = reduce(lambda df, f: df.where(F.lower(f[0]) == f[1].lower()), filters.items(), methods.where(text.contains(term.lower())))
    return numbered(kept, [], [F.desc(F.col(name).isin(highlighted)), F.lower(name), name, *(c for c in kept.columns if c != name)])


def record_search(records: DataFrame, columns: tuple[str, ...], term: str, known: DataFrame | None = None) -> DataFrame:
    """Records with the term in one of the columns; with ``known`` (method) only those of known methods."""
    found = records.where(F.lower(F.concat_ws(" ", *columns)).contains(term.lower()))
    return found if known is None else found.join(known.select("method").distinct(), "method", "left_semi")


def legend_filter(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows one of whose comma-separated values is exactly ``value``."""
    return rows.where(F.exists(F.split(column, ","), lambda v: F.trim(v) == value))


def evidence_filter(chunks: DataFrame, role: str | None, content: str | None, papers: DataFrame) -> DataFrame:
    """Chunks of a role and content, of the traversed papers if any of these has one, else of all."""
    kept = chunks if role is None else chunks.where(F.col("role") == role)
    kept = kept if content is None else kept.where(F.col("content") == content)
    marked = kept.join(papers.select("paper", F.lit(True).alias("traversed")).distinct(), "paper", "left").withColumn("traversed", F.coalesce("traversed", F.lit(False)))
    some = marked.agg(F.coalesce(F.max("traversed"), F.lit(False)).alias("any_traversed"))
    return marked.crossJoin(F.broadcast(some)).where(F.col("traversed") | ~F.col("any_traversed")).drop("traversed", "any_traversed")


def filter_cells(cells: DataFrame, entries: DataFrame, attributes: DataFrame, equal: dict[str, str], wanted: dict[str, str]) -> DataFrame:
    """Cells with the values asked for in which one method has all attributes asked for.

    ``entries`` has metric, condition, method; ``attributes`` method and a column per attribute.
    """
    kept = reduce(lambda df, f: df.where(F.col(f[0]) == f[1]), equal.items(), cells)
    if not wanted:
        return kept
    fits = reduce(lambda df, f: df.where(F.lower(f[0]) == f[1].lower()), wanted.items(), attributes).select("method")
    return kept.join(entries.join(fits, "method", "left_semi").select("metric", "condition"), ["metric", "condition"], "left_semi")


def bare_name(name: Column) -> Column:
    """A name without what stands before its first letter or digit, without regard to case."""
    return F.lower(F.trim(F.regexp_replace(name, r"^[^\p{L}\p{N}]+", "")))


def method_attributes(entries: DataFrame, methods: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Entries with each field of their method: its first column, else its second, else 'not reported'."""
    def value(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit("")), F.lit(NOT_REPORTED))

    known = methods.groupBy(bare_name(F.col("name")).alias("bare")).agg(*[F.min(c).alias(c) for pair in fields.values() for c in pair])
    joined = entries.withColumn("bare", bare_name(F.col("method"))).join(known, "bare", "left")
    return joined.select(*entries.columns, *[value(a, b).alias(f) for f, (a, b) in fields.items()])


def paper_of_method(methods: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, paper): by the method's label and its described_in edge; the smallest paper."""
    named = methods.select("method").distinct().join(nodes.where("type = 'method'").select("id", F.col("label").alias("method")), "method")
    return named.join(edges.where("type = 'described_in'").select(F.col("src").alias("id"), "dst"), "id").groupBy("method").agg(F.min("dst").alias("paper"))


def summaries(methods: DataFrame, first: list[str], fields: dict[str, str], most: int) -> DataFrame:
    """(place, name, summary) of at most ``most`` methods: those named first in their order, then the others; a top-k report.

    ``methods`` has name, place and the fields, which are written as short=value where they have one.
    """
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col("name")), F.lit(0)), F.lit(len(first) + 1))
    text = F.concat_ws("; ", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{short}="), F.trim(c))) for c, short in fields.items()])
    ranked = methods.select("name", text.alias("summary"), at.alias("at"), "place").orderBy("at", "place").limit(most)
    return ranked.select(F.row_number().over(W.orderBy("at", "place")).cast("int").alias("place"), "name", "summary")


def best_chunks(claims: DataFrame, chunks: DataFrame, least: int = 4) -> DataFrame:
    """(claim_id, chunk_id, shared, support): the chunk that shares most words of ``least`` letters with a claim, met by the words; support is their share of the claim's.

    Of chunks with equal sets of words the first stands for all. Sets are dealt to tasks; where the claims' words are few enough to be sent to all, a set's
    matches are counted and ranked where it lies.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"([a-z0-9]{{{least},}})"), 1)))
    said = staged(claims.select("claim_id", F.explode(words).alias("word")))
    sizes = said.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    sets = dealt(chunks.select("chunk_id", "text"), "chunk_id").select("chunk_id", words.alias("words")).where(F.size("words") > 0).groupBy("words").agg(F.min("chunk_id").alias("chunk_id"))
    held = dealt(sets, "chunk_id").select("chunk_id", F.explode("words").alias("word"))
    met = held.join(said, "word").groupBy("claim_id", "chunk_id").agg(F.count(F.lit(1)).alias("shared"))
    best = met.groupBy("claim_id").agg(F.min(F.struct((-F.col("shared")).alias("a"), "chunk_id")).alias("b"))
    return best.join(sizes, "claim_id").select("claim_id", "b.chunk_id", (-F.col("b.a")).alias("shared"), F.round(-F.col("b.a") / F.col("n"), 6).alias("support"))


def parsed_triples(answers: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(answer_id, relation, object, quote) of the JSON array in an answer, whatever stands around it; other relations and empty parts are dropped."""
    body = F.regexp_extract("answer", r"(?s)(\[.*\])", 1)
    rows = answers.select("answer_id", F.posexplode(F.from_json(body, "array<struct<relation: string, object: string, quote: string>>")).alias("i", "t"))
    return rows.where(F.col("t.relation").isin(*relations) & (F.trim("t.object") != "") & (F.trim("t.quote") != "")).select("answer_id", "i", "t.relation", "t.object", "t.quote")


def parsed_entities(answers: DataFrame, kinds: tuple[str, ...], least: int = 6, most: int = 300) -> DataFrame:
    """(answer_id, i, type, value, confidence) of the JSON array in an answer, fenced or with text around it: known types and values of ``least`` characters or more, cut at ``most``.

    An array that is cut off or broken gives nothing, as it cannot be told what is whole; a missing confidence is medium.
    """
    body = F.regexp_extract(F.coalesce(F.nullif(F.regexp_extract("answer", r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1), F.lit("")), F.col("answer")), r"(?s)(\[.*\])", 1)
    rows = answers.select("answer_id", F.posexplode(F.from_json(body, "array<struct<type: string, value: string, confidence: string>>")).alias("i", "e"))
    good = rows.where(F.col("e.type").isin(*kinds) & (F.length("e.value") >= least))
    return good.select("answer_id", "i", "e.type", F.substring("e.value", 1, most).alias("value"), F.coalesce("e.confidence", F.lit("medium")).alias("confidence"))


def structured_answers(answers: DataFrame) -> DataFrame:
    """(answer_id, answer, discussed, citations) of answers given as JSON, fenced or not; those that are not, or say nothing, are left out.

    What is discussed may be names or objects with id or method; a citation's marker and paper stand in for each other.
    """
    fenced = F.regexp_extract("answer", r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(F.col("answer").rlike(r"(?is)```(?:json)?\s*(.*?)```"), fenced).otherwise(F.col("answer")), r"(?s)(\{.*\})", 1)
    shape = "answer string, discussed array<string>, methods array<string>, citations array<struct<marker: string, paper_id: string, paper_title: string>>"
    told = answers.select("answer_id", F.from_json(body, shape).alias("o")).where(F.trim(F.coalesce("o.answer", F.lit(""))) != "")

    def name(d: Column) -> Column:
        is_object = F.coalesce(d, F.lit("")).startswith("{")
        inner = F.coalesce(F.nullif(F.get_json_object(d, "$.id"), F.lit("")), F.get_json_object(d, "$.method"), F.lit(""))
        return F.trim(F.when(is_object, inner).otherwise(F.coalesce(d, F.lit(""))))

    names = F.filter(F.transform(F.coalesce("o.discussed", "o.methods", F.array().cast("array<string>")), name), lambda n: n != "")
    either = lambda a, b: F.trim(F.coalesce(F.nullif(a, F.lit("")), b, F.lit("")))
    cited = F.transform(F.filter(F.coalesce("o.citations", F.array().cast("array<struct<marker: string, paper_id: string, paper_title: string>>")), lambda c: c.isNotNull()), lambda c: F.struct(either(c["marker"], c["paper_id"]).alias("marker"), either(c["paper_id"], c["marker"]).alias("paper_id"), F.trim(F.coalesce(c["paper_title"], F.lit(""))).alias("paper_title")))
    return told.select("answer_id", F.trim("o.answer").alias("answer"), names.alias("discussed"), cited.alias("citations"))


def records_of_json(payloads: DataFrame, schema: str) -> DataFrame:
    """Records of JSON documents by an explicit schema: keys it lacks are dropped, missing ones are null, decimals broken by blanks are joined."""
    rows = payloads.select("payload_id", F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("r")).select("payload_id", "r.*")
    return rows.withColumn("value_str", F.regexp_replace("value_str", r"(\d)\s*\.\s*(\d)", "$1.$2"))


def records_of_comparisons(results: DataFrame) -> DataFrame:
    """Records as far as published results tell them: verified by grade A or B, medium confidence, no deviation."""
    return results.select("record_id", "method", "metric", "condition", "value", F.col("grade").isin("A", "B").alias("verified"), F.lit("medium").alias("confidence"), F.lit(None).cast("double").alias("std"))


def records_of_pairs(pairs: DataFrame) -> DataFrame:
    """(paper, method, metric, condition, value): both sides of win and lose pairs; the metric's words after its first are the condition, the metric is then the success rate."""
    condition = F.lower(F.regexp_replace(F.regexp_extract("metric", r"^\S+\s+(.*)$", 1), r"\s+", ":"))
    sides = F.explode(F.array(F.struct(F.col("winner").alias("method"), F.col("winner_value").alias("value")), F.struct(F.col("loser").alias("method"), F.col("loser_value").alias("value"))))
    return pairs.select("paper", sides.alias("s"), F.lit("success rate").alias("metric"), F.nullif(condition, F.lit("")).alias("condition")).select("paper", "s.method", "metric", "condition", "s.value").distinct()


def verified_values(records: DataFrame, crops: DataFrame) -> DataFrame:
    """Records with verified and confidence by whether their value, blanks left out, stands in the text of their table's crop."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    joined = records.join(crops, "table_id", "left")
    seen = flat(F.col("crop_text")).contains(flat(F.col("value_str"))) & (flat(F.col("value_str")) != "")
    return joined.select(*records.columns, seen.alias("verified"), F.when(seen, "high").otherwise("low").alias("confidence"))


def tags(records: DataFrame) -> DataFrame:
    """(record_id, category, value): method, metric, each token of the condition, grade and who reported it; tokens that only repeat the metric are left out."""
    category = F.coalesce(*[F.when(F.col("token").isin(*words), F.lit(name)) for name, words in TOKEN_CATEGORIES], F.lit("Measurement scope"))
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    tokens = records.select("record_id", "metric", F.explode(F.filter(F.split(F.coalesce("condition", F.lit("")), ":"), lambda t: t != "")).alias("token")).withColumn("category", category)
    repeats = (F.col("category") == "Measurement scope") & (F.col("token") != "success-rate-k") & flat(F.col("metric")).contains(flat(F.col("token")))
    own = F.array(
        F.struct(F.lit("Method").alias("category"), F.col("method").alias("value")), F.struct(F.lit("Metric").alias("category"), F.col("metric").alias("value")),
        F.struct(F.lit("Evidence grade").alias("category"), F.col("grade").alias("value")), F.struct(F.lit("Reported by").alias("category"), F.when(F.col("is_own"), "self").otherwise("third-party").alias("value")),
    )
    plain = records.select("record_id", F.explode(own).alias("t")).select("record_id", "t.category", "t.value").where("value IS NOT NULL")
    return plain.unionByName(tokens.where(~repeats).select("record_id", "category", F.col("token").alias("value"))).distinct()


def filter_by_tags(tagged: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """(record_id) of records with one chosen value in every category that has any."""
    hits = reduce(lambda a, b: a | b, [(F.col("category") == c) & F.col("value").isin(v) for c, v in chosen.items()])
    return tagged.where(hits).groupBy("record_id").agg(F.countDistinct("category").alias("n")).where(F.col("n") == len(chosen)).select("record_id")


def facets(condition: Column) -> Column:
    """Category to token of a condition, the first token of a category counting; what no category knows is listed under rest."""
    said = F.filter(F.split(F.coalesce(condition, F.lit("")), ":"), lambda t: t != "")
    tokens = F.transform(said, lambda t: F.coalesce(*[F.when(F.lower(t) == a, F.lit(name)) for a, name in TOKEN_ALIASES.items()], F.lower(t)))
    pairs = [F.struct(F.lit(name).alias("key"), F.get(F.array_intersect(tokens, F.array(*map(F.lit, words))), F.lit(0)).alias("value")) for name, words in TOKEN_CATEGORIES]
    known = [*(w for _, words in TOKEN_CATEGORIES for w in words), *TOKEN_ALIASES]
    rest = F.struct(F.lit("rest").alias("key"), F.nullif(F.array_join(F.filter(F.array_distinct(said), lambda t: ~F.lower(t).isin(known)), ":"), F.lit("")).alias("value"))
    return F.map_from_entries(F.filter(F.array(*pairs, rest), lambda p: p["value"].isNotNull()))


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of an alias, its hyphens read as blanks or its blanks as hyphens too; else the name in title case."""
    key = F.lower(F.trim(name))
    ways = [key, F.replace(key, F.lit("-"), F.lit(" ")), F.replace(key, F.lit(" "), F.lit("-"))]
    found = [F.when(way == alias, F.lit(full)) for way in ways for alias, full in aliases.items()]
    return F.coalesce(*found, F.initcap(F.trim(F.regexp_replace(name, r"[\s_-]+", " "))))


def contained_alias(text: Column, aliases: dict[str, str], most: int = 80) -> Column:
    """The name of the first alias that stands in a text, else its first sentence, ``most`` characters at most."""
    key = F.lower(F.trim(text))
    return F.coalesce(*[F.when(key.contains(a), F.lit(full)) for a, full in aliases.items()], F.substring(F.trim(F.split(text, r"\.")[0]), 1, most))


def expanded_terms(query: Column, acronyms: dict[str, str]) -> Column:
    """Distinct words of a question, synonyms of each, and the long forms of its acronyms; sorted."""
    own = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9-]+)"), 1))
    groups = [F.when(F.arrays_overlap(own, F.array(*map(F.lit, g))), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in SYNONYMS]
    long = [F.when(F.array_contains(own, a.lower()), F.array(*map(F.lit, full.lower().split()))).otherwise(F.array().cast("array<string>")) for a, full in acronyms.items()]
    return F.array_sort(F.array_distinct(F.concat(own, *groups, *long)))


def routed_metric(query: Column, keywords: dict[str, list[str]]) -> Column:
    """The metric whose keywords a question names: a hundred points a character of the longest one, one for each; the first of equals, null without any."""
    low = F.lower(query)
    scores = []
    for words in keywords.values():
        hits = [F.when(low.contains(w), F.lit(len(w))).otherwise(0) for w in words]
        longest = F.greatest(*hits, F.lit(0))
        scores.append(longest * 100 + sum(((h > 0).cast("int") for h in hits), F.lit(0)))
    best = F.greatest(*scores, F.lit(0))
    return F.when(best > 0, F.coalesce(*[F.when(s == best, F.lit(m)) for m, s in zip(keywords, scores, strict=True)]))


def board_lines(boards: DataFrame, metric: str, condition: str | None, cells: int = 2, rows: int = 6) -> DataFrame:
    """(metric, dataset, condition, line): the first ``rows`` entries of at most ``cells`` boards of a metric, exact conditions first; a top-k report."""
    found = boards.where(F.col("metric") == metric).where(F.col("rank") <= rows)
    exact = F.when(F.col("condition") == condition, 0).otherwise(1) if condition else F.lit(0)
    best = found.groupBy("dataset", "condition").agg(F.count(F.lit(1)).alias("n")).orderBy(exact, F.desc("n"), "condition", "dataset").limit(cells)
    best = F.broadcast(best.select(F.col("dataset").alias("d"), F.col("condition").alias("c")))  # ``cells`` rows
    kept = found.join(best, F.col("dataset").eqNullSafe(F.col("d")) & F.col("condition").eqNullSafe(F.col("c")), "left_semi")
    return kept.select("metric", "dataset", "condition", F.concat_ws(" ", F.concat(F.col("rank").cast("string"), F.lit(".")), "method", F.format_string("%.2f", F.col("value")), "grade").alias("line"))


def manifest(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """(place, paper, digest, source): audit rows in the order of papers, 12 digits of the content's digest, where the record comes from."""
    joined = papers.join(sources, "paper", "left")
    return joined.select("paper", F.substring("sha", 1, 12).alias("digest"), F.coalesce("source", F.lit("unknown")).alias("source"))


def found_facts(chunks: DataFrame, patterns: dict[str, str], reach: int = 40, caps: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, kind, value, context): first matches of each family of patterns in a document, values compared without regard to case.

    ``caps`` says how many values of a kind a document shows; that limit is the feature.
    """
    families = F.array(*[F.struct(F.lit(k).alias("kind"), places(F.col("text"), p).alias("hits")) for k, p in patterns.items()])
    hits = chunks.select("doc_id", "seq", "text", F.explode(families).alias("f")).select("doc_id", "seq", "text", "f.kind", F.posexplode("f.hits").alias("i", "hit"))
    begin = F.greatest(F.lit(0), F.col("hit.at") - reach)
    context = F.substring("text", begin + 1, F.col("hit.at") - begin + F.length("hit.hit") + reach)
    told = hits.select("doc_id", "seq", "kind", "i", F.col("hit.hit").alias("value"), context.alias("context"))
    first = told.groupBy("doc_id", "kind", F.lower(F.trim("value")).alias("key")).agg(F.min(F.struct("seq", "i", "value", "context")).alias("m"))
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in (caps or {}).items()], F.lit(2**31 - 1))
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("m.seq", "m.i", "key"))).where(F.col("place") <= limit)
    return ranked.select("doc_id", "kind", F.trim("m.value").alias("value"), "m.context")


def derived_features(methods: DataFrame, rules: dict[str, tuple[tuple[str, str], ...]], column: str, default: str = "Other") -> DataFrame:
    """``methods`` with a column per rule: the name of the first pattern that a text column matches, without regard to case."""
    return methods.withColumns({name: F.coalesce(*[F.when(F.col(column).rlike(f"(?i){p}"), F.lit(v)) for v, p in patterns], F.lit(default)) for name, patterns in rules.items()})


def highlighted(texts: DataFrame, terms: DataFrame, least_idf: float = 2.0, letters: int = 4) -> DataFrame:
    """(doc_id, term, n): how often informative terms of ``letters`` or more stand as words in a text, met by the words."""
    known = terms.where((F.col("idf") >= least_idf) & (F.length("term") >= letters)).select(F.lower("term").alias("term")).distinct()
    words = texts.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9-]+)"), 1)).alias("term"))
    return words.join(known, "term", "left_semi").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def title_parts(citation: Column) -> tuple[Column, Column]:
    """(title, surname): the quoted span of a citation, and the first author's name without initials."""
    title = F.nullif(F.trim(F.regexp_extract(citation, '["“]([^"”]+)["”]', 1)), F.lit(""))
    lead = F.regexp_replace(F.split(citation, r'["“]')[0], r"\b[A-Z]\.\s*-?", "")
    return F.regexp_replace(title, r"[,.]$", ""), F.nullif(F.regexp_extract(F.trim(lead), r"([A-Z][\p{L}'-]+)", 1), F.lit(""))


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two titles are: the best of the ratios between the sorted common words and these with each side's own ones."""
    def ratio(x: str, y: str) -> float:
        one, two = set((x or "").lower().split()), set((y or "").lower().split())
        if not one or not two:
            return 0.0
        common = " ".join(sorted(one & two))
        left, right = (f"{common} {' '.join(sorted(own))}".strip() for own in (one - two, two - one))
        return max(difflib.SequenceMatcher(None, s, t).ratio() for s, t in ((common, left), (common, right), (left, right)))

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def verified_matches(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of titles that are alike and whose surname, where known, is one of the authors' words."""
    known = F.col("surname").isNull() | F.array_contains(F.regexp_extract_all(F.lower("authors"), F.lit(r"([\p{L}'-]+)"), 1), F.lower("surname"))
    return pairs.withColumn("ratio", token_set_ratio("title", "candidate")).where((F.col("ratio") >= least) & known)


def tail_overlap(chunks: DataFrame, share: float = 0.15, least: int = 10) -> DataFrame:
    """Chunks with the last sentences of the one before them in their section, up to ``share`` of its words where that is ``least`` or more."""
    order = W.partitionBy("doc_id").orderBy("seq")
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    rows = chunks.withColumns({"before": F.lag("text").over(order), "section_before": F.lag("section").over(order)})
    sentences = F.reverse(F.filter(F.transform(F.split("before", r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != ""))
    room = F.floor(count(F.col("before")) * share).cast("int")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(acc: Column, s: Column) -> Column:
        fits = ~acc["full"] & (acc["n"] + count(s) <= F.col("room"))
        return F.struct(F.when(fits, F.concat(F.array(s), acc["kept"])).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["n"] + count(s)).otherwise(acc["n"]).alias("n"), (~fits).alias("full"))

    rows = rows.withColumn("room", room).withColumn("overlap", F.array_join(F.aggregate(sentences, start, add)["kept"], " "))
    some = F.col("section").eqNullSafe(F.col("section_before")) & (F.col("room") >= least) & (F.coalesce("overlap", F.lit("")) != "")
    return rows.select("doc_id", "seq", F.when(some, F.concat_ws(" ", "overlap", "text")).otherwise(F.col("text")).alias("text"), F.coalesce(some, F.lit(False)).alias("has_overlap"))


def clustered(vectors: DataFrame, default: int, seed: int = 42) -> DataFrame:
    """(id, cluster) by k-means with k = max(2, min(default, n / 3)); ``vectors`` has id and an array."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    k = max(2, min(default, n // 3))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster")) if n >= 2 else rows.select("id", F.lit(0).alias("cluster"))
