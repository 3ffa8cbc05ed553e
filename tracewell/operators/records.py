"""Result records from table cells: name resolution, records, normalisation, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import staged
from .ranks import matched

#: Characters that both sides of a containment are met by.
SEED = 5
#: Rows of tables that a task gets: with their records they are sorted in its memory, as they are many times the size of what is moved.
ROWS = 50_000
#: Different header rows, captions or labels that go to all tasks, settled once each; beyond, each is settled where it lies.
FEW = 20_000


def first_of(df: DataFrame, key: str, order: str, *kept: str) -> DataFrame:
    """For each key the columns ``kept`` of its row that comes first."""
    return df.groupBy(key).agg(F.min_by(F.struct(*kept), F.col(order)).alias("row")).select(key, "row.*")


def contained(texts: DataFrame, text: str, names: DataFrame, name: str, seed: int = SEED) -> DataFrame:
    """Rows of ``texts`` with the rows of ``names`` whose name, of ``seed`` characters or more, stands in the text.

    Both sides are met by the first characters of the name, which a text offers at each of its places.
    """
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - seed + 1)), lambda i: F.substring(F.col(text), i, F.lit(seed)))
    offered = texts.withColumn("seed", F.explode(F.array_distinct(places)))
    return offered.join(names.where(F.length(name) >= seed).withColumn("seed", F.substring(name, 1, seed)), "seed").where(F.col(text).contains(F.col(name))).drop("seed")


def method_cascade(mentions: DataFrame, methods: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention, method, confidence, how) of each distinct mention, null, low and none where nothing names a method.

    Steps: the whole key of a name or alias, the same without blanks (five characters or more), a name inside the
    mention (five or more, the first in the order of methods), the mention as a whole token of one method's name
    only. Only mentions with letters go on to the last two. ``methods`` has method and place, ``aliases`` alias and method.
    """
    known = methods.select("method", "place", L.registry_key(F.col("method")).alias("key"))
    exact = first_of(known, "key", "place", "method")
    other = aliases.select("method", L.registry_key(F.col("alias")).alias("key")).groupBy("key").agg(F.min("method").alias("method"))
    asked = mentions.select("mention").distinct().withColumn("key", L.registry_key(F.col("mention")))

    def tight(df: DataFrame) -> DataFrame:
        narrow = df.withColumn("key", F.regexp_replace("key", " ", "")).where(F.length("key") >= SEED)
        return narrow.groupBy("key").agg(F.min("method").alias("method"))

    def step(found: DataFrame, confidence: str, how: str, rank: int) -> DataFrame:
        return found.select("mention", "method", F.lit(confidence).alias("confidence"), F.lit(how).alias("how"), F.lit(rank).alias("rank"))

    close = asked.withColumn("key", F.regexp_replace("key", " ", ""))
    lettered = asked.where(F.col("key").rlike("[a-z]"))
    inside = contained(lettered.withColumnRenamed("key", "said"), "said", known, "key").groupBy("mention").agg(F.min_by("method", "place").alias("method"))
    tokens = known.select("method", F.explode(F.array_distinct(F.split("key", " "))).alias("key")).groupBy("key").agg(F.countDistinct("method").alias("n"), F.min("method").alias("method")).where("n = 1")
    found = [
        step(asked.join(exact, "key"), "high", "exact", 1), step(asked.join(other, "key"), "high", "alias", 2), step(close.join(tight(exact), "key"), "high", "compact", 3),
        step(close.join(tight(other), "key"), "high", "compact alias", 4), step(inside, "medium", "contained", 5), step(lettered.join(tokens, "key"), "medium", "token", 6),
    ]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    best = every.groupBy("mention").agg(F.min(F.struct("rank", "method", "confidence", "how")).alias("b")).select("mention", "b.method", "b.confidence", "b.how")
    return asked.select("mention").join(best, "mention", "left").fillna({"confidence": "low", "how": "none"})


def aliases_of(methods: DataFrame) -> DataFrame:
    """(method, alias): the lower-case name, its bracketed parts of 2 to 20 characters, and the name without brackets."""
    name = F.lower(F.trim("method"))
    short = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), 1), lambda a: F.trim(a)), lambda a: F.length(a).between(2, 20))
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "))
    return methods.where(name != "").select("method", F.explode(F.filter(F.array_distinct(F.concat(F.array(name), short, F.array(bare))), lambda a: a != "")).alias("alias"))


def methods_mentioned(mentions: DataFrame, methods: DataFrame) -> DataFrame:
    """(mention, method): every method that a mention names by an alias, letters and digits compared.

    An alias of three characters or more stands in the mention; one of six or fewer as a word. A method whose longest
    such alias is part of another one's is dropped.
    """
    named = aliases_of(methods).withColumn("tight", F.regexp_replace("alias", "[^a-z0-9]+", ""))
    said = mentions.select("mention").distinct().withColumn("said", F.regexp_replace(F.lower("mention"), "[^a-z0-9]+", ""))
    met = contained(said, "said", named, "tight", 3)
    word = F.regexp_like(F.lower("mention"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("alias"), F.lit(r"\E(?![a-z0-9])")))
    hits = met.where((F.length("tight") > 6) | word).groupBy("mention", "method").agg(F.max_by("tight", F.struct(F.length("tight"), F.col("tight"))).alias("tight"))
    rivals = hits.groupBy("mention").agg(F.collect_set("tight").alias("others"))  # the aliases that one mention names
    inside = F.exists("others", lambda o: (o != F.col("tight")) & o.contains(F.col("tight")))
    return hits.join(rivals, "mention").where(~inside).select("mention", "method")


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, id): the first node, by place, of each name, bracketed short form or slug of a label."""
    label = F.lower(F.trim("label"))
    keys = F.array(label, F.regexp_extract(label, r"\(([^)]+)\)", 1), F.trim(F.regexp_replace(label, r"\s*\([^)]*\)", "")), L.slug(label))
    rows = nodes.select("id", "place", F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("id", "place").alias("id"))


def closest_by_tokens(names: DataFrame, methods: DataFrame) -> DataFrame:
    """(name, method, score): equal keys score 1, else common words over the larger number of words, half at least; the best one."""
    asked = names.select("name").distinct().withColumn("words", F.array_distinct(F.split(L.registry_key(F.col("name")), " ")))
    known = methods.select("method", "place", F.array_distinct(F.split(L.registry_key(F.col("method")), " ")).alias("own"))
    met = asked.withColumn("word", F.explode("words")).join(known.withColumn("word", F.explode("own")), "word")
    common = met.groupBy("name", "method", "place", F.size("words").alias("a"), F.size("own").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    scored = common.withColumn("score", F.col("n") / F.greatest("a", "b")).where("score >= 0.5")
    return scored.groupBy("name").agg(F.max_by(F.struct("method", "score"), F.struct("score", -F.col("place"))).alias("m")).select("name", "m.method", F.round("m.score", 6).alias("score"))


def linked_names(mentions: DataFrame, methods: DataFrame) -> DataFrame:
    """(mention, method): the equal name, else one that starts the mention or is started by it, the closest in length.

    Prefixes of five characters or more are met by their first five.
    """
    asked = mentions.select("mention").distinct().withColumn("key", L.registry_key(F.col("mention"))).where(F.length("key") >= SEED)
    known = methods.select("method", "place", L.registry_key(F.col("method")).alias("own")).where(F.length("own") >= SEED)
    met = asked.withColumn("seed", F.substring("key", 1, SEED)).join(known.withColumn("seed", F.substring("own", 1, SEED)), "seed")
    near = met.where(F.col("key").startswith(F.col("own")) | F.col("own").startswith(F.col("key")))
    return near.groupBy("mention").agg(F.min_by("method", F.struct(F.abs(F.length("key") - F.length("own")), F.col("place"))).alias("method"))


def cells_of(tables: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, col, text) of tables whose ``rows`` are arrays of cells."""
    by_row = tables.select(*keys, F.posexplode("rows").alias("row", "cells"))
    return by_row.select(*keys, "row", F.posexplode("cells").alias("col", "text"))


def records_from_cells(cells: DataFrame, tables: DataFrame, metrics: list[dict], conditions: list[dict]) -> DataFrame:
    """One row per number of a table: its method cell, metric, condition, value, deviation and unit.

    ``cells`` has table_id, row, col, text; ``tables`` table_id, paper, caption. Leading header rows collapse into one
    label per column; the method column is the first that is no row number; columns of one metric and condition are
    kept apart by their last label; rows of totals are left out; what a column does not say the caption may. Cells move once, to their table.
    """
    moved = _moved(cells.where("table_id IS NOT NULL"), 6 * ROWS)  # rows are then put together where they lie
    return _records(moved.groupBy("table_id", "row").agg(F.collect_list(F.struct("col", "text")).alias("cells")), tables, metrics, conditions)


def records_from_rows(rows: DataFrame, tables: DataFrame, metrics: list[dict], conditions: list[dict], protocol: bool = False) -> DataFrame:
    """:func:`records_from_cells` of ``rows`` with table_id, row and the texts of the row's columns as an array ``cells``; rows of one number are one row.

    What header rows, their sequences and captions say is settled once for each different one, if these are few. With ``protocol`` records have
    ``scope`` and ``tokens``, as :func:`normalised` would find them, too.
    """
    rows = rows.where("table_id IS NOT NULL").select("table_id", "row", "cells")
    known = _headings(rows, metrics, conditions, protocol)
    moved = _moved(rows, ROWS).withColumn("cells", F.transform("cells", lambda text, col: F.struct(col.alias("col"), text.alias("text"))))
    alike = W.partitionBy("table_id", "row").orderBy("row")  # in the order that tables are read in: sorted once, which groups would not be
    merged = moved.withColumns({"cells": F.flatten(F.collect_list("cells").over(alike)), "nth": F.row_number().over(alike)}).where("nth = 1").drop("nth")
    return _records(merged, tables, metrics, conditions, known, protocol)


def _headings(rows: DataFrame, metrics: list[dict], conditions: list[dict], protocol: bool) -> tuple[DataFrame, DataFrame] | None:
    """The different header rows (heading, id, what their cells say) and sequences of them at the head of a table (shape, columns, method_col); None if these are not few."""
    heads = staged(rows.where(L.header_first(F.get("cells", F.lit(0))) | (F.col("row") < 1)))
    different = staged(heads.select("cells").distinct().withColumn("id", F.monotonically_increasing_id()))
    if different.count() > FEW:
        return None
    placed = heads.join(F.broadcast(different.withColumnRenamed("cells", "other")), F.col("cells") == F.col("other"))
    shapes = staged(placed.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "id"))).alias("shape")).select("shape").distinct())
    if shapes.count() > FEW:
        return None
    cells = F.transform("cells", lambda text, col: F.struct(col.alias("col"), text.alias("text")))
    headings = staged(different.select(cells.alias("heading"), "id", _said(cells, metrics, conditions, protocol).alias("labels")))
    parts = shapes.select("shape", F.posexplode("shape").alias("nth", "part")).join(F.broadcast(headings), F.col("part.id") == F.col("id"))
    said = parts.groupBy("shape").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "labels"))), lambda x: x["labels"])).alias("said"))
    return headings, staged(_columns(said, protocol))


def _moved(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` dealt by table to as many tasks as give each about ``most`` of them: the default number would let tasks grow with the input until their sorts go to disk."""
    return rows.repartition(max(1, -(-rows.count() // most)), "table_id")


def _said(cells: Column, metrics: list[dict], conditions: list[dict], protocol: bool) -> Column:
    """The labels of a header row's cells that are not blank, by column, with what they name."""
    def told(c: Column) -> Column:
        label = F.trim(c["text"])

        def of(metric: Column) -> Column:
            unit = F.coalesce(*[F.when(metric == m["id"], F.lit(m.get("unit"))) for m in metrics], F.lit(None).cast("string"))
            higher = F.coalesce(*[F.when(metric == m["id"], F.lit(m.get("higher_is_better"))) for m in metrics], F.lit(None).cast("boolean"))
            return F.struct(metric.alias("metric"), F.when(metric.isNotNull(), L.unit_of(label, unit)).alias("unit"), higher.alias("higher"))

        extra = [L.protocol_places(label).alias("places")] if protocol else []
        return F.struct(c["col"].alias("col"), label.alias("label"), L.bound(L.metric_of(label, metrics), of).alias("named"), L.condition_of(label, conditions).alias("condition"), F.nullif(L.slug(label), F.lit("")).alias("last"), *extra)

    return F.array_sort(F.transform(F.filter(cells, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != ""), told))


def _columns(rows: DataFrame, protocol: bool) -> DataFrame:
    """Rows with ``columns``, a map of what the labels ``said`` (in the order of their rows) make of each column but that of methods, and ``method_col``, instead; null where these are null.

    A column without a label is no measure and no method.
    """
    told = rows.withColumn("columns", F.transform(F.array_distinct("said.col"), lambda at: F.struct(at.alias("col"), F.array_distinct(F.filter("said", lambda x: x["col"] == at)).alias("said"))))  # a label per header row
    told = told.withColumn("columns", F.filter("columns", lambda c: ~F.regexp_replace(F.lower(F.trim(F.array_join(c["said"]["label"], " | "))), r"\.+$", "").isin(*L.INDEX_TOKENS)))
    told = told.withColumn("method_col", F.when(F.col("said").isNotNull(), F.coalesce(F.array_min("columns.col"), F.lit(0)))).drop("said")

    def measure(c: Column) -> Column:
        naming, under = F.get(F.filter(c["said"]["named"], lambda x: x["metric"].isNotNull()), F.lit(0)), F.get(F.filter(c["said"]["condition"], lambda x: x.isNotNull()), F.lit(0))
        told = F.struct(naming.alias("named"), F.array_join(c["said"]["label"], " | ").alias("raw"), under.alias("own_condition"), F.element_at(c["said"], -1)["last"].alias("last"))

        def kept(x: Column) -> Column:
            extra = [L.least_places(c["said"]["places"]).alias("places"), F.when(x["named"]["metric"] == "latency", L.time_scope(x["raw"])).alias("scope")] if protocol else []
            return F.struct(x["named"]["metric"].alias("metric"), x["raw"].alias("metric_raw"), x["named"]["unit"].alias("unit"), x["own_condition"].alias("own_condition"), x["last"].alias("last"), x["named"]["higher"].alias("higher"), *extra)

        return F.struct(c["col"].alias("col"), L.bound(told, kept).alias("said"))

    def kept_apart(c: Column) -> Column:  # columns of one metric and condition
        own = c["said"]["own_condition"]
        alike = F.size(F.filter("columns", lambda x: x["said"]["metric"].eqNullSafe(c["said"]["metric"]) & x["said"]["own_condition"].eqNullSafe(own)))
        apart = c["said"]["metric"].isNotNull() & (alike > 1)
        return F.struct(c["col"].alias("col"), c["said"].withField("own_condition", F.when(apart, F.concat_ws(":", own, F.coalesce(c["said"]["last"], F.lit("col")))).otherwise(own)).dropFields("last").alias("said"))

    told = told.withColumn("columns", F.transform(F.filter("columns", lambda c: c["col"] != F.col("method_col")), measure))
    return told.withColumn("columns", F.map_from_entries(F.transform("columns", kept_apart)))


def _about(tables: DataFrame, conditions: list[dict], protocol: bool) -> DataFrame:
    """``tables`` with the condition (and protocol places) of their captions, each different caption settled once if these are few."""
    caption = F.col("caption")
    told = {"about": L.condition_of(caption, conditions)} | ({"caption_places": L.protocol_places(F.coalesce(caption, F.lit("")))} if protocol else {})
    tables = tables.select("table_id", "paper", "caption")
    different = staged(tables.select("caption").distinct())
    return matched(tables, F.broadcast(different.withColumns(told)), ["caption"]) if different.count() <= FEW else tables.withColumns(told)


def _records(rows: DataFrame, tables: DataFrame, metrics: list[dict], conditions: list[dict], known: tuple[DataFrame, DataFrame] | None = None, protocol: bool = False) -> DataFrame:
    """Records of ``rows`` (table_id, row, cells of col and text) that lie with their table's others already: sorted once, and moved no more."""
    table = W.partitionBy("table_id")
    # cells are read after the sort, which moves their texts only
    first = F.array_max(F.transform(F.filter("cells", lambda c: c["col"] == 0), lambda c: c["text"]))
    numbers = F.size(F.filter("cells", lambda c: (c["col"] > 0) & c["text"].rlike("[0-9]") & L.parsed_cell(c["text"])["value"].isNotNull()))
    told = rows.withColumn("nth", F.row_number().over(table.orderBy("row"))).withColumn("first", first).withColumn("heads", L.header_row(F.col("first"), numbers))
    told = told.withColumns({"n": F.count(F.lit(1)).over(table), "lead": F.min(F.when(~F.col("heads"), F.col("row"))).over(table)}).where("n >= 2")
    told = told.withColumn("headers", F.least(F.col("n") - 1, F.greatest(F.lit(1), F.coalesce("lead", "n")))).drop("heads", "n", "lead", "first")
    heads, labels = F.col("row") < F.col("headers"), _said(F.col("cells"), metrics, conditions, protocol)
    settled = []
    if known:  # what is said by header rows that are not among those known, as several of one number make one, is worked out below
        headings, shapes = known
        told = told.withColumn("asked", F.when(heads, F.col("cells"))).join(F.broadcast(headings.select("heading", "id")), F.col("asked") == F.col("heading"), "left").drop("asked", "heading")
        told = told.withColumn("own", F.collect_list(F.when(heads, F.struct("row", "id"))).over(table)).drop("id").withColumn("own", F.array_sort("own"))
        told = told.join(F.broadcast(shapes.withColumnsRenamed({"columns": "known_columns", "method_col": "known_col"})), F.col("own") == F.col("shape"), "left").drop("own", "shape")
        heads, settled = heads & F.col("known_col").isNull(), ["known_columns", "known_col"]
    told = told.withColumn("said", F.collect_list(F.when(heads, F.struct("row", labels.alias("labels")))).over(table))
    # what columns say is worked out at a table's first row and then told to all
    asked = (F.col("nth") == 1) & (F.col("known_col").isNull() if known else F.lit(True))
    told = _columns(told.withColumn("said", F.when(asked, F.flatten(F.transform(F.array_sort("said"), lambda x: x["labels"])))), protocol)
    told = told.withColumns({"columns": F.first("columns", True).over(table), "method_col": F.first("method_col", True).over(table)}).where(F.col("row") >= F.col("headers"))
    if known:
        told = told.withColumns({"columns": F.coalesce("known_columns", "columns"), "method_col": F.coalesce("known_col", "method_col")}).drop(*settled)
    told = told.drop("headers", "nth").join(_about(tables, conditions, protocol), "table_id")  # while rows are still in the order of their tables

    def named(c: Column) -> Column:
        def own(mention: Column) -> Column:
            low = F.lower(mention)
            return F.struct(c["text"].alias("method_raw"), mention.alias("mention"), low.isin(*L.SUMMARY_ROWS).alias("sums"), (low.contains("our") & low.rlike(r"\bours?\b")).alias("is_own"), low.rlike(r"^(no |w/o |without |w/ |with |\+ |- )").alias("is_ablation"))

        uncited = F.when(c["text"].contains("["), F.regexp_replace(c["text"], r"\s*\[[\d,\s\-]+\]", "")).otherwise(c["text"])
        return L.bound(F.trim(F.regexp_replace(uncited, r"[*†‡✓✗]+$", "")), own)

    names = F.transform(F.filter("cells", lambda c: (c["col"] == F.col("method_col")) & (F.trim(c["text"]) != "")), named)
    told = told.withColumn("who", F.explode_outer(names)).where("who IS NOT NULL AND NOT who.sums")  # a plain explode would name all rows a second time, to see whether any is left
    told = told.withColumn("c", F.explode("cells")).drop("cells").withColumn("at", F.col("columns")[F.col("c.col")]).drop("columns").where("at IS NOT NULL")
    told = L.with_parsed(told.withColumn("text", F.col("c.text")), "text")
    extra = [F.col("at.scope").alias("scope"), L.tokens_at(F.col("at.places"), F.col("caption_places")).alias("tokens")] if protocol else []
    return told.select(
        "paper", "table_id", "row", F.col("c.col").alias("col"), "who.method_raw", "who.mention", "at.metric_raw", "at.metric", F.coalesce("at.own_condition", "about").alias("condition"),
        "cell.value", F.trim("text").alias("value_str"), "cell.deviation", F.coalesce("at.unit", "cell.unit").alias("unit"), F.col("at.higher").alias("higher_is_better"), "who.is_own", "who.is_ablation", "caption", *extra,
    )


def normalised(records: DataFrame, metrics: list[dict], condition_aliases: dict[str, str]) -> DataFrame:
    """Condition aliases, then rates below 1 as percent (not average precision), then the scope of a bare latency, then protocol tokens; these two as records have them, if they do."""
    settled = "tokens" in records.columns
    scope, tokens = (F.col("scope"), F.col("tokens")) if settled else (L.time_scope(F.col("metric_raw")), L.protocol_tokens(F.col("metric_raw"), F.col("caption")))
    renamed = F.coalesce(*[F.when(F.col("condition") == k, F.lit(v)) for k, v in condition_aliases.items()], F.col("condition"))
    rates = [m["id"] for m in metrics if m.get("type") == "rate" and m["id"] != "ap"]
    scoped = F.when(F.col("condition").isNull() & (F.col("metric") == "latency"), scope).otherwise(F.col("condition"))
    return (
        records.withColumn("condition", renamed)
        .withColumn("value", F.when(F.col("metric").isin(*rates) & (F.col("value") > 0) & (F.col("value") < 1), F.col("value") * 100).otherwise(F.col("value")))
        .withColumn("condition", scoped)
        .withColumn("condition", L.with_tokens(F.col("condition"), tokens))
        .drop("scope", "tokens")
    )


def published(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records with a valid method and label: method (resolved, or found by its compact form among resolved ones), label, whether comparable.

    ``resolved`` has mention, method and confidence.
    """
    def compact(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z0-9+]+", "")

    # a name is settled once, however many records have it, and records move once, without what nobody asks for
    own_name = L.method_name(F.col("method_raw"))
    names = records.select("mention", "method_raw").distinct().join(resolved.select("mention", F.col("method").alias("resolved"), F.col("confidence").alias("match")), "mention", "left")
    known = resolved.where("method IS NOT NULL").groupBy(compact(F.col("method")).alias("form")).agg(F.min("method").alias("salvaged"))
    names = names.withColumn("clean", own_name).withColumn("form", compact(F.col("clean"))).join(known, "form", "left").withColumn("found", F.coalesce("resolved", "salvaged"))
    names = names.withColumn("method", F.coalesce("found", "clean")).where(L.valid_method_name(F.col("method")) & L.valid_method_name(F.col("clean")))
    names = names.select("mention", "method_raw", "method", F.col("found").isNotNull().alias("known"), F.coalesce("match", F.lit("low")).alias("confidence"))
    rows = _labelled(records)
    rows = rows.select("mention", "method_raw", "paper", "table_id", "row", "col", "metric", "label", "condition", F.round("value", 4).alias("value"), "deviation", "unit", "higher_is_better", "is_own")
    return matched(rows, staged(names), ["mention", "method_raw"]).select(
        "paper", "table_id", "row", "col", "method", "metric", "label", "condition", "value", "deviation", "unit", "higher_is_better", "is_own",
        (F.col("metric").isNotNull() & F.col("known")).alias("comparable"), "confidence",
    )


def _labelled(records: DataFrame) -> DataFrame:
    """``records`` with a valid label, each different metric and label settled once if these are few."""
    label = L.metric_label(F.coalesce("metric", "metric_raw"))
    different = staged(records.select("metric", "metric_raw").distinct())
    few = different.count() <= FEW
    told = (different if few else records).withColumn("label", label).where(L.valid_metric_label(F.col("label"), F.col("metric")))
    return matched(records, F.broadcast(told), ["metric", "metric_raw"]) if few else told
