"""Filters, value statistics, joins, windows and set operations over canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

#: Keys of an item, or items of a key, that one side of a join key holds at most.
BLOCK = 512
NULL_TOKENS = ("nan", "", "-", "n/a", "none")


def split_values(cell: Column) -> Column:
    """Distinct parts of a multi-valued cell: cut at commas, semicolons and 'and'; null tokens and single letters go."""
    parts = F.transform(F.split(cell, r"[,;]|\s+and\s+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: ~F.lower(p).isin(*NULL_TOKENS) & (F.length(p) > 1))


def smart_split(cell: Column) -> Column:
    """Comma split as of a CSV line: quotes protect commas, doubled quotes stand for one, blanks before a quote and text after it are allowed; trimmed, empties dropped."""
    parts = F.regexp_extract_all(cell, F.lit(r'(?:^|,) *("(?:[^"]|"")*"[^,]*|[^,]*)'), 1)
    quoted = r'(?s)^"((?:[^"]|"")*)"(.*)$'
    plain = F.transform(parts, lambda p: F.trim(F.when(p.rlike(quoted), F.concat(F.regexp_replace(F.regexp_extract(p, quoted, 1), '""', '"'), F.regexp_extract(p, quoted, 2))).otherwise(p)))
    return F.filter(plain, lambda p: p != "")


def filter_and_count(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose columns contain every pattern, without regard to case; unknown columns are ignored."""
    tests = [F.col(c).rlike(f"(?i){p}") for c, p in filters.items() if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def attribute_filter(df: DataFrame, query: str, columns: tuple[str, ...], least: int = 2) -> DataFrame:
    """Rows that have a value named in the query: OR in a column, AND across columns that are named at all; none if fewer than ``least``.

    Which columns are named and how many rows match are one row each, joined by a broadcast.
    """
    named = [F.coalesce(F.lit(query.lower()).contains(F.lower(F.col(c))), F.lit(False)) for c in columns]
    seen = df.agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(f"named_{i}") for i, n in enumerate(named)])
    fits = reduce(lambda a, b: a & b, [n | ~F.col(f"named_{i}") for i, n in enumerate(named)])
    some = reduce(lambda a, b: a | b, [F.col(f"named_{i}") for i in range(len(columns))])
    kept = df.crossJoin(F.broadcast(seen)).where(some & fits).select(*df.columns)
    return kept.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("n_matches")))).where(F.col("n_matches") >= least).drop("n_matches")


def structured_matches(df: DataFrame, query: str, columns: tuple[str, ...]) -> DataFrame:
    """One row per (column, value) that the query names, fewest matches first in ``place``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("item")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.facet", "p.item").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.lit(query.lower()).contains(F.lower("item"))).withColumn("place", F.row_number().over(W.orderBy("n", "facet", "item")))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts of exploded values with the total and each one's share."""
    counts = df.select(F.explode(column).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6))


def cross_tabulate(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs that occur in one row."""
    return df.select(F.explode(a).alias("a"), b).select("a", F.explode(b).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def gap_matrix(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every combination of two columns' values with its count, zero where none occurs.

    The combinations come from the distinct values of both columns, not from rows.
    """
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(a).distinct().crossJoin(df.select(b).distinct())
    return grid.join(counts, [a, b], "left").fillna(0, ["n"])


def top_per_group(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k most frequent items of each group."""
    counts = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), item))).where(F.col("place") <= k)


def met(rows: DataFrame, item: str, key: str, block: int = BLOCK) -> DataFrame:
    """(item, a, b): all pairs a < b of keys that share an item.

    An item with over ``block`` keys is met block against block, so no join key ever has more than that many rows on a side.
    """
    one = rows.select(item, key).distinct()
    sizes = one.groupBy(item).agg(F.expr(f"(count(1) + {block - 1}) div {block}").cast("int").alias("blocks"))
    dealt = one.join(sizes, item).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    left = dealt.select(item, F.col(key).alias("u"), F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    right = dealt.select(item, F.col(key).alias("v"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("x"), F.col("block").alias("y"))
    pairs = left.join(right, [item, "x", "y"]).where((F.col("x") < F.col("y")) | (F.col("u") < F.col("v")))
    return pairs.select(item, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def shared_counts(rows: DataFrame, item: str, key: str, name: str, block: int = BLOCK) -> DataFrame:
    """(a, b, name): pairs a < b of keys that share items, with how many.

    What moves is not a row per pair and item: an item's keys are put into sorted lists of about ``block``, each key takes the rest of its
    lists along to where its pairs are counted, and no count moves again. Items with several lists meet list against list.
    """
    one = rows.select(item, key).where(F.col(key).isNotNull()).distinct()
    sizes = one.groupBy(item).agg(F.expr(f"(count(1) + {block - 1}) div {block}").cast("int").alias("blocks"))
    dealt = one.join(sizes, item).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    lists = staged(dealt.groupBy(item, "blocks", "block").agg(F.array_sort(F.collect_list(key)).alias("vs")))
    inside = lists.select("vs", F.posexplode("vs").alias("i", "u")).select("u", F.slice("vs", F.col("i") + 2, F.size("vs")).alias("vs"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    hubs = lists.where("blocks > 1")
    asking = hubs.select(item, F.col("block").alias("x"), F.col("vs").alias("us"), other.alias("y")).where("x <> y")
    across = asking.join(hubs.select(item, other.alias("x"), F.col("block").alias("y"), "vs").where("x <> y"), [item, "x", "y"])
    across = across.select(F.explode("us").alias("u"), "vs").select("u", F.filter("vs", lambda v: v > F.col("u")).alias("vs"))
    met_once = inside.unionByName(across).where(F.size("vs") > 0).repartition("u")
    return met_once.select(F.col("u").alias("a"), F.explode("vs").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))


def cooccurrence(df: DataFrame, key: str, item: str, least: int) -> DataFrame:
    """Unordered pairs of items by how many keys have both."""
    return shared_counts(df, key, item, "weight").where(F.col("weight") >= least)


def dense_timeline(df: DataFrame, year: Column, stance: str) -> DataFrame:
    """Counts per year and stance with zero rows for years and stances between the extremes."""
    counts = df.groupBy(year.alias("year"), stance).agg(F.count(F.lit(1)).alias("n"))
    years = counts.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return years.crossJoin(counts.select(stance).distinct()).join(counts, ["year", stance], "left").fillna(0, ["n"])


def hub_histogram(df: DataFrame, key: str, bins: int = 16, hub: int = 20) -> DataFrame:
    """How many keys have how many rows, in bins of equal step (hubs of at least ``hub`` rows apart)."""
    degree = df.groupBy(key).agg(F.count(F.lit(1)).alias("degree"))
    step = F.ceil(F.col("top") / bins)
    both = degree.crossJoin(F.broadcast(degree.agg(F.max("degree").alias("top"))))
    return both.groupBy((F.floor((F.col("degree") - 1) / step) * step + 1).alias("low"), (F.col("degree") >= hub).alias("is_hub")).agg(F.count(F.lit(1)).alias("n"))


def z_scores(df: DataFrame, group: str, value: str) -> DataFrame:
    """value minus its group's mean, over the population deviation (0 counts as 1)."""
    stats = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    joined = df.join(stats, group)
    return joined.withColumn("z", F.round((F.col(value) - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")), 6)).drop("mean", "sd")


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered table; pages are the feature, so only the rows up to it are ordered."""
    top = df.orderBy(*order).limit(page * size)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).where(F.col("place") > (page - 1) * size)


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and edited keys between two versions of a table."""
    o, n = old.select(F.col(key), F.col(value).alias("was")), new.select(F.col(key), F.col(value).alias("now"))
    joined = o.withColumn("in_old", F.lit(True)).join(n.withColumn("in_new", F.lit(True)), key, "full")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "edited")
    return joined.select(key, kind.alias("kind")).where("kind IS NOT NULL")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, carried: str, width: str = "DAY") -> DataFrame:
    """For each left row the last right row of its key at or before its time.

    Both sides are stacked and the last right value runs along the time order within a key and ``width`` of time; what was
    last before each such stretch comes from one row per key and stretch, so a hot key is spread over its stretches.
    """
    stretch = F.date_trunc(width, F.col(time))
    both = left.select(key, time, "event_id", F.lit(None).cast(dict(right.dtypes)[carried]).alias(carried), F.lit(1).alias("side")).unionByName(
        right.select(key, time, F.lit(None).cast("long").alias("event_id"), carried, F.lit(0).alias("side"))
    ).withColumn("stretch", stretch)
    ends = both.where(F.col(carried).isNotNull()).groupBy(key, "stretch").agg(F.max(F.struct(time, carried))[carried].alias("end_value"))
    starts = both.select(key, "stretch").distinct().join(ends, [key, "stretch"], "left")
    before = starts.withColumn("before", F.last("end_value", ignorenulls=True).over(W.partitionBy(key).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))).drop("end_value")
    run = W.partitionBy(key, "stretch").orderBy(time, "side").rowsBetween(W.unboundedPreceding, 0)
    told = both.withColumn("last", F.last(carried, ignorenulls=True).over(run)).where("side = 1").join(before, [key, "stretch"])
    return told.select("event_id", key, F.coalesce("last", "before").alias(carried))


def band_join(left: DataFrame, right: DataFrame, key: str, low: str, high: str, width: int) -> DataFrame:
    """Rows of both sides where left.key lies between right.low and right.high, met by buckets of ``width``."""
    spread = right.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.withColumn("bucket", F.floor(F.col(key) / width)).join(spread, "bucket").where(F.col(key).between(F.col(low), F.col(high))).drop("bucket")


def shared_values(df: DataFrame, key: str, item: str, keys_a: str, least: float) -> DataFrame:
    """Pairs of keys with the Jaccard similarity of their item sets, where it exceeds ``least``."""
    sets = df.select(key, item).distinct()
    sizes = sets.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    common = shared_counts(sets, item, key, "common").join(sizes.select(F.col(key).alias("a"), F.col("size").alias("sa")), "a")
    within = common.where(F.round(F.col("common") / F.col("sa"), 6) > least)  # no pair is more alike than what it shares of one set
    joined = within.join(sizes.select(F.col(key).alias("b"), F.col("size").alias("sb")), "b")
    scored = joined.select("a", "b", "common", F.round(F.col("common") / (F.col("sa") + F.col("sb") - F.col("common")), 6).alias("jaccard"))
    return scored.where(F.col("jaccard") > least)


def comparability(df: DataFrame, key: str, dimensions: tuple[str, ...]) -> DataFrame:
    """Per key and dimension: gap, shared or differs, by the distinct values without regard to case."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.lower(F.col(c).cast("string")).alias("v")) for c in dimensions])).alias("x"))
    counts = long.groupBy(key, "x.dimension").agg(F.countDistinct("x.v").alias("n"))
    return counts.withColumn("status", F.when(F.col("n") == 0, "gap").when(F.col("n") == 1, "shared").otherwise("differs"))
