"""Places, running sums and quantiles along an order, computed by all tasks.

A window over a key puts all rows of the key into one task. Here rows are range-partitioned by key and order and
written once, so a key with a third of all rows spans as many partitions as its rows need; what precedes a partition is a sum over one row
per key and partition. The order must tell rows apart (end it with an id), or equal rows cannot be spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

_PART, _AT = "part_of_range", "at_in_range"


def ranged(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` in the order of keys and ``order``, written, with the partition and the place that each row has in it."""
    by = [*map(F.col, keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_AT, F.monotonically_increasing_id())
    return staged(rows.withColumn(_PART, F.shiftright(_AT, 33)))


def matched(left: DataFrame, right: DataFrame, keys: tuple[str, ...] | list[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys of which null equals null, ``right``'s keys dropped."""
    other = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"r_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"r_{k}" for k in keys])


def with_before(rows: DataFrame, keys: list[str], name: str, own: Column, along=F.sum) -> DataFrame:
    """``rows`` with name_before (``along`` the key's earlier partitions), name_whole (along all) and the key's first place in the partition.

    The table that is joined has a row for each key and partition that holds it: no more than keys and partitions together.
    """
    held = rows.groupBy(*keys, _PART).agg(F.min(_AT).alias("first"), own.alias("own"))
    key = W.partitionBy(*keys)  # one row per partition that the key spans
    earlier = key.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    told = staged(held.select(*keys, _PART, "first", along("own").over(earlier).alias(f"{name}_before"), along("own").over(key).alias(f"{name}_whole")))
    return matched(rows, told, [*keys, _PART])


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "place", count: str | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) in the order of its key, and the key's number of rows as ``count``."""
    rows = with_before(ranged(df, keys, order), keys, "n", F.count(F.lit(1)))
    extra = [F.col("n_whole").alias(count)] if count else []
    return rows.select(*df.columns, (F.col(_AT) - F.col("first") + F.coalesce("n_before", F.lit(0)) + 1).alias(name), *extra)


def running(df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str, whole: str | None = None, along=F.sum) -> DataFrame:
    """``df`` with ``along`` (a sum, least or greatest) of ``value`` over the rows of the key up to and with each row, and over all of them as ``whole``."""
    rows = with_before(ranged(df, keys, order), keys, "v", along(value), along)
    local = along(value).over(W.partitionBy(_PART, *keys).orderBy(_AT).rowsBetween(W.unboundedPreceding, 0))  # a part of the key's rows
    both = {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.min: F.least, F.max: F.greatest}[along]
    extra = [F.col("v_whole").alias(whole)] if whole else []
    return rows.select(*df.columns, both(local, F.col("v_before")).alias(name), *extra)


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], spread: bool = True) -> DataFrame:
    """(keys, a column for each of ``wanted``): exact quantiles of the values that are not null, between neighbours by their distance.

    Equal values are counted first; of the distinct ones, in order, those at the places wanted are picked by their running counts. Without
    ``spread`` each key's counts run in one task and move once: for keys that are known to have few rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value_of")).agg(F.count(F.lit(1)).alias("n_equal"))
    if spread:
        rows = running(counts, keys, ["value_of"], "n_equal", "upto", "whole")
    else:
        key = W.partitionBy(*keys).orderBy("value_of")
        rows = counts.withColumn("upto", F.sum("n_equal").over(key.rowsBetween(W.unboundedPreceding, 0))).withColumn("whole", F.sum("n_equal").over(key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    begin, end = F.col("upto") - F.col("n_equal"), F.col("upto")
    places = {n: F.lit(float(q)) * (F.col("whole") - 1) for n, q in wanted.items()}
    picked = [F.max(F.when((begin <= f(p)) & (f(p) < end), F.col("value_of"))).alias(f"{n}_{side}") for n, p in places.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    near = reduce(lambda a, b: a | b, [(begin <= f(p)) & (f(p) < end) for p in places.values() for f in (F.floor, F.ceil)])
    ends = rows.where(near).groupBy(*keys).agg(F.max("whole").alias("whole"), *picked)
    return ends.select(*keys, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (p - F.floor(p))).alias(n) for n, p in places.items()])


def medians(df: DataFrame, keys: list[str], value: str, name: str, spread: bool = True) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, spread)


def any_above(rows: DataFrame, keys: list[str], most: int) -> bool:
    """Whether a key holds more than ``most`` rows; counts are partial sums."""
    return not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).isEmpty()
