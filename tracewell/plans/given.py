"""Inputs of queries that are said once, in SQL that Spark and DuckDB both read; ``{name}`` stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import table

_table = re.compile(r"\{(\w+)\}")


def given(spark: SparkSession, sf_dir: str, sql: str, **views: DataFrame) -> DataFrame:
    names = set(_table.findall(sql)) - set(views)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names}, **views)


def named(sql: str) -> str:
    """The same input for DuckDB, which knows the tables by their names."""
    return _table.sub(r"\1", sql)
