"""Canonical tables of the engine, as views over the star schema and the corpus.

Each view is a projection that Catalyst prunes: a query reads only the columns it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records: one reported measurement of a method on a metric under a condition in a paper."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("paper"),
        F.col("p_brand").alias("method"),
        F.col("p_type").alias("metric"),
        F.concat_ws(":", F.lower("l_returnflag"), F.lower("l_linestatus")).alias("condition"),
        F.concat(F.lit("d"), (F.col("l_orderkey") % 53).cast("string")).alias("dataset"),
        F.when(F.col("p_type") == "PROMO", "rate").when(F.col("p_type") == "ECONOMY", "time").when(F.col("p_type") == "SMALL", "count").otherwise("default").alias("kind"),
        F.when(F.col("l_orderkey") % 11 == 3, "Baseline results are taken from [4]").otherwise("Results").alias("caption"),
        F.col("l_quantity").alias("value"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("std"),
        (F.col("p_type") != "ECONOMY").alias("higher_is_better"),
        (F.col("l_linenumber") == 1).alias("is_own"),
        (F.col("l_linenumber") <= 5).alias("verified"),
        F.when(F.col("l_linenumber") % 3 == 0, "low").when(F.col("l_linenumber") % 3 == 1, "medium").otherwise("high").alias("confidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
    )


RESULTS = """results AS (
  SELECT 's' || l_suppkey AS paper, p_brand AS method, p_type AS metric, lower(l_returnflag) || ':' || lower(l_linestatus) AS condition,
         'd' || (l_orderkey % 53) AS dataset, CASE p_type WHEN 'PROMO' THEN 'rate' WHEN 'ECONOMY' THEN 'time' WHEN 'SMALL' THEN 'count' ELSE 'default' END AS kind, l_orderkey % 11 = 3 AS copied,
         l_quantity AS value, nullif(l_tax, 0) AS std, p_type <> 'ECONOMY' AS higher_is_better, l_linenumber = 1 AS is_own, l_linenumber <= 5 AS verified,
         CASE l_linenumber % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, l_orderkey * 10 + l_linenumber AS record_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents with their place and whitespace token count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return docs.where("text <> ''").withColumn("tokens", F.size(F.filter(F.split("text", " "), lambda w: w != "")))


CHUNKS = """chunks AS (
  SELECT * FROM (
    SELECT doc_id, lang, source, CAST(i AS INT) AS seq, p[i + 1] AS text, CAST(len(list_filter(string_split(p[i + 1], ' '), lambda w: w <> '')) AS INT) AS tokens
    FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents) d, range(len(p)) r(i)) WHERE text <> '')"""


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods: name with multi-valued words, brand, type and a size bucket."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("method_id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("words"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.floor(F.col("p_size") / 10).cast("int").alias("era"), "p_retailprice",
    )


METHODS = """methods AS (
  SELECT p_partkey AS method_id, p_name AS name, string_split(p_name, ' ') AS words, p_brand AS brand, p_type AS type,
         CAST(floor(p_size / 10.0) AS INT) AS era, p_retailprice FROM part)"""
