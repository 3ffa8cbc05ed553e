"""Token counts through a digest cache.

Each text's digest, with the digest of the tokenizer file, is joined to the stored counts; only
distinct texts that miss are encoded, and their counts are appended to the cache. Counts depend on
every byte of a text, so its normal form is the text itself with null as empty.

Texts move once, folded by digest before the shuffle; what is joined back to the documents is digests
and numbers. The counts of digests that over a thousandth of the documents share are broadcast (fewer
than a thousand), so no task gets all rows of a hot one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, pick, read, scratch_dir, staged
from .tokens import default_path, encoder, version

CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


def stored(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache table; empty if nothing was written to it so far."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache_path)


def token_counts(docs: DataFrame, cache_path: str, *, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty (0 tokens). Rows may repeat and ids may be null: counts follow the
    text alone. An empty table gives no rows and leaves the cache as it was. Two runs that append
    the same digest agree on its count, and readers take it once. Extra columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()
    name = version(tokenizer)
    texts = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def encode(batches):
        counts = encoder(tokenizer)
        for batch in batches:
            n = [len(counts.ids(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    known = stored(spark, cache_path).where(F.col("tokenizer") == name)
    distinct = keyed.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(known.select("content"), "content", "left_anti")
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)

    counts = stored(spark, cache_path).where(F.col("tokenizer") == name).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    narrow = staged(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "token-documents")
    held = narrow.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    return lookup(narrow, held.join(counts, "content"), ["content"], "n", narrow.count()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{scratch_dir(spark)}/tracewell-token-counts/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return token_counts(read(spark, sf_dir, "documents"), cache)
