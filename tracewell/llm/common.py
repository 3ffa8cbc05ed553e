"""What the training-data operators share: column picking, scratch tables, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and text contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


#: A key is hot from this part of all rows on.
HOT_SHARE = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only the named columns, found by exact name first and then without regard to case.

    Columns are taken by position, so extra columns of any name (even ``TEXT`` beside ``text``, or
    a name that an operator uses itself) can neither clash nor make a reference ambiguous.
    """
    wanted = {n: n for n in names} | renamed
    return by_place(df).select(*[F.col(place_of(df, name)).alias(alias) for alias, name in wanted.items()])


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., so that columns added beside them clash with none."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> str:
    """The name that :func:`by_place` gives a column, found by exact name first and then without regard to case."""
    lower = [c.lower() for c in df.columns]
    if name in df.columns:
        return f"c{df.columns.index(name)}"
    if lower.count(name.lower()) == 1:
        return f"c{lower.index(name.lower())}"
    raise ValueError(f"no column {name!r} among {df.columns}")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only if that is unset on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage: what is computed once is not computed again by later jobs, and a lost
    executor costs only the tasks it was running. Tables stay until :func:`clear_scratch`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with the row of ``table`` that has their ``keys`` (rows without one go).

    ``weight`` of ``table`` says how many of ``rows`` have its keys, about ``total`` in all. Keys with over a
    thousandth of these, fewer than a thousand, are broadcast, so no task gets all rows of a hot key.
    """
    if total is None:
        total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > total
    added = [c for c in table.columns if c not in (*keys, weight)]
    hot = F.broadcast(table.where(is_hot).select(*keys, F.struct(F.lit(True).alias("is_hot"), *added).alias("hot_row")))
    marked = rows.join(hot, keys, "left")
    warm = marked.where("hot_row IS NOT NULL").select(*rows.columns, *[F.col(f"hot_row.{c}").alias(c) for c in added])
    cold = marked.where("hot_row IS NULL").drop("hot_row").join(table.where(~is_hot).drop(weight), keys)
    return warm.unionByName(cold.select(*rows.columns, *added))


def clear_scratch(spark: SparkSession) -> None:
    """Remove all staged tables of the shared folder; call it once their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/tracewell")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, mod 4, is 2. A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
