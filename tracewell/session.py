"""Sessions that can run the package's Python functions on their executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """``spark``, with this package added to its executors' Python path (once per application)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tracewell-"), "tracewell.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where that is unset on a local master."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewell-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to as many tasks as a shuffle has, however few bytes it is: for work that is heavy for the size of its input."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again, for what several branches of a plan read."""
    path = f"{shared_dir(df.sparkSession)}/tracewell/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
