"""Tables between the steps of an operator, in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none (single machine, tests) one is set below
    the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/batchtide-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, file_rows: int = 0) -> DataFrame:
    """df as a table in the shared folder: it is computed once and lost executors don't lose it.

    What is read from it has a plan of its own, without df's.  With file_rows a
    task's files hold so many rows each, so that more tasks than wrote them can read them.
    """
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
