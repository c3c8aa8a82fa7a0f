"""What the operators share: columns, folders, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_folder, written  # noqa: F401


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", as_bytes: bool = True) -> DataFrame:
    """Only (doc_id, text): other columns, of whatever name, can't clash with ours."""
    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), (t.cast("binary") if as_bytes else t).alias("text"))


def file_system(uri: str):
    """(file system, path) of a path as Spark writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns by name."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                for out in f(b):
                    yield pa.RecordBatch.from_pydict(out, schema=want)

    want = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def texts(batch: pa.RecordBatch) -> list[bytes]:
    """Texts as bytes; null counts as empty."""
    return [t or b"" for t in batch.column("text").to_pylist()]
