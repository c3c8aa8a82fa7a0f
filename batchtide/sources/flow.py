"""Order flow from a generic table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def order_flow(spark: SparkSession, sf_dir: str, coin: str = "EV") -> DataFrame:
    """Order-lifecycle records by a fixed integer rule over ``events``: errors cancel earlier ids, some views are fills, some purchases are market orders."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return e.select(
        F.lit(coin).alias("coin"),
        i.alias("seq"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000).alias("ts"),
        u.cast("string").alias("user_id"),
        F.when(kind == "error", 2).when((kind == "view") & (i % 5 == 0), 5).otherwise(1).alias("status_id"),
        F.lit(False).alias("is_trigger"),
        F.when(kind == "error", i - 1 - i % 7).otherwise(i).alias("oid"),
        ((i + u) % 2 == 1).alias("is_ask"),
        F.when((kind == "purchase") & (i % 4 == 0), 1).otherwise(0).alias("order_type_id"),
        (100_000_000 + ((i * 37 + u * 11) % 41 - 20) * 10_000).alias("limit_px"),
        (1 + F.floor("value") % 20).cast("long").alias("orig_sz"),
    )


#: The same for DuckDB, as the common table expression ``flow``.
FLOW_SQL = """flow AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts, user_id::VARCHAR AS user_id,
         CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'view' AND event_id % 5 = 0 THEN 5 ELSE 1 END AS status_id,
         CASE WHEN event_type = 'error' THEN event_id - 1 - event_id % 7 ELSE event_id END AS oid,
         (event_id + user_id) % 2 = 1 AS is_ask,
         CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 1 ELSE 0 END AS order_type_id,
         100000000 + ((event_id * 37 + user_id * 11) % 41 - 20) * 10000 AS limit_px,
         (1 + CAST(floor(value) AS BIGINT) % 20)::BIGINT AS orig_sz
  FROM events)"""
