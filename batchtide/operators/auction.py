"""One batch's uniform-price clearing as DataFrame operations, for many batches at once.

orders: batch, oid, ts, is_ask, limit (null: market), quantity, and optionally a
user.  Everything is keyed by batch; prices are levels before they are joined to
anything, so work grows with orders and levels, not with their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "batch"


def schedule(orders: DataFrame) -> DataFrame:
    """(batch, price, demand, supply) at every distinct limit price of a batch."""
    level = orders.where(F.col("limit").isNotNull()).groupBy(KEY, F.col("limit").alias("price")).agg(
        F.sum(F.when(~F.col("is_ask"), F.col("quantity")).otherwise(0)).alias("_b"), F.sum(F.when(F.col("is_ask"), F.col("quantity")).otherwise(0)).alias("_s")
    )
    market = orders.where(F.col("limit").isNull()).groupBy(KEY).agg(
        F.sum(F.when(~F.col("is_ask"), F.col("quantity")).otherwise(0)).alias("_mb"), F.sum(F.when(F.col("is_ask"), F.col("quantity")).otherwise(0)).alias("_ms")
    )
    up = Window.partitionBy(KEY).orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(KEY).orderBy(F.desc("price")).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    return (
        level.withColumn("_d", F.sum("_b").over(down))
        .withColumn("_u", F.sum("_s").over(up))
        .join(market, KEY, "left")
        .select(KEY, "price", (F.col("_d") + F.coalesce("_mb", zero)).alias("demand"), (F.col("_u") + F.coalesce("_ms", zero)).alias("supply"))
    )


def clearing(levels: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(batch, price, demand, supply, volume, imbalance): most volume, least imbalance, nearest to the last price (batch, last), lowest."""
    d = levels.join(last, KEY, "left") if last is not None else levels.withColumn("last", F.lit(None).cast("long"))
    volume, imbalance = F.least("demand", "supply"), F.abs(F.col("demand") - F.col("supply"))
    rank = F.struct(-volume, imbalance, F.coalesce(F.abs(F.col("price") - F.col("last")), F.lit(0)), F.col("price"))
    best = d.groupBy(KEY).agg(F.min_by(F.struct("price", "demand", "supply"), rank).alias("b"))
    return best.select(KEY, "b.price", "b.demand", "b.supply", F.least("b.demand", "b.supply").alias("volume"), F.abs(F.col("b.demand") - F.col("b.supply")).alias("imbalance"))


def fills(orders: DataFrame, cleared: DataFrame) -> DataFrame:
    """Eligible orders with hi (cumulated quantity in priority order), lo, and fill: what the volume leaves for each."""
    d = orders.join(cleared.select(KEY, "price", "volume"), KEY)
    able = F.col("limit").isNull() | F.when(F.col("is_ask"), F.col("limit") <= F.col("price")).otherwise(F.col("limit") >= F.col("price"))
    better = F.when(F.col("is_ask"), F.col("limit")).otherwise(-F.col("limit"))
    rank = Window.partitionBy(KEY, "is_ask").orderBy(F.col("limit").isNotNull(), better, "ts", "oid").rowsBetween(Window.unboundedPreceding, 0)
    d = d.where(able).withColumn("hi", F.sum("quantity").over(rank)).withColumn("lo", F.col("hi") - F.col("quantity"))
    return d.withColumn("fill", F.greatest(F.lit(0).cast("long"), F.least("quantity", F.col("volume") - F.col("lo"))))


def trades(filled: DataFrame, width: int = 64) -> DataFrame:
    """(batch, price, quantity, buy_oid, sell_oid, at): overlaps of the two sides' ranges of cumulated quantity.

    Ranges are dealt to cells of ``width`` units of quantity and joined by
    (batch, cell), so a batch costs its volume in cells and not buys times sells.
    """
    f = filled.where("fill > 0").withColumn("hi", F.col("lo") + F.col("fill"))
    cell = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    side = lambda ask, p: f.where(F.col("is_ask") == ask).select(KEY, "price", F.col("oid").alias(f"{p}_oid"), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), cell.alias("cell"))
    both = side(False, "buy").join(side(True, "sell").drop("price"), [KEY, "cell"])
    start = F.greatest("buy_lo", "sell_lo")
    both = both.withColumn("at", start).withColumn("quantity", F.least("buy_hi", "sell_hi") - start)
    return both.where((F.col("quantity") > 0) & (F.floor(F.col("at") / width) == F.col("cell"))).select(KEY, "price", "quantity", "buy_oid", "sell_oid", "at")


def surplus(filled: DataFrame) -> DataFrame:
    """(batch, buyers, sellers): what limit orders gain against their limits."""
    gain = F.coalesce(F.greatest(F.when(F.col("is_ask"), F.col("price") - F.col("limit")).otherwise(F.col("limit") - F.col("price")), F.lit(0)), F.lit(0)) * F.col("fill")
    return filled.groupBy(KEY).agg(F.sum(F.when(~F.col("is_ask"), gain).otherwise(0)).alias("buyers"), F.sum(F.when(F.col("is_ask"), gain).otherwise(0)).alias("sellers"))
