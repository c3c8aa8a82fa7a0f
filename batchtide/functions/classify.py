"""Row predicates of order-lifecycle records (columns status_id, is_trigger, order_type_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
CANCEL_STATUSES = (2, 7, 10, 11, 12, 13, 14, 16)
MARKET_TYPES = (1, 2, 3, 6)
FILLED, OPEN, TRIGGERED = 5, 1, 9


def side(is_ask: Column | str = "is_ask") -> Column:
    return F.when(F.col(is_ask) if isinstance(is_ask, str) else is_ask, "sell").otherwise("buy")


def is_market() -> Column:
    return F.coalesce(F.col("order_type_id").isin(*MARKET_TYPES), F.lit(False))


def limit_price() -> Column:
    """Null for a market order."""
    return F.when(~is_market(), F.col("limit_px"))


def is_new_live() -> Column:
    return F.coalesce(((F.col("status_id") == OPEN) & ~F.coalesce(F.col("is_trigger"), F.lit(False))) | (F.col("status_id") == TRIGGERED), F.lit(False))


def is_cancellation() -> Column:
    return F.coalesce(F.col("status_id").isin(*CANCEL_STATUSES), F.lit(False))


def record_class() -> Column:
    return F.when(is_new_live(), "new_live").when(is_cancellation(), "cancel").otherwise("other")


def is_actionable() -> Column:
    return is_new_live() | is_cancellation()


def has_size() -> Column:
    """Records whose rounded size is nothing are never seen by the engines."""
    return F.col("orig_sz") > 0


def eligible_at(price: Column) -> Column:
    """Whether an order can trade in an auction at a price."""
    return is_market() | F.when(F.col("is_ask"), F.col("limit_px") <= price).otherwise(F.col("limit_px") >= price)


def crosses(is_ask: Column, limit: Column, resting: Column) -> Column:
    """Whether an incoming order (null limit: market) meets a resting price on the other side."""
    return limit.isNull() | F.when(is_ask, resting >= limit).otherwise(resting <= limit)


def messages(events: DataFrame) -> DataFrame:
    """The message log: every sized record, whether it is accepted, and its quantity."""
    return events.where(has_size()).select("coin", "seq", "ts", "oid", "user_id", "is_ask", limit_price().alias("limit_price"), F.col("orig_sz").alias("quantity"), is_new_live().alias("accepted"))
