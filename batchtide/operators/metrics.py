"""The interval table: liquidity, price discovery and execution by interval.

Each family of metrics is an aggregation to (coin, bucket); the families are
joined on the dense grid of a coin's intervals.  Quantities and prices are whole
numbers and sums of them stay whole until the last division.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NS, UNIT, bucket, deviation_bps
from ..schemas import INTERVAL_COLUMNS
from ..tables import written
from .ordered import asof_forward, dense_grid, forward_fill, in_windows

HORIZONS, LAMBDA_HORIZON = (1, 5, 30), 5
BPS = 10_000.0
KEY = ["coin", "bucket"]


def bounds(messages: DataFrame) -> DataFrame:
    """(coin, anchor, last): the first record's time and the latest."""
    return messages.groupBy("coin").agg(F.min_by("ts", "seq").alias("anchor"), F.max("ts").alias("last"))


def _bucketed(df: DataFrame, limits: DataFrame, width: int, ts: str = "ts") -> DataFrame:
    # sent to every task, a row a coin: a shuffle by coin would leave all that follows to one task a coin
    return df.join(F.broadcast(limits.select("coin", "anchor")), "coin").withColumn("bucket", bucket(F.col(ts), F.col("anchor"), width)).drop("anchor")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def order_states(messages: DataFrame, trades: DataFrame) -> DataFrame:
    """First accepted message of each oid, with what was filled and when first."""
    first = messages.where("accepted").groupBy("coin", "oid").agg(F.min_by(F.struct("user_id", "limit_price", "quantity", "ts"), "seq").alias("m"))
    fills = trades.select("coin", "ts", "quantity", F.explode(F.array("buy_order_id", "sell_order_id")).alias("oid")).groupBy("coin", "oid").agg(F.sum("quantity").alias("filled"), F.min("ts").alias("first_fill_ts"))
    return first.select("coin", "oid", "m.user_id", "m.limit_price", F.col("m.quantity").alias("orig"), F.col("m.ts").alias("first_seen_ts")).join(fills, ["coin", "oid"], "left").withColumn("filled", F.coalesce("filled", F.lit(0).cast("long")))


def execution(states: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """fill_rate, avg_time_to_execution_secs and order_size_inflation, by when orders were first seen."""
    s = _bucketed(states, limits, width, "first_seen_ts")
    user = s.groupBy(*KEY, "user_id").agg(F.sum("orig").alias("orig"), F.sum("filled").alias("filled"), F.sum(F.greatest(F.col("first_fill_ts") - F.col("first_seen_ts"), F.lit(0))).alias("wait"), F.count("first_fill_ts").alias("waits"))
    return user.groupBy(*KEY).agg(
        _ratio(F.sum("filled"), F.sum("orig")).alias("fill_rate"),
        (_ratio(F.sum("wait"), F.sum("waits")) / NS).alias("avg_time_to_execution_secs"),
        F.avg(F.when((F.col("orig") > 0) & (F.col("filled") > 0), F.col("orig") / F.col("filled"))).alias("order_size_inflation"),
    )


def price_series(engine: str, books: DataFrame | None, batches: DataFrame | None) -> DataFrame:
    """(coin, ts, ord, p): mids with both sides present, or clearing prices."""
    if engine == "cda":
        return books.where("best_bid is not null and best_ask is not null").select("coin", "ts", F.col("seq").alias("ord"), ((F.col("best_bid") + F.col("best_ask")) / 2.0).alias("p"))
    return batches.where("clearing_price is not null").select("coin", "ts", F.col("batch").alias("ord"), F.col("clearing_price").cast("double").alias("p"))


def traded(trades: DataFrame, states: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """Volume, notional, count, vwap, surplus, dispersion and effective spread."""
    limit = lambda s: states.select("coin", F.col("oid").alias(f"{s}_order_id"), F.col("limit_price").alias(f"{s}_limit"))
    t = _bucketed(trades, limits, width).join(limit("buy"), ["coin", "buy_order_id"], "left").join(limit("sell"), ["coin", "sell_order_id"], "left")
    q, p, m = F.col("quantity"), F.col("price"), F.col("reference_price")
    exact = lambda x: x.cast("decimal(38,0)")
    gain = lambda x: F.coalesce(F.greatest(x, F.lit(0)), F.lit(0))
    weight = F.when(m > 0, q)
    mean = F.avg(p)
    return t.groupBy(*KEY).agg(
        F.sum(q).cast("double").alias("executed_volume"),
        F.sum(exact(q) * p).cast("double").alias("executed_notional"),
        F.count(F.lit(1)).alias("trade_count"),
        (F.sum(exact(q) * p).cast("double") / F.sum(q)).alias("vwap"),
        F.sum(exact(q) * (gain(F.col("buy_limit") - p) + gain(p - F.col("sell_limit")))).cast("double").alias("trader_surplus"),
        F.when(mean > 0, F.stddev_pop(p) / mean * BPS).otherwise(0.0).alias("intra_interval_price_dispersion"),
        _ratio(F.sum(F.when(m > 0, deviation_bps(p, m, F.col("aggressor_is_ask")) * q)), F.sum(weight)).alias("effective_spread_bps"),
    )


def realized(trades: DataFrame, prices: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """Realized spreads at each horizon: twice the distance from the later price, over the price before."""
    probes = trades.where("reference_price > 0").select("coin", "ts", "price", "quantity", "reference_price", "aggressor_is_ask", F.explode(F.array(*map(F.lit, HORIZONS))).alias("h"))
    probes = probes.withColumn("target", F.col("ts") + F.col("h") * F.lit(NS).cast("long"))
    t = _bucketed(asof_forward(probes, prices, "target", "ts", "ord", "p", "later", ["coin"]), limits, width).where("later is not null")
    d = 2.0 * (F.col("price") - F.col("later")) / F.col("reference_price") * BPS
    value = F.when(F.col("aggressor_is_ask").isNull(), F.abs(d)).when(F.col("aggressor_is_ask"), -d).otherwise(d) * F.col("quantity")
    at = lambda h, x: F.sum(F.when(F.col("h") == h, x))
    return t.groupBy(*KEY).agg(*[_ratio(at(h, value), at(h, F.col("quantity"))).alias(f"realized_spread_bps_{h}s") for h in HORIZONS])


def kyle_cda(trades: DataFrame, prices: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """Slope through the origin of the mid's move in five seconds on net signed flow, one observation for each time with trades."""
    sign = F.when(F.col("aggressor_is_ask"), -F.col("quantity")).otherwise(F.col("quantity"))
    sweep = trades.where("reference_price > 0 and aggressor_is_ask is not null").groupBy("coin", "ts").agg(F.sum(sign).alias("x"), F.min_by("reference_price", "trade_id").alias("m"))
    sweep = sweep.withColumn("target", F.col("ts") + LAMBDA_HORIZON * NS)
    s = _bucketed(asof_forward(sweep, prices, "target", "ts", "ord", "p", "later", ["coin"]), limits, width).where("later is not null")
    return _slope(s.withColumn("y", (F.col("later") - F.col("m")) / F.col("m") * BPS))


def kyle_fba(batches: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """The same of the change from one priced batch to the next on the batch's net flow."""
    d = forward_fill(batches.where("clearing_price is not null"), "was", "clearing_price", "batch", ["coin"], inclusive=False).where("was > 0")
    return _slope(_bucketed(d, limits, width).withColumn("x", F.col("net_order_flow")).withColumn("y", (F.col("clearing_price") - F.col("was")) / F.col("was") * BPS))


def _slope(d: DataFrame) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y")
    return d.groupBy(*KEY).agg(_ratio(F.sum(x * y), F.sum(x * x)).alias("kyle_lambda"))


def volatility(prices: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """realized_volatility and the last price (close) of each interval that has prices."""
    d = _bucketed(prices, limits, width)
    was = F.lag("p").over(Window.partitionBy(*KEY).orderBy("ts", "ord"))
    r = F.when(F.col("was") > 0, (F.col("p") - F.col("was")) / F.col("was"))
    return d.withColumn("was", was).withColumn("r", r).groupBy(*KEY).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("realized_volatility"), F.max_by("p", F.struct("ts", "ord")).alias("close"))


def book_liquidity(books: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """Spread, depths and imbalance as means over book snapshots."""
    b, bid, ask, x, y = _bucketed(books, limits, width), F.col("best_bid"), F.col("best_ask"), F.col("best_bid_qty"), F.col("best_ask_qty")
    return b.groupBy(*KEY).agg(
        F.avg(F.when(bid + ask > 0, (ask - bid) / ((bid + ask) / 2.0) * BPS)).alias("quoted_spread_bps"),
        F.avg((x + y) / 2.0).alias("depth_at_best"),
        *[F.avg((F.col(f"b{n}") + F.col(f"a{n}")) / 2.0).alias(f"depth_within_{n}bps") for n in (10, 50, 100)],
        F.avg(F.when(x + y > 0, (x - y) / (x + y))).alias("book_imbalance"),
        F.avg((F.col("bid_depth") + F.col("ask_depth")) / 2.0).alias("total_book_depth"),
        F.sum("compute_ns").alias("_spent"),
        F.count(F.lit(1)).alias("_timed"),
    )


def batch_liquidity(batches: DataFrame, messages: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """Spread, depths, residual share and boundary concentration of cleared batches."""
    opened, late = F.greatest(F.col("ts") - F.col("batch_open_ts"), F.lit(0)), F.struct(F.lit(True).alias("_late"), (F.col("ts") - F.floor(F.col("_window") / 10)).alias("_from"))
    w = batches.select("coin", "ts", "batch_open_ts", opened.alias("_window")).where("_window > 0")
    # a batch's whole window and its last tenth are two rows, so the messages are counted up once
    w = w.select("coin", "ts", F.explode(F.array(F.struct(F.lit(False).alias("_late"), F.col("batch_open_ts").alias("_from")), late)).alias("_w")).select("coin", "ts", "_w.*")
    w = _bucketed(in_windows(w, messages, "_from", "ts", "ts", "_held", ["coin"], width), limits, width)
    near = w.groupBy(*KEY).agg(_ratio(F.sum(F.when(F.col("_late"), F.col("_held"))), F.sum(F.when(~F.col("_late"), F.col("_held")))).alias("boundary_concentration"))
    b, cp = _bucketed(batches, limits, width), F.col("clearing_price")
    return b.groupBy(*KEY).agg(
        F.avg(F.when(cp > 0, (F.col("best_unfilled_sell") - F.col("best_unfilled_buy")) / cp * BPS)).alias("quoted_spread_bps"),
        F.avg((F.col("demand_at_price") + F.col("supply_at_price")) / 2.0).alias("depth_at_best"),
        *[F.avg((F.col(f"b{n}") + F.col(f"a{n}")) / 2.0).alias(f"depth_within_{n}bps") for n in (10, 50, 100)],
        _ratio(F.sum("unexecuted_quantity"), F.sum(F.greatest("demand_at_price", "supply_at_price"))).alias("unexecuted_residual_share"),
        F.sum("compute_ns").alias("_spent"),
        F.count(F.lit(1)).alias("_timed"),
    ).join(near, KEY, "left")


def message_counts(messages: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    return _bucketed(messages, limits, width).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_messages"))


def intervals(engine: str, width: int, messages: DataFrame, trades: DataFrame, books: DataFrame | None = None, batches: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """coin and the interval table's columns, a row for every interval of the grid.

    Both engines of a run share their grid: it comes from the messages.
    Each part is a table before the next one is planned: the driver holds one
    part's plan at a time, and the result's plan reads a table.
    """
    limits = limits if limits is not None else written(bounds(messages), "bounds")
    trades = trades.where(F.col("engine") == engine)
    states, prices = written(order_states(messages, trades), "states"), price_series(engine, books, batches)
    parts = [
        traded(trades, states, limits, width),
        realized(trades, prices, limits, width),
        kyle_cda(trades, prices, limits, width) if engine == "cda" else kyle_fba(batches, limits, width),
        volatility(prices, limits, width),
        execution(states, limits, width),
        message_counts(messages, limits, width),
        book_liquidity(books, limits, width) if engine == "cda" else batch_liquidity(batches, messages, limits, width),
    ]
    parts = [written(p, "interval-part") for p in parts]
    d = written(reduce(lambda x, y: x.join(y, KEY, "left"), parts, dense_grid(limits, width)), "interval-parts")
    d = forward_fill(d.withColumn("_n", F.floor(F.col("bucket") / width)), "was", "close", "_n", ["coin"], inclusive=False)
    dollars = F.col("executed_notional") / UNIT
    out = {
        "engine": F.lit(engine),
        "interval_start_ns": F.col("bucket"),
        "interval_width_ns": F.lit(width).cast("long"),
        "amihud_illiquidity": F.when((F.col("was") > 0) & (dollars > 0), F.abs((F.col("close") - F.col("was")) / F.col("was")) / dollars * 1e6),
        "pricing_error_bps": F.lit(None).cast("double"),
        "order_to_trade_ratio": F.when(F.col("trade_count") > 0, F.col("_messages") / F.col("trade_count")),
        "throughput_orders_per_sec": F.when(F.col("_spent") > 0, F.col("_messages") / (F.col("_spent") / NS)),
        "avg_clearing_latency_micros": _ratio(F.floor(F.col("_spent") / 1000), F.col("_timed")),
    }
    out |= {f"price_impact_bps_{h}s": F.col("effective_spread_bps") - F.col(f"realized_spread_bps_{h}s") for h in HORIZONS}
    out |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("executed_volume", "executed_notional", "trader_surplus")}
    out["trade_count"] = F.coalesce(F.col("trade_count"), F.lit(0)).cast("long")
    have = set(d.columns)
    return d.select("coin", *[out[c].alias(c) if c in out else F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in INTERVAL_COLUMNS])
