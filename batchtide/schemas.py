"""Schemas of the event-replay tables; all times are long nanoseconds, prices are long millionths."""

ORDER_EVENTS = (
    "coin string, seq long, file string, ts long, user_id string, is_builder boolean, status_id int, is_ask boolean, limit_px long, sz long, oid long, "
    "timestamp_diff long, trigger_condition long, triggered boolean, is_trigger boolean, has_children boolean, is_position_tpsl boolean, reduce_only boolean, "
    "order_type_id int, tif_id int, trigger_px long, orig_sz long"
)
TRADES = (
    "coin string, engine string, trade_id long, seq long, price long, quantity long, buyer_id string, seller_id string, buy_order_id long, sell_order_id long, "
    "ts long, reference_price long, aggressor_is_ask boolean"
)
DEPTHS = ("b10", "a10", "b50", "a50", "b100", "a100")
_DEPTHS = ", ".join(f"{c} long" for c in DEPTHS)
BATCHES = (
    "coin string, batch long, ts long, batch_open_ts long, clearing_price long, demand_at_price long, supply_at_price long, net_order_flow long, "
    f"traded_quantity long, unexecuted_quantity long, best_unfilled_buy long, best_unfilled_sell long, {_DEPTHS}, pool_orders long, compute_ns long"
)
BOOKS = (
    "coin string, seq long, ts long, best_bid long, best_ask long, best_bid_qty long, best_ask_qty long, bid_depth long, ask_depth long, "
    f"{_DEPTHS}, compute_ns long"
)
RESTING = "coin string, is_ask boolean, price long, ts long, oid long, user_id string, quantity long, is_market boolean"

#: The interval table's columns, in order (fixed values).
INTERVAL_COLUMNS = [
    "engine", "interval_start_ns", "interval_width_ns", "quoted_spread_bps", "depth_at_best", "depth_within_10bps", "depth_within_50bps",
    "depth_within_100bps", "book_imbalance", "total_book_depth", "effective_spread_bps", "realized_spread_bps_1s", "realized_spread_bps_5s",
    "realized_spread_bps_30s", "price_impact_bps_1s", "price_impact_bps_5s", "price_impact_bps_30s", "amihud_illiquidity", "kyle_lambda",
    "realized_volatility", "intra_interval_price_dispersion", "pricing_error_bps", "executed_volume", "executed_notional", "vwap", "trade_count",
    "fill_rate", "avg_time_to_execution_secs", "trader_surplus", "order_size_inflation", "order_to_trade_ratio", "boundary_concentration",
    "throughput_orders_per_sec", "avg_clearing_latency_micros", "unexecuted_residual_share",
]
METRICS = INTERVAL_COLUMNS[3:]
#: Which engine has a metric (others have both, or need outside data).
SCOPE = {"book_imbalance": "cda", "total_book_depth": "cda", "boundary_concentration": "fba", "unexecuted_residual_share": "fba", "pricing_error_bps": "external"}

#: What a metric may be: (least, most), either of them open-ended.
RANGE = {
    **dict.fromkeys(("executed_volume", "executed_notional", "trader_surplus", "depth_at_best", "total_book_depth"), (0, None)),
    **dict.fromkeys(("effective_spread_bps", "amihud_illiquidity", "realized_volatility", "intra_interval_price_dispersion"), (0, None)),
    **dict.fromkeys(("boundary_concentration", "unexecuted_residual_share", "fill_rate"), (0, 1)),
    "book_imbalance": (-1, 1),
}
#: What is above zero wherever it is told.
POSITIVE = ("quoted_spread_bps", "vwap")
#: (product, factors), (difference, its two terms), and depths of which each holds the one before.
PRODUCTS = [("executed_notional", ("vwap", "executed_volume"))]
DIFFERENCES = [(f"price_impact_bps_{h}", ("effective_spread_bps", f"realized_spread_bps_{h}")) for h in ("1s", "5s", "30s")]
NESTED = ("depth_within_10bps", "depth_within_50bps", "depth_within_100bps", "total_book_depth")
#: What an interval with trades tells and one without doesn't, whether as null or as zero.
WITH_TRADES = {"vwap": "null", "trade_count": "zero", "executed_notional": "zero"}
#: Half of the last digit that is printed.
PRINTED = 5e-7


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def arrow(ddl: str):
    """The Arrow schema of one of the texts above; needs no session, so workers can use it."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])
