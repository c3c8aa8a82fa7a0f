"""Functions on the two engines' series, a row a bucket: what the figures and tables of an analysis are made of.

A paired row has the bucket's number in ``order`` and both engines' values; rows
follow one another by shards (see ordered.py), so no series is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered, stats

BPS = 10_000.0


def both_traded(paired: DataFrame, a: str, b: str) -> DataFrame:
    """Rows on which both engines have a price."""
    return paired.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def signed_spreads(paired: DataFrame, price: str, other: str, effective: str, realized: str, order: str, keys: list[str]) -> DataFrame:
    """sign of the price's last move over rows on which both traded, spreads times it, and impact as what is left of effective over realized."""
    d = stats.tick_sign(both_traded(paired, price, other), price, order, keys)
    e, r = F.col("sign") * F.col(effective), F.col("sign") * F.col(realized)
    return d.select(*keys, order, "sign", e.alias("signed_effective"), r.alias("signed_realized"), (e - r).alias("signed_impact"))


def matched_returns(paired: DataFrame, a: str, b: str, order: str, keys: list[str]) -> DataFrame:
    """Log returns r_a and r_b of both prices between rows on which both traded, and their sizes in bp."""
    d = stats.log_returns(stats.log_returns(both_traded(paired, a, b), a, order, keys, "r_a"), b, order, keys, "r_b")
    return d.withColumn("abs_a", F.abs("r_a") * BPS).withColumn("abs_b", F.abs("r_b") * BPS)


def intersection(paired: DataFrame, a: str, b: str) -> DataFrame:
    """Shares of buckets in which each and both traded, and the share if the two were independent."""
    x, y = F.col(a).isNotNull(), F.col(b).isNotNull()
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return paired.agg(F.count(F.lit(1)).alias("n"), share(x).alias("share_a"), share(y).alias("share_b"), share(x & y).alias("share_both"), (share(x) * share(y)).alias("share_if_independent"))


def common_flow_slopes(prices: DataFrame, flow: DataFrame, a: str, b: str, order: str, keys: list[str], horizons: tuple[int, ...] = (0, 5)) -> DataFrame:
    """(horizon, slope_a, slope_b, diff, se, t): both prices' moves on one flow (order, x) of the same buckets.

    The buckets must follow one another, else it fails: a move over ``h`` rows is then one over h buckets.
    """
    ends = prices.groupBy(*keys).agg((F.max(order) - F.min(order) + 1).alias("span"), F.count(F.lit(1)).alias("n"), F.countDistinct(order).alias("starts"))
    if not ends.where("span <> n or n <> starts").isEmpty():
        raise ValueError("buckets don't follow one another")
    # both prices at once, and all horizons: rows numbered once meet those h further on
    which = F.explode(F.array(*[F.struct(F.lit(p).alias("which"), F.col(p).cast("double").alias("v")) for p in (a, b)]))
    long = prices.select(*keys, order, which.alias("p")).select(*keys, order, "p.which", "p.v")
    k = [*keys, "which"]
    f = ordered.forward_fill(ordered.forward_fill(long, "filled", "v", order, k), "before", "v", order, k, inclusive=False)
    probes = f.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("_at", F.col(order) + F.col("horizon"))
    ahead = f.select(*k, F.col(order).alias("_at"), F.col("filled").alias("after"))
    moves = probes.join(ahead, [*k, "_at"]).where("before > 0").withColumn("y", (F.col("after") - F.col("before")) / F.col("before") * BPS)
    wide = moves.groupBy(*keys, order, "horizon").agg(*[F.max(F.when(F.col("which") == p, F.col("y"))).alias(f"y_{p}") for p in (a, b)])
    d = wide.join(flow.select(*keys, order, F.col("x").cast("double").alias("x")), [*keys, order])
    return stats.slope_difference(d, "x", f"y_{a}", f"y_{b}", [*keys, "horizon"], order)


def candle_deviation(vwap: DataFrame, candles: DataFrame, keys: list[str], price: str = "vwap", close: str = "close") -> DataFrame:
    """keys, vwap, close, deviation of the simulated price from an outside candle's close, where both have the hour."""
    return vwap.join(candles.select(*keys, F.col(close).alias("_close")), keys).select(*keys, F.col(price).alias("vwap"), F.col("_close").alias("close"), (F.col(price) / F.col("_close") - 1).alias("deviation"))


def complete_days(*series: DataFrame, expected: int, share: float = 0.8) -> DataFrame:
    """Days (column day) that have at least a share of the expected rows in every one of the series."""
    out = None
    for s in series:
        days = s.groupBy("day").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= share * expected).select("day")
        out = days if out is None else out.join(days, "day", "left_semi")
    return out


def daily_means(d: DataFrame, days: DataFrame, values: list[str]) -> DataFrame:
    """Means of some values by day, on the days given."""
    return d.join(days, "day", "left_semi").groupBy("day").agg(*[F.avg(v).alias(v) for v in values])


def busiest_day(d: DataFrame, days: DataFrame, value: str) -> DataFrame:
    """One row (day, mean): the given day with the highest mean, the earlier one of equals."""
    m = daily_means(d, days, [value])
    top = F.max(F.struct(F.col(value).alias("mean"), (-F.col("day")).alias("d")))
    return m.agg(top.alias("t")).select((-F.col("t.d")).alias("day"), "t.mean")


def rolling_mean(d: DataFrame, value: str, order: str, keys: list[str], span: int, shard: int = 1 << 20) -> DataFrame:
    """rolling: the mean of values in (t - span, t], by shards of time that begin with what the one before ends with."""
    own = F.floor(F.col(order) / shard)
    p = F.explode(F.sequence(own, F.floor((F.col(order) + span - 1) / shard))).alias("_p")
    w = Window.partitionBy(*keys, "_p").orderBy(order).rangeBetween(-span + 1, 0)
    return d.select("*", p).withColumn("rolling", F.avg(value).over(w)).where(F.col("_p") == own).drop("_p")


def share_histogram(d: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, share) of equal bins of what lies from lo to hi."""
    h = stats.histogram(d, value, lo, hi, bins)
    total = h.agg(F.sum("n").alias("_t"))
    return h.crossJoin(F.broadcast(total)).select("bin", (F.col("n") / F.col("_t")).alias("share"))  # one row


def clipped_histogram(d: DataFrame, x: str, top: float, bins: int) -> DataFrame:
    """(bin, n) of what is above 0 and below the quantile, and in bin -1 how many are 0."""
    edge = d.agg(F.percentile(x, F.lit(top)).alias("_edge"))
    v = d.where(F.col(x).isNotNull()).crossJoin(F.broadcast(edge))  # one row
    place = F.when(F.col(x) == 0, -1).when(F.col(x) <= F.col("_edge"), F.least(F.floor(F.col(x) / F.col("_edge") * bins), F.lit(bins - 1)))
    return v.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin is not null")


def bucket_prices(d: DataFrame, keys: list[str], price: str, minute: str) -> DataFrame:
    """Of the buckets: how many there are, how many have several prices, and the most prices in one."""
    one = d.groupBy(*keys, minute).agg(F.countDistinct(price).alias("_n"))
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("buckets"), F.count_if(F.col("_n") > 1).alias("several"), F.max("_n").alias("most"))


def resampled(d: DataFrame, keys: list[str], order: str, width: int, value: str) -> DataFrame:
    """Mean and median of a value by coarser buckets."""
    return d.groupBy(*keys, F.floor(F.col(order) / width).alias("period")).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))


def price_union(books: DataFrame, batches: DataFrame) -> DataFrame:
    """(coin, ts, kind, ord, p): mids and clearing prices in one series, at one time the books' first."""
    b = books.where("best_bid is not null and best_ask is not null").select("coin", "ts", F.lit(0).alias("kind"), F.col("seq").alias("ord"), ((F.col("best_bid") + F.col("best_ask")) / 2.0).alias("p"))
    c = batches.where("clearing_price is not null").select("coin", "ts", F.lit(1).alias("kind"), F.col("batch").alias("ord"), F.col("clearing_price").cast("double").alias("p"))
    return b.unionByName(c)


