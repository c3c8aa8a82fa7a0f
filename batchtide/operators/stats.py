"""Paired statistics with autocorrelation-robust errors, and series functions of the analysis."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LAGS = 60


def lag_rule(n: Column) -> Column:
    """floor(4 (n/100)^(2/9)), at most 60; none below two."""
    return F.when(n < 2, 0).otherwise(F.least(F.lit(MOST_LAGS), F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))))).cast("int")


def normal_two_sided(t: Column) -> Column:
    """Two-sided p-value of a standard normal (a Pandas UDF: there is no built-in erfc)."""

    def p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else float("nan"))

    return F.pandas_udf(p, "double")(t)


def _autocovariance_sum(d: DataFrame, score: str, keys: list[str], order: str) -> DataFrame:
    """keys, s: the Bartlett-weighted sum of autocovariances of score up to the rule's lags.

    Lags count rows of the compacted sequence.  A row meets at most MOST_LAGS
    later ones by its number, an equi-join, so a series needn't be one task's.
    """
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_l", lag_rule(F.col("_n")))
    rows = d.select(*keys, F.col(order).alias("_i"), F.col(score).alias("_u"))
    left = rows.join(n, keys).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_l")))).withColumn("_j", F.col("_i") - F.col("_k"))
    right = rows.select(*keys, F.col("_i").alias("_j"), F.col("_u").alias("_w"))
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("_k") / (F.col("_l") + 1.0)))
    return left.join(right, [*keys, "_j"]).groupBy(*keys).agg(F.sum(weight * F.col("_u") * F.col("_w")).alias("s"))


def numbered(d: DataFrame, keys: list[str], order: str, name: str = "i", shards: int = 1 << 20, ties: tuple = ()) -> DataFrame:
    """Row numbers from 0 along order (then ties), by shards of order: ranks inside plus what earlier shards hold."""
    s = d.withColumn("_s", F.floor(F.col(order) / shards))
    before = s.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_b", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(order, *ties)) - 1
    return s.withColumn("_r", inside).join(before, [*keys, "_s"]).withColumn(name, (F.col("_r") + F.col("_b")).cast("long")).drop("_s", "_r", "_b")


def paired_difference(d: DataFrame, a: str, b: str, keys: list[str], order: str) -> DataFrame:
    """keys, n, mean_a, mean_b, diff, se, t of a - b over rows where both are present."""
    p = numbered(d.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b)), keys, order)
    m = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("_d").alias("diff"), F.stddev_pop("_d").alias("_sd"))
    e = p.join(m.select(*keys, "diff"), keys).withColumn("_e", F.col("_d") - F.col("diff"))
    s = _autocovariance_sum(e, "_e", keys, "i")
    se = F.when((F.col("n") > 1) & (F.col("_sd") > 0) & (F.col("s") > 0), F.sqrt("s") / F.col("n"))
    return m.join(s, keys, "left").withColumn("se", se).select(*keys, "n", "mean_a", "mean_b", "diff", "se", (F.col("diff") / F.col("se")).alias("t"))


def with_p(d: DataFrame) -> DataFrame:
    return d.withColumn("p", normal_two_sided(F.col("t")))


def origin_slope(d: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """keys, slope of y on x through the origin."""
    return d.groupBy(*keys).agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"))


def slope_difference(d: DataFrame, x: str, a: str, b: str, keys: list[str], order: str) -> DataFrame:
    """keys, slope_a, slope_b, diff, se, t: two slopes on the same x, and their difference's robust error."""
    p = numbered(d.where(F.col(x).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()), keys, order)
    xx, xa, xb = (F.sum(F.col(x) * F.col(c)) for c in (x, a, b))
    m = p.groupBy(*keys).agg((xa / xx).alias("slope_a"), (xb / xx).alias("slope_b"), xx.alias("_xx"))
    e = p.join(m, keys).withColumn("_e", F.col(x) * (F.col(a) - F.col(b) - (F.col("slope_a") - F.col("slope_b")) * F.col(x)))
    s = _autocovariance_sum(e, "_e", keys, "i")
    return m.join(s, keys).withColumn("diff", F.col("slope_a") - F.col("slope_b")).withColumn("se", F.sqrt("s") / F.col("_xx")).select(*keys, "slope_a", "slope_b", "diff", "se", (F.col("diff") / F.col("se")).alias("t"))


def one_sided(d: DataFrame, value: str, keys: list[str]) -> DataFrame:
    v = F.col(value)
    return d.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"))


def unpivot_metrics(d: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Long form: ids, metric, value."""
    return d.unpivot(ids, metrics, "metric", "value")


def paired(fba: DataFrame, cda: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """One row an interval with _fba and _cda columns; each interval is there once on both sides, else it fails."""
    for d, name in ((fba, "fba"), (cda, "cda")):
        if not d.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"intervals of {name} are not unique")
    side = lambda d, s: d.select(*keys, *[F.col(m).alias(f"{m}_{s}") for m in metrics])
    return side(fba, "fba").join(side(cda, "cda"), keys)


def paired_table(wide: DataFrame, metrics: list[str], order: str) -> DataFrame:
    """The paired difference of every metric."""
    long = wide.select(order, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_fba").cast("double").alias("a"), F.col(f"{m}_cda").cast("double").alias("b")) for m in metrics])).alias("m")).select(order, "m.*")
    return paired_difference(long, "a", "b", ["metric"], order)


def price_changes_bps(d: DataFrame, price: str, order: str, keys: list[str], horizon: int = 0) -> DataFrame:
    """filled: the price carried forward; change: from one row before to ``horizon`` rows ahead, in bp."""
    from .ordered import forward_fill

    f = forward_fill(forward_fill(d, "filled", price, order, keys), "_before", price, order, keys, inclusive=False)
    if horizon:
        f = numbered(f, keys, order, "_i")
        ahead = f.select(*keys, (F.col("_i") - horizon).alias("_i"), F.col("filled").alias("_ahead"))
        f = f.join(ahead, [*keys, "_i"], "left").drop("_i")
    last = F.col("_ahead") if horizon else F.col("filled")
    return f.withColumn("change", F.when(F.col("_before") > 0, (last - F.col("_before")) / F.col("_before") * 10_000.0)).drop("_before", "_ahead")


def tick_sign(d: DataFrame, price: str, order: str, keys: list[str]) -> DataFrame:
    """sign: of the last change that was not zero."""
    from .ordered import forward_fill, lagged

    moved = lagged(d, "_before", F.col(price), order, keys).withColumn("_sign", F.nullif(F.signum(F.col(price) - F.col("_before")), F.lit(0.0)))
    return forward_fill(moved, "sign", "_sign", order, keys).drop("_sign", "_before")


def log_returns(d: DataFrame, price: str, order: str, keys: list[str], name: str = "r") -> DataFrame:
    from .ordered import lagged

    return lagged(d, "_before", F.col(price), order, keys).withColumn(name, F.log(F.col(price) / F.col("_before"))).drop("_before")


def windowed_rms(d: DataFrame, r: str, keys: list[str], least: int = 5) -> DataFrame:
    """keys, n, rms in bp; null below so many returns."""
    return d.groupBy(*keys).agg(F.count(r).alias("n"), F.when(F.count(r) >= least, F.sqrt(F.avg(F.col(r) * F.col(r))) * 10_000.0).alias("rms"))


def block_sums(d: DataFrame, index: str, value: str, k: int, length: int) -> DataFrame:
    """(block, total) of whole blocks of k; a block cut short by the end is left out."""
    return d.where(F.col(index) < length - length % k).groupBy(F.floor(F.col(index) / k).alias("block")).agg(F.sum(value).alias("total"))


def quantile_bins(d: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(bin, n, mean_x, mean_y) between distinct exact quantiles; edges belong to the bin below, the least to the first."""
    cuts = sorted(set(d.select(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0] or []))
    inner = cuts[1:-1]
    place = sum((F.when(F.col(x) > c, 1).otherwise(0) for c in inner), F.lit(0))
    return d.where(F.col(x).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))


def histogram(d: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins; the last one holds hi."""
    b = F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return d.where((value >= lo) & (value <= hi)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def clip_quantiles(d: DataFrame, x: str, lo: float, hi: float) -> DataFrame:
    q = d.agg(F.percentile(x, F.lit(lo)).alias("_lo"), F.percentile(x, F.lit(hi)).alias("_hi"))
    return d.crossJoin(F.broadcast(q)).where(F.col(x).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
