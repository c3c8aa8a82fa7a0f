"""Order-dependent functions over long sequences, by shards.

A window over a whole sequence is one task's work.  Here the sequence is cut
into shards of its order column; a window runs inside each shard, what must be
carried from shard to shard is one row a shard, and a window over those few
rows supplies it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 1 << 20


def _keyed(keys: Sequence[str]) -> list[str]:
    return list(keys) or ["_all"]


def carried(df: DataFrame, name: str, value: Column, order: str, kind: str, keys: Sequence[str] = (), shard: int = SHARD, inclusive: bool = True) -> DataFrame:
    """df with ``name``: the running max of value (kind "max") or its last non-null (kind "last") up to each row.

    Without inclusive the row itself doesn't count.  order is a long column
    that is unique for each key.
    """
    k = _keyed(keys)
    d = df.withColumn("_all", F.lit(0)) if not keys else df
    d = d.withColumn("_v", value).withColumn("_shard", F.floor(F.col(order) / shard))
    head = d.groupBy(*k, "_shard").agg((F.max("_v") if kind == "max" else F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order)))).alias("_head"))
    earlier = Window.partitionBy(*k).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    head = head.withColumn("_carry", F.max("_head").over(earlier) if kind == "max" else F.last("_head", True).over(earlier)).select(*k, "_shard", "_carry")
    inside = Window.partitionBy(*k, "_shard").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    here = F.max("_v").over(inside) if kind == "max" else F.last("_v", True).over(inside)
    out = d.withColumn("_here", here).join(head, [*k, "_shard"])
    joined = F.greatest("_here", "_carry") if kind == "max" else F.coalesce("_here", "_carry")
    return out.withColumn(name, joined).drop("_v", "_shard", "_here", "_carry", *([] if keys else ["_all"]))


def running_max(df: DataFrame, name: str, value: str, order: str, keys: Sequence[str] = (), shard: int = SHARD) -> DataFrame:
    return carried(df, name, F.col(value), order, "max", keys, shard)


def forward_fill(df: DataFrame, name: str, value: str, order: str, keys: Sequence[str] = (), shard: int = SHARD, inclusive: bool = True) -> DataFrame:
    return carried(df, name, F.col(value), order, "last", keys, shard, inclusive)


def lagged(df: DataFrame, name: str, value: Column, order: str, keys: Sequence[str] = (), shard: int = SHARD) -> DataFrame:
    """df with the value of the row before (null at the first), nulls included."""
    d = carried(df, "_was", F.struct(value.alias("v")), order, "last", keys, shard, inclusive=False)
    return d.withColumn(name, F.col("_was.v")).drop("_was")


def rolling_rows(df: DataFrame, order: str, keys: Sequence[str], rows: int, columns: dict[str, Column], shard: int = SHARD) -> DataFrame:
    """df with aggregates over the ``rows`` rows before each one.

    columns: aggregate functions by name.  Rows are numbered and cut into
    shards; the last rows of a shard are also in the next one, where they only
    stand before others.
    """
    from .stats import numbered

    d = numbered(df, list(keys), order, "_i")
    own = F.floor(F.col("_i") / shard)
    d = d.withColumn("_p", F.explode(F.when(F.col("_i") % shard >= shard - rows, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_p").orderBy("_i").rowsBetween(-rows, -1)
    return d.withColumns({n: c.over(w) for n, c in columns.items()}).where(F.col("_p") == own).drop("_i", "_p")


def batch_index(events: DataFrame, width: int, keys: Sequence[str] = ("coin",)) -> DataFrame:
    """events with clock (running max of ts) and batch: windows of width from the first record's ts; a record at a boundary is in the next one."""
    d = running_max(events, "clock", "ts", "seq", keys)
    first = events.groupBy(*keys).agg(F.min_by("ts", "seq").alias("_t0"))
    return d.join(first, list(keys)).withColumn("batch", F.floor((F.col("clock") - F.col("_t0")) / width).cast("long")).drop("_t0")


def asof_forward(probes: DataFrame, prices: DataFrame, time: str, price_time: str, price_order: str, value: str, name: str, keys: Sequence[str] = (), width: int = 3600 * 10**9) -> DataFrame:
    """probes with the value of the first price row at or after their time (in order on ties), null past the end.

    Both sides are cut into buckets of time.  Within a bucket the two are
    sorted together, backwards, probes last; a probe that finds nothing there takes the
    first price of the next bucket that has one.
    """
    k = list(keys)
    cols = probes.columns
    p = probes.select(*k, F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_o"), F.struct(*cols).alias("_row"), F.lit(None).cast(prices.schema[value].dataType).alias("_v"))
    q = prices.where(F.col(value).isNotNull()).select(*k, F.col(price_time).alias("_t"), F.lit(1).alias("_kind"), F.col(price_order).cast("long").alias("_o"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    u = p.unionByName(q).withColumn("_b", F.floor(F.col("_t") / width))
    bk = [*k, "_b"]
    firsts = u.groupBy(*bk).agg(F.min_by("_v", F.when(F.col("_kind") == 1, F.struct("_t", "_o"))).alias("_first"))
    # backwards in time, so that each row adds one to the frame before it; frames to the end would be worked out anew
    later = Window.partitionBy(*k).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_next", F.last("_first", True).over(later)).select(*bk, "_next")
    ahead = Window.partitionBy(*bk).orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    found = u.withColumn("_found", F.last("_v", True).over(ahead)).where("_kind = 0").join(firsts, bk)
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in cols], F.coalesce("_found", "_next").alias(name))


def in_windows(windows: DataFrame, points: DataFrame, lo: str, hi: str, at: str, name: str, keys: Sequence[str], width: int) -> DataFrame:
    """windows with the number of points in [lo, hi], both ends counted.

    Points before a time are counted up, by buckets of width, so a window is two
    look-ups in time whatever it holds: points before its end's next instant less points before its
    beginning.
    """
    k = list(keys)
    counted = points.groupBy(*k, F.col(at).alias("_at")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.floor(F.col("_at") / width))
    shards = counted.groupBy(*k, "_s").agg(F.sum("_n").alias("_m"))
    earlier = Window.partitionBy(*k).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("_carry", F.coalesce(F.sum("_m").over(earlier), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*k, "_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("_here", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(shards, [*k, "_s"]).select(*k, "_at", (F.col("_here") + F.col("_carry")).alias("_before"))
    total = points.groupBy(*k).agg(F.count(F.lit(1)).alias("_total"))
    held = windows.withColumns({"_lo": F.col(lo), "_hi": F.col(hi)})
    ends = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("_lo").alias("x")), F.struct(F.lit(1).alias("sign"), (F.col("_hi") + 1).alias("x"))))
    probes = held.select(*k, "_lo", "_hi").distinct().withColumn("_e", ends).select(*k, "_lo", "_hi", "_e.sign", F.col("_e.x").alias("_x"))
    found = asof_forward(probes, before, "_x", "_at", "_at", "_before", "_c", k, width).join(F.broadcast(total), k, "left")
    got = found.groupBy(*k, "_lo", "_hi").agg(F.sum(F.col("sign") * F.coalesce("_c", "_total", F.lit(0))).alias("_count"))
    return held.join(got, [*k, "_lo", "_hi"], "left").select(*windows.columns, F.coalesce(F.greatest("_count", F.lit(0)), F.lit(0)).alias(name))


def dense_grid(bounds: DataFrame, width: int, keys: Sequence[str] = ("coin",)) -> DataFrame:
    """(keys, bucket): every interval from a key's anchor to the one that holds its last time."""
    past = F.greatest(F.col("last") - F.col("anchor"), F.lit(0).cast("long"))
    return bounds.select(*keys, F.explode(F.sequence(F.col("anchor"), F.col("anchor") + past - past % width, F.lit(width).cast("long"))).alias("bucket"))
