"""Data-quality audits of raw records and of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.scalars import NS
from . import ordered, stats

GAP = 60 * NS


def scan_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(classify.record_class().alias("class")).agg(F.count(F.lit(1)).alias("records"))


def dataset_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("user_id").alias("participants"), F.countDistinct("oid").alias("orders"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def code_histogram(events: DataFrame) -> DataFrame:
    """(kind, code, records) of statuses and order types."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("code")) for k, c in (("status", "status_id"), ("order_type", "order_type_id"))]))
    return events.select(kinds.alias("x")).groupBy("x.kind", "x.code").agg(F.count(F.lit(1)).alias("records"))


def with_labels(histogram: DataFrame, labels: DataFrame) -> DataFrame:
    """The label of each code; labels (kind, label, id) is a lookup of a few dozen fixed rows."""
    return histogram.join(F.broadcast(labels.withColumnRenamed("id", "code")), ["kind", "code"], "left")


def interarrival(events: DataFrame, keys: list[str], every: int = 200) -> DataFrame:
    """Statistics of each ``every``-th time difference within a file."""
    d = stats.numbered(ordered.lagged(events, "_before", F.col("ts"), "seq", keys), keys, "seq", "_i")
    d = d.where((F.col("_i") > 0) & (F.col("_i") % every == 1)).withColumn("gap", F.col("ts") - F.col("_before"))
    g = F.col("gap")
    return d.agg(F.count(g).alias("n"), F.avg(g).alias("mean"), F.percentile(g, F.lit(0.5)).alias("median"), F.percentile(g, F.lit(0.9)).alias("p90"), F.percentile(g, F.lit(0.99)).alias("p99"), F.avg(F.when(g == 0, 1.0).otherwise(0.0)).alias("zero_share"))


def duplicates(events: DataFrame, columns: list[str], file: str = "coin") -> DataFrame:
    """(file, records, repeats, live_repeats): later copies of a whole record within a file."""
    live = F.when(classify.is_new_live(), 1).otherwise(0)
    same = events.groupBy(file, *columns).agg(F.count(F.lit(1)).alias("_n"), F.max(live).alias("_live"))
    return same.groupBy(file).agg(F.sum("_n").alias("records"), F.sum(F.col("_n") - 1).alias("repeats"), F.sum((F.col("_n") - 1) * F.col("_live")).alias("live_repeats"))


def repeats_by_status(events: DataFrame, columns: list[str], file: str = "file") -> DataFrame:
    """(status_id, records, repeats): later copies of a whole record within a file, by its status."""
    same = events.groupBy(file, *columns).agg(F.count(F.lit(1)).alias("_n"))
    return same.groupBy("status_id").agg(F.sum("_n").alias("records"), F.sum(F.col("_n") - 1).alias("repeats"))


def worst_files(repeated: DataFrame, n: int = 10, file: str = "file") -> DataFrame:
    """The n files with the most repeats, of the result of duplicates."""
    return repeated.where("repeats > 0").orderBy(F.desc("repeats"), file).limit(n)


def submission_spread(events: DataFrame) -> DataFrame:
    """How far apart the submission times (ts less timestamp_diff, in ms) of an order's records lie."""
    sent = F.col("ts") - F.col("timestamp_diff") * (NS // 1000)
    one = events.groupBy("coin", "oid").agg((F.max(sent) - F.min(sent)).alias("_d"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return one.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("_d") > 2 * NS // 1000).alias("over_2ms"), F.count_if(F.col("_d") > NS).alias("over_1s"), F.max("_d").alias("widest"))


def record_faults(events: DataFrame, booleans: list[str], hour: str, file: str = "file") -> DataFrame:
    """(file, records, bad_booleans, outside_hour): flags that are neither 0 nor 1, times outside the file's hour (ns of its beginning)."""
    flags = reduce(lambda x, y: x + y, [F.when(F.col(b).isin(0, 1), 0).otherwise(1) for b in booleans])
    out = (F.col("ts") < F.col(hour)) | (F.col("ts") >= F.col(hour) + 3600 * NS)
    return events.groupBy(file).agg(F.count(F.lit(1)).alias("records"), F.sum(flags).alias("bad_booleans"), F.count_if(out).alias("outside_hour"))


def size_reductions(events: DataFrame) -> DataFrame:
    """(status_id, events, reduced): by how much records other than fills make their order smaller."""
    w = Window.partitionBy("coin", "oid").orderBy("seq")
    d = events.withColumn("_cut", F.lag("sz").over(w) - F.col("sz")).where((F.col("status_id") != classify.FILLED) & (F.col("_cut") > 0))
    return d.groupBy("status_id").agg(F.count(F.lit(1)).alias("events"), F.sum("_cut").alias("reduced"))


def recoveries(resets_: DataFrame, depth: DataFrame, minute: str = "minute", value: str = "depth", share: float = 0.9, within: int = 60) -> DataFrame:
    """For each reset: minutes until the depth is back at ``share`` of what it was before (null if not ``within``), and the depth that many minutes on."""
    r = resets_.select("coin", F.col(minute).alias("_at"), F.col("before"), F.explode(F.sequence(F.lit(1), F.lit(within))).alias("_k")).withColumn(minute, F.col("_at") + F.col("_k"))
    j = r.join(depth.select("coin", minute, F.col(value).alias("_d")), ["coin", minute], "left")
    back = F.min(F.when(F.col("_d") >= share * F.col("before"), F.col("_k")))
    return j.groupBy("coin", F.col("_at").alias(minute)).agg(back.alias("recovered_after"), F.max(F.when(F.col("_k") == within, F.col("_d"))).alias("depth_later"))


def replay_ratios(seconds: DataFrame) -> DataFrame:
    """Totals of (sim, venue, post_only) volumes by second and their ratios."""
    t = seconds.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sim", "venue", "post_only")])
    of = lambda a, b: F.when(b > 0, a / b)
    s, v, p = F.col("sim"), F.col("venue"), F.col("post_only")
    return t.select("sim", "venue", "post_only", of(s, v).alias("ratio"), of(p, s).alias("post_only_share"), of(s - p, v).alias("ratio_without_post_only"))


def sampled_files(files: DataFrame, n: int, seed: str = "", path: str = "path") -> DataFrame:
    """n files, the same for one seed wherever they are listed."""
    return files.orderBy(F.md5(F.concat(F.lit(seed), F.col(path)).cast("binary")), path).limit(n)


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str, n: int = 3) -> DataFrame:
    """The first n keys whose values differ or that one side lacks."""
    j = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).orderBy(*keys).limit(n)


def file_audit(events: DataFrame, file: str = "coin") -> DataFrame:
    """Counts of what a file shouldn't hold: unknown codes, steps back in time, long silences."""
    d = ordered.lagged(events, "_before", F.col("ts"), "seq", [file])
    step = F.col("ts") - F.col("_before")
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return d.withColumn("_d", step).groupBy(file).agg(
        F.count(F.lit(1)).alias("records"),
        hit((F.col("status_id") > 17) | (F.col("status_id") < 0)).alias("unknown_status"),
        hit((F.col("order_type_id") > 6) | (F.col("order_type_id") < 0)).alias("unknown_type"),
        hit(F.col("_d") < 0).alias("backward_steps"),
        hit(F.col("_d") > GAP).alias("long_gaps"),
        F.max("_d").alias("longest_gap"),
        hit(F.col("orig_sz") == 0).alias("size_zero"),
    )


def _terminal() -> Column:
    return classify.is_cancellation() | ((F.col("status_id") == classify.FILLED) & (F.coalesce(F.col("sz"), F.lit(0)) == 0))


def lifecycle_audit(events: DataFrame) -> DataFrame:
    """Counts over all orders: how they begin, sizes that grow, records after the end, re-opened ones."""
    w = Window.partitionBy("coin", "oid").orderBy("seq")
    first = F.row_number().over(w) == 1
    was = F.coalesce(F.lag("sz").over(w), F.col("orig_sz"))
    d = events.withColumn("_first", first).withColumn("_was", was).withColumn("_ended", F.coalesce(F.lag(_terminal()).over(w), F.lit(False)))
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = F.col("status_id")
    return d.agg(
        hit(F.col("_first")).alias("orders"),
        hit(F.col("_first") & s.isin(1, 9)).alias("first_is_open"),
        hit(F.col("_first") & ~s.isin(1, 9)).alias("first_is_other"),
        hit(~F.col("_first") & (F.col("sz") > F.col("_was"))).alias("size_increases"),
        hit(F.col("_ended")).alias("after_the_end"),
        hit((s == 1) & ~F.col("_first")).alias("reopened"),
    )


def venue_fills(events: DataFrame) -> DataFrame:
    """(sec, buy, sell, events, taker_buy, taker_sell): fills by second, from the size that each order had before."""
    w = Window.partitionBy("coin", "oid").orderBy("seq")
    d = events.withColumn("_fill", F.coalesce(F.lag("sz").over(w), F.col("orig_sz")) - F.col("sz")).where((F.col("status_id") == classify.FILLED) & (F.col("_fill") > 0))
    ask, taker, f = F.col("is_ask"), F.col("timestamp_diff") == 0, F.col("_fill")
    total = lambda c: F.sum(F.when(c, f).otherwise(0))
    return d.groupBy(F.floor(F.col("ts") / NS).alias("sec")).agg(total(~ask).alias("buy"), total(ask).alias("sell"), F.count(F.lit(1)).alias("events"), total(~ask & taker).alias("taker_buy"), total(ask & taker).alias("taker_sell"))


def _rules(engine: str) -> list[tuple[str, Column, Column]]:
    """(rule, where it applies, what holds there), from what the schema says of each metric."""
    from ..schemas import DIFFERENCES, METRICS, NESTED, POSITIVE, PRINTED, PRODUCTS, RANGE, SCOPE, WITH_TRADES

    c, told = F.col, lambda *names: reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in names])
    foreign = [m for m in METRICS if SCOPE.get(m, engine) != engine]
    out = [(f"{m} is not of this engine", F.lit(True), c(m).isNull()) for m in foreign]
    for m, (least, most) in RANGE.items():
        if m in foreign:
            continue
        bounds = [c(m) >= least - PRINTED] + ([c(m) <= most + PRINTED] if most is not None else [])
        out.append((f"{m} from {least}" + (f" to {most}" if most is not None else ""), told(m), reduce(lambda x, y: x & y, bounds)))
    out += [(f"{m} above 0", told(m), c(m) > 0) for m in POSITIVE]
    traded = c("executed_volume") > 0
    out += [(f"{m} goes with trades", F.lit(True), traded == (c(m).isNotNull() if empty == "null" else c(m) > 0)) for m, empty in WITH_TRADES.items()]
    out.append(("a trade has one unit at least", traded, c("executed_volume") >= c("trade_count")))
    for m, (x, y) in PRODUCTS:
        # each printed number is off by half a digit at most
        out.append((f"{m} is {x} times {y}", told(m, x, y), F.abs(c(m) - c(x) * c(y)) <= PRINTED * (1 + F.abs(c(x)) + F.abs(c(y))) + 1e-9 * F.abs(c(m))))
    for m, (x, y) in DIFFERENCES:
        out.append((f"{m} is {x} less {y}", told(x, y), F.coalesce(F.abs(c(m) - (c(x) - c(y))) <= 4 * PRINTED, F.lit(False))))
        out.append((f"{m} needs {x} and {y}", c(m).isNotNull(), told(x, y)))
    if "total_book_depth" not in foreign:
        out += [(f"{x} is within {y}", told(x, y), c(x) <= c(y) + 2 * PRINTED) for x, y in zip(NESTED, NESTED[1:], strict=False)]
    else:
        out.append(("one price an interval's batches agree on", c("intra_interval_price_dispersion").isNotNull() & (c("trade_count") == 1), F.abs(c("intra_interval_price_dispersion")) <= PRINTED))
    return out


def invariants(d: DataFrame, engine: str, width: int) -> DataFrame:
    """(rule, checked, violations) of an engine's interval table.

    The grid is told by its ends and its count: distinct starts that are whole
    widths from the first one, as many as lie between the ends, follow one another.
    """
    c, start = F.col, F.col("interval_start_ns")
    ends = d.groupBy("coin").agg(F.min(start).alias("_first"), F.max(start).alias("_last"), F.count(F.lit(1)).alias("_rows"), F.countDistinct(start).alias("_starts"))
    n = (c("_last") - c("_first")) / width + 1
    grid = [
        ("grid: whole widths from the first", F.lit(True), c("_off") == 0),
        ("grid: as wide as asked for", F.lit(True), c("_width") == 0),
        ("grid: one row a start", F.lit(True), c("_rows") == c("_starts")),
        ("grid: as many rows as between the ends", F.lit(True), c("_starts") == n),
    ]
    hit = lambda x: F.sum(F.when(x, 1).otherwise(0))
    off = d.join(F.broadcast(ends), "coin").groupBy("coin", "_first", "_last", "_rows", "_starts").agg(hit((start - c("_first")) % width != 0).alias("_off"), hit(c("interval_width_ns") != width).alias("_width"))

    def counted(rows, rules):
        sums = [F.struct(F.lit(name).alias("rule"), F.coalesce(hit(where), F.lit(0)).alias("checked"), F.coalesce(hit(where & ~holds), F.lit(0)).alias("violations")).alias(f"r{i}") for i, (name, where, holds) in enumerate(rules)]
        one = rows.agg(*sums)
        return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")

    return counted(off, grid).unionByName(counted(d, _rules(engine)))


def summary(d: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, total, avg, min, max) of an interval table."""
    long = d.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"))


def summary_text(header: dict[str, object], rows: list) -> str:
    """The summary table as text, with each metric's scope."""
    from ..schemas import METRICS, SCOPE

    named = {r["metric"]: r for r in rows}
    out = [f"{k}: {v}" for k, v in header.items()] + [""]
    for m in METRICS:
        if (r := named.get(m)) is not None:
            figures = "no values" if not r["n"] else f"avg {r['avg']:.6f}  min {r['min']:.6f}  max {r['max']:.6f}  n {r['n']}"
            out.append(f"{m} [{SCOPE.get(m, 'both')}]: {figures}")
    return "\n".join(out)


def crosscheck(d: DataFrame, stored: DataFrame, metrics: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(metric, same_n, same_total, same_range) of a table against stored (metric, n, total, min, max)."""
    a, b = summary(d, metrics).alias("a"), stored.alias("b")
    near = lambda x: F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"b.{x}")))
    return a.join(b, "metric").select("metric", (F.col("a.n") == F.col("b.n")).alias("same_n"), near("total").alias("same_total"), (near("min") & near("max")).alias("same_range"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(rows, missing_a, missing_b, and differing rows of each value) of two results."""
    x, y = a.select(*keys, *values, F.lit(1).alias("_in")).alias("x"), b.select(*keys, *values, F.lit(1).alias("_in")).alias("y")
    cond = reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    j = x.join(y, cond, "full_outer")
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = F.col("x._in").isNotNull() & F.col("y._in").isNotNull()
    same = lambda v: F.col(f"x.{v}").eqNullSafe(F.col(f"y.{v}")) | F.coalesce(F.abs(F.col(f"x.{v}") - F.col(f"y.{v}")) <= tolerance, F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("rows"), hit(F.col("x._in").isNull()).alias("missing_a"), hit(F.col("y._in").isNull()).alias("missing_b"), *[hit(both & ~same(v)).alias(f"differs_{v}") for v in values])


def excess(sim: DataFrame, venue: DataFrame, key: str = "sec", value: str = "volume") -> DataFrame:
    """key, sim, venue, excess over the union of both keys."""
    j = sim.select(key, F.col(value).alias("sim")).join(venue.select(key, F.col(value).alias("venue")), key, "full_outer").na.fill(0, ["sim", "venue"])
    return j.withColumn("excess", F.greatest(F.col("sim") - F.col("venue"), F.lit(0)))


def resets(depth: DataFrame, minute: str = "minute", value: str = "depth", drop: float = 0.6) -> DataFrame:
    """Minutes at the top of an hour whose mean depth falls below ``drop`` of the mean of the ten before (five at least)."""
    d = ordered.rolling_rows(depth, minute, ["coin"], 10, {"_n": F.count(value), "_m": F.avg(value)})
    d = d.withColumn("before", F.when(F.col("_n") >= 5, F.col("_m"))).drop("_n", "_m")
    return d.where((F.col(minute) % 60 == 0) & (F.col(value) < drop * F.col("before")))
