"""Registered queries on the two engines' series and on audits of files, with DuckDB SQL beside them.

PAIR stands for the two engines' interval tables: a fixed rule gives each hour of
the order flow a price of either engine, spreads, depths and volatility.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, series, stats
from ..sources.flow import FLOW_SQL, order_flow
from .queries import _SERIES, _SIZED, BATCHES_SQL, BOOKS_SQL, HOUR, TAPE, _series, _sized, query, rounded, tape

_PAIR = _SERIES + """, pair AS (SELECT hour, hour // 24 AS day, CASE WHEN hour % 4 > 0 THEN px END::DOUBLE AS fba, CASE WHEN hour % 7 > 0 THEN n::DOUBLE / q END AS cda, (a % 97)::DOUBLE / 4 AS eff, (b % 53)::DOUBLE / 8 AS rea,
  (q % 1000)::DOUBLE / 1000 AS residual, abs(a - b)::DOUBLE AS rv, q AS depth FROM series)"""


def _pair(spark, sf):
    h = F.col("hour")
    return _series(spark, sf).select(
        "coin", "hour", F.floor(h / 24).alias("day"), F.when(h % 4 > 0, F.col("px")).cast("double").alias("fba"), F.when(h % 7 > 0, F.col("n").cast("double") / F.col("q")).alias("cda"),
        ((F.col("a") % 97).cast("double") / 4).alias("eff"), ((F.col("b") % 53).cast("double") / 8).alias("rea"), ((F.col("q") % 1000).cast("double") / 1000).alias("residual"),
        F.abs(F.col("a") - F.col("b")).cast("double").alias("rv"), F.col("q").alias("depth"), F.col("q").alias("x"),
    )


_BOTH = _PAIR + ", both_ AS (SELECT * FROM pair WHERE fba IS NOT NULL AND cda IS NOT NULL)"


@query(f"""WITH {_BOTH}, d AS (SELECT *, nullif(sign(fba - lag(fba) OVER (ORDER BY hour)), 0) AS s FROM both_), z AS (SELECT *, last_value(s IGNORE NULLS) OVER (ORDER BY hour)::DOUBLE AS sign FROM d)
SELECT hour, sign, round(sign * eff, 6) AS signed_effective, round(sign * rea, 6) AS signed_realized, round(sign * eff - sign * rea, 6) AS signed_impact FROM z""")
def signed_spreads(spark, sf):
    return rounded(series.signed_spreads(_pair(spark, sf), "fba", "cda", "eff", "rea", "hour", ["coin"]).drop("coin"))


@query(f"""WITH {_BOTH} SELECT hour, round(abs(ln(fba / lag(fba) OVER (ORDER BY hour))) * 10000, 6) AS abs_a, round(abs(ln(cda / lag(cda) OVER (ORDER BY hour))) * 10000, 6) AS abs_b FROM both_""")
def matched_returns(spark, sf):
    return rounded(series.matched_returns(_pair(spark, sf), "fba", "cda", "hour", ["coin"]).select("hour", "abs_a", "abs_b"))


@query(f"""WITH {_BOTH}, r AS (SELECT day, ln(fba / lag(fba) OVER (ORDER BY hour)) AS r FROM both_) SELECT day, count(r)::BIGINT AS n, CASE WHEN count(r) >= 5 THEN round(sqrt(avg(r * r)) * 10000, 6) END AS rms FROM r GROUP BY day""")
def matched_volatility(spark, sf):
    return rounded(stats.windowed_rms(series.matched_returns(_pair(spark, sf), "fba", "cda", "hour", ["coin"]), "r_a", ["day"]))


@query(f"""WITH {_PAIR}, s AS (SELECT count(*) AS n, avg(CASE WHEN fba IS NOT NULL THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN cda IS NOT NULL THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN fba IS NOT NULL AND cda IS NOT NULL THEN 1.0 ELSE 0.0 END) AS c FROM pair)
SELECT n::BIGINT AS n, round(a, 6) AS share_a, round(b, 6) AS share_b, round(c, 6) AS share_both, round(a * b, 6) AS share_if_independent FROM s""")
def intersection_diagnostics(spark, sf):
    return rounded(series.intersection(_pair(spark, sf), "fba", "cda"))


_MOVES = ", ".join(f"CASE WHEN lag(f{p}) OVER w > 0 THEN (lead(f{p}, h) OVER w - lag(f{p}) OVER w) / lag(f{p}) OVER w * 10000.0 END AS y{p}" for p in "ab")


@query(f"""WITH {_PAIR}, f AS (SELECT hour, depth::DOUBLE AS x, h, last_value(fba IGNORE NULLS) OVER (PARTITION BY h ORDER BY hour) AS fa, last_value(cda IGNORE NULLS) OVER (PARTITION BY h ORDER BY hour) AS fb FROM pair, (SELECT unnest([0, 5]) AS h)),
m AS (SELECT h, x, {_MOVES} FROM f WINDOW w AS (PARTITION BY h ORDER BY hour))
SELECT h::BIGINT AS horizon, round(sum(x * ya) / sum(x * x), 9) AS slope_a, round(sum(x * yb) / sum(x * x), 9) AS slope_b, round(sum(x * ya) / sum(x * x) - sum(x * yb) / sum(x * x), 9) AS diff FROM m WHERE ya IS NOT NULL AND yb IS NOT NULL GROUP BY h""")
def common_flow(spark, sf):
    # rows in order, as hours may be missing
    p = stats.numbered(_pair(spark, sf), ["coin"], "hour")
    r = series.common_flow_slopes(p, p.select("coin", "i", "x"), "fba", "cda", "i", ["coin"])
    return r.select(F.col("horizon").cast("long").alias("horizon"), *[F.round(c, 9).alias(c) for c in ("slope_a", "slope_b", "diff")])


_HAC = "least(60, floor(4 * pow(n / 100.0, 2.0 / 9)))"


@query(f"""WITH {_PAIR}, l AS (SELECT 'price' AS metric, hour, fba AS a, cda AS b FROM pair UNION ALL SELECT 'spread', hour, eff, rea FROM pair), p AS (SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY hour) AS i, a - b AS d, a, b FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT metric, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(d) AS md FROM p GROUP BY 1),
g AS (SELECT m.metric, l, sum((x.d - md) * (y.d - md)) AS g FROM m, (SELECT unnest(range(0, 61)) AS l) k, p x JOIN p y ON y.metric = x.metric AND y.i = x.i - l WHERE m.metric = x.metric AND l <= {_HAC} GROUP BY ALL), s AS (SELECT metric, sum(CASE WHEN l = 0 THEN g ELSE 2 * (1 - l / ({_HAC} + 1)) * g END) AS s FROM g JOIN m USING (metric) GROUP BY 1)
SELECT metric, n::BIGINT AS n, round(ma, 3) AS mean_a, round(mb, 3) AS mean_b, round(md, 3) AS diff, round(sqrt(s) / n, 3) AS se, round(md / (sqrt(s) / n), 6) AS t FROM m JOIN s USING (metric)""")
def paired_metrics(spark, sf):
    p = _pair(spark, sf)
    side = lambda price, spread: p.select("hour", F.col(price).alias("price"), F.col(spread).alias("spread"))
    wide = stats.paired(side("fba", "eff"), side("cda", "rea"), ["price", "spread"], ["hour"])
    r = stats.paired_table(wide, ["price", "spread"], "hour")
    return r.select("metric", "n", *[F.round(c, 3).alias(c) for c in ("mean_a", "mean_b", "diff", "se")], F.round("t", 6).alias("t"))


@query(f"""WITH {_PAIR}, c AS (SELECT hour, arg_max(limit_px, seq) AS close FROM (SELECT *, ts // {HOUR} AS hour FROM flow) WHERE order_type_id = 0 AND hour % 3 > 0 GROUP BY 1)
SELECT hour, cda AS vwap, close::DOUBLE AS close, cda / close - 1 AS deviation FROM pair JOIN c USING (hour) WHERE cda IS NOT NULL""")
def candle_deviation(spark, sf):
    hour = F.floor(F.col("ts") / HOUR)
    candles = order_flow(spark, sf).where("order_type_id = 0").groupBy(hour.alias("hour")).agg(F.max_by("limit_px", "seq").cast("double").alias("close")).where("hour % 3 > 0")
    return series.candle_deviation(_pair(spark, sf).where("cda is not null"), candles, ["hour"], "cda")


_DAYS = ", days AS (SELECT day FROM pair WHERE fba IS NOT NULL GROUP BY day HAVING count(*) >= 0.7 * 24 INTERSECT SELECT day FROM pair WHERE cda IS NOT NULL GROUP BY day HAVING count(*) >= 0.7 * 24)"


def _days(p):
    return series.complete_days(p.where("fba is not null"), p.where("cda is not null"), expected=24, share=0.7)


@query(f"WITH {_PAIR}{_DAYS} SELECT day, round(avg(eff), 6) AS eff, round(avg(rea), 6) AS rea FROM pair SEMI JOIN days USING (day) GROUP BY day")
def complete_day_means(spark, sf):
    p = _pair(spark, sf)
    return rounded(series.daily_means(p, _days(p), ["eff", "rea"]))


@query(f"""WITH {_PAIR}{_DAYS}, m AS (SELECT day, avg(rv) AS mean FROM pair SEMI JOIN days USING (day) GROUP BY day ORDER BY mean DESC, day LIMIT 1) SELECT day, round(mean, 6) AS mean, hour, round(fba, 6) AS fba, round(cda, 6) AS cda FROM pair JOIN m USING (day)""")
def busiest_day_prices(spark, sf):
    p = _pair(spark, sf)
    return rounded(p.join(F.broadcast(series.busiest_day(p, _days(p), "rv")), "day").select("day", "mean", "hour", "fba", "cda"))


@query(f"WITH {_PAIR} SELECT round(avg(eff), 6) AS effective, round(avg(rea), 6) AS realized, round(avg(eff - rea), 6) AS impact, round(avg(depth), 6) AS depth FROM pair")
def decomposition_means(spark, sf):
    return rounded(_pair(spark, sf).agg(F.avg("eff").alias("effective"), F.avg("rea").alias("realized"), F.avg(F.col("eff") - F.col("rea")).alias("impact"), F.avg("depth").alias("depth")))


@query(f"WITH {_PAIR} SELECT hour, round(avg(residual) OVER (ORDER BY hour RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), 9) AS rolling FROM pair")
def residual_rolling(spark, sf):
    return rounded(series.rolling_mean(_pair(spark, sf), "residual", "hour", ["coin"], 6, 100).select("hour", "rolling"), 9)


@query(f"WITH {_PAIR} SELECT least(floor(residual * 40), 39)::BIGINT AS bin, round(count(*) / (SELECT count(*) FROM pair WHERE residual BETWEEN 0 AND 1), 9) AS share FROM pair WHERE residual BETWEEN 0 AND 1 GROUP BY 1")
def residual_histogram(spark, sf):
    return rounded(series.share_histogram(_pair(spark, sf), F.col("residual"), 0.0, 1.0, 40), 9)


@query(f"""WITH {_PAIR}, e AS (SELECT quantile_cont(rv, 0.99) AS edge FROM pair) SELECT (CASE WHEN rv = 0 THEN -1 ELSE least(floor(rv / edge * 30), 29) END)::BIGINT AS bin, count(*)::BIGINT AS n FROM pair, e WHERE rv <= edge GROUP BY 1""")
def dispersion_histogram(spark, sf):
    return rounded(series.clipped_histogram(_pair(spark, sf), "rv", 0.99, 30))


@query(f"WITH {_PAIR} SELECT round(quantile_cont(depth, 0.99), 6) AS p99, round(quantile_cont(cda - fba, 0.05), 6) AS low, round(median(cda - fba), 6) AS middle, round(stddev_samp(cda - fba), 6) AS std FROM pair")
def difference_quantiles(spark, sf):
    d = F.col("cda") - F.col("fba")
    return rounded(_pair(spark, sf).agg(F.percentile("depth", F.lit(0.99)).alias("p99"), F.percentile(d, F.lit(0.05)).alias("low"), F.median(d).alias("middle"), F.stddev_samp(d).alias("std")))


@query(f"WITH {_PAIR} SELECT hour // 24 AS period, round(avg(depth), 6) AS mean, round(median(depth), 6) AS median FROM pair GROUP BY 1")
def daily_depth(spark, sf):
    return rounded(series.resampled(_pair(spark, sf), [], "hour", 24, "depth"))


@query(f"WITH {FLOW_SQL}, o AS (SELECT ts // {HOUR} AS h, count(DISTINCT limit_px) AS k FROM flow GROUP BY 1) SELECT count(*)::BIGINT AS buckets, count_if(k > 1)::BIGINT AS several, max(k)::BIGINT AS most FROM o")
def bucket_prices(spark, sf):
    d = order_flow(spark, sf).withColumn("hour", F.floor(F.col("ts") / HOUR))
    return series.bucket_prices(d, ["coin"], "limit_px", "hour").drop("coin")


@query(f"""{TAPE} SELECT ts, 0::BIGINT AS kind, seq AS ord, (best_bid + best_ask) / 2.0 AS p FROM books WHERE best_bid IS NOT NULL UNION ALL SELECT ts, 1, batch, clearing_price::DOUBLE FROM batches WHERE clearing_price IS NOT NULL""")
def price_union(spark, sf):
    return rounded(series.price_union(tape(spark, sf, BOOKS_SQL), tape(spark, sf, BATCHES_SQL)).drop("coin"))


# files and records

_FILED = FLOW_SQL + ", filed AS (SELECT *, 'f' || (seq // 500) AS file, seq % 1000 AS td, (ts // 3600000000000 + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) * 3600000000000 AS h0, CASE WHEN seq % 90 = 0 THEN 2 ELSE seq % 2 END AS flag FROM flow)"


def _filed(spark, sf):
    q = F.col("seq")
    return order_flow(spark, sf).withColumns({
        "file": F.concat(F.lit("f"), F.floor(q / 500).cast("string")), "timestamp_diff": q % 1000,
        "h0": (F.floor(F.col("ts") / HOUR) + F.when(q % 50 == 0, 1).otherwise(0)) * HOUR, "flag": F.when(q % 90 == 0, 2).otherwise(q % 2),
    })


_KEYS = ["status_id", "is_ask", "limit_px", "orig_sz"]


@query(f"WITH {_FILED}, g AS (SELECT file, status_id, is_ask, limit_px, orig_sz, count(*) AS n FROM filed GROUP BY ALL) SELECT status_id::BIGINT AS status_id, sum(n)::BIGINT AS records, sum(n - 1)::BIGINT AS repeats FROM g GROUP BY 1")
def repeats_by_status(spark, sf):
    return rounded(audit.repeats_by_status(_filed(spark, sf), _KEYS))


@query(f"WITH {_FILED}, g AS (SELECT file, status_id, count(*) AS n, max(CASE WHEN status_id = 1 THEN 1 ELSE 0 END) AS l FROM filed GROUP BY file, status_id, is_ask, limit_px, orig_sz), f AS (SELECT file, sum(n)::BIGINT AS records, sum(n - 1)::BIGINT AS repeats, sum((n - 1) * l)::BIGINT AS live_repeats FROM g GROUP BY 1) SELECT * FROM f WHERE repeats > 0 ORDER BY repeats DESC, file LIMIT 10")
def worst_files(spark, sf):
    return audit.worst_files(audit.duplicates(_filed(spark, sf), _KEYS, "file"))


@query(f"""WITH {_FILED}, s AS (SELECT oid % 2000 AS oid, ts - td * 1000000 AS sent FROM filed), o AS (SELECT max(sent) - min(sent) AS d FROM s GROUP BY oid HAVING count(*) > 1)
SELECT count(*)::BIGINT AS orders, count_if(d > 2000000)::BIGINT AS over_2ms, count_if(d > 1000000000)::BIGINT AS over_1s, max(d)::BIGINT AS widest FROM o""")
def submission_spread(spark, sf):
    return audit.submission_spread(_filed(spark, sf).withColumn("oid", F.col("oid") % 2000))


@query(f"WITH {_FILED} SELECT file, count(*)::BIGINT AS records, count_if(flag NOT IN (0, 1))::BIGINT AS bad_booleans, count_if(ts < h0 OR ts >= h0 + 3600000000000)::BIGINT AS outside_hour FROM filed GROUP BY file")
def record_faults(spark, sf):
    return audit.record_faults(_filed(spark, sf), ["flag"], "h0")


@query(f"WITH {_SIZED}, c AS (SELECT status_id, was - sz AS cut FROM l WHERE NOT first AND status_id <> 5 AND was > sz) SELECT status_id::BIGINT AS status_id, count(*)::BIGINT AS events, sum(cut)::BIGINT AS reduced FROM c GROUP BY 1")
def size_reductions(spark, sf):
    return rounded(audit.size_reductions(_sized(spark, sf)))


@query(f"""WITH {_SERIES}, w AS (SELECT hour AS minute, q AS depth, CASE WHEN count(q) OVER w >= 5 THEN avg(q) OVER w END AS before FROM series WINDOW w AS (ORDER BY hour ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
r AS (SELECT * FROM w WHERE minute % 60 = 0 AND depth < 0.9 * before), j AS (SELECT r.minute, r.before, d.minute - r.minute AS k, d.depth FROM r JOIN w d ON d.minute BETWEEN r.minute + 1 AND r.minute + 60)
SELECT minute, min(k) FILTER (depth >= 0.9 * before)::BIGINT AS recovered_after, max(depth) FILTER (k = 60)::BIGINT AS depth_later FROM j GROUP BY minute""")
def depth_recoveries(spark, sf):
    d = _series(spark, sf).select("coin", F.col("hour").alias("minute"), F.col("q").alias("depth"))
    return rounded(audit.recoveries(audit.resets(d, drop=0.9), d).drop("coin"))


@query(f"""WITH {_SERIES}, t AS (SELECT sum(coalesce(a, 0)) AS s, sum(coalesce(b, 0)) AS v, sum(coalesce(a, 0) // 3) AS p FROM series)
SELECT s::BIGINT AS sim, v::BIGINT AS venue, p::BIGINT AS post_only, round(s / v, 9) AS ratio, round(p / s, 9) AS post_only_share, round((s - p) / v, 9) AS ratio_without_post_only FROM t""")
def replay_ratios(spark, sf):
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return rounded(audit.replay_ratios(_series(spark, sf).select(a.alias("sim"), b.alias("venue"), F.floor(a / 3).alias("post_only"))), 9)


@query(f"WITH {_FILED}, f AS (SELECT DISTINCT file AS path FROM filed) SELECT path FROM f ORDER BY md5('7' || path), path LIMIT 5")
def sampled_files(spark, sf):
    return audit.sampled_files(_filed(spark, sf).select(F.col("file").alias("path")).distinct(), 5, "7")


@query(f"""WITH {_SERIES}, x AS (SELECT hour, q FROM series), y AS (SELECT hour, CASE WHEN hour % 7 = 0 THEN q + 1 ELSE q END AS q FROM series WHERE hour % 11 <> 0)
SELECT hour, x.q::BIGINT AS a, y.q::BIGINT AS b FROM x FULL JOIN y USING (hour) WHERE x.q IS DISTINCT FROM y.q ORDER BY hour LIMIT 3""")
def first_mismatches(spark, sf):
    s = _series(spark, sf).select("hour", "q")
    return rounded(audit.mismatches(s, s.where("hour % 11 <> 0").withColumn("q", F.when(F.col("hour") % 7 == 0, F.col("q") + 1).otherwise(F.col("q"))), ["hour"], "q"))


_WORDS = ("seq", "ts", "limit_px", "orig_sz", "oid", "status_id", "order_type_id")
_HASH = "0::HUGEINT"
for _w in _WORDS:
    _HASH = f"(({_HASH}) * 1000003 + {_w}) % 18446744073709551616::HUGEINT"


@query(f"""WITH {FLOW_SQL} SELECT seq, ({_HASH})::VARCHAR AS hash, CASE WHEN seq % 100 > 0 THEN ', ETA ' || (seq * (100 - seq % 100) // (seq % 100) // 60 % 60) ELSE '' END AS eta
FROM flow WHERE seq * (100 - seq % 100) // greatest(seq % 100, 1) BETWEEN 60 AND 3599 OR seq % 100 = 0""")
def record_hashes(spark, sf):
    d, done = order_flow(spark, sf), F.col("seq") % 100
    left = F.floor(F.col("seq") * (100 - done) / F.greatest(done, F.lit(1)))
    d = d.where(left.between(60, 3599) | (done == 0))
    # up to the minutes
    return d.select("seq", S.record_hash([F.col(w) for w in _WORDS]).cast("string").alias("hash"), F.regexp_replace(S.eta_suffix(done, F.lit(100), F.col("seq")), "m .*", "").alias("eta"))
