"""Registered queries: each applies an operator to the driver's tables, with SQL for DuckDB beside it.

Where an operator takes trades, books or batches, a fixed integer rule over the
order flow (TAPE) supplies them, so that each operator is held against SQL
without the engines; the engines have queries of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import scalars as S
from ..operators import auction, audit, metrics, ordered, stats
from ..operators import replay as R
from ..sources.flow import FLOW_SQL, order_flow
from ..tables import written

W = 21_600 * 10**9
HOUR = 3_600 * 10**9
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# TAPE: the same text for both engines, over flow
MESSAGES_SQL = """SELECT seq, ts, oid, user_id, is_ask, CASE WHEN order_type_id NOT IN (1, 2, 3, 6) THEN limit_px END AS limit_price,
  orig_sz AS quantity, (status_id = 1 OR status_id = 9) AS accepted FROM {flow} WHERE orig_sz > 0"""
TRADES_SQL = """SELECT 'cda' AS engine, seq AS trade_id, seq, limit_px AS price, orig_sz AS quantity, oid AS buy_order_id, oid - 1 - seq % 5 AS sell_order_id,
  ts + (seq % 7) * 1000000000 AS ts, 100000000 + (seq % 5 - 2) * 10000 AS reference_price, seq % 2 = 0 AS aggressor_is_ask
  FROM {flow} WHERE status_id = 1"""
BOOKS_SQL = """SELECT seq, ts, CASE WHEN seq % 17 <> 0 THEN limit_px - 20000 END AS best_bid, limit_px + 10000 * (1 + seq % 3) AS best_ask,
  orig_sz AS best_bid_qty, orig_sz % 7 AS best_ask_qty, orig_sz * 40 AS bid_depth, orig_sz * 30 AS ask_depth, orig_sz AS b10, orig_sz * 2 AS a10,
  orig_sz * 3 AS b50, orig_sz * 4 AS a50, orig_sz * 5 AS b100, orig_sz * 6 AS a100, 1000 AS compute_ns FROM {flow}"""
BATCHES_SQL = """SELECT seq AS batch, ts, ts - 3600000000000 * (1 + seq % 3) AS batch_open_ts, CASE WHEN seq % 200 <> 0 THEN limit_px END AS clearing_price,
  orig_sz * 3 AS demand_at_price, orig_sz + 20 AS supply_at_price, orig_sz - 9 AS net_order_flow, abs(orig_sz * 3 - orig_sz - 20) AS unexecuted_quantity,
  CASE WHEN seq % 3 <> 0 THEN limit_px - 20000 END AS best_unfilled_buy, limit_px + 20000 AS best_unfilled_sell, orig_sz AS b10, orig_sz * 2 AS a10,
  orig_sz * 3 AS b50, orig_sz * 4 AS a50, orig_sz * 5 AS b100, orig_sz * 6 AS a100, 1000 AS compute_ns FROM {flow}"""
TAPE = "WITH " + FLOW_SQL + ",\n" + ",\n".join(f"{n} AS ({q.format(flow='flow')})" for n, q in (("messages", MESSAGES_SQL), ("trades", TRADES_SQL), ("books", BOOKS_SQL), ("batches", BATCHES_SQL)))
TAPE += ",\nanchor AS (SELECT min(ts) AS a, max(ts) AS z FROM messages)"


def tape(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("{flow}", "{d}"), d=order_flow(spark, sf_dir)).withColumn("coin", F.lit("EV"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(d: DataFrame, digits: int = 6) -> DataFrame:
    return d.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "decimal(38,0)") else F.col(c) for c, t in d.dtypes])


# scans, classes, audits


@query(f"""WITH {FLOW_SQL} SELECT CASE WHEN status_id IN (1, 9) THEN 'new_live' WHEN status_id IN (2, 7, 10, 11, 12, 13, 14, 16) THEN 'cancel' ELSE 'other' END AS class,
  count(*)::BIGINT AS records FROM flow GROUP BY 1""")
def scan_classes(spark, sf):
    return audit.scan_counts(order_flow(spark, sf))


@query(f"WITH {FLOW_SQL} SELECT count(*)::BIGINT AS records, count(DISTINCT user_id)::BIGINT AS participants, count(DISTINCT oid)::BIGINT AS orders, min(ts) AS first_ts, max(ts) AS last_ts FROM flow")
def dataset_stats(spark, sf):
    return audit.dataset_stats(order_flow(spark, sf))


_LABELS = [("status", "open", 1), ("status", "canceled", 2), ("status", "filled", 5), ("order_type", "Limit", 0), ("order_type", "Market", 1)]


@query(f"""WITH {FLOW_SQL}, x AS (SELECT 'status' AS kind, status_id AS code FROM flow UNION ALL SELECT 'order_type', order_type_id FROM flow)
SELECT kind, code::BIGINT AS code, count(*)::BIGINT AS records, max(CASE kind || code WHEN 'status1' THEN 'open' WHEN 'status2' THEN 'canceled' WHEN 'status5' THEN 'filled' WHEN 'order_type0' THEN 'Limit' WHEN 'order_type1' THEN 'Market' END) AS label
FROM x GROUP BY 1, 2""")
def code_labels(spark, sf):
    return rounded(audit.with_labels(audit.code_histogram(order_flow(spark, sf)), spark.createDataFrame(_LABELS, "kind string, label string, id int")))


@query(f"""WITH {FLOW_SQL}, g AS (SELECT ts - lag(ts) OVER (ORDER BY seq) AS gap, row_number() OVER (ORDER BY seq) - 1 AS i FROM flow), s AS (SELECT gap FROM g WHERE i > 0 AND i % 200 = 1)
SELECT count(*)::BIGINT AS n, round(avg(gap), 3) AS mean, round(quantile_cont(gap, 0.5), 3) AS median, round(quantile_cont(gap, 0.9), 3) AS p90, round(quantile_cont(gap, 0.99), 3) AS p99,
  round(avg(CASE WHEN gap = 0 THEN 1.0 ELSE 0.0 END), 3) AS zero_share FROM s""")
def interarrival(spark, sf):
    return rounded(audit.interarrival(order_flow(spark, sf), ["coin"]), 3)


@query(f"""WITH {FLOW_SQL}, g AS (SELECT status_id, is_ask, limit_px, orig_sz, count(*) AS n, max(CASE WHEN status_id = 1 THEN 1 ELSE 0 END) AS l FROM flow GROUP BY ALL)
SELECT 'EV' AS coin, sum(n)::BIGINT AS records, sum(n - 1)::BIGINT AS repeats, sum((n - 1) * l)::BIGINT AS live_repeats FROM g""")
def duplicate_records(spark, sf):
    return audit.duplicates(order_flow(spark, sf), ["status_id", "is_ask", "limit_px", "orig_sz"])


@query(f"""WITH {FLOW_SQL}, g AS (SELECT *, ts - lag(ts) OVER (ORDER BY seq) AS d FROM flow)
SELECT 'EV' AS coin, count(*)::BIGINT AS records, count_if(status_id > 17)::BIGINT AS unknown_status, count_if(order_type_id > 6)::BIGINT AS unknown_type, count_if(d < 0)::BIGINT AS backward_steps,
  count_if(d > 60000000000)::BIGINT AS long_gaps, max(d)::BIGINT AS longest_gap, count_if(orig_sz = 0)::BIGINT AS size_zero FROM g""")
def file_audit(spark, sf):
    return audit.file_audit(order_flow(spark, sf))


def _sized(spark, sf):
    return order_flow(spark, sf).withColumn("sz", F.when(F.col("status_id") == 1, F.col("orig_sz")).otherwise(F.col("orig_sz") % 5)).withColumn("timestamp_diff", F.col("seq") % 2).withColumn("oid", F.col("oid") % 2000)


_SIZED = FLOW_SQL + """, s AS (SELECT * REPLACE (oid % 2000 AS oid), CASE WHEN status_id = 1 THEN orig_sz ELSE orig_sz % 5 END AS sz, seq % 2 AS td FROM flow),
l AS (SELECT *, row_number() OVER w = 1 AS first, coalesce(lag(sz) OVER w, orig_sz) AS was, coalesce(lag(status_id = 2 OR (status_id = 5 AND sz = 0)) OVER w, false) AS ended FROM s WINDOW w AS (PARTITION BY oid ORDER BY seq))"""


@query(f"""WITH {_SIZED} SELECT count_if(first)::BIGINT AS orders, count_if(first AND status_id = 1)::BIGINT AS first_is_open, count_if(first AND status_id <> 1)::BIGINT AS first_is_other,
  count_if(NOT first AND sz > was)::BIGINT AS size_increases, count_if(ended)::BIGINT AS after_the_end, count_if(status_id = 1 AND NOT first)::BIGINT AS reopened FROM l""")
def lifecycle_audit(spark, sf):
    return audit.lifecycle_audit(_sized(spark, sf))


@query(f"""WITH {_SIZED} SELECT ts // 1000000000 AS sec, sum(CASE WHEN NOT is_ask THEN was - sz ELSE 0 END)::BIGINT AS buy, sum(CASE WHEN is_ask THEN was - sz ELSE 0 END)::BIGINT AS sell, count(*)::BIGINT AS events,
  sum(CASE WHEN NOT is_ask AND td = 0 THEN was - sz ELSE 0 END)::BIGINT AS taker_buy, sum(CASE WHEN is_ask AND td = 0 THEN was - sz ELSE 0 END)::BIGINT AS taker_sell FROM l WHERE status_id = 5 AND was > sz GROUP BY 1""")
def venue_fills(spark, sf):
    return audit.venue_fills(_sized(spark, sf))


@query(f"""WITH {FLOW_SQL} SELECT seq, CASE WHEN is_ask THEN 'sell' ELSE 'buy' END AS side, order_type_id IN (1, 2, 3, 6) AS market, CASE WHEN order_type_id NOT IN (1, 2, 3, 6) THEN limit_px END AS limit_price,
  status_id IN (1, 9) AS live, status_id IN (2, 7, 10, 11, 12, 13, 14, 16) AS cancel, order_type_id IN (1, 2, 3, 6) OR CASE WHEN is_ask THEN limit_px <= 100000000 ELSE limit_px >= 100000000 END AS able FROM flow WHERE orig_sz > 0""")
def order_flags(spark, sf):
    d = order_flow(spark, sf).where(classify.has_size())
    return d.select("seq", classify.side().alias("side"), classify.is_market().alias("market"), classify.limit_price().alias("limit_price"), classify.is_new_live().alias("live"), classify.is_cancellation().alias("cancel"), classify.eligible_at(F.lit(100_000_000)).alias("able"))


# scalar functions

_PACKED = "(event_id * 2654435761 + user_id * 40503) % 4294967296"


@query(f"""WITH p AS (SELECT event_id, {_PACKED} AS p FROM events), u AS (SELECT event_id, p >> 29 AS d, p & 536870911 AS v, p & 268435455 AS w, (p & 268435456) <> 0 AS neg FROM p),
x AS (SELECT event_id, neg, CASE WHEN d = 7 THEN (v + 5) // 10 ELSE v * CAST(10 ** (6 - d) AS BIGINT) END AS price, CASE WHEN d = 7 THEN (w + 5) // 10 ELSE w * CAST(10 ** (6 - d) AS BIGINT) END AS s FROM u)
SELECT event_id, price::BIGINT AS price, CASE WHEN neg THEN -s ELSE s END::BIGINT AS signed, ((price + 500000) // 1000000)::BIGINT AS quantity FROM x""")
def packed_numbers(spark, sf):
    p = F.expr(_PACKED)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.decode_price(p).alias("price"), S.decode_signed_price(p).alias("signed"), S.decode_quantity(p).alias("quantity"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 90)::VARCHAR WHEN 1 THEN (event_id % 90) || '.' || (user_id % 1000) WHEN 2 THEN '-' || event_id WHEN 3 THEN (user_id % 7) || '.12345678' ELSE '.5' END AS s,
  strftime(epoch_ms(epoch_us(ts) // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad((event_id % 1000)::VARCHAR, 3, '0') AS c, CASE event_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' ELSE 'yes' END AS b, epoch_us(ts) // 1000000 AS secs FROM events),
p AS (SELECT *, regexp_full_match(s, '[0-9]+(\\.[0-9]*)?') AS ok, split_part(s, '.', 1) AS w, split_part(s, '.', 2) AS f FROM t)
SELECT event_id, CASE WHEN ok THEN w::BIGINT * 1000000 + rpad(f[1:6], 6, '0')::BIGINT END AS fixed, CASE WHEN ok THEN w::BIGINT + CASE WHEN f[1:1] >= '5' THEN 1 ELSE 0 END END AS units,
  secs * 1000000000 + (event_id % 1000) * 1000000 AS ns, CASE b WHEN 'True' THEN true WHEN 'false' THEN false END AS flag FROM p""")
def parsed_text(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    text = F.when(i % 5 == 0, (i % 90).cast("string")).when(i % 5 == 1, F.concat((i % 90).cast("string"), F.lit("."), (u % 1000).cast("string"))).when(i % 5 == 2, F.concat(F.lit("-"), i.cast("string")))
    text = text.when(i % 5 == 3, F.concat((u % 7).cast("string"), F.lit(".12345678"))).otherwise(".5")
    clock = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad((i % 1000).cast("string"), 3, "0"))
    flag = F.when(i % 3 == 0, "True").when(i % 3 == 1, "false").otherwise("yes")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.parse_fixed_point(text).alias("fixed"), S.round_to_unit(text).alias("units"), S.parse_timestamp(clock).alias("ns"), S.parse_bool(flag).alias("flag"))


@query(f"""WITH {FLOW_SQL} SELECT seq, limit_px // 1000000 || '.' || lpad((limit_px % 1000000)::VARCHAR, 6, '0') AS price,
  CASE WHEN seq // 3600 > 0 THEN format('{{}}h {{:02d}}m {{:02d}}s', seq // 3600, seq % 3600 // 60, seq % 60) WHEN seq // 60 > 0 THEN format('{{}}m {{:02d}}s', seq // 60, seq % 60) ELSE seq || 's' END AS duration,
  'a_b-' || seq || '.x' AS slug, coalesce(nullif(trim(CASE WHEN seq % 2 = 0 THEN ' ' ELSE user_id END), ''), '-') AS who, date '1970-01-01' + (seq % 20000)::INT AS day, (seq % 20000)::BIGINT AS days,
  (CASE WHEN seq % 2 = 0 THEN 100000000 ELSE 99000000 END + abs(limit_px - 100000000) * 10000 // 100000000)::BIGINT AS mid_and_band FROM flow""")
def formatted_text(spark, sf):
    q = F.col("seq")
    mid = S.midpoint(F.when(q % 2 == 0, F.lit(99_999_999)).otherwise(F.lit(99_000_000)), F.when(q % 2 == 0, F.lit(100_000_002)))
    return order_flow(spark, sf).select(
        "seq", S.format_price(F.col("limit_px")).alias("price"), S.format_duration(q).alias("duration"), S.slugify(F.concat(F.lit("/data/a b-"), q.cast("string"), F.lit(".x/"))).alias("slug"),
        F.coalesce(S.non_empty(F.when(q % 2 == 0, " ").otherwise(F.col("user_id"))), F.lit("-")).alias("who"), S.civil_from_days(q % 20_000).alias("day"),
        S.days_from_civil(S.civil_from_days(q % 20_000)).cast("long").alias("days"), (mid + S.depth_band(F.col("limit_px"), F.lit(100_000_000))).alias("mid_and_band"),
    )


# clocks, grids, as-of and range joins


@query(f"""WITH {FLOW_SQL}, s AS (SELECT seq, ts - (seq % 4) * 3600000000000 AS ts FROM flow), c AS (SELECT seq, ts, max(ts) OVER (ORDER BY seq) AS clock, first_value(ts) OVER (ORDER BY seq) AS t0 FROM s)
SELECT seq, ts, clock, (clock - t0) // {W} AS batch FROM c""")
def batch_clock(spark, sf):
    d = order_flow(spark, sf).withColumn("ts", F.col("ts") - F.col("seq") % 4 * HOUR).select("coin", "seq", "ts")
    return ordered.batch_index(d, W).select("seq", "ts", "clock", "batch")


@query(f"""{TAPE}, g AS (SELECT unnest(range(a, z + 1, {HOUR})) AS bucket FROM anchor), m AS (SELECT a + (ts - a) // {HOUR} * {HOUR} AS bucket, count(*) AS n FROM messages, anchor GROUP BY 1)
SELECT bucket, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN m USING (bucket)""")
def dense_grid_counts(spark, sf):
    m = tape(spark, sf, MESSAGES_SQL)
    limits = metrics.bounds(m)
    return ordered.dense_grid(limits, HOUR).join(metrics.message_counts(m, limits, HOUR), ["coin", "bucket"], "left").select("bucket", F.coalesce("_messages", F.lit(0)).alias("n"))


@query(f"""WITH {FLOW_SQL}, p AS (SELECT seq, ts + 1800000000000 AS t FROM flow WHERE order_type_id = 1 AND status_id = 1), q AS (SELECT ts, arg_min(limit_px, seq) AS px FROM flow WHERE order_type_id = 0 AND status_id = 1 GROUP BY ts)
SELECT p.seq, p.t AS target, q.px AS later FROM p ASOF LEFT JOIN q ON p.t <= q.ts""")
def asof_markout(spark, sf):
    f = order_flow(spark, sf).where("status_id = 1")
    p = f.where("order_type_id = 1").select("seq", (F.col("ts") + HOUR // 2).alias("target"))
    return ordered.asof_forward(p, f.where("order_type_id = 0"), "target", "ts", "seq", "limit_px", "later")


@query(f"{TAPE} SELECT batch, (SELECT count(*) FROM messages m WHERE m.ts BETWEEN b.batch_open_ts AND b.ts)::BIGINT AS n FROM batches b")
def range_counts(spark, sf):
    return ordered.in_windows(tape(spark, sf, BATCHES_SQL), tape(spark, sf, MESSAGES_SQL), "batch_open_ts", "ts", "ts", "n", ["coin"], HOUR).select("batch", "n")


# the auction of one batch, set-based


def _orders(spark, sf):
    d = ordered.batch_index(order_flow(spark, sf), W).where(classify.is_new_live() & classify.has_size())
    return d.select("batch", "oid", "ts", "is_ask", classify.limit_price().alias("limit"), F.col("orig_sz").alias("quantity"))


_ORDERS = f"""WITH {FLOW_SQL}, o AS (SELECT (ts - (SELECT min(ts) FROM flow)) // {W} AS batch, oid, ts, is_ask, CASE WHEN order_type_id = 0 THEN limit_px END AS lim, orig_sz AS q FROM flow WHERE status_id = 1),
sched AS (SELECT p.batch, p.price, coalesce(sum(q) FILTER (NOT is_ask AND (lim IS NULL OR lim >= price)), 0)::BIGINT AS demand, coalesce(sum(q) FILTER (is_ask AND (lim IS NULL OR lim <= price)), 0)::BIGINT AS supply
  FROM (SELECT DISTINCT batch, lim AS price FROM o WHERE lim IS NOT NULL) p JOIN o USING (batch) GROUP BY ALL),
best AS (SELECT *, least(demand, supply) AS volume, abs(demand - supply) AS imbalance FROM sched QUALIFY row_number() OVER (PARTITION BY batch ORDER BY least(demand, supply) DESC, abs(demand - supply), price) = 1),
able AS (SELECT o.*, price, volume, sum(q) OVER (PARTITION BY batch, is_ask ORDER BY lim IS NOT NULL, CASE WHEN is_ask THEN lim ELSE -lim END, ts, oid ROWS UNBOUNDED PRECEDING)::BIGINT AS hi
  FROM o JOIN best USING (batch) WHERE lim IS NULL OR CASE WHEN is_ask THEN lim <= price ELSE lim >= price END),
filled AS (SELECT *, hi - q AS lo, greatest(0, least(q, volume - (hi - q)))::BIGINT AS fill FROM able)
"""


@query(_ORDERS + "SELECT * FROM sched")
def auction_schedule(spark, sf):
    return auction.schedule(_orders(spark, sf))


@query(_ORDERS + "SELECT batch, price, demand, supply, volume, imbalance FROM best")
def auction_clearing(spark, sf):
    return auction.clearing(auction.schedule(_orders(spark, sf)))


def _filled(spark, sf):
    o = _orders(spark, sf)
    return auction.fills(o, auction.clearing(auction.schedule(o)))


@query(_ORDERS + "SELECT batch, oid, is_ask, lo, hi, fill FROM filled")
def auction_fills(spark, sf):
    return _filled(spark, sf).select("batch", "oid", "is_ask", "lo", "hi", "fill")


@query(_ORDERS + """SELECT b.batch, b.price, (least(b.lo + b.fill, s.lo + s.fill) - greatest(b.lo, s.lo))::BIGINT AS quantity, b.oid AS buy_oid, s.oid AS sell_oid, greatest(b.lo, s.lo)::BIGINT AS at
FROM filled b JOIN filled s ON b.batch = s.batch AND NOT b.is_ask AND s.is_ask AND b.fill > 0 AND s.fill > 0 AND b.lo < s.lo + s.fill AND s.lo < b.lo + b.fill""")
def auction_trades(spark, sf):
    return auction.trades(_filled(spark, sf))


@query(_ORDERS + """SELECT batch, coalesce(sum((lim - price) * fill) FILTER (NOT is_ask AND lim IS NOT NULL), 0)::BIGINT AS buyers, coalesce(sum((price - lim) * fill) FILTER (is_ask AND lim IS NOT NULL), 0)::BIGINT AS sellers FROM filled GROUP BY batch""")
def auction_surplus(spark, sf):
    return auction.surplus(_filled(spark, sf))


# the engines

_FBA = f"""WITH RECURSIVE {FLOW_SQL}, t0 AS (SELECT min(ts) AS t FROM flow), ev AS (SELECT flow.*, (ts - t) // {W} AS k, status_id = 1 AS live, status_id = 2 AS gone FROM flow, t0),
last_k AS (SELECT max(k) AS m FROM ev),
step AS (
  SELECT -1::BIGINT AS k, 1 AS kind, NULL::BIGINT AS oid, NULL::BIGINT AS seq, NULL::BIGINT AS ts, NULL::BOOLEAN AS is_ask, NULL::BIGINT AS px, 0::BIGINT AS rem, 0::BIGINT AS fill, NULL::BIGINT AS p, NULL::BIGINT AS d, NULL::BIGINT AS s, NULL::BIGINT AS lastp
  UNION ALL
  (WITH nx AS (SELECT max(k) + 1 AS k, max(lastp) AS lastp FROM step WHERE kind = 1 HAVING max(k) < (SELECT m FROM last_k)),
  cancels AS (SELECT oid, max(seq) AS cs FROM ev JOIN nx USING (k) WHERE gone GROUP BY oid),
  pool AS (
    SELECT w.oid, w.seq, w.ts, w.is_ask, w.px, w.rem - w.fill AS rem FROM step w, nx WHERE w.kind = 0 AND w.rem > w.fill AND w.oid NOT IN (SELECT oid FROM cancels)
    UNION ALL SELECT e.oid, e.seq, e.ts, e.is_ask, CASE WHEN e.order_type_id = 0 THEN e.limit_px END, e.orig_sz FROM ev e JOIN nx USING (k) LEFT JOIN cancels c ON c.oid = e.oid WHERE e.live AND (c.cs IS NULL OR c.cs < e.seq)),
  ds AS (SELECT c.px AS p, coalesce(sum(rem) FILTER (NOT o.is_ask AND (o.px IS NULL OR o.px >= c.px)), 0)::BIGINT AS d, coalesce(sum(rem) FILTER (o.is_ask AND (o.px IS NULL OR o.px <= c.px)), 0)::BIGINT AS s
    FROM (SELECT DISTINCT px FROM pool WHERE px IS NOT NULL) c, pool o GROUP BY c.px),
  best AS (SELECT p, d, s FROM ds, nx ORDER BY least(d, s) DESC, abs(d - s), coalesce(abs(p - lastp), 0), p LIMIT 1),
  alloc AS (SELECT pool.*, best.p, best.d, best.s, CASE WHEN best.p IS NOT NULL AND (px IS NULL OR CASE WHEN is_ask THEN px <= p ELSE px >= p END) THEN 1 ELSE 0 END AS able FROM pool LEFT JOIN best ON true),
  cum AS (SELECT *, sum(rem * able) OVER (PARTITION BY is_ask ORDER BY able DESC, px IS NOT NULL, CASE WHEN is_ask THEN px ELSE -px END, ts, oid ROWS UNBOUNDED PRECEDING) AS c FROM alloc)
  SELECT nx.k::BIGINT, 0, cum.oid::BIGINT, cum.seq::BIGINT, cum.ts::BIGINT, cum.is_ask, cum.px::BIGINT, cum.rem::BIGINT, (CASE WHEN able = 1 THEN greatest(0, least(rem, least(d, s) - (c - rem))) ELSE 0 END)::BIGINT, p::BIGINT, d::BIGINT, s::BIGINT, NULL::BIGINT FROM cum, nx
  UNION ALL SELECT nx.k::BIGINT, 1, NULL, NULL, NULL, NULL, NULL, 0, 0, NULL, NULL, NULL, (SELECT coalesce(max(CASE WHEN least(d, s) > 0 THEN p END), (SELECT lastp FROM nx)) FROM (SELECT p, d, s FROM best UNION ALL SELECT NULL, NULL, NULL))::BIGINT FROM nx))
"""


@query(_FBA + "SELECT k AS batch, max(p) AS clearing_price, coalesce(max(d), 0)::BIGINT AS demand_at_price, coalesce(max(s), 0)::BIGINT AS supply_at_price, (sum(fill) FILTER (NOT is_ask))::BIGINT AS traded_quantity, count(*)::BIGINT AS pool_orders, sum(CASE WHEN is_ask THEN -rem ELSE rem END)::BIGINT AS net_order_flow FROM step JOIN step x USING (k) WHERE step.kind = 0 AND x.kind = 1 GROUP BY k".replace("FROM step JOIN step x USING (k) WHERE step.kind = 0 AND x.kind = 1", "FROM step WHERE kind = 0"))
def fba_replay(spark, sf):
    b = R.of_kind(R.replay(order_flow(spark, sf), W, ("fba",)), "batch")
    return b.select("batch", "clearing_price", "demand_at_price", "supply_at_price", "traded_quantity", "pool_orders", "net_order_flow")


@query(_FBA + "SELECT is_ask, oid, sum(fill)::BIGINT AS filled FROM step WHERE kind = 0 AND fill > 0 GROUP BY 1, 2")
def fba_fills(spark, sf):
    t = R.of_kind(R.replay(order_flow(spark, sf), W, ("fba",)), "trade")
    side = lambda c, a: t.select(F.lit(a).alias("is_ask"), F.col(c).alias("oid"), "quantity")
    return side("buy_order_id", False).unionByName(side("sell_order_id", True)).groupBy("is_ask", "oid").agg(F.sum("quantity").alias("filled"))


_CDA = f"""WITH RECURSIVE {FLOW_SQL}, ev AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, oid, ts, is_ask, status_id = 1 AS live, status_id = 2 AS gone, CASE WHEN order_type_id = 0 THEN limit_px END AS px, orig_sz AS q FROM flow WHERE status_id IN (1, 2)),
step AS (
  SELECT 0::BIGINT AS i, 1 AS kind, NULL::BIGINT AS oid, NULL::BIGINT AS ts, NULL::BOOLEAN AS is_ask, NULL::BIGINT AS px, 0::BIGINT AS rem, 0::BIGINT AS fill, NULL::BIGINT AS taker
  UNION ALL
  (WITH e AS (SELECT ev.* FROM ev WHERE ev.i = (SELECT max(i) + 1 FROM step WHERE kind = 1)),
  book AS (SELECT w.oid, w.ts, w.is_ask, w.px, w.rem - w.fill AS rem FROM step w WHERE w.kind = 0 AND w.rem > w.fill),
  hit AS (SELECT b.*, e.live AND b.is_ask <> e.is_ask AND (e.px IS NULL OR CASE WHEN e.is_ask THEN b.px >= e.px ELSE b.px <= e.px END) AS x, e.q, e.oid AS taker, e.i AS ei, e.gone AND e.oid = b.oid AS dead FROM book b, e),
  cum AS (SELECT *, sum(rem) OVER (ORDER BY CASE WHEN is_ask THEN px ELSE -px END, ts, oid ROWS UNBOUNDED PRECEDING) AS c FROM hit WHERE x),
  done AS (SELECT *, greatest(0, least(rem, q - (c - rem))) AS f FROM cum)
  SELECT ei::BIGINT, 0, oid::BIGINT, ts::BIGINT, is_ask, px::BIGINT, rem::BIGINT, f::BIGINT, CASE WHEN f > 0 THEN taker END::BIGINT FROM done
  UNION ALL SELECT ei::BIGINT, 0, oid::BIGINT, ts::BIGINT, is_ask, px::BIGINT, rem::BIGINT, 0, NULL FROM hit WHERE NOT x AND NOT dead
  UNION ALL SELECT e.i::BIGINT, 0, e.oid::BIGINT, e.ts::BIGINT, e.is_ask, e.px::BIGINT, (e.q - coalesce((SELECT sum(f) FROM done), 0))::BIGINT, 0, NULL FROM e WHERE e.live AND e.px IS NOT NULL AND e.q > coalesce((SELECT sum(f) FROM done), 0)
  UNION ALL SELECT e.i::BIGINT, 1, NULL, NULL, NULL, NULL, 0, 0, NULL FROM e))
"""


@query(_CDA + "SELECT taker, oid AS maker, px AS price, fill AS quantity, is_ask AS maker_is_ask FROM step WHERE kind = 0 AND fill > 0")
def cda_replay(spark, sf):
    t = R.of_kind(R.replay(order_flow(spark, sf), W, ("cda",), books=False), "trade")
    ask = F.col("aggressor_is_ask")
    return t.select(F.when(ask, F.col("sell_order_id")).otherwise(F.col("buy_order_id")).alias("taker"), F.when(ask, F.col("buy_order_id")).otherwise(F.col("sell_order_id")).alias("maker"), "price", "quantity", (~ask).alias("maker_is_ask"))


@query(_CDA + "SELECT is_ask, px AS price, ts, oid, (rem - fill)::BIGINT AS quantity FROM step WHERE kind = 0 AND rem > fill AND i = (SELECT max(i) FROM step)")
def cda_open_orders(spark, sf):
    return R.of_kind(R.replay(order_flow(spark, sf), W, ("cda",), books=False, resting=True, kinds=("resting",)), "resting_cda").select("is_ask", "price", "ts", "oid", "quantity")


@query()
def replay_intervals(spark, sf):
    """Both engines' interval tables from one replay, without what the machine's clock decides."""
    from ..session import replay

    return replay(order_flow(spark, sf), W).intervals.drop("throughput_orders_per_sec", "avg_clearing_latency_micros")


@query()
def replay_invariants(spark, sf):
    from ..session import replay

    both = written(replay(order_flow(spark, sf), W).intervals, "intervals")  # four passes over a few rows
    return audit.invariants(both.where("engine = 'cda'"), "cda", W).withColumn("engine", F.lit("cda")).unionByName(audit.invariants(both.where("engine = 'fba'"), "fba", W).withColumn("engine", F.lit("fba")))


# interval metrics on the tape

_B = f"a + greatest(ts - a, 0) // {W} * {W} AS bucket"
_STATES = """first AS (SELECT oid, arg_min(user_id, seq) AS user_id, arg_min(limit_price, seq) AS limit_price, arg_min(quantity, seq) AS orig, arg_min(ts, seq) AS seen FROM (SELECT *, limit_price IS NULL AS z FROM messages WHERE accepted) GROUP BY oid),
lim AS (SELECT oid, limit_price FROM (SELECT oid, limit_price, row_number() OVER (PARTITION BY oid ORDER BY seq) AS r FROM messages WHERE accepted) WHERE r = 1),
fill AS (SELECT oid, sum(quantity) AS filled, min(ts) AS fat FROM (SELECT buy_order_id AS oid, quantity, ts FROM trades UNION ALL SELECT sell_order_id, quantity, ts FROM trades) GROUP BY oid),
states AS (SELECT first.oid, user_id, orig, seen, coalesce(filled, 0) AS filled, fat FROM first LEFT JOIN fill USING (oid))"""


def _tape(spark, sf):
    m = tape(spark, sf, MESSAGES_SQL)
    return m, tape(spark, sf, TRADES_SQL), metrics.bounds(m)


@query(f"""{TAPE}, {_STATES}, t AS (SELECT t.*, {_B}, b.limit_price AS bl, s.limit_price AS sl, (price - reference_price) * 20000.0 / reference_price AS dev FROM anchor, trades t LEFT JOIN lim b ON b.oid = buy_order_id LEFT JOIN lim s ON s.oid = sell_order_id)
SELECT bucket, sum(quantity)::DOUBLE AS executed_volume, sum(quantity::HUGEINT * price)::DOUBLE AS executed_notional, count(*)::BIGINT AS trade_count, round(sum(quantity::HUGEINT * price)::DOUBLE / sum(quantity), 6) AS vwap,
  sum(quantity * (coalesce(greatest(bl - price, 0), 0) + coalesce(greatest(price - sl, 0), 0)))::DOUBLE AS trader_surplus, round(stddev_pop(price) / avg(price) * 10000, 6) AS intra_interval_price_dispersion,
  round(sum(CASE WHEN aggressor_is_ask THEN -dev ELSE dev END * quantity) / sum(quantity), 6) AS effective_spread_bps FROM t GROUP BY bucket""")
def interval_trades(spark, sf):
    m, t, limits = _tape(spark, sf)
    return rounded(metrics.traded(t, metrics.order_states(m, t), limits, W).drop("coin"))


_MIDS = "mids AS (SELECT ts, seq, (best_bid + best_ask) / 2.0 AS p FROM books WHERE best_bid IS NOT NULL), mid AS (SELECT ts, arg_min(p, seq) AS p FROM mids GROUP BY ts)"


@query(f"""{TAPE}, {_MIDS}, x AS (SELECT trades.*, h, ts + h * 1000000000 AS target FROM trades, (SELECT unnest([1, 5, 30]::BIGINT[]) AS h)), y AS (SELECT x.*, mid.p FROM x ASOF LEFT JOIN mid ON x.target <= mid.ts),
z AS (SELECT {_B}, h, quantity, CASE WHEN aggressor_is_ask THEN -1 ELSE 1 END * 2.0 * (price - p) / reference_price * 10000 AS v FROM y, anchor WHERE p IS NOT NULL)
SELECT bucket, {', '.join(f"round(sum(v * quantity) FILTER (h = {h}) / sum(quantity) FILTER (h = {h}), 6) AS realized_spread_bps_{h}s" for h in (1, 5, 30))} FROM z GROUP BY bucket""")
def interval_realized_spreads(spark, sf):
    _, t, limits = _tape(spark, sf)
    return rounded(metrics.realized(t, metrics.price_series("cda", tape(spark, sf, BOOKS_SQL), None), limits, W).drop("coin"))


@query(f"""{TAPE}, {_MIDS}, s AS (SELECT ts, sum(CASE WHEN aggressor_is_ask THEN -quantity ELSE quantity END) AS x, arg_min(reference_price, trade_id) AS m FROM trades GROUP BY ts),
y AS (SELECT s.*, mid.p FROM (SELECT *, ts + 5000000000 AS target FROM s) s ASOF LEFT JOIN mid ON s.target <= mid.ts), z AS (SELECT {_B}, x::DOUBLE AS x, (p - m) / m * 10000 AS y FROM y, anchor WHERE p IS NOT NULL)
SELECT bucket, CASE WHEN sum(x * x) > 0 THEN round(sum(x * y) / sum(x * x), 6) END AS kyle_lambda FROM z GROUP BY bucket""")
def interval_kyle_cda(spark, sf):
    _, t, limits = _tape(spark, sf)
    return rounded(metrics.kyle_cda(t, metrics.price_series("cda", tape(spark, sf, BOOKS_SQL), None), limits, W).drop("coin"))


@query(f"""{TAPE}, c AS (SELECT *, lag(clearing_price) OVER (ORDER BY batch) AS was FROM batches WHERE clearing_price IS NOT NULL), z AS (SELECT {_B}, net_order_flow::DOUBLE AS x, (clearing_price - was)::DOUBLE / was * 10000 AS y FROM c, anchor WHERE was > 0)
SELECT bucket, CASE WHEN sum(x * x) > 0 THEN round(sum(x * y) / sum(x * x), 6) END AS kyle_lambda FROM z GROUP BY bucket""")
def interval_kyle_fba(spark, sf):
    return rounded(metrics.kyle_fba(tape(spark, sf, BATCHES_SQL), _tape(spark, sf)[2], W).drop("coin"))


@query(f"""{TAPE}, {_STATES}, u AS (SELECT a + (seen - a) // {W} * {W} AS bucket, user_id, sum(orig) AS orig, sum(filled) AS filled, sum(greatest(fat - seen, 0)) AS wait, count(fat) AS waits FROM states, anchor GROUP BY ALL)
SELECT bucket, round(sum(filled) / sum(orig), 6) AS fill_rate, round(sum(wait) / sum(waits) / 1e9, 6) AS avg_time_to_execution_secs, round(avg(orig / filled) FILTER (filled > 0), 6) AS order_size_inflation FROM u GROUP BY bucket""")
def interval_execution(spark, sf):
    m, t, limits = _tape(spark, sf)
    return rounded(metrics.execution(metrics.order_states(m, t), limits, W).drop("coin"))


@query(f"""{TAPE}, {_MIDS}, r AS (SELECT {_B}, ts, seq, p FROM mids, anchor), l AS (SELECT *, lag(p) OVER (PARTITION BY bucket ORDER BY ts, seq) AS was FROM r)
SELECT bucket, round(sqrt(sum(((p - was) / was) ** 2)), 9) AS realized_volatility, arg_max(p, seq) AS close FROM l GROUP BY bucket""")
def interval_volatility(spark, sf):
    return rounded(metrics.volatility(metrics.price_series("cda", tape(spark, sf, BOOKS_SQL), None), _tape(spark, sf)[2], W).drop("coin"), 9)


@query(f"""{TAPE}, b AS (SELECT {_B}, * FROM books, anchor) SELECT bucket, round(avg((best_ask - best_bid) / ((best_bid + best_ask) / 2.0) * 10000), 6) AS quoted_spread_bps, round(avg((best_bid_qty + best_ask_qty) / 2.0), 6) AS depth_at_best,
  {', '.join(f"round(avg((b{n} + a{n}) / 2.0), 6) AS depth_within_{n}bps" for n in (10, 50, 100))}, round(avg((best_bid_qty - best_ask_qty) / (best_bid_qty + best_ask_qty)), 6) AS book_imbalance,
  round(avg((bid_depth + ask_depth) / 2.0), 6) AS total_book_depth FROM b GROUP BY bucket""")
def interval_books(spark, sf):
    return rounded(metrics.book_liquidity(tape(spark, sf, BOOKS_SQL), _tape(spark, sf)[2], W).drop("coin", "_spent", "_timed"))


@query(f"""{TAPE}, w AS (SELECT *, ts - (ts - batch_open_ts) // 10 AS tail FROM batches), n AS (SELECT w.*, (SELECT count(*) FROM messages m WHERE m.ts BETWEEN w.batch_open_ts AND w.ts) AS al, (SELECT count(*) FROM messages m WHERE m.ts BETWEEN w.tail AND w.ts) AS late FROM w),
b AS (SELECT {_B}, * FROM n, anchor) SELECT bucket, round(avg((best_unfilled_sell - best_unfilled_buy) / clearing_price * 10000), 6) AS quoted_spread_bps, round(avg((demand_at_price + supply_at_price) / 2.0), 6) AS depth_at_best,
  {', '.join(f"round(avg((b{n} + a{n}) / 2.0), 6) AS depth_within_{n}bps" for n in (10, 50, 100))}, round(sum(unexecuted_quantity) / sum(greatest(demand_at_price, supply_at_price)), 6) AS unexecuted_residual_share,
  round(sum(late) / sum(al), 6) AS boundary_concentration FROM b GROUP BY bucket""")
def interval_batches(spark, sf):
    return rounded(metrics.batch_liquidity(tape(spark, sf, BATCHES_SQL), tape(spark, sf, MESSAGES_SQL), _tape(spark, sf)[2], W).drop("coin", "_spent", "_timed"))


# statistics and series, by hour of the flow

_SERIES = FLOW_SQL + f""", series AS (SELECT ts // {HOUR} AS hour, sum(CASE WHEN is_ask THEN orig_sz END) AS a, sum(CASE WHEN NOT is_ask THEN orig_sz END) AS b, max(CASE WHEN seq % 5 > 0 THEN limit_px END) AS px, sum(orig_sz) AS q, sum(orig_sz * limit_px) AS n FROM flow GROUP BY 1)"""


def _series(spark, sf):
    f, ask = order_flow(spark, sf), F.col("is_ask")
    return f.groupBy(F.floor(F.col("ts") / HOUR).alias("hour")).agg(
        F.sum(F.when(ask, F.col("orig_sz"))).alias("a"), F.sum(F.when(~ask, F.col("orig_sz"))).alias("b"), F.max(F.when(F.col("seq") % 5 > 0, F.col("limit_px"))).alias("px"),
        F.sum("orig_sz").alias("q"), F.sum(F.col("orig_sz") * F.col("limit_px")).alias("n"),
    ).withColumn("coin", F.lit("EV"))


_HAC = "least(60, floor(4 * pow(n / 100.0, 2.0 / 9)))"


@query(f"""WITH {_SERIES}, p AS (SELECT row_number() OVER (ORDER BY hour) AS i, (a - b)::DOUBLE AS d, a, b FROM series WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(d) AS md FROM p),
g AS (SELECT l, sum((x.d - md) * (y.d - md)) AS g FROM m, (SELECT unnest(range(0, 61)) AS l) k, p x JOIN p y ON y.i = x.i - l WHERE l <= {_HAC} GROUP BY l), s AS (SELECT sum(CASE WHEN l = 0 THEN g ELSE 2 * (1 - l / ({_HAC} + 1)) * g END) AS s FROM g, m)
SELECT 'EV' AS coin, n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(md, 6) AS diff, round(sqrt(s) / n, 6) AS se, round(md / (sqrt(s) / n), 6) AS t FROM m, s""")
def paired_difference(spark, sf):
    return rounded(stats.paired_difference(_series(spark, sf), "a", "b", ["coin"], "hour"))


@query(f"""WITH {_SERIES}, p AS (SELECT row_number() OVER (ORDER BY hour) AS i, q::DOUBLE AS x, a::DOUBLE AS a, b::DOUBLE AS b FROM series WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT count(*) AS n, sum(x * x) AS xx, sum(x * a) / sum(x * x) AS sa, sum(x * b) / sum(x * x) AS sb FROM p),
e AS (SELECT i, x * (a - b - (sa - sb) * x) AS e FROM p, m), g AS (SELECT l, sum(u.e * v.e) AS g FROM m, (SELECT unnest(range(0, 61)) AS l) k, e u JOIN e v ON v.i = u.i - l WHERE l <= {_HAC} GROUP BY l),
s AS (SELECT sum(CASE WHEN l = 0 THEN g ELSE 2 * (1 - l / ({_HAC} + 1)) * g END) AS s FROM g, m) SELECT 'EV' AS coin, round(sa, 9) AS slope_a, round(sb, 9) AS slope_b, round(sa - sb, 9) AS diff, round(sqrt(s) / xx, 9) AS se, round((sa - sb) / (sqrt(s) / xx), 6) AS t FROM m, s""")
def slope_difference(spark, sf):
    d = _series(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("a", "b", "q")})
    r = stats.slope_difference(d, "q", "a", "b", ["coin"], "hour")
    return r.select("coin", *[F.round(c, 6 if c == "t" else 9).alias(c) for c in r.columns[1:]])


@query(f"""WITH {_SERIES}, l AS (SELECT metric, v FROM series UNPIVOT (v FOR metric IN (a, b, q)))
SELECT metric, count(v)::BIGINT AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v)::BIGINT AS min, max(v)::BIGINT AS max, round(median(v), 6) AS median FROM l GROUP BY metric""")
def one_sided(spark, sf):
    return rounded(stats.one_sided(stats.unpivot_metrics(_series(spark, sf), ["coin", "hour"], ["a", "b", "q"]), "value", ["metric"]))


@query(f"""WITH {_SERIES}, f AS (SELECT hour, last_value(px IGNORE NULLS) OVER (ORDER BY hour) AS filled FROM series) SELECT hour, filled, round(CASE WHEN lag(filled) OVER (ORDER BY hour) > 0 THEN (lead(filled, 5) OVER (ORDER BY hour) - lag(filled) OVER (ORDER BY hour)) / lag(filled) OVER (ORDER BY hour) * 10000.0 END, 6) AS change FROM f""")
def price_changes(spark, sf):
    return rounded(stats.price_changes_bps(_series(spark, sf), "px", "hour", ["coin"], 5).select("hour", "filled", "change"))


@query(f"""WITH {_SERIES}, d AS (SELECT hour, nullif(sign(px - lag(px) OVER (ORDER BY hour)), 0) AS s FROM series) SELECT hour, last_value(s IGNORE NULLS) OVER (ORDER BY hour)::DOUBLE AS sign FROM d""")
def tick_signs(spark, sf):
    return stats.tick_sign(_series(spark, sf), "px", "hour", ["coin"]).select("hour", "sign")


@query(f"""WITH {_SERIES}, r AS (SELECT hour // 24 AS day, ln(px / lag(px) OVER (ORDER BY hour)) AS r FROM series WHERE px IS NOT NULL) SELECT day, count(r)::BIGINT AS n, CASE WHEN count(r) >= 5 THEN round(sqrt(avg(r * r)) * 10000, 6) END AS rms FROM r GROUP BY day""")
def daily_volatility(spark, sf):
    r = stats.log_returns(_series(spark, sf).where("px is not null"), "px", "hour", ["coin"])
    return rounded(stats.windowed_rms(r.withColumn("day", F.floor(F.col("hour") / 24)), "r", ["day"]))


@query(f"""WITH {_SERIES}, i AS (SELECT row_number() OVER (ORDER BY hour) - 1 AS i, count(*) OVER () AS n, q FROM series) SELECT i // 24 AS block, sum(q)::BIGINT AS total FROM i WHERE i < n - n % 24 GROUP BY 1""")
def block_sums(spark, sf):
    d = stats.numbered(_series(spark, sf), ["coin"], "hour")
    return stats.block_sums(d, "i", "q", 24, d.count())


@query(f"""WITH {_SERIES}, c AS (SELECT unnest(list_distinct([{', '.join(f'quantile_cont(q, {i} / 20)' for i in range(21))}])) AS e FROM series), k AS (SELECT e FROM c WHERE e > (SELECT min(e) FROM c) AND e < (SELECT max(e) FROM c)),
b AS (SELECT q, n, (SELECT count(*) FROM k WHERE q > e) AS bin FROM series) SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(q), 6) AS mean_x, round(avg(n), 3) AS mean_y FROM b GROUP BY bin""")
def quantile_bins(spark, sf):
    r = stats.quantile_bins(_series(spark, sf), "q", "n")
    return r.select(F.col("bin").cast("long").alias("bin"), "n", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 3).alias("mean_y"))


@query(f"""WITH {_SERIES}, v AS (SELECT ln(q) / ln(10) AS v FROM series) SELECT least(floor((v - 0.0) / 6.0 * 80), 79)::BIGINT AS bin, count(*)::BIGINT AS n FROM v WHERE v BETWEEN 0 AND 6 GROUP BY 1""")
def log_histogram(spark, sf):
    return rounded(stats.histogram(_series(spark, sf), F.log("q") / F.log(F.lit(10.0)), 0.0, 6.0, 80))


@query(f"""WITH {_SERIES}, d AS (SELECT hour // 24 AS day, sum(a) AS a, sum(b) AS b FROM series GROUP BY 1), r AS (SELECT a / b AS r FROM d WHERE b > 0)
SELECT (SELECT round(corr(a, b), 6) FROM series) AS correlation, (SELECT round(sum(CASE WHEN a > b THEN q END) / sum(q), 6) FROM series) AS share, round(min(r), 6) AS lowest, round(median(r), 6) AS middle, round(max(r), 6) AS highest FROM r""")
def fidelity(spark, sf):
    s = _series(spark, sf)
    day = s.groupBy(F.floor(F.col("hour") / 24).alias("day")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("b > 0").withColumn("r", F.col("a") / F.col("b"))
    one = s.agg(F.corr("a", "b").alias("correlation"), (F.sum(F.when(F.col("a") > F.col("b"), F.col("q"))) / F.sum("q")).alias("share"))
    return rounded(one.join(day.agg(F.min("r").alias("lowest"), F.median("r").alias("middle"), F.max("r").alias("highest"))))


@query(f"""WITH {_SERIES}, h AS (SELECT hour, n / q / 1e6 AS vwap, px / 1e6 AS close FROM series WHERE px IS NOT NULL), d AS (SELECT vwap / close - 1 AS e, vwap / lag(vwap) OVER (ORDER BY hour) - 1 AS c FROM h)
SELECT round(avg(e), 9) AS mean, round(avg(abs(e)), 9) AS mae, round(median(abs(e)), 9) AS median, round(quantile_cont(abs(e), 0.95), 9) AS p95, round(max(abs(e)), 9) AS worst, round(sqrt(avg(e * e)), 9) AS rmse, round(avg(CASE WHEN abs(e) <= 0.001 THEN 1.0 ELSE 0.0 END), 9) AS inside, round(avg(c), 9) AS change FROM d""")
def hourly_price_deviation(spark, sf):
    from pyspark.sql import Window

    h = _series(spark, sf).where("px is not null").withColumn("vwap", F.col("n") / F.col("q") / 1e6)
    e, c = F.col("vwap") / (F.col("px") / 1e6) - 1, F.col("vwap") / F.lag("vwap").over(Window.partitionBy("coin").orderBy("hour")) - 1
    d = h.select(e.alias("e"), c.alias("c"), F.abs(e).alias("x"))
    return rounded(d.agg(F.avg("e").alias("mean"), F.avg("x").alias("mae"), F.median("x").alias("median"), F.percentile("x", F.lit(0.95)).alias("p95"), F.max("x").alias("worst"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.when(F.col("x") <= 0.001, 1.0).otherwise(0.0)).alias("inside"), F.avg("c").alias("change")), 9)


@query(f"""WITH {_SERIES}, s AS (SELECT hour AS sec, a AS volume FROM series WHERE a IS NOT NULL), v AS (SELECT hour + 1 AS sec, b AS volume FROM series WHERE b IS NOT NULL)
SELECT sec, coalesce(s.volume, 0)::BIGINT AS sim, coalesce(v.volume, 0)::BIGINT AS venue, greatest(coalesce(s.volume, 0) - coalesce(v.volume, 0), 0)::BIGINT AS excess FROM s FULL JOIN v USING (sec) ORDER BY excess DESC, sec LIMIT 15""")
def top_excess(spark, sf):
    s = _series(spark, sf)
    sim, venue = s.where("a is not null").select(F.col("hour").alias("sec"), F.col("a").alias("volume")), s.where("b is not null").select((F.col("hour") + 1).alias("sec"), F.col("b").alias("volume"))
    return audit.excess(sim, venue).orderBy(F.desc("excess"), "sec").limit(15)


@query(f"""WITH {_SERIES}, w AS (SELECT hour AS minute, q AS depth, CASE WHEN count(q) OVER w >= 5 THEN avg(q) OVER w END AS before FROM series WINDOW w AS (ORDER BY hour ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT minute, depth::BIGINT AS depth, round(before, 6) AS before FROM w WHERE minute % 60 = 0 AND depth < 0.6 * before""")
def depth_resets(spark, sf):
    d = _series(spark, sf).select("coin", F.col("hour").alias("minute"), F.col("q").alias("depth"))
    return rounded(audit.resets(d).select("minute", "depth", "before"))


@query(f"""WITH {_SERIES}, l AS (SELECT metric, v FROM series UNPIVOT (v FOR metric IN (a, b, q))) SELECT metric, count(v)::BIGINT AS n, sum(v)::DOUBLE AS total, round(avg(v), 6) AS avg, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max FROM l GROUP BY metric""")
def metric_summary(spark, sf):
    return rounded(audit.summary(_series(spark, sf), ["a", "b", "q"]))


@query(f"""WITH {_SERIES}, x AS (SELECT hour, q FROM series), y AS (SELECT hour, CASE WHEN hour % 7 = 0 THEN q + 1 ELSE q END AS q FROM series WHERE hour % 11 <> 0)
SELECT count(*)::BIGINT AS rows, 0::BIGINT AS missing_a, count_if(y.hour IS NULL)::BIGINT AS missing_b, count_if(x.q <> y.q)::BIGINT AS differs_q FROM x LEFT JOIN y USING (hour)""")
def compare_results(spark, sf):
    s = _series(spark, sf).select("hour", "q")
    return audit.compare(s, s.where("hour % 11 <> 0").withColumn("q", F.when(F.col("hour") % 7 == 0, F.col("q") + 1).otherwise(F.col("q"))), ["hour"], ["q"])


@query(f"""{TAPE}, m AS (SELECT * FROM trades UNION ALL SELECT 'fba' AS engine, * EXCLUDE (engine) FROM trades) SELECT row_number() OVER (ORDER BY ts, engine, trade_id)::BIGINT AS place, engine, trade_id, price, quantity FROM m""")
def trade_ledger(spark, sf):
    from ..session import ledger

    t = tape(spark, sf, TRADES_SQL)
    both = reduce(DataFrame.unionByName, [t, t.withColumn("engine", F.lit("fba"))])
    return ledger(both).select("place", "engine", "trade_id", "price", "quantity")


from . import series as _more  # noqa: E402, F401  registers its queries here
