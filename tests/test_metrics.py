"""Hand-computed interval metrics, sources, streaming and session."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchtide.operators import metrics, ordered, stats
from batchtide.schemas import BATCHES, BOOKS, TRADES

NS = 10**9
MSG = "coin string, seq long, ts long, oid long, user_id string, is_ask boolean, limit_price long, quantity long, accepted boolean"


def rows(spark, ddl, dicts):
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], ddl)


def book(ts, bid, ask, **k):
    return {"coin": "C", "seq": ts, "ts": ts, "best_bid": bid, "best_ask": ask, "best_bid_qty": 0, "best_ask_qty": 0, "bid_depth": 0, "ask_depth": 0, **dict.fromkeys(("b10", "a10", "b50", "a50", "b100", "a100"), 0), "compute_ns": 0, **k}


def trade(n, ts, price, q, ref, ask, b=1, s=2):
    return {"coin": "C", "engine": "cda", "trade_id": n, "price": price, "quantity": q, "buy_order_id": b, "sell_order_id": s, "ts": ts, "reference_price": ref, "aggressor_is_ask": ask}


def limits(spark, last):
    return spark.createDataFrame([("C", 0, last)], "coin string, anchor long, last long")


def test_volatility_is_root_of_squared_returns(spark):
    p = spark.createDataFrame([("C", t, t, x) for t, x in ((1, 100.0), (2, 120.0), (3, 96.0))], "coin string, ts long, ord long, p double")
    r = metrics.volatility(p, limits(spark, 3), 100).first()
    assert r.realized_volatility == pytest.approx(math.sqrt(0.08)) and r.close == 96.0


def test_spread_decomposition(spark):
    # bought at 102 with the mid at 100: 400 bp; the mid one second on is 101: realized 200 bp
    t = rows(spark, TRADES, [trade(0, 0, 102, 10, 100, False)])
    books = rows(spark, BOOKS, [book(0, 99, 101), book(NS, 100, 102), book(6 * NS, 103, 105)])
    m = rows(spark, MSG, [{"coin": "C", "seq": 0, "ts": 0, "oid": 1, "user_id": "a", "is_ask": False, "limit_price": 103, "quantity": 20, "accepted": True}])
    r = metrics.intervals("cda", 60 * NS, m, t, books=books).first()
    assert r.effective_spread_bps == pytest.approx(400) and r.realized_spread_bps_1s == pytest.approx(200) and r.price_impact_bps_1s == pytest.approx(200)
    assert r.realized_spread_bps_5s == pytest.approx(-400) and r.realized_spread_bps_30s is None and r.price_impact_bps_30s is None
    assert r.trader_surplus == 10 and r.fill_rate == 0.5 and r.order_size_inflation == 2.0 and r.order_to_trade_ratio == 1.0 and r.vwap == 102


def test_batches_and_boundary(spark):
    base = dict.fromkeys(("b10", "a10", "b50", "a50", "b100", "a100", "net_order_flow", "traded_quantity", "pool_orders", "compute_ns"), 0)
    b = rows(spark, BATCHES, [{"coin": "C", "batch": 0, "ts": 100, "batch_open_ts": 0, "clearing_price": 100, "demand_at_price": 30, "supply_at_price": 55, "unexecuted_quantity": 25, "best_unfilled_buy": 98, "best_unfilled_sell": 102, **base}])
    m = rows(spark, MSG, [{"coin": "C", "seq": i, "ts": ts, "oid": i, "user_id": "a", "is_ask": False, "limit_price": 1, "quantity": 1, "accepted": True} for i, ts in enumerate((0, 50, 89, 90, 100, 100, 101))])
    r = metrics.batch_liquidity(b, m, limits(spark, 101), 1000).first()
    assert r.quoted_spread_bps == pytest.approx(400) and r.unexecuted_residual_share == pytest.approx(25 / 55) and r.boundary_concentration == pytest.approx(3 / 6)


def test_grid_has_gap_rows(spark):
    assert ordered.dense_grid(limits(spark, 105), 10).count() == 11


def test_sharded_functions_equal_whole_windows(spark):
    v = [5, None, 3, 9, None, 9, 1, None, 12, 2]
    d = spark.createDataFrame([("C", i, x) for i, x in enumerate(v)], "coin string, seq long, v long")
    top = [r[0] for r in ordered.running_max(d, "m", "v", "seq", ["coin"], 3).orderBy("seq").select("m").collect()]
    assert top == [5, 5, 5, 9, 9, 9, 9, 9, 12, 12]
    fill = [r[0] for r in ordered.forward_fill(d, "f", "v", "seq", [], 3, False).orderBy("seq").select("f").collect()]
    assert fill == [None, 5, 5, 3, 9, 9, 9, 1, 1, 12]
    assert [r.i for r in stats.numbered(d, ["coin"], "seq", shards=4).orderBy("seq").collect()] == list(range(10))


def test_asof_takes_first_at_or_after(spark):
    p = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 99)], "id long, t long")
    q = spark.createDataFrame([(10, 1, 1.0), (10, 2, 2.0), (40, 3, 3.0)], "ts long, o long, v double")
    got = {r.id: r.x for r in ordered.asof_forward(p, q, "t", "ts", "o", "v", "x", width=7).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 3.0, 4: None}


def test_price_changes_fill_before_lag(spark):
    d = spark.createDataFrame([("C", i, x) for i, x in enumerate((100.0, None, 101.0, None, None, 99.0))], "coin string, i long, p double")
    got = [r.change for r in stats.price_changes_bps(d, "p", "i", ["coin"]).orderBy("i").collect()]
    assert got == [None, 0.0, pytest.approx(100.0), 0.0, 0.0, pytest.approx(-198.0198, abs=1e-3)]


def test_p_values(spark):
    r = stats.with_p(spark.createDataFrame([(1.959963985,)], "t double")).first()
    assert r.p == pytest.approx(0.05, abs=1e-6)


def test_binary_source(spark, tmp_path):
    from batchtide.sources import binary

    golden = bytes.fromhex("0af9f2979e157d18 ed000000 00 01 00 7b310040 26ca0020 6b42863a3b000000 00000000 00000000 00 00 00 00 00 00 00 00000000 26ca0020")
    r = np.frombuffer(golden, binary.RECORD)
    binary.write_records(str(tmp_path / "20251201/COIN_12.data.gz"), np.concatenate([r, r]))
    binary.write_records(str(tmp_path / "20251201/COIN_12_rejected.data.gz"), r)
    (tmp_path / "20251201/COIN_13.data").write_bytes(b"\0" * 54)
    binary.register(spark)
    d = spark.read.format("orderbin").load(str(tmp_path))
    got = d.orderBy("seq").collect()
    assert len(got) == 3 and got[0].seq + 1 == got[1].seq < got[2].seq
    x = got[0]
    assert (x.ts, x.user_id, x.status_id, x.is_ask, x.limit_px, x.oid, x.orig_sz, x.coin) == (1764590399897401610, "237", 1, False, 126670000, 254384947819, 5175, "COIN")
    cases = np.array([(2 << 29) | 9654321, (7 << 29) | 15, (7 << 29) | 14, (6 << 29) | 1], np.int64)
    assert binary.unpack_price(cases).tolist() == [96543210000, 2, 1, 1]
    assert binary.unpack_price(np.array([(1 << 29) | 0x10000000 | 50]), True).tolist() == [-5000000]
    assert binary.unpack_quantity(np.array([(2 << 29) | 3935, (1 << 29) | 395, (1 << 29) | 2])).tolist() == [39, 40, 0]


def test_csv_source(spark, tmp_path):
    from batchtide.sources.text import CSV_COLUMNS, read_key_values, read_order_csv

    row = "2025-12-01 11:59:59.897401610,237,False,1,False,126.67,5175.0,254384947819,0,0.0,False,False,False,False,False,0,0,0.0,5175.0,open,Limit,Alo"
    (tmp_path / "a.csv").write_text("\n".join([",".join(CSV_COLUMNS), row, "broken,row", row.replace("126.67", "-1")]))
    got = read_order_csv(spark, str(tmp_path / "a.csv"), "C").collect()
    assert len(got) == 1 and (got[0].ts, got[0].limit_px, got[0].orig_sz, got[0].status_label) == (1764590399897401610, 126670000, 5175, "open")
    (tmp_path / "kv.txt").write_text("version 3\nlast a b\n")
    assert {(r.key, r.value) for r in read_key_values(spark, str(tmp_path / "kv.txt")).collect()} == {("version", "3"), ("last", "a b")}


def test_interval_csv_round_trip(spark, tmp_path):
    from batchtide.schemas import INTERVAL_COLUMNS
    from batchtide.sources.text import read_intervals, write_intervals

    d = spark.range(1).select(*[F.lit("cda").alias(c) if c == "engine" else F.lit(5).cast("long").alias(c) if c in ("interval_start_ns", "interval_width_ns", "trade_count") else F.lit(None if c == "vwap" else 1.5).cast("double").alias(c) for c in INTERVAL_COLUMNS])
    write_intervals(d, str(tmp_path / "out"))
    r = read_intervals(spark, str(tmp_path / "out/of=cda")).first()
    assert r.vwap is None and r.fill_rate == 1.5 and r.trade_count == 5


def test_stream_equals_batch(spark, tmp_path):
    from batchtide.operators import replay as R
    from batchtide.sources.flow import order_flow
    from batchtide.streaming.replay_stream import replay_stream

    d = order_flow(spark, "/root/testdata/sf0.001")
    for i in range(3):
        d.where(F.floor(F.col("seq") / 400) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay_stream(src, 21_600 * NS).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["engine", "trade_id", "price", "quantity", "buy_order_id", "sell_order_id"]
    live = sorted(map(tuple, R.of_kind(spark.table("replayed"), "trade").select(*cols).collect()))
    whole = sorted(map(tuple, R.of_kind(R.replay(d, 21_600 * NS), "trade").select(*cols).collect()))
    last = [t for t in whole if t not in set(live)]
    assert set(live) <= set(whole) and all(t[0] == "fba" for t in last)  # the batch still open


def test_session(spark):
    from batchtide.session import Session

    s = Session(spark)
    s.add("sell", 102, 20, "a", 1)
    s.add("sell", 105, 30, "b", 2)
    s.add("buy", 110, 15, "c", 3)
    s.add("buy", 95, 10, "d", 4)
    m = s.metrics()
    assert m["spread_bps"] == pytest.approx(710.66, abs=0.01) and m["imbalance"] == pytest.approx(-0.5556, abs=1e-4) and m["fill_rate"] == pytest.approx(0.4) and m["depth"] == 45 and m["notional"] == 1530
    assert s.book().count() == 3 and s.log().count() == 1
    s.use("fba")
    s.add("buy", 100, 20, "a", 5)
    s.add("sell", 100, 12, "b", 6)
    assert s.clear() == {"price": 100, "demand": 20, "supply": 12, "quantity": 12}
    assert s.metrics()["fill_rate"] == pytest.approx(0.75)


def test_ledger_is_whole(spark):
    from batchtide.session import ledger

    rows = [((i * 7919) % 3001 * 10**10, "cda" if i % 3 else "fba", i) for i in range(4000)]
    got = ledger(spark.createDataFrame(rows, "ts long, engine string, trade_id long")).select("place", "ts", "engine", "trade_id").collect()
    assert sorted(map(tuple, got)) == [(i, *r) for i, r in enumerate(sorted(rows), 1)]


def test_one_coin_s_rows_are_dealt_by_interval(spark):
    p = spark.createDataFrame([("C", t, t, float(t)) for t in range(1, 9)], "coin string, ts long, ord long, p double")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = metrics.volatility(p, limits(spark, 8), 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "SortMergeJoin" not in plan and "bucket" in plan[plan.index("hashpartitioning(") :].split(")")[0]


def test_a_replay_s_tables_are_planned_in_parts(spark, monkeypatch):
    from batchtide import session
    from batchtide.sources.flow import order_flow

    lines = lambda d: d._jdf.queryExecution().analyzed().toString().count("\n")
    seen, kept = [], getattr(metrics, "written", None)
    monkeypatch.setattr(metrics, "written", lambda d, kind: seen.append(lines(d)) or kept(d, kind), raising=False)
    d = session.replay(order_flow(spark, "/root/testdata/sf0.001"), 21_600 * NS).intervals
    assert lines(d) < 200 and max(seen) < 500


def test_a_batch_s_windows_are_counted_in_one_pass(spark):
    b = rows(spark, BATCHES, [{"coin": "C", "batch": i, "ts": 100, "batch_open_ts": at, "clearing_price": 100} for i, at in enumerate((0, 60, 100))])
    m = rows(spark, MSG, [{"coin": "C", "seq": ts, "ts": ts} for ts in (0, 50, 89, 90, 97, 100, 101)])
    d = metrics.batch_liquidity(b, m, limits(spark, 101), 1000)
    assert d.first().boundary_concentration == pytest.approx((3 + 2) / (6 + 4))  # the third has no window
    assert d._jdf.queryExecution().analyzed().toString().count("Window [") <= 6  # 24 if each window looks up on its own
