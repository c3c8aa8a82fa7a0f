"""The command surface: an interactive session with both engines, and replay and scan of data."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify
from .operators import audit, metrics, stats
from .operators import replay as R
from .schemas import METRICS, RESTING, TRADES
from .tables import written

_FILE_ROWS = 1 << 19  # an engine's replay of a coin is one task, what reads its rows needn't be


@dataclass
class ReplayResult:
    trades: DataFrame
    batches: DataFrame
    books: DataFrame
    intervals: DataFrame


def replay(events: DataFrame, interval_ns: int) -> ReplayResult:
    """Both engines over the same records, and their interval tables on one grid; what is read more than once is written."""
    tagged = written(R.replay(events, interval_ns), "replay", _FILE_ROWS)
    trades, batches, books = (R.of_kind(tagged, k) for k in ("trade", "batch", "book"))
    messages = classify.messages(events)
    limits = written(metrics.bounds(messages), "bounds")
    both = metrics.intervals("fba", interval_ns, messages, trades, batches=batches, limits=limits).unionByName(metrics.intervals("cda", interval_ns, messages, trades, books=books, limits=limits))
    return ReplayResult(trades, batches, books, both)


def scan(events: DataFrame) -> DataFrame:
    return audit.scan_counts(events)


def trade_log(trades: DataFrame) -> DataFrame:
    """Trades of both engines by time; at one time the continuous engine's first."""
    return trades.orderBy("ts", F.when(F.col("engine") == "cda", 0).otherwise(1), "trade_id")


def ledger(trades: DataFrame) -> DataFrame:
    """Every trade of both engines with its place from 1 in the trade log, numbered by hours."""
    ties = (F.when(F.col("engine") == "cda", 0).otherwise(1), "trade_id")
    return stats.numbered(trades, [], "ts", "place", 3_600 * 10**9, ties).withColumn("place", F.col("place") + 1)


def core_metrics(result: ReplayResult, metrics_of: list[str] | None = None) -> DataFrame:
    both = [audit.summary(result.intervals.where(F.col("engine") == e), metrics_of or METRICS).withColumn("engine", F.lit(e)) for e in ("cda", "fba")]
    return both[0].unionByName(both[1])


@dataclass
class Session:
    """Orders typed in by hand; views are DataFrames."""

    spark: SparkSession
    engine: str = "cda"
    coin: str = "MANUAL"
    cda: R.Continuous = field(default_factory=R.Continuous)
    fba: R.Batch = field(default_factory=R.Batch)
    next_oid: int = 1
    trades: list[tuple] = field(default_factory=list)

    def use(self, engine: str) -> None:
        if engine not in ("cda", "fba"):
            raise ValueError("engine is cda or fba")
        self.engine = engine

    def add(self, side: str, price: int | None, quantity: int, user: str, ts: int | None = None) -> int:
        """A limit order, or with price None a market order; gives its id."""
        if side not in ("buy", "sell") or quantity <= 0:
            raise ValueError("side is buy or sell, quantity above zero")
        ts, oid, ask = ts if ts is not None else time.time_ns(), self.next_oid, side == "sell"
        self.next_oid += 1
        if self.engine == "fba":
            self.fba.submit(ts, oid, ask, price, quantity, user)
            return oid
        bid, offer, *_ = self.cda.touch()
        mid = bid if offer is None else offer if bid is None else (bid + offer) // 2
        for n, p, q, other, who in self.cda.submit(ts, oid, ask, price, quantity, user):
            buyer, seller, b, s = (who, user, other, oid) if ask else (user, who, oid, other)
            self.trades.append((self.coin, "cda", n, None, p, q, buyer, seller, b, s, ts, mid, ask))
        return oid

    def cancel(self, oid: int) -> bool:
        return (self.cda if self.engine == "cda" else self.fba).cancel(oid)

    def clear(self) -> dict | None:
        """Clears the batch; None if it has no limit price."""
        if not self.fba.open:
            return None
        newest, was = self.fba.newest(), self.fba.last
        got = self.fba.clear()
        if got is None:
            return None
        price, demand, supply, trades = got
        self.trades += [(self.coin, "fba", n, None, price, q, buyer, seller, b, s, newest, was, None) for n, q, buyer, seller, b, s in trades]
        return {"price": price, "demand": demand, "supply": supply, "quantity": sum(t[1] for t in trades)}

    def load(self, events: DataFrame) -> int:
        """Applies records in order to the current engine; for small inputs at hand."""
        n = 0
        for r in R.prepared(events).orderBy("seq").toLocalIterator():
            n += 1
            book = self.cda if self.engine == "cda" else self.fba
            if r.live:
                book.submit(r.ts, r.oid, r.is_ask, r.limit, r.orig_sz, r.user_id)
            elif r.cancel:
                book.cancel(r.oid)
        return n

    def book(self) -> DataFrame:
        """Open orders of the current engine, best first."""
        rows = [(self.coin, *r) for r in (self.cda if self.engine == "cda" else self.fba).resting()]
        return self.spark.createDataFrame(rows, RESTING)

    def log(self) -> DataFrame:
        return trade_log(self.spark.createDataFrame(self.trades, TRADES))

    def metrics(self) -> dict:
        """Figures of the current engine as it stands."""
        if self.engine == "cda":
            bid, ask, _, _, b, a = self.cda.touch()
            spread = (ask - bid) / ((ask + bid) / 2) * 1e4 if bid is not None and ask is not None else None
            done = [t for t in self.trades if t[1] == "cda"]
            return {
                "best_bid": bid, "best_ask": ask, "spread_bps": spread, "depth": b + a, "imbalance": (b - a) / (b + a) if a + b else None,
                "fill_rate": self.cda.filled / self.cda.submitted if self.cda.submitted else 0.0,
                "volume": sum(t[5] for t in done), "notional": sum(t[4] * t[5] for t in done),
            }
        buy, sell = self.fba.best_unfilled()
        pending = sum(o[4] for o in self.fba.orders())
        ref = self.fba.last if self.fba.last is not None else (buy + sell) // 2 if buy is not None and sell is not None else None
        return {
            "best_buy": buy, "best_sell": sell, "spread_bps": (sell - buy) / ref * 1e4 if ref and buy is not None and sell is not None else None,
            "depth": pending, "fill_rate": 1 - pending / self.fba.submitted if self.fba.submitted else 0.0, "last_price": self.fba.last,
        }
