"""The two matching engines, as keyed stateful operators.

Records of a coin are worked off in seq order.  A task gets its coins' records
of an engine sorted (coin, seq) and streams through them, so it holds the open
orders and never a coin's whole history; coins and engines are the units of
parallelism.  The same engine objects serve the streaming operator.
"""

from __future__ import annotations

import gc
import sys
import time
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..schemas import BATCHES, BOOKS, DEPTHS, RESTING, TRADES, arrow, names

_BANDS = (10, 50, 100)


class _Side:
    """One side of a book: levels by price, each a heap of orders [ts, oid, arrival, left, user, is_ask, price].

    The first order of a level is open; others that a cancellation took stay,
    with nothing left, until they come up or are most of their level.
    Prices wait in a heap (negated for bids); empty levels leave it late.
    With moves, every change of a price's quantity is written down.
    """

    def __init__(self, sign: int):
        self.sign, self.levels, self.heap, self.total, self.gone, self.depth = sign, {}, [], {}, {}, 0
        self.moves: tuple[list[int], list[int]] | None = None

    def best(self) -> int | None:
        while self.heap:
            p = self.heap[0] * self.sign
            if p in self.levels:
                return p
            heappop(self.heap)
        return None

    def add(self, order: list) -> None:
        price, left = order[6], order[3]
        level = self.levels.get(price)
        if level is None:
            self.levels[price], self.total[price] = [order], left
            if len(self.heap) > 2 * len(self.levels) + 64:
                self.heap = [p * self.sign for p in self.levels]
                heapify(self.heap)
            else:
                heappush(self.heap, price * self.sign)
        else:
            order[6] = level[0][6]  # the same number, held once a level
            heappush(level, order)
            self.total[price] += left
        self.depth += left
        if self.moves is not None:
            self.moves[0].append(price)
            self.moves[1].append(left)

    def take(self, order: list, quantity: int) -> None:
        """Takes some of an order off, which is the first of its level unless all of it goes."""
        price = order[6]
        order[3] -= quantity
        self.depth -= quantity
        if self.moves is not None:
            self.moves[0].append(price)
            self.moves[1].append(-quantity)
        total = self.total[price] = self.total[price] - quantity
        if not total:
            del self.levels[price], self.total[price]
            self.gone.pop(price, None)
        elif not order[3]:
            level = self.levels[price]
            if level[0] is order:
                heappop(level)
                while not level[0][3]:
                    heappop(level)
                    self.gone[price] -= 1
            else:
                gone = self.gone[price] = self.gone.get(price, 0) + 1
                if 2 * gone > len(level):
                    level[:] = [o for o in level if o[3]]
                    heapify(level)
                    del self.gone[price]

    def orders(self, price: int) -> list[list]:
        return sorted(o for o in self.levels[price] if o[3])


class Continuous:
    """Continuous double auction: price, then time; trades at the resting order's price."""

    def __init__(self):
        self.sides = {False: _Side(-1), True: _Side(1)}
        self.where: dict[int, list] = {}  # the newest resting order of an oid, until any order of that oid ends
        self.copies: dict[int, dict[tuple, list]] = {}  # of an oid that came again: a heap of its orders for each side and price
        self.arrivals = self.trades = self.submitted = self.filled = 0

    def _rest(self, order: list) -> None:
        oid = order[1]
        was = self.where.get(oid)
        if was is not None or oid in self.copies:
            kept = self.copies.setdefault(oid, {})
            if not kept:
                kept[was[5], was[6]] = [was]
            heappush(kept.setdefault((order[5], order[6]), []), order)
        self.where[oid] = order
        self.sides[order[5]].add(order)

    def _end(self, order: list) -> None:
        """An order leaves: the first of its oid at its price."""
        oid = order[1]
        self.where.pop(oid, None)
        if oid in self.copies:
            kept, at = self.copies[oid], (order[5], order[6])
            heappop(kept[at])
            if not kept[at]:
                del kept[at]
                if not kept:
                    del self.copies[oid]

    def cancel(self, oid: int) -> bool:
        """The first order of that oid at the price of its newest goes."""
        order = self.where.get(oid)
        if order is None:
            return False
        if oid in self.copies:
            order = self.copies[oid][order[5], order[6]][0]
        self._end(order)
        self.sides[order[5]].take(order, order[3])
        return True

    def submit(self, ts: int, oid: int, is_ask: bool, limit: int | None, quantity: int, user: str) -> list[tuple]:
        """Fills (trade_id, price, quantity, resting oid, resting user) of a live order; what is left of a limit order rests."""
        fills, other, left = [], self.sides[not is_ask], quantity
        self.submitted += quantity
        while left:
            price = other.best()
            if price is None or (limit is not None and (price < limit if is_ask else price > limit)):
                break
            order = other.levels[price][0]
            n = min(left, order[3])
            left -= n
            fills.append((self.trades, price, n, order[1], order[4]))
            self.trades += 1
            self.filled += 2 * n
            if n == order[3]:
                self._end(order)
            other.take(order, n)
        if left and limit is not None:
            self._rest([ts, oid, self.arrivals, left, user, is_ask, limit])
            self.arrivals += 1
        return fills

    def touch(self) -> tuple:
        """(best bid, best ask, first order's quantity on each side, depth of each side)."""
        b, a = (self.sides[s] for s in (False, True))
        bid, ask = b.best(), a.best()
        return bid, ask, b.levels[bid][0][3] if bid is not None else 0, a.levels[ask][0][3] if ask is not None else 0, b.depth, a.depth

    def schedule(self) -> tuple[int, ...]:
        """Quantity within 10, 50 and 100 bp of the mid, bids and asks in turn."""
        bid, ask = self.sides[False].best(), self.sides[True].best()
        if bid is None and ask is None:
            return (0,) * 6
        mid = bid if ask is None else ask if bid is None else (bid + ask) // 2
        return bands(mid, ((p, s, q) for s in (False, True) for p, q in self.sides[s].total.items()))

    def resting(self):
        """Open orders, best first."""
        for is_ask, side in self.sides.items():
            for p in sorted(side.levels, key=lambda x, s=side.sign: x * s):
                for ts, oid, _, left, user, *_ in side.orders(p):
                    yield is_ask, p, ts, oid, user, left, False


def bands(reference: int, levels) -> tuple[int, ...]:
    out = [0] * 6
    if reference:
        for price, is_ask, quantity in levels:
            far = abs(price - reference) * 10_000 // reference
            for i, most in enumerate(_BANDS):
                if far <= most:
                    out[2 * i + is_ask] += quantity
    return tuple(out)


_STEP = 512


def schedules(total: dict[int, int], prices: list[int], deltas: list[int], ends: np.ndarray, mid: np.ndarray, told: np.ndarray) -> np.ndarray:
    """bands() of one side after each of many records: a row a record, a column a band.

    total is the side after the last record, prices and deltas its changes, the
    first ends[i] of them made by records up to i; told says where mid counts.
    Records are worked off by _STEP: a step sums the side before it up by price, and its own changes by record and price.
    """
    prices, deltas, now = np.array(prices, np.int64), np.array(deltas, np.int64), np.array(list(total), np.int64)
    at = np.searchsorted(ends, np.arange(len(prices)), "right")
    known = np.unique(np.concatenate([now, prices]))
    held, place = np.zeros(len(known), np.int64), np.searchsorted(known, prices)
    held[np.searchsorted(known, now)] = list(total.values())
    np.subtract.at(held, place, deltas)
    most = np.array(_BANDS) + 1
    whole, rest = np.divmod(mid[:, None], 10_000)
    far = most * whole + (most * rest - 1) // 10_000  # the farthest p for which abs(p - mid) * 10_000 // mid is within the band
    low = np.where(mid[:, None] > 0, mid[:, None] - far, np.iinfo(np.int64).min)
    high = np.where(mid[:, None] > 0, mid[:, None] + far, np.iinfo(np.int64).max)
    low, high = np.searchsorted(known, low, "left"), np.searchsorted(known, high, "right")
    out = np.zeros(low.shape, np.int64)
    for i in range(0, len(ends), _STEP):
        j = min(i + _STEP, len(ends))
        before = np.concatenate([[0], np.cumsum(held)])
        out[i:j] = before[high[i:j]] - before[low[i:j]]
        m = slice(ends[i - 1] if i else 0, ends[j - 1])
        if m.start < m.stop:
            moved, which = np.unique(place[m], return_inverse=True)
            own = np.zeros((j - i, len(moved) + 1), np.int64)
            np.add.at(own, (at[m] - i, which + 1), deltas[m])
            own = own.cumsum(0).cumsum(1)
            row = np.arange(j - i)[:, None]
            out[i:j] += own[row, np.searchsorted(moved, high[i:j])] - own[row, np.searchsorted(moved, low[i:j])]
            np.add.at(held, place[m], deltas[m])
    return np.where(told[:, None], out, 0)


class _Queue:
    """Open orders of one side by limit price (None: at the market), with the quantity of each price.

    A level is a heap of orders [ts, oid, arrival, limit, left, user, is_ask] as in _Side.
    """

    def __init__(self, is_ask: bool):
        self.is_ask = is_ask
        self.orders: dict[int | None, list[list]] = {}
        self.total: dict[int | None, int] = {}
        self.gone: dict[int | None, int] = {}

    def add(self, order: list) -> None:
        limit = order[3]
        level = self.orders.get(limit)
        if level is None:
            self.orders[limit], self.total[limit] = [order], order[4]
        else:
            order[3] = level[0][3]  # the same number, held once a level
            heappush(level, order)
            self.total[limit] += order[4]

    def take(self, order: list, quantity: int) -> None:
        """Takes some of an order off, which is the first of its level unless all of it goes."""
        limit = order[3]
        order[4] -= quantity
        total = self.total[limit] = self.total[limit] - quantity
        if not total:
            del self.orders[limit], self.total[limit]
            self.gone.pop(limit, None)
        elif not order[4]:
            level = self.orders[limit]
            if level[0] is order:
                heappop(level)
                while not level[0][4]:
                    heappop(level)
                    self.gone[limit] -= 1
            else:
                gone = self.gone[limit] = self.gone.get(limit, 0) + 1
                if 2 * gone > len(level):
                    level[:] = [o for o in level if o[4]]
                    heapify(level)
                    del self.gone[limit]

    def limits(self) -> list[int]:
        """Prices, the keenest first."""
        return sorted((p for p in self.total if p is not None), reverse=not self.is_ask)

    def keenest(self) -> int | None:
        return (min if self.is_ask else max)((p for p in self.total if p is not None), default=None)

    def heads(self):
        """The first order by priority (at the market, then by price, each by time and id), again after each that was taken."""
        for p in ([None] if None in self.orders else []) + self.limits():
            while p in self.orders:
                yield self.orders[p][0]


class Batch:
    """Frequent batch auction: one price a batch, leftovers roll over.

    Each side keeps its orders by price with the prices' quantities, so a
    clearing reads levels and only as many orders as trade.
    """

    def __init__(self):
        self.sides = {False: _Queue(False), True: _Queue(True)}
        self.by_oid: dict[int, list | dict[int, list]] = {}  # an open order, or several by arrival: [ts, oid, arrival, limit or None, left, user, is_ask]
        self.open = 0
        self.times: list[list] = []  # orders that batches left open, newest last; some may be gone since
        self.fresh: list[list] = []  # orders since the last batch
        self.last: int | None = None
        self.arrivals = self.trades = self.submitted = 0

    def submit(self, ts: int, oid: int, is_ask: bool, limit: int | None, quantity: int, user: str) -> None:
        self.submitted += quantity
        number = self.arrivals
        order = [ts, oid, number, limit, quantity, user, is_ask]
        self.sides[is_ask].add(order)
        self.fresh.append(order)
        self.open += 1
        same = self.by_oid.get(oid)
        if same is None:
            self.by_oid[oid] = order
        elif isinstance(same, dict):
            same[number] = order
        else:
            self.by_oid[oid] = {same[2]: same, number: order}
        self.arrivals += 1

    def cancel(self, oid: int) -> bool:
        """All open orders of that id go."""
        same = self.by_oid.get(oid)
        if same is None:
            return False
        for order in list(same.values()) if isinstance(same, dict) else [same]:
            self._take(order, order[4])
        return True

    def _take(self, order: list, quantity: int) -> None:
        self.sides[order[6]].take(order, quantity)
        if not order[4]:
            self.open -= 1
            same = self.by_oid[order[1]]
            if isinstance(same, dict):
                del same[order[2]]
            if not isinstance(same, dict) or not same:
                del self.by_oid[order[1]]

    def orders(self):
        """Open orders, by id."""
        for same in self.by_oid.values():
            yield from same.values() if isinstance(same, dict) else (same,)

    @property
    def pool(self) -> dict[int, list]:
        """Open orders by arrival, looked up anew."""
        return {o[2]: o for o in sorted(self.orders(), key=lambda o: o[2])}

    def newest(self) -> int:
        """The latest time of an open order."""
        while self.times and not self.times[-1][4]:
            self.times.pop()
        fresh = [o[0] for o in self.fresh if o[4]]
        return max(fresh + [self.times[-1][0]] if self.times else fresh)

    def _settle(self) -> None:
        """Puts what a batch leaves open where its time belongs; most come after all others."""
        fresh, self.fresh = sorted(o for o in self.fresh if o[4]), []
        if fresh:
            at = bisect_left(self.times, fresh[0])
            self.times[at:] = sorted(self.times[at:] + fresh)
        if 4 * len(self.times) > 5 * self.open + 256:
            self.times = [o for o in self.times if o[4]]

    def levels(self) -> list[tuple[int | None, bool, int]]:
        return [(p, a, q) for a, side in self.sides.items() for p, q in side.total.items()]

    def price(self) -> tuple[int, int, int] | None:
        """(price, demand, supply) that trades most; then the least imbalance, the nearest to the last price, the lowest."""
        buy, sell = self.sides[False].total, self.sides[True].total
        demand, supply = sum(buy.values()), sell.get(None, 0)
        best = found = None
        for p in sorted({*buy, *sell} - {None}):  # going up, sellers join at p and buyers leave above it
            supply += sell.get(p, 0)
            merit = (min(demand, supply), -abs(demand - supply), 0 if self.last is None else -abs(p - self.last), -p)
            if best is None or merit > best:
                best, found = merit, (p, demand, supply)
            demand -= buy.get(p, 0)
        return found

    def clear(self) -> tuple[int, int, int, list[tuple]] | None:
        """(price, demand, supply, trades); None if there is no limit price.  Trades: (id, quantity, buyer, seller, buy oid, sell oid)."""
        if (found := self.price()) is None:
            self._settle()
            return None
        price, demand, supply = found
        open_, trades = min(demand, supply), []
        if open_:
            buyers, sellers = (self.sides[a].heads() for a in (False, True))
            x, y = next(buyers), next(sellers)
            while open_:
                quantity = min(x[4], y[4], open_)
                trades.append((self.trades, quantity, x[5], y[5], x[1], y[1]))
                self.trades += 1
                open_ -= quantity
                for order in (x, y):
                    self._take(order, quantity)
                if open_:
                    x = x if x[4] else next(buyers)
                    y = y if y[4] else next(sellers)
            self.last = price
        self._settle()
        return price, demand, supply, trades

    def best_unfilled(self) -> tuple[int | None, int | None]:
        return tuple(self.sides[a].keenest() for a in (False, True))

    def resting(self):
        for is_ask, side in self.sides.items():
            last = [None] if None in side.orders else []
            for p in side.limits() + last:
                for ts, oid, _, limit, left, user, _ in sorted(o for o in side.orders[p] if o[4]):
                    yield is_ask, limit, ts, oid, user, left, limit is None


class Replay:
    """Both engines of one coin and the clock of its batches; rows gather in out until taken."""

    def __init__(self, coin: str, width: int, engines: tuple[str, ...] = ("cda", "fba"), books: bool = True):
        self.coin, self.width, self.books = coin, width, books
        self.cda = Continuous() if "cda" in engines else None
        self.fba = Batch() if "fba" in engines else None
        self.opened: int | None = None
        self.batch = 0
        self.last_ts: int | None = None
        self.out: dict[str, list[tuple]] = {"trade": [], "batch": [], "book": []}
        self._watch()

    def _watch(self) -> None:
        if self.cda is not None and self.books:
            for side in self.cda.sides.values():
                side.moves = ([], [])

    def columns(self, kind: str) -> dict | None:
        """What has gathered of a kind, by column, which is then let go; None if nothing has."""
        rows, self.out[kind] = self.out[kind], []
        if not rows:
            return None
        cols = list(zip(*rows, strict=True))
        if kind != "book":
            return dict(zip(names(_KINDS[kind]), cols, strict=True))
        seq, ts, bid, ask, *sizes, bids_moved, asks_moved, spent = cols
        mids = [b if a is None else a if b is None else (a + b) // 2 for b, a in zip(bid, ask, strict=True)]
        mid, told = np.array([m or 0 for m in mids], np.int64), np.array([bool(m) for m in mids])
        out = {"coin": [self.coin] * len(seq), "seq": seq, "ts": ts, "best_bid": bid, "best_ask": ask, **dict(zip(("best_bid_qty", "best_ask_qty", "bid_depth", "ask_depth"), sizes, strict=True))}
        for is_ask, ends in ((False, bids_moved), (True, asks_moved)):
            side = self.cda.sides[is_ask]
            for n, c in zip(DEPTHS[is_ask::2], schedules(side.total, *side.moves, np.array(ends), mid, told).T, strict=True):
                out[n] = c
        self._watch()
        return out | {"compute_ns": spent}

    def record(self, seq, ts, oid, is_ask, limit, quantity, user, live, cancel) -> None:
        self.last_ts = ts
        if self.opened is None:
            self.opened = ts
        while ts >= self.opened + self.width:
            self._close(self.opened + self.width)
            self.opened += self.width
            if self.fba is None or not self.fba.open:  # nothing can clear until the batch of ts
                skip = (ts - self.opened) // self.width
                self.batch += skip
                self.opened += skip * self.width
        if self.fba is not None:
            if live:
                self.fba.submit(ts, oid, is_ask, limit, quantity, user)
            elif cancel:
                self.fba.cancel(oid)
        if self.cda is None:
            return
        cda = self.cda
        began = time.perf_counter_ns() if self.books else 0
        if live:
            bids, asks = cda.sides[False], cda.sides[True]
            bid, ask = bids.best(), asks.best()
            fills = cda.submit(ts, oid, is_ask, limit, quantity, user)
            if fills:
                mid = bid if ask is None else ask if bid is None else (bid + ask) // 2
                coin, trades = self.coin, self.out["trade"]
                for n, price, q, other, who in fills:
                    if is_ask:
                        trades.append((coin, "cda", n, seq, price, q, who, user, other, oid, ts, mid, True))
                    else:
                        trades.append((coin, "cda", n, seq, price, q, user, who, oid, other, ts, mid, False))
        elif cancel:
            cda.cancel(oid)
        if self.books:
            spent = time.perf_counter_ns() - began
            self.out["book"].append((seq, ts, *cda.touch(), len(cda.sides[False].moves[0]), len(cda.sides[True].moves[0]), spent))

    def _close(self, ts: int) -> None:
        batch, fba = self.batch, self.fba
        self.batch += 1
        if fba is None or not fba.open:
            return
        levels, orders, newest = fba.levels(), fba.open, fba.newest()
        flow = sum(-q if a else q for _, a, q in levels)
        was = fba.last
        began = time.perf_counter_ns()
        got = fba.clear()
        spent = time.perf_counter_ns() - began
        if got is None:
            self.out["batch"].append((self.coin, batch, ts, self.opened, None, 0, 0, flow, 0, 0, *fba.best_unfilled(), *(0,) * 6, orders, spent))
            return
        price, d, s, trades = got
        for n, q, buyer, seller, b, a in trades:
            self.out["trade"].append((self.coin, "fba", n, None, price, q, buyer, seller, b, a, newest, was, None))
        depth = bands(price, ((price if p is None else p, a, q) for p, a, q in levels))
        self.out["batch"].append((self.coin, batch, ts, self.opened, price, d, s, flow, sum(t[1] for t in trades), abs(d - s), *fba.best_unfilled(), *depth, orders, spent))

    def finish(self) -> None:
        """Clears the batch that is still open, at the last record's time."""
        if self.opened is not None:
            self._close(max(self.last_ts, self.opened))

    def resting(self, engine: str):
        for r in (self.cda if engine == "cda" else self.fba).resting():
            yield (self.coin, *r)


_KINDS = {"trade": TRADES, "batch": BATCHES, "book": BOOKS}


def tagged_schema(kinds: tuple[str, ...] = ("trade", "batch", "book", "resting")) -> str:
    """One wide row for trades, batches, books and (at the end) resting orders; ``kind`` says which."""
    cols: dict[str, str] = {}
    for kind in kinds:
        cols |= dict(c.split() for c in _KINDS.get(kind, RESTING).split(", "))
    return "kind string, " + ", ".join(f"{k} {v}" for k, v in cols.items())


_CHUNK = 10_000


def _to_batches(kind: str, cols: dict, want: pa.Schema):
    n = len(cols["coin"])
    cols = {f.name: pa.array(cols[f.name], f.type) for f in want if f.name in cols} | {"kind": pa.array([kind] * n)}
    whole = pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in want], schema=want)
    for at in range(0, n, _CHUNK):
        yield whole.slice(at, _CHUNK)


def taken(replay: Replay, want: pa.Schema, kinds: tuple[str, ...] = tuple(_KINDS), final: tuple[str, ...] = ()):
    """Record batches of what has gathered of some kinds, and of the open orders of some engines."""
    for kind in _KINDS:
        if kind not in kinds:
            replay.out[kind] = []
        elif cols := replay.columns(kind):
            yield from _to_batches(kind, cols, want)
    for engine in final:
        if rows := list(replay.resting(engine)):
            yield from _to_batches(f"resting_{engine}", dict(zip(names(RESTING), zip(*rows, strict=True), strict=True)), want)


_INPUT = ("coin", "seq", "ts", "oid", "is_ask", "limit", "orig_sz", "user_id", "live", "cancel")


def prepared(events: DataFrame) -> DataFrame:
    """What the engines read of a record."""
    return events.where(classify.has_size()).select(
        "coin", "seq", "ts", "oid", "is_ask", classify.limit_price().alias("limit"), "orig_sz", "user_id", classify.is_new_live().alias("live"), classify.is_cancellation().alias("cancel")
    )


def _listed(column: pa.Array) -> list:
    """to_pylist(), by numpy where a column has numbers."""
    if pa.types.is_integer(column.type):
        out = column.fill_null(0).to_numpy().tolist()
        if column.null_count:
            for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
                out[i] = None
        return out
    if pa.types.is_boolean(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_string(column.type):
        column = column.dictionary_encode()
        names = [*map(sys.intern, column.dictionary.to_pylist()), None]  # an open order's user is held once
        return [names[i] for i in column.indices.fill_null(len(names) - 1).to_numpy().tolist()]
    return column.to_pylist()


def replay(events: DataFrame, width: int, engines: tuple[str, ...] = ("cda", "fba"), books: bool = True, resting: bool = False, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Tagged rows of the replay of every coin (see tagged_schema); of some kinds only, if named.

    Every record moves the clock, so all are read, by each engine on its own.
    """
    kinds = kinds or ("trade", *["batch"] * ("fba" in engines), *["book"] * (books and "cda" in engines), *["resting"] * resting)
    schema = tagged_schema(kinds)
    want = arrow(schema)

    def run(batches):
        gc.disable()  # nothing here refers to itself, and every look at the open orders takes long
        now: Replay | None = None
        engine = None
        for batch in batches:
            cols = [_listed(batch.column(c)) for c in ("engine", *_INPUT)]
            for of, coin, *rest in zip(*cols, strict=True):
                if now is None or coin != now.coin or of != engine:
                    if now is not None:
                        now.finish()
                        yield from taken(now, want, kinds, (engine,) * resting)
                    now, engine = Replay(coin, width, (of,), books), of
                now.record(*rest)
            if now is not None:
                yield from taken(now, want, kinds)
        if now is not None:
            now.finish()
            yield from taken(now, want, kinds, (engine,) * resting)

    each = prepared(events).withColumn("engine", F.explode(F.array(*map(F.lit, engines))))
    return each.repartition("engine", "coin").sortWithinPartitions("engine", "coin", "seq").mapInArrow(run, schema)


def of_kind(tagged: DataFrame, kind: str) -> DataFrame:
    """The rows of a kind with its own columns: trade, batch, book, resting_cda or resting_fba."""
    return tagged.where(F.col("kind") == kind).select(*names(_KINDS.get(kind, RESTING)))


__all__ = ["Batch", "Continuous", "DEPTHS", "Replay", "of_kind", "replay", "tagged_schema"]
