"""Hand-computed scenarios and randomised comparisons of the two engines."""

import random

import pytest

from batchtide.operators.replay import Batch, Continuous, Replay
from batchtide.schemas import BOOKS, names

SF = "/root/testdata/sf0.001"
BOOK_COLUMNS = names(BOOKS)[3:-1]


def cda(*orders):
    """Orders (side, price or None, quantity); gives (book, fills as (price, quantity))."""
    book, fills = Continuous(), []
    for i, (side, price, q) in enumerate(orders):
        fills += [(p, n) for _, p, n, _, _ in book.submit(i, i + 1, side == "sell", price, q, "u")]
    return book, fills


@pytest.mark.parametrize(
    ("orders", "want", "depths"),
    [
        ([("buy", 100, 10)], [], (10, 0)),
        ([("sell", 100, 10), ("buy", 100, 10)], [(100, 10)], (0, 0)),
        ([("sell", 100, 10), ("buy", 100, 4)], [(100, 4)], (0, 6)),
        ([("sell", 100, 3), ("sell", 100, 4), ("buy", 101, 10)], [(100, 3), (100, 4)], (3, 0)),
        ([("sell", 102, 5), ("sell", 100, 5), ("buy", 105, 5)], [(100, 5)], (0, 5)),
        ([("sell", 100, 10), ("buy", None, 10)], [(100, 10)], (0, 0)),
        ([("buy", None, 10)], [], (0, 0)),
        ([("buy", 100, 10), ("sell", 90, 4), ("sell", 105, 3)], [(100, 4)], (6, 3)),
    ],
)
def test_continuous(orders, want, depths):
    book, fills = cda(*orders)
    assert fills == want
    assert (book.sides[False].depth, book.sides[True].depth) == depths


def test_market_remainder_vanishes():
    book, _ = cda(("sell", 130, 6), ("buy", None, 6), ("buy", None, 3))
    assert book.filled / book.submitted == pytest.approx(0.8)


def test_time_priority_and_cancel():
    book, _ = cda(("buy", 100, 5), ("buy", 100, 5))
    assert book.submit(9, 9, True, 100, 5, "s")[0][3] == 1
    assert book.cancel(2) and not book.cancel(2) and not book.cancel(999)
    assert book.sides[False].depth == 0


def test_duplicate_oid_cancel_after_fill_is_noop():
    book = Continuous()
    for ts in (1, 2):
        book.submit(ts, 7, False, 100, 5, "u")
    book.submit(3, 8, True, 100, 5, "s")
    assert not book.cancel(7)
    assert book.sides[False].depth == 5


def fba(*orders, last=None):
    b = Batch()
    b.last = last
    for i, (side, price, q) in enumerate(orders):
        b.submit(i, i + 1, side == "sell", price, q, "u")
    return b, b.clear()


@pytest.mark.parametrize(
    ("orders", "last", "price", "quantities", "left"),
    [
        ([("buy", 100, 10), ("sell", 100, 10)], None, 100, [10], []),
        ([("buy", 105, 10), ("buy", 100, 10), ("buy", 100, 10), ("sell", 100, 15)], None, 100, [10, 5], [5, 10]),
        ([("sell", 100, 8), ("sell", 105, 20), ("buy", None, 12)], None, 105, [8, 4], [16]),
        ([("buy", 90, 10), ("sell", 100, 10)], None, 90, [], [10, 10]),
        ([("buy", 90, 10), ("sell", 100, 10)], 97, 100, [], [10, 10]),
        ([("buy", 100, 20), ("sell", 100, 12)], None, 100, [12], [8]),
    ],
)
def test_batch(orders, last, price, quantities, left):
    b, got = fba(*orders, last=last)
    assert got[0] == price
    assert [t[1] for t in got[3]] == quantities
    assert [o[4] for o in b.pool.values()] == left


def test_all_market_batch_does_not_clear():
    b, got = fba(("buy", None, 5), ("sell", None, 5), last=100)
    assert got is None and len(b.pool) == 2


def test_batch_cancel_takes_all_copies():
    b = Batch()
    for ts in (1, 2):
        b.submit(ts, 7, False, 100, 5, "u")
    assert b.cancel(7) and not b.pool and not b.cancel(7)


class NaiveBook:
    def __init__(self):
        self.rest = []

    def submit(self, ts, oid, ask, limit, q):
        out = []
        while q:
            can = [o for o in self.rest if o[2] != ask and (limit is None or (o[3] >= limit if ask else o[3] <= limit))]
            if not can:
                break
            best = min(can, key=lambda o: (-o[3] if ask else o[3], o[0], o[1]))
            n = min(q, best[4])
            out.append((best[3], n, best[1]))
            q -= n
            best[4] -= n
            self.rest = [o for o in self.rest if o[4]]
        if q and limit is not None:
            self.rest.append([ts, oid, ask, limit, q])
        return out


def test_continuous_against_full_scan():
    rng = random.Random(5)
    for _ in range(60):
        a, b = Continuous(), NaiveBook()
        ts = 100
        for oid in range(120):
            ts += rng.choice((0, 1, 1, 2, -1))
            if rng.random() < 0.2 and oid:
                gone = rng.randrange(oid)
                had = any(o[1] == gone for o in b.rest)
                assert a.cancel(gone) == had
                b.rest = [o for o in b.rest if o[1] != gone]
                continue
            ask, limit, q = rng.random() < 0.5, None if rng.random() < 0.18 else rng.randint(95, 105), rng.randint(1, 20)
            assert [(p, n, o) for _, p, n, o, _ in a.submit(ts, oid, ask, limit, q, "u")] == b.submit(ts, oid, ask, limit, q)
            for s in (False, True):
                assert a.sides[s].depth == sum(o[4] for o in b.rest if o[2] == s)


def test_batch_price_against_every_price():
    rng = random.Random(6)
    for _ in range(200):
        b = Batch()
        b.last = rng.choice((None, 97, 103))
        orders = [(rng.random() < 0.5, None if rng.random() < 0.18 else rng.randint(95, 105), rng.randint(1, 20)) for _ in range(rng.randint(1, 25))]
        for i, (ask, limit, q) in enumerate(orders):
            b.submit(i, i, ask, limit, q, "u")
        last = b.last
        got = b.clear()
        prices = sorted({p for _, p, _ in orders if p is not None})
        if not prices:
            assert got is None
            continue

        def at(p, orders=orders):
            d = sum(q for a, x, q in orders if not a and (x is None or x >= p))
            s = sum(q for a, x, q in orders if a and (x is None or x <= p))
            return d, s

        want = min(prices, key=lambda p: (-min(at(p)), abs(at(p)[0] - at(p)[1]), abs(p - last) if last is not None else 0, p))
        assert got[:3] == (want, *at(want))
        assert sum(t[1] for t in got[3]) == min(at(want))


def test_clock_closes_batches_and_skips_empty_ones():
    r = Replay("C", 10, ("fba",))
    r.record(0, 0, 1, False, 100, 5, "a", True, False)
    r.record(1, 35, 2, True, 100, 5, "b", True, False)
    assert [(x[1], x[2], x[3]) for x in r.out["batch"]] == [(0, 10, 0), (1, 20, 10), (2, 30, 20)]
    r.finish()
    assert r.out["batch"][-1][1:5] == (3, 35, 30, 100) and r.out["trade"][-1][10] == 35


def test_cancellations_in_a_deep_level_read_few_orders():
    # 20,000 orders at one price, cancelled from the back: a scan of the level would read 200 million
    book, read = Continuous(), [0]

    class Oid(int):
        def __eq__(self, other):
            read[0] += 1
            return int(self) == int(other)

        def __lt__(self, other):
            read[0] += 1
            return int(self) < int(other)

        __hash__ = int.__hash__

    for i in range(20_000):
        book.submit(1, Oid(i), False, 100, 1, "u")
    assert all(book.cancel(i) for i in reversed(range(1, 20_000)))
    assert read[0] < 2_000_000
    assert book.sides[False].depth == 1 and len(book.sides[False].levels[100]) < 4
    assert [f[3] for f in book.submit(2, 99_999, True, 100, 5, "s")] == [0]


def test_cancel_takes_the_first_copy_at_the_newest_price():
    book = Continuous()
    for ts, price in ((5, 100), (3, 100), (4, 90), (6, 100)):
        book.submit(ts, 7, False, price, ts, "u")
    assert book.cancel(7) and [r[2] for r in book.resting()] == [5, 6, 4]
    assert not book.cancel(7)
    book.submit(9, 7, False, 90, 9, "u")
    assert book.cancel(7) and [r[2] for r in book.resting()] == [5, 6, 9]


def test_book_rows_by_column_equal_each_record_s_own():
    rng = random.Random(8)
    for low, high in ((95, 105), (9_500, 10_500), (-3, 3)):
        r, want, got = Replay("C", 1_000, ("cda",)), [], []
        for i in range(1_500):  # more than a step of schedules()
            z = rng.random()
            r.record(i, i, rng.randrange(900), rng.random() < 0.5, None if rng.random() < 0.1 else rng.randint(low, high), rng.randint(1, 20), "u", z < 0.6, 0.6 <= z < 0.9)
            want.append((*r.cda.touch(), *r.cda.schedule()))
            if i in (3, 900):
                got += _books(r)
        assert got + _books(r) == want


def _books(r):
    c = r.columns("book")
    return [tuple(None if x is None else int(x) for x in row) for row in zip(*[c[n] for n in BOOK_COLUMNS], strict=True)]


def test_replay_gives_named_kinds_and_engines_tasks(spark):
    from batchtide.operators import replay as R
    from batchtide.sources.flow import order_flow

    flow = order_flow(spark, SF)
    d = R.replay(flow, 21_600 * 10**9, resting=True)
    only = R.replay(flow, 21_600 * 10**9, ("cda",), books=False, resting=True, kinds=("resting",))
    assert {r[0] for r in only.select("kind").distinct().collect()} == {"resting_cda"}
    both = {r["kind"]: r["count"] for r in d.groupBy("kind").count().collect()}
    assert set(both) == {"trade", "batch", "book", "resting_cda", "resting_fba"} and both["resting_cda"] == only.count()
    assert "price" in only.columns and "clearing_price" not in only.columns


def test_deep_batches_sort_only_what_trades():
    # 3,000 sellers at one price, one of them traded a batch: levels were sorted anew in each
    b, read = Batch(), [0]

    class Time(int):
        def __lt__(self, other):
            read[0] += 1
            return int(self) < int(other)

    for i in range(3_000):
        b.submit(Time(i), i, True, 100, 1, "s")
    for i in range(300):
        b.submit(Time(3_000 + i), 3_000 + i, False, 100, 1, "b")
        assert [t[5] for t in b.clear()[3]] == [i]
    assert read[0] < 100_000 and len(b.pool) == 2_700 == len(b.by_oid)


def test_an_open_order_is_held_once():
    import sys

    import pyarrow as pa

    from batchtide.operators.replay import Batch, _listed

    b = Batch()
    for at in range(0, 4000, 100):
        users = _listed(pa.array([f"user {i % 7}" for i in range(100)]))
        for i, who in zip(range(at, at + 100), users, strict=True):
            b.submit(10**18 - abs(i - 50), i, i % 2 == 1, int("1000000") + i % 2 * 1000, 5, who)
        b.clear()
    assert len(b.pool) == 4000 == len(list(b.resting()))
    assert len({id(o[5]) for o in b.pool.values()}) == 7 and len({id(o[3]) for o in b.pool.values()}) == 2
    assert sum(sys.getsizeof(x) for x in b.times) <= 4000 * sys.getsizeof(next(iter(b.pool.values()))) and all(x is b.pool[x[2]] for x in b.times)
    for i in range(4000):
        assert i % 1000 or b.newest() == max(o[0] for o in b.pool.values())
        b.cancel(i)
    assert not b.pool and not b.by_oid
