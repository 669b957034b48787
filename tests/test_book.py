"""Books: the golden corpus, and the closed form against an independent state machine."""

import random

from ticklake.operators import book
from ticklake.schema import TICK

# fixed values: the golden corpus (mono, instrument, kind, price, qty)
GOLDEN = [
    (100, 1, 4, 0, 0), (101, 1, 5, 10000, 5), (102, 1, 6, 10100, 4), (103, 1, 7, 0, 0), (105, 2, 4, 0, 0), (106, 2, 5, 5000, 5), (107, 2, 6, 5100, 5), (108, 2, 7, 0, 0),
    (110, 1, 1, 10000, 7), (115, 3, 3, 777, 1), (120, 1, 3, 10050, 2), (150, 2, 2, 5100, 3), (200, 1, 4, 0, 0), (201, 1, 5, 10200, 1), (202, 1, 6, 10300, 2), (203, 1, 7, 0, 0),
    (250, 2, 11, 0, 0), (260, 2, 4, 0, 0), (261, 2, 5, 5200, 2), (262, 2, 7, 0, 0), (300, 1, 1, 10200, 9), (500, 1, 4, 0, 0), (510, 1, 5, 9000, 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(m, m + 1000, m + 2000, m, p, q, 0, i, k, 1, 0, n, 0) for n, (m, i, k, p, q) in enumerate(rows)], TICK)


def test_golden_points(spark):
    ticks = frame(spark, GOLDEN)
    asked = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate([(1, 104), (1, 110), (1, 600), (2, 255), (2, 600), (3, 600), (1, 50)])], "qid bigint, instrument int, t bigint")
    top = {r.qid: ((r.bid, r.bid_qty), (r.ask, r.ask_qty)) for r in book.tops(book.levels_at(asked, ticks)).collect()}
    assert top == {0: ((10000, 5), (10100, 4)), 1: ((10000, 7), (10100, 4)), 2: ((9000, 1), (None, None)), 4: ((5200, 2), (None, None))}
    from pyspark.sql import functions as F

    anchor = {r.qid: r.found for r in book.asof(asked, book.snapshot_index(ticks), "mono", ["event_id", "sub"], F.col("mono")).collect()}
    assert anchor == {0: 100, 1: 100, 2: 200, 3: 105, 4: 260, 5: None, 6: None}


def machine(rows, cap=None):
    """Book of one instrument by plain state transitions."""
    state, sides, dropped = "Unsynced", {"B": {}, "A": {}}, 0
    for _, _, kind, price, qty in rows:
        if kind in (1, 2, 5, 6):
            if state != ("Synced" if kind < 3 else "Filling"):
                dropped += 1
                continue
            side = sides["B" if kind in (1, 5) else "A"]
            if qty:
                side[price] = qty
                if cap and len(side) > cap:
                    del side[min(side) if kind in (1, 5) else max(side)]
            else:
                side.pop(price, None)
        elif kind == 4:
            sides, state = {"B": {}, "A": {}}, "Filling"
        elif kind == 7:
            if state == "Filling":
                state = "Synced"
            else:
                dropped += 1
        elif kind == 11:
            sides, state = {"B": {}, "A": {}}, "Unsynced"
        elif kind == 10:
            state = "Unsynced"
    return sides, dropped


def streams(n, seed):
    rnd = random.Random(seed)
    rows = []
    for instrument in range(1, n + 1):
        for m in range(120):
            kind = rnd.choice([1, 1, 1, 2, 2, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 10, 11])
            rows.append((m, instrument, kind, rnd.randint(1, 39) * 100, rnd.randint(0, 4) * 7))
    return rows


def test_closed_form_equals_machine(spark):
    rows = streams(30, 5)
    ticks = frame(spark, rows)
    asked = spark.createDataFrame([(i, i, 1000) for i in range(1, 31)], "qid bigint, instrument int, t bigint")
    got = {(r.qid, r.side, r.price): r.qty for r in book.levels_at(asked, ticks).collect()}
    want, dropped = {}, {}
    for i in range(1, 31):
        sides, dropped[i] = machine([r for r in rows if r[1] == i])
        want |= {(i, s, p): q for s, levels in sides.items() for p, q in levels.items()}
    assert got == want
    from pyspark.sql import functions as F

    lost = {r.instrument: r.n for r in book.with_state(ticks).groupBy("instrument").agg(F.count_if(book.outcome() == "Dropped").alias("n")).collect()}
    assert lost == dropped


def test_capped_fold_equals_machine(spark):
    rows = streams(10, 9)
    last = {}
    for r in book.fold(frame(spark, rows), cap=3).collect():
        last[r.instrument] = max(last.get(r.instrument, ((-1,), None)), ((r.event_id,), (r.bid, r.bid_qty, r.ask, r.ask_qty)))
    for i, ((event,), top) in last.items():
        sides, _ = machine([r for n, r in enumerate(rows) if r[1] == i and n <= event], cap=3)
        bid, ask = max(sides["B"], default=None), min(sides["A"], default=None)
        assert top == (bid, sides["B"].get(bid), ask, sides["A"].get(ask))
