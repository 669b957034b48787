"""Codes and schemas of the tick data model."""

from __future__ import annotations

# Event kinds, flags, venues, instruments and price decimals of the data model.
BID_SET, ASK_SET, TRADE, SNAP_BEGIN, SNAP_BID, SNAP_ASK, SNAP_END, CHECKSUM, HEARTBEAT, GAP, CLEAR = range(1, 12)
KIND_NAMES = {1: "BidSet", 2: "AskSet", 3: "Trade", 4: "SnapBegin", 5: "SnapBid", 6: "SnapAsk", 7: "SnapEnd", 8: "Checksum", 9: "Heartbeat", 10: "Gap", 11: "Clear"}
TAKER_SELL, FROM_SNAPSHOT, SYNTHETIC = 1, 2, 4
VENUES = {1: "coinbase", 2: "binance", 3: "kraken"}
BASES = ("BTC", "ETH", "SOL", "XRP", "DOGE")
PAIR_DECIMALS = {11: (1, 8), 12: (2, 8), 13: (2, 8), 14: (5, 8), 15: (7, 8)}
SCALE = 100_000_000

#: The order of ticks: time, then place in the source.
ORDER = ("recv_mono", "event_id", "sub")

TICK = (
    "recv_mono bigint, recv_wall bigint, venue_ts bigint, venue_seq bigint, price bigint, qty bigint, aux bigint, "
    "instrument int, kind int, venue int, flags int, event_id bigint, sub int"
)
TICK_COLUMNS = tuple(part.split()[0] for part in TICK.split(", "))
