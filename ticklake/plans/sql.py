"""SQL of the tick projection and of shared steps, for the statements beside the plans."""

TICKS = """
WITH base AS (
  SELECT event_id, epoch_us(ts) * 1000 AS wall, CAST(user_id % 15 + 1 AS INTEGER) AS instrument, event_type,
         CAST(round(value * 100) AS BIGINT) * 1000000 AS q, CAST(props->>'$.k' AS BIGINT) AS k
  FROM events),
x AS (SELECT *, CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'purchase' THEN 3
   WHEN event_type = 'signup' AND k < 30 THEN 100 WHEN event_type = 'signup' AND k < 40 THEN 4 WHEN event_type = 'signup' THEN 8
   WHEN k < 10 THEN 11 WHEN k < 20 THEN 10 ELSE 9 END AS kk FROM base),
y AS (SELECT *, CAST(unnest(CASE WHEN kk = 100 THEN range(0, 8) ELSE [0] END) AS INTEGER) AS sub FROM x),
tick AS (SELECT wall - 1704067200000000000 AS recv_mono, wall AS recv_wall, wall - k * 1000000 AS venue_ts, event_id AS venue_seq,
  CASE WHEN kk = 1 THEN (1000 - k % 10) * 100000000::BIGINT WHEN kk = 2 THEN (1001 + k % 10) * 100000000::BIGINT WHEN kk = 3 THEN 1000 * 100000000::BIGINT
       WHEN kk = 100 AND sub BETWEEN 1 AND 3 THEN (1000 - (k + sub) % 10) * 100000000::BIGINT
       WHEN kk = 100 AND sub BETWEEN 4 AND 6 THEN (1001 + (k + sub) % 10) * 100000000::BIGINT ELSE 0::BIGINT END AS price,
  CASE WHEN kk IN (1, 2) AND k % 7 = 0 THEN 0::BIGINT WHEN kk IN (1, 2, 3) THEN q WHEN kk = 100 AND sub BETWEEN 1 AND 6 THEN q + sub * 100000000::BIGINT ELSE 0::BIGINT END AS qty,
  event_id AS aux, instrument,
  CAST(CASE WHEN kk <> 100 THEN kk WHEN sub = 0 THEN 4 WHEN sub <= 3 THEN 5 WHEN sub <= 6 THEN 6 ELSE 7 END AS INTEGER) AS kind,
  CAST((instrument - 1) // 5 + 1 AS INTEGER) AS venue,
  CAST(CASE WHEN kk = 3 AND k % 2 = 1 THEN 1 WHEN kk = 100 THEN 2 ELSE 0 END AS INTEGER) AS flags, event_id, sub
  FROM y),
inst AS (SELECT CAST(i AS INTEGER) AS instrument, CAST((i - 1) // 5 + 1 AS INTEGER) AS venue, b || CASE (i - 1) // 5 WHEN 0 THEN '-USD' WHEN 1 THEN 'USDT' ELSE '/USD' END AS venue_symbol, b || '-USD' AS canonical
  FROM (SELECT i, ['BTC', 'ETH', 'SOL', 'XRP', 'DOGE'][CAST((i - 1) % 5 + 1 AS INTEGER)] AS b FROM range(1, 16) t(i))),
decimals AS (SELECT * FROM (VALUES (11, 1, 8), (12, 2, 8), (13, 2, 8), (14, 5, 8), (15, 7, 8)) d(instrument, price_decimals, qty_decimals)),
ask AS (SELECT event_id AS qid, CAST((event_id // 50) % 15 + 1 AS INTEGER) AS instrument, epoch_us(ts) * 1000 - 1704067200000000000 AS t FROM events WHERE event_id % 50 = 0)
"""

STATE = TICKS + """
, placed AS (SELECT *, row_number() OVER w AS place FROM tick WINDOW w AS (PARTITION BY instrument ORDER BY recv_mono, event_id, sub)),
marked AS (SELECT *, max(CASE WHEN kind IN (4, 10, 11) THEN place END) OVER b AS reset_place, max(CASE WHEN kind = 7 THEN place END) OVER b AS end_place,
  count(CASE WHEN kind IN (4, 11) THEN 1 END) OVER u AS epoch
  FROM placed WINDOW b AS (PARTITION BY instrument ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY instrument ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stated AS (SELECT m.*, CASE WHEN r.kind IS NULL OR r.kind <> 4 THEN 'Unsynced' WHEN m.end_place > m.reset_place THEN 'Synced' ELSE 'Filling' END AS sync_state
  FROM marked m LEFT JOIN placed r ON r.instrument = m.instrument AND r.place = m.reset_place),
state AS (SELECT *, (kind IN (1, 2) AND sync_state = 'Synced') OR (kind IN (5, 6) AND sync_state = 'Filling') AS effective,
  CASE WHEN kind IN (1, 5) THEN 'B' WHEN kind IN (2, 6) THEN 'A' END AS side FROM stated)
"""

INDEX = """
, control AS (SELECT *, lag(kind) OVER w AS bk, lag(recv_mono) OVER w AS mono, lag(event_id) OVER w AS be, lag(sub) OVER w AS bs FROM tick WHERE kind IN (4, 7, 11) WINDOW w AS (PARTITION BY instrument ORDER BY recv_mono, event_id, sub)),
idx AS (SELECT instrument, mono, be AS event_id, bs AS sub FROM control WHERE kind = 7 AND bk = 4)
"""

#: Levels at each question: per query, by a rescan of the instrument's epoch.
LEVELS = STATE + """
, question AS (SELECT q.*, (SELECT max(epoch) FROM state s WHERE s.instrument = q.instrument AND s.recv_mono <= q.t AND s.kind IN (4, 11)) AS epoch FROM ask q),
level AS (SELECT q.qid, q.instrument, q.t, s.side, s.price, arg_max(s.qty, s.place) AS qty FROM question q JOIN state s ON s.instrument = q.instrument AND s.epoch = q.epoch AND s.recv_mono <= q.t
  WHERE s.effective GROUP BY ALL),
book AS (SELECT * FROM level WHERE qty <> 0)
"""

#: The table of CRC-32 by its rule, for statements that sum bytes up.
CRC = """WITH RECURSIVE crc_bit(i, c, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bit WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bit WHERE k = 8)"""


def crc_steps(source: str) -> str:
    """Steps that give ``done`` (id, crc) of the ASCII texts of ``source`` (id, x)."""
    return (
        f"crc_step(id, x, p, c) AS (SELECT id, x, 1, 4294967295::BIGINT FROM {source} UNION ALL SELECT id, x, p + 1, xor(c >> 8, t[CAST(xor(c, ascii(substr(x, p, 1))) & 255 AS INTEGER) + 1]) FROM crc_step, crc_table WHERE p <= length(x)), "
        "done AS (SELECT id, xor(c, 4294967295) AS crc FROM crc_step WHERE p = length(x) + 1)"
    )
