"""Raw segments: round trip, torn tails, compressed files."""

import zstandard

from ticklake.sources import segments

ROWS = [(1, 10, 1000, b'{"a":1}'), (3, 11, 1001, b""), (4, 12, 1002, "é".encode())]


def test_round_trip_and_torn_tails(spark, tmp_path):
    whole = segments.encode(2, ROWS)
    assert segments.decode(whole) == (2, ROWS, len(whole), None)
    last = len(whole) - (25 + len(ROWS[-1][3]))
    for n, reason in ((1, "short record"), (len(whole) - last - 2, "short length")):
        assert segments.decode(whole[: len(whole) - n]) == (2, ROWS[:2], last, reason)
    broken = bytearray(whole)
    broken[-6] ^= 1
    assert segments.decode(bytes(broken))[1:] == (ROWS[:2], last, "bad checksum")
    assert segments.decode(b"")[3] == "short header"
    assert segments.decode(b"x" * 40)[3] == "not a segment"
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a-1.fbraw").write_bytes(bytes(broken))
    (tmp_path / "v/a-2.fbraw.zst").write_bytes(zstandard.compress(whole))
    files = segments.read_files(spark, str(tmp_path))
    assert sorted((r.recv_mono, bytes(r.payload)) for r in segments.records(files).collect()) == sorted([(m, p) for _, m, _, p in ROWS[:2]] + [(m, p) for _, m, _, p in ROWS])
    assert sorted((r.records, r.torn or "") for r in segments.report(files).collect()) == [(2, "bad checksum"), (3, "")]
