"""Scalar functions as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticklake.schema import SCALE

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Tokens whose whole part fits into a bigint, without an exponent.
_PLAIN = r"^[+-]?(?:[0-9]{1,18}(?:\.[0-9]*)?|\.[0-9]+)$"


def parse_fixed(text: Column) -> Column:
    """Mantissa at 1e-8 of a decimal token, exactly; null if it is malformed, too large or
    finer than 1e-8.  Plain tokens are cut at the dot into two integers; exponents and long
    whole parts take the general way, which is evaluated for them alone."""
    return F.when(text.rlike(_PLAIN), _parse_plain(text)).when(text.rlike(_NUMBER), _parse_any(text))


def _parse_plain(text: Column) -> Column:
    whole = F.coalesce(F.substring_index(text, ".", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    fraction = F.when(F.instr(text, ".") > 0, F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))).otherwise(F.lit(""))
    part = F.rpad(fraction, 8, "0").try_cast("bigint")
    signed = F.when(text.startswith("-"), -part).otherwise(part)
    return F.when(F.length(fraction) <= 8, F.try_add(F.try_multiply(whole, F.lit(SCALE)), signed))


def _parse_any(text: Column) -> Column:
    """Digits moved as text: sign, digits without the dot, and an exponent that counts the fraction."""
    body = F.regexp_replace(text, r"^[+-]|[eE].*$", "")
    exponent = F.coalesce(F.try_to_number(F.regexp_extract(text, r"[eE]\+?(-?[0-9]{1,4})$", 1), F.lit("S9999")).cast("int"), F.lit(0))
    fraction = F.length(F.regexp_extract(body, r"\.([0-9]*)$", 1))
    digits = F.regexp_replace(F.regexp_replace(body, r"\.", ""), r"^0+", "")
    trimmed = F.regexp_replace(digits, r"0+$", "")
    zeros = F.length(digits) - F.length(trimmed)
    shift = F.lit(8) + exponent - fraction + zeros
    whole = F.when(trimmed == "", F.lit("0")).when((shift >= 0) & (F.length(trimmed) + shift <= 19), F.concat(trimmed, F.repeat(F.lit("0"), F.greatest(shift, F.lit(0)).cast("int"))))
    value = F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), whole)
    return value.try_cast("bigint")


def format_fixed(mantissa: Column) -> Column:
    """Shortest exact decimal text of a mantissa at 1e-8."""
    wide = mantissa.cast("decimal(20,0)")
    size = F.abs(wide).cast("string")
    padded = F.lpad(size, F.greatest(F.length(size), F.lit(9)), F.lit("0"))
    whole, part = F.substring(padded, F.lit(1), F.length(padded) - 8), F.regexp_replace(F.right(padded, F.lit(8)), "0+$", "")
    return F.concat(F.when(mantissa < 0, F.lit("-")).otherwise(F.lit("")), whole, F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))


def fixed_to_double(mantissa: Column) -> Column:
    return mantissa.cast("double") / SCALE


_RFC3339 = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt]([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])(\.([0-9]{1,9}))?[Zz]$"


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of a strict UTC timestamp text; null if it is not one."""
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = [F.substring(text, at, 2).try_cast("bigint") for at in (12, 15, 18)]
    nanos = F.rpad(F.regexp_extract(text, _RFC3339, 8), 9, "0").try_cast("bigint")
    seconds = days * 86_400 + clock[0] * 3_600 + clock[1] * 60 + clock[2]
    return F.when(text.rlike(_RFC3339) & day.isNotNull() & (days >= 0), F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000)), nanos))


def taker_side(venue: Column, side: Column) -> Column:
    """1 if the taker sold: the first venue names the maker's side, the second says whether
    the buyer was the maker, the third names the taker's side.  Null for any other word."""
    sold = F.when(venue == 1, "buy").when(venue == 2, "true").otherwise("sell")
    bought = F.when(venue == 1, "sell").when(venue == 2, "false").otherwise("buy")
    return F.when(side == sold, 1).when(side == bought, 0).cast("int")


def crc_digits(mantissa: Column, decimals: Column) -> Column:
    """Digits of a level for the book checksum: scaled, without dot or leading zeros."""
    unit = F.pow(F.lit(10.0), F.lit(8) - decimals).cast("bigint")
    value = F.call_function("div", mantissa, unit)
    return F.when(value == 0, F.lit("")).otherwise(value.cast("string"))


def zigzag(delta: Column) -> Column:
    return F.shiftleft(delta, 1).bitwiseXOR(F.shiftright(delta, 63))


def varint_len(value: Column) -> Column:
    """Bytes of an unsigned LEB128 number held in a non-negative bigint."""
    bits = F.length(F.regexp_replace(F.bin(value), "^0+", ""))
    return F.greatest(F.lit(1), F.ceil(bits / 7)).cast("int")


def put_uvarint(value: Column) -> Column:
    """Unsigned LEB128 bytes of a non-negative bigint."""
    groups = F.sequence(F.lit(0), varint_len(value) - 1)
    octet = lambda g: F.call_function("shiftright", value, (g * 7).cast("int")).bitwiseAND(127) + F.when(g < varint_len(value) - 1, 128).otherwise(0)
    return F.unhex(F.array_join(F.transform(groups, lambda g: F.lpad(F.hex(octet(g)), 2, "0")), ""))


def take_uvarint(data: Column) -> Column:
    """The bigint of LEB128 bytes; null if they end early, go on too long or overflow."""
    size = F.length(data)
    octet = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("bigint")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), octet)
    whole = (size >= 1) & (size <= 9) & F.forall(F.slice(groups, F.lit(1), size - 1), lambda g: g >= 128) & (F.element_at(groups, -1) < 128)
    value = F.aggregate(F.reverse(groups), F.lit(0).cast("bigint"), lambda done, g: done * 128 + g.bitwiseAND(127))
    return F.when(whole, value)


def unzigzag(value: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, F.lit(1)).bitwiseXOR(-value.bitwiseAND(1))


def sql_quote(text: Column) -> Column:
    """A text as a SQL literal: quotes doubled, within quotes."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def wsname(name: Column) -> Column:
    """New to old symbols, part by part."""
    return F.array_join(F.transform(F.split(name, "/"), lambda p: F.when(p == "BTC", F.lit("XBT")).when(p == "DOGE", F.lit("XDG")).otherwise(p)), "/")


def to_unix_sec(n: Column) -> Column:
    """Seconds from an epoch number of unknown unit, judged by its size."""
    n = n.cast("double")
    return F.when(n <= 0, F.lit(0.0)).when(n >= 1e17, n / 1e9).when(n >= 1e14, n / 1e6).when(n >= 1e11, n / 1e3).otherwise(n)


def is_headline(key: Column) -> Column:
    """Whether a metric is shown first.  Fixed values: the parts of names that are."""
    return F.lower(key).rlike(r"msgs_per_s|events_per_s|multiplier|bytes_per_event|gb_per_s|total_added|(^|[._])(p50|p90|p99|p999)([._]|$)")


def unit_for(key: Column) -> Column:
    """Display unit of a metric name: by what it contains, else its last unit word."""
    # fixed values: parts of names and unit words with the units they stand for
    k = F.lower(key)
    named = [("msgs_per_s", "msgs/s"), ("events_per_s", "events/s"), ("gb_per_s", "GB/s"), ("bytes_per_event", "B/event"), ("multiplier", "x")]
    out = None
    for part, unit in named:
        out = (F.when if out is None else out.when)(k.contains(part), unit)
    words = {"ns": "ns", "us": "us", "ms": "ms", "s": "s", "mb": "MB", "gb": "GB", "bytes": "bytes", "pct": "%"}
    units = F.filter(F.split(k, "[._]"), lambda w: w.isin(*words))
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return out.otherwise(F.coalesce(table[F.try_element_at(units, F.lit(-1))], F.lit("")))


def quote_numbers(payload: Column) -> Column:
    """Quote bare price and quantity tokens, so that their digits reach the parser."""
    return F.regexp_replace(payload, r'"(price|qty)":(\s*)([-+0-9.eE]+)', '"$1":$2"$3"')
