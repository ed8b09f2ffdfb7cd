"""Leaves of telemetry records as Column expressions: raw JSON text in, typed value or null out.

A leaf is the JSON text of one value, quotes and all. An unreadable leaf is null; it never fails a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts read as booleans.
TRUE_TEXTS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_TEXTS = ("0", "f", "F", "FALSE", "false", "False")
#: Temporalities by number and by enum name.
TEMPORALITY_NAMES = {"AGGREGATION_TEMPORALITY_UNSPECIFIED": 0, "AGGREGATION_TEMPORALITY_DELTA": 1, "AGGREGATION_TEMPORALITY_CUMULATIVE": 2}
DELTA, CUMULATIVE = 1, 2
MOST = 9223372036854775807


def text_leaf(raw: Column) -> Column:
    """The text inside a JSON string without escapes; null for other kinds."""
    return F.when(raw.rlike(r'^"[^"\\]*"$'), raw.substr(F.lit(2), F.length(raw) - 2))


def number_text(raw: Column) -> Column:
    """Digits of a number, or of a string that holds one."""
    return F.coalesce(text_leaf(raw), F.when(~raw.startswith('"'), raw))


def int_leaf(raw: Column) -> Column:
    """A base-10 64-bit integer, as a number or a string."""
    t = number_text(raw)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t).try_cast("bigint")


def float_leaf(raw: Column) -> Column:
    """A finite double, as a number or a string; in a string also with hexadecimal digits and a binary exponent."""
    t = number_text(raw)
    hexadecimal = r"^([+-]?)0[xX]([0-9a-fA-F]*)\.?([0-9a-fA-F]*)[pP]([+-]?[0-9]{1,4})$"
    whole, part = F.regexp_extract(text_leaf(raw), hexadecimal, 2), F.regexp_extract(text_leaf(raw), hexadecimal, 3)
    digits = F.concat(whole, part)
    power = F.regexp_extract(text_leaf(raw), hexadecimal, 4).try_cast("int") - 4 * F.length(part)
    binary = F.conv(digits, 16, 10).try_cast("double") * F.pow(F.lit(2.0), power) * F.when(F.regexp_extract(text_leaf(raw), hexadecimal, 1) == "-", -1).otherwise(1)
    of_hex = F.when(text_leaf(raw).rlike(hexadecimal) & F.length(digits).between(1, 15), binary)
    d = F.coalesce(of_hex, F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t).try_cast("double"))
    return F.when(F.abs(d) <= 1.7976931348623157e308, d)


def nanos_leaf(raw: Column) -> Column:
    """Nanoseconds since 1970; 0 is absent."""
    return F.nullif(int_leaf(raw), F.lit(0).cast("bigint"))


def bool_leaf(raw: Column) -> Column:
    t = number_text(raw)
    return F.when(t.isin(*TRUE_TEXTS), True).when(t.isin(*FALSE_TEXTS), False)


def count_gate(as_double: Column, as_int: Column) -> Column:
    """'ok', 'not_a_count' or 'unreadable'. A readable double decides: its range failure doesn't fall back to the integer."""
    d, i = float_leaf(as_double), int_leaf(as_int)
    r = F.round(d)
    whole = F.when((r < 0) | (r >= 9.223372036854775807e18) | ((r == 0) & (d <= -0.5)), "not_a_count").otherwise("ok")
    return F.when(d.isNotNull(), whole).when(i < 0, "not_a_count").when(i.isNotNull(), "ok").otherwise("unreadable")


def count_leaf(as_double: Column, as_int: Column) -> Column:
    """The count, rounded half away from zero; null unless its gate is 'ok'."""
    d = float_leaf(as_double)
    return F.when(count_gate(as_double, as_int) == "ok", F.when(d.isNotNull(), F.round(d).try_cast("bigint")).otherwise(int_leaf(as_int)))


def temporality(raw: Column) -> Column:
    """The declared number, -1 if absent, -2 if unreadable."""
    named = reduce(lambda c, x: c.when(text_leaf(raw) == x[0], x[1]), TEMPORALITY_NAMES.items(), F.when(raw.isNull() | (raw == "null"), -1))
    return named.otherwise(F.coalesce(int_leaf(raw), F.lit(-2)))


def event_name(body: Column, attribute: Column, namespace: str = "claude_code") -> Column:
    """A non-empty body decides: kept if it has the namespace, else no name. Otherwise the attribute, with the namespace put before it once."""
    prefix = f"{namespace}."
    short = F.when(attribute.startswith(prefix), attribute.substr(F.lit(len(prefix) + 1), F.length(attribute))).otherwise(attribute)
    return F.when(F.coalesce(body, F.lit("")) != "", F.when(body.startswith(prefix), body)).when(F.coalesce(short, F.lit("")) != "", F.concat(F.lit(prefix), short))


def rfc3339_nanos(ns: Column) -> Column:
    """UTC time with the nanoseconds' trailing zeros cut; empty for null."""
    fraction = F.rtrim(F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("0"))
    # whole seconds by exact subtraction first: a quotient of doubles may round a late nanosecond up
    seconds = F.round(F.try_subtract(ns, F.pmod(ns, F.lit(1_000_000_000))) / 1_000_000_000).cast("bigint")
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.concat(whole, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z")), F.lit(""))


def saturating_sum(value: Column) -> Column:
    """Sum of non-negative longs, held at the largest long."""
    return F.least(F.sum(value.cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")


def round2(x: Column) -> Column:
    """Half away from zero at two decimals, by scaling."""
    return F.round(x * 100) / 100


def success_rate(successes: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(round2(successes / total))


def quantity(n: Column, one: str, many: str | None = None) -> Column:
    """'1 data point', '3 data points'."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def reason(*clauses: tuple[Column, str, str]) -> Column:
    """Clauses (n, noun, rest) with n > 0, joined by '; '."""
    return F.concat_ws("; ", *[F.when(n > 0, F.concat(quantity(n, noun, noun if noun == "time series" else None), F.lit(f" {rest}"))) for n, noun, rest in clauses])
