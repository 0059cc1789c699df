"""Column functions: time, precision, identifiers, names, JSON, arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def _whole(ns: Column, unit: int) -> Column:
    """Whole units, rounded down, in integers: a double doesn't hold nanoseconds since 1970."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(unit)), F.lit(unit))


def to_timestamp(ns: Column) -> Column:
    """Nanoseconds to a timestamp (whole microseconds); null stays null."""
    return F.timestamp_micros(_whole(ns, 1000))


def from_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def iso8601(ns: Column, digits: int = 9) -> Column:
    """Text in UTC with 9 or 3 digits of the second, whatever the session's zone. From 1970 on."""
    seconds = _whole(ns, NANOS)
    days, rest = F.floor(seconds / 86400), seconds % 86400
    two = lambda x: F.lpad(F.floor(x).cast("int").cast("string"), 2, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")
    fraction = F.lpad((ns % NANOS).cast("string"), 9, "0")
    return F.concat(date, F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("."), F.substring(fraction, 1, digits), F.lit("Z"))


def latest_of(*times: Column) -> Column:
    """The greatest of those that aren't null."""
    return F.greatest(*times)


def earliest_of(*times: Column) -> Column:
    return F.least(*times)


def to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone)


def precision(x: Column) -> Column:
    """Digits after the point of a number's shortest text."""
    text = F.regexp_extract(x.cast("decimal(28,9)").cast("string"), r"\.(\d*?)0*$", 1)
    return F.length(text)


def add_prices(a: Column, b: Column) -> Column:
    """Sum at the larger precision of both."""
    return (a.cast("decimal(28,9)") + b.cast("decimal(28,9)")).cast("double")


def negative_quantity(a: Column, b: Column) -> Column:
    """Whether a difference of quantities would fall below zero, which a quantity can't."""
    return a < b


def symbol(instrument: Column) -> Column:
    """What stands before the last dot."""
    return F.regexp_extract(instrument, r"^(.*)\.[^.]*$", 1)


def venue(instrument: Column) -> Column:
    return F.substring_index(instrument, ".", -1)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def title_case(name: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(name, "_", " ")), " ", "")


def safe_identifier(name: Column) -> Column:
    """An identifier as a partition's name: slashes go."""
    return F.regexp_replace(name, "/", "")


def basis_points(x: Column) -> Column:
    """Basis points as a fraction."""
    return x / 10_000


def json_number(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).cast("double")


def depth_totals(levels: Column) -> Column:
    """Total size of an array of (price, size)."""
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x["size"])
