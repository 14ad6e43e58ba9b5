"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns.
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
ANSI = "\\x1B(?:[@-Z\\-_]|\\[[0-?]*[ -/]*[@-~])"
NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def url_path(url: Column) -> Column:
    """Path of a URL, without scheme, host, query and fragment. Odd URLs don't raise."""
    return F.regexp_extract(url, PATH, 1)


def day_of(stamp: Column) -> Column:
    """Calendar day as the text of an ISO timestamp has it; offsets aren't applied."""
    return F.substring(stamp, 1, 10)


def checkpoint(seconds: Column) -> Column:
    """Hundredths, cut off, in doubles."""
    return F.floor(seconds.cast("double") * F.lit(100.0)) / F.lit(100.0)


def truncate_millis(seconds: Column) -> Column:
    return F.floor(seconds.cast("double") * F.lit(1000.0)) / F.lit(1000.0)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def lenient_number(text: Column) -> Column:
    """The number that a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(text, NUMBER, 1).try_cast("double"), F.lit(0.0))


def format_iso(stamp: Column) -> Column:
    """ISO 8601 of an instant, in the session's time zone, with its offset."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssxxx")


def format_iso_utc(stamp: Column) -> Column:
    """ISO 8601 of a time without zone, which counts as UTC."""
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def instant(text: Column) -> Column:
    """The instant that a date and time with an offset names, with a blank or T between its parts; null for other texts."""
    plain = F.trim(text)
    forms = ("yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd HH:mm:ssxxx", "yyyy-MM-dd'T'HH:mm:ssxxx", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(x)) for x in forms))


def plain_number(x: Column) -> Column:
    """A double as text, whole numbers without a decimal point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def json_text(text: Column) -> Column:
    """The inside of a JSON string as ASCII, slashes escaped as well."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("/"), F.lit("\\/"))
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(....)", r"\\u$1")

    def escaped(c: Column) -> Column:
        out = F.when(c.between(F.lit(" "), F.lit("\x7f")), c)
        for k, v in short.items():
            out = out.when(c == F.lit(k), F.lit(v))
        return out.otherwise(units(c))

    each = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.when(plain.rlike("[^ -\x7f]"), each).otherwise(plain)


def board_line(*columns: Column) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in columns))


def clean_count(text: Column) -> Column:
    """A count typed with separators."""
    return F.translate(text, ",_", "").cast("long")
