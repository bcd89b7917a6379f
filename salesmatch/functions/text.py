"""Scalar Column helpers (F1-F16). Built-in expressions only, so every helper
stays inside whole-stage codegen; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from the reference: the ellipsis and the empty-value mark, the
# chunk size of streamed answers, the yen unit switch of price labels.
ELLIPSIS = "..."
EMPTY_MARK = "-"
CHUNK_CHARS = 30
PRICE_UNIT = 10_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prefix(col, n: int) -> Column:
    """first ``n`` characters (characters, not bytes)."""
    return F.substring(_c(col), 1, n)


def truncate(col, n: int) -> Column:
    """``left(n) + '...'`` when longer than ``n``, else unchanged."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def short_label(col, n: int = 20) -> Column:
    """F16: first ``n`` characters followed by '...', without a length test."""
    return F.concat(F.substring(_c(col), 1, n), F.lit(ELLIPSIS))


def thousands(col) -> Column:
    """integer with thousands separators."""
    return F.format_number(_c(col).cast("bigint"), 0)


def budget_label(lo, hi, currency: str = "¥") -> Column:
    """'¥a 〜 ¥b'; '-' when either bound is missing or 0."""
    lo_c, hi_c = _c(lo), _c(hi)
    ok = lo_c.isNotNull() & hi_c.isNotNull() & (lo_c != 0) & (hi_c != 0)
    text = F.concat(F.lit(currency), thousands(lo_c), F.lit(" 〜 "), F.lit(currency), thousands(hi_c))
    return F.when(ok, text).otherwise(F.lit(EMPTY_MARK))


def price_label(col, unit: int = PRICE_UNIT, unit_name: str = "万円", base_name: str = "円") -> Column:
    """price text with a unit switch at ``unit``; unparsable -> the raw text.

    The reference prints the raw yen amount next to the 10,000-yen unit
    (trap T11); this label divides by the unit and says so in the name.
    """
    raw = _c(col).cast("string")
    num = _c(col).try_cast("double")
    big = F.concat(F.format_number(F.floor(num / unit), 0), F.lit(unit_name))
    small = F.concat(raw, F.lit(base_name))
    return F.when(num.isNull(), raw).when(num >= unit, big).otherwise(small)


def list_text(col, sep: str = ", ", kind: T.DataType | None = None) -> Column:
    """array -> 'a, b'; '-' when null or empty. With the column's ``kind``, scalars pass through as text."""
    c = _c(col)
    text = F.array_join(c, sep) if kind is None or isinstance(kind, T.ArrayType) else c.cast("string")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(EMPTY_MARK))


def head(col, n: int) -> Column:
    """first ``n`` items."""
    return F.slice(_c(col), 1, n)


def tail_or_all(col, n: int) -> Column:
    """items after the first ``n``; the whole list when nothing is left."""
    c = _c(col)
    return F.when(F.size(c) > n, F.slice(c, n + 1, F.size(c) - n)).otherwise(c)


def contains_ci(col, needle: str) -> Column:
    """Case-insensitive literal substring test (no wildcards); null -> false."""
    return F.coalesce(F.contains(F.lower(_c(col)), F.lit(needle.lower())), F.lit(False))


def trunc_long(col) -> Column:
    """Python int(): truncation toward zero (DuckDB's cast rounds, Spark's truncates)."""
    return _c(col).cast("bigint")


def round_even(col, digits: int) -> Column:
    """Rounding of halves to the even digit (Spark's ``round`` goes away from zero)."""
    return F.bround(_c(col), digits)


def chunks(col, size: int = CHUNK_CHARS) -> Column:
    """fixed-size character chunks of the whole text; '' -> []."""
    c = _c(col)
    n = F.length(c)
    starts = F.sequence(F.lit(0), n - 1, F.lit(size))
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(c, i + 1, size))).otherwise(
        F.array().cast("array<string>"))


def json_value(col, path: str, default=None, cast: str | None = None) -> Column:
    """nested JSON field with a default."""
    v = F.get_json_object(_c(col), path)
    if cast:
        v = v.try_cast(cast)
    return v if default is None else F.coalesce(v, F.lit(default))


def map_value(col, key: str, default=None) -> Column:
    """map lookup that yields the default for a missing key."""
    v = F.try_element_at(_c(col), F.lit(key))
    return v if default is None else F.coalesce(v, F.lit(default))


def or_default(col, default) -> Column:
    """P10/T4: Python's ``x or default`` for numbers: null and 0 -> default."""
    return F.coalesce(F.nullif(_c(col), F.lit(0)), F.lit(default))


# Fixed value: the characters that Python's ``str.strip()`` takes for white space.
WHITE_SPACE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                       0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip_ws(col) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace, not just spaces."""
    return F.btrim(_c(col), F.lit(WHITE_SPACE))


# --- F12: time helpers -------------------------------------------------------

def minutes_ago(n: int, now: Column | None = None) -> Column:
    """now - n minutes (session time zone); ``now`` pins the moment."""
    return (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(n)} MINUTES")


def epoch_ms(col) -> Column:
    """timestamp -> epoch milliseconds."""
    return F.unix_millis(_c(col).cast("timestamp"))


def from_epoch_ms(col) -> Column:
    """epoch milliseconds -> timestamp."""
    return F.timestamp_millis(_c(col))


def iso_text(col) -> Column:
    """timestamp -> ISO-8601 text with microseconds, as Python's isoformat()."""
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
