"""Numeric and state rules of the editor's record format, as column expressions.

Three roundings are in use: half up (``round_half_up``), half even (``F.bround``) and half away from zero (``F.round``).
Two defaults are in use: ``or_default`` also replaces 0, NaN, '' and false; ``F.coalesce`` replaces null only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def or_default(x: Column, default) -> Column:
    """``default`` where a number is null, 0 or NaN."""
    return F.when(x.isNull() | (x == 0) | F.isnan(x.cast("double")), lit(default)).otherwise(x)


def text_or(x: Column, default) -> Column:
    """``default`` where a text is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), lit(default))


def clamp(x: Column, low, high) -> Column:
    """Null stays null, which ``least`` and ``greatest`` alone would skip."""
    return F.when(x.isNotNull(), F.least(lit(high), F.greatest(lit(low), x)))


def layer_scale(x: Column) -> Column:
    return clamp(x, 0.05, 2.5)


def fixed(x: Column, digits: int = 2) -> Column:
    """Rounded to ``digits``; exact binary ties may differ by one in the last digit from decimal text formatting."""
    return F.round(x, digits)


def number(text: Column) -> Column:
    """A double from text: decimal, exponent or 0x notation, blank is 0; null where it isn't a finite number."""
    t = F.trim(text)
    hexed = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).cast("double"))
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.when(t == "", 0.0).otherwise(F.coalesce(hexed, plain))


def bounded_integer(text: Column, fallback: int, low: int, high: int) -> Column:
    """Rounded and clamped; ``fallback`` where the value is null or no number."""
    n = number(F.coalesce(text, F.lit(str(fallback))))
    return F.when(n.isNull(), F.lit(fallback)).otherwise(clamp(round_half_up(n), low, high)).cast("int")


def port(text: Column, fallback: int, low: int = 1, high: int = 65_535) -> Column:
    n = number(text)
    good = (n == F.floor(n)) & n.between(low, high) & (F.trim(text) != "")
    return F.when(good, n.cast("int")).otherwise(F.lit(fallback))


def export_settings(columns, fps, frame_count, frame_height, frame_width) -> Column:
    """The five bounded numbers of an export request."""
    return F.struct(
        bounded_integer(columns, 1, 1, 64).alias("columns"), bounded_integer(fps, 8, 1, 60).alias("fps"), bounded_integer(frame_count, 1, 1, 256).alias("frameCount"),
        bounded_integer(frame_height, 256, 1, 4096).alias("frameHeight"), bounded_integer(frame_width, 256, 1, 4096).alias("frameWidth"),
    )


def number_text(x: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def decimal_text(x: Column, digits: int = 6) -> Column:
    """A double as text with at most ``digits`` decimals and no zeros at the end; never an exponent."""
    return F.regexp_replace(F.round(x, digits).cast(f"decimal(30,{digits})").cast("string"), r"\.?0+$", "")


def fixed_text(x: Column, digits: int) -> Column:
    """A double with exactly ``digits`` decimals; what rounds to zero from below keeps its sign. Binary ties as in ``fixed``."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.round(F.abs(x), digits).cast(f"decimal(30,{digits})").cast("string"))


def state_value(text: Column) -> Column:
    """struct(kind, value): what a state text means, with numbers in one notation."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = number(t)
    kind = F.when(t == "", "text").when(t.isin("true", "false"), "boolean").when(n.isNotNull(), "number").otherwise("text")
    return F.struct(kind.alias("kind"), F.when((kind == "number"), number_text(n)).otherwise(t).alias("value"))


def state_matches(kind: Column, value: Column, expected: Column) -> Column:
    """Blank ``expected`` asks whether the stored value is set and not false, 0 or empty; else the texts must be equal."""
    t = F.trim(F.coalesce(expected, F.lit("")))
    held = F.when(kind == "number", F.coalesce(number_text(number(value)), value)).otherwise(value)  # one too large for a double is Infinity, which isn't read again
    holds = F.when(kind == "boolean", value == "true").when(kind == "number", F.coalesce(number(value) != 0, value.isNotNull())).otherwise(value != "")
    return F.when(t == "", F.coalesce(holds, F.lit(False))).otherwise(F.coalesce(held, F.lit("undefined")) == state_value(t)["value"])


def put_state(state: Column, key, value) -> Column:
    """``state`` (map) with ``key`` set, whether or not it was there."""
    kept = F.map_filter(F.coalesce(state, F.create_map().cast("map<string,string>")), lambda k, _: k != lit(key))
    return F.map_concat(kept, F.create_map(lit(key), lit(value)))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, hh:mm a")


def record_id(prefix: str, *parts) -> Column:
    """An id from parts that the caller passes: clock and chance are parameters."""
    return F.concat_ws("_", F.lit(prefix), *(lit(p).cast("string") for p in parts))


def same_record(a: Column, b: Column) -> Column:
    """Equality of structures by their JSON text."""
    return F.to_json(a) == F.to_json(b)
