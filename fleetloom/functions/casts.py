"""Text casts with one defined meaning, and null-skipping aggregates.

Spark's own casts take texts that a strict loader must refuse (a bare year, a
``d`` behind a number, today's date for a bare clock time), truncate where
rounding is meant, and its rounding works on the shortest text of a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"\A\s*([0-9]{4,6})([-/])([0-9]{1,2})\2([0-9]{1,2})(?:\s*\z|(?:[T ])([0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2}(?:\.[0-9]{1,9})?)?)\s*(?:Z|UTC|[+-][0-9]{2}(?::?[0-9]{2})?)?\s*\z)"


def to_timestamp(text: Column) -> Column:
    """A year-first date with or without a clock time; an offset is read over, the wall clock kept."""
    iso = F.regexp_replace(text, _STAMP, "$1-$3-$4T$5")  # leaves what doesn't match as it is
    fits = F.substring(F.ltrim(text), 1, 4).rlike("^[0-9]{4}$") & text.rlike(_STAMP)
    return F.when(fits, F.when(iso.endswith("T"), F.concat(iso, F.lit("00:00:00"))).otherwise(iso).try_cast("timestamp_ntz"))


def to_double(text: Column) -> Column:
    """A number; type suffixes are refused, underscores between digits are read over."""
    # the patterns run only on texts that show what they look for
    plain = F.when(text.contains("_"), F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")).otherwise(text)
    suffixed = F.right(F.rtrim(text), F.lit(1)).isin("d", "D", "f", "F") & text.rlike(r"[0-9.][dDfF]\s*\z")
    return F.when(~suffixed, plain.try_cast("double"))


def to_whole(number: Column, kind: str) -> Column:
    """A double to int or bigint, half to even; null beyond the range."""
    return F.rint(number).try_cast(kind)


def text_or_null(text: Column) -> Column:
    """Without outer spaces; null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def rounded(number: Column, digits: int) -> Column:
    """Scale, round half away from zero, unscale."""
    scale = F.lit(float(10**digits))
    return F.round(number * scale, 0) / scale


def first_by(value: Column, *order: Column) -> Column:
    """The value of the least row among those that have one."""
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*order)))


def last_by(value: Column, *order: Column) -> Column:
    """The value of the greatest row among those that have one."""
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*order)))


def mean_of(number: Column, digits: int) -> Column:
    """The mean over exact sums, so that the order of addition can't show."""
    exact = F.sum(number.cast("decimal(28,6)")).cast("double")
    return rounded(exact / F.nullif(F.count(number), F.lit(0)), digits)
