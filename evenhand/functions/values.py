"""Scalar recodes used while a raw table becomes a labelled one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: Column | str) -> Column:
    """Text to double; what cannot be read becomes null."""
    return _col(c).try_cast("double")


def text_label(c: Column | str, positive: str) -> Column:
    """1 where the text, without blanks and trailing dots, is the positive label; null counts as 0."""
    cleaned = F.replace(F.rtrim(F.trim(_col(c)), F.lit(".")), F.lit(" "), F.lit(""))
    return F.coalesce((cleaned == F.lit(positive)).cast("int"), F.lit(0))


def matches(c: Column | str, value: str) -> Column:
    """1 where the lower-case trimmed text is ``value``; null counts as 0."""
    return F.coalesce((F.lower(F.trim(_col(c))) == F.lit(value.lower())).cast("int"), F.lit(0))


def coded(c: Column | str, value: float = 1.0) -> Column:
    """1 where the numeric code is ``value``; unreadable codes count as 0."""
    return F.coalesce((numeric(_col(c).cast("string")) == F.lit(float(value))).cast("int"), F.lit(0))


def to_zero_one(c: Column | str) -> Column:
    """-1/1 labels to 0/1."""
    return F.when(_col(c) == 1, 1).otherwise(0)


def to_minus_one_one(c: Column | str) -> Column:
    """0/1 labels to -1/1."""
    return F.when(_col(c) == 1, 1).otherwise(-1)


def signed_log(c: Column | str) -> Column:
    return F.signum(_col(c)) * F.log1p(F.abs(_col(c)))


def finite_or_zero(c: Column | str) -> Column:
    """Null, NaN and both infinities become 0."""
    c = _col(c)
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """A rate that is 0 where its denominator is 0 or missing."""
    return F.coalesce(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))


def fixed(value: Column, digits: int = 4) -> Column:
    """Text with a fixed number of digits, rounded half to even on the exact binary value.

    The value is split into 26 fractional bits and a remainder, whose products with a power of ten are
    both exact, so a tie is told apart from values that only look like one in decimals.
    """
    scale, bits = F.lit(float(10**digits)), F.lit(float(2**26))
    size = F.abs(value)
    high = F.floor(size * bits) / bits
    units = F.floor(size * scale)
    above = (high * scale - (units + F.lit(0.5))) + (size - high) * scale
    rounded = F.when(above > 0, units + 1).when(above < 0, units).otherwise(units + units % 2)
    return F.format_string(f"%.{digits}f", F.signum(value) * rounded / scale)


def mean_and_spread(mean: Column, std: Column, digits: int = 4) -> Column:
    """``mean +/- std`` as text with a fixed number of digits."""
    return F.concat(fixed(mean, digits), F.lit(" +/- "), fixed(std, digits))
