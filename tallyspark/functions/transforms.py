"""Scalar transforms of the mapping language: each takes and returns a column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in order of trial, and strings that stand for no amount.
DATE_FORMATS = ("M/d/yy", "M/d/yyyy", "yyyy-MM-dd", "d/M/yyyy")
#: What a date must look like for each of them.
_DATE_SHAPES = (r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$")
BLANKS = ("", "-", "n/a", "na", "none", "null")


class UnknownTransform(ValueError):
    """A step that is not in TRANSFORMS; the message names the field."""


def trim(c: Column) -> Column:
    return F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))


def lower(c: Column) -> Column:
    return F.lower(trim(c))


def upper(c: Column) -> Column:
    return F.upper(trim(c))


def fold_key(c: Column) -> Column:
    """Keys that differ in case and spaces are one; sharp s and ss stay two."""
    return lower(c)


def _blank(c: Column) -> Column:
    return c.isNull() | lower(c).isin(*BLANKS)


def parse_money(c: Column) -> Column:
    """$1,234.50 and (5.00) for a negative; blanks and what is no amount are null (money_error() tells them apart)."""
    text = trim(c)
    digits = F.regexp_replace(text, r"[$€£,\s()]", "")
    value = digits.try_cast("decimal(14,4)")
    return F.when(_blank(c), None).otherwise(F.when(text.rlike(r"^\(.*\)$"), -value).otherwise(value))


def money_error(c: Column) -> Column:
    return ~_blank(c) & parse_money(c).isNull()


def cents_to_dollars(c: Column) -> Column:
    return (c.cast("decimal(18,0)") / 100).cast("decimal(14,4)")


def to_decimal(c: Column) -> Column:
    return F.when(~_blank(c), trim(c).try_cast("decimal(14,4)"))


def to_int(c: Column) -> Column:
    return F.when(~_blank(c), trim(c).try_cast("decimal(18,4)").cast("bigint"))


def hash_id(c: Column, prefix: str = "") -> Column:
    key = fold_key(c)
    return F.when(key != "", F.concat(F.lit(prefix), F.substring(F.sha1(key), 1, 16)))


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; null where none does."""
    text = trim(c)
    shapes = dict(zip(DATE_FORMATS, _DATE_SHAPES, strict=True))
    tries = [F.when(text.rlike(shapes.get(f, ".")), F.to_date(F.try_to_timestamp(text, F.lit(f)))) for f in formats]
    return F.coalesce(*tries)


def split_name(c: Column, part: str = "first") -> Column:
    """First Last, or Last, First; a single word is a first name."""
    text = trim(c)
    comma = F.split(text, r"\s*,\s*", 2)
    words = F.split(text, " ", 2)
    first = F.when(text.contains(","), F.get(comma, F.lit(1))).otherwise(F.get(words, F.lit(0)))
    last = F.when(text.contains(","), F.get(comma, F.lit(0))).otherwise(F.get(words, F.lit(1)))
    return F.when(text != "", first if part == "first" else last)


def default(c: Column, to=None) -> Column:
    return F.when(c.isNull() | (trim(c) == ""), F.lit(to)).otherwise(c)


def at_time(c: Column, at: str = "12:00", timezone: str = "UTC") -> Column:
    """The UTC instant of a wall-clock time on a date in a zone."""
    local = F.to_timestamp(F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit(f" {at}:00")))
    return F.to_utc_timestamp(local, timezone)


TRANSFORMS: dict[str, Callable[..., Column]] = {f.__name__: f for f in (trim, lower, upper, fold_key, parse_money, cents_to_dollars, to_decimal, to_int, hash_id, parse_date, split_name, default, at_time)}


def apply_transforms(c: Column, steps: list, field: str) -> Column:
    """Steps in order; each is a name or a mapping of one name to its arguments."""

    def step(value: Column, s) -> Column:
        name, args = (s, {}) if isinstance(s, str) else next(iter(s.items()))
        if name not in TRANSFORMS:
            raise UnknownTransform(f"{field}: there is no transform {name!r}; there are {', '.join(TRANSFORMS)}")
        return TRANSFORMS[name](value, **(args or {}))

    return reduce(step, steps, c)


def normalised_email(c: Column) -> Column:
    text = lower(c)
    return F.when(text.contains("@"), text)


def normalised_phone(c: Column) -> Column:
    """Digits only; a leading 1 of eleven digits goes."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(digits) >= 7, digits)
