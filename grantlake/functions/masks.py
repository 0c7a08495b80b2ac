"""Mask kinds as Column expressions over the value to hide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def redact(val: Column) -> Column:
    return F.lit(rules.REDACTED)


def show_last_4(val: Column) -> Column:
    return F.concat(F.lit(rules.LAST_4_PREFIX), F.right(val, F.lit(4)))


def show_first_4(val: Column) -> Column:
    return F.concat(F.left(val, F.lit(4)), F.lit(rules.FIRST_4_SUFFIX))


def hashed(val: Column) -> Column:
    return F.sha2(val, 256)


def nullified(val: Column) -> Column:
    return F.lit(None).cast("string")


def year_only(val: Column) -> Column:
    """First of January of a date, as a date."""
    return F.make_date(F.year(val), F.lit(1), F.lit(1))


def year_only_text(val: Column) -> Column:
    """The same over text: what does not read as a date becomes null."""
    return year_only(val.try_cast("date")).cast("string")


def clear(val: Column) -> Column:
    return val


# Mask kind -> expression over text.
TEXT_MASKS = {
    "REDACT": redact,
    "CUSTOM": redact,
    "LAST_4": show_last_4,
    "FIRST_4": show_first_4,
    "HASH": hashed,
    "NULLIFY": nullified,
    "DATE_YEAR": year_only_text,
    "NONE": clear,
}


def _x(count: Column) -> Column:
    return F.repeat(F.lit("x"), count)


def _rest(val: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.length(val) - F.lit(n))


def hide_all_but_last(val: Column, n: int) -> Column:
    return F.concat(_x(_rest(val, n)), F.right(val, F.lit(n)))


def hide_all_but_first(val: Column, n: int) -> Column:
    return F.concat(F.left(val, F.lit(n)), _x(_rest(val, n)))


def hide_first(val: Column, n: int) -> Column:
    return F.concat(_x(F.lit(n)), F.right(val, _rest(val, n)))


def hide_last(val: Column, n: int) -> Column:
    return F.concat(F.left(val, _rest(val, n)), _x(F.lit(n)))


def hide_letters_and_digits(val: Column) -> Column:
    return F.regexp_replace(val, "[A-Za-z0-9]", "x")


def kind_of(word: Column) -> Column:
    """Mask kind of a mask word; none given means MASK, an unknown one means REDACT."""
    from .principals import lookup

    given = F.when(word.isNull() | (word == ""), "MASK").otherwise(word)
    return F.coalesce(lookup(rules.MASK_KINDS)[given], F.lit("REDACT"))
