"""Column builders for filter and mask expression texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

WHOLE_IDENTIFIER = r"(?<![\p{L}\p{N}_])[A-Za-z_][A-Za-z0-9_]*+(?![\p{L}\p{N}_])"
REQUEST_CONTEXT = r"\$\{\{[^}]+\}\}"
COLUMN_MARK = r"(?i)\{col\}"
BUILTIN_CALL = r"(?iU)\b(" + "|".join(rules.MASK_BUILTINS) + r")\s*\("
SUBQUERY = r"(?iU)\bSELECT\b"

ISSUE = "struct<code:string,detail:string>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_literals(text: Column) -> Column:
    return F.regexp_replace(text, "'[^']*'", " ")


def filter_columns(text: Column) -> Column:
    """Column names a filter expression refers to, first use first.

    Literals are dropped, then whole word runs are kept when they are plain identifiers (one pattern
    finds both) and not one of the fixed words. Names are made distinct before they meet the words.
    """
    bare = F.regexp_replace(without_literals(text), '"[^"]*"', " ")
    names = F.array_distinct(F.regexp_extract_all(bare, F.lit(WHOLE_IDENTIFIER), 0))
    return F.filter(names, lambda w: ~F.lower(w).isin(rules.FILTER_WORDS))


def context_attributes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REQUEST_CONTEXT), 0))


def builtin_calls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(BUILTIN_CALL), 1))


def expression_issues(text: Column) -> Column:
    """What keeps an expression from running in the target: array of (code, detail)."""

    def issue(test: Column, code: str, detail: Column) -> Column:
        return F.when(test, F.named_struct(F.lit("code"), F.lit(code), F.lit("detail"), detail))

    found = F.array(
        issue(text.rlike(REQUEST_CONTEXT), "request_context", F.array_join(context_attributes(text), ", ")),
        issue(text.rlike(COLUMN_MARK), "column_mark", F.lit("{col}")),
        issue(text.rlike(BUILTIN_CALL), "mask_builtin", F.array_join(builtin_calls(text), ", ")),
        issue(without_literals(text).rlike(SUBQUERY), "subquery", F.lit("SELECT")),
    )
    return F.coalesce(F.array_compact(found), F.array().cast(f"array<{ISSUE}>"))


def is_clean(text: Column) -> Column:
    """True when ``expression_issues`` would be empty (null text counts as clean)."""
    bad = (
        text.rlike(REQUEST_CONTEXT)
        | text.rlike(COLUMN_MARK)
        | text.rlike(BUILTIN_CALL)
        | without_literals(text).rlike(SUBQUERY)
    )
    return ~F.coalesce(bad, F.lit(False))


def native_mask(text: Column) -> Column:
    """A call of a source-service mask function as plain SQL over ``val``, else null."""
    call = stripped(text)
    out = None
    for pattern, template in rules.MASK_CALLS:
        value = F.lit(template)
        if "{n}" in template:
            value = F.replace(value, F.lit("{n}"), F.regexp_extract(call, pattern, 1))
        test = call.rlike(pattern)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def else_branch(text: Column) -> Column:
    """Text of the ELSE branch when the whole expression is a CASE with one, else null."""
    pattern = rules.CASE_WITH_ELSE
    return F.when(text.rlike(pattern), stripped(F.regexp_extract(text, pattern, 1)))


def mask_fallback(text: Column) -> Column:
    """Stricter stand-in for a mask expression that is not clean, or null when there is none."""
    branch = else_branch(text)
    clean_branch = F.regexp_replace(branch, COLUMN_MARK, "val")
    return F.when(
        branch.isNotNull(), F.when(is_clean(branch), clean_branch).otherwise(native_mask(branch))
    ).otherwise(native_mask(text))


# A literal in CAST('...' AS <number>) that does not read as a number: the look-ahead rejects
# everything that does (sign, digits with single '_', decimals, exponent, inf, nan).
_DIGITS = r"\d(?:_?\d)*"
_NUMBER = (
    rf"\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)\s*"
)
_NUMERIC_TYPES = "|".join(rules.NUMERIC_TYPES)
BAD_CAST = (
    rf"(?i)CAST\s*\(\s*'(?!{_NUMBER}')([^']*)'\s+AS\s+({_NUMERIC_TYPES})(?:\s*\([^)]*\))?\s*\)"
)
LOOSE_IDENTIFIER = (
    r"(?<![\p{L}\p{N}_])([A-Za-z_][A-Za-z0-9_]*)(?![\p{L}\p{N}_])(?!\s*\()"
)


def adapted_mask(text: Column, column: Column) -> Column:
    """Custom mask text with impossible numeric casts as NULL and the masked column as ``val``."""
    name = F.concat(F.lit(r"(?U)\b\Q"), column, F.lit(r"\E\b"))
    return F.regexp_replace(F.regexp_replace(text, BAD_CAST, "NULL"), name, F.lit("val"))


def other_columns(adapted: Column) -> Column:
    """Identifiers an adapted mask still refers to besides ``val``."""
    words = F.regexp_extract_all(adapted, F.lit(LOOSE_IDENTIFIER), 1)
    return F.array_distinct(F.filter(words, lambda w: ~F.lower(w).isin(rules.MASK_WORDS)))


def bind_val(text: str, column_sql: str) -> str:
    """Put a column in place of ``val`` in a mask text, outside of quoted literals."""
    return re.sub(
        r"'[^']*'|\bval\b", lambda m: m[0] if m[0].startswith("'") else column_sql, text
    )
