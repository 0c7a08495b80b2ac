"""SQL texts of filter and mask rules, as Column expressions over item rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expressions import adapted_mask, is_clean, mask_fallback, other_columns, stripped
from ..functions.masks import kind_of
from ..functions.principals import lookup

# Mask body per kind over a text value.
TEXT_BODY = {
    "REDACT": f"'{rules.REDACTED}'",
    "CUSTOM": f"'{rules.REDACTED}'",
    "LAST_4": f"CONCAT('{rules.LAST_4_PREFIX}', RIGHT(val, 4))",
    "FIRST_4": f"CONCAT(LEFT(val, 4), '{rules.FIRST_4_SUFFIX}')",
    "HASH": "SHA2(val, 256)",
    "NULLIFY": "NULL",
    "DATE_YEAR": "CAST(MAKE_DATE(YEAR(TRY_CAST(val AS DATE)), 1, 1) AS STRING)",
    "NONE": "val",
}
# Fixed value: the same for a lone year mask, which works on a DATE.
DATE_BODY = "MAKE_DATE(YEAR(val), 1, 1)"


def mask_kind() -> Column:
    return kind_of(F.col("mask_type"))


def custom_text() -> Column:
    return stripped(F.coalesce("mask_expr", F.lit("")))


def mask_column() -> Column:
    return F.coalesce(F.get("columns", F.lit(0)), F.lit("col"))


def lone_mask_body() -> Column:
    """Body of a mask that is alone on its column; null when there is nothing to run.

    LAST_4, HASH and NULLIFY ignore a custom text; FIRST_4 and DATE_YEAR prefer it.
    """
    kind, custom = mask_kind(), custom_text()
    given = custom != ""
    return (
        F.when(kind == "NONE", F.lit(None).cast("string"))
        .when(kind.isin("LAST_4", "HASH", "NULLIFY"), lookup(TEXT_BODY)[kind])
        .when(kind.isin("FIRST_4", "DATE_YEAR") & given, custom)
        .when(kind == "DATE_YEAR", DATE_BODY)
        .when(kind == "FIRST_4", TEXT_BODY["FIRST_4"])
        .when(given & is_clean(custom), custom)
        .when(given, mask_fallback(custom))
        .otherwise(TEXT_BODY["REDACT"])
    )


def merged_mask_body() -> Column:
    """Body of one branch of a merged mask. A custom text comes before every kind but NONE; one
    that needs other columns is replaced by full redaction."""
    kind, custom = mask_kind(), custom_text()
    adapted = adapted_mask(custom, mask_column())
    return (
        F.when(kind == "NONE", "val")
        .when((custom != "") & (F.size(other_columns(adapted)) > 0), TEXT_BODY["REDACT"])
        .when(custom != "", adapted)
        .otherwise(lookup(TEXT_BODY)[kind])
    )


def filter_text() -> Column:
    return F.when(F.length("filter_expr") > 0, F.col("filter_expr")).otherwise("TRUE")
