"""Statistics, readiness score, previews and roll-ups of items and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.naming import volume_name
from ..functions.principals import service_account_kind
from ..functions.rows import unnest
from .review import not_translatable

# Report name of the count of each item type and status.
TYPE_COUNTS = {
    "grant": "grants",
    "deny": "denies",
    "row_filter": "row_filters",
    "column_mask": "masks",
    "hdfs_grant": "hdfs_grants",
    "hbase_grant": "hbase_grants",
    "udf_grant": "udf_grants",
    "tag_set": "tag_sets",
    "tag_grant": "tag_grants",
    "tag_placeholder": "tag_placeholders",
}
CRITICAL_PENALTY = 10
WARNING_PENALTY = 3


def item_statistics(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per type and status, disabled and untranslatable items, distinct schemas and principals."""
    by = by or ["export_id"]
    present = F.when(F.length("schema") > 0, F.col("schema"))
    named = F.when(F.length("principal.name") > 0, F.col("principal.name"))
    return items.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("type") == t).alias(n) for t, n in TYPE_COUNTS.items()],
        *[F.count_if(F.col("status") == s).alias(s) for s in rules.STATUSES],
        F.count_if(~F.coalesce("enabled", F.lit(False))).alias("disabled"),
        F.count_if(not_translatable()).alias("not_translatable"),
        F.count_distinct(present).alias("schema_count"),
        F.count_distinct(named).alias("principal_count"),
    )


def item_schemas(items: DataFrame) -> DataFrame:
    return items.filter(F.length("schema") > 0).select("export_id", "schema").distinct()


def item_principals(items: DataFrame) -> DataFrame:
    return items.filter(F.length("principal.name") > 0).select(
        "export_id", F.col("principal.name").alias("principal")
    ).distinct()


def preview(df: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """First ``n`` values per key. The limit is applied on both sides of the shuffle."""
    window = Window.partitionBy(*keys).orderBy(column)
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)


def severity_rollup(summary: DataFrame) -> DataFrame:
    """Categories and items per severity."""
    return summary.groupBy("export_id", "severity").agg(
        F.count("*").alias("categories"), F.sum("items").alias("items")
    )


def readiness(statistics: DataFrame, summary: DataFrame) -> DataFrame:
    """Readiness score per export.

    Share of translatable items in percent, less ten per critical and three per warning category,
    not below zero, rounded half to even.
    """
    severities = summary.groupBy("export_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
        F.sum("items").alias("issues"),
    )
    joined = statistics.join(severities, "export_id", "left").na.fill(0, ["critical", "warning", "issues"])
    base = F.when(
        F.col("total") > 0, (F.col("total") - F.col("not_translatable")) / F.col("total") * 100
    ).otherwise(0.0)
    penalised = base - CRITICAL_PENALTY * F.col("critical") - WARNING_PENALTY * F.col("warning")
    score = F.greatest(F.lit(0), F.bround(penalised, 0)).cast("bigint")
    return joined.withColumns(
        {
            "base": F.bround(base, 0).cast("bigint"),
            "score": score,
            "verdict": F.when(score >= 70, "Ready").when(score >= 40, "Needs attention").otherwise("Significant gaps"),
            "effort": effort(F.col("critical")),
        }
    )


def effort(critical: Column) -> Column:
    return F.when(critical > 2, "High").when(critical > 0, "Medium").otherwise("Low")


def score_breakdown(scores: DataFrame) -> DataFrame:
    """Rows that explain a score; factors that do not apply are left out."""
    lost = F.bround(F.col("not_translatable") / F.col("total") * 100, 0).cast("bigint")

    def row(position: int, factor: str, amount: Column, impact: Column) -> Column:
        kind = "struct<position:int,factor:string,amount:bigint,impact:bigint>"
        return F.struct(F.lit(position), F.lit(factor), amount, impact).cast(kind)

    critical, warning = F.col("critical"), F.col("warning")
    rows = F.array(
        row(1, "translatable", F.col("total") - F.col("not_translatable"), F.col("base")),
        F.when(F.col("not_translatable") > 0, row(2, "not_translatable", F.col("not_translatable"), -lost)),
        F.when(critical > 0, row(3, "critical_penalty", critical, -CRITICAL_PENALTY * critical)),
        F.when(warning > 0, row(4, "warning_penalty", warning, -WARNING_PENALTY * warning)),
        row(5, "score", F.col("total"), F.col("score")),
    )
    return unnest(scores.filter(F.col("total") > 0), F.array_compact(rows), "r", keep=["export_id"]).select(
        "export_id", "r.*"
    )


def risk_summary(headers: DataFrame, scores: DataFrame) -> DataFrame:
    return headers.join(scores, "export_id").select(
        "export_id", "service_name", "cluster_name", "total_policies", "schema_count",
        "principal_count", "critical", "warning", "score", "verdict", "effort",
    )


def type_rollup(items: DataFrame, key: str = "archive") -> DataFrame:
    return items.groupBy(key).pivot("type", rules.ITEM_TYPES).agg(F.count(F.lit(1))).na.fill(0)


def status_rollup(items: DataFrame, key: str = "archive") -> DataFrame:
    return items.groupBy(key).pivot("status", rules.STATUSES).agg(F.count(F.lit(1))).na.fill(0)


def map_rollup(mapping: DataFrame, key: str = "archive") -> DataFrame:
    """Entries of an identity map: all, changed, unchanged."""
    changed = F.col("source") != F.col("target")
    return mapping.groupBy(key).agg(
        F.count("*").alias("principals"),
        F.count_if(changed).alias("remapped"),
        F.count_if(~changed).alias("unchanged"),
    )


def object_inventory(items: DataFrame) -> DataFrame:
    """Distinct objects that items refer to: one row per (kind, name)."""
    principal = F.col("principal.name")
    who = F.when(F.col("principal.type") == "user", F.coalesce(service_account_kind(principal), F.lit("user"))).otherwise(
        F.col("principal.type")
    )
    schema = F.when(F.length("schema") > 0, F.col("schema"))
    entry = "struct<kind:string,name:string>"

    def one(test: Column, kind: Column | str, name: Column) -> Column:
        label = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(F.coalesce(test, F.lit(False)), F.struct(label, name).cast(entry))

    found = F.array_compact(
        F.array(
            one(F.col("catalog").isNotNull(), "catalog", F.col("catalog")),
            one(schema.isNotNull(), "schema", schema),
            one(schema.isNotNull() & (F.length("table") > 0), "table", F.concat_ws(".", schema, "table")),
            one(F.col("type") == "hdfs_grant", "volume", volume_name(F.col("path"))),
            one(F.col("type") == "udf_grant", "function", F.concat_ws(".", schema, "udf_name")),
            one((F.length(principal) > 0) & (F.col("principal.type") != "system"), who, principal),
        )
    )
    return unnest(items, found, "o", keep=["export_id"]).select("export_id", "o.*").distinct()


def referenced_columns(items: DataFrame) -> DataFrame:
    """Distinct columns that rules refer to: masked columns and columns of filter texts."""
    from ..functions.expressions import filter_columns

    names = F.when(F.col("type") == "column_mask", F.col("columns")).when(
        F.col("type") == "row_filter", filter_columns(F.col("filter_expr"))
    )
    ruled = items.filter(F.col("type").isin("row_filter", "column_mask"))
    return unnest(ruled, names, "column", keep=["export_id", "schema", "table"]).distinct()
