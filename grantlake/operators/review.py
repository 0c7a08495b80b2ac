"""Review of items: eligibility, search, status changes, labels, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expressions import REQUEST_CONTEXT


def not_translatable() -> Column:
    kind = F.col("type")
    spaces = (kind == "hbase_grant") & (F.col("schema") == rules.ALL_NAMESPACES)
    return kind.isin("deny", "tag_placeholder") | F.coalesce(spaces, F.lit(False))


def eligible(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status").isin("approved", "needs_review"))


def executable(items: DataFrame) -> DataFrame:
    return eligible(items).filter(~not_translatable())


def advisory_only(items: DataFrame) -> DataFrame:
    return eligible(items).filter(not_translatable())


def search(items: DataFrame, kind: str | None = None, status: str | None = None, term: str | None = None) -> DataFrame:
    """Items of a type and status whose policy, schema, table or principal holds ``term``."""
    if kind:
        items = items.filter(F.col("type") == kind)
    if status:
        items = items.filter(F.col("status") == status)
    if term:
        text = [F.coalesce(c, F.lit("")) for c in ("policy_name", "schema", "table", "principal.name")]
        items = items.filter(F.lower(F.concat_ws(" ", *text)).contains(term.lower()))
    return items


def approve_valid(items: DataFrame) -> DataFrame:
    """Approve every translatable item that is enabled and not rejected."""
    ok = ~not_translatable() & F.coalesce("enabled", F.lit(True)) & (F.col("status") != "rejected")
    return items.withColumn("status", F.when(ok, "approved").otherwise(F.col("status")))


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set single statuses: ``decisions`` has export_id, id, status and may have ``order``.

    Where an id occurs more than once in an export, only its first item changes. Of several
    decisions on one id the last in ``order`` counts (then, or without it, the last by status).
    """
    order = F.struct("order", "status") if "order" in decisions.columns else F.col("status")
    chosen = decisions.groupBy("export_id", "id").agg(F.max_by("status", order).alias("decided"))
    targets = (
        items.join(chosen, ["export_id", "id"])
        .groupBy("export_id", "id")
        .agg(F.min("seq").alias("seq"), F.any_value("decided").alias("decided"))
        .drop("id")
    )
    return (
        items.join(targets, ["export_id", "seq"], "left")
        .withColumn("status", F.coalesce("decided", "status"))
        .select(items.columns)
    )


def unresolvable_resource() -> Column:
    """Schema or table holds a request-context mark, so no fixed name exists."""
    return F.coalesce(F.col("schema").rlike(REQUEST_CONTEXT), F.lit(False)) | F.coalesce(
        F.col("table").rlike(REQUEST_CONTEXT), F.lit(False)
    )


def user_mark_principal() -> Column:
    return F.coalesce(F.col("principal.name").contains("{USER}"), F.lit(False))


def guard_code() -> Column:
    """Why an item stays advisory whatever its type, else null."""
    return F.when(unresolvable_resource(), "dynamic_resource").when(
        user_mark_principal(), "user_mark_principal"
    )


def resource_label(catalog: Column | None = None) -> Column:
    """How the review list shows the resource of an item."""
    cat = F.lit("main") if catalog is None else catalog
    kind, schema, table = F.col("type"), F.coalesce("schema", F.lit("")), F.col("table")
    return (
        F.when(kind == "tag_set", F.concat_ws(".", cat, schema, "table", F.when(F.col("column") != "", F.col("column"))))
        .when(kind == "tag_placeholder", F.concat(F.lit("tags: "), F.array_join("tag_names", ", ")))
        .when(kind == "hdfs_grant", F.coalesce("path", F.lit("/")))
        .when(schema != "", F.concat_ws(".", cat, schema, F.coalesce(table, F.lit("*"))))
        .otherwise(F.concat(cat, F.lit(".*")))
    )
