"""Warnings raised while policies are read: one explode per policy, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.principals import blank_entries
from ..functions.rows import unnest

WARNING = "struct<category:string,severity:string,detail:string,recommendation:string>"
SUB_ITEM_FIELDS = ["policyItems", "denyPolicyItems", "rowFilterPolicyItems", "dataMaskPolicyItems"]


def _warning(category: str, severity: str, detail: Column, recommendation: str) -> Column:
    return F.struct(F.lit(category), F.lit(severity), detail, F.lit(recommendation)).cast(WARNING)


def _one(test: Column, warning: Column) -> Column:
    return F.when(test, F.array(warning)).otherwise(F.array().cast(f"array<{WARNING}>"))


def _items(field: str) -> Column:
    return F.col(f"policy.{field}")


def condition_types() -> Column:
    """Sorted distinct condition types over the four sub-item lists of a policy."""
    none = F.array().cast("array<string>")

    def of(field: str) -> Column:
        types = F.flatten(
            F.transform(
                _items(field),
                lambda i: F.coalesce(
                    F.transform(F.filter(i["conditions"], lambda c: F.length(c["type"]) > 0), lambda c: c["type"]),
                    none,
                ),
            )
        )
        return F.coalesce(types, none)

    return F.array_sort(F.array_distinct(F.concat(*[of(f) for f in SUB_ITEM_FIELDS])))


def _blank_warnings() -> Column:
    none = F.array().cast(f"array<{WARNING}>")

    def of(field: str) -> Column:
        return F.coalesce(
            F.transform(
                _items(field),
                lambda i: F.array_join(blank_entries(i["groups"], i["users"], i["roles"]), "; "),
            ),
            F.array().cast("array<string>"),
        )

    labels = F.filter(F.concat(*[of(f) for f in SUB_ITEM_FIELDS]), lambda t: t != "")
    made = F.transform(
        labels,
        lambda t: F.struct(
            F.lit("blank_principal"),
            F.lit("warning"),
            t,
            F.lit("Give explicit user, group or role names; blank entries are left out."),
        ).cast(WARNING),
    )
    return F.coalesce(made, none)


def raised_warnings() -> Column:
    """Warnings of a policy with its ``condition_types``, in the order they are raised."""
    schedules = F.col("policy.validitySchedules")
    first = F.get(schedules, F.lit(0))
    types = F.col("condition_types")
    return F.concat(
        _one(
            ~F.coalesce("policy.isEnabled", F.lit(True)),
            _warning("disabled", "info", F.lit("policy is disabled"), "Decide whether the policy is still needed."),
        ),
        _one(
            F.coalesce("policy.isDenyAllElse", F.lit(False)),
            _warning(
                "deny_all_else", "critical", F.lit("everybody not listed is denied"),
                "Check who else has access; grants do not restrict anybody.",
            ),
        ),
        _one(
            F.coalesce(F.size(schedules), F.lit(0)) > 0,
            _warning(
                "validity_schedule", "warning",
                F.concat(F.coalesce(first["startTime"], F.lit("—")), F.lit(" → "), F.coalesce(first["endTime"], F.lit("no end"))),
                "Grants are permanent: revoke them when the period ends.",
            ),
        ),
        _one(
            F.size(types) > 0,
            _warning("conditions", "warning", F.array_join(types, ", "), "Enforce the conditions outside of the catalog."),
        ),
        _blank_warnings(),
    )


def policy_warnings(policies: DataFrame) -> DataFrame:
    """Warnings of each policy, in the order they are raised (``warn_pos``)."""
    head = ["export_id", "policy_pos", "policy_id", "policy_name"]
    raised = policies.withColumn("condition_types", condition_types()).select(
        "export_id",
        "policy_pos",
        F.col("policy.id").alias("policy_id"),
        F.col("policy.name").alias("policy_name"),
        raised_warnings().alias("found"),
    )
    return unnest(raised, "found", "w", "warn_pos", head).select(*head, "warn_pos", "w.*")


def deny_warnings(items: DataFrame) -> DataFrame:
    """One critical warning per deny item."""
    detail = F.concat(
        F.lit("DENY for "), "principal.name", F.lit(" on "), "schema", F.lit("."),
        F.coalesce("table", F.lit("*")), F.lit(" ["), F.array_join("privileges", ", "), F.lit("]"),
    )
    return items.filter(F.col("type") == "deny").select(
        "export_id",
        "seq",
        "policy_id",
        "policy_name",
        F.lit("deny").alias("category"),
        F.lit("critical").alias("severity"),
        detail.alias("detail"),
        F.lit("Move the data behind restricted grants, or hide it by filters and masks.").alias("recommendation"),
    )


def all_warnings(policies: DataFrame, items: DataFrame) -> DataFrame:
    """Policy warnings and deny warnings in raising order ``(export_id, seq)``."""
    from .items import sequence_number

    raised = policy_warnings(policies).withColumn("seq", sequence_number(F.col("policy_pos"), F.lit(0)))
    shape = ["export_id", "seq", "warn_pos", "policy_id", "policy_name", "category", "severity", "detail", "recommendation"]
    return raised.select(shape).unionByName(
        deny_warnings(items).withColumn("warn_pos", F.lit(0).cast("bigint")).select(shape)
    )
