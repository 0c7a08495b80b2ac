"""Gap analysis: what cannot be carried over, as rows and as a summary.

Items are read once. Every item yields the categories it falls into through one explode; only the
conflict groups need an aggregate of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expressions import expression_issues, is_clean
from ..functions.principals import lookup, service_account_kind
from ..functions.rows import unnest
from .conflicts import rule_conflicts
from .identity import named_users
from .warnings import condition_types, raised_warnings

# Gap categories in report order, with severity and title.
CATEGORIES = {
    "deny": ("critical", "Deny Policies"),
    "service_account": ("critical", "Kerberos / Service Accounts"),
    "delegate_admin": ("warning", "Delegate Admin"),
    "no_equivalent": ("warning", "Service-Specific Privileges (No Equivalent)"),
    "drop_to_manage": ("warning", "DROP Privilege Converted to MANAGE"),
    "create_dropped": ("warning", "CREATE Privilege Dropped (Table Scope)"),
    "wildcard_table": ("warning", "Wildcard Table Access"),
    "disabled": ("info", "Disabled Policies"),
    "filter_untranslatable": ("critical", "Row Filters with Untranslatable Expressions"),
    "filter_translated": ("warning", "Row Filter Translation"),
    "conflict": ("warning", "Row Filter / Column Mask Conflicts Merged"),
    "deny_all_else": ("critical", "isDenyAllElse Policies"),
    "validity_schedule": ("warning", "Time-Limited Policies"),
    "blank_principal": ("warning", "Blank / Empty Principals Skipped"),
    "conditions": ("warning", "Policy Conditions (Not Translated)"),
}
FROM_WARNINGS = ["deny_all_else", "validity_schedule", "blank_principal", "conditions"]
#: Fixed value: how many disabled policies a report lists unless told otherwise.
DISABLED_PREVIEW = 10
REMEDIATION = {
    "deny": "Move the data into schemas with restricted grants, or use row filters and masks.",
    "service_account": "Create a service principal for each account and map users to the identity provider.",
    "delegate_admin": "Grant MANAGE on the object, or make the principal an administrator.",
    "no_equivalent": "Check whether a dropped privilege needs a grant by hand.",
    "drop_to_manage": "Grant ALL PRIVILEGES or ownership where objects must be dropped.",
    "create_dropped": "Grant MODIFY or ALL PRIVILEGES on the table as needed.",
    "wildcard_table": "Check whether a grant on the whole schema is meant.",
    "disabled": "Confirm that the policies are switched off on purpose.",
    "filter_untranslatable": "Rewrite the filters with group tests, user tests or a lookup table.",
    "filter_translated": "Review and test the filter functions.",
    "conflict": "Check the branches of each merged function.",
    "deny_all_else": "Check everybody with access; grant to listed principals only.",
    "validity_schedule": "Revoke the grants when the period ends.",
    "blank_principal": "Give explicit names and export again.",
    "conditions": "Enforce the conditions at the network or application layer.",
}

ENTRY = "struct<category:string,resource:string,principal:string,detail:string>"
GAP_COLUMNS = ["export_id", "category", "seq", "resource", "principal", "detail"]


def dropped_privileges() -> Column:
    """Privileges of an item without a counterpart, in item order."""
    return F.filter("privileges", lambda p: p.isin("EXECUTE", *rules.NO_EQUIVALENT))


def item_tests() -> dict[str, Column]:
    """Whether an item falls into each category that follows from single items. No text is built here."""
    kind = F.col("type")
    grants = kind.isin("grant", "hbase_grant")
    clean = is_clean(F.coalesce("filter_expr", F.lit("")))
    return {
        "deny": kind == "deny",
        "delegate_admin": F.col("delegate_admin"),
        "no_equivalent": kind.isin("grant", "hbase_grant", "tag_grant") & (F.size(dropped_privileges()) > 0),
        "drop_to_manage": grants & F.array_contains("privileges", "DROP"),
        "create_dropped": grants & F.col("table").isNotNull() & F.array_contains("privileges", "CREATE"),
        "wildcard_table": (kind == "grant") & F.col("table").isNull(),
        "disabled": ~F.col("enabled"),
        "filter_untranslatable": (kind == "row_filter") & ~clean,
        "filter_translated": (kind == "row_filter") & clean,
    }


def item_gaps(items: DataFrame) -> DataFrame:
    """Gap rows that follow from single items."""
    schema = F.coalesce("schema", F.lit("None"))
    place = F.concat_ws(".", schema, F.when(F.length("table") > 0, F.col("table")).otherwise("*"))
    table = F.concat_ws(".", schema, "table")
    privileges = F.coalesce(F.array_join("privileges", ", "), F.lit(""))
    issues = F.array_join(F.transform(expression_issues(F.col("filter_expr")), lambda i: i["code"]), "; ")
    filter_text = F.coalesce("filter_expr", F.lit(""))
    shown = {
        "deny": (place, privileges),
        "delegate_admin": (place, F.lit("delegated administration")),
        "no_equivalent": (place, F.array_join(dropped_privileges(), ", ")),
        "drop_to_manage": (place, privileges),
        "create_dropped": (table, privileges),
        "wildcard_table": (F.concat(schema, F.lit(".*")), privileges),
        "disabled": (place, F.col("policy_name")),
        "filter_untranslatable": (table, F.concat(filter_text, F.lit(" — "), issues)),
        "filter_translated": (table, filter_text),
    }

    def entry(category: str, test: Column) -> Column:
        made = F.struct(F.lit(category), shown[category][0], F.col("principal.name"), shown[category][1]).cast(ENTRY)
        return F.when(F.coalesce(test, F.lit(False)), made)

    entries = F.array_compact(F.array(*[entry(c, t) for c, t in item_tests().items()]))
    return unnest(items, entries, "e", keep=["export_id", "seq"]).select(
        "export_id", "e.category", "seq", "e.resource", "e.principal", "e.detail"
    )


def item_gap_counts(items: DataFrame) -> DataFrame:
    """(export, category, items) of the categories of single items: one aggregate with a counter per
    category, over the few columns the tests read."""
    tests = item_tests()
    counted = items.groupBy("export_id").agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(c) for c, t in tests.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("items")) for c in tests])
    return unnest(counted, pairs, "p", keep=["export_id"]).select("export_id", "p.category", "p.items").filter(F.col("items") > 0)


def gap_counts(policies: DataFrame, items: DataFrame) -> DataFrame:
    """(export, category, items) of all categories; no gap row is built for it."""
    conflicts = rule_conflicts(items).groupBy("export_id").agg(F.count("*").alias("items"))
    others = policy_gaps(policies).groupBy("export_id", "category").agg(F.count("*").alias("items"))
    return (
        item_gap_counts(items)
        .unionByName(conflicts.select("export_id", F.lit("conflict").alias("category"), "items"))
        .unionByName(others)
    )


def conflict_gaps(items: DataFrame) -> DataFrame:
    """One gap row per target that several rules share (over all items, not only eligible ones)."""
    what = F.when(F.col("type") == "row_filter", "row filter conflict").otherwise("column mask conflict")
    column = F.when(F.col("target_column") != "", F.col("target_column"))
    return rule_conflicts(items).select(
        "export_id",
        F.lit("conflict").alias("category"),
        F.col("first_seq").alias("seq"),
        F.concat_ws(".", F.coalesce("schema", F.lit("None")), "table", column).alias("resource"),
        F.lit(None).cast("string").alias("principal"),
        F.concat_ws(", ", what, F.concat("members", F.lit(" rules merged"))).alias("detail"),
    )


def policy_gaps(policies: DataFrame) -> DataFrame:
    """Gap rows that follow from policies: warnings and service accounts. Policies are read once."""
    name, none = F.col("policy.name"), F.array().cast(f"array<{ENTRY}>")
    warned = F.transform(
        F.filter(raised_warnings(), lambda w: w["category"].isin(FROM_WARNINGS)),
        lambda w: F.struct(
            w["category"], F.coalesce(name, F.lit("—")),
            F.when(w["category"] == "blank_principal", "— (blank)").otherwise("—"), w["detail"],
        ).cast(ENTRY),
    )
    accounts = F.transform(
        F.filter(named_users(), lambda u: service_account_kind(u).isNotNull()),
        lambda u: F.struct(
            F.lit("service_account"), name, u,
            F.when(service_account_kind(u) == "kerberos_principal", "realm principal").otherwise("service account"),
        ).cast(ENTRY),
    )
    rows = policies.withColumn("condition_types", condition_types()).select(
        "export_id", F.col("policy_pos").alias("seq"), F.concat(F.coalesce(warned, none), F.coalesce(accounts, none)).alias("entries")
    )
    return unnest(rows, "entries", "e", keep=["export_id", "seq"]).select(
        "export_id", "e.category", "seq", "e.resource", "e.principal", "e.detail"
    )


def gap_items(policies: DataFrame, items: DataFrame) -> DataFrame:
    """All gap rows of all categories."""
    return item_gaps(items).unionByName(conflict_gaps(items)).unionByName(policy_gaps(policies))


def category_order(category: Column) -> Column:
    numbers = {c: n for n, c in enumerate(CATEGORIES, 1)}
    return F.create_map(*[F.lit(x) for p in numbers.items() for x in p])[category]


def severity_of(category: Column) -> Column:
    return lookup({c: s for c, (s, _) in CATEGORIES.items()})[category]


def title_of(category: Column) -> Column:
    return lookup({c: t for c, (_, t) in CATEGORIES.items()})[category]


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Per export and category: severity, title, count. Empty categories are absent.

    ``gaps`` are rows, one per gap, or counts of them (``gap_counts``).
    """
    if "items" not in gaps.columns:
        gaps = gaps.groupBy("export_id", "category").agg(F.count("*").alias("items"))
    return gaps.select(
        "export_id",
        category_order(F.col("category")).alias("position"),
        "category",
        title_of(F.col("category")).alias("title"),
        severity_of(F.col("category")).alias("severity"),
        "items",
    )


def listed_gaps(gaps: DataFrame, disabled_preview: int | None = DISABLED_PREVIEW) -> DataFrame:
    """Gap rows as a report lists them: all, but only the first disabled ones per export (None: all).

    The row limit is applied before and after the shuffle, so a large group sends that many rows
    per task and no more. ``unlisted_gaps`` counts what is left out.
    """
    if disabled_preview is None:
        return gaps
    window = Window.partitionBy("export_id").orderBy("seq")
    disabled = (
        gaps.filter(F.col("category") == "disabled")
        .withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= disabled_preview)
        .drop("rank")
    )
    return gaps.filter(F.col("category") != "disabled").unionByName(disabled)


def unlisted_gaps(summary: DataFrame, disabled_preview: int | None = DISABLED_PREVIEW) -> DataFrame:
    """Categories of ``gap_summary`` that ``listed_gaps`` shows in part, with the number left out."""
    more = F.col("items") - F.lit(disabled_preview if disabled_preview is not None else 2**62)
    return summary.filter((F.col("category") == "disabled") & (more > 0)).withColumn("unlisted", more)
