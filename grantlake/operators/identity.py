"""Identities, the identity map, membership and service-account findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import unnest
from ..functions.principals import principal_list, resolved_name, service_account_kind
from .skew import skew_join
from .stage import stage


def _every_item(fields: list[str]) -> Column:
    empty = F.array().cast("array<struct<groups:array<string>,users:array<string>,roles:array<string>>>")
    return F.concat(
        *[
            F.coalesce(
                F.transform(
                    F.col(f"policy.{f}"), lambda i: F.named_struct(
                        F.lit("groups"), i["groups"], F.lit("users"), i["users"], F.lit("roles"), i["roles"])
                ),
                empty,
            )
            for f in fields
        ]
    )


def identities(policies: DataFrame) -> DataFrame:
    """Distinct (type, name) of the principals of every sub-item that reaches the item fact."""
    from .items import route

    tag_fields = ["policyItems", "rowFilterPolicyItems", "dataMaskPolicyItems"]
    fields = ["policyItems", "denyPolicyItems", "rowFilterPolicyItems", "dataMaskPolicyItems"]
    routed = policies.withColumn("route", route())
    used = (
        F.when(F.col("route") == "table", _every_item(fields))
        .when(F.col("route") == "tag", _every_item(tag_fields))
        .otherwise(_every_item(["policyItems"]))
    )
    sub_items = unnest(routed, used, "i", keep=["export_id"])
    named = unnest(
        sub_items, principal_list(F.col("i.groups"), F.col("i.users"), F.col("i.roles")), "p", keep=["export_id"]
    )
    return named.select("export_id", "p.type", "p.name").distinct()


def sorted_identities(policies: DataFrame) -> DataFrame:
    return identities(policies).orderBy("export_id", "type", "name")


def search_identities(found: DataFrame, kind: str | None = None, term: str | None = None) -> DataFrame:
    if kind:
        found = found.filter(F.col("type") == kind)
    if term:
        found = found.filter(F.lower("name").contains(term.lower()))
    return found


def named_users() -> Column:
    """All users that the sub-items of a policy name, as often as they occur."""
    fields = ["policyItems", "denyPolicyItems", "dataMaskPolicyItems", "rowFilterPolicyItems"]
    return F.flatten(
        F.concat(
            *[
                F.coalesce(
                    F.transform(
                        F.col(f"policy.{f}"),
                        lambda i: F.coalesce(i["users"], F.array().cast("array<string>")),
                    ),
                    F.array().cast("array<array<string>>"),
                )
                for f in fields
            ]
        )
    )


def service_accounts(policies: DataFrame) -> DataFrame:
    """Users that look like Kerberos or service accounts, one row per occurrence."""
    listed = policies.select(
        "export_id",
        "policy_pos",
        F.col("policy.id").alias("policy_id"),
        F.col("policy.name").alias("policy_name"),
        named_users().alias("users"),
    )
    head = [c for c in listed.columns if c != "users"]
    rows = unnest(listed, "users", "principal", "user_pos", head).withColumn(
        "kind", service_account_kind(F.col("principal"))
    )
    is_realm = F.col("principal").contains("@")
    return rows.filter(F.col("kind").isNotNull()).select(
        "export_id",
        "policy_pos",
        "user_pos",
        "policy_id",
        "policy_name",
        "principal",
        "kind",
        F.lit("warning").alias("severity"),
        F.concat(
            F.lit('"'), "principal", F.lit('" looks like a '),
            F.when(is_realm, "Kerberos principal").otherwise("service account"),
            F.lit(" and needs a target identity"),
        ).alias("message"),
        F.when(is_realm, "Map to a user of the identity provider and drop the realm suffix.")
        .otherwise("Create a service principal with token login in place of a keytab.")
        .alias("recommendation"),
    )


def default_identity_map(found: DataFrame) -> DataFrame:
    """Every name mapped to itself, once per export."""
    return found.select("export_id", F.col("name").alias("source"), F.col("name").alias("target")).distinct()


def apply_edits(mapping: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited targets over the present map; new names are added.

    The map and the edits are merged by one aggregate: an edit outranks the entry it replaces.
    """
    ranked = mapping.withColumn("rank", F.lit(0)).unionByName(edits.withColumn("rank", F.lit(1)))
    return ranked.groupBy("export_id", "source").agg(F.max_by("target", "rank").alias("target"))


def identity_table(found: DataFrame, accounts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapping view: type, name, Kerberos flag and target of each identity."""
    flagged = accounts.select("export_id", F.col("principal").alias("name")).distinct()
    targets = mapping.select("export_id", F.col("source").alias("name"), "target")
    return (
        found.join(flagged.withColumn("flag", F.lit(True)), ["export_id", "name"], "left")
        .join(targets, ["export_id", "name"], "left")
        .select(
            "export_id",
            "type",
            "name",
            F.coalesce("flag", F.lit(False)).alias("is_kerberos"),
            F.coalesce("target", "name").alias("target"),
        )
    )


def map_principals(items: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Add ``principal_type`` and ``principal_name`` (target name) to items.

    The map is aggregated to one row per name, so an item never doubles. Whether it is sent to
    all tasks or shuffled is left to the size-based choice of Spark.
    """
    kind = F.coalesce("principal.type", F.lit("group"))
    raw = F.when(F.length("principal.name") > 0, F.col("principal.name")).otherwise("unknown")
    rows = items.withColumns({"principal_type": kind, "raw_principal": raw})
    if mapping is None:
        return rows.withColumn("principal_name", resolved_name(F.col("principal_type"), F.col("raw_principal")))
    changed = mapping.filter(F.col("source") != F.col("target")).select(
        "export_id", F.col("source").alias("raw_principal"), "target"
    )
    joined = rows.join(changed, ["export_id", "raw_principal"], "left")
    named = F.coalesce("target", "raw_principal")
    return joined.withColumn("principal_name", resolved_name(F.col("principal_type"), named)).drop("target")


def rules_of_user(items: DataFrame, membership: DataFrame, user: str) -> DataFrame:
    """Items that apply to one user: named directly, or through a group or role of theirs.

    ``membership`` has columns user and group; only the rows of this user are read from it.
    """
    mine = membership.filter(F.col("user") == user).select(F.col("group").alias("principal_name")).distinct()
    by_name = items.filter((F.col("principal_type") == "user") & (F.col("principal_name") == user))
    by_group = items.filter(F.col("principal_type") != "user").join(mine, "principal_name", "left_semi")
    return by_name.unionByName(by_group.select(by_name.columns))


def covered_counts(items: DataFrame, membership: DataFrame) -> DataFrame:
    """How many users each group or role item covers, and the first of them: (export_id, seq, members,
    first_user). Groups are counted before they meet items, so a group that everybody uses moves as
    one row."""
    groups = membership.groupBy(F.col("group").alias("principal_name")).agg(
        F.count_distinct("user").alias("members"), F.min("user").alias("first_user")
    )
    rows = items.filter(F.col("principal_type") != "user").join(groups, "principal_name")
    return rows.select("export_id", "seq", "members", "first_user")


def covered_members(items: DataFrame, membership: DataFrame) -> DataFrame:
    """Users each group or role item covers: (export_id, seq, user). A group that very many items name is
    split over runs."""
    rows = stage(items.filter(F.col("principal_type") != "user").select("export_id", "seq", "principal_name"))
    members = membership.select(F.col("group").alias("principal_name"), "user")
    return skew_join(rows, members, ["principal_name"]).select("export_id", "seq", "user")
