"""Conflicts, duplicates and nesting among items.

Groups are never gathered whole: members stay rows, and what is needed per group (its size, its
first member) is a plain aggregate that combines before the shuffle. Members find their group
again over unique item keys or through a join that Spark may split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import has_wildcard, path_ancestors, path_key
from .review import eligible
from .skew import skew_join
from .stage import stage

ITEM_KEY = ["export_id", "seq"]


def first_column() -> Column:
    return F.coalesce(F.get("columns", F.lit(0)), F.lit("col"))


def rule_targets(items: DataFrame) -> DataFrame:
    """Row filters and column masks with their target: schema, table and (masks) column."""
    return items.filter(
        F.col("type").isin("row_filter", "column_mask") & (F.length("table") > 0)
    ).withColumn("target_column", F.when(F.col("type") == "column_mask", first_column()).otherwise(""))


TARGET = ["export_id", "type", "schema", "table", "target_column"]


def rule_conflicts(items: DataFrame) -> DataFrame:
    """Targets with more than one rule: size and first item of each group."""
    return (
        rule_targets(items)
        .groupBy(*TARGET)
        .agg(F.count("*").alias("members"), F.min("seq").alias("first_seq"))
        .filter(F.col("members") > 1)
    )


def filter_conflicts(items: DataFrame) -> DataFrame:
    return rule_conflicts(items.filter(F.col("type") == "row_filter")).drop("target_column", "type")


def mask_conflicts(items: DataFrame) -> DataFrame:
    return rule_conflicts(items.filter(F.col("type") == "column_mask")).drop("type")


def conflict_members(items: DataFrame) -> DataFrame:
    """Rows of the rules that share their target, with the group's size and first item.

    Members and targets are narrow tables: only keys are written, and the join splits a target that holds
    a large part of all rules. Whole members are found again by their unique keys.
    """
    rules_ = stage(rule_targets(items).select("seq", *TARGET))
    numbers = rules_.groupBy(*TARGET).agg(F.count("*").alias("members"), F.min("seq").alias("first_seq")).filter("members > 1")
    key = [F.coalesce(c, F.lit("")).alias(c) for c in TARGET]  # a null schema equals itself
    nulls = F.col("schema").isNull().alias("no_schema")
    found = skew_join(rules_.select("seq", *key, nulls), numbers.select(*key, nulls, "members", "first_seq"), [*TARGET, "no_schema"])
    return rule_targets(items).join(found.select(*ITEM_KEY, "members", "first_seq"), ITEM_KEY)


def conflict_count(items: DataFrame) -> DataFrame:
    return rule_conflicts(items).groupBy("export_id").agg(
        F.count_if(F.col("type") == "row_filter").alias("filter_conflicts"),
        F.count_if(F.col("type") == "column_mask").alias("mask_conflicts"),
        F.count("*").alias("conflicts"),
    )


def unmerged(items: DataFrame) -> DataFrame:
    """Items that are not part of a merged rule."""
    return items.join(conflict_members(items).select(*ITEM_KEY), ITEM_KEY, "left_anti")


def grant_deny_conflicts(items: DataFrame) -> DataFrame:
    """(schema, table, principal) that has a grant and a deny among the eligible items.

    Both sides come out of one aggregate, so nothing is joined.
    """
    both = eligible(items).filter(F.col("type").isin("grant", "deny"))
    grouped = both.groupBy(
        "export_id", "schema", "table", F.coalesce("principal.name", F.lit("")).alias("principal_name")
    ).agg(
        F.bool_or(F.col("type") == "grant").alias("granted"),
        F.bool_or(F.col("type") == "deny").alias("denied"),
        F.min(F.when(F.col("type") == "deny", F.col("seq"))).alias("first_deny"),
    )
    return grouped.filter("granted AND denied").drop("granted", "denied")


def eligible_paths(items: DataFrame) -> DataFrame:
    """Distinct paths of eligible path grants, with their comparison key and first use."""
    return (
        eligible(items)
        .filter(F.col("type") == "hdfs_grant")
        .groupBy("export_id", F.coalesce("path", F.lit("/")).alias("path"))
        .agg(F.min("seq").alias("first_seq"))
        .withColumn("key", path_key(F.col("path")))
    )


def nested_paths(paths: DataFrame) -> DataFrame:
    """Parent and child among the distinct paths of an export.

    Each path offers every prefix of itself and meets the paths that equal one: an equi join whose
    input grows with path depth, not with the number of pairs.
    """
    offers = paths.select(
        "export_id", F.col("path").alias("child"), F.explode(path_ancestors(F.col("key"))).alias("key")
    )
    parents = paths.select("export_id", "key", F.col("path").alias("parent"))
    return offers.join(parents, ["export_id", "key"]).select("export_id", "parent", "child")


def wildcard_column_grants(items: DataFrame) -> DataFrame:
    """Eligible grants by wildcard column: one row per item and pattern."""
    rows = eligible(items).filter(
        (F.col("type") == "grant") & (F.length("table") > 0) & F.col("columns").isNotNull()
    )
    return rows.withColumn("pattern", F.explode("columns")).filter(
        has_wildcard(F.col("pattern")) & (F.col("pattern") != "*")
    )


PATTERN = ["export_id", "schema", "table", "pattern"]


def wildcard_column_groups(items: DataFrame) -> DataFrame:
    """Per (schema, table, pattern): number of items, number of principals, first item."""
    return wildcard_column_grants(items).groupBy(*PATTERN).agg(
        F.count("*").alias("members"),
        F.count_distinct("principal").alias("principals"),
        F.min("seq").alias("first_seq"),
    )


def wildcard_column_emitters(items: DataFrame) -> DataFrame:
    """The first item of each pattern group, which stands for the whole group.

    An item that leads several groups stands for the last of them, by order of first appearance.
    """
    position = F.posexplode("columns").alias("column_pos", "pattern")
    rows = eligible(items).filter(
        (F.col("type") == "grant") & (F.length("table") > 0) & F.col("columns").isNotNull()
    )
    spread = rows.select("export_id", "seq", "schema", "table", position).filter(
        has_wildcard(F.col("pattern")) & (F.col("pattern") != "*")
    )
    lead = spread.groupBy(*PATTERN).agg(F.min(F.struct("seq", "column_pos")).alias("lead"))
    return lead.groupBy("export_id", F.col("lead.seq").alias("seq")).agg(
        F.max_by(F.struct("schema", "table", "pattern"), "lead.column_pos").alias("group")
    ).select("export_id", "seq", "group.*")


def grant_signature() -> Column:
    """What makes two grants the same: schema, table, raw principal name, set of privileges."""
    return F.struct(
        "schema",
        "table",
        F.coalesce("principal.name", F.lit("")).alias("principal_name"),
        F.array_sort(F.coalesce("privileges", F.array().cast("array<string>"))).alias("privileges"),
    )


def taken_by_pattern() -> Column:
    """Whether a grant belongs to a wildcard-column group, or a deny to a column pattern."""
    by_pattern = F.exists(
        F.coalesce("columns", F.array().cast("array<string>")),
        lambda c: has_wildcard(c) & (c != "*"),
    )
    return by_pattern & (F.coalesce(F.length("table"), F.lit(0)) > 0)


def plain_grants(items: DataFrame) -> DataFrame:
    """Eligible grants that no wildcard-column group has taken over."""
    return eligible(items).filter((F.col("type") == "grant") & ~taken_by_pattern())


def first_grants(items: DataFrame) -> DataFrame:
    """Keys of the grants that come first among their equals."""
    return (
        plain_grants(items)
        .select("export_id", "seq", grant_signature().alias("sig"))
        .groupBy("export_id", "sig")
        .agg(F.min("seq").alias("seq"))
        .select(*ITEM_KEY)
    )


def kept_grants(items: DataFrame) -> DataFrame:
    return plain_grants(items).join(first_grants(items), ITEM_KEY, "left_semi")


def duplicate_grants(items: DataFrame) -> DataFrame:
    """Grants that repeat an earlier one. Found over unique item keys, so a hot signature is no burden."""
    return plain_grants(items).join(first_grants(items), ITEM_KEY, "left_anti")
