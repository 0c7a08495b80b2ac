"""Tag policies: joins of policies to tagged resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.principals import PRINCIPAL
from ..functions.rows import unnest
from .items import (
    as_items,
    first_principal,
    policy_units,
    resource_values,
    sequence_number,
    text_or_none,
)
from .ranking import spread_row_number
from .skew import skew_join
from .stage import stage

# Resolved resources of one policy are joined in runs of this many, so that a policy whose tags
# cover a large part of all tables is spread over many tasks.
RUN = 1 << 14


def tag_set_items(resources: DataFrame, definitions: DataFrame, catalog: str = "main") -> DataFrame:
    """One item per tagged resource with the tag flags and attributes to set on it."""
    assigned = tag_assignments(resources, definitions)
    attrs = F.map_from_entries(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first_pos", "key", "value"))),
            lambda e: F.struct(e["key"], e["value"]),
        )
    )
    grouped = assigned.groupBy("export_id", "res_pos", "path", "schema", "table", "column").agg(
        attrs.alias("tag_attrs")
    )
    return as_items(
        grouped.select(
            "export_id",
            F.col("res_pos").alias("seq"),
            F.concat_ws("_", F.lit("tag_set"), "schema", "table", F.coalesce("column", F.lit("tbl"))).alias("id"),
            F.concat(F.lit("SET TAGS — "), "path").alias("policy_name"),
            F.lit("").alias("policy_desc"),
            F.lit("tag_set").alias("type"),
            F.lit(catalog).alias("catalog"),
            "schema",
            "table",
            "column",
            "tag_attrs",
            F.struct(F.lit("system").alias("type"), F.lit("").alias("name")).alias("principal"),
            F.lit(True).alias("enabled"),
            F.lit("pending").alias("status"),
        )
    )


def tag_assignments(resources: DataFrame, definitions: DataFrame) -> DataFrame:
    """Long form of the tag settings: one row per resource and key, the last write of a key wins.

    Writes come in the order of the tag list: first the tag itself as 'true', then its attributes.
    """
    at = ["export_id", "res_pos", "path", "schema", "table", "column"]
    defs = definitions.groupBy("export_id", "tag").agg(
        F.collect_list(F.struct("attr_pos", "key", "value")).alias("attrs")
    )
    flag = F.struct(
        F.lit(-1).cast("bigint").alias("attr_pos"), F.col("tag").alias("key"), F.lit("true").alias("value")
    )
    none = F.array().cast("array<struct<attr_pos:bigint,key:string,value:string>>")
    writes = unnest(
        skew_join(stage(resources), defs, ["export_id", "tag"], "left"),
        F.concat(F.array(flag), F.coalesce("attrs", none)),
        "w",
        keep=[*at, "tag_pos"],
    )
    pos = F.struct("tag_pos", "w.attr_pos")
    return writes.groupBy(*at, F.col("w.key").alias("key")).agg(
        F.max_by("w.value", pos).alias("value"), F.min(pos).alias("first_pos")
    )


# Bits of the order key that hold a resource position; the tag's place in the policy is above them.
POSITION_BITS = 40


def resolve_tags(policies: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources of each tag policy: first hit per (schema, table), with its rank ``hit``.

    Resources are reduced to the first one per tag, schema and table before they meet policies, so
    a tag on very many columns joins once per table. The order of hits is one long, which keeps
    both aggregates hash aggregates that combine before the shuffle; the column of the winning
    resource is fetched by its position afterwards.
    """
    wanted = policies.filter(F.size(resource_values("tag")) > 0).select(
        "export_id",
        "policy_pos",
        F.posexplode(resource_values("tag")).alias("list_pos", "tag"),
    )
    per_tag = resources.groupBy("export_id", "tag", "schema", "table").agg(F.min("res_pos").alias("res_pos"))
    order = F.shiftleft(F.col("list_pos").cast("bigint"), POSITION_BITS) + F.col("res_pos")
    first = (
        skew_join(stage(per_tag), wanted, ["export_id", "tag"])
        .groupBy("export_id", "policy_pos", "schema", "table")
        .agg(F.min(order).alias("ord"))
    )
    ranked = spread_row_number(first, ["export_id", "policy_pos"], "ord", "hit")
    columns = resources.select("export_id", "res_pos", "column").distinct()
    position = F.col("ord").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return ranked.withColumn("res_pos", position).join(columns, ["export_id", "res_pos"]).select(
        "export_id", "policy_pos", "schema", "table", "column", "hit"
    )


def _tag_units(policies: DataFrame) -> DataFrame:
    return policy_units(policies.filter(F.size(resource_values("tag")) > 0))


def tag_items(policies: DataFrame, resources: DataFrame, catalog: str = "main") -> DataFrame:
    """Items of tag policies: grants, placeholders, row filters and column masks.

    Sub-items meet the resolved resources by a left join on (export, policy, run), so one key has
    at most ``RUN`` resources; policies without any resource keep placeholder names.
    """
    hits = resolve_tags(policies, resources).withColumn(
        "run", F.floor((F.col("hit") - 1) / RUN).cast("bigint")
    )
    totals = hits.groupBy("export_id", "policy_pos").agg(F.count("*").alias("found"))
    key = ["export_id", "policy_pos"]
    counted = _tag_units(policies).join(totals, key, "left").na.fill(0, ["found"])

    # Everything that is the same for all resources of a sub-item, before the fan-out.
    kind, found = F.col("kind"), F.col("found")
    item_type = (
        F.when((kind == "allow") & (found > 0), "tag_grant")
        .when(kind == "allow", "tag_placeholder")
        .when(kind == "filter", "row_filter")
        .otherwise("column_mask")
    )
    id_kind = (
        F.when(kind == "filter", "rowfilter-tag").when(kind == "mask", "mask-tag").otherwise(F.col("type"))
    )
    names = F.array_join("tag_names", "_")
    leaf = f"array<struct<principal:{PRINCIPAL},leaf_no:bigint>>"
    people = F.transform("principals", lambda p, i: F.struct(p, i + F.lit(1))).cast(leaf)
    first = F.array(F.struct(first_principal(), F.lit(1))).cast(leaf)
    rule = kind.isin("filter", "mask")
    prepared = counted.withColumn("type", item_type).select(
        *key,
        "policy_id",
        "policy_name",
        "policy_desc",
        "type",
        "stride",
        "enabled",
        "privileges",
        (F.col("offset") * F.greatest(found, F.lit(1))).alias("base"),
        F.concat_ws("-", text_or_none(F.col("policy_id")), id_kind).alias("id_head"),
        F.concat(F.lit("<schema_with_"), names, F.lit(">")).alias("no_schema"),
        F.concat(F.lit("<table_with_"), names, F.lit(">")).alias("no_table"),
        F.concat(F.lit("<col_with_"), names, F.lit(">")).alias("no_column"),
        F.when(F.col("type") != "tag_placeholder", F.lit(catalog)).alias("catalog"),
        F.when(~rule, F.col("tag_names")).alias("tag_names"),
        F.when(rule, F.col("principals")).alias("all_principals"),
        F.when(kind == "filter", F.col("filter_expr")).alias("filter_expr"),
        F.when(kind == "mask", F.col("mask_type")).alias("mask_type"),
        F.when(kind == "mask", F.col("mask_expr")).alias("mask_expr"),
        F.when(F.col("type") == "tag_grant", F.col("delegate_admin")).alias("delegate_admin"),
        F.when(F.col("type") == "tag_grant", "pending").otherwise("needs_review").alias("status"),
        F.when(kind == "allow", people).otherwise(first).alias("leaves"),
        F.sequence(
            F.lit(0).cast("bigint"), F.greatest(F.floor((found - 1) / RUN), F.lit(0).cast("bigint"))
        ).alias("runs"),
    )
    by_run = unnest(prepared, "runs", "run", keep=[c for c in prepared.columns if c != "runs"])
    placed = by_run.join(hits, [*key, "run"], "left").drop("run")
    rows = unnest(placed, "leaves", "leaf", keep=[c for c in placed.columns if c != "leaves"])

    hit = F.coalesce("hit", F.lit(1).cast("bigint"))
    rows = rows.withColumn("number", F.col("base") + (hit - 1) * F.col("stride") + F.col("leaf.leaf_no"))
    kind = F.col("type")
    named = kind != "tag_placeholder"
    masked = F.when(kind == "column_mask", F.coalesce("column", "no_column"))
    table = F.when(named, F.coalesce("table", "no_table"))
    item_id = F.concat_ws(
        "-", "id_head", F.when(kind == "tag_grant", F.col("schema")), table, masked, "leaf.principal.name", "number"
    )
    return as_items(
        rows.select(
            "export_id",
            sequence_number(F.col("policy_pos"), F.col("number")).alias("seq"),
            item_id.alias("id"),
            "policy_id",
            "policy_name",
            "policy_desc",
            "type",
            "catalog",
            F.when(named, F.coalesce("schema", "no_schema")).alias("schema"),
            table.alias("table"),
            F.when(masked.isNotNull(), F.array(masked)).alias("columns"),
            "tag_names",
            "privileges",
            "leaf.principal",
            "all_principals",
            "filter_expr",
            "mask_type",
            "mask_expr",
            "delegate_admin",
            "enabled",
            "status",
        )
    )
