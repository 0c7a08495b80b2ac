"""Policy rows to policy items: one explode pipeline, no shuffle.

The reference order of items inside a policy is a plain nested loop, so the running number of an
item follows from array sizes and positions. That keeps the whole step row by row: no window, no
sort, no group that could grow hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.principals import (
    PRINCIPAL,
    access_list,
    blank_entries,
    lookup,
    principal_count,
    principal_list,
)
from ..functions.rows import once, unnest
from ..sources.exports import SUB_ITEM

# Columns of the item fact, in order.
ITEM_COLUMNS = {
    "export_id": "string",
    "seq": "bigint",
    "id": "string",
    "policy_id": "bigint",
    "policy_name": "string",
    "policy_desc": "string",
    "type": "string",
    "catalog": "string",
    "schema": "string",
    "table": "string",
    "columns": "array<string>",
    "column": "string",
    "path": "string",
    "is_recursive": "boolean",
    "col_families": "array<string>",
    "udf_name": "string",
    "tag_names": "array<string>",
    "tag_attrs": "map<string,string>",
    "privileges": "array<string>",
    "principal": PRINCIPAL,
    "all_principals": f"array<{PRINCIPAL}>",
    "filter_expr": "string",
    "mask_type": "string",
    "mask_expr": "string",
    "conditions": "array<struct<type:string,values:array<string>>>",
    "deny_exceptions": f"array<{PRINCIPAL}>",
    "blanks": "array<string>",
    "delegate_admin": "boolean",
    "enabled": "boolean",
    "status": "string",
}

NEEDS_REVIEW = ["deny", "row_filter", "column_mask", "tag_placeholder", "skipped_blank_principal"]
# Running numbers of one policy stay below this, so (policy position, number) packs into a long.
PER_POLICY = 1 << 32


def as_items(df: DataFrame) -> DataFrame:
    """Give a frame the item-fact columns; what it lacks is null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in ITEM_COLUMNS.items()
        ]
    )


def resource_values(name: str) -> Column:
    return F.col("policy.resources")[name]["values"]


def values_or(values: Column, default: str) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(default)))


def resource_defaults(policies: DataFrame) -> DataFrame:
    """Add the resource lists of each policy, with the default of each kind where none is given."""
    return policies.withColumns(
        {
            "databases": values_or(resource_values("database"), "default"),
            "tables": values_or(resource_values("table"), "*"),
            "columns": values_or(resource_values("column"), "*"),
            "paths": values_or(resource_values("path"), "/"),
            "families": values_or(resource_values("column-family"), "*"),
        }
    )


def route() -> Column:
    """The one branch a policy takes: tag, path, kv, url, function or table."""

    def given(name: str) -> Column:
        return F.size(resource_values(name)) > 0

    service = F.col("service_type")
    return (
        F.when(given("tag"), "tag")
        .when(service == "hdfs", "path")
        .when(service == "hbase", "kv")
        .when(given("url"), "url")
        .when(given("udf"), "function")
        .otherwise("table")
    )


def access_table() -> Column:
    """Access words of the policy's route; the functions route has none."""
    where = F.col("route")
    return (
        F.when(where.isin("path", "url"), lookup(rules.PATH_ACCESS))
        .when(where == "kv", lookup(rules.KV_ACCESS))
        .when(where != "function", lookup(rules.TABLE_ACCESS))
    )


def sub_items(policies: DataFrame) -> DataFrame:
    """One row per sub-item (``kind``, ``item``) with its ``stride`` and ``offset``.

    ``stride`` is how many running numbers the sub-item takes per resource, ``offset`` the sum of
    the strides before it. Only sub-items that the route of the policy reads are kept, and the
    policy itself is left behind, so a long policy is not copied along with each of its sub-items.
    """
    where = F.col("route")
    none = F.array().cast(f"array<struct<kind:string,item:{SUB_ITEM}>>")

    def of(field: str, kind: str, on: Column) -> Column:
        tagged = F.transform(
            F.col(f"policy.{field}"), lambda i: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("item"), i)
        )
        return F.when(on & tagged.isNotNull(), tagged).otherwise(none)

    tag_or_table = where.isin("tag", "table")
    exceptions = F.flatten(
        F.transform(F.col("policy.denyExceptions"), lambda i: principal_list(i["groups"], i["users"], i["roles"]))
    )
    recursive = F.coalesce(
        F.when(where == "path", F.col("policy.resources")["path"]["isRecursive"]).when(
            where == "url", F.col("policy.resources")["url"]["isRecursive"]
        ),
        F.lit(False),
    )
    listed = resource_defaults(policies.withColumn("route", route())).select(
        "export_id",
        "policy_pos",
        "route",
        F.col("policy.id").alias("policy_id"),
        F.col("policy.name").alias("policy_name"),
        F.coalesce("policy.description", F.lit("")).alias("policy_desc"),
        F.coalesce("policy.isEnabled", F.lit(True)).alias("enabled"),
        _outer().alias("outer"),
        _inner().alias("inner"),
        F.col("columns").alias("all_columns"),
        F.when(where == "kv", F.col("families")).alias("families"),
        F.when(where == "tag", resource_values("tag")).alias("tag_names"),
        recursive.alias("is_recursive"),
        F.when(where == "table", exceptions).alias("deny_exceptions"),
        F.concat(
            of("policyItems", "allow", F.lit(True)),
            of("denyPolicyItems", "deny", where == "table"),
            of("rowFilterPolicyItems", "filter", tag_or_table),
            of("dataMaskPolicyItems", "mask", tag_or_table),
        ).alias("listed"),
    )
    advisory_slot = F.when(where == "table", 1).otherwise(0)
    masked = F.when(where == "table", F.size("all_columns")).otherwise(1)

    def stride(u: Column) -> Column:
        people = principal_count(u["item"]["groups"], u["item"]["users"], u["item"]["roles"])
        return (
            F.when(u["kind"] == "filter", 1)
            .when(u["kind"] == "mask", masked)
            .when(u["kind"] == "allow", people + advisory_slot)
            .otherwise(people)
            .cast("bigint")
        )

    strided = listed.withColumn("stride", F.transform("listed", stride))
    offsets = F.aggregate(
        F.col("stride"),
        F.named_struct(F.lit("out"), F.array().cast("array<bigint>"), F.lit("sum"), F.lit(0).cast("bigint")),
        lambda acc, n: F.named_struct(
            F.lit("out"), F.array_append(acc["out"], acc["sum"]), F.lit("sum"), acc["sum"] + n
        ),
        lambda acc: acc["out"],
    )
    kept = [c for c in listed.columns if c != "listed"]
    zipped = strided.select(*kept, F.arrays_zip("listed", "stride", offsets.alias("offset")).alias("zipped"))
    return unnest(zipped, "zipped", "n", keep=kept).select(
        *kept, "n.listed.kind", "n.listed.item", "n.stride", "n.offset"
    )


def policy_units(policies: DataFrame) -> DataFrame:
    """Sub-items with everything an item needs: principals, privileges, rule texts, resources."""
    where, item, kind = F.col("route"), F.col("item"), F.col("kind")
    unknown = F.when(where == "url", F.lit(rules.URL_UNKNOWN_ACCESS))
    rows = sub_items(policies).withColumn("granted", access_list(item["accesses"], access_table(), unknown))
    privileges = (
        F.when(kind == "deny", F.col("granted"))
        .when(kind == "allow", F.when(where != "function", F.array_distinct("granted")))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("item", "granted", "deny_exceptions")],
        F.when(kind == "deny", F.col("deny_exceptions")).alias("deny_exceptions"),
        principal_list(item["groups"], item["users"], item["roles"]).alias("principals"),
        blank_entries(item["groups"], item["users"], item["roles"]).alias("blanks"),
        privileges.alias("privileges"),
        item["conditions"].alias("conditions"),
        F.coalesce(item["rowFilterInfo"]["filterExpr"], F.lit("")).alias("filter_expr"),
        F.coalesce(item["dataMaskInfo"]["dataMaskType"], F.lit("MASK")).alias("mask_type"),
        F.coalesce(item["dataMaskInfo"]["valueExpr"], F.lit("")).alias("mask_expr"),
        F.coalesce(item["delegateAdmin"], F.lit(False)).alias("delegate_admin"),
    )


def _outer() -> Column:
    where = F.col("route")
    return F.when(where.isin("table", "function"), F.col("databases")).otherwise(
        F.array(F.lit(None).cast("string"))
    )


def _inner() -> Column:
    where = F.col("route")
    return (
        F.when(where == "path", F.col("paths"))
        .when(where == "url", resource_values("url"))
        .when(where == "function", resource_values("udf"))
        .otherwise(F.col("tables"))
    )


LEAF = f"struct<leaf_no:bigint,principal:{PRINCIPAL},leaf_column:string,is_blank:boolean>"


def first_principal() -> Column:
    return F.coalesce(F.get("principals", F.lit(0)), F.named_struct(F.lit("type"), F.lit("group"), F.lit("name"), F.lit("ALL")))


def _leaves() -> Column:
    """What a sub-item yields per resource: principals, columns or the first principal only."""
    nobody = F.lit(None).cast(PRINCIPAL)
    no_column = F.lit(None).cast("string")

    def leaf(number, principal, column, blank=False):
        return F.struct(number.cast("bigint"), principal, column, F.lit(blank)).cast(LEAF)

    advisory_slot = F.when((F.col("route") == "table") & (F.col("kind") == "allow"), 1).otherwise(0)
    people = F.transform(
        "principals", lambda p, i: leaf(i + F.lit(1) + advisory_slot, p, no_column)
    )
    advisory = F.when(
        (advisory_slot == 1) & (F.size("blanks") > 0),
        F.array(leaf(F.lit(1), nobody, no_column, True)),
    ).otherwise(F.array().cast(f"array<{LEAF}>"))
    masked = F.transform(
        "all_columns", lambda c, i: leaf(i + F.lit(1), first_principal(), c)
    )
    return (
        F.when(F.col("kind") == "filter", F.array(leaf(F.lit(1), first_principal(), no_column)))
        .when(F.col("kind") == "mask", masked)
        .otherwise(F.concat(advisory, people))
    )


def text_or_none(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def sequence_number(policy_pos: Column, number: Column) -> Column:
    return (policy_pos + F.lit(1)) * F.lit(PER_POLICY) + number


def initial_status(kind: Column, schema: Column) -> Column:
    all_spaces = (kind == "hbase_grant") & F.coalesce(schema == rules.ALL_NAMESPACES, F.lit(False))
    return F.when(kind.isin(NEEDS_REVIEW) | all_spaces, "needs_review").otherwise("pending")


def _resource() -> Column:
    """The resource at ``outer`` and ``inner`` of a sub-item (one element each) as a struct."""
    where, rule = F.col("route"), F.col("kind").isin("filter", "mask")
    none = F.lit(None).cast("string")
    db, res = F.col("outer.value"), F.col("inner.value")
    split = F.split(res, ":", 2)
    spaced = res.contains(":")
    namespace = (
        F.when(spaced, F.get(split, F.lit(0)))
        .when(res == "*", F.lit(rules.ALL_NAMESPACES))
        .otherwise(F.lit("default"))
    )
    bare = F.when(spaced & (where == "kv"), F.get(split, F.lit(1))).otherwise(res)
    part = F.when(where.isin("table", "function"), F.concat(F.lit("-"), db, F.lit("-"), res)).otherwise("")
    return F.struct(
        F.when(where == "kv", namespace).otherwise(db).alias("schema"),
        F.when(where.isin("table", "kv") & (rule | (bare != "*")), bare).otherwise(none).alias("table"),
        F.when(where.isin("path", "url"), res).otherwise(none).alias("path"),
        F.when(where == "function", res).otherwise(none).alias("udf_name"),
        part.alias("id_part"),
        (F.col("outer_no") * F.col("width") + F.col("inner_no")).alias("cell_no"),
    )


def _boxed(array: str) -> Column:
    """Elements in structs, so that null ones come through ``unnest``."""
    return F.transform(array, lambda v: F.struct(v.alias("value")))


def resource_items(policies: DataFrame, catalog: str = "main") -> DataFrame:
    """Items of all policies that name resources themselves (every route but tags).

    What is the same for all items of a sub-item is worked out once per sub-item, before the
    fan-out; per item only the number, the id and the picks of resource and principal remain. Outer
    and inner resources are unnested one after the other, so pairs of them are never an array.
    """
    where, kind = F.col("route"), F.col("kind")
    # policies may be made row by row: the test must not make each of them a second time
    tested = once(policies, F.coalesce(F.size(resource_values("tag")) > 0, F.lit(False)), "by_tag")
    units = policy_units(tested.filter("NOT by_tag"))
    item_type = (
        F.when(where.isin("path", "url"), "hdfs_grant")
        .when(where == "kv", "hbase_grant")
        .when(where == "function", "udf_grant")
        .when(kind == "allow", "grant")
        .when(kind == "deny", "deny")
        .when(kind == "filter", "row_filter")
        .otherwise("column_mask")
    )
    id_kind = (
        F.when(where == "url", "url")
        .when(where == "path", "hdfs")
        .when(where == "kv", "hbase")
        .when(where == "function", "udf")
        .when(kind == "allow", "grant")
        .when(kind == "deny", "deny")
        .when(kind == "filter", "rowfilter")
        .otherwise("mask")
    )
    pathlike, rule = where.isin("path", "url"), kind.isin("filter", "mask")
    deny = kind == "deny"
    scope = F.when(
        (where == "table") & ~rule & (F.get("all_columns", F.lit(0)) != "*"), F.col("all_columns")
    )
    families = F.when(F.col("families") != F.array(F.lit("*")), F.col("families")).otherwise(
        F.array().cast("array<string>")
    )
    prepared = units.select(
        "export_id",
        "policy_pos",
        "policy_id",
        "policy_name",
        "policy_desc",
        "enabled",
        "stride",
        (F.col("offset") * F.size("outer") * F.size("inner")).alias("base"),
        item_type.alias("unit_type"),
        text_or_none(F.col("policy_id")).alias("id_head"),
        id_kind.alias("id_kind"),
        F.when(~pathlike, F.lit(catalog)).alias("catalog"),
        scope.alias("scope_columns"),
        F.when(pathlike, F.col("is_recursive")).alias("is_recursive"),
        F.when(where == "kv", families).alias("col_families"),
        "privileges",
        F.when(rule, F.col("principals")).alias("all_principals"),
        F.when(kind == "filter", F.col("filter_expr")).alias("filter_expr"),
        F.when(kind == "mask", F.col("mask_type")).alias("mask_type"),
        F.when(kind == "mask", F.col("mask_expr")).alias("mask_expr"),
        F.when(deny, F.coalesce("conditions", F.array().cast(ITEM_COLUMNS["conditions"]))).alias("conditions"),
        F.when(deny, F.coalesce("deny_exceptions", F.array().cast(ITEM_COLUMNS["deny_exceptions"]))).alias(
            "deny_exceptions"
        ),
        "blanks",
        F.when(~rule & ~deny, F.col("delegate_admin")).alias("delegate_admin"),
        "route",
        "kind",
        _boxed("outer").alias("outers"),
        _boxed("inner").alias("inners"),
        F.size("inner").cast("bigint").alias("width"),
        _leaves().alias("leaves"),
    )
    by_outer = unnest(prepared, "outers", "outer", "outer_no", [c for c in prepared.columns if c != "outers"])
    by_inner = unnest(by_outer, "inners", "inner", "inner_no", [c for c in by_outer.columns if c != "inners"])
    parts = {"route", "kind", "outer", "outer_no", "inner", "inner_no", "width"}
    by_cell = by_inner.select(*[c for c in by_inner.columns if c not in parts], _resource().alias("cell"))
    rows = unnest(by_cell, "leaves", "leaf", keep=[c for c in by_cell.columns if c != "leaves"])
    rows = rows.withColumn(
        "number", F.col("base") + F.col("cell.cell_no") * F.col("stride") + F.col("leaf.leaf_no")
    )
    blank = F.col("leaf.is_blank")
    key = F.when(blank, F.concat_ws("-", "id_head", F.lit("blank"), "number")).otherwise(
        F.concat_ws(
            "-", F.concat_ws("-", "id_head", F.concat("id_kind", "cell.id_part")), "leaf.leaf_column",
            "leaf.principal.name", "number",
        )
    )
    shaped = rows.select(
        "export_id",
        sequence_number(F.col("policy_pos"), F.col("number")).alias("seq"),
        key.alias("id"),
        "policy_id",
        "policy_name",
        "policy_desc",
        F.when(blank, "skipped_blank_principal").otherwise(F.col("unit_type")).alias("type"),
        "catalog",
        "cell.schema",
        "cell.table",
        F.when(F.col("leaf.leaf_column").isNotNull(), F.array("leaf.leaf_column"))
        .when(~blank, F.col("scope_columns"))
        .alias("columns"),
        "cell.path",
        "is_recursive",
        "col_families",
        "cell.udf_name",
        F.when(~blank, F.col("privileges")).alias("privileges"),
        "leaf.principal",
        "all_principals",
        "filter_expr",
        "mask_type",
        "mask_expr",
        "conditions",
        "deny_exceptions",
        F.when(blank, F.col("blanks")).alias("blanks"),
        F.when(~blank, F.col("delegate_admin")).alias("delegate_admin"),
        (blank | F.col("enabled")).alias("enabled"),
        F.when(blank, "needs_review")
        .otherwise(initial_status(F.col("unit_type"), F.col("cell.schema")))
        .alias("status"),
    )
    return as_items(shaped)
