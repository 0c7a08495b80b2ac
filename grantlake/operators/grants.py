"""Effective grants in the target catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.naming import dotted, has_wildcard, quoted, target_privilege, volume_name
from ..functions.rows import unnest
from .conflicts import taken_by_pattern
from .identity import map_principals
from .review import eligible, guard_code
from .stage import stage
from .tags import tag_assignments
from .wildcards import (
    schemas_for_patterns,
    tables_for_patterns,
    tables_of_schema_patterns,
    tables_of_schemas,
)

GRANT = "array<struct<securable_type:string,securable:string,privilege:string>>"


def no_grants() -> Column:
    return F.array().cast(GRANT)


def scope() -> Column:
    """What a grant aims at: catalog, table_pattern, schema_pattern, schema, table or other kinds."""
    kind, schema, table = F.col("type"), F.col("schema"), F.col("table")
    tabular = kind.isin("grant", "hbase_grant")
    return (
        F.when((kind == "grant") & (schema == "*"), "catalog")
        .when((kind == "hbase_grant") & (schema == rules.ALL_NAMESPACES), "none")
        .when(tabular & has_wildcard(table), "table_pattern")
        .when((kind == "grant") & has_wildcard(schema), "schema_pattern")
        .when(tabular & table.isNull(), "schema")
        .when(tabular, "table")
        .when(kind == "hdfs_grant", "volume")
        .when(kind == "udf_grant", "function")
        .when(kind == "tag_grant", F.when(table.isNull(), "tag_schema").otherwise("tag_table"))
        .otherwise("none")
    )


def _raw(on: str, name: Column, privileges: Column) -> Column:
    made = F.transform(privileges, lambda p: F.struct(F.lit(on), name, p))
    return F.coalesce(made.cast(GRANT), no_grants())


def _translated(on: str, name: Column, privileges: Column) -> Column:
    on_table = F.lit(on == "TABLE")
    kept = F.transform(privileges, lambda p: target_privilege(p, on_table))
    return _raw(on, name, F.array_compact(kept))


def _fixed(on: str, name: Column, privilege: str) -> Column:
    return F.array(F.struct(F.lit(on), name, F.lit(privilege))).cast(GRANT)


def table_only() -> Column:
    return F.filter("privileges", lambda p: p.isin(rules.TABLE_ONLY))


def schema_level() -> Column:
    return F.filter("privileges", lambda p: ~p.isin(rules.TABLE_ONLY))


def direct_grants(catalog: Column) -> Column:
    """Grants of an item that need no listing, in statement order."""
    cat = quoted(catalog)
    schema_name = dotted(catalog, F.coalesce("schema", F.lit("default")))
    table_name = dotted(catalog, F.coalesce("schema", F.lit("default")), F.col("table"))
    volume = dotted(catalog, F.lit(rules.VOLUME_SCHEMA), volume_name(F.coalesce("path", F.lit("/"))))
    function = dotted(catalog, F.coalesce("schema", F.lit("default")), F.coalesce("udf_name", F.lit("unknown")))
    use = F.concat(_fixed("CATALOG", cat, "USE CATALOG"), _fixed("SCHEMA", schema_name, "USE SCHEMA"))
    whole = F.filter("privileges", lambda p: p == "ALL PRIVILEGES")
    where = F.col("scope")
    return (
        F.when(where == "catalog", F.concat(_fixed("CATALOG", cat, "USE CATALOG"), _raw("CATALOG", cat, whole)))
        .when(where == "schema", F.concat(use, _translated("SCHEMA", schema_name, schema_level())))
        .when(where == "table", _translated("TABLE", table_name, F.col("privileges")))
        .when(where == "volume", _raw("VOLUME", volume, F.col("privileges")))
        .when(where == "function", _fixed("FUNCTION", function, "EXECUTE"))
        .when(where == "tag_schema", F.concat(use, _raw("SCHEMA", schema_name, F.col("privileges"))))
        .when(where == "tag_table", _raw("TABLE", table_name, F.col("privileges")))
        .otherwise(no_grants())
    )


def granting_items(items: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """What may grant: one row per distinct (export, principal, scope, resource, privileges).

    Of grants that say the same (``grant_signature``) the first counts, and only if no guard holds it back;
    one aggregate finds it, by two flags of the item with the smallest ``seq``. ``items`` is read once.
    """
    where = ["export_id", "type", "schema", "table", "path", "udf_name"]
    name = F.coalesce("principal.name", F.lit(""))
    is_user = F.coalesce(F.col("principal.type") == "user", F.lit(False))
    privileges = F.array_sort(F.coalesce("privileges", F.array().cast("array<string>")))
    flags = (is_user.cast("int") * 2 + guard_code().isNull().cast("int")).alias("flags")
    kinds = ["grant", "hbase_grant", "hdfs_grant", "udf_grant", "tag_grant"]
    rows = eligible(items).filter(F.col("type").isin(kinds) & ((F.col("type") != "grant") | ~taken_by_pattern()))
    own = F.when(F.col("type") != "grant", F.col("flags"))  # of other kinds every item counts
    told = rows.select(*where, "seq", name.alias("name"), privileges.alias("privileges"), flags).withColumn("own", own)
    first = told.groupBy(*where, "name", "privileges", "own").agg(F.min_by("flags", "seq").alias("flags"))
    free = first.filter(F.col("flags").bitwiseAND(1) == 1)
    kind = F.when(F.col("flags") >= 2, "user").otherwise("group")
    named = free.select(*where, "privileges", F.struct(kind.alias("type"), F.col("name").alias("name")).alias("principal"))
    return map_principals(named, mapping).withColumn("scope", scope())


# Every privilege a grant can have by name, before or after translation.
PRIVILEGES = sorted(
    {*rules.TABLE_ACCESS.values(), *rules.PATH_ACCESS.values(), *rules.KV_ACCESS.values(), rules.URL_UNKNOWN_ACCESS, *rules.NO_EQUIVALENT}
    | {"CREATE TABLE", "MANAGE", "USE CATALOG", "USE SCHEMA"}
)


def bits(*names: str) -> int:
    return sum(1 << PRIVILEGES.index(n) for n in set(names))


def privilege_mask(privileges: Column) -> Column:
    """Known privileges of an array as the bits of one long."""
    table = F.create_map(*[F.lit(x) for n in PRIVILEGES for x in (n, bits(n))])
    return F.aggregate(privileges, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.coalesce(table[p].cast("long"), F.lit(0).cast("long"))))


def _masked(mask: Column, allowed: int) -> Column:
    return mask.bitwiseAND(F.lit(allowed).cast("long"))


def translated_mask(mask: Column, on_table: bool) -> Column:
    """``target_privilege`` on all bits at once."""
    moved = {"DROP": "MANAGE", "ALTER": "ALL PRIVILEGES", "CREATE": None if on_table else "CREATE TABLE", "EXECUTE": None}
    gone = moved | dict.fromkeys(rules.NO_EQUIVALENT)
    out = _masked(mask, bits(*[p for p in PRIVILEGES if p not in gone]))
    for old, new in moved.items():
        if new:
            out = out.bitwiseOR(F.when(_masked(mask, bits(old)) != 0, F.lit(bits(new)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


SECURABLE = "struct<kind:string,a:string,b:string,mask:bigint,other:string>"


def _on(kind: str, a: Column | None, b: Column | None, mask: Column | int, other: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    mask = F.lit(mask).cast("long") if isinstance(mask, int) else mask
    return F.struct(F.lit(kind), none if a is None else a, none if b is None else b, mask, none if other is None else other).cast(SECURABLE)


def _schema_use() -> Column:
    """The bit of USE SCHEMA, once per resource: not on rows that hold a privilege without a bit."""
    return F.when(F.col("other").isNull(), F.lit(bits("USE SCHEMA")).cast("long")).otherwise(F.lit(0).cast("long"))


def _direct() -> Column:
    """Securables of a row that need no listing, each with its privileges as a mask."""
    mask, other, where = F.col("mask"), F.col("other"), F.col("scope")
    schema, table = F.coalesce("schema", F.lit("default")), F.col("table")
    volume = volume_name(F.coalesce("path", F.lit("/")))
    use, use_schema = _on("CATALOG", None, None, bits("USE CATALOG")), _schema_use()
    above = _masked(mask, bits(*[p for p in PRIVILEGES if p not in rules.TABLE_ONLY]))
    return (
        F.when(where == "catalog", F.array(use, _on("CATALOG", None, None, _masked(mask, bits("ALL PRIVILEGES")))))
        .when(where == "schema", F.array(use, _on("SCHEMA", schema, None, translated_mask(above, False).bitwiseOR(use_schema), other)))
        .when(where == "table", F.array(_on("TABLE", schema, table, translated_mask(mask, True), other)))
        .when(where == "volume", F.array(_on("VOLUME", F.lit(rules.VOLUME_SCHEMA), volume, mask, other)))
        .when(where == "function", F.array(_on("FUNCTION", schema, F.coalesce("udf_name", F.lit("unknown")), bits("EXECUTE"))))
        .when(where == "tag_schema", F.array(use, _on("SCHEMA", schema, None, mask.bitwiseOR(use_schema), other)))
        .when(where == "tag_table", F.array(_on("TABLE", schema, table, mask, other)))
        .otherwise(F.array().cast(f"array<{SECURABLE}>"))
    )


def granted_masks(items: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(export, principal, scope, resource) with all privileges as one ``mask``. A privilege without a
    bit has a row of its own in ``other``."""
    rows = granting_items(items, mapping)
    unknown = F.array_except("privileges", F.array(*[F.lit(p) for p in PRIVILEGES]))
    none = F.struct(privilege_mask(F.col("privileges")).alias("mask"), F.lit(None).cast("string").alias("other"))
    alone = F.transform(unknown, lambda p: F.struct(F.lit(0).cast("long").alias("mask"), p.alias("other")))
    at = ["export_id", "principal_name", "scope", "schema", "table", "path", "udf_name"]
    told = rows.filter("scope <> 'none'").select(*at, F.explode(F.concat(F.array(none), alone)).alias("m"))
    return told.groupBy(*at, F.col("m.other").alias("other")).agg(F.bit_or("m.mask").alias("mask"))


def effective_grants(
    items: DataFrame, tables: DataFrame, mapping: DataFrame | None = None, catalog: str = "main", direct: bool = True
) -> DataFrame:
    """Distinct (export, principal, securable type, securable, privilege) of all items.

    ``tables`` lists (schema, table) of the target catalog; pattern and whole-schema grants are
    resolved against it. With ``direct=False`` only what comes from the listing is returned.

    Privileges are bits from the start: rows on the same resource are one row before they meet the
    listing, and again after it, and become rows per privilege only at the end.
    """
    rows = stage(granted_masks(items, mapping))
    keep = ["export_id", "principal_name"]
    mask, other = F.col("mask"), F.col("other")
    on_tables = _masked(mask, bits(*rules.TABLE_ONLY))
    parts = [unnest(rows, _direct(), "s", keep=keep)] if direct else []

    in_pattern = tables_for_patterns(rows.filter("scope = 'table_pattern'"), tables)
    parts.append(in_pattern.select(*keep, _on("TABLE", F.coalesce("schema", F.lit("default")), F.col("match"), translated_mask(mask, True), other).alias("s")))
    in_schema = tables_of_schemas(rows.filter((F.col("scope") == "schema") & (on_tables != 0)), tables)
    parts.append(in_schema.select(*keep, _on("TABLE", F.col("schema"), F.col("match"), on_tables).alias("s")))
    patterned = rows.filter("scope = 'schema_pattern'")
    above = translated_mask(_masked(mask, bits(*[p for p in PRIVILEGES if p not in rules.TABLE_ONLY])), False)
    schemas = F.array(
        _on("CATALOG", None, None, bits("USE CATALOG")),
        _on("SCHEMA", F.col("match"), None, above.bitwiseOR(_schema_use()), other),
    )
    parts.append(unnest(schemas_for_patterns(patterned, tables), schemas, "s", keep=keep))
    below = tables_of_schema_patterns(patterned.filter(on_tables != 0), tables)
    parts.append(below.select(*keep, _on("TABLE", F.col("match"), F.col("match_table"), on_tables).alias("s")))

    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.select(*keep, "s.*").groupBy(*keep, "kind", "a", "b", "other").agg(F.bit_or("mask").alias("mask"))
    named = F.array_compact(F.array("other", *[F.when(_masked(mask, bits(p)) != 0, F.lit(p)) for p in PRIVILEGES]))
    return unnest(merged, named, "privilege", keep=[*keep, "kind", "a", "b"]).select(
        "export_id",
        F.col("principal_name").alias("principal"),
        F.col("kind").alias("securable_type"),
        dotted(F.lit(catalog), F.col("a"), F.col("b")).alias("securable"),
        "privilege",
    )


def grant_statement() -> Column:
    """SQL text of an effective-grant row."""
    return F.concat(
        F.lit("GRANT "), "privilege", F.lit(" ON "), "securable_type", F.lit(" "), "securable",
        F.lit(" TO "), quoted(F.col("principal")), F.lit(";"),
    )


def tag_settings(resources: DataFrame, definitions: DataFrame, catalog: str = "main") -> DataFrame:
    """Tag assignments as (export, securable, column, key, value)."""
    return tag_assignments(resources, definitions).select(
        "export_id",
        dotted(F.lit(catalog), F.col("schema"), F.col("table")).alias("securable"),
        "column",
        "key",
        "value",
    )
