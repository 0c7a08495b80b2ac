"""Queries that read exports and build items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.principals import blank_entries, principal_list
from ..operators import items as I
from ..operators import tags as T
from ..operators.fact import policy_items
from ..operators.identity import sorted_identities
from ..operators.stage import stage_dir
from ..sources import archives, exports, mistyped, sinks
from . import bindings as B
from .oracle import FLEET, TAGS, flat_items
from .registry import query


def flat(items: DataFrame) -> DataFrame:
    """Items with plain columns only."""
    return items.select(
        "export_id", "seq", "id", "policy_id", "type", "schema", "table",
        F.array_join("columns", ",").alias("columns"), "path", "udf_name",
        F.array_join("privileges", ",").alias("privileges"),
        F.col("principal.type").alias("principal_type"), F.col("principal.name").alias("principal"),
        "filter_expr", "mask_type", "mask_expr", "delegate_admin", "enabled", "status",
    )


# Scans ----------------------------------------------------------------------------------------

DOC = """
WITH d AS (SELECT c_custkey AS k, 'doc' || c_custkey AS export_id, c_name AS nm, c_custkey % 50 NOT IN (37, 41, 43, 47, 49) AS sound FROM customer)"""


@query("export_headers", "S1 S2 S3", DOC + """
SELECT export_id,
  CASE WHEN k % 8 = 5 OR k % 7 = 0 THEN 'unknown' ELSE CASE k % 4 WHEN 0 THEN 'prod_hadoop' WHEN 1 THEN 'my_HBase' ELSE 'warehouse' END END AS service_name,
  CASE WHEN k % 8 = 5 THEN 'hive' WHEN k % 6 = 0 THEN 'hive'
       WHEN k % 7 <> 0 AND k % 4 = 0 THEN 'hdfs' WHEN k % 5 = 0 THEN 'hdfs'
       WHEN k % 7 <> 0 AND k % 4 = 1 THEN 'hbase' WHEN k % 5 = 1 THEN 'hbase' ELSE 'hive' END AS service_type,
  CASE WHEN k % 8 <> 5 AND k % 2 = 0 THEN 'c1' ELSE 'unknown' END AS cluster_name,
  CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS total_policies
FROM d WHERE sound""")
def export_headers(spark, sf):
    return exports.export_headers(exports.open_documents(B.export_documents(spark, sf)))


@query("invalid_exports", "S1 S2", DOC + """
SELECT export_id, CASE WHEN k % 50 = 49 THEN 'not JSON' ELSE (CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END) || ' mistyped fields' END AS fault FROM d WHERE NOT sound""")
def invalid_exports(spark, sf):
    return exports.invalid_documents(B.export_documents(spark, sf)).select("export_id", "fault")


@query("mistyped_fields", "S1 S2 P5", DOC + """
SELECT export_id, 'policies[' || i || ']' || path AS path, expected, 'STRING' AS found
FROM d JOIN (VALUES (47, '.resources.table.values', 'ARRAY'), (43, '.policyItems[0].users', 'ARRAY'), (41, '.id', 'BIGINT'), (37, '.isEnabled', 'BOOLEAN')) w(r, path, expected) ON k % 50 = r,
  LATERAL (SELECT unnest(range(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)) AS i) n""")
def mistyped_fields(spark, sf):
    return mistyped.mistyped_fields(B.export_documents(spark, sf))


@query("document_items", "S1 S2 P7", DOC + """,
p AS (SELECT *, unnest(range(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)) AS i,
  CASE WHEN k % 8 = 5 OR k % 6 = 0 THEN 'hive' WHEN k % 7 <> 0 AND k % 4 = 0 THEN 'hdfs' WHEN k % 5 = 0 THEN 'hdfs'
       WHEN k % 7 <> 0 AND k % 4 = 1 THEN 'hbase' WHEN k % 5 = 1 THEN 'hbase' ELSE 'hive' END AS service
  FROM d WHERE sound)
SELECT export_id, (i + 1) * 4294967296 + CASE service WHEN 'hive' THEN 2 ELSE 1 END AS seq, k AS policy_id, 'p' || k AS policy_name,
  CASE service WHEN 'hive' THEN 'grant' ELSE service || '_grant' END AS type,
  CASE WHEN service = 'hdfs' THEN CASE WHEN k % 5 = 0 THEN '/data' ELSE '/' END END AS path,
  CASE WHEN service <> 'hdfs' AND NOT (service = 'hbase' AND k % 5 = 0) THEN CASE WHEN k % 5 = 0 THEN NULL ELSE 't' END END AS "table",
  CASE WHEN service = 'hdfs' THEN 'SELECT' ELSE 'SELECT' END AS privileges, nm AS principal
FROM p""")
def document_items(spark, sf):
    opened = exports.open_documents(B.export_documents(spark, sf))
    items = policy_items(exports.policy_rows(opened))
    return items.select(
        "export_id", "seq", "policy_id", "policy_name", "type", "path", "table",
        F.array_join("privileges", ",").alias("privileges"), F.col("principal.name").alias("principal"),
    )


@query("tag_resource_scan", "S5", TAGS + "SELECT 'tags' AS export_id, * FROM res")
def tag_resource_scan(spark, sf):
    return B.tag_resources(spark, sf)


@query("landing_names", "S4 C2", """
SELECT page_id, 'user_' || substr(regexp_replace(lower(url), '[^a-z0-9_-]', '_', 'g'), 1, 80) AS name FROM pages""")
def landing_names(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", sinks.landing_name(F.col("url")).alias("name"))


# Archives -------------------------------------------------------------------------------------

ARCHIVES = """
WITH a AS (
  SELECT c_custkey AS k, c_custkey % 2 = 0 AS nested,
    'arch_' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '_20240102_030405' ELSE '' END || '.json' AS archive,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'GRANT ' || c_custkey END AS sql
  FROM customer),
ai AS (SELECT a.*, unnest(range(CAST(k % 4 AS INT) + 1)) AS i FROM a),
norm AS (
  SELECT archive, CASE WHEN nested THEN 'nested' ELSE 'flat' END AS form,
    CASE WHEN nested THEN '2024-01-' ELSE '2023-02-' END || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') AS "timestamp",
    'svc' || (k % 7) AS service_name, CASE WHEN nested THEN 'c' || (k % 2) ELSE 'unknown' END AS cluster_name,
    'main' AS catalog_name, CASE WHEN nested THEN 'hdfs' ELSE 'hive' END AS service_type,
    CASE WHEN nested THEN k % 9 ELSE k % 4 + 1 END AS total_policies,
    CASE WHEN nested AND k % 4 <> 0 THEN 'src.json' ELSE '' END AS source_file,
    CASE WHEN nested THEN 'n' ELSE '' END AS notes, k % 4 + 1 AS items, sql AS generated_sql, k
  FROM a)
"""


def _archives(spark, sf):
    return archives.normalised(B.archive_documents(spark, sf))


@query("archive_normalised", "S10", ARCHIVES + "SELECT * EXCLUDE (k) FROM norm")
def archive_normalised(spark, sf):
    return _archives(spark, sf).withColumn("items", F.size("items").cast("bigint")).drop("identity_map", "kept_lists")


@query("archive_listing", "S9 C9 O2", ARCHIVES + """
SELECT archive, regexp_replace(regexp_replace(archive, '\\.json$', ''), '_\\d{8}_\\d{6}$', '') AS title,
  "timestamp", service_name, cluster_name, catalog_name, notes, true AS has_size, items FROM norm""")
def archive_listing(spark, sf):
    """Archives written to the stage folder and read back, so that sizes are those of files."""
    folder = f"{stage_dir(spark)}/archives-{uuid.uuid4().hex}"
    archives.save_archives(_archives(spark, sf), folder)
    found = archives.listing(archives.normalised(archives.read_archives(spark, folder)))
    named = found.withColumn("title", naming.archive_title(F.col("archive")))
    return named.withColumn("has_size", F.col("size_kb") > 0).drop("size_kb")


@query("archive_attached", "S11", ARCHIVES + """
SELECT archive, CASE WHEN generated_sql <> '' THEN generated_sql WHEN k % 5 = 0 THEN 'script of ' || k ELSE '' END AS generated_sql,
  CASE WHEN source_file <> '' THEN source_file WHEN k % 3 = 0 THEN archive ELSE '' END AS source_file FROM norm""")
def archive_attached(spark, sf):
    names = B.archive_documents(spark, sf).select(
        "archive", F.regexp_extract("archive", r"arch_(\d+)", 1).cast("bigint").alias("k")
    )
    scripts = names.filter("k % 5 = 0").select(
        naming.file_stem(F.col("archive")).alias("stem"), F.concat(F.lit("script of "), "k").alias("script_sql")
    )
    sources = names.filter("k % 3 = 0").select(F.col("archive").alias("file_name"))
    done = archives.fill_from_files(_archives(spark, sf), scripts, sources)
    return done.select("archive", "generated_sql", "source_file")


@query("archive_load", "S12", ARCHIVES + """
SELECT archive, service_name, items FROM norm WHERE archive = (SELECT max(archive) FROM norm)""")
def archive_load(spark, sf):
    every = _archives(spark, sf)
    newest = every.agg(F.max("archive").alias("archive"))
    return every.join(newest, "archive", "left_semi").select(
        "archive", "service_name", F.size("items").cast("bigint").alias("items")
    )


@query("archive_delete", "S12", ARCHIVES + "SELECT archive, form FROM norm WHERE k % 9 <> 0")
def archive_delete(spark, sf):
    every = _archives(spark, sf)
    gone = B.table(spark, sf, "customer").filter("c_custkey % 9 = 0").selectExpr(
        "concat('arch_', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '_20240102_030405' ELSE '' END, '.json') AS archive"
    )
    return archives.delete_archives(every, gone).select("archive", "form")


@query("archive_round_trip", "S8", ARCHIVES + """
SELECT * EXCLUDE (k) REPLACE ('nested' AS form) FROM norm""")
def archive_round_trip(spark, sf):
    again = archives.normalised(archives.archive_documents(_archives(spark, sf)))
    return again.withColumn("items", F.size("items").cast("bigint")).drop("identity_map", "kept_lists")


@query("archive_bundle", "S13", ARCHIVES + """
SELECT archive, 'generated_sql' AS part, sql AS value FROM a
UNION ALL SELECT archive, 'identity_map', '{"a' || k || '":"a' || k || '","b":"B' || k || '"}' FROM a""")
def archive_bundle(spark, sf):
    parts = archives.bundle_parts(_archives(spark, sf))
    return parts["generated_sql"].withColumn("part", F.lit("generated_sql")).unionByName(
        parts["identity_map"].withColumn("part", F.lit("identity_map"))
    )


@query("archive_bundle_parts", "S13")
def archive_bundle_parts(spark, sf):
    whole = None
    for name, part in archives.bundle_parts(_archives(spark, sf)).items():
        rows = part.withColumn("part", F.lit(name))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


@query("archive_items", "S10 A10", ARCHIVES + """
SELECT archive AS export_id, CAST(i AS BIGINT) AS seq, k || '-grant-' || i AS id, CASE WHEN i % 2 = 0 THEN 'grant' ELSE 'deny' END AS type,
  'db' || ((k + i) % 4) AS "schema", 'g' || i AS principal FROM ai""")
def archive_items(spark, sf):
    return archives.archive_items(_archives(spark, sf)).select(
        "export_id", "seq", "id", "type", "schema", F.col("principal.name").alias("principal")
    )


# Sub-items ------------------------------------------------------------------------------------


@query("principal_lists", "P1", """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'group:g' || (user_id % 7) || ',' END || 'user:u' || user_id
  || CASE WHEN user_id % 2 = 0 THEN ',role:' || event_type ELSE '' END AS principals FROM events""")
def principal_lists(spark, sf):
    names = B.table(spark, sf, "events").selectExpr(
        "event_id",
        "array(CASE WHEN user_id % 3 = 0 THEN ' ' ELSE concat('g', user_id % 7) END) AS groups",
        "array(concat('u', user_id), null, '') AS users",
        "CASE WHEN user_id % 2 = 0 THEN array(event_type) END AS roles",
    )
    found = principal_list(F.col("groups"), F.col("users"), F.col("roles"))
    text = F.transform(found, lambda p: F.concat(p["type"], F.lit(":"), p["name"]))
    return names.select("event_id", F.array_join(text, ",").alias("principals"))


@query("blank_entries", "P2", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'users[1] is empty; ' ELSE '' END || 'groups[0] is empty'
  || CASE WHEN user_id % 3 = 0 THEN '; roles[0] is empty' ELSE '' END AS blanks FROM events""")
def blank_entry_labels(spark, sf):
    names = B.table(spark, sf, "events").selectExpr(
        "event_id",
        "array(' ', 'g') AS groups",
        "array(concat('u', user_id), CASE WHEN user_id % 2 = 0 THEN '' ELSE 'x' END) AS users",
        "array(CASE WHEN user_id % 3 = 0 THEN null ELSE 'r' END) AS roles",
    )
    labels = blank_entries(F.col("groups"), F.col("users"), F.col("roles"))
    return names.select("event_id", F.array_join(labels, "; ").alias("blanks"))


def _accesses(spark, sf):
    return B.table(spark, sf, "events").selectExpr(
        "event_id",
        "transform(array('select', event_type, 'read', CASE event_type WHEN 'view' THEN 'lock' WHEN 'purchase' THEN 'update' "
        "WHEN 'signup' THEN 'create' ELSE 'all' END), a -> named_struct('type', a, 'isAllowed', "
        "CASE WHEN a = 'all' THEN event_id % 2 = 0 END)) AS accesses",
    )


EVENT_PRIVS = """
WITH e AS (SELECT event_id, ['SELECT', upper(event_type), 'SELECT'] || CASE event_type WHEN 'view' THEN ['SELECT'] WHEN 'purchase' THEN ['MODIFY']
  WHEN 'signup' THEN ['CREATE'] ELSE CASE WHEN event_id % 2 = 0 THEN ['ALL PRIVILEGES'] ELSE [] END END AS p FROM events)
"""


@query("access_lists", "P3", EVENT_PRIVS + "SELECT event_id, array_to_string(p, ',') AS privileges FROM e")
def access_lists(spark, sf):
    from ..functions import rules
    from ..functions.principals import access_list, lookup

    got = access_list(F.col("accesses"), lookup(rules.TABLE_ACCESS))
    return _accesses(spark, sf).select("event_id", F.array_join(got, ",").alias("privileges"))


@query("distinct_accesses", "P4", EVENT_PRIVS + """
SELECT event_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS privileges FROM e""")
def distinct_accesses(spark, sf):
    from ..functions import rules
    from ..functions.principals import access_list, lookup

    got = F.array_distinct(access_list(F.col("accesses"), lookup(rules.TABLE_ACCESS)))
    return _accesses(spark, sf).select("event_id", F.array_join(got, ",").alias("privileges"))


@query("resource_defaults", "P5", FLEET + """
SELECT k AS policy_pos, array_to_string(dbs, ',') AS databases, array_to_string(tbs, ',') AS tables,
  array_to_string(cls, ',') AS columns, '/' AS paths, '*' AS families FROM pol""")
def resource_defaults(spark, sf):
    rows = I.resource_defaults(B.order_policies(spark, sf))
    joined = [F.array_join(c, ",").alias(c) for c in ("databases", "tables", "columns", "paths", "families")]
    return rows.select("policy_pos", *joined)


@query("policy_routes", "P6", """
SELECT route, CAST(count(*) AS BIGINT) AS policies FROM (
  SELECT 'table' AS route FROM orders UNION ALL SELECT 'path' FROM pages UNION ALL SELECT 'url' FROM pages
  UNION ALL SELECT 'kv' FROM part UNION ALL SELECT 'function' FROM supplier UNION ALL SELECT 'tag' FROM supplier) GROUP BY route""")
def policy_routes(spark, sf):
    every = B.fleet_policies(spark, sf).unionByName(B.page_policies(spark, sf, True)).unionByName(B.tag_policies(spark, sf))
    return every.select(I.route().alias("route")).groupBy("route").agg(F.count("*").alias("policies"))


def _of_type(kind: str):
    def run(spark, sf):
        return flat(I.resource_items(B.order_policies(spark, sf)).filter(F.col("type") == kind))

    return run


for _name, _kind, _covers in [
    ("grant_items", "grant", "P7 P17"),
    ("deny_items", "deny", "P8 P17"),
    ("row_filter_items", "row_filter", "P9 P17"),
    ("column_mask_items", "column_mask", "P10 P17"),
    ("blank_principal_items", "skipped_blank_principal", "P16"),
]:
    query(_name, _covers, flat_items(f"type = '{_kind}'", "order_items"))(_of_type(_kind))


@query("path_items", "P11", FLEET + """
SELECT seq, id, path, k % 2 = 0 AS is_recursive, array_to_string(privs, ',') AS privileges, pname AS principal, delegate_admin, status FROM page_items""")
def path_items(spark, sf):
    return I.resource_items(B.page_policies(spark, sf)).select(
        "seq", "id", "path", "is_recursive", F.array_join("privileges", ",").alias("privileges"),
        F.col("principal.name").alias("principal"), "delegate_admin", "status",
    )


@query("key_value_items", "P12", FLEET + """
SELECT seq, id, "schema", "table", CASE WHEN k % 2 = 0 THEN 'cf1,cf2' ELSE '' END AS families,
  array_to_string(privs, ',') AS privileges, pname AS principal, status FROM kv_items""")
def key_value_items(spark, sf):
    return I.resource_items(B.part_policies(spark, sf)).select(
        "seq", "id", "schema", "table", F.array_join("col_families", ",").alias("families"),
        F.array_join("privileges", ",").alias("privileges"), F.col("principal.name").alias("principal"), "status",
    )


@query("url_items", "P13", """
WITH u AS (SELECT page_id AS k, CASE page_id % 4 WHEN 0 THEN [url || '/'] WHEN 1 THEN [url, url || '/*']
  WHEN 2 THEN [regexp_extract(url, '^[^?#]*/', 0)] ELSE [url] END AS paths FROM pages)
SELECT k || '-url-web' || (k % 5) || '-' || p.i AS id, 'hdfs_grant' AS type, paths[p.i] AS path, k % 2 = 0 AS is_recursive,
  CASE WHEN k % 4 = 0 THEN 'READ VOLUME,WRITE VOLUME,READ FILES' ELSE 'READ VOLUME' END AS privileges
FROM u, LATERAL (SELECT unnest(range(1, len(paths) + 1)) AS i) p""")
def url_items(spark, sf):
    return I.resource_items(B.page_policies(spark, sf, True)).select(
        "id", "type", "path", "is_recursive", F.array_join("privileges", ",").alias("privileges")
    )


@query("function_items", "P14", FLEET + """
SELECT seq, id, "schema", udf_name, ptype AS principal_type, pname AS principal, delegate_admin, status FROM fn_items""")
def function_items(spark, sf):
    return I.resource_items(B.supplier_policies(spark, sf)).select(
        "seq", "id", "schema", "udf_name", F.col("principal.type").alias("principal_type"),
        F.col("principal.name").alias("principal"), "delegate_admin", "status",
    )


@query("item_status", "P18", FLEET + """
SELECT type, status, CAST(count(*) AS BIGINT) AS items FROM items GROUP BY type, status""")
def item_status(spark, sf):
    return B.fleet_items(spark, sf).groupBy("type", "status").agg(F.count("*").alias("items"))


@query("item_fact", "P19 O1", flat_items())
def item_fact(spark, sf):
    return flat(B.fleet_items(spark, sf))


@query("identities", "D1 O2", FLEET + """,
pairs AS (
  SELECT export_id, unnest(people) AS who FROM sub UNION ALL SELECT export_id, ptype || ':' || pname FROM page_items
  UNION ALL SELECT export_id, ptype || ':' || pname FROM kv_items UNION ALL SELECT export_id, ptype || ':' || pname FROM fn_items)
SELECT DISTINCT export_id, split_part(who, ':', 1) AS type, who[strpos(who, ':') + 1:] AS name FROM pairs""")
def identity_list(spark, sf):
    return sorted_identities(B.fleet_policies(spark, sf))


# Tags -----------------------------------------------------------------------------------------

# Level and owner of a brand; the PII level overrides the brand's where both are set.
SETTINGS = TAGS + """,
settings AS (
  SELECT res_pos, path, "schema", "table", "column", tag AS key, 'true' AS value FROM res
  UNION ALL SELECT res_pos, path, "schema", "table", "column", 'owner', tag FROM res WHERE tag <> 'PII'
  UNION ALL SELECT res_pos, path, "schema", "table", "column", 'level',
    CASE WHEN max(tag = 'PII') THEN 'high' ELSE 'L' || max(length(tag)) END FROM res GROUP BY ALL)
"""


@query("tag_set_items", "P15", SETTINGS + """
SELECT res_pos AS seq, 'tag_set_' || "schema" || '_' || "table" || '_' || coalesce("column", 'tbl') AS id, "schema", "table", "column",
  string_agg(key || '=' || value, ',' ORDER BY key) AS tag_attrs FROM settings GROUP BY ALL""")
def tag_set_items(spark, sf):
    made = T.tag_set_items(B.tag_resources(spark, sf), B.tag_definitions(spark, sf))
    pairs = F.transform(F.map_entries("tag_attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return made.select("seq", "id", "schema", "table", "column", F.array_join(F.array_sort(pairs), ",").alias("tag_attrs"))


@query("tag_settings", "E18", SETTINGS + """
SELECT 'tags' AS export_id, '`main`.`' || "schema" || '`.`' || "table" || '`' AS securable, "column", key, value FROM settings""")
def tag_settings(spark, sf):
    from ..operators.grants import tag_settings as settings

    return settings(B.tag_resources(spark, sf), B.tag_definitions(spark, sf))


@query("tag_resolution", "J1", TAGS + """
SELECT 'tags' AS export_id, k AS policy_pos, "schema", "table", "column", hit FROM ranked""")
def tag_resolution(spark, sf):
    return T.resolve_tags(B.tag_policies(spark, sf), B.tag_resources(spark, sf))


def _tag_items(spark, sf, kind: str):
    made = T.tag_items(B.tag_policies(spark, sf), B.tag_resources(spark, sf))
    return made.filter(F.col("type") == kind).select(
        "seq", "id", "schema", "table", F.array_join("columns", ",").alias("columns"),
        F.array_join("tag_names", ",").alias("tag_names"), F.array_join("privileges", ",").alias("privileges"),
        F.col("principal.name").alias("principal"), "filter_expr", "mask_type", "delegate_admin", "enabled", "status",
    )


TAG_PEOPLE = """LATERAL (SELECT unnest(range(1, 3)) AS i) w"""
TAG_WHO = "['tg' || (k % 4), 'u' || k][w.i]"
TAG_HEAD = """SELECT (k + 1) * 4294967296 + num AS seq, id, "schema", "table", columns, tag_names, privileges, principal,
  filter_expr, mask_type, delegate_admin, enabled, status FROM"""


@query("tag_grants", "J2", TAGS + f"""{TAG_HEAD} (
SELECT *, k || '-tag_grant-' || "schema" || '-' || "table" || '-' || principal || '-' || num AS id FROM (
  SELECT k, CAST((hit - 1) * 2 + w.i AS BIGINT) AS num, rs AS "schema", rt AS "table", CAST(NULL AS VARCHAR) AS columns, tag_names, 'SELECT,DROP' AS privileges,
    {TAG_WHO} AS principal, CAST(NULL AS VARCHAR) AS filter_expr, CAST(NULL AS VARCHAR) AS mask_type, k % 5 = 0 AS delegate_admin, enabled, 'pending' AS status
  FROM joined, {TAG_PEOPLE} WHERE found > 0))""")
def tag_grants(spark, sf):
    return _tag_items(spark, sf, "tag_grant")


@query("tag_placeholders", "J3", TAGS + f"""{TAG_HEAD} (
SELECT *, k || '-tag_placeholder-' || principal || '-' || num AS id FROM (
  SELECT k, CAST(w.i AS BIGINT) AS num, CAST(NULL AS VARCHAR) AS "schema", CAST(NULL AS VARCHAR) AS "table", CAST(NULL AS VARCHAR) AS columns, tag_names, 'SELECT,DROP' AS privileges,
    {TAG_WHO} AS principal, CAST(NULL AS VARCHAR) AS filter_expr, CAST(NULL AS VARCHAR) AS mask_type, CAST(NULL AS BOOLEAN) AS delegate_admin, enabled, 'needs_review' AS status
  FROM joined, {TAG_PEOPLE} WHERE found = 0))""")
def tag_placeholders(spark, sf):
    return _tag_items(spark, sf, "tag_placeholder")


@query("tag_row_filters", "J4", TAGS + f"""{TAG_HEAD} (
SELECT *, k || '-rowfilter-tag-' || "table" || '-' || principal || '-' || num AS id FROM (
  SELECT k, CAST(2 * cells + hit AS BIGINT) AS num, coalesce(rs, '<schema_with_' || joined_tags || '>') AS "schema",
    coalesce(rt, '<table_with_' || joined_tags || '>') AS "table", CAST(NULL AS VARCHAR) AS columns, CAST(NULL AS VARCHAR) AS tag_names, '' AS privileges,
    'tg' || (k % 4) AS principal, 'owner_id = 7' AS filter_expr, CAST(NULL AS VARCHAR) AS mask_type, CAST(NULL AS BOOLEAN) AS delegate_admin, enabled, 'needs_review' AS status
  FROM joined WHERE k % 2 = 0))""")
def tag_row_filters(spark, sf):
    return _tag_items(spark, sf, "row_filter")


@query("tag_column_masks", "J5", TAGS + f"""{TAG_HEAD} (
SELECT *, k || '-mask-tag-' || "table" || '-' || columns || '-ALL-' || num AS id FROM (
  SELECT k, CAST((2 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) * cells + hit AS BIGINT) AS num, coalesce(rs, '<schema_with_' || joined_tags || '>') AS "schema",
    coalesce(rt, '<table_with_' || joined_tags || '>') AS "table", coalesce(rc, '<col_with_' || joined_tags || '>') AS columns, CAST(NULL AS VARCHAR) AS tag_names, '' AS privileges,
    'ALL' AS principal, CAST(NULL AS VARCHAR) AS filter_expr, 'MASK_HASH' AS mask_type, CAST(NULL AS BOOLEAN) AS delegate_admin, enabled, 'needs_review' AS status
  FROM joined WHERE k % 5 = 1))""")
def tag_column_masks(spark, sf):
    return _tag_items(spark, sf, "column_mask")
