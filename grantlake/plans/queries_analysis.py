"""Queries that review, compare, warn about and score items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.principals import resolved_name
from ..operators import audit, conflicts, gaps, identity, review, scoring, warnings
from ..operators.items import resource_items
from ..operators.stage import stage
from ..sources import archives
from . import bindings as B
from . import statements
from .oracle import FLEET
from .queries_items import ARCHIVES, flat
from .registry import query

FLAT = """SELECT export_id, seq, id, policy_id, type, "schema", "table", array_to_string(cols, ',') AS columns, path, udf_name,
  array_to_string(privs, ',') AS privileges, ptype AS principal_type, pname AS principal, filter_expr, mask_type, mask_expr,
  delegate_admin, enabled, status FROM"""
KEYS = "SELECT export_id, seq, id, type, status FROM"


def keys(items):
    return items.select("export_id", "seq", "id", "type", "status")


# Review ---------------------------------------------------------------------------------------


@query("eligible_items", "F1", FLEET + f"{KEYS} items WHERE status IN ('approved', 'needs_review')")
def eligible_items(spark, sf):
    return keys(review.eligible(B.fleet_items(spark, sf)))


@query("not_translatable_items", "F2", FLEET + f"{KEYS} flagged WHERE not_translatable")
def not_translatable_items(spark, sf):
    return keys(B.fleet_items(spark, sf).filter(review.not_translatable()))


@query("executable_items", "F3", FLEET + f"{KEYS} eligible WHERE NOT not_translatable")
def executable_items(spark, sf):
    return keys(review.executable(B.approved_items(spark, sf)))


@query("advisory_items", "F3", FLEET + f"{KEYS} eligible WHERE not_translatable")
def advisory_items(spark, sf):
    return keys(review.advisory_only(B.approved_items(spark, sf)))


@query("review_search", "F4", FLEET + f"""{KEYS} items WHERE type = 'grant' AND status = 'pending'
  AND contains(lower(concat_ws(' ', policy_name, coalesce("schema", ''), coalesce("table", ''), coalesce(pname, ''))), 'shared g1')""")
def review_search(spark, sf):
    return keys(review.search(B.fleet_items(spark, sf), "grant", "pending", "Shared G1"))


PEOPLE = FLEET + """,
pairs AS (SELECT export_id, unnest(people) AS who FROM sub),
ids AS (SELECT DISTINCT export_id, split_part(who, ':', 1) AS type, who[strpos(who, ':') + 1:] AS name FROM pairs)
"""


@query("identity_search", "F5", PEOPLE + "SELECT export_id, type, name FROM ids WHERE type = 'user' AND contains(lower(name), 'svc')")
def identity_search(spark, sf):
    return identity.search_identities(identity.identities(B.order_policies(spark, sf)), "user", "SVC")


@query("bulk_approval", "F6", FLEET + "SELECT type, status, enabled, CAST(count(*) AS BIGINT) AS items FROM approved GROUP BY ALL")
def bulk_approval(spark, sf):
    return B.approved_items(spark, sf).groupBy("type", "status", "enabled").agg(F.count("*").alias("items"))


@query("single_decisions", "F7", FLEET + """
SELECT export_id, seq, id, type, CASE WHEN policy_id % 5 = 0 AND type = 'row_filter' THEN 'rejected' ELSE status END AS status FROM order_items""")
def single_decisions(spark, sf):
    items = stage(resource_items(B.order_policies(spark, sf)))
    chosen = items.filter("policy_id % 5 = 0 AND type = 'row_filter'").select(
        "export_id", "id", F.lit("rejected").alias("status")
    )
    return keys(review.decide(items, chosen))


@query("unresolvable_resources", "F8", FLEET + f"{KEYS} items WHERE contains(\"table\", '${{{{USER')")
def unresolvable_resources(spark, sf):
    return keys(B.fleet_items(spark, sf).filter(review.unresolvable_resource()))


@query("user_mark_items", "F9", FLEET + f"{KEYS} items WHERE contains(pname, '{{USER}}')")
def user_mark_items(spark, sf):
    return keys(B.fleet_items(spark, sf).filter(review.user_mark_principal()))


@query("resource_labels", "F10", FLEET + """
SELECT export_id, seq, CASE WHEN type = 'hdfs_grant' THEN path ELSE 'main.' || "schema" || '.' || coalesce("table", '*') END AS label FROM items""")
def resource_labels(spark, sf):
    return B.fleet_items(spark, sf).select("export_id", "seq", review.resource_label().alias("label"))


# Identities -----------------------------------------------------------------------------------

MAPPING = """,
mapping AS (
  SELECT 'svc' || (c_custkey % 7) AS export_id, 'u' || c_custkey AS source,
    CASE WHEN c_custkey % 2 = 0 THEN 'user' || c_custkey || '@corp.com' ELSE 'u' || c_custkey END AS target FROM customer
  UNION SELECT 'svc' || (c_custkey % 7), 'g' || (c_custkey % 20), 'grp_' || (c_custkey % 20) FROM customer)"""
MAPPED = MAPPING + """,
mapped AS (
  SELECT i.*, CASE WHEN i.ptype = 'user' AND NOT contains(coalesce(m.target, i.pname), '@')
    THEN coalesce(m.target, i.pname) || '@company.com' ELSE coalesce(m.target, i.pname) END AS target
  FROM approved i LEFT JOIN mapping m ON m.export_id = i.export_id AND m.source = i.pname)"""


@query("mapped_principals", "J6", FLEET + MAPPED + "SELECT export_id, seq, coalesce(target, 'unknown') AS principal FROM mapped")
def mapped_principals(spark, sf):
    mapped = identity.map_principals(B.fleet_items(spark, sf), B.identity_map(spark, sf))
    return mapped.select("export_id", "seq", F.col("principal_name").alias("principal"))


@query("identity_table", "J7", PEOPLE[: PEOPLE.rindex(")") + 1] + MAPPING + """
SELECT i.export_id, type, name, contains(name, '@') OR contains(name, '/') OR name LIKE 'svc\\_%' ESCAPE '\\' AS is_kerberos,
  coalesce(m.target, name) AS target FROM ids i LEFT JOIN mapping m ON m.export_id = i.export_id AND m.source = i.name""")
def identity_table(spark, sf):
    policies = B.order_policies(spark, sf)
    return identity.identity_table(
        identity.identities(policies), identity.service_accounts(policies), B.identity_map(spark, sf)
    )


@query("identity_edits", "J8", PEOPLE[: PEOPLE.rindex(")") + 1] + MAPPING + """
SELECT coalesce(m.export_id, i.export_id) AS export_id, coalesce(m.source, i.name) AS source, coalesce(m.target, i.name) AS target
FROM (SELECT DISTINCT export_id, name FROM ids) i FULL JOIN mapping m ON m.export_id = i.export_id AND m.source = i.name""")
def identity_edits(spark, sf):
    found = identity.identities(B.order_policies(spark, sf))
    return identity.apply_edits(identity.default_identity_map(found), B.identity_map(spark, sf))


@query("group_members", "J17", """
WITH g AS (SELECT c_custkey % 20 AS g, count(*) AS members, min(c_name) AS first_user FROM customer GROUP BY 1)
SELECT o_orderkey AS seq, members, first_user FROM orders JOIN g ON g = o_custkey % 20""")
def group_members(spark, sf):
    rules = B.table(spark, sf, "orders").selectExpr(
        "'svc' AS export_id", "o_orderkey AS seq", "'group' AS principal_type",
        "concat('g', o_custkey % 20) AS principal_name",
    )
    return identity.covered_counts(rules, B.membership(spark, sf)).select("seq", "members", "first_user")


@query("rules_of_user", "J17", """
WITH me AS (SELECT min(c_name) AS nm FROM customer),
mine AS (SELECT c_custkey % 20 AS g FROM customer, me WHERE c_name = nm)
SELECT o_orderkey AS seq FROM orders, mine WHERE o_custkey % 20 = g""")
def rules_of_user(spark, sf):
    members = B.membership(spark, sf)
    me = members.agg(F.min("user")).first()[0]
    rules = B.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "'group' AS principal_type", "concat('g', o_custkey % 20) AS principal_name"
    )
    return identity.rules_of_user(rules, members, me).select("seq")


# Conflicts ------------------------------------------------------------------------------------

GROUPS = """,
targets AS (SELECT *, CASE WHEN type = 'column_mask' THEN cols[1] ELSE '' END AS target_column FROM eligible
  WHERE type IN ('row_filter', 'column_mask')),
clashes AS (SELECT export_id, type, "schema", "table", target_column, count(*) AS members, min(seq) AS first_seq
  FROM targets GROUP BY ALL HAVING count(*) > 1)"""


@query("filter_conflicts", "A1", FLEET + GROUPS + """
SELECT export_id, "schema", "table", members, first_seq FROM clashes WHERE type = 'row_filter'""")
def filter_conflicts(spark, sf):
    return conflicts.filter_conflicts(B.fleet_items(spark, sf))


@query("mask_conflicts", "A2", FLEET + GROUPS + """
SELECT export_id, "schema", "table", target_column, members, first_seq FROM clashes WHERE type = 'column_mask'""")
def mask_conflicts(spark, sf):
    return conflicts.mask_conflicts(B.fleet_items(spark, sf))


@query("conflict_counts", "A3", FLEET + GROUPS + """
SELECT export_id, count(*) FILTER (type = 'row_filter') AS filter_conflicts, count(*) FILTER (type = 'column_mask') AS mask_conflicts,
  count(*) AS conflicts FROM clashes GROUP BY export_id""")
def conflict_counts(spark, sf):
    return conflicts.conflict_count(B.fleet_items(spark, sf))


@query("conflict_members", "A1 A2", FLEET + GROUPS + """
SELECT t.export_id, t.seq, c.members, c.first_seq FROM targets t JOIN clashes c USING (export_id, type, "schema", "table", target_column)""")
def conflict_members(spark, sf):
    items = B.fleet_items(spark, sf).select("export_id", "seq", "type", "schema", "table", "columns")
    return conflicts.conflict_members(stage(items)).select("export_id", "seq", "members", "first_seq")


@query("unmerged_items", "J16 O1", FLEET + GROUPS + f"""{KEYS} items i WHERE NOT EXISTS (
  SELECT 1 FROM targets t JOIN clashes c USING (export_id, type, "schema", "table", target_column)
  WHERE t.export_id = i.export_id AND t.seq = i.seq)""")
def unmerged_items(spark, sf):
    return keys(conflicts.unmerged(stage(B.fleet_items(spark, sf))))


@query("grant_deny_conflicts", "J9", FLEET + """
SELECT export_id, "schema", "table", pname AS principal_name, min(seq) FILTER (type = 'deny') AS first_deny
FROM eligible WHERE type IN ('grant', 'deny') GROUP BY export_id, "schema", "table", pname
HAVING count(*) FILTER (type = 'grant') > 0 AND count(*) FILTER (type = 'deny') > 0""")
def grant_deny_conflicts(spark, sf):
    return conflicts.grant_deny_conflicts(B.approved_items(spark, sf))


PATH_KEYS = """
  CASE WHEN regexp_replace(rtrim(path, '/'), '/*\\*$', '') = '' THEN '/' ELSE regexp_replace(rtrim(path, '/'), '/*\\*$', '') END"""


@query("nested_paths", "J10", FLEET + f""",
paths AS (SELECT DISTINCT path, {PATH_KEYS} AS key FROM page_items)
SELECT 'files' AS export_id, a.path AS parent, b.path AS child FROM paths a JOIN paths b ON starts_with(b.key, a.key || '/')""")
def nested_paths(spark, sf):
    items = review.approve_valid(resource_items(B.page_policies(spark, sf)))
    return conflicts.nested_paths(conflicts.eligible_paths(items))


@query("wildcard_column_groups", "A5", FLEET + """
SELECT export_id, "schema", "table", p AS pattern, count(*) AS members, count(DISTINCT ptype || ':' || pname) AS principals, min(seq) AS first_seq
FROM (SELECT *, unnest(cols) AS p FROM eligible WHERE type = 'grant' AND "table" IS NOT NULL) WHERE contains(p, '*') AND p <> '*' GROUP BY ALL""")
def wildcard_column_groups(spark, sf):
    return conflicts.wildcard_column_groups(B.approved_items(spark, sf))


@query("wildcard_column_emitters", "D3", FLEET + """
SELECT export_id, seq, "schema", "table", cols[1] AS pattern FROM eligible WHERE type = 'grant' AND "table" IS NOT NULL AND cols[1] = 'col*'
QUALIFY row_number() OVER (PARTITION BY export_id, "schema", "table" ORDER BY seq) = 1""")
def wildcard_column_emitters(spark, sf):
    return conflicts.wildcard_column_emitters(B.approved_items(spark, sf))


@query("duplicate_grants", "D2", FLEET + f"""{KEYS} (
  SELECT *, row_number() OVER (PARTITION BY export_id, "schema", "table", pname, array_to_string(list_sort(privs), ',') ORDER BY seq) AS n
  FROM eligible WHERE type = 'grant' AND NOT ("table" IS NOT NULL AND coalesce(cols[1] = 'col*', false))) WHERE n > 1""")
def duplicate_grants(spark, sf):
    return keys(conflicts.duplicate_grants(stage(B.approved_items(spark, sf))))


# Warnings -------------------------------------------------------------------------------------

RAISED = FLEET + """,
raised AS (
  SELECT export_id, k, 'disabled' AS category, 'info' AS severity, 'policy is disabled' AS detail FROM pol WHERE NOT enabled
  UNION ALL SELECT export_id, k, 'deny_all_else', 'critical', 'everybody not listed is denied' FROM pol WHERE k % 97 = 0
  UNION ALL SELECT export_id, k, 'validity_schedule', 'warning', '2020/01/01 → ' || CASE WHEN k % 2 = 0 THEN '2021/01/01' ELSE 'no end' END
    FROM pol WHERE k % 89 = 0
  UNION ALL SELECT export_id, k, 'conditions', 'warning', concat_ws(', ', CASE WHEN k % 14 = 0 THEN 'accessed-together' END, CASE WHEN k % 41 = 0 THEN 'ip-range' END)
    FROM pol WHERE k % 41 = 0 OR k % 14 = 0
  UNION ALL SELECT export_id, k, 'blank_principal', 'warning', 'groups[1] is empty' FROM pol WHERE k % 31 = 0)
"""


def _warning_query(category: str):
    def run(spark, sf):
        found = warnings.policy_warnings(B.order_policies(spark, sf)).filter(F.col("category") == category)
        return found.select("export_id", F.col("policy_id").alias("k"), "category", "severity", "detail")

    return run


for _name, _category, _covers in [
    ("warn_disabled", "disabled", "V1"),
    ("warn_deny_all_else", "deny_all_else", "V2"),
    ("warn_validity_schedule", "validity_schedule", "V3"),
    ("warn_conditions", "conditions", "V4 D4"),
    ("warn_blank_principal", "blank_principal", "V5"),
]:
    query(_name, _covers, RAISED + f"SELECT * FROM raised WHERE category = '{_category}'")(_warning_query(_category))


@query("warn_deny", "V6", FLEET + """
SELECT export_id, seq, 'DENY for ' || pname || ' on ' || "schema" || '.' || coalesce("table", '*') || ' [SELECT, SELECT]' AS detail FROM order_items WHERE type = 'deny'""")
def warn_deny(spark, sf):
    return warnings.deny_warnings(resource_items(B.order_policies(spark, sf))).select("export_id", "seq", "detail")


ACCOUNTS = FLEET + """,
accounts AS (
  SELECT export_id, k, unnest(['svc_' || (c % 9), 'etl/h' || (c % 9) || '@REALM']) AS principal FROM pol WHERE k % 37 = 0 AND k % 3 <> 0)
"""


@query("service_accounts", "V7", ACCOUNTS + """
SELECT export_id, k, principal, CASE WHEN contains(principal, '@') THEN 'kerberos_principal' ELSE 'service_account' END AS kind FROM accounts""")
def service_accounts(spark, sf):
    return identity.service_accounts(B.order_policies(spark, sf)).select(
        "export_id", F.col("policy_id").alias("k"), "principal", "kind"
    )


# Gaps -----------------------------------------------------------------------------------------

PLACE = """coalesce("schema", 'None') || '.' || coalesce("table", '*')"""
PRIVS = "coalesce(array_to_string(privs, ', '), '')"
NO_EQ = "list_filter(privs, lambda p: p IN ('EXECUTE', 'SERVICEADMIN'))"
GAPS = RAISED + f""",
clash AS (SELECT export_id, type, "schema", "table", CASE WHEN type = 'column_mask' THEN cols[1] END AS col, count(*) AS n, min(seq) AS seq
  FROM items WHERE type IN ('row_filter', 'column_mask') GROUP BY ALL HAVING count(*) > 1),
accounts AS (
  SELECT export_id, k, unnest(['svc_' || (c % 9), 'etl/h' || (c % 9) || '@REALM']) AS principal FROM pol WHERE k % 37 = 0 AND k % 3 <> 0),
gaps AS (
  SELECT export_id, 'deny' AS category, seq, {PLACE} AS resource, pname AS principal, {PRIVS} AS detail FROM items WHERE type = 'deny'
  UNION ALL SELECT export_id, 'delegate_admin', seq, {PLACE}, pname, 'delegated administration' FROM items WHERE delegate_admin
  UNION ALL SELECT export_id, 'no_equivalent', seq, {PLACE}, pname, array_to_string({NO_EQ}, ', ') FROM items
    WHERE type IN ('grant', 'hbase_grant') AND len({NO_EQ}) > 0
  UNION ALL SELECT export_id, 'drop_to_manage', seq, {PLACE}, pname, {PRIVS} FROM items WHERE type IN ('grant', 'hbase_grant') AND list_contains(privs, 'DROP')
  UNION ALL SELECT export_id, 'create_dropped', seq, {PLACE}, pname, {PRIVS} FROM items
    WHERE type IN ('grant', 'hbase_grant') AND list_contains(privs, 'CREATE') AND "table" IS NOT NULL
  UNION ALL SELECT export_id, 'wildcard_table', seq, "schema" || '.*', pname, {PRIVS} FROM items WHERE type = 'grant' AND "table" IS NULL
  UNION ALL SELECT export_id, 'disabled', seq, {PLACE}, pname, policy_name FROM items WHERE NOT enabled
  UNION ALL SELECT export_id, 'filter_untranslatable', seq, {PLACE}, pname, filter_expr || ' — request_context' FROM items
    WHERE type = 'row_filter' AND contains(filter_expr, '${{{{')
  UNION ALL SELECT export_id, 'filter_translated', seq, {PLACE}, pname, filter_expr FROM items WHERE type = 'row_filter' AND NOT contains(filter_expr, '${{{{')
  UNION ALL SELECT export_id, 'conflict', seq, concat_ws('.', "schema", "table", col), NULL,
    CASE WHEN type = 'row_filter' THEN 'row filter conflict' ELSE 'column mask conflict' END || ', ' || n || ' rules merged' FROM clash
  UNION ALL SELECT export_id, category, k, 'policy_' || k, CASE WHEN category = 'blank_principal' THEN '— (blank)' ELSE '—' END, detail
    FROM raised WHERE category <> 'disabled'
  UNION ALL SELECT export_id, 'service_account', k, 'policy_' || k, principal,
    CASE WHEN contains(principal, '@') THEN 'realm principal' ELSE 'service account' END FROM accounts)
"""
SEVERITIES = """CASE WHEN category IN ('deny', 'service_account', 'filter_untranslatable', 'deny_all_else') THEN 'critical'
  WHEN category = 'disabled' THEN 'info' ELSE 'warning' END"""


def _gap_query(category: str):
    """One category. Only its own source is read: items, conflict groups or policies."""

    def run(spark, sf):
        policies = B.fleet_policies(spark, sf)
        if category in (*gaps.FROM_WARNINGS, "service_account"):
            rows = gaps.policy_gaps(policies)
        elif category == "conflict":
            rows = gaps.conflict_gaps(B.fleet_items(spark, sf))
        else:
            rows = gaps.item_gaps(B.fleet_items(spark, sf))
        return rows.filter(F.col("category") == category).select(*gaps.GAP_COLUMNS)

    return run


for _number, _category in enumerate(gaps.CATEGORIES, 1):
    query(f"gap_{_category}", f"G{_number}", GAPS + f"SELECT * FROM gaps WHERE category = '{_category}'")(
        _gap_query(_category)
    )


def _gap_rows(spark, sf):
    policies = B.fleet_policies(spark, sf)
    items = stage(B.approved_items(spark, sf))
    return items, stage(gaps.gap_items(policies, items))


#: What statistics, counters and conflicts read of an item.
COUNTED = ["export_id", "type", "status", "enabled", "schema", "table", "columns", "seq", "principal", "privileges", "delegate_admin", "filter_expr"]


def _counted(spark, sf):
    """Items by the columns that counts need, written once, and the gap summary counted from them."""
    items = stage(B.approved_items(spark, sf).select(COUNTED))
    return items, gaps.gap_summary(gaps.gap_counts(B.fleet_policies(spark, sf), items))


TITLES = "CASE category " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, (_, t) in gaps.CATEGORIES.items()) + " END"
POSITIONS = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(gaps.CATEGORIES, 1)) + " END"
SUMMARY = GAPS + f""",
summary AS (SELECT export_id, {POSITIONS} AS position, category, {TITLES} AS title, {SEVERITIES} AS severity, count(*) AS items
  FROM gaps GROUP BY export_id, category)
"""


@query("gap_summary", "G16", SUMMARY + "SELECT * FROM summary")
def gap_summary(spark, sf):
    return _counted(spark, sf)[1]


@query("disabled_preview", "G8 O3", GAPS + """
SELECT * FROM gaps WHERE category = 'disabled' QUALIFY row_number() OVER (PARTITION BY export_id ORDER BY seq) <= 10""")
def disabled_preview(spark, sf):
    rows = gaps.item_gaps(B.fleet_items(spark, sf)).filter(F.col("category") == "disabled")
    return gaps.listed_gaps(rows)


# Scores ---------------------------------------------------------------------------------------

STATS = ", ".join(f"count(*) FILTER (type = '{t}') AS {n}" for t, n in scoring.TYPE_COUNTS.items()) + ", " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}" for s in ("approved", "needs_review", "pending", "rejected")
)


@query("item_statistics", "A4", FLEET + f"""
SELECT export_id, count(*) AS total, {STATS}, count(*) FILTER (NOT enabled) AS disabled, count(*) FILTER (not_translatable) AS not_translatable,
  count(DISTINCT "schema") AS schema_count, count(DISTINCT pname) AS principal_count FROM approved GROUP BY export_id""")
def item_statistics(spark, sf):
    return scoring.item_statistics(B.approved_items(spark, sf))


@query("item_schemas", "A4 O2", FLEET + 'SELECT DISTINCT export_id, "schema" FROM items WHERE "schema" IS NOT NULL')
def item_schemas(spark, sf):
    return scoring.item_schemas(B.fleet_items(spark, sf)).orderBy("export_id", "schema")


@query("item_principals", "A4 O2", FLEET + "SELECT DISTINCT export_id, pname AS principal FROM items WHERE pname IS NOT NULL")
def item_principals(spark, sf):
    return scoring.item_principals(B.fleet_items(spark, sf)).orderBy("export_id", "principal")


@query("principal_preview", "O3", FLEET + """
SELECT export_id, principal, row_number() OVER (PARTITION BY export_id ORDER BY principal) AS position
FROM (SELECT DISTINCT export_id, pname AS principal FROM items WHERE pname IS NOT NULL)
QUALIFY position <= 10""")
def principal_preview(spark, sf):
    return scoring.preview(scoring.item_principals(B.fleet_items(spark, sf)), ["export_id"], "principal", 10).withColumn(
        "position", F.col("position").cast("bigint")
    )


@query("severity_rollup", "A6", SUMMARY + """
SELECT export_id, severity, count(*) AS categories, CAST(sum(items) AS BIGINT) AS items FROM summary GROUP BY ALL""")
def severity_rollup(spark, sf):
    return scoring.severity_rollup(_counted(spark, sf)[1])


SCORES = SUMMARY + """,
counted AS (SELECT export_id, count(*) AS total, count(*) FILTER (not_translatable) AS lost FROM approved GROUP BY export_id),
sev AS (SELECT export_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning FROM summary GROUP BY ALL),
scores AS (
  SELECT c.*, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning,
    CAST(round_even((total - lost) / total * 100, 0) AS BIGINT) AS base,
    CAST(greatest(0, round_even((total - lost) / total * 100 - 10 * coalesce(critical, 0) - 3 * coalesce(warning, 0), 0)) AS BIGINT) AS score
  FROM counted c LEFT JOIN sev USING (export_id))
"""


def _scores(spark, sf):
    items, summary = _counted(spark, sf)
    return scoring.readiness(scoring.item_statistics(items), summary)


@query("readiness", "A7", SCORES + """
SELECT export_id, base, critical, warning, score, CASE WHEN score >= 70 THEN 'Ready' WHEN score >= 40 THEN 'Needs attention' ELSE 'Significant gaps' END AS verdict FROM scores""")
def readiness(spark, sf):
    return _scores(spark, sf).select("export_id", "base", "critical", "warning", "score", "verdict")


@query("score_breakdown", "A8", SCORES + """
SELECT export_id, 1 AS position, 'translatable' AS factor, total - lost AS amount, base AS impact FROM scores
UNION ALL SELECT export_id, 2, 'not_translatable', lost, -CAST(round_even(lost / total * 100, 0) AS BIGINT) FROM scores WHERE lost > 0
UNION ALL SELECT export_id, 3, 'critical_penalty', critical, -10 * critical FROM scores WHERE critical > 0
UNION ALL SELECT export_id, 4, 'warning_penalty', warning, -3 * warning FROM scores WHERE warning > 0
UNION ALL SELECT export_id, 5, 'score', total, score FROM scores""")
def score_breakdown(spark, sf):
    return scoring.score_breakdown(_scores(spark, sf))


@query("effort_class", "A9", SCORES + """
SELECT export_id, critical, CASE WHEN critical > 2 THEN 'High' WHEN critical > 0 THEN 'Medium' ELSE 'Low' END AS effort FROM scores""")
def effort_class(spark, sf):
    return _scores(spark, sf).select("export_id", "critical", "effort")


@query("archive_rollup", "A10", ARCHIVES + """
SELECT 'arch_' || k || CASE WHEN nested THEN '_20240102_030405' ELSE '' END || '.json' AS archive, count(*) FILTER (i % 2 = 0) AS "grant",
  count(*) FILTER (i % 2 = 1) AS deny, count(DISTINCT (k + i) % 4) AS schemas, count(*) AS total FROM ai GROUP BY ALL""")
def archive_rollup(spark, sf):
    items = archives.archive_items(archives.normalised(B.archive_documents(spark, sf)))
    return items.withColumnRenamed("export_id", "archive").groupBy("archive").agg(
        F.count_if(F.col("type") == "grant").alias("grant"),
        F.count_if(F.col("type") == "deny").alias("deny"),
        F.count_distinct("schema").alias("schemas"),
        F.count("*").alias("total"),
    )


@query("archive_types", "A10", ARCHIVES + """
SELECT archive, count(*) FILTER (i % 2 = 0) AS "grant", count(*) FILTER (i % 2 = 1) AS deny FROM ai GROUP BY archive""")
def archive_types(spark, sf):
    items = archives.archive_items(archives.normalised(B.archive_documents(spark, sf)))
    return scoring.type_rollup(items.withColumnRenamed("export_id", "archive")).select("archive", "grant", "deny")


@query("archive_states", "A10", ARCHIVES + """
SELECT archive, count(*) FILTER (i % 3 = 0) AS approved, count(*) FILTER (i % 3 <> 0) AS needs_review FROM ai GROUP BY archive""")
def archive_states(spark, sf):
    items = archives.archive_items(archives.normalised(B.archive_documents(spark, sf)))
    return scoring.status_rollup(items.withColumnRenamed("export_id", "archive")).select("archive", "approved", "needs_review")


@query("map_rollup", "A11", ARCHIVES + "SELECT archive, 2 AS principals, 1 AS remapped, 1 AS unchanged FROM a")
def map_rollup(spark, sf):
    return scoring.map_rollup(archives.archive_maps(archives.normalised(B.archive_documents(spark, sf))))


VOLUME = "'ext_loc_' || CASE WHEN trim(path, '/') = '' THEN 'root' ELSE regexp_replace(trim(path, '/'), '[^a-zA-Z0-9_]', '_', 'g') END"


@query("object_inventory", "A12", FLEET + f"""
SELECT DISTINCT export_id, kind, name FROM (
  SELECT export_id, 'catalog' AS kind, 'main' AS name FROM items WHERE type <> 'hdfs_grant'
  UNION ALL SELECT export_id, 'schema', "schema" FROM items UNION ALL SELECT export_id, 'table', "schema" || '.' || "table" FROM items
  UNION ALL SELECT export_id, 'volume', {VOLUME} FROM items WHERE type = 'hdfs_grant'
  UNION ALL SELECT export_id, 'function', "schema" || '.' || udf_name FROM items WHERE type = 'udf_grant'
  UNION ALL SELECT export_id, CASE WHEN ptype <> 'user' THEN ptype WHEN contains(pname, '@') THEN 'kerberos_principal'
    WHEN starts_with(pname, 'svc_') THEN 'service_account' ELSE 'user' END, pname FROM items) WHERE name IS NOT NULL""")
def object_inventory(spark, sf):
    return scoring.object_inventory(B.fleet_items(spark, sf))


@query("referenced_columns", "A12 X1", FLEET + """
SELECT DISTINCT export_id, "schema", "table", "column" FROM (
  SELECT export_id, "schema", "table", cols[1] AS "column" FROM items WHERE type = 'column_mask'
  UNION ALL SELECT export_id, "schema", "table", unnest(CASE WHEN contains(filter_expr, '$') THEN ['dept', 'USER', 'note'] ELSE ['region', 'dept_id'] END)
  FROM items WHERE type = 'row_filter')""")
def referenced_columns(spark, sf):
    return scoring.referenced_columns(B.fleet_items(spark, sf))


# Audit ----------------------------------------------------------------------------------------


@query("latest_events", "T1", """
SELECT event_id, ts, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'
ORDER BY ts DESC, event_id DESC LIMIT 100""")
def latest_events(spark, sf):
    log = B.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return audit.latest_events(log, "2024-01-15")


@query("log_comparison", "T2", """
WITH g AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_id % 2 = 0) AS old_events, count(*) FILTER (event_id % 2 = 1) AS new_events,
    count(*) FILTER (event_id % 2 = 0 AND event_type = 'error') AS old_denied, count(*) FILTER (event_id % 2 = 1 AND event_type = 'error') AS new_denied
  FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' GROUP BY ALL)
SELECT *, CASE WHEN new_events = 0 THEN 'old_only' WHEN old_events = 0 THEN CASE WHEN new_denied > 0 THEN 'new_only_denied' ELSE 'new_only' END
  WHEN new_denied > 0 AND old_denied = 0 THEN 'newly_denied' ELSE 'same' END AS finding FROM g""")
def log_comparison(spark, sf):
    log = B.table(spark, sf, "events").filter("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'").selectExpr(
        "user_id", "CAST(ts AS DATE) AS day", "event_type = 'error' AS denied", "event_id % 2 = 0 AS is_old"
    )
    return audit.compare_logs(log.filter("is_old"), log.filter("NOT is_old"), ["user_id", "day"])


# Notices and advisories -----------------------------------------------------------------------


@query("script_notices", "R4", FLEET + GROUPS + f""",
paths AS (SELECT DISTINCT path, {PATH_KEYS} AS key FROM page_items)
SELECT export_id, 'rule_conflicts' AS notice, CAST(count(*) AS VARCHAR) AS subject, '' AS object FROM clashes GROUP BY export_id
UNION ALL SELECT export_id, 'grant_deny', pname, "schema" || '.' || coalesce("table", 'None') FROM eligible WHERE type IN ('grant', 'deny')
  GROUP BY export_id, "schema", "table", pname HAVING count(*) FILTER (type = 'grant') > 0 AND count(*) FILTER (type = 'deny') > 0
UNION ALL SELECT 'files', 'nested_path', a.path, b.path FROM paths a JOIN paths b ON starts_with(b.key, a.key || '/')""")
def script_notices(spark, sf):
    return statements.notices(stage(B.approved_items(spark, sf)))


@query("gap_report_lines", "S7")
def gap_report_lines(spark, sf):
    items, rows = _gap_rows(spark, sf)
    summary = gaps.gap_summary(rows)
    scores = scoring.readiness(scoring.item_statistics(items), summary)
    return statements.gap_report_lines(summary, rows, scores)
