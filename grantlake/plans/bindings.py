"""Policy facts derived from the given tables, for the registered queries.

Every derivation is row by row over a whole table, so it grows with the table. ``oracle.py`` states
the same facts for the comparison engine, directly and without the policy model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fact import policy_items
from ..sources.exports import POLICY, SUB_ITEM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(keys: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly before each grows into a policy or a document. A table of a few row groups
    is read by as many tasks, and keys are too small to be split by their size."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, *keys.columns)


def _sub(groups="array()", users="array()", roles="array()", accesses="array()", delegate="false",
         conditions="null", row_filter="null", mask="null") -> str:
    return (
        f"CAST(named_struct('groups', {groups}, 'users', {users}, 'roles', {roles}, 'accesses', {accesses}, "
        f"'delegateAdmin', {delegate}, 'conditions', {conditions}, 'rowFilterInfo', {row_filter}, "
        f"'dataMaskInfo', {mask}) AS {SUB_ITEM})"
    )


def _access(words: str) -> str:
    return f"transform({words}, a -> named_struct('type', a, 'isAllowed', true))"


def _when(test: str, *items: str) -> str:
    return f"CASE WHEN {test} THEN array({', '.join(items)}) ELSE CAST(array() AS ARRAY<{SUB_ITEM}>) END"


def _policy(ident, name, description="''", enabled="true", deny_all="false", schedules="null", resources="null",
            allow="null", deny="null", exceptions="null", filters="null", masks="null") -> str:
    return (
        f"CAST(named_struct('id', {ident}, 'name', {name}, 'description', {description}, 'isEnabled', {enabled}, "
        f"'isDenyAllElse', {deny_all}, 'validitySchedules', {schedules}, 'resources', {resources}, "
        f"'policyItems', {allow}, 'denyPolicyItems', {deny}, 'denyExceptions', {exceptions}, "
        f"'rowFilterPolicyItems', {filters}, 'dataMaskPolicyItems', {masks}) AS {POLICY})"
    )


def _values(values: str, recursive: str = "false") -> str:
    return f"named_struct('values', {values}, 'isExcludes', false, 'isRecursive', {recursive})"


MASK_WORDS = (
    "element_at(array('MASK', 'MASK_SHOW_LAST_4', 'MASK_SHOW_FIRST_4', 'MASK_HASH', 'MASK_NONE', "
    "'MASK_DATE_SHOW_YEAR', 'MASK_NULL', 'CUSTOM'), CAST(k % 8 AS INT) + 1)"
)


def order_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table policy per order, in seven exports."""
    db = (
        "CASE WHEN k % 53 = 0 THEN array('*') WHEN k % 59 = 0 THEN null WHEN k % 29 = 0 THEN array('db1*') "
        "WHEN k % 6 = 0 THEN array(concat('db', c % 5), 'dbx') ELSE array(concat('db', c % 5)) END"
    )
    tb = (
        "CASE WHEN k % 13 = 0 THEN array('*') WHEN k % 17 = 0 THEN array('t1*') WHEN k % 61 = 0 THEN "
        "array(concat('t_$', '{{USER.dept}}')) WHEN k % 4 = 0 THEN array(concat('t', k % 40), 'shared') "
        "ELSE array(concat('t', k % 40)) END"
    )
    cl = "CASE WHEN k % 19 = 0 THEN array('col*') WHEN k % 5 = 0 THEN array('c1', 'c2') END"
    words = (
        "concat(CASE st WHEN 'F' THEN array('select', 'read') WHEN 'O' THEN array('update', 'create', 'drop') "
        "ELSE array('all', 'execute') END, CASE WHEN k % 15 = 0 THEN array('serviceadmin') ELSE array() END)"
    )
    accesses = (
        f"transform({words}, a -> named_struct('type', a, 'isAllowed', NOT (a = 'execute' AND k % 2 = 0)))"
    )
    first = _sub(
        groups="CASE WHEN k % 31 = 0 THEN array(concat('g', c % 20), ' ') ELSE array(concat('g', c % 20)) END",
        users="CASE WHEN k % 3 = 0 THEN array(concat('u', c)) WHEN k % 37 = 0 THEN "
              "array(concat('svc_', c % 9), concat('etl/h', c % 9, '@REALM')) "
              "WHEN k % 43 = 0 THEN array('{USER}') ELSE array() END",
        roles="CASE WHEN k % 23 = 0 THEN array(concat('r', k % 3)) ELSE array() END",
        accesses=accesses,
        delegate="k % 10 = 0",
        conditions="CASE WHEN k % 41 = 0 THEN array(named_struct('type', 'ip-range', 'values', array('10.0.0.0/8'))) END",
    )
    second = _sub(users="array(concat('u', c + 1))", accesses=_access("array('alter', 'index')"))
    deny = _sub(
        groups="array(concat('g', c % 20))",
        users="array(concat('u', c))",
        accesses=_access("array('select', 'lock')"),
        conditions="CASE WHEN k % 14 = 0 THEN array(named_struct('type', 'accessed-together', 'values', "
                   "array('db.t.c1', 'db.t.c2', 'db.t.x*'))) END",
    )
    exempt = _sub(groups="array(concat('g', (c + 1) % 20))", users="array('boss')")
    filter_0 = _sub(
        groups="array(concat('g', c % 20))",
        row_filter="named_struct('filterExpr', concat('region = ''EU'' AND dept_id = ', c % 10))",
    )
    filter_1 = _sub(
        users="array(concat('u', c))",
        row_filter="named_struct('filterExpr', concat('dept = $', '{{USER.dept}} OR note LIKE ''SELECT'''))",
    )
    mask = _sub(
        groups="array(concat('g', c % 20))",
        mask=f"named_struct('dataMaskType', {MASK_WORDS}, 'valueExpr', CASE WHEN k % 8 = 7 THEN "
             "'CASE WHEN c1 > 5 THEN c1 ELSE CAST(''XX'' AS INT) END' END, 'conditionExpr', null)",
    )
    policy = _policy(
        "k", "concat('policy_', k)", "pr", "k % 11 <> 0", "k % 97 = 0",
        "CASE WHEN k % 89 = 0 THEN array(named_struct('startTime', '2020/01/01', 'endTime', "
        "CASE WHEN k % 2 = 0 THEN '2021/01/01' END)) END",
        f"map('database', {_values(db)}, 'table', {_values(tb)}, 'column', {_values(cl)})",
        f"concat(array({first}), {_when('k % 6 = 1', second)})",
        _when("k % 7 = 0", deny),
        _when("k % 7 = 0", exempt),
        f"concat({_when('k % 8 = 1', filter_0)}, {_when('k % 16 = 1', filter_1)})",
        _when("k % 9 = 1", mask),
    )
    keys = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "o_orderstatus AS st", "o_orderpriority AS pr"
    )
    return spread(keys).selectExpr(
        "concat('svc', c % 7) AS export_id", "'hive' AS service_type", "k AS policy_pos", f"{policy} AS policy"
    )


def page_policies(spark: SparkSession, sf_dir: str, url_resource: bool = False) -> DataFrame:
    """One path policy per page; as a url resource of a table service with ``url_resource``."""
    name, service, export = ("url", "hive", "urls") if url_resource else ("path", "hdfs", "files")
    missing = "array(url)" if url_resource else "null"
    paths = (
        "CASE k % 4 WHEN 0 THEN array(concat(url, '/')) WHEN 1 THEN array(url, concat(url, '/*')) "
        f"WHEN 2 THEN array(regexp_extract(url, '^[^?#]*/', 0)) ELSE {missing} END"
    )
    allow = _sub(
        groups="array(concat('web', k % 5))",
        accesses=_access("CASE WHEN k % 4 = 0 THEN array('read', 'write', 'fly') ELSE array('read', 'execute') END"),
        delegate="k % 6 = 0",
    )
    policy = _policy("k", "concat('page_', k)", resources=f"map('{name}', {_values(paths, 'k % 2 = 0')})",
                     allow=f"array({allow})")
    return spread(table(spark, sf_dir, "pages").selectExpr("page_id AS k", "url")).selectExpr(
        f"'{export}' AS export_id", f"'{service}' AS service_type", "k AS policy_pos", f"{policy} AS policy"
    )


def part_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key-value policy per part."""
    tables = (
        "CASE k % 5 WHEN 0 THEN array(concat('ns', k % 3, ':t', k % 20)) WHEN 1 THEN array(concat('ns', k % 3, ':*')) "
        "WHEN 2 THEN array('*') WHEN 3 THEN array(concat('t', k % 20), 'ns1:x*') END"
    )
    families = "CASE WHEN k % 2 = 0 THEN array('cf1', 'cf2') END"
    allow = _sub(
        groups="array(concat('kv', k % 6))",
        accesses=_access("CASE WHEN k % 3 = 0 THEN array('read', 'create') ELSE array('write', 'admin', 'scan') END"),
    )
    policy = _policy("k", "concat('part_', k)",
                     resources=f"map('table', {_values(tables)}, 'column-family', {_values(families)})",
                     allow=f"array({allow})")
    return spread(table(spark, sf_dir, "part").selectExpr("p_partkey AS k")).selectExpr(
        "'kv' AS export_id", "'hbase' AS service_type", "k AS policy_pos", f"{policy} AS policy"
    )


def supplier_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function policy per supplier."""
    dbs = "CASE WHEN k % 4 = 0 THEN null ELSE array(concat('db', k % 5)) END"
    allow = _sub(users="array(concat('u', k))", roles="array('dev')", accesses=_access("array('all')"), delegate="k % 2 = 0")
    policy = _policy("k", "concat('fn_', k)",
                     resources=f"map('udf', {_values(_udfs())}, 'database', {_values(dbs)})",
                     allow=f"array({allow})")
    return spread(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k")).selectExpr(
        "'fn' AS export_id", "'hive' AS service_type", "k AS policy_pos", f"{policy} AS policy"
    )


def _udfs() -> str:
    return "array(concat('fn_', k % 10), 'fx')"


def fleet_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the above without tags: the standard fleet of the registered queries."""
    return (
        order_policies(spark, sf_dir)
        .unionByName(page_policies(spark, sf_dir))
        .unionByName(part_policies(spark, sf_dir))
        .unionByName(supplier_policies(spark, sf_dir))
    )


def fleet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_items(fleet_policies(spark, sf_dir))


def approved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet items after the bulk approval."""
    from ..operators.review import approve_valid

    return approve_valid(fleet_items(spark, sf_dir))


# Tags ---------------------------------------------------------------------------------------


def tag_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged resources as they stand in an export, one per part."""
    path = (
        "CASE WHEN k % 97 = 0 THEN p_type WHEN k % 10 = 0 THEN concat(p_type, '.', nm) "
        "ELSE concat(p_type, '.', nm, '.c', p_size) END"
    )
    tags = "CASE WHEN k % 4 = 0 THEN to_json(array(p_brand, 'PII')) ELSE p_brand END"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS k", "p_type", "replace(p_name, ' ', '_') AS nm", "p_size", "p_brand"
    ).selectExpr("'tags' AS export_id", "k AS res_pos", f"{path} AS path", f"{tags} AS tags")


def tag_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.exports import split_tag_resources

    return split_tag_resources(tag_entries(spark, sf_dir))


def tag_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attributes per brand, one for PII."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag")).distinct()
    rows = brands.selectExpr("tag", "stack(2, 0, 'level', concat('L', length(tag)), 1, 'owner', tag) AS (p, key, value)")
    pii = brands.selectExpr("'PII' AS tag", "0 AS p", "'level' AS key", "'high' AS value").distinct()
    return rows.unionByName(pii).selectExpr("'tags' AS export_id", "tag", "CAST(p AS BIGINT) AS attr_pos", "key", "value")


def tag_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tag policy per supplier; some name a tag that nothing carries."""
    names = (
        "CASE WHEN k % 3 = 0 THEN array(concat('Brand#', k % 30), 'PII') ELSE array(concat('Brand#', k % 30)) END"
    )
    allow = _sub(groups="array(concat('tg', k % 4))", users="array(concat('u', k))",
                 accesses=_access("array('select', 'drop')"), delegate="k % 5 = 0")
    row_filter = _sub(groups="array(concat('tg', k % 4))", row_filter="named_struct('filterExpr', 'owner_id = 7')")
    mask = _sub(mask="named_struct('dataMaskType', 'MASK_HASH', 'valueExpr', null, 'conditionExpr', null)")
    policy = _policy("k", "concat('tag_', k)", enabled="k % 6 <> 0", resources=f"map('tag', {_values(names)})",
                     allow=f"array({allow})", filters=_when("k % 2 = 0", row_filter), masks=_when("k % 5 = 1", mask))
    return spread(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k")).selectExpr(
        "'tags' AS export_id", "'hive' AS service_type", "k AS policy_pos", f"{policy} AS policy"
    )


# Listings, maps, documents ------------------------------------------------------------------


def target_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the target catalog, read off the parts: db0..db4, db10..db12, ns0..ns2."""
    return table(spark, sf_dir, "part").selectExpr(
        "explode(array(concat('db', p_partkey % 5), concat('db1', p_partkey % 3), concat('ns', p_partkey % 3))) AS schema",
        "concat('t', p_size, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END) AS table",
    ).distinct()


def target_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of target tables, read off the orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('db', o_custkey % 5) AS schema",
        "concat('t', o_orderkey % 40) AS table",
        "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'col_' ELSE 'k_' END, o_custkey % 4) AS column",
    ).distinct()


def identity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited identity map of every export: one entry per customer user and per group."""
    users = table(spark, sf_dir, "customer").selectExpr(
        "concat('svc', c_custkey % 7) AS export_id",
        "concat('u', c_custkey) AS source",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('user', c_custkey, '@corp.com') ELSE concat('u', c_custkey) END AS target",
    )
    groups = table(spark, sf_dir, "customer").selectExpr(
        "concat('svc', c_custkey % 7) AS export_id",
        "concat('g', c_custkey % 20) AS source",
        "concat('grp_', c_custkey % 20) AS target",
    ).distinct()
    return users.unionByName(groups)


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and their groups: each customer is in a segment and a numbered group."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_name AS user", "explode(array(c_mktsegment, concat('g', c_custkey % 20))) AS group"
    )


def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export document per customer, in every accepted shape, some that are no JSON and some with
    a field of the wrong type."""
    resources = (
        "CASE k % 5 WHEN 0 THEN '{\"path\":{\"values\":[\"/data\"]}}' WHEN 1 THEN "
        "'{\"table\":{\"values\":[\"t\"]},\"column-family\":{\"values\":[\"f\"]}}' ELSE '{\"table\":{\"values\":[\"t\"]}}' END"
    )
    item = "concat('{\"users\":[\"', nm, '\"],\"accesses\":[{\"type\":\"select\"},{\"type\":\"x\",\"isAllowed\":false}]}')"
    policy = f"concat('{{\"id\":', k, ',\"name\":\"p', k, '\",\"resources\":', {resources}, ',\"policyItems\":[', {item}, ']}}')"
    wrong = (
        f"CASE k % 50 WHEN 47 THEN replace({policy}, '[\"t\"]', '\"t\"') "
        f"WHEN 43 THEN replace({policy}, concat('[\"', nm, '\"]'), concat('\"', nm, '\"')) "
        f"WHEN 41 THEN replace({policy}, concat('\"id\":', k), concat('\"id\":\"', k, '\"')) "
        f"WHEN 37 THEN replace({policy}, '\"name\"', '\"isEnabled\":\"false\",\"name\"') ELSE {policy} END"
    )
    policy = wrong
    policies = f"concat('[', {policy}, CASE WHEN k % 3 = 0 THEN concat(',', {policy}) ELSE '' END, ']')"
    head = (
        "concat(CASE WHEN k % 7 = 0 THEN '' ELSE concat('\"serviceName\":\"', CASE k % 4 WHEN 0 THEN 'prod_hadoop' "
        "WHEN 1 THEN 'my_HBase' ELSE 'warehouse' END, '\",') END, "
        "CASE WHEN k % 6 = 0 THEN '\"serviceType\":\"HIVE\",' ELSE '' END, "
        "CASE WHEN k % 2 = 0 THEN '\"clusterName\":\"c1\",' ELSE '' END)"
    )
    body = f"concat('{{', {head}, '\"policies\":', {policies}, '}}')"
    document = (
        f"CASE WHEN k % 50 = 49 THEN concat('{{broken ', k) WHEN k % 8 = 5 THEN concat(CASE WHEN k % 16 = 5 THEN '\\n\\t ' ELSE '' END, {policies}) "
        f"WHEN k % 8 = 6 THEN concat('{{\"testCases\":[{{\"name\":\"x\",\"servicePolicies\":', {body}, '}}]}}') ELSE {body} END"
    )
    return spread(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS nm")).selectExpr(
        "concat('doc', k) AS export_id", f"{document} AS document"
    )


def archive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive document per customer: nested for even keys, the old flat form for odd ones."""
    item = (
        "concat('{\"id\":\"', k, '-grant-', i, '\",\"type\":\"', CASE WHEN i % 2 = 0 THEN 'grant' ELSE 'deny' END, "
        "'\",\"schema\":\"db', (k + i) % 4, '\",\"principal\":{\"type\":\"group\",\"name\":\"g', i, '\"},\"status\":\"', "
        "CASE WHEN i % 3 = 0 THEN 'approved' ELSE 'needs_review' END, '\",\"enabled\":true}')"
    )
    items = f"concat('[', array_join(transform(sequence(0, CAST(k % 4 AS INT)), i -> {item}), ','), ']')"
    mapping = "concat('{\"a', k, '\":\"a', k, '\",\"b\":\"B', k, '\"}')"
    sql = "CASE WHEN k % 3 = 0 THEN '' ELSE concat('GRANT ', k) END"
    nested = (
        "concat('{\"metadata\":{\"timestamp\":\"2024-01-', lpad(k % 28 + 1, 2, '0'), '\",\"service_name\":\"svc', k % 7, "
        "'\",\"cluster_name\":\"c', k % 2, '\",\"catalog_name\":\"main\",\"source_file\":\"', "
        "CASE WHEN k % 4 = 0 THEN '' ELSE 'src.json' END, '\",\"notes\":\"n\"},"
        "\"parsed_data\":{\"serviceName\":\"svc', k % 7, '\",\"serviceType\":\"hdfs\",\"totalRangerPolicies\":', k % 9, '},"
        f"\"policy_items\":', {items}, ',\"identity_map\":', {mapping}, ',\"generated_sql\":\"', {sql}, '\"}}')"
    )
    flat = (
        "concat('{\"timestamp\":\"2023-02-', lpad(k % 28 + 1, 2, '0'), '\",\"serviceName\":\"svc', k % 7, "
        f"'\",\"policyItems\":', {items}, ',\"identityMap\":', {mapping}, ',\"generatedSQL\":\"', {sql}, '\"}}')"
    )
    name = "concat('arch_', k, CASE WHEN k % 2 = 0 THEN '_20240102_030405' ELSE '' END, '.json')"
    return spread(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k")).selectExpr(
        f"{name} AS archive", f"CASE WHEN k % 2 = 0 THEN {nested} ELSE {flat} END AS document"
    )
