"""Comparison SQL for the derived facts: plain SQL over the given tables.

Item rows come from lists, unnest and a running sum, without nested policies.
"""

from __future__ import annotations

ALLOW_PRIVS = """
  CASE st WHEN 'F' THEN ['SELECT'] WHEN 'O' THEN ['MODIFY', 'CREATE', 'DROP']
       ELSE CASE WHEN k % 2 = 0 THEN ['ALL PRIVILEGES'] ELSE ['ALL PRIVILEGES', 'EXECUTE'] END END
  || CASE WHEN k % 15 = 0 THEN ['SERVICEADMIN'] ELSE [] END"""

MASK_WORD = """['MASK', 'MASK_SHOW_LAST_4', 'MASK_SHOW_FIRST_4', 'MASK_HASH', 'MASK_NONE',
  'MASK_DATE_SHOW_YEAR', 'MASK_NULL', 'CUSTOM'][CAST(k % 8 AS INT) + 1]"""

POLICIES = """
pol AS (
  SELECT 'svc' || (o_custkey % 7) AS export_id, o_orderkey AS k, o_custkey AS c, o_orderstatus AS st,
    o_orderpriority AS pr,
    CASE WHEN o_orderkey % 53 = 0 THEN ['*'] WHEN o_orderkey % 59 = 0 THEN ['default']
         WHEN o_orderkey % 29 = 0 THEN ['db1*']
         WHEN o_orderkey % 6 = 0 THEN ['db' || (o_custkey % 5), 'dbx'] ELSE ['db' || (o_custkey % 5)] END AS dbs,
    CASE WHEN o_orderkey % 13 = 0 THEN ['*'] WHEN o_orderkey % 17 = 0 THEN ['t1*']
         WHEN o_orderkey % 61 = 0 THEN ['t_${{USER.dept}}']
         WHEN o_orderkey % 4 = 0 THEN ['t' || (o_orderkey % 40), 'shared'] ELSE ['t' || (o_orderkey % 40)] END AS tbs,
    CASE WHEN o_orderkey % 19 = 0 THEN ['col*'] WHEN o_orderkey % 5 = 0 THEN ['c1', 'c2'] ELSE ['*'] END AS cls,
    o_orderkey % 11 <> 0 AS enabled
  FROM orders)"""

# kind_no: 1 allow, 2 deny, 3 filter, 4 mask. People are 'type:name'.
SUBS = f"""
sub AS (
  SELECT pol.*, 1 AS kind_no, 0 AS item_no,
    ['group:g' || (c % 20)]
    || CASE WHEN k % 3 = 0 THEN ['user:u' || c]
            WHEN k % 37 = 0 THEN ['user:svc_' || (c % 9), 'user:etl/h' || (c % 9) || '@REALM']
            WHEN k % 43 = 0 THEN ['user:{{USER}}'] ELSE [] END
    || CASE WHEN k % 23 = 0 THEN ['role:r' || (k % 3)] ELSE [] END AS people,
    {ALLOW_PRIVS} AS privs, k % 10 = 0 AS delegate, k % 31 = 0 AS blank,
    NULL AS filter_expr, NULL AS mask_type, NULL AS mask_expr
  FROM pol
  UNION ALL
  SELECT pol.*, 1, 1, ['user:u' || (c + 1)], ['ALTER', 'SELECT'], false, false, NULL, NULL, NULL FROM pol WHERE k % 6 = 1
  UNION ALL
  SELECT pol.*, 2, 0, ['group:g' || (c % 20), 'user:u' || c], ['SELECT', 'SELECT'], NULL, false, NULL, NULL, NULL
  FROM pol WHERE k % 7 = 0
  UNION ALL
  SELECT pol.*, 3, 0, ['group:g' || (c % 20)], [], NULL, false,
    'region = ''EU'' AND dept_id = ' || (c % 10), NULL, NULL FROM pol WHERE k % 8 = 1
  UNION ALL
  SELECT pol.*, 3, 1, ['user:u' || c], [], NULL, false,
    'dept = ${{{{USER.dept}}}} OR note LIKE ''SELECT''', NULL, NULL FROM pol WHERE k % 16 = 1
  UNION ALL
  SELECT pol.*, 4, 0, ['group:g' || (c % 20)], [], NULL, false, NULL, {MASK_WORD},
    CASE WHEN k % 8 = 7 THEN 'CASE WHEN c1 > 5 THEN c1 ELSE CAST(''XX'' AS INT) END' ELSE '' END
  FROM pol WHERE k % 9 = 1)"""

ORDER_ITEMS = """
sized AS (
  SELECT *, CASE kind_no WHEN 1 THEN len(people) + 1 WHEN 2 THEN len(people) WHEN 3 THEN 1 ELSE len(cls) END AS stride
  FROM sub),
placed AS (
  SELECT *, coalesce(sum(stride) OVER (PARTITION BY k ORDER BY kind_no, item_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sized),
cell AS (
  SELECT p.*, d.i AS di, t.i AS ti, dbs[d.i + 1] AS db, tbs[t.i + 1] AS tb
  FROM placed p, LATERAL (SELECT unnest(range(len(p.dbs))) AS i) d, LATERAL (SELECT unnest(range(len(p.tbs))) AS i) t),
leaf AS (
  SELECT cell.*, l.i AS leaf_no, people[l.i] AS who, NULL AS col, false AS is_blank, 0 AS shift
  FROM cell, LATERAL (SELECT unnest(range(1, len(cell.people) + 1)) AS i) l WHERE kind_no = 2
  UNION ALL
  SELECT cell.*, l.i, people[l.i], NULL, false, 1
  FROM cell, LATERAL (SELECT unnest(range(1, len(cell.people) + 1)) AS i) l WHERE kind_no = 1
  UNION ALL
  SELECT cell.*, 0, NULL, NULL, true, 1 FROM cell WHERE kind_no = 1 AND blank
  UNION ALL
  SELECT cell.*, 1, people[1], NULL, false, 0 FROM cell WHERE kind_no = 3
  UNION ALL
  SELECT cell.*, l.i, people[1], cls[l.i], false, 0
  FROM cell, LATERAL (SELECT unnest(range(1, len(cell.cls) + 1)) AS i) l WHERE kind_no = 4),
numbered AS (
  SELECT *, CAST(off * len(dbs) * len(tbs) + (di * len(tbs) + ti) * stride + leaf_no + shift AS BIGINT) AS num,
    split_part(who, ':', 1) AS ptype, who[strpos(who, ':') + 1:] AS pname
  FROM leaf),
order_items AS (
  SELECT export_id, (k + 1) * 4294967296 + num AS seq,
    CASE WHEN is_blank THEN k || '-blank-' || num
         WHEN kind_no = 1 THEN k || '-grant-' || db || '-' || tb || '-' || pname || '-' || num
         WHEN kind_no = 2 THEN k || '-deny-' || db || '-' || tb || '-' || pname || '-' || num
         WHEN kind_no = 3 THEN k || '-rowfilter-' || db || '-' || tb || '-' || pname || '-' || num
         ELSE k || '-mask-' || db || '-' || tb || '-' || col || '-' || pname || '-' || num END AS id,
    k AS policy_id, 'policy_' || k AS policy_name,
    CASE WHEN is_blank THEN 'skipped_blank_principal'
         ELSE ['grant', 'deny', 'row_filter', 'column_mask'][kind_no] END AS type,
    db AS "schema",
    CASE WHEN kind_no >= 3 THEN tb WHEN tb <> '*' THEN tb END AS "table",
    CASE WHEN is_blank THEN NULL WHEN kind_no = 4 THEN [col]
         WHEN kind_no < 3 AND cls[1] <> '*' THEN cls END AS cols,
    NULL AS path, NULL AS udf_name,
    CASE WHEN NOT is_blank THEN privs END AS privs,
    CASE WHEN NOT is_blank THEN ptype END AS ptype, CASE WHEN NOT is_blank THEN pname END AS pname,
    filter_expr, mask_type, mask_expr,
    CASE WHEN kind_no = 1 AND NOT is_blank THEN delegate END AS delegate_admin,
    CASE WHEN is_blank THEN true ELSE enabled END AS enabled,
    CASE WHEN kind_no = 1 AND NOT is_blank THEN 'pending' ELSE 'needs_review' END AS status,
    kind_no = 2 AND k % 14 = 0 AS co_access, c, k
  FROM numbered)"""

OTHER_ITEMS = """
page_paths AS (
  SELECT page_id AS k, CASE page_id % 4 WHEN 0 THEN [url || '/'] WHEN 1 THEN [url, url || '/*']
    WHEN 2 THEN [regexp_extract(url, '^[^?#]*/', 0)] ELSE ['/'] END AS paths FROM pages),
page_items AS (
  SELECT 'files' AS export_id, (k + 1) * 4294967296 + p.i AS seq, k || '-hdfs-web' || (k % 5) || '-' || p.i AS id,
    k AS policy_id, 'page_' || k AS policy_name, 'hdfs_grant' AS type, NULL AS "schema", NULL AS "table", NULL AS cols,
    paths[p.i] AS path, NULL AS udf_name,
    CASE WHEN k % 4 = 0 THEN ['READ VOLUME', 'WRITE VOLUME', 'FLY'] ELSE ['READ VOLUME'] END AS privs,
    'group' AS ptype, 'web' || (k % 5) AS pname, NULL AS filter_expr, NULL AS mask_type, NULL AS mask_expr,
    k % 6 = 0 AS delegate_admin, true AS enabled, 'pending' AS status, false AS co_access, NULL AS c, k
  FROM page_paths, LATERAL (SELECT unnest(range(1, len(paths) + 1)) AS i) p),
kv_tables AS (
  SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN [['ns' || (p_partkey % 3), 't' || (p_partkey % 20)]]
    WHEN 1 THEN [['ns' || (p_partkey % 3), NULL]] WHEN 3 THEN [['default', 't' || (p_partkey % 20)], ['ns1', 'x*']]
    ELSE [['_all_namespaces', NULL]] END AS tbs FROM part),
kv_items AS (
  SELECT 'kv' AS export_id, (k + 1) * 4294967296 + t.i AS seq, k || '-hbase-kv' || (k % 6) || '-' || t.i AS id,
    k AS policy_id, 'part_' || k AS policy_name, 'hbase_grant' AS type, tbs[t.i][1] AS "schema", tbs[t.i][2] AS "table",
    NULL AS cols, NULL AS path, NULL AS udf_name,
    CASE WHEN k % 3 = 0 THEN ['SELECT', 'CREATE'] ELSE ['MODIFY', 'ALL PRIVILEGES', 'SCAN'] END AS privs,
    'group' AS ptype, 'kv' || (k % 6) AS pname, NULL AS filter_expr, NULL AS mask_type, NULL AS mask_expr,
    false AS delegate_admin, true AS enabled,
    CASE WHEN tbs[t.i][1] = '_all_namespaces' THEN 'needs_review' ELSE 'pending' END AS status, false AS co_access,
    NULL AS c, k
  FROM kv_tables, LATERAL (SELECT unnest(range(1, len(tbs) + 1)) AS i) t),
fn_items AS (
  SELECT 'fn' AS export_id, (k + 1) * 4294967296 + f.i * 2 + w.i + 1 AS seq,
    k || '-udf-' || db || '-' || ['fn_' || (k % 10), 'fx'][f.i + 1] || '-' || ['u' || k, 'dev'][w.i + 1] || '-' || (f.i * 2 + w.i + 1) AS id,
    k AS policy_id, 'fn_' || k AS policy_name, 'udf_grant' AS type, db AS "schema", NULL AS "table", NULL AS cols,
    NULL AS path, ['fn_' || (k % 10), 'fx'][f.i + 1] AS udf_name, NULL AS privs,
    ['user', 'role'][w.i + 1] AS ptype, ['u' || k, 'dev'][w.i + 1] AS pname,
    NULL AS filter_expr, NULL AS mask_type, NULL AS mask_expr, k % 2 = 0 AS delegate_admin, true AS enabled,
    'pending' AS status, false AS co_access, NULL AS c, k
  FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'default' ELSE 'db' || (s_suppkey % 5) END AS db FROM supplier),
    (SELECT unnest(range(2)) AS i) f, (SELECT unnest(range(2)) AS i) w),
items AS (
  SELECT * FROM order_items UNION ALL SELECT * FROM page_items UNION ALL SELECT * FROM kv_items UNION ALL SELECT * FROM fn_items),
flagged AS (
  SELECT *, type = 'deny' OR coalesce(type = 'hbase_grant' AND "schema" = '_all_namespaces', false) AS not_translatable FROM items),
approved AS (
  SELECT * REPLACE (CASE WHEN NOT not_translatable AND enabled AND status <> 'rejected' THEN 'approved' ELSE status END AS status)
  FROM flagged),
eligible AS (SELECT * FROM approved WHERE status IN ('approved', 'needs_review'))"""

FLEET = f"WITH {POLICIES},{SUBS},{ORDER_ITEMS},{OTHER_ITEMS}"

TAGS = """
WITH entries AS (
  SELECT p_partkey AS res_pos, p_partkey AS k, p_type, replace(p_name, ' ', '_') AS nm,
    CASE WHEN p_partkey % 97 = 0 THEN p_type WHEN p_partkey % 10 = 0 THEN p_type || '.' || replace(p_name, ' ', '_')
         ELSE p_type || '.' || replace(p_name, ' ', '_') || '.c' || p_size END AS path,
    CASE WHEN p_partkey % 10 <> 0 THEN 'c' || p_size END AS col,
    CASE WHEN p_partkey % 4 = 0 THEN [p_brand, 'PII'] ELSE [p_brand] END AS tags
  FROM part),
res AS (
  SELECT res_pos, path, p_type AS "schema", nm AS "table", col AS "column", CAST(t.i AS BIGINT) AS tag_pos, tags[t.i + 1] AS tag
  FROM entries, LATERAL (SELECT unnest(range(len(tags))) AS i) t WHERE k % 97 <> 0),
tpol AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN ['Brand#' || (s_suppkey % 30), 'PII'] ELSE ['Brand#' || (s_suppkey % 30)] END AS tags,
    s_suppkey % 6 <> 0 AS enabled FROM supplier),
hits AS (
  SELECT p.k, t.i AS list_pos, r.* FROM tpol p, LATERAL (SELECT unnest(range(len(p.tags))) AS i) t
  JOIN res r ON r.tag = p.tags[t.i + 1]),
firsts AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY k, "schema", "table" ORDER BY list_pos, res_pos, tag_pos) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY list_pos, res_pos) AS hit,
  count(*) OVER (PARTITION BY k) AS found FROM firsts),
joined AS (
  SELECT p.k, p.enabled, array_to_string(p.tags, ',') AS tag_names, array_to_string(p.tags, '_') AS joined_tags, coalesce(r.found, 0) AS found,
    greatest(coalesce(r.found, 0), 1) AS cells, coalesce(r.hit, 1) AS hit,
    r."schema" AS rs, r."table" AS rt, r."column" AS rc
  FROM tpol p LEFT JOIN ranked r ON r.k = p.k)
"""


def flat_items(where: str = "true", source: str = "items") -> str:
    """Item rows of a source CTE in the flat form that the queries return."""
    return f"""{FLEET}
SELECT export_id, seq, id, policy_id, type, "schema", "table", array_to_string(cols, ',') AS columns,
  path, udf_name, array_to_string(privs, ',') AS privileges, ptype AS principal_type, pname AS principal,
  filter_expr, mask_type, mask_expr, delegate_admin, enabled, status
FROM {source} WHERE {where}"""
