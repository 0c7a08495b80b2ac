"""Fixed values of the policy model: access words, mask kinds, word lists.

Everything here is plain data that results depend on; the code that uses it lives elsewhere.
"""

# Access word -> privilege, table services.
TABLE_ACCESS = {
    "select": "SELECT",
    "read": "SELECT",
    "update": "MODIFY",
    "create": "CREATE",
    "drop": "DROP",
    "alter": "ALTER",
    "all": "ALL PRIVILEGES",
    "write": "MODIFY",
    "index": "SELECT",
    "lock": "SELECT",
    "execute": "EXECUTE",
}

# Access word -> privilege, path services.
PATH_ACCESS = {
    "read": "READ VOLUME",
    "write": "WRITE VOLUME",
    "execute": "READ VOLUME",
    "all": "READ VOLUME",
}
URL_UNKNOWN_ACCESS = "READ FILES"

# Access word -> privilege, key-value services.
KV_ACCESS = {
    "read": "SELECT",
    "write": "MODIFY",
    "create": "CREATE",
    "admin": "ALL PRIVILEGES",
    "all": "ALL PRIVILEGES",
}

# Mask word -> mask kind (an unknown word means REDACT).
MASK_KINDS = {
    "MASK": "REDACT",
    "MASK_SHOW_LAST_4": "LAST_4",
    "MASK_SHOW_FIRST_4": "FIRST_4",
    "MASK_HASH": "HASH",
    "MASK_NONE": "NONE",
    "MASK_DATE_SHOW_YEAR": "DATE_YEAR",
    "MASK_NULL": "NULLIFY",
    "CUSTOM": "CUSTOM",
}

# Privileges of one service only, without a counterpart in the target catalog.
NO_EQUIVALENT = [
    "SERVICEADMIN",
    "REPLADMIN",
    "TEMPUDFADMIN",
    "URLAUTH",
    "CONSUME",
    "PUBLISH",
    "DESCRIBE",
    "ENTITY-READ",
]

# Privileges that exist on tables only (never on a schema).
TABLE_ONLY = ["SELECT", "MODIFY"]

# Words in a row-filter expression that are not column names.
FILTER_WORDS = [
    "select", "from", "where", "and", "or", "not", "in", "like", "is", "null",
    "true", "false", "between", "case", "when", "then", "else", "end", "if",
    "exists", "all", "any", "some", "union", "intersect", "except",
    "current_user", "current_date", "current_timestamp", "current_schema",
    "is_account_group_member",
]

# Words in a mask expression that are not column names.
MASK_WORDS = [
    "case", "when", "then", "else", "end", "and", "or", "not", "is", "in",
    "like", "between", "as", "null", "true", "false", "val",
    "cast", "try_cast", "if", "coalesce", "ifnull", "nvl", "greatest", "least", "nullif",
    "left", "right", "concat", "concat_ws", "length", "len", "substr", "substring",
    "sha2", "sha", "md5", "year", "month", "day", "hour", "minute", "second",
    "make_date", "date", "repeat", "lpad", "rpad",
    "upper", "lower", "trim", "ltrim", "rtrim", "replace", "regexp_replace",
    "to_date", "to_timestamp", "date_format", "datediff", "add_months",
    "string", "int", "integer", "bigint", "smallint", "tinyint",
    "double", "float", "real", "boolean", "decimal", "numeric",
    "array", "map", "struct", "current_user",
]

# Mask functions of the source services.
MASK_BUILTINS = [
    "mask", "mask_first_n", "mask_last_n", "mask_show_first_n", "mask_show_last_n", "mask_hash",
]

# Names and literals that end up in results.
USER_DOMAIN = "@company.com"
ALL_NAMESPACES = "_all_namespaces"
VOLUME_SCHEMA = "ranger_hdfs_volumes"
VOLUME_PREFIX = "ext_loc_"
REDACTED = "***REDACTED***"
LAST_4_PREFIX = "***-**-"
FIRST_4_SUFFIX = "***"

# Item types and review states.
ITEM_TYPES = [
    "grant", "deny", "row_filter", "column_mask", "hdfs_grant", "hbase_grant", "udf_grant",
    "tag_set", "tag_grant", "tag_placeholder", "skipped_blank_principal",
]
STATUSES = ["approved", "needs_review", "pending", "rejected"]

# Calls of source-service mask functions, in the order they are tried, and their plain
# SQL over ``val``. ``{n}`` is the number in the call.
MASK_CALLS = [
    (r"(?i)^mask_show_last_n\s*\(\s*\{col\}\s*,\s*(\d+)\s*(?:,.*)?\)", "CONCAT(REPEAT('x', GREATEST(0, LENGTH(val) - {n})), RIGHT(val, {n}))"),
    (r"(?i)^mask_show_first_n\s*\(\s*\{col\}\s*,\s*(\d+)\s*(?:,.*)?\)", "CONCAT(LEFT(val, {n}), REPEAT('x', GREATEST(0, LENGTH(val) - {n})))"),
    (r"(?i)^mask_hash\s*\(\s*\{col\}\s*\)", "SHA2(val, 256)"),
    (r"(?i)^mask_first_n\s*\(\s*\{col\}\s*,\s*(\d+)\s*(?:,.*)?\)", "CONCAT(REPEAT('x', {n}), RIGHT(val, GREATEST(0, LENGTH(val) - {n})))"),
    (r"(?i)^mask_last_n\s*\(\s*\{col\}\s*,\s*(\d+)\s*(?:,.*)?\)", "CONCAT(LEFT(val, GREATEST(0, LENGTH(val) - {n})), REPEAT('x', {n}))"),
    (r"(?i)^mask\s*\(\s*\{col\}\s*(?:,.*)?\)", "REGEXP_REPLACE(val, '[A-Za-z0-9]', 'x')"),
]

# A whole CASE expression with an ELSE branch, and the number types of a cast.
CASE_WITH_ELSE = r"(?is)^\s*CASE\s+WHEN\s+.+?\s+THEN\s+.+?\s+ELSE\s+(.+?)\s+END\s*$"
NUMERIC_TYPES = ["DECIMAL", "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "REAL", "NUMERIC", "NUMBER"]
