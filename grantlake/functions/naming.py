"""Column builders for names, patterns, paths and privilege translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def slug(name: Column, length: int = 40) -> Column:
    """Lower case, anything but letters, digits, '-' and '_' replaced, cut to ``length``."""
    return F.substring(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_-]", "_"), 1, length)


def ascii_slug(name: Column, length: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "_"), 1, length)


def quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), name, F.lit("`"))


def dotted(*names: Column) -> Column:
    """Quoted names joined by dots; null parts are left out."""
    return F.concat_ws(".", *[quoted(n) for n in names])


def sql_text(value: Column) -> Column:
    """Single quotes doubled."""
    return F.replace(value, F.lit("'"), F.lit("''"))


def has_wildcard(name: Column) -> Column:
    return F.coalesce(name.rlike("[*?]"), F.lit(False))


def like_pattern(glob: Column) -> Column:
    """Glob to LIKE. '_' and '%' in the name stay pattern characters, as in the source rules."""
    return F.translate(glob, "*?", "%_")


def like_prefix(pattern: Column) -> Column:
    """Leading part of a LIKE pattern that holds no pattern character."""
    return F.regexp_extract(pattern, "^[^%_]*", 0)


def matches(name: str, pattern: str) -> Column:
    """``name LIKE pattern`` between two columns, with no escape character in effect."""
    return F.expr(f"{name} LIKE {pattern} ESCAPE '\u0001'")


def path_key(path: Column) -> Column:
    """Path without trailing slashes and without one trailing '*' (and the slashes before it)."""
    bare = F.regexp_replace(F.rtrim(path, F.lit("/")), r"/*\*$", "")
    return F.when(bare == "", "/").otherwise(bare)


def path_ancestors(key: Column) -> Column:
    """Every prefix of a path key that ends just before a '/', the empty prefix left out."""
    parts = F.split(key, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    prefixes = F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.filter(prefixes, lambda p: p != "")


def volume_name(path: Column) -> Column:
    inner = safe_name(F.trim(path, F.lit("/")))
    return F.concat(F.lit(rules.VOLUME_PREFIX), F.when(inner == "", "root").otherwise(inner))


def archive_title(file_name: Column) -> Column:
    """File name without '.json' and without a trailing time stamp."""
    return F.regexp_replace(F.regexp_replace(file_name, r"\.json$", ""), r"_\d{8}_\d{6}$", "")


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(file_name, "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")


def target_privilege(privilege: Column, on_table: Column) -> Column:
    """Privilege to grant in the target catalog, or null where there is none."""
    return (
        F.when((privilege == "CREATE") & on_table, F.lit(None).cast("string"))
        .when(privilege == "CREATE", "CREATE TABLE")
        .when(privilege == "DROP", "MANAGE")
        .when(privilege == "ALTER", "ALL PRIVILEGES")
        .when(privilege.isin("EXECUTE", *rules.NO_EQUIVALENT), F.lit(None).cast("string"))
        .otherwise(privilege)
    )


def privilege_note(privilege: Column, on_table: Column) -> Column:
    """Advisory code for a privilege that does not carry over as it is, else null."""
    return (
        F.when((privilege == "CREATE") & on_table, "create_not_on_table")
        .when(privilege == "DROP", "drop_becomes_manage")
        .when(privilege == "ALTER", "alter_becomes_all")
        .when(privilege == "EXECUTE", "execute_needs_function")
        .when(privilege.isin(*rules.NO_EQUIVALENT), "no_equivalent")
    )


def filter_function(table: Column, principal: Column | None = None) -> Column:
    return F.concat_ws("_", F.lit("rf"), table, *([] if principal is None else [safe_name(principal)]))


def mask_function(table: Column, column: Column, principal: Column | None = None) -> Column:
    tail = [] if principal is None else [safe_name(principal)]
    return F.concat_ws("_", F.lit("mask"), table, column, *tail)


def resource_label(catalog: Column, schema: Column, table: Column, missing: str = "*") -> Column:
    return F.concat_ws(".", catalog, schema, F.coalesce(table, F.lit(missing)))
