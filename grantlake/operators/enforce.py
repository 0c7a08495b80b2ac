"""Row filters and column masks applied to DataFrames for one caller.

For a known caller the first matching branch of a merged rule is the only one that can run, so it
is picked from the rule table by an aggregate. What reaches the driver is at most one row per
column of the protected table and one for its filter, whatever the size of the rule table. The
data itself gets a projection and a filter: no shuffle, no UDF, and pushdown keeps working.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bind_val, is_clean
from ..functions.naming import has_wildcard
from ..functions.principals import resolved_name
from .conflicts import wildcard_column_emitters, wildcard_column_grants
from .identity import map_principals
from .review import eligible, guard_code
from .rule_bodies import filter_text, lone_mask_body, mask_column, mask_kind, merged_mask_body
from .wildcards import columns_for_patterns

CO_ACCESS = "accessed-together"


@dataclass(frozen=True)
class Session:
    """The caller: a user name and the groups and roles they belong to.

    ``membership`` (columns user, group) may stand in for ``groups``; it is then joined, not read
    to the driver.
    """

    user: str
    groups: tuple[str, ...] = ()
    membership: DataFrame | None = field(default=None, compare=False)


def mark_member(items: DataFrame, session: Session, kind: str = "principal_type", name: str = "principal_name") -> DataFrame:
    """Add ``member``: whether the caller is, or belongs to, the principal of the row."""
    is_user = F.col(kind) == "user"
    if session.membership is None:
        in_group = F.col(name).isin(list(session.groups)) if session.groups else F.lit(False)
        return items.withColumn("member", F.when(is_user, F.col(name) == session.user).otherwise(in_group))
    mine = (
        session.membership.filter(F.col("user") == session.user)
        .select(F.col("group").alias(name), F.lit(True).alias("__in"))
        .distinct()
    )
    return (
        items.join(mine, name, "left")
        .withColumn(
            "member",
            F.when(is_user, F.col(name) == session.user).otherwise(F.coalesce("__in", F.lit(False))),
        )
        .drop("__in")
    )


def rule_choice(
    items: DataFrame,
    session: Session,
    schema: str,
    table: str,
    mapping: DataFrame | None = None,
    all_principals: bool = False,
    skip_disabled: bool = False,
    export_id: str | None = None,
) -> DataFrame:
    """The rule that counts for the caller, per target column of one table.

    One row per (type, column): number of rules that share the target and the chosen body. A lone
    rule and a merged one differ: see ``rule_bodies``. Rules of all exports count together, in the
    order of export and place there, unless ``export_id`` names one. ``all_principals`` looks at
    every principal of a rule in place of the first; ``skip_disabled`` leaves disabled policies
    out. Both are off by default. ``items`` is read as it is: hand in a staged table if several
    tables are protected.
    """
    rows = eligible(items).filter(
        F.col("type").isin("row_filter", "column_mask")
        & (F.col("schema") == schema)
        & (F.col("table") == table)
    )
    if export_id is not None:
        rows = rows.filter(F.col("export_id") == export_id)
    if skip_disabled:
        rows = rows.filter("enabled")
    rows = rows.withColumn("rule_seq", F.struct("export_id", "seq"))
    if all_principals:
        everyone = F.when(F.size("all_principals") > 0, F.col("all_principals")).otherwise(F.array("principal"))
        rows = rows.withColumn("principal", F.explode(everyone))
    marked = mark_member(map_principals(rows, mapping), session)
    is_filter = F.col("type") == "row_filter"
    clean = is_clean(F.col("filter_expr"))
    prepared = marked.select(
        "type",
        F.when(is_filter, "").otherwise(mask_column()).alias("column"),
        F.col("rule_seq").alias("seq"),
        "member",
        F.when(is_filter, F.when(clean, filter_text())).otherwise(lone_mask_body()).alias("lone"),
        F.when(is_filter, F.when(clean, filter_text())).otherwise(merged_mask_body()).alias("merged"),
        F.when(~is_filter, mask_kind()).alias("kind"),
        guard_code().isNotNull().alias("guarded"),
    )
    hit = F.col("member") & F.col("merged").isNotNull()
    alone = F.col("member") & ~F.col("guarded")
    chosen = prepared.groupBy("type", "column").agg(
        F.count_distinct("seq").alias("members"),
        F.min_by(F.when(hit, F.col("merged")), F.when(hit, F.col("seq"))).alias("merged"),
        F.min_by(F.when(alone, F.col("lone")), F.when(alone, F.col("seq"))).alias("lone"),
        F.bool_or(F.col("lone").isNotNull() & ~F.col("guarded")).alias("lone_runs"),
        F.min_by("kind", "seq").alias("kind"),
    )
    several = F.col("members") > 1
    return chosen.select(
        "type",
        "column",
        "members",
        F.when(several, F.col("merged")).otherwise(F.col("lone")).alias("body"),
        (several | F.col("lone_runs")).alias("masked"),
        (~several & (F.col("kind") == "DATE_YEAR")).alias("as_date"),
    )


def secure(
    df: DataFrame,
    items: DataFrame,
    session: Session,
    schema: str,
    table: str,
    mapping: DataFrame | None = None,
    default: str = "allow",
    **options,
) -> DataFrame:
    """``df`` as the caller may see it: the row filter on clear values first, then the masks.

    A masked column becomes text, except for a lone year mask, which stays a date. Callers without
    a matching branch see everything, or nothing from filtered tables with ``default="deny"``.
    """
    if default not in ("allow", "deny"):
        raise ValueError("default must be 'allow' or 'deny'")
    choice = rule_choice(items, session, schema, table, mapping, **options).filter(
        (F.col("type") == "row_filter") | F.col("column").isin(df.columns)
    )
    # At most one row per column of df, plus the filter.
    rules = {(r["type"], r["column"]): r for r in choice.collect()}
    filtering = rules.get(("row_filter", ""))
    if filtering is not None:
        if filtering["body"] is not None:
            df = df.filter(F.expr(filtering["body"]))
        elif default == "deny":
            df = df.filter(F.lit(False))
    out = []
    for name in df.columns:
        rule = rules.get(("column_mask", name))
        out.append(F.col(name) if rule is None or not rule["masked"] else _masked(name, rule))
    return df.select(out)


def _masked(name: str, rule) -> Column:
    kind = "DATE" if rule["as_date"] else "STRING"
    value = f"CAST(`{name}` AS {kind})"
    body = value if rule["body"] is None else bind_val(rule["body"], value)
    return F.expr(f"CAST({body} AS {kind})").alias(name)


def without_excepted(rows: DataFrame, session: Session) -> DataFrame:
    """Rows whose deny exceptions do not name the caller (names are taken as they are).

    Groups given with the session are tested in place. With a membership table the exceptions
    become rows, meet the caller's groups in a join and lead back by a key.
    """
    entries = F.coalesce("deny_exceptions", F.array().cast("array<struct<type:string,name:string>>"))
    me = F.lit(session.user)

    def by_user(e: Column) -> Column:
        return (e["type"] == "user") & (resolved_name(e["type"], e["name"]) == me)

    if session.membership is None:
        groups = F.array(*[F.lit(g) for g in session.groups]).cast("array<string>")
        return rows.filter(~F.exists(entries, lambda e: by_user(e) | ((e["type"] != "user") & F.array_contains(groups, e["name"]))))
    left = rows.filter(~F.exists(entries, by_user)).withColumn("__named", F.filter(entries, lambda e: e["type"] != "user"))
    key = ["export_id", "seq"]
    named = left.select(*key, F.explode("__named").alias("e")).select(*key, F.col("e.type").alias("kind"), F.col("e.name").alias("name"))
    excepted = mark_member(named.distinct(), session, "kind", "name").filter("member").select(*key).distinct()
    return left.drop("__named").join(excepted, key, "left_anti")


def co_access_columns(items: DataFrame) -> DataFrame:
    """Deny items by concrete column of their co-access conditions (``column``)."""
    together = F.filter("conditions", lambda c: c["type"] == CO_ACCESS)
    names = F.flatten(
        F.transform(together, lambda c: F.transform(c["values"], lambda v: F.regexp_extract(v, r"[^.]*$", 0)))
    )
    concrete = F.filter(names, lambda n: ~has_wildcard(n))
    return eligible(items).filter(F.col("type") == "deny").withColumn("column", F.explode(concrete))


def deny_pattern_columns(items: DataFrame, columns: DataFrame) -> DataFrame:
    """Deny items by column that one of their wildcard columns matches (``column``)."""
    rows = eligible(items).filter((F.col("type") == "deny") & (F.length("table") > 0) & F.col("columns").isNotNull())
    spread = rows.withColumn("pattern", F.explode("columns")).filter(
        has_wildcard(F.col("pattern")) & (F.col("pattern") != "*")
    )
    return columns_for_patterns(spread.drop("column"), columns).withColumnRenamed("match", "column")


def denied_columns(rows: DataFrame, session: Session, mapping: DataFrame | None = None, users_only_by_name: bool = False) -> DataFrame:
    """(schema, table, column) hidden from the caller by deny rows that have a ``column``.

    With ``users_only_by_name`` everything that is no group is compared with the user name, as the
    co-access rules do.
    """
    named = map_principals(rows, mapping)
    if users_only_by_name:
        kind = F.when(F.col("principal_type") == "group", "group").otherwise("user")
        named = named.withColumn("principal_type", kind)
    hit = without_excepted(mark_member(named, session).filter("member"), session)
    return hit.select("schema", "table", "column").distinct()


def grant_pattern_columns(items: DataFrame, columns: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Columns under wildcard-column grants, one row per column and permitted principal."""
    led = wildcard_column_emitters(items).withColumnRenamed("seq", "lead_seq")
    group = ["export_id", "schema", "table", "pattern"]
    rows = map_principals(wildcard_column_grants(items), mapping)
    permitted = rows.select(*group, "principal_type", "principal_name").distinct().join(led, group)
    return columns_for_patterns(permitted, columns).withColumnRenamed("match", "column")


def restricted_columns(rows: DataFrame, session: Session) -> DataFrame:
    """(schema, table, column) hidden from the caller because only others are permitted."""
    per_group = (
        mark_member(rows, session)
        .groupBy("export_id", "schema", "table", "column", "pattern", "lead_seq")
        .agg(F.bool_or("member").alias("permitted"))
    )
    last = per_group.groupBy("schema", "table", "column").agg(
        F.max_by("permitted", F.struct("export_id", "lead_seq", "pattern")).alias("permitted")
    )
    return last.filter(~F.col("permitted")).select("schema", "table", "column")


def hide_columns(df: DataFrame, hidden: DataFrame, schema: str, table: str) -> DataFrame:
    """Null out the columns of ``df`` that ``hidden`` lists. Reads at most one row per column."""
    names = {
        r["column"]
        for r in hidden.filter(
            (F.col("schema") == schema) & (F.col("table") == table) & F.col("column").isin(df.columns)
        )
        .select("column")
        .distinct()
        .collect()
    }
    return df.select(
        [F.lit(None).cast("string").alias(c) if c in names else F.col(c) for c in df.columns]
    )
