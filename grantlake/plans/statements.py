"""Statement and script tables: SQL text as ordered rows.

A script is a table of lines with a sort key, not one string: the lines of a merged rule or of a
large export spread over tasks, and the sink sorts by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import expression_issues, filter_columns, is_clean
from ..functions.naming import dotted, filter_function, has_wildcard, mask_function, privilege_note, quoted, safe_name
from ..functions.principals import member_test, resolved_name
from ..functions.rows import unnest
from ..operators import grants
from ..operators.conflicts import (
    ITEM_KEY,
    TARGET,
    conflict_count,
    conflict_members,
    duplicate_grants,
    eligible_paths,
    grant_deny_conflicts,
    nested_paths,
    rule_conflicts,
    taken_by_pattern,
    wildcard_column_emitters,
    wildcard_column_grants,
)
from ..operators.enforce import CO_ACCESS, deny_pattern_columns
from ..operators.identity import map_principals
from ..operators.review import eligible, guard_code
from ..operators.rule_bodies import (
    custom_text,
    filter_text,
    lone_mask_body,
    mask_column,
    mask_kind,
    merged_mask_body,
)
from ..operators.wildcards import columns_for_patterns

LINE_KEY = ["export_id", "part", "block", "sub", "line_no"]
HEADER, NOTICE, MERGED, ITEM = 0, 1, 2, 3


def no_lines() -> Column:
    return F.array().cast("array<string>")


def _lines(*texts: Column | str) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts]).cast("array<string>")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _function(name: Column, catalog: Column) -> Column:
    return F.concat(dotted(catalog, F.col("schema")), F.lit("."), name)


def _place(catalog: Column) -> Column:
    return dotted(catalog, F.col("schema"), F.col("table"))


def _grant_lines(catalog: Column) -> Column:
    return F.transform(
        grants.direct_grants(catalog),
        lambda g: F.concat(
            F.lit("GRANT "), g["privilege"], F.lit(" ON "), g["securable_type"], F.lit(" "), g["securable"],
            F.lit(" TO "), quoted(F.col("principal_name")), F.lit(";"),
        ),
    )


def _tag_lines(catalog: Column) -> Column:
    pairs = F.array_join(
        F.transform(F.map_entries("tag_attrs"), lambda e: F.concat(F.lit("'"), e["key"], F.lit("' = '"), e["value"], F.lit("'"))),
        ", ",
    )
    on_column = _lines(
        _text("ALTER TABLE ", _place(catalog)),
        _text("  ALTER COLUMN ", quoted(F.col("column")), " SET TAGS (", pairs, ");"),
    )
    on_table = _lines(_text("ALTER TABLE ", _place(catalog), " SET TAGS (", pairs, ");"))
    return F.when(F.length("column") > 0, on_column).otherwise(on_table)


def _filter_lines(catalog: Column) -> Column:
    name = _function(filter_function(F.col("table"), F.col("principal_name")), catalog)
    columns = filter_columns(filter_text())
    made = _lines(
        _text("CREATE OR REPLACE FUNCTION ", name, "(", F.array_join(F.transform(columns, lambda c: F.concat(c, F.lit(" STRING"))), ", "), ")"),
        "RETURNS BOOLEAN",
        "RETURN IF(",
        _text("  ", member_test(F.col("principal_type"), F.col("principal_name")), ","),
        _text("  ", filter_text(), ","),
        "  TRUE  -- others see all rows",
        ");",
        _text("ALTER TABLE ", _place(catalog)),
        _text("SET ROW FILTER ", name, " ON (", F.array_join(columns, ", "), ");"),
    )
    return F.when(is_clean(filter_text()), made).otherwise(no_lines())


def _mask_lines(catalog: Column) -> Column:
    name = _function(mask_function(F.col("table"), mask_column(), F.col("principal_name")), catalog)
    kind = F.when(mask_kind() == "DATE_YEAR", "DATE").otherwise("STRING")
    body = lone_mask_body()
    made = _lines(
        _text("CREATE OR REPLACE FUNCTION ", name, "(val ", kind, ")"),
        _text("RETURNS ", kind),
        "RETURN IF(",
        _text("  ", member_test(F.col("principal_type"), F.col("principal_name")), ","),
        _text("  ", body, ","),
        "  val",
        ");",
        _text("ALTER TABLE ", _place(catalog)),
        _text("ALTER COLUMN ", mask_column(), " SET MASK ", name, ";"),
    )
    return F.when(body.isNotNull(), made).otherwise(no_lines())


def exception_test() -> Column:
    """SQL text that is true for callers who are exempt from a deny, or empty."""
    tests = F.transform(
        "deny_exceptions", lambda e: member_test(e["type"], resolved_name(e["type"], e["name"]))
    )
    return F.array_join(F.array_distinct(tests), " OR ")


def _co_access_lines(catalog: Column) -> Column:
    """Null masks for the concrete columns of a co-access deny. Only groups are tested as groups."""
    together = F.filter("conditions", lambda c: c["type"] == CO_ACCESS)
    names = F.flatten(
        F.transform(together, lambda c: F.transform(c["values"], lambda v: F.regexp_extract(v, r"[^.]*$", 0)))
    )
    kind = F.when(F.col("principal_type") == "group", "group").otherwise("user")
    denied = member_test(kind, F.col("principal_name"))
    test = F.when(exception_test() != "", _text("(", denied, " AND NOT (", exception_test(), "))")).otherwise(denied)

    def block(c: Column) -> Column:
        name = F.concat(
            dotted(catalog, F.col("schema")), F.lit(".mask_"), F.coalesce("table", F.lit("None")), F.lit("_"), c,
            F.lit("_deny_"), safe_name(F.col("principal_name")),
        )
        return _lines(
            _text("CREATE OR REPLACE FUNCTION ", name, "(val STRING)"),
            "RETURNS STRING",
            _text("RETURN IF(", test, ", NULL, val);"),
            _text("ALTER TABLE ", dotted(catalog, F.col("schema"), F.coalesce("table", F.lit("None")))),
            _text("ALTER COLUMN ", c, " SET MASK ", name, ";"),
        )

    blocks = F.flatten(F.transform(F.filter(names, lambda n: ~has_wildcard(n)), block))
    return F.coalesce(blocks, no_lines())


#: Places of the columns of a pattern group within their item, after all of its principals.
AFTER_MEMBERS = 1 << 62


def _null_mask(name: Column, column: Column, test: Column, catalog: Column) -> Column:
    return _lines(
        _text("CREATE OR REPLACE FUNCTION ", name, "(val STRING)"),
        "RETURNS STRING",
        _text("RETURN IF(", test, ", NULL, val);"),
        _text("ALTER TABLE ", _place(catalog)),
        _text("ALTER COLUMN ", quoted(column), " SET MASK ", name, ";"),
    )


def restricted_column_rows(items: DataFrame, columns: DataFrame, mapping: DataFrame | None = None, catalog: str = "main") -> DataFrame:
    """Grants by column pattern as masks, at the place of the group's first item: (export_id, seq, sub, lines).

    A group has one test function, with a line per permitted principal, and one mask per column that
    calls it, so lines grow with principals plus columns. Principals come by their first item,
    columns by name.
    """
    where = F.lit(catalog)
    group = ["export_id", "schema", "table", "pattern"]
    led = wildcard_column_emitters(items)
    tester = F.concat(dotted(where, F.col("schema")), F.lit(".permitted_"), safe_name(F.col("table")), F.lit("_"), F.col("seq").cast("string"))
    head = _lines(_text("CREATE OR REPLACE FUNCTION ", tester, "()"), "RETURNS BOOLEAN", "RETURN FALSE")
    people = map_principals(wildcard_column_grants(items).drop("column"), mapping)
    people = people.groupBy(*group, "principal_type", "principal_name").agg(F.min("seq").alias("member_seq")).join(led, group)
    test = _lines(_text("  OR ", member_test(F.col("principal_type"), F.col("principal_name"))))
    by_name = Window.partitionBy("export_id", "seq").orderBy("match")  # columns of one table
    found = columns_for_patterns(led, columns).withColumn("rank", F.row_number().over(by_name))
    name = F.concat(dotted(where, F.col("schema")), F.lit(".mask_"), safe_name(F.col("table")), F.lit("_col_restrict_"), safe_name(F.col("match")))
    masks = _null_mask(name, F.col("match"), F.concat(F.lit("NOT "), tester, F.lit("()")), where)
    return (
        led.select("export_id", "seq", F.lit(1).cast("bigint").alias("sub"), head.alias("lines"))
        .unionByName(people.select("export_id", "seq", F.col("member_seq").alias("sub"), test.alias("lines")))
        .unionByName(led.select("export_id", "seq", F.lit(AFTER_MEMBERS).alias("sub"), _lines("  ;").alias("lines")))
        .unionByName(found.select("export_id", "seq", (F.lit(AFTER_MEMBERS) + F.col("rank")).alias("sub"), masks.alias("lines")))
    )


def denied_column_rows(items: DataFrame, columns: DataFrame, mapping: DataFrame | None = None, catalog: str = "main") -> DataFrame:
    """Denies by column pattern as masks, after the lines of their item: (export_id, seq, sub, lines)."""
    where = F.lit(catalog)
    hit = deny_pattern_columns(items, columns).filter(guard_code().isNull()).withColumnRenamed("column", "match")
    once = map_principals(hit.dropDuplicates(["export_id", "seq", "match"]), mapping)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("export_id", "seq").orderBy("match")))
    denied = member_test(F.col("principal_type"), F.col("principal_name"))
    test = F.when(exception_test() != "", _text("(", denied, " AND NOT (", exception_test(), "))")).otherwise(denied)
    name = F.concat(
        dotted(where, F.col("schema")), F.lit(".mask_"), safe_name(F.col("table")), F.lit("_deny_"),
        safe_name(F.col("principal_name")), F.lit("_"), safe_name(F.col("match")),
    )
    return ranked.select("export_id", "seq", F.col("rank").cast("bigint").alias("sub"), _null_mask(name, F.col("match"), test, where).alias("lines"))


def column_pattern_items(items: DataFrame) -> DataFrame:
    """The items that ``column_pattern_lines`` reads: eligible grants and denies with a column pattern."""
    return eligible(items).filter(F.col("type").isin("grant", "deny") & taken_by_pattern())


def column_pattern_lines(items: DataFrame, columns: DataFrame, mapping: DataFrame | None = None, catalog: str = "main") -> DataFrame:
    """Statements of all items with a column pattern: (export_id, seq, sub, line_no, line)."""
    rows = restricted_column_rows(items, columns, mapping, catalog).unionByName(denied_column_rows(items, columns, mapping, catalog))
    return unnest(rows, "lines", "line", "line_no", ["export_id", "seq", "sub"])


def item_lines(catalog: Column) -> Column:
    """Executable lines of one item; advisory items have none."""
    kind = F.col("type")
    return F.when(
        guard_code().isNull(),
        F.when(kind.isin("grant", "hbase_grant", "hdfs_grant", "udf_grant", "tag_grant"), _grant_lines(catalog))
        .when(kind == "tag_set", _tag_lines(catalog))
        .when(kind == "row_filter", _filter_lines(catalog))
        .when(kind == "column_mask", _mask_lines(catalog))
        .when(kind == "deny", _co_access_lines(catalog))
        .otherwise(no_lines()),
    ).otherwise(no_lines())


NOTE = "struct<code:string,detail:string>"


def _note(test: Column, code: Column | str, detail: Column) -> Column:
    label = F.lit(code) if isinstance(code, str) else code
    return F.when(F.coalesce(test, F.lit(False)), F.struct(label, detail).cast(NOTE))


def item_notes() -> Column:
    """Advisory notes of one item with its ``scope``: array of (code, detail)."""
    kind = F.col("type")
    where = F.col("scope")
    nothing = F.array().cast(f"array<{NOTE}>")
    target = F.lit("target")
    on_table = where.isin("table", "table_pattern")
    per_privilege = F.array_compact(
        F.transform(
            "privileges",
            lambda p: F.when(
                privilege_note(p, on_table).isNotNull(), F.struct(privilege_note(p, on_table), p).cast(NOTE)
            ),
        )
    )
    lost_on_catalog = F.transform(
        F.filter("privileges", lambda p: p != "ALL PRIVILEGES"),
        lambda p: F.struct(F.lit("not_on_catalog"), p).cast(NOTE),
    )
    conditions = F.transform(
        "conditions",
        lambda c: F.struct(
            F.when(c["type"] == CO_ACCESS, "co_access").otherwise("condition"),
            F.concat_ws(": ", c["type"], F.array_join(c["values"], ", ")),
        ).cast(NOTE),
    )
    exceptions = F.array_join(F.transform("deny_exceptions", lambda e: F.concat_ws(": ", e["type"], e["name"])), ", ")
    issues = F.when(kind == "row_filter", expression_issues(filter_text())).when(
        (kind == "column_mask") & mask_kind().isin("REDACT", "CUSTOM"), expression_issues(custom_text())
    )
    single = F.array_compact(
        F.array(
            _note(where == "catalog", "catalog_level", target),
            _note(where == "table_pattern", "table_pattern", F.col("table")),
            _note(where == "schema_pattern", "schema_pattern", F.col("schema")),
            _note((kind == "grant") & where.isin("schema", "table") & (F.size("columns") > 0), "columns_widened", F.array_join("columns", ", ")),
            _note(where == "schema", "whole_schema", F.col("schema")),
            _note((kind == "hbase_grant") & (where == "none"), "all_namespaces", F.col("schema")),
            _note((kind == "hbase_grant") & (where != "none") & (F.size("col_families") > 0), "families_dropped", F.array_join("col_families", ", ")),
            _note(kind == "deny", "deny_not_supported", F.array_join("privileges", ", ")),
            _note((kind == "deny") & (F.size("columns") > 0), "deny_columns", F.array_join("columns", ", ")),
            _note((kind == "deny") & (F.size("deny_exceptions") > 0), "deny_exceptions", exceptions),
            _note(kind == "tag_placeholder", "tag_unresolved", F.array_join("tag_names", ", ")),
            _note(kind == "skipped_blank_principal", "blank_principal", F.array_join("blanks", "; ")),
            _note((kind == "column_mask") & (mask_kind() == "NONE"), "no_mask_needed", mask_column()),
            _note(F.col("delegate_admin"), "delegate_admin", target),
        )
    )
    some = F.concat(
        single,
        F.coalesce(F.when(where.isin("table", "schema", "table_pattern", "schema_pattern"), per_privilege), nothing),
        F.coalesce(F.when(where == "catalog", lost_on_catalog), nothing),
        F.coalesce(F.when(kind == "deny", conditions), nothing),
        F.coalesce(issues.cast(f"array<{NOTE}>"), nothing),
    )
    guard = F.array(F.struct(guard_code(), F.col("principal.name")).cast(NOTE))
    return F.when(guard_code().isNotNull(), guard).otherwise(some)


def advisories(items: DataFrame) -> DataFrame:
    """Advisory rows of all eligible items."""
    head = ["export_id", "seq", "type"]
    scoped = eligible(items).withColumn("scope", grants.scope())
    return unnest(scoped, item_notes(), "n", "note_no", head).select(*head, "note_no", "n.code", "n.detail")


def item_statements(items: DataFrame, mapping: DataFrame | None = None, catalog: str = "main") -> DataFrame:
    """Executable lines of each item, whatever its status: (export_id, seq, type, line_no, line)."""
    named = map_principals(items, mapping).withColumn("scope", grants.scope())
    return unnest(named, item_lines(F.lit(catalog)), "line", "line_no", ["export_id", "seq", "type"])


def _rows(df: DataFrame, part: int, block, sub, lines: Column) -> DataFrame:
    as_long = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("bigint")
    placed = df.select(
        "export_id",
        F.lit(part).alias("part"),
        as_long(block).alias("block"),
        as_long(sub).alias("sub"),
        lines.alias("lines"),
    )
    return unnest(placed, "lines", "line", "line_no", ["export_id", "part", "block", "sub"])


# A block key keeps merged filters before merged masks.
MASK_BLOCKS = 1 << 62
FIRST, LAST = -1, (1 << 63) - 1


def merged_rule_lines(items: DataFrame, mapping: DataFrame | None = None, catalog: str = "main") -> DataFrame:
    """Lines of the merged filter and mask functions: head, one row per branch, tail.

    Branches are rows of their own, so a function with very many branches is no single value.
    """
    cat = F.lit(catalog)
    members = map_principals(conflict_members(eligible(items)), mapping)
    is_filter = F.col("type") == "row_filter"
    block = F.col("first_seq") + F.when(is_filter, 0).otherwise(MASK_BLOCKS)

    used = members.filter(is_filter & is_clean(F.col("filter_expr"))).select(
        *TARGET, "seq", F.posexplode(filter_columns(F.col("filter_expr"))).alias("pos", "used")
    )
    # One row per distinct column name of a table, then the short list of names of that table.
    firsts = used.groupBy(*TARGET, "used").agg(F.min(F.struct("seq", "pos")).alias("at"))
    columns = firsts.groupBy(*TARGET).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "used"))), lambda e: e["used"]).alias("on_columns")
    )
    clean = (
        eligible(items)
        .filter(is_filter & is_clean(F.col("filter_expr")) & (F.length("table") > 0))
        .groupBy("export_id", "schema", "table")
        .agg(F.lit(True).alias("any_clean"))
    )
    groups = rule_conflicts(eligible(items)).alias("g")
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}")) for k in TARGET]
    with_columns = groups.join(columns.alias("c"), same, "left").select("g.*", "c.on_columns")
    near = [F.col(f"g.{k}").eqNullSafe(F.col(f"k.{k}")) for k in ("export_id", "schema", "table")]
    heads = with_columns.alias("g").join(clean.alias("k"), near, "left").select("g.*", "k.any_clean")

    runs = ~is_filter | F.coalesce("any_clean", F.lit(False))
    name = _function(
        F.when(is_filter, filter_function(F.col("table"))).otherwise(mask_function(F.col("table"), F.col("target_column"))), cat
    )
    listed = F.coalesce("on_columns", no_lines())
    params = F.array_join(F.transform(listed, lambda c: F.concat(c, F.lit(" STRING"))), ", ")
    title = _text(
        "-- merged ", F.when(is_filter, "row filter").otherwise("column mask"), " of ", F.col("members").cast("string"), " rules"
    )
    head = F.when(
        runs,
        _lines(
            title,
            _text("CREATE OR REPLACE FUNCTION ", name, "(", F.when(is_filter, params).otherwise("val STRING"), ")"),
            F.when(is_filter, "RETURNS BOOLEAN").otherwise("RETURNS STRING"),
            "RETURN",
            "  CASE",
        ),
    ).otherwise(_lines(title, "-- every branch must be rewritten by hand"))
    tail = F.when(
        runs,
        _lines(
            F.when(is_filter, "    ELSE TRUE").otherwise("    ELSE val"),
            "  END;",
            _text("ALTER TABLE ", _place(cat)),
            F.when(is_filter, _text("SET ROW FILTER ", name, " ON (", F.array_join(listed, ", "), ");")).otherwise(
                _text("ALTER COLUMN ", F.col("target_column"), " SET MASK ", name, ";")
            ),
        ),
    ).otherwise(no_lines())
    body = F.when(is_filter, F.when(is_clean(F.col("filter_expr")), filter_text())).otherwise(merged_mask_body())
    test = member_test(F.col("principal_type"), F.col("principal_name"))
    branch = F.when(body.isNotNull(), _lines(_text("    WHEN ", test, " THEN ", body))).otherwise(
        _lines(_text("    -- branch left out: ", F.col("principal_name"), ": ", F.col("filter_expr")))
    )
    return (
        _rows(heads, MERGED, block, FIRST, head)
        .unionByName(_rows(members, MERGED, block, F.col("seq"), branch))
        .unionByName(_rows(heads, MERGED, block, LAST, tail))
    )


def notices(items: DataFrame) -> DataFrame:
    """Notice rows: conflict count, grant/deny pairs and nested paths."""
    counted = conflict_count(eligible(items)).select(
        "export_id", F.lit("rule_conflicts").alias("notice"), F.col("conflicts").cast("string").alias("subject"),
        F.lit("").alias("object"),
    )
    pairs = grant_deny_conflicts(items).select(
        "export_id", F.lit("grant_deny").alias("notice"), F.col("principal_name").alias("subject"),
        F.concat_ws(".", "schema", F.coalesce("table", F.lit("None"))).alias("object"),
    )
    nested = nested_paths(eligible_paths(items)).select(
        "export_id", F.lit("nested_path").alias("notice"), F.col("parent").alias("subject"), F.col("child").alias("object")
    )
    return counted.unionByName(pairs).unionByName(nested)


def script_lines(
    items: DataFrame,
    mapping: DataFrame | None = None,
    catalog: str = "main",
    today: str = "",
    tables: DataFrame | None = None,
    columns: DataFrame | None = None,
) -> DataFrame:
    """All lines of the migration script of each export, with their sort key.

    Merged rules come first, then the other items in order. Grants by pattern or whole schema are
    resolved against ``tables`` when given, at the end; column patterns against ``columns``, at the
    place of their item.
    """
    sizes = items.groupBy("export_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("approved", "needs_review")).alias("used")
    )
    head = _lines(
        _text("-- Source: ", F.col("export_id")),
        _text("-- Target catalog: ", catalog),
        _text("-- Date: ", today),
        _text("-- Items: ", F.col("used").cast("string"), " of ", F.col("total").cast("string")),
    )
    header = _rows(sizes, HEADER, 0, 0, head)
    noted = _rows(
        notices(items), NOTICE, 0, 0, _lines(F.concat_ws(" ", F.lit("-- notice:"), "notice", "subject", "object"))
    )
    merged = merged_rule_lines(items, mapping, catalog)

    out_of_order = conflict_members(eligible(items)).select(*ITEM_KEY)
    by_pattern = wildcard_column_grants(items).select(*ITEM_KEY)
    rest = eligible(items).join(out_of_order.unionByName(by_pattern), ITEM_KEY, "left_anti")
    repeated = duplicate_grants(items).select(*ITEM_KEY, F.lit(True).alias("repeated"))
    marked = rest.join(repeated, ITEM_KEY, "left")
    named = map_principals(marked, mapping).withColumn("scope", grants.scope())
    title = _text("-- ", F.coalesce("policy_name", F.lit("None")), " [", F.col("type"), "] ", F.coalesce("principal.name", F.lit("None")))
    notes = F.transform(item_notes(), lambda n: F.concat_ws(": ", F.concat(F.lit("-- note "), n["code"]), n["detail"]))
    own = F.when(F.col("repeated"), _lines(title, "-- same grant as above, left out")).otherwise(
        F.concat(_lines(title), notes, item_lines(F.lit(catalog)))
    )
    plain = _rows(named, ITEM, F.col("seq"), 0, own)
    led = wildcard_column_emitters(items)
    patterns = _rows(
        led, ITEM, F.col("seq"), 0,
        _lines(_text("-- columns like ", F.col("pattern"), " of ", dotted(F.lit(catalog), F.col("schema"), F.col("table")), " are hidden from everybody not permitted")),
    )
    out = header.unionByName(noted).unionByName(merged).unionByName(plain).unionByName(patterns)
    if columns is not None:
        for rows in (restricted_column_rows(items, columns, mapping, catalog), denied_column_rows(items, columns, mapping, catalog)):
            out = out.unionByName(_rows(rows, ITEM, F.col("seq"), F.col("sub"), F.col("lines")))
    if tables is not None:
        # Direct grants are among the statements of their items already.
        effective = grants.effective_grants(items, tables, mapping, catalog, direct=False)
        out = out.unionByName(_rows(effective, ITEM + 1, 0, 0, _lines(grants.grant_statement())))
    return out


def gap_report_lines(summary: DataFrame, gaps: DataFrame, scores: DataFrame) -> DataFrame:
    """Gap report as ordered lines: summary first, then each category with its rows."""
    from ..operators.gaps import REMEDIATION, category_order, listed_gaps, unlisted_gaps
    from ..functions.principals import lookup

    top = _lines(
        _text("Items: ", F.col("total").cast("string")),
        _text("  translatable: ", (F.col("total") - F.col("not_translatable")).cast("string")),
        _text("  not translatable: ", F.col("not_translatable").cast("string")),
        _text("Readiness: ", F.col("score").cast("string"), "% (", F.col("verdict"), ")"),
        _text("Critical: ", F.col("critical").cast("string"), ", warnings: ", F.col("warning").cast("string")),
        _text("Items that need attention: ", F.col("issues").cast("string")),
    )
    heads = _lines(
        _text(F.upper("title"), " (", F.upper("severity"), ")"),
        _text("Count: ", F.col("items").cast("string")),
        _text("Remediation: ", lookup(REMEDIATION)[F.col("category")]),
    )
    rows = _lines(
        _text("  Resource: ", F.coalesce("resource", F.lit("None"))),
        _text("    Principal: ", F.coalesce("principal", F.lit("None"))),
        _text("    Detail: ", F.coalesce("detail", F.lit(""))),
    )
    return (
        _rows(scores, HEADER, 0, 0, top)
        .unionByName(_rows(summary, ITEM, F.col("position"), FIRST, heads))
        .unionByName(_rows(listed_gaps(gaps), ITEM, category_order(F.col("category")), F.col("seq"), rows))
        .unionByName(_rows(unlisted_gaps(summary), ITEM, F.col("position"), LAST, _lines(_text("  ... and ", F.col("unlisted").cast("string"), " more"))))
    )
