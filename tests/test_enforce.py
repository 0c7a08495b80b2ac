"""Rules applied to data, brute force on small frames."""

import pytest
from pyspark.sql import functions as F

from grantlake.functions import expressions as X
from grantlake.functions import naming
from grantlake.operators import enforce, wildcards
from grantlake.operators.ranking import spread_row_number
from grantlake.plans.queries_rules import rule_items


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "alice", "2020-05-06", 10), (2, "bob", "x", 20), (3, None, None, 30)]
    return spark.createDataFrame(rows, "id int, name string, born string, pay int")


def secured(people, rules, session, **options):
    items = rule_items(people.sparkSession, "hr", "people", rules)
    return enforce.secure(people, items, session, "hr", "people", **options).orderBy("id").collect()


BOB = enforce.Session("bob@company.com", ("b",))


def test_first_matching_branch_counts(people):
    rules = [
        {"who": "group:a", "column": "name", "mask": "MASK"},
        {"who": "user:bob", "column": "name", "mask": "MASK_SHOW_FIRST_4"},
        {"who": "group:b", "column": "name", "mask": "MASK_NULL"},
    ]
    assert [r.name for r in secured(people, rules, BOB)] == ["alic***", "bob***", None]
    assert [r.name for r in secured(people, rules, enforce.Session("eve", ()))] == ["alice", "bob", None]


def test_merged_custom_text_beats_kind_and_lone_ignores_it(people):
    custom = {"who": "group:b", "column": "name", "mask": "MASK_HASH", "expr": "upper(name)"}
    assert secured(people, [custom, {**custom, "who": "group:z"}], BOB)[0].name == "ALICE"
    assert len(secured(people, [custom], BOB)[0].name) == 64


def test_cross_column_text_is_redacted_when_merged(people):
    rule = {"who": "group:b", "column": "name", "mask": "CUSTOM", "expr": "concat(pay, name)"}
    assert secured(people, [rule, {**rule, "who": "group:z"}], BOB)[0].name == "***REDACTED***"


def test_year_mask_alone_and_merged(people):
    rule = {"who": "group:b", "column": "born", "mask": "MASK_DATE_SHOW_YEAR"}
    merged = secured(people, [rule, {**rule, "who": "group:z"}], BOB)
    assert [r.born for r in merged] == ["2020-01-01", None, None]
    dated = secured(people.filter("id = 1"), [rule], BOB)
    assert str(dated[0].born) == "2020-01-01" and not isinstance(dated[0].born, str)


def test_filter_sees_clear_values(people):
    rules = [
        {"who": "group:b", "filter": "name = 'bob'"},
        {"who": "group:b", "column": "name", "mask": "MASK"},
    ]
    assert [(r.id, r.name) for r in secured(people, rules, BOB)] == [(2, "***REDACTED***")]


def test_unmatched_callers(people):
    rules = [{"who": "group:z", "filter": "id = 1"}]
    assert len(secured(people, rules, BOB)) == 3
    assert secured(people, rules, BOB, default="deny") == []
    unclean = [{"who": "group:b", "filter": "id = ${{USER.id}}"}]
    assert len(secured(people, unclean, BOB)) == 3


def test_membership_frame_equals_group_list(spark, people):
    members = spark.createDataFrame([("bob@company.com", "b"), ("eve", "z")], "user string, group string")
    rules = [{"who": "role:b", "filter": "id > 1"}]
    joined = secured(people, rules, enforce.Session("bob@company.com", membership=members))
    assert joined == secured(people, rules, BOB)


def test_plan_needs_no_shuffle_and_pushes_the_filter(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    items = rule_items(spark, "hr", "people", [{"who": "group:b", "filter": "pay > 15"}])
    plan = enforce.secure(stored, items, BOB, "hr", "people")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThan(pay,15)" in plan


@pytest.mark.parametrize(
    "path, key",
    [("/", "/"), ("", "/"), ("/a/", "/a"), ("/a/*", "/a"), ("/a/**", "/a/*"), ("s3://b//*/", "s3://b"), ("*", "/")],
)
def test_path_keys(spark, path, key):
    assert spark.range(1).select(naming.path_key(F.lit(path))).first()[0] == key


def test_patterns_equal_brute_force(spark):
    patterns = ["a*", "*", "?b*", "a_c", "ab", "*c?", "b%d"]
    names = ["a", "ab", "abc", "axc", "bbd", "b", "cb1", "a\\b"]
    items = spark.createDataFrame([(p,) for p in patterns], "like string").select(naming.like_pattern(F.col("like")).alias("like"))
    listed = spark.createDataFrame([(n,) for n in names], "table string")
    got = wildcards.match_patterns(items, listed, [], "table").distinct().collect()

    def like(p, n):
        if not p:
            return not n
        if p[0] == "%":
            return any(like(p[1:], n[i:]) for i in range(len(n) + 1))
        return bool(n) and (p[0] == "_" or p[0] == n[0]) and like(p[1:], n[1:])

    translated = [p.translate(str.maketrans("*?", "%_")) for p in patterns]
    assert {(r.like, r.table) for r in got} == {(p, n) for p in translated for n in names if like(p, n)}


def test_spread_row_number_equals_plain_order(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 977).alias("o"))
    got = spread_row_number(rows, ["g"], "o", "n").collect()
    for g in range(3):
        ordered = sorted((r.o, r.n) for r in got if r.g == g)
        assert [n for _, n in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize(
    "text, adapted, others",
    [
        ("CAST('12.5' AS INT)", "CAST('12.5' AS INT)", []),
        ("cast ( '1_0e3' as double)", "cast ( '1_0e3' as double)", []),
        ("CAST('abc' AS DECIMAL (3,1))", "NULL", []),
        ("CASE WHEN amt > 1 THEN amt2 END", "CASE WHEN val > 1 THEN amt2 END", ["amt2"]),
        ("f(amt, other)", "f(val, other)", ["other"]),
    ],
)
def test_custom_mask_text(spark, text, adapted, others):
    row = spark.range(1).select(X.adapted_mask(F.lit(text), F.lit("amt")).alias("a"))
    got = row.select("a", X.other_columns(F.col("a")).alias("o")).first()
    assert (got.a, got.o) == (adapted, others)


def test_hide_columns(spark, people):
    hidden = spark.createDataFrame([("hr", "people", "pay"), ("hr", "other", "name")], "schema string, table string, column string")
    got = enforce.hide_columns(people, hidden, "hr", "people").first()
    assert got.pay is None and got.name == "alice"


def test_rules_of_several_exports(people):
    """The same place in two exports is not one rule; the export's name decides who comes first."""
    rules = [
        {"export": "b", "seq": 1, "who": "group:b", "filter": "id > 2"},
        {"export": "a", "seq": 1, "who": "group:b", "filter": "id = 1"},
    ]
    assert [r.id for r in secured(people, rules, BOB)] == [1]
    assert [r.id for r in secured(people, rules, BOB, export_id="b")] == [3]


def test_exceptions_by_membership(spark):
    rows = [("e", k, "s", "t", f"c{k}", ("group", "b"), [("group", g)]) for k, g in enumerate(["b", "z"])] + [("e", 9, "s", "t", "c9", ("group", "b"), None)]
    denied = spark.createDataFrame(rows, "export_id string, seq long, schema string, table string, column string, principal struct<type:string,name:string>, deny_exceptions array<struct<type:string,name:string>>")
    members = spark.createDataFrame([(BOB.user, "b")], "user string, group string")
    for session in (BOB, enforce.Session(BOB.user, membership=members)):
        assert sorted(r.column for r in enforce.denied_columns(denied, session).collect()) == ["c1", "c9"]
