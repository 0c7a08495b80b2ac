"""Item rows of small hand-written exports."""

import json

import pytest

from grantlake.operators import conflicts, gaps, review, scoring, warnings
from grantlake.operators.fact import items_of_documents
from grantlake.operators.items import resource_items
from grantlake.operators.stage import stage
from grantlake.plans import bindings, statements
from grantlake.sources import exports

GRANTS = {
    "serviceName": "shop",
    "policies": [
        {
            "id": 7,
            "name": "sales",
            "isDenyAllElse": True,
            "validitySchedules": [{"startTime": "2020"}],
            "resources": {
                "database": {"values": ["s1", "s2"]},
                "table": {"values": ["*", "t1"]},
                "column": {"values": ["c1", "c2"]},
            },
            "policyItems": [
                {
                    "groups": ["a", " "],
                    "users": ["u"],
                    "accesses": [{"type": "select"}, {"type": "read"}, {"type": "odd"}, {"type": "drop", "isAllowed": False}],
                    "delegateAdmin": True,
                },
                {"roles": ["r"], "accesses": [{"type": "create"}]},
            ],
            "denyPolicyItems": [
                {
                    "users": ["u"],
                    "accesses": [{"type": "select"}, {"type": "lock"}],
                    "conditions": [{"type": "accessed-together", "values": ["s1.t1.c1", "s1.t1.x*"]}],
                }
            ],
            "denyExceptions": [{"groups": ["boss"], "users": ["v"]}],
            "rowFilterPolicyItems": [
                {"groups": ["a", "b"], "rowFilterInfo": {"filterExpr": "k = 1"}},
                {"rowFilterInfo": {"filterExpr": "k = ${{USER.k}}"}},
            ],
            "dataMaskPolicyItems": [{"users": ["u"], "dataMaskInfo": {"dataMaskType": "MASK_HASH"}}],
        }
    ],
}
TAGS = {
    "serviceName": "tagged",
    "tagDefinitions": [{"name": "PII", "attributeDefs": {"level": "high"}}, {"name": "X", "attributeDefs": {"level": "low"}}],
    "resourceTags": {"d.t.c1": ["PII", "X"], "d.t.c2": "PII", "d.v": "X", "alone": "X", "a.b.c.d": "X"},
    "policies": [
        {
            "id": 1,
            "name": "p",
            "resources": {"tag": {"values": ["PII", "X"]}},
            "policyItems": [{"groups": ["g"], "accesses": [{"type": "select"}]}],
            "denyPolicyItems": [{"groups": ["g"], "accesses": [{"type": "select"}]}],
            "dataMaskPolicyItems": [{"dataMaskInfo": {}}],
        },
        {
            "id": 2,
            "name": "q",
            "resources": {"tag": {"values": ["NONE"]}},
            "policyItems": [{"groups": ["g"], "users": ["u"], "accesses": [{"type": "drop"}]}],
            "rowFilterPolicyItems": [{"groups": ["g"], "rowFilterInfo": {"filterExpr": "x = 1"}}],
        },
    ],
}
KV = {
    "serviceName": "my_HBASE",
    "policies": [
        {
            "id": 3,
            "name": "kv",
            "resources": {"table": {"values": ["n:t", "n:*", "*", "t"]}, "column-family": {"values": ["f"]}},
            "policyItems": [{"groups": ["g"], "accesses": [{"type": "admin"}, {"type": "all"}]}],
            "denyPolicyItems": [{"groups": ["g"], "accesses": [{"type": "read"}]}],
        }
    ],
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("grants", json.dumps(GRANTS)), ("tags", json.dumps(TAGS)), ("kv", json.dumps(KV)), ("bad", "{oops")]
    return spark.createDataFrame(rows, "export_id string, document string")


@pytest.fixture(scope="module")
def items(documents):
    return stage(items_of_documents(documents))


@pytest.fixture(scope="module")
def policies(documents):
    return exports.policy_rows(exports.open_documents(documents))


def rows_of(items, export, kind):
    return items.filter(f"export_id = '{export}' AND type = '{kind}'").orderBy("seq").collect()


def test_bad_documents_are_set_aside(documents):
    assert [r.export_id for r in exports.invalid_documents(documents).collect()] == ["bad"]


def test_headers(documents):
    got = {r.export_id: r for r in exports.export_headers(exports.open_documents(documents)).collect()}
    assert got["kv"].service_type == "hbase" and got["grants"].service_type == "hive"
    assert got["tags"].total_policies == 2 and got["tags"].cluster_name == "unknown"


def test_grants_number_and_order(items):
    got = rows_of(items, "grants", "grant")
    assert len(got) == 2 * 2 * (2 + 1)
    assert got[0].id == "7-grant-s1-*-a-2" and got[0].table is None
    assert got[0].privileges == ["SELECT", "ODD"] and got[0].columns == ["c1", "c2"]
    assert [r.id for r in got[-2:]] == ["7-grant-s2-*-r-18", "7-grant-s2-t1-r-20"]


def test_blank_items_take_the_first_number(items):
    got = rows_of(items, "grants", "skipped_blank_principal")
    assert [r.id for r in got] == ["7-blank-1", "7-blank-4", "7-blank-7", "7-blank-10"]
    assert got[0].blanks == ["groups[1] is empty"] and got[0].principal is None and got[0].enabled


def test_denies_keep_repeats_and_exceptions(items):
    got = rows_of(items, "grants", "deny")
    assert got[0].privileges == ["SELECT", "SELECT"]
    assert [(e.type, e.name) for e in got[0].deny_exceptions] == [("group", "boss"), ("user", "v")]


def test_rules_keep_star_and_first_principal(items):
    filters = rows_of(items, "grants", "row_filter")
    assert filters[0].table == "*" and filters[0].principal.name == "a" and len(filters[0].all_principals) == 2
    assert filters[-1].principal.name == "ALL" and filters[-1].status == "needs_review"
    assert [r.columns for r in rows_of(items, "grants", "column_mask")[:2]] == [["c1"], ["c2"]]


def test_numbers_do_not_repeat(items):
    assert items.groupBy("export_id", "seq").count().filter("count > 1").isEmpty()


def test_tag_join_keeps_first_resource_of_a_table(items):
    grants = rows_of(items, "tags", "tag_grant")
    assert [(r.schema, r.table) for r in grants] == [("d", "t"), ("d", "v")]
    masks = rows_of(items, "tags", "column_mask")
    assert [r.columns for r in masks] == [["c1"], ["<col_with_PII_X>"]]
    assert masks[0].mask_type == "MASK" and masks[0].principal.name == "ALL"


def test_unresolved_tags_become_placeholders(items):
    assert [r.id for r in rows_of(items, "tags", "tag_placeholder")] == [
        "2-tag_placeholder-g-1", "2-tag_placeholder-u-2",
    ]
    assert rows_of(items, "tags", "row_filter")[0].table == "<table_with_NONE>"
    assert rows_of(items, "tags", "deny") == []


def test_tag_settings_last_write_wins_in_first_order(items):
    got = rows_of(items, "tags", "tag_set")
    assert [r.id for r in got] == ["tag_set_d_t_c1", "tag_set_d_t_c2", "tag_set_d_v_tbl"]
    assert got[0].tag_attrs == {"PII": "true", "level": "low", "X": "true"}


def test_key_value_tables(items):
    got = rows_of(items, "kv", "hbase_grant")
    assert [(r.schema, r.table, r.status) for r in got] == [
        ("n", "t", "pending"), ("n", None, "pending"), ("_all_namespaces", None, "needs_review"), ("default", "t", "pending"),
    ]
    assert got[0].privileges == ["ALL PRIVILEGES"] and got[0].col_families == ["f"]


def test_warnings(policies, items):
    got = [(r.category, r.detail) for r in warnings.all_warnings(policies, items).filter("export_id = 'grants'").orderBy("seq", "warn_pos").collect()]
    assert got[:4] == [
        ("deny_all_else", "everybody not listed is denied"), ("validity_schedule", "2020 → no end"),
        ("conditions", "accessed-together"), ("blank_principal", "groups[1] is empty"),
    ]
    assert sum(c == "deny" for c, _ in got) == 4


def test_gaps_and_score(policies, items):
    summary = gaps.gap_summary(gaps.gap_items(policies, items))
    got = {r.category: r["items"] for r in summary.filter("export_id = 'grants'").collect()}
    assert got["deny"] == 4 and got["filter_untranslatable"] == 4 and got["wildcard_table"] == 6
    assert got["conflict"] == 4 and got["delegate_admin"] == 8
    scores = scoring.readiness(scoring.item_statistics(items), summary).filter("export_id = 'grants'").first()
    base = (scores.total - 4) / scores.total * 100
    assert scores.score == max(0, round(base - 10 * scores.critical - 3 * scores.warning))


def test_order_of_input_does_not_matter(spark, documents, items):
    again = items_of_documents(documents.repartition(3).orderBy("document"))
    key = ["export_id", "seq", "id"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, items.select(key).collect()))


def test_script_merges_in_item_order(items):
    approved = review.approve_valid(items)
    lines = statements.script_lines(approved).filter("export_id = 'grants'").orderBy(*statements.LINE_KEY)
    text = [r.line for r in lines.collect()]
    start = text.index("CREATE OR REPLACE FUNCTION `main`.`s1`.rf_t1(k STRING)")
    assert text[start + 4 : start + 7] == [
        "    WHEN IS_ACCOUNT_GROUP_MEMBER('a') THEN k = 1", "    -- branch left out: ALL: k = ${{USER.k}}", "    ELSE TRUE",
    ]
    assert "GRANT MANAGE ON SCHEMA `main`.`s1` TO `a`;" not in text
    assert any("_deny_u_company_com(val STRING)" in t for t in text)


def test_duplicates_keep_first(spark, items):
    twice = items.unionByName(items.withColumn("seq", items.seq + 1_000_000).withColumn("id", items.id))
    approved = review.approve_valid(twice)
    grants = approved.filter("type = 'grant' AND export_id = 'grants'")
    assert conflicts.duplicate_grants(grants).count() == grants.count() / 2
    assert conflicts.duplicate_grants(grants).filter("seq < 4294967296 + 1000000").isEmpty()


def test_policies_made_row_by_row_are_made_once(spark, tmp_path):
    spark.range(4).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    items = resource_items(bindings.part_policies(spark, str(tmp_path)))
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("isDenyAllElse, ") == 1
    assert {r.policy_id for r in items.collect()} == {0, 1, 2, 3}
