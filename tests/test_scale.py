"""Work is spread, and done once, whatever the layout of the tables."""

import json

import pytest
from pyspark.sql import functions as F

from grantlake.operators import wildcards
from grantlake.plans import bindings, load_queries
from grantlake.sources import archives


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One file of one row group per table, as the given tables have."""
    folder = str(tmp_path_factory.mktemp("tables"))
    keys = spark.range(400).coalesce(1)
    made = {
        "customer": ["id AS c_custkey", "concat('Customer#', id) AS c_name"],
        "supplier": ["id AS s_suppkey"],
        "part": ["id AS p_partkey"],
        "pages": ["id AS page_id", "concat('https://a.org/', id, '/x') AS url"],
        "orders": ["id AS o_orderkey", "id % 50 AS o_custkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority"],
    }
    for name, columns in made.items():
        keys.selectExpr(*columns).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["order_policies", "page_policies", "part_policies", "supplier_policies", "tag_policies", "export_documents", "archive_documents"])
def test_a_table_in_one_file_grows_in_several_tasks(spark, tables, name):
    made = getattr(bindings, name)(spark, tables).select(F.spark_partition_id().alias("task"))
    assert made.count() == 400 and made.distinct().count() > 1


@pytest.mark.parametrize("name", ["archive_round_trip", "archive_items"])
def test_documents_are_not_read_again_by_filters(spark, tables, name):
    """A filter that is pushed below a reading repeats it."""
    filters = [x for x in plan(load_queries()[0][name](spark, tables)).splitlines() if "Filter " in x]
    assert not [x for x in filters if "json" in x or "variant" in x]


def test_archives_are_saved_in_few_files(spark, tmp_path):
    rows = [(f"a {k}%.json", json.dumps({"serviceName": f"s{k}", "policyItems": []})) for k in range(300)]
    rows += [("twice.json", json.dumps({"serviceName": "x"}))] * 2
    shaped = archives.normalised(spark.createDataFrame(rows, "archive string, document string").coalesce(2))
    path = str(tmp_path / "arch")
    archives.save_archives(shaped, path)
    archives.save_archives(shaped.filter("archive = 'a 7%.json'").withColumn("service_name", F.lit("new")), path)
    assert len(list((tmp_path / "arch").rglob("*.parquet"))) <= 4
    found = archives.listing(archives.normalised(archives.read_archives(spark, path))).collect()
    assert sorted(r.archive for r in found) == sorted({n for n, _ in rows})
    assert {r.service_name for r in found if r.archive == "a 7%.json"} == {"new"} and all(r.size_kb > 0 for r in found)


def test_saves_of_the_earlier_form_are_replaced(spark, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / f"archive={name}").mkdir()
        (tmp_path / f"archive={name}" / "part-0.txt").write_text(json.dumps({"serviceName": "old"}) + "\n")
    (tmp_path / "a.json").write_text(json.dumps({"serviceName": "file"}))
    new = spark.createDataFrame([("a.json", json.dumps({"serviceName": "new"}))], "archive string, document string")
    archives.save_archives(archives.normalised(new), str(tmp_path))
    found = archives.normalised(archives.read_archives(spark, str(tmp_path))).select("archive", "service_name").collect()
    assert sorted(map(tuple, found)) == [("a.json", "file"), ("a.json", "new"), ("b.json", "old")]


@pytest.mark.parametrize("how", [wildcards.tables_for_patterns, wildcards.schemas_for_patterns, wildcards.tables_of_schema_patterns, wildcards.tables_of_schemas])
def test_items_are_read_once_by_pattern_joins(spark, how):
    read = spark.sparkContext.accumulator(0)
    rows = [("e", k, ["s*", "s"][k % 2], ["t*", None][k // 2 % 2]) for k in range(40)]

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    items = spark.createDataFrame(rows, "export_id string, seq int, schema string, table string").mapInArrow(count, "export_id string, seq int, schema string, table string")
    listing = spark.createDataFrame([("s", "t1"), ("s", "t2")], "schema string, table string")
    assert how(items, listing).count() > 0 and read.value == 40


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_policy_gaps_read_policies_once(spark):
    """Warnings and service accounts come out of one pass over the policies."""
    from grantlake.operators import gaps
    from grantlake.plans import bindings as B

    policies = B.order_policies(spark, "/root/testdata/sf0.001")
    assert scans(gaps.policy_gaps(policies)) == scans(policies)


def test_column_pattern_items_give_all_lines(spark):
    """Only grants and denies with a column pattern are kept, and the lines are those of all items."""
    from grantlake.operators.items import resource_items
    from grantlake.operators.review import approve_valid
    from grantlake.operators.stage import stage
    from grantlake.plans import bindings as B, statements

    sf = "/root/testdata/sf0.001"
    every = stage(approve_valid(resource_items(B.order_policies(spark, sf))))
    few = stage(statements.column_pattern_items(every))
    assert 0 < few.count() < every.count() / 5
    lines = [sorted(map(tuple, statements.column_pattern_lines(x, B.target_columns(spark, sf)).collect())) for x in (every, few)]
    assert lines[0] and lines[0] == lines[1]
