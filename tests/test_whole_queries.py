"""Registered queries that return all of what their operator makes."""

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


def test_advisories_of_the_whole_fleet(spark):
    queries = entry_module.queries()
    rows = {tuple(r) for r in queries["fleet_advisories"](spark, SF).select("export_id", "seq", "code", "detail").collect()}
    some = {tuple(r) for r in queries["advisories"](spark, SF).select("export_id", "seq", "code", "detail").collect()}
    assert some < rows
    kinds = {r.type for r in queries["fleet_advisories"](spark, SF).select("type").distinct().collect()}
    assert kinds - {"deny", "skipped_blank_principal"}


def test_all_parts_of_a_bundle(spark):
    queries = entry_module.queries()
    rows = queries["archive_bundle_parts"](spark, SF).collect()
    assert {r.part for r in rows} == {"metadata", "parsed_data", "policy_items", "identity_map", "generated_sql"}
    assert {tuple(r[c] for c in ("archive", "part", "value")) for r in queries["archive_bundle"](spark, SF).collect()} < {(r.archive, r.part, r.value) for r in rows}
