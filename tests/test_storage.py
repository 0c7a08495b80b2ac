"""Sinks, archives, stages and the stream."""

import json

import pytest

from grantlake.operators.stage import stage
from grantlake.plans import statements
from grantlake.operators import review
from grantlake.operators.fact import items_of_documents
from grantlake.sources import archives, exports, sinks
from grantlake.streaming import ingest
from tests.test_items import GRANTS, KV, TAGS


@pytest.fixture()
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, body in [("one", GRANTS), ("two", TAGS), ("three", KV)]:
        (source / f"{name}.json").write_text(json.dumps(body, indent=1))
    return source


def test_files_to_script(spark, folder, tmp_path):
    documents = exports.read_documents(spark, str(folder))
    items = stage(review.approve_valid(items_of_documents(documents)))
    lines = statements.script_lines(items)
    sinks.write_lines(lines, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == lines.count()
    files = sorted((tmp_path / "out" / "export_id=three").glob("part-*"))
    text = "".join(f.read_text() for f in files).splitlines()
    want = [r.line for r in lines.filter("export_id = 'three'").orderBy(*statements.LINE_KEY, "line").collect()]
    assert text == want


def test_landing_appends(spark, folder, tmp_path):
    documents = exports.read_documents(spark, str(folder))
    for _ in range(2):
        sinks.land_documents(documents.filter("export_id = 'one'"), str(tmp_path / "landing"))
    assert len(list((tmp_path / "landing" / "name=user_one").glob("id=*/part-*"))) == 2


def test_landing_keeps_documents_apart(spark, tmp_path):
    names = ["a b", "a_b", "x" * 90, "x" * 90 + "y"]
    documents = spark.createDataFrame([(n, f"document {k}") for k, n in enumerate(names)], "export_id string, document string")
    sinks.land_documents(documents, str(tmp_path / "landing"))
    folders = [sorted(f.read_text() for f in d.glob("part-*")) for d in (tmp_path / "landing").glob("name=*/id=*")]
    assert len(folders) == 4 and all(len(f) == 1 for f in folders)


def test_lists_after_white_space_are_read(spark):
    documents = spark.createDataFrame([("n", "\n\t [" + json.dumps(GRANTS["policies"][0]) + "]")], "export_id string, document string")
    headers = exports.export_headers(exports.open_documents(documents)).first()
    assert headers.total_policies == 1 and headers.service_type == "hive"


def test_last_decision_counts(spark, folder):
    items = stage(items_of_documents(exports.read_documents(spark, str(folder))))
    one = items.first()
    decisions = spark.createDataFrame([(one.export_id, one.id, s, k) for k, s in ((2, "rejected"), (3, "approved"), (1, "needs_review"))], "export_id string, id string, status string, order int")
    assert review.decide(items, decisions).filter((items.export_id == one.export_id) & (items.id == one.id)).orderBy("seq").first().status == "approved"


def test_archives_round_trip(spark, tmp_path):
    rows = [
        ("a.json", json.dumps({"metadata": {"service_name": "s"}, "parsed_data": {"serviceType": "hdfs", "warnings": [{"code": "w"}], "identities": ["i"]}, "policy_items": [{"id": "1", "type": "grant"}], "identity_map": {"x": "y"}})),
        ("b.json", json.dumps({"serviceName": "old", "policyItems": [{"id": "1", "type": "deny"}, {"id": "2", "type": "deny"}]})),
        ("c.json", "not json"),
    ]
    documents = spark.createDataFrame(rows, "archive string, document string")
    shaped = archives.normalised(documents)
    assert {(r.archive, r.form, len(r["items"])) for r in shaped.collect()} == {("a.json", "nested", 1), ("b.json", "flat", 2)}
    archives.save_archives(shaped, str(tmp_path / "arch"))
    archives.save_archives(shaped.filter("archive = 'b.json'"), str(tmp_path / "arch"))  # replaces b, leaves a
    again = stage(archives.normalised(archives.read_archives(spark, str(tmp_path / "arch"))))
    lists = again.filter("archive = 'a.json'").first().kept_lists
    assert json.loads(lists.warnings) == [{"code": "w"}] and json.loads(lists.identities) == ["i"] and lists.kerberosIssues is None
    assert {(r.archive, r.service_name, len(r["items"])) for r in again.collect()} == {("a.json", "s", 1), ("b.json", "old", 2)}
    left = archives.delete_archives(again, again.filter("archive = 'a.json'"))
    assert [r.archive for r in left.collect()] == ["b.json"]
    for name in ("a.json", "b.json"):
        archives.write_bundle(again.filter(again.archive == name), str(tmp_path / "bundle"))
    parts = list((tmp_path / "bundle").iterdir())
    assert len(parts) == 5 and all(len(list(p.glob("archive=*"))) == 2 for p in parts)


def test_saving_nothing_is_an_error(spark):
    documents = spark.createDataFrame([], "archive string, document string")
    with pytest.raises(ValueError):
        archives.save_archives(archives.normalised(documents), "/nowhere")


def test_files_are_listed_newest_first(spark, tmp_path):
    for name in ("a_20240101_000000.json", "b_20240101_000000.json"):
        (tmp_path / name).write_text(json.dumps({"serviceName": name}))
    found = archives.listing(archives.normalised(archives.read_archives(spark, str(tmp_path)))).collect()
    assert [r.archive[0] for r in found] == ["b", "a"] and found[0].size_kb > 0


def test_stream_equals_batch(spark, folder, tmp_path):
    query = ingest.append_items(
        ingest.stream_documents(spark, str(folder)), str(tmp_path / "items"), str(tmp_path / "check")
    )
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "items" / "batch=*")).select("export_id", "seq", "id")
    batch = items_of_documents(exports.read_documents(spark, str(folder))).select("export_id", "seq", "id")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
