"""Fields of the wrong JSON type: listed, set aside, and never a wider grant."""

import json

import pytest

from grantlake.operators.fact import items_of_documents
from grantlake.sources import exports, mistyped


def policy(**changes):
    item = {"users": ["ana"], "accesses": [{"type": "select", "isAllowed": True}]}
    return {"id": 7, "name": "p", "isEnabled": True, "resources": {"database": {"values": ["s"]}, "table": {"values": ["t"]}}, "policyItems": [item]} | changes


SHAPES = {
    "plain": lambda p: {"serviceName": "w", "policies": [p]},
    "list": lambda p: [p],
    "wrapped": lambda p: {"testCases": [{"servicePolicies": {"policies": [p]}}]},
}
WRONG = [
    (policy(resources={"table": {"values": "t"}}), "policies[0].resources.table.values", "ARRAY", "STRING"),
    (policy(resources={"table": ["t"]}), "policies[0].resources.table", "OBJECT", "ARRAY"),
    (policy(resources="t"), "policies[0].resources", "OBJECT", "STRING"),
    (policy(policyItems=[{"users": "ana", "accesses": []}]), "policies[0].policyItems[0].users", "ARRAY", "STRING"),
    (policy(policyItems=[{}, {"groups": {"g": 1}}]), "policies[0].policyItems[1].groups", "ARRAY", "OBJECT"),
    (policy(policyItems={"users": ["ana"]}), "policies[0].policyItems", "ARRAY", "OBJECT"),
    (policy(policyItems=[{"accesses": [{"type": "select", "isAllowed": "false"}]}]), "policies[0].policyItems[0].accesses[0].isAllowed", "BOOLEAN", "STRING"),
    (policy(denyPolicyItems=["x"]), "policies[0].denyPolicyItems[0]", "OBJECT", "STRING"),
    (policy(id="7"), "policies[0].id", "BIGINT", "STRING"),
    (policy(id=1.5), "policies[0].id", "BIGINT", "DECIMAL"),
    (policy(isEnabled="false"), "policies[0].isEnabled", "BOOLEAN", "STRING"),
    (policy(isEnabled=0), "policies[0].isEnabled", "BOOLEAN", "BIGINT"),
    (policy(name=["p"]), "policies[0].name", "STRING", "ARRAY"),
    (policy(rowFilterPolicyItems=[{"rowFilterInfo": "a = 1"}]), "policies[0].rowFilterPolicyItems[0].rowFilterInfo", "OBJECT", "STRING"),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(f"{shape}-{k}", json.dumps(make(p))) for k, (p, *_) in enumerate(WRONG) for shape, make in SHAPES.items()]
    rows += [(f"{shape}-good", json.dumps(make(policy()))) for shape, make in SHAPES.items()]
    loose = policy(isEnabled=None, resources=None, description=5, denyPolicyItems=None, policyItems=[None, {"users": None, "groups": [3], "accesses": [{"type": "select", "isAllowed": None}]}])
    rows += [("loose", json.dumps({"policies": [loose], "serviceName": None, "unknown": {"x": 1}})), ("empty", "{}"), ("broken", "{"), ("text", '"x"'), ("none", None)]
    return spark.createDataFrame(rows, "export_id string, document string")


def test_every_mistyped_field_is_listed(documents):
    got = {(r.export_id, r.path, r.expected, r.found) for r in mistyped.mistyped_fields(documents).collect()}
    want = {(f"{shape}-{k}", *w) for k, (_, *w) in enumerate(WRONG) for shape in SHAPES}
    assert got == want | {("text", "", "OBJECT", "STRING")}


def test_nothing_is_read_from_such_documents(documents):
    faulty = {f"{shape}-{k}" for k in range(len(WRONG)) for shape in SHAPES} | {"broken", "none", "text"}
    assert {r.export_id for r in exports.invalid_documents(documents).collect()} == faulty
    items = items_of_documents(documents).select("export_id", "table", "principal.name", "privileges").collect()
    assert {r.export_id for r in items} == {"plain-good", "list-good", "wrapped-good", "loose"}
    assert {(r.table, r.name) for r in items if r.export_id.endswith("-good")} == {("t", "ana")}
