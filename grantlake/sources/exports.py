"""Policy exports: JSON documents to policy rows, tag rows and tag definitions.

A document is read as one row and taken apart at once; everything after that works on policy
rows ``(export_id, service_type, policy_pos, policy)``, so the size of one export does not decide
the size of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import once

ACCESS = "array<struct<type:string,isAllowed:boolean>>"
CONDITIONS = "array<struct<type:string,values:array<string>>>"
SUB_ITEM = (
    "struct<groups:array<string>,users:array<string>,roles:array<string>,"
    f"accesses:{ACCESS},delegateAdmin:boolean,conditions:{CONDITIONS},"
    "rowFilterInfo:struct<filterExpr:string>,"
    "dataMaskInfo:struct<dataMaskType:string,valueExpr:string,conditionExpr:string>>"
)
RESOURCES = "map<string,struct<values:array<string>,isExcludes:boolean,isRecursive:boolean>>"
POLICY = (
    "struct<id:bigint,name:string,description:string,isEnabled:boolean,isDenyAllElse:boolean,"
    "validitySchedules:array<struct<startTime:string,endTime:string>>,"
    f"resources:{RESOURCES},"
    f"policyItems:array<{SUB_ITEM}>,denyPolicyItems:array<{SUB_ITEM}>,"
    f"denyExceptions:array<{SUB_ITEM}>,"
    f"rowFilterPolicyItems:array<{SUB_ITEM}>,dataMaskPolicyItems:array<{SUB_ITEM}>>"
)
EXPORT = (
    "struct<serviceName:string,serviceType:string,clusterName:string,"
    f"policies:array<{POLICY}>,tagDefinitions:string,resourceTags:map<string,string>>"
)
ROOT = EXPORT.replace(
    "struct<serviceName", f"struct<testCases:array<struct<servicePolicies:{EXPORT}>>,serviceName", 1
)
DEFINITION = "struct<name:string,attributeDefs:map<string,string>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``(export_id, document)``; the file stem names the export."""
    from ..functions.naming import file_stem

    text = spark.read.text(path, wholetext=True)
    return text.select(
        file_stem(F.col("_metadata.file_name")).alias("export_id"), F.col("value").alias("document")
    )


def begins_list(text: Column) -> Column:
    """Whether a JSON text is a list, after any of the four white-space characters of JSON."""
    return text.rlike(r"^[ \t\r\n]*\[")


def fault(document: Column) -> Column:
    """Why a document is set aside: 'not JSON', the number of its mistyped fields, or null."""
    from .mistyped import bound, export_mismatches

    def told(n: Column) -> Column:
        return F.when(n.isNull(), "not JSON").when(n > 0, F.concat(n, F.lit(" mistyped fields")))

    found = export_mismatches(document)
    return bound(bound(found, lambda f: F.when(f.isNotNull(), F.size(f))), told)


def invalid_documents(documents: DataFrame) -> DataFrame:
    """Documents that are set aside, and why. Nothing is read from them, so no lost field widens a grant."""
    return once(documents, fault(F.col("document")), "fault").filter(F.col("fault").isNotNull())


def open_documents(documents: DataFrame) -> DataFrame:
    """Sound documents as ``(export_id, is_array, body)`` with the export wrapper taken off."""
    is_array = begins_list(F.col("document"))
    bare_list = F.from_json(
        F.concat(F.lit('{"policies":'), F.col("document"), F.lit("}")), ROOT
    )
    parsed = once(documents, fault(F.col("document")), "fault").filter(F.col("fault").isNull()).select(
        "export_id",
        is_array.alias("is_array"),
        F.when(is_array, bare_list).otherwise(F.from_json("document", ROOT)).alias("root"),
    )
    wrapped = F.get(F.col("root.testCases"), F.lit(0))["servicePolicies"]
    fields = [f.split(":")[0] for f in _top_fields(EXPORT)]
    plain = F.struct(*[F.col(f"root.{f}").alias(f) for f in fields])
    return parsed.select(
        "export_id",
        "is_array",
        F.when(wrapped.isNotNull(), wrapped).otherwise(plain).alias("body"),
    )


def _top_fields(ddl: str) -> list[str]:
    """Top-level fields of a struct type string."""
    depth, part, out = 0, "", []
    for ch in ddl[len("struct<") : -1]:
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def service_type(explicit: Column, name: Column, first_resources: Column) -> Column:
    """Service type as given, else from the service name or the first policy's resources."""
    lower = F.lower(name)
    named = F.map_keys(first_resources)

    def has(key: str) -> Column:
        return F.coalesce(F.array_contains(named, key), F.lit(False))

    return (
        F.when(F.length(explicit) > 0, F.lower(explicit))
        .when(lower.contains("hdfs") | lower.contains("hadoop") | has("path"), "hdfs")
        .when(lower.contains("hbase") | (has("table") & has("column-family")), "hbase")
        .otherwise("hive")
    )


def export_headers(opened: DataFrame) -> DataFrame:
    """One row per export: service name and type, cluster, number of policies."""
    name = F.coalesce(F.col("body.serviceName"), F.lit("unknown"))
    first = F.get(F.col("body.policies"), F.lit(0))["resources"]
    kind = service_type(F.col("body.serviceType"), name, first)
    return opened.select(
        "export_id",
        name.alias("service_name"),
        F.when(F.col("is_array"), "hive").otherwise(kind).alias("service_type"),
        F.coalesce(F.col("body.clusterName"), F.lit("unknown")).alias("cluster_name"),
        F.coalesce(F.size("body.policies"), F.lit(0)).cast("bigint").alias("total_policies"),
    )


def policy_rows(opened: DataFrame, spread: bool = True) -> DataFrame:
    """Policies of all exports, one row each.

    ``spread`` shuffles the rows evenly before the fan-out, so that one large document does not
    keep its policies in the task that read it.
    """
    name = F.coalesce(F.col("body.serviceName"), F.lit("unknown"))
    first = F.get(F.col("body.policies"), F.lit(0))["resources"]
    kind = F.when(F.col("is_array"), "hive").otherwise(
        service_type(F.col("body.serviceType"), name, first)
    )
    rows = opened.select(
        "export_id",
        kind.alias("service_type"),
        F.posexplode_outer("body.policies").alias("policy_pos", "policy"),
    ).filter(F.col("policy_pos").isNotNull()).withColumn("policy_pos", F.col("policy_pos").cast("bigint"))
    if not spread:
        return rows
    return rows.repartition("export_id", "policy_pos")


def tag_resources(opened: DataFrame) -> DataFrame:
    """Tagged resources: ``(export_id, res_pos, path, schema, table, column, tag_pos, tag)``.

    A tag value is one name or a list of names; paths that are not db.table or db.table.column
    are left out.
    """
    entries = opened.select(
        "export_id", F.posexplode("body.resourceTags").alias("res_pos", "path", "tags")
    )
    return split_tag_resources(entries)


def split_tag_resources(entries: DataFrame) -> DataFrame:
    """``(export_id, res_pos, path, tags)`` with ``tags`` as written to one row per tag."""
    listed = begins_list(F.col("tags"))
    names = F.when(listed, F.from_json("tags", "array<string>")).otherwise(F.array("tags"))
    parts = F.split("path", r"\.")
    return (
        entries.withColumn("parts", parts)
        .filter(F.size("parts").isin(2, 3))
        .select(
            "export_id",
            F.col("res_pos").cast("bigint").alias("res_pos"),
            "path",
            F.get("parts", F.lit(0)).alias("schema"),
            F.get("parts", F.lit(1)).alias("table"),
            F.get("parts", F.lit(2)).alias("column"),
            F.posexplode(names).alias("tag_pos", "tag"),
        )
        .withColumn("tag_pos", F.col("tag_pos").cast("bigint"))
    )


def tag_definitions(opened: DataFrame) -> DataFrame:
    """Attributes of tags: ``(export_id, tag, attr_pos, key, value)``.

    Definitions come as an object keyed by tag or as a list of objects with a name; in a list the
    last one of a name counts.
    """
    raw = F.col("body.tagDefinitions")
    as_list = F.from_json(raw, f"array<{DEFINITION}>")
    as_map = F.from_json(raw, f"map<string,{DEFINITION}>")
    pairs = "array<struct<tag:string,attrs:map<string,string>>>"
    listed = F.transform(
        F.filter(as_list, lambda d: d["name"].isNotNull()),
        lambda d: F.struct(d["name"], d["attributeDefs"]),
    ).cast(pairs)
    keyed = F.transform(
        F.map_entries(as_map),
        lambda e: F.struct(e["key"], e["value"]["attributeDefs"]),
    ).cast(pairs)
    rows = opened.select(
        "export_id",
        F.posexplode(F.when(begins_list(raw), listed).otherwise(keyed)).alias("pos", "d"),
    )
    last = rows.groupBy("export_id", F.col("d.tag").alias("tag")).agg(
        F.max_by("d.attrs", "pos").alias("attrs")
    )
    return last.select(
        "export_id", "tag", F.posexplode("attrs").alias("attr_pos", "key", "value")
    ).withColumn("attr_pos", F.col("attr_pos").cast("bigint"))
