"""Session archives: writing, listing, normalising, restoring, deleting, bundling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import file_stem, slug
from ..functions.principals import PRINCIPAL
from ..functions.rows import once
from ..operators.items import as_items

# Field names of the archive format, nested form and old flat form.
METADATA = (
    "struct<timestamp:string,service_name:string,cluster_name:string,catalog_name:string,"
    "source_file:string,notes:string>"
)
ITEM = (
    "struct<id:string,rangerPolicyId:bigint,rangerPolicyName:string,rangerPolicyDesc:string,type:string,"
    "catalog:string,schema:string,table:string,columns:array<string>,column:string,path:string,"
    "isRecursive:boolean,col_families:array<string>,udf_name:string,tag_names:array<string>,"
    f"tag_attrs:map<string,string>,privileges:array<string>,principal:{PRINCIPAL},"
    f"allPrincipals:array<{PRINCIPAL}>,filterExpr:string,maskType:string,maskExpr:string,"
    "conditions:array<struct<type:string,values:array<string>>>,"
    f"denyExceptions:array<{PRINCIPAL}>,blanks:array<string>,delegateAdmin:boolean,enabled:boolean,status:string>"
)
ARCHIVE = (
    f"struct<metadata:{METADATA},parsed_data:string,policy_items:array<{ITEM}>,identity_map:map<string,string>,"
    "generated_sql:string,timestamp:string,serviceName:string,catalogName:string,clusterName:string,"
    f"serviceType:string,totalRangerPolicies:bigint,policyItems:array<{ITEM}>,identityMap:map<string,string>,"
    "generatedSQL:string,source_file:string,notes:string>"
)
PARSED = (
    "struct<serviceName:string,serviceType:string,clusterName:string,totalRangerPolicies:bigint,"
    "warnings:string,identities:string,kerberosIssues:string>"
)
#: Lists of a parsed export that an archive keeps as they are.
KEPT_LISTS = ["warnings", "identities", "kerberosIssues"]
ITEM_FIELDS = {
    "id": "id", "policy_id": "rangerPolicyId", "policy_name": "rangerPolicyName",
    "policy_desc": "rangerPolicyDesc", "type": "type", "catalog": "catalog", "schema": "schema",
    "table": "table", "columns": "columns", "column": "column", "path": "path",
    "is_recursive": "isRecursive", "col_families": "col_families", "udf_name": "udf_name",
    "tag_names": "tag_names", "tag_attrs": "tag_attrs", "privileges": "privileges",
    "principal": "principal", "all_principals": "allPrincipals", "filter_expr": "filterExpr",
    "mask_type": "maskType", "mask_expr": "maskExpr", "conditions": "conditions",
    "deny_exceptions": "denyExceptions", "blanks": "blanks", "delegate_admin": "delegateAdmin",
    "enabled": "enabled", "status": "status",
}


#: Folder, within a folder of archives, of the tables that ``save_archives`` writes, one per save.
SAVED = "saved"


def _saves(spark: SparkSession, path: str) -> list[str]:
    """Names of the saves in a folder, oldest first."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{SAVED}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(n.removeprefix("save=") for n in names if n.startswith("save="))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives of a folder as (archive, document, size_kb): files as they are, and those that
    ``save_archives`` has written. Of a name that was saved several times the last save counts."""
    files = _archive_files(spark, path)
    saves = _saves(spark, path)
    if not saves:
        return files.drop("in_folder")
    written = spark.read.option("basePath", f"{path}/{SAVED}").schema("archive string, document string, save string").parquet(
        *[f"{path}/{SAVED}/save={n}" for n in saves]
    )
    if len(saves) > 1:
        last = written.groupBy("archive").agg(F.max("save").alias("last"))
        same = written.archive.eqNullSafe(last.archive) & (written.save == last.last)
        written = written.join(last, same, "left_semi")
    # As a text file would have it, with the end of its line.
    size = ((F.octet_length("document") + 1) / 1024).alias("size_kb")
    older = files.join(written.select("archive", F.lit(True).alias("in_folder")), ["archive", "in_folder"], "left_anti")
    return older.select("archive", "document", "size_kb").unionByName(written.select("archive", "document", size))


def _archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder; ``in_folder``: one that a save of an earlier form has put in a folder of its own."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json,txt}")
    saved = F.regexp_extract("_metadata.file_path", "/archive=([^/]*)/[^/]*$", 1)
    # A folder name is escaped once by the writer and once more in the file's address.
    name = F.url_decode(F.url_decode(F.replace(saved, F.lit("+"), F.lit("%2B"))))
    return text.select(
        F.when(saved != "", name).otherwise(F.col("_metadata.file_name")).alias("archive"),
        F.col("value").alias("document"),
        (F.col("_metadata.file_size") / 1024).alias("size_kb"),
        (saved != "").alias("in_folder"),
    )


def normalised(documents: DataFrame) -> DataFrame:
    """Both archive forms as one shape; documents that are no JSON are left out."""
    sound = once(documents, F.try_parse_json("document").isNotNull(), "sound").filter("sound")
    parsed = sound.withColumn("a", F.from_json("document", ARCHIVE))
    nested = F.col("a.metadata").isNotNull() & F.col("a.parsed_data").isNotNull()
    inner = F.from_json("a.parsed_data", PARSED)
    items = F.when(nested, F.col("a.policy_items")).otherwise(F.col("a.policyItems"))
    no_items = F.array().cast(f"array<{ITEM}>")

    def pick(new: Column, old: Column, default: str) -> Column:
        return F.when(nested, new).otherwise(F.coalesce(old, F.lit(default)))

    shaped = parsed.withColumn("inner", inner).select(
        *documents.columns,
        F.when(nested, "nested").otherwise("flat").alias("form"),
        pick(F.col("a.metadata.timestamp"), F.col("a.timestamp"), "").alias("timestamp"),
        pick(F.col("a.metadata.service_name"), F.col("a.serviceName"), "unknown").alias("service_name"),
        pick(F.col("a.metadata.cluster_name"), F.col("a.clusterName"), "unknown").alias("cluster_name"),
        pick(F.col("a.metadata.catalog_name"), F.col("a.catalogName"), "main").alias("catalog_name"),
        pick(F.col("inner.serviceType"), F.col("a.serviceType"), "hive").alias("service_type"),
        F.when(nested, F.col("inner.totalRangerPolicies"))
        .otherwise(F.coalesce("a.totalRangerPolicies", F.coalesce(F.size("a.policyItems"), F.lit(0)).cast("bigint")))
        .alias("total_policies"),
        pick(F.col("a.metadata.source_file"), F.col("a.source_file"), "").alias("source_file"),
        pick(F.col("a.metadata.notes"), F.col("a.notes"), "").alias("notes"),
        F.coalesce(items, no_items).alias("items"),
        F.when(nested, F.col("a.identity_map")).otherwise(F.col("a.identityMap")).alias("identity_map"),
        F.when(nested, F.col("a.generated_sql")).otherwise(F.col("a.generatedSQL")).alias("generated_sql"),
        F.when(nested, F.struct(*[F.col(f"inner.{c}") for c in KEPT_LISTS])).alias("kept_lists"),
    )
    return shaped.drop("document")


def fill_from_files(archives: DataFrame, scripts: DataFrame, sources: DataFrame) -> DataFrame:
    """Complete empty SQL texts and source names from files of the same stem.

    ``scripts`` has (stem, script_sql), ``sources`` has (file_name). Each has one row per name.
    """
    keyed = archives.withColumns(
        {"stem": file_stem(F.col("archive")), "file_name": F.regexp_extract("archive", "[^/]*$", 0)}
    )
    named = sources.select("file_name", F.lit(True).alias("known")).distinct()
    joined = keyed.join(scripts, "stem", "left").join(named, "file_name", "left")
    return joined.withColumns(
        {
            "generated_sql": F.when(F.length("generated_sql") > 0, F.col("generated_sql")).otherwise(
                F.coalesce("script_sql", F.lit(""))
            ),
            "source_file": F.when(F.length("source_file") > 0, F.col("source_file")).otherwise(
                F.when(F.col("known"), F.col("file_name")).otherwise("")
            ),
        }
    ).select(archives.columns)


def archive_items(archives: DataFrame) -> DataFrame:
    """Items of archives as rows, with the archive name as export."""
    rows = archives.select("archive", F.posexplode_outer("items").alias("seq", "i")).filter("seq IS NOT NULL")
    named = rows.select(
        F.col("archive").alias("export_id"),
        F.col("seq").cast("bigint").alias("seq"),
        *[F.col(f"i.{old}").alias(new) for new, old in ITEM_FIELDS.items()],
    )
    return as_items(named)


def archive_maps(archives: DataFrame) -> DataFrame:
    return archives.select("archive", F.explode("identity_map").alias("source", "target"))


def listing(archives: DataFrame) -> DataFrame:
    """Archives by name, newest name first."""
    return archives.select(
        "archive", "timestamp", "service_name", "cluster_name", "catalog_name", "notes", "size_kb",
        F.size("items").cast("bigint").alias("items"),
    ).orderBy(F.col("archive").desc())


def load_archive(archives: DataFrame, name: str) -> DataFrame:
    return archives.filter(F.col("archive") == name)


def delete_archives(archives: DataFrame, names: DataFrame) -> DataFrame:
    """What is left after deleting the named archives (column ``archive``)."""
    return archives.join(names.select("archive").distinct(), "archive", "left_anti")


def archive_name(label: Column, stamp: Column | None = None) -> Column:
    """File name of a new archive: label cut to 80, else service cut to 40, and a time stamp."""
    base = slug(label, 80)
    return F.concat(base, F.lit(".json")) if stamp is None else F.concat(base, F.lit("_"), stamp, F.lit(".json"))


def _kept_lists(sessions: DataFrame) -> list[Column]:
    """The lists of parsed data that are passed on, as JSON values."""
    if "kept_lists" not in sessions.columns:
        return []
    return [F.try_parse_json(F.col(f"kept_lists.{c}")).alias(c) for c in KEPT_LISTS]


def archive_documents(sessions: DataFrame) -> DataFrame:
    """Sessions as archive documents (nested form): (archive, document).

    ``sessions`` has the columns that ``normalised`` returns.
    """
    metadata = F.struct("timestamp", "service_name", "cluster_name", "catalog_name", "source_file", "notes")
    parsed = F.struct(
        F.col("service_name").alias("serviceName"),
        F.col("service_type").alias("serviceType"),
        F.col("cluster_name").alias("clusterName"),
        F.col("total_policies").alias("totalRangerPolicies"),
        F.col("items").alias("results"),
        *_kept_lists(sessions),
    )
    body = F.struct(
        metadata.alias("metadata"),
        parsed.alias("parsed_data"),
        F.col("items").alias("policy_items"),
        "identity_map",
        "generated_sql",
    )
    return sessions.select("archive", F.to_json(body).alias("document"))


def save_archives(sessions: DataFrame, path: str) -> None:
    """Write sessions as archive documents, in place of those of the same name; others stay. An empty
    frame is an error: nothing is loaded.

    A save is one table of (archive, document), named after those before it, so the number of files
    follows the tasks and not the archives. ``read_archives`` takes each name from its last save. A name is
    one archive: of sessions that share it the first by its text is written.
    """
    if sessions.isEmpty():
        raise ValueError("no policies loaded to archive")
    before = _saves(sessions.sparkSession, path)
    number = int(before[-1].split("-")[0]) + 1 if before else 0
    named = archive_documents(sessions).groupBy("archive").agg(F.min("document").alias("document"))
    named.write.parquet(f"{path}/{SAVED}/save={number:09d}-{uuid.uuid4().hex}")


def bundle_parts(archives: DataFrame) -> dict[str, DataFrame]:
    """The five parts of an archive bundle, as (archive, value) frames."""
    metadata = F.struct("timestamp", "service_name", "cluster_name", "catalog_name", "source_file", "notes")
    parsed = F.struct(
        F.col("service_name").alias("serviceName"),
        F.col("service_type").alias("serviceType"),
        F.col("cluster_name").alias("clusterName"),
        F.col("total_policies").alias("totalRangerPolicies"),
        *_kept_lists(archives),
    )
    texts = {
        "metadata": F.to_json(metadata),
        "parsed_data": F.to_json(parsed),
        "policy_items": F.to_json("items"),
        "identity_map": F.to_json("identity_map"),
        "generated_sql": F.coalesce("generated_sql", F.lit("")),
    }
    return {name: archives.select("archive", text.alias("value")) for name, text in texts.items()}


def write_bundle(archives: DataFrame, path: str) -> None:
    """Write each part to its own folder, one sub-folder per archive. Bundles of other archives stay."""
    for name, part in bundle_parts(archives).items():
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive").text(f"{path}/{name}")
