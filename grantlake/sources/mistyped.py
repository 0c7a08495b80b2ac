"""Fields of export documents whose JSON type is not that of the policy model.

A field that is read with the wrong type would be lost, and a lost field often means the default: a table
list that is a text would become every table, a user that is a text nobody, ``"isEnabled": "false"`` would be
enabled. So documents are held against the model before anything is read from them: as variants, level by
level, in one expression per document. Null and absent fields are no mismatch, they have defaults by design;
fields that are text in the model may hold any scalar, as that loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, LongType, MapType, StructType

from ..functions.rows import unnest
from .exports import EXPORT, begins_list

MISMATCH = "array<struct<path:string,expected:string,found:string>>"
#: Fields that hold any JSON, and one that is an object of any values; they are taken apart elsewhere.
FREE, OBJECT_OF_ANY = {"tagDefinitions"}, {"resourceTags"}


def _found(value: Column) -> Column:
    """Kind of a variant: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, DOUBLE, DECIMAL."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _wrong(path: Column, expected: str, value: Column) -> Column:
    return F.array(F.struct(path, F.lit(expected), _found(value))).cast(MISMATCH)


def _none() -> Column:
    return F.array().cast(MISMATCH)


def _under(path: Column, name: str) -> Column:
    return F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _of_kind(kind: DataType):
    return lambda e: mismatches(e["v"], kind, e["p"])


def mismatches(value: Column, kind: DataType, path: Column) -> Column:
    """Mistyped fields of a variant against a type of the model, at any depth. ``value`` and ``path`` are named
    several times, so they should be bound."""
    absent = value.isNull() | F.is_variant_null(value)
    if isinstance(kind, StructType):
        fields = [(f.name, StructType() if f.name in OBJECT_OF_ANY else f.dataType) for f in kind if f.name not in FREE]
        pairs = [F.struct(F.try_variant_get(value, F.lit(f"$.{n}"), "variant").alias("v"), _under(path, n).alias("p")) for n, _ in fields]
        parts = [bound(pair, _of_kind(t)) for pair, (_, t) in zip(pairs, fields)]
        return F.when(absent, _none()).when(_found(value) != "OBJECT", _wrong(path, "OBJECT", value)).otherwise(F.concat(_none(), *parts))
    if isinstance(kind, (ArrayType, MapType)):
        as_list = isinstance(kind, ArrayType)
        inner_kind = kind.elementType if as_list else kind.valueType

        def inner(members: Column) -> Column:
            if as_list:
                made = F.transform(members, lambda x, i: F.struct(x.alias("v"), F.concat(path, F.lit("["), i, F.lit("]")).alias("p")))
            else:
                made = F.transform(F.map_entries(members), lambda e: F.struct(e["value"].alias("v"), F.concat(path, F.lit("."), e["key"]).alias("p")))
            found = F.flatten(F.transform(made, lambda e: mismatches(e["v"], inner_kind, e["p"])))
            return F.when(members.isNull(), _wrong(path, "ARRAY" if as_list else "OBJECT", value)).otherwise(found)

        members = F.try_variant_get(value, F.lit("$"), "array<variant>" if as_list else "map<string,variant>")
        return F.when(absent, _none()).otherwise(bound(members, inner))
    expected = {LongType: "BIGINT", BooleanType: "BOOLEAN"}.get(type(kind))
    if expected:
        return F.when(absent | (_found(value) == expected), _none()).otherwise(_wrong(path, expected, value))
    return F.when(absent | ~_found(value).isin("OBJECT", "ARRAY"), _none()).otherwise(_wrong(path, "STRING", value))


def export_mismatches(document: Column) -> Column:
    """Mistyped fields of a document in any accepted shape, null if it is no JSON; paths start at the
    export itself."""
    text = F.when(begins_list(document), F.concat(F.lit('{"policies":'), document, F.lit("}"))).otherwise(document)
    kind = DataType.fromDDL(EXPORT)

    def of(whole: Column) -> Column:
        body = F.coalesce(F.try_variant_get(whole, F.lit("$.testCases[0].servicePolicies"), "variant"), whole)
        return F.when(whole.isNotNull(), bound(body, lambda v: mismatches(v, kind, F.lit(""))))

    return bound(F.try_parse_json(text), of)


def mistyped_fields(documents: DataFrame) -> DataFrame:
    """(export_id, path, expected, found) of every mistyped field of documents that are JSON."""
    rows = unnest(documents, export_mismatches(F.col("document")), "m", keep=["export_id"])
    return rows.select("export_id", "m.*")
