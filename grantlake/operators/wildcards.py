"""Joins of name patterns to listings of schemas, tables and columns.

A bare ``name LIKE pattern`` has no join key. Distinct patterns are taken apart by what is fixed in them:

* a fixed start is the key of an equi join with the starts of names. A dictionary has the lengths in
  use per key, and a name offers only starts of those lengths;
* without a fixed start, a fixed end is the key in the same way;
* a pattern with neither must be held against every name of its key: names are dealt to ``RUNS`` runs by a
  hash and meet the pattern run by run.

LIKE then checks the candidates only. Items meet the matches afterwards, by joins that split heavy keys. Patterns,
counts of keys and the join all read the items, so those with a pattern are written once; hand in the columns
that are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import has_wildcard, like_pattern, like_prefix, matches
from .skew import skew_join
from .stage import stage

RUNS = 64


def _fixed_join(wanted: DataFrame, names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, like, name) where the fixed part ``part`` of a pattern is at its ``side`` of the name."""
    ends = F.struct("side", F.length("part").alias("length"))
    if keys:
        lengths = wanted.groupBy(*keys).agg(F.collect_set(ends).alias("ends"))  # at most twice the longest name
        offering = names.join(lengths, keys)
    else:
        offering = names.withColumn("ends", wanted.agg(F.collect_set(ends)).scalar())
    offered = offering.select(*keys, name, F.explode("ends").alias("end")).filter(F.col("end.length") <= F.length(name))
    text, length = F.col(name), F.col("end.length")
    part = F.when(F.col("end.side") == "start", F.left(text, length)).otherwise(F.right(text, length))
    offered = offered.select(*keys, name, F.col("end.side").alias("side"), part.alias("part"))
    return offered.join(wanted, [*keys, "side", "part"]).filter(matches(f"`{name}`", "`like`")).select(*keys, "like", name)


def _loose_join(wanted: DataFrame, names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, like, name) for patterns with nothing fixed at either end, run by run."""
    patterns = wanted.select(*keys, "like", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"))
    dealt = names.withColumn("run", F.pmod(F.xxhash64(name), F.lit(RUNS)).cast("int"))
    return dealt.join(patterns, [*keys, "run"]).filter(matches(f"`{name}`", "`like`")).select(*keys, "like", name)


def pattern_parts(like: Column) -> tuple[Column, Column]:
    """Side and text of the fixed part of a LIKE pattern: its start, else its end, else nothing."""
    start, end = like_prefix(like), F.regexp_extract(like, "[^%_]*$", 0)
    side = F.when(start != "", "start").when(end != "", "end").otherwise("none")
    return side, F.when(start != "", start).otherwise(end)


def match_patterns(patterns: DataFrame, names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, like, name) for every distinct pattern ``like`` and name that match within ``keys``."""
    side, part = pattern_parts(F.col("like"))
    wanted = stage(patterns.select(*keys, "like").distinct().withColumns({"side": side, "part": part}))
    listed = names.select(*keys, name).distinct()
    fixed = _fixed_join(wanted.filter("side <> 'none'"), listed, keys, name)
    return fixed.unionByName(_loose_join(wanted.filter("side = 'none'"), listed, keys, name))


def tables_for_patterns(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Items with a table pattern, once per matching table of their schema (``match``)."""
    rows = stage(items.filter(has_wildcard(F.col("table"))).withColumn("like", like_pattern(F.col("table"))))
    found = match_patterns(rows, tables.select("schema", "table"), ["schema"], "table")
    return skew_join(rows, found.withColumnRenamed("table", "match"), ["schema", "like"], grows=True)


def schemas_for_patterns(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Items with a schema pattern, once per matching schema (``match``)."""
    rows = stage(items.filter(has_wildcard(F.col("schema"))).withColumn("like", like_pattern(F.col("schema"))))
    found = match_patterns(rows, tables.select("schema"), [], "schema")
    return skew_join(rows, found.withColumnRenamed("schema", "match"), ["like"], grows=True)


def tables_of_schema_patterns(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Items with a schema pattern, once per table of each matching schema. Patterns meet schemas and
    tables first, once each; items meet the tables of their pattern in one join."""
    rows = stage(items.filter(has_wildcard(F.col("schema"))).withColumn("like", like_pattern(F.col("schema"))))
    listing = tables.select(F.col("schema").alias("match"), F.col("table").alias("match_table")).distinct()
    found = match_patterns(rows, tables.select("schema"), [], "schema").withColumnRenamed("schema", "match")
    return skew_join(rows, found.join(listing, "match"), ["like"], grows=True)


def tables_of_schemas(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Items on all tables of a schema, once per table (``match``)."""
    listing = tables.select("schema", F.col("table").alias("match")).distinct()
    return skew_join(stage(items.filter(F.col("table").isNull())), listing, ["schema"], grows=True)


def columns_for_patterns(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows with (schema, table, pattern), once per matching column (``match``)."""
    keyed = stage(rows.withColumn("like", like_pattern(F.col("pattern"))))
    found = match_patterns(keyed, columns, ["schema", "table"], "column")
    return skew_join(keyed, found.withColumnRenamed("column", "match"), ["schema", "table", "like"], grows=True).drop("like")
