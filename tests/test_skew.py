"""Heavy-key joins, pattern joins and privilege masks against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from grantlake.functions import naming
from grantlake.operators import grants, skew, wildcards


def sizes(df):
    """Rows per task, without the coalescing of small partitions."""
    return sorted(n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n)


@pytest.fixture
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_key_at_half_of_all_rows(spark, many_parts):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"))
    others = rows.select("k").distinct().withColumn("v", F.length("k"))
    plain, split = rows.join(others, "k"), skew.skew_join(rows, others, ["k"])
    assert split.count() == 60_000 and split.exceptAll(plain.select(split.columns)).count() == 0
    by_task, before = sizes(split), sizes(plain)
    assert before[-1] > 8 * before[len(before) // 2]
    assert by_task[-1] < 3 * by_task[len(by_task) // 2]


def test_heavy_keys_are_bounded_and_need_no_size(spark):
    rows = spark.range(2000).select((F.col("id") % 7).alias("k"))
    assert skew.heavy_keys(rows, ["k"], parts=7).count() == 5  # 286 of 2000 is more than a seventh, 285 is not
    assert skew.heavy_keys(rows, ["k"], parts=512).count() == 7
    assert skew.heavy_keys(rows.limit(0), ["k"]).count() == 0


def test_null_keys_and_left_joins(spark):
    rows = spark.createDataFrame([(k, None) for k in range(200)] + [(300, "a"), (301, "b")], "id long, k string")
    others = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert sorted((r.id, r.v) for r in skew.skew_join(rows, others, ["k"]).collect()) == [(300, 1), (300, 2)]
    left = skew.skew_join(rows, others, ["k"], "left").collect()
    assert len(left) == 203 and sum(r.v is None for r in left) == 201


@pytest.mark.parametrize("keys", [[], ["schema"]])
def test_patterns_without_a_fixed_start(spark, keys):
    """Half of the patterns begin with a wildcard: they meet names by their fixed end, or run by run."""
    globs = [f"*_{k}" for k in range(20)] + [f"t{k}*" for k in range(16)] + ["*", "?", "*1*", "?_?"]
    names = [f"t{k}_{k % 23}" for k in range(300)] + ["a", "", "x_y"]
    patterns = spark.createDataFrame([("s", g) for g in globs], "schema string, glob string").select("schema", naming.like_pattern(F.col("glob")).alias("like"))
    listed = spark.createDataFrame([("s", n) for n in names] + [("other", "t1_1")], "schema string, table string")
    found = wildcards.match_patterns(patterns.select(*keys, "like"), listed.where("schema = 's'").select(*keys, "table"), keys, "table")

    def like(g):
        return re.compile("".join(".*" if c in "*%" else "." if c in "?_" else re.escape(c) for c in g), re.S)

    want = {(g.translate(str.maketrans("*?", "%_")), n) for g in globs for n in names if like(g).fullmatch(n)}
    got = [(r.like, r.table) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_pattern_has_an_empty_key(spark):
    side, part = wildcards.pattern_parts(F.col("like"))
    rows = spark.createDataFrame([("%x",), ("a%",), ("%",), ("_b_",), ("ab",), ("",)], "like string").select("like", side.alias("side"), part.alias("part")).collect()
    assert {r.like: (r.side, r.part) for r in rows if r.side != "none"} == {"%x": ("end", "x"), "a%": ("start", "a"), "ab": ("start", "ab")}
    assert {r.like for r in rows if r.side == "none"} == {"%", "_b_", ""}


def test_masks_translate_as_names_do(spark):
    one = spark.createDataFrame([(p,) for p in grants.PRIVILEGES], "p string")
    mask = grants.privilege_mask(F.array("p"))
    for on_table in (True, False):
        named = F.coalesce(grants.privilege_mask(F.array_compact(F.array(naming.target_privilege(F.col("p"), F.lit(on_table))))), F.lit(0))
        rows = one.select("p", grants.translated_mask(mask, on_table).alias("got"), named.alias("want")).collect()
        assert [(r.p, r.got) for r in rows] == [(r.p, r.want) for r in rows]


def test_rows_that_meet_many_others_stay_dealt(spark):
    """Spark would merge the small partitions before the join makes them large."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        rows = spark.range(600).selectExpr("id", "'hot' AS k")
        others = spark.range(200).selectExpr("'hot' AS k", "id AS v")
        found = skew.skew_join(rows, others, ["k"], grows=True)
        by_task = sizes(found)
        assert sum(by_task) == 120_000 and found.distinct().count() == 120_000
        assert len(by_task) > 8 and by_task[-1] < 120_000 / 4
    finally:
        spark.conf.set(key, old)
