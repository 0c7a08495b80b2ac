"""A repeated query id with an unusable row keeps its usable one."""

from grantlake.llm import neighbours, products

NAN = float("nan")


def test_usable_row_is_the_query(spark):
    rows = [(0, [1.0, 2.0]), (0, [None, 9.0]), (0, [NAN, 1.0]), (0, None), (0, []), (1, [2.0, 1.0]), (2, [-1.0, 0.5]), (3, [0.0, 0.0])]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vecs.where("vec_id = 0")
    got = products.largest_products(vecs, asked, k=5, scale=64.0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 16384), (2, 2, 0), (3, 3, 0)]
    near = neighbours.nearest(vecs, asked, k=5).collect()
    assert [r.vec_id for r in sorted(near, key=lambda r: r.rank)] == [1, 2]


def test_zero_row_does_not_hide_a_query(spark):
    vecs = spark.createDataFrame([(0, [0.0, 0.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.nearest(vecs, vecs.where("vec_id = 0"), k=5).collect()] == [1]
