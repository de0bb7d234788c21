"""Split groups give the same rows as plain windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from formbook.operators.frames import Prior, prior_frames
from formbook.operators.hot import PART, average_rank, rank_within, split_hot, with_prefix


def _rows(spark, n=400):
    # Key 0 holds about half of all rows; values repeat, one value very often.
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 9).alias("k"),
        F.col("id").alias("i"),
        (F.xxhash64("id") % 7).alias("v"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.abs(F.xxhash64("id")) % 50).alias("w"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 11).cast("double")).alias("x"),
    )


def _same(a, b, *cols):
    left = sorted(map(str, a.select(*cols).collect()))
    right = sorted(map(str, b.select(*cols).collect()))
    assert left == right


def test_rank_within_split_equals_row_number(spark, cut_small):
    df = _rows(spark)
    order = Window.partitionBy("k").orderBy(F.col("w").desc(), "i")
    want = df.withColumn("r", F.row_number().over(order))
    got = rank_within(df, ["k"], [("w", False), ("i", True)], "r")
    _same(got, want, "k", "i", "r")


def test_hot_group_is_divided_even_when_all_values_tie(spark, cut_small):
    df = _rows(spark).withColumn("w", F.lit(1))
    parts = split_hot(df, ["k"], [("w", True), ("i", True)]).where("k = 0")
    sizes = [r["count"] for r in parts.groupBy(PART).count().collect()]
    assert max(sizes) <= 6
    got = rank_within(df, ["k"], [("w", True), ("i", True)], "r")
    order = Window.partitionBy("k").orderBy("i")
    _same(got, df.withColumn("r", F.row_number().over(order)), "k", "i", "r")


def test_rank_without_key(spark, cut_small):
    df = _rows(spark, 100)
    got = rank_within(df, [], [("i", False)], "r")
    assert {r["i"]: r["r"] for r in got.collect()} == {i: 100 - i for i in range(100)}


def test_prefix_sums(spark, cut_small):
    df = _rows(spark)
    order = Window.partitionBy("k").orderBy("i")
    want = df.withColumn(
        "s", F.coalesce(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    got = with_prefix(df, ["k"], [("i", True)], {"s": F.col("v")}, inclusive=False)
    _same(got, want, "k", "i", "s")


def test_average_rank(spark, cut_small):
    df = _rows(spark)
    order = Window.partitionBy("k").orderBy("w")
    ties = F.count(F.lit(1)).over(Window.partitionBy("k", "w"))
    want = df.withColumn("r", F.rank().over(order) + (ties - 1) / 2)
    _same(average_rank(df, ["k"], "w", "r"), want, "k", "i", "r")


def _frames():
    return [
        Prior("s3", F.col("x"), "sum", 3),
        Prior("a5", F.col("x"), "avg", 5),
        Prior("c10", F.col("v"), "count", 10),
        Prior("a10", F.col("v"), "avg", 10),
        Prior("all_sum", F.col("x"), "sum"),
        Prior("all_avg", F.col("x"), "avg"),
        Prior("all_count", F.col("x"), "count"),
    ]


def test_prior_frames_split_equals_plain(spark):
    df = _rows(spark)
    frames = _frames()
    outs = [f.out for f in frames]
    rounded = [F.round(F.col(o).cast("double"), 9).alias(o) for o in outs]
    order = [("w", True), ("i", True)]
    plain = prior_frames(df, ["k"], order, frames).select("k", "i", *rounded).collect()
    try:
        spark.conf.set("spark.formbook.hotGroupRows", "3")
        spark.conf.set("spark.formbook.hotGroupSplits", "16")
        split = prior_frames(df, ["k"], order, frames).select("k", "i", *rounded).collect()
    finally:
        spark.conf.unset("spark.formbook.hotGroupRows")
        spark.conf.unset("spark.formbook.hotGroupSplits")
    assert sorted(map(str, plain)) == sorted(map(str, split))


def test_first_row_has_no_frame(spark):
    rows = spark.createDataFrame([(1, i, 1.0) for i in range(1, 5)], "k int, i int, win double")
    got = prior_frames(rows, ["k"], [("i", True)], [Prior("w3", F.col("win"), "sum", 3)])
    assert [r["w3"] for r in got.orderBy("i").collect()] == [None, 1.0, 2.0, 3.0]


def test_parts_follow_the_size_of_the_group(spark, cut_small):
    df = spark.range(30_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.xxhash64("id").alias("v"))
    try:
        spark.conf.set("spark.formbook.hotGroupSplits", "64")
        for limit in (3_000, 10):
            spark.conf.set("spark.formbook.hotGroupRows", str(limit))
            parts = split_hot(df, ["k"], [("v", True), ("i", True)]).groupBy(PART)
            sizes = parts.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
            rows = sorted(tuple(r) for r in sizes.collect())
            assert max(r[1] for r in rows) <= 2 * limit and sum(r[1] for r in rows) == 30_000
            assert all(x[3] <= y[2] for x, y in zip(rows, rows[1:]))
    finally:
        spark.conf.set("spark.formbook.hotGroupRows", "3")


def test_order_of_text_only_is_cut_too(spark, cut_small):
    df = spark.range(200).select(F.lit(1).alias("k"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    got = rank_within(df, ["k"], [("t", False)], "r")
    names = sorted((f"t{i}" for i in range(200)), reverse=True)
    assert {r["t"]: r["r"] for r in got.collect()} == {n: i + 1 for i, n in enumerate(names)}
