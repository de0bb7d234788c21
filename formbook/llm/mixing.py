"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source asks for its weight's share of all words. A source cannot give more
than ``max_epochs`` times its own words; what it cannot give is shared among the
others by weight, until nobody is above its cap. Each round clamps at least one
source, and only two numbers per round (words and weight still free) reach the
driver.

A source's target then means so many whole repetitions of each document and, for
the rest, one more repetition of some. Which ones is decided by a seeded order of
the documents (a hash of id and text): going down that order, documents are taken
while the running sum of words stays nearest to what is missing. The running sum
is not computed row by row. The documents of a source fall into hash ranges, about the
square root of their number; sums per range are aggregated before the shuffle, and
only the one range in which the target falls is put in order.

Null or empty text has size 0 and is repeated like any other; a null source is a
source of its own, last in order. Rows equal in source, id and text stand at one
place of the order and are repeated alike. An empty table gives an empty mix. Without a
word in any source all targets are 0. Columns of the input that clash with results
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import new_path

# Hex digits of the hash that give the place in the order: 52 bits, exact in a double.
PLACE_DIGITS = 13


def word_count(text: Column) -> Column:
    """Runs of anything but blanks (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def place(seed: int, doc: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on seed, id and text alone."""
    whole = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, PLACE_DIGITS), 16, 10).cast("long") / F.lit(float(16**PLACE_DIGITS))


def source_weights(sources: DataFrame, source: str, weights: tuple[int, ...]) -> DataFrame:
    """Each source with the weight of its place by code point, null last.

    One row per source: ``sources`` is sorted in ranges, and a row's place is its
    place in the range plus the rows of earlier ranges.
    """
    path = new_path(sources.sparkSession, "mix-sources")
    ranged = sources.repartitionByRange(F.col(source).asc_nulls_last())
    ranged.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = sources.sparkSession.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(F.col(source).asc_nulls_last())
    at = F.row_number().over(inside) - 1
    out = ranged.withColumn("_at", at).join(starts, "_range")
    turn = (F.col("_at") + F.col("_start")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    return out.withColumn("weight", weight.cast("long")).drop("_at", "_start", "_range")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add ``target`` to rows of (source_size, weight)."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()["words"]
    level, clamped = None, F.lit(False)
    while True:
        free = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0)).alias("given"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(clamped, 1)).alias("clamped"),
        ).first()
        if not free["weight"]:
            return sources.withColumn("target", cap.cast("double"))
        words, weight = total - (free["given"] or 0), free["weight"]
        # Whole numbers on both sides: no rounding decides who is above its cap.
        wants = F.col("weight").cast("decimal(38,0)") * F.lit(words).cast("decimal(20,0)")
        above = clamped | (wants > cap.cast("decimal(38,0)") * F.lit(weight).cast("decimal(18,0)"))
        if level == (words, weight):
            share = F.col("weight").cast("double") * float(words) / float(weight)
            return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))
        level, clamped = (words, weight), above


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The columns of ``docs`` and ``size, source_size, target, repeats, taken``.

    ``repeats`` is how often the mix takes the document, at most ``max_epochs``.
    """
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "repeats", "taken")
    base = docs.drop(*added).select(
        "*",
        word_count(F.col(text)).alias("size"),
        place(seed, F.col(doc_id), F.col(text)).alias("_place"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("_source"),
    )
    path = new_path(spark, "mix-sizes")
    base.select("_source", source, "size", "_place").write.parquet(path)
    sizes = spark.read.parquet(path)
    own = sizes.groupBy("_source").agg(
        F.first(source).alias(source), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")
    )
    path = new_path(spark, "mix-targets")
    water_fill(source_weights(own, source, weights), max_epochs).write.parquet(path)
    targets = spark.read.parquet(path).select(
        "_source",
        "source_size",
        "target",
        F.ceil(F.sqrt("_rows")).alias("_ranges"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("_whole"),
    ).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(targets, "_source").withColumn("_range", F.floor(F.col("_place") * F.col("_ranges")))

    # The range in which the rest of a source falls: one row per source and range.
    sums = placed(sizes).groupBy("_source", "_range", "_rest").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest")))
        .groupBy("_source")
        .agg(F.min(F.struct("_range", "_before")).alias("_edge"))
        .select("_source", F.col("_edge._range").alias("_edge"), F.col("_edge._before").alias("_before"))
    )
    # In that range, the words that stand before a place: one row per place.
    inside = (
        placed(sizes).select("_source", "_range", "_place", "size")
        .join(edge, "_source")
        .where(F.col("_range") == F.col("_edge"))
        .groupBy("_source", "_place")
        .agg(F.sum("size").alias("_words"), F.first("_before").alias("_start"))
    )
    running = Window.partitionBy("_source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_words").over(running), F.lit(0)))
    # The last place taken: the nearer of the two that enclose the rest.
    rest = targets.select("_source", "_rest")
    last = (
        inside.join(rest, "_source")
        .where(F.col("_start") + F.col("_words") / 2 <= F.col("_rest"))
        .groupBy("_source")
        .agg(F.max("_place").alias("_last"))
    )
    path = new_path(spark, "mix-edges")
    edge.join(last, "_source", "left").drop("_before").write.parquet(path)
    edges = spark.read.parquet(path)

    more = (F.col("_range") < F.col("_edge")) | (
        (F.col("_range") == F.col("_edge")) & (F.col("_place") <= F.col("_last"))
    )
    return (
        placed(base).join(edges, "_source", "left")
        .withColumn("repeats", F.col("_whole") + F.coalesce(more, F.lit(False)).cast("int"))
        .withColumn("taken", F.col("size") * F.col("repeats"))
        .select(*[c for c in docs.columns if c not in added], *added)
    )


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it; rows with no repetition go."""
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats")))
    return mixed.where("repeats > 0").withColumn("_copy", copies).drop("_copy")
