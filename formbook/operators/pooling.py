"""Pooling of adjacent violators over range partitions.

The rising step function nearest to weighted means is found by pooling neighbours that
fall, in any order. So each range of scores pools its own rows on a stack and hands on
the blocks that are left; ranges are then joined to fewer and pooled again, until no two
neighbours fall. Blocks shrink from round to round, a range is streamed, and no task or
driver holds more than the blocks of one range.

There is no expression for a stack, so this is a function over Arrow batches: one pass
per round, its work one step per block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import new_path

BLOCK = "lo double, hi double, total double, weight double"
# Blocks that a range is meant to hold.
RANGE_BLOCKS = 1 << 18


def _stacked(blocks: DataFrame) -> DataFrame:
    """Blocks pooled within each partition of sorted rows."""

    def run(batches):
        stack: list[list[float]] = []
        for batch in batches:
            for lo, hi, total, weight in zip(*(c.to_pylist() for c in batch.columns)):
                block = [lo, hi, total, weight]
                # Means compared as products: total / weight, never falling.
                while stack and stack[-1][2] * block[3] >= block[2] * stack[-1][3]:
                    low = stack.pop()
                    block = [low[0], block[1], low[2] + block[2], low[3] + block[3]]
                stack.append(block)
        columns = [pa.array(c, pa.float64()) for c in zip(*stack)] or [pa.array([], pa.float64())] * 4
        yield pa.RecordBatch.from_arrays(columns, ["lo", "hi", "total", "weight"])

    return blocks.mapInArrow(run, BLOCK)


def pooled_blocks(rows: DataFrame, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """(lo, hi, total, weight) blocks with rising means from rows of the same shape, whose
    [lo, hi] do not overlap. A stored table; each round reads the one before."""
    spark = rows.sparkSession
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in ("lo", "hi", "total", "weight")])
    path = new_path(spark, "scores")
    rows.write.parquet(path)
    blocks = spark.read.parquet(path)
    left = blocks.count()
    while True:
        ranges = max(1, -(-left // range_blocks))
        ranged = blocks.repartitionByRange(ranges, "lo").sortWithinPartitions("lo")
        path = new_path(spark, "blocks")
        _stacked(ranged).withColumn("_range", F.spark_partition_id()).write.parquet(path)
        made = spark.read.parquet(path)
        blocks = made.drop("_range")
        now = blocks.count()
        if ranges == 1 or not _falls(made):
            return blocks
        # Ranges that lose no block to pooling are joined to larger ones.
        if now == left:
            range_blocks *= 2
        left = now


def _falls(blocks: DataFrame) -> bool:
    """Does a range begin no higher than the one before it ends? One row per range."""
    mean = F.col("total") / F.col("weight")
    edges = blocks.groupBy("_range").agg(F.min_by(mean, "lo").alias("_first"), F.max_by(mean, "lo").alias("_last"))
    before = F.lag("_last").over(Window.orderBy("_range"))
    return not edges.withColumn("_before", before).where("_before >= _first").isEmpty()
