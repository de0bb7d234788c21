"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.session import new_path


# Whether a query's shuffle files go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage.

    With ``drop_shuffles`` the shuffle files of the write go as soon as it ends, so
    ``df`` itself should not be run again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    if drop_shuffles:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of ``links`` (a, b): the smallest node that links reach.

    Each round gives every node the smallest node among itself and its neighbours,
    follows that pointer once more, and replaces the ends of each link by where they
    point; links within one node go. The smallest node of a component never moves,
    all others end there. Stars, which the callers hand over, take a round or two;
    long chains shrink by a constant factor per round. Every round is a written
    table, so a lost executor costs one round.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    moved = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        to = stored(to, "pointers")
        further = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
        to = stored(to.join(further, "to").select("node", F.col("further").alias("root")), "pointers")
        if moved is None:
            moved = to
        else:
            then = to.select(F.col("node").alias("root"), F.col("root").alias("then"))
            moved = moved.join(then, "root", "left").select("node", F.coalesce("then", "root").alias("root"))
        moved = stored(moved, "roots")
        left = to.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        right = to.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        ends = links.join(left, "a").join(right, "b").where("_a <> _b")
        links = stored(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    if moved is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return moved


def forest(left: np.ndarray, right: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Of links between numbers below ``size``, enough to connect what they connect:
    for each group, every other member with the smallest."""
    root = np.arange(size)
    if len(left):
        while True:
            a, b = root[left], root[right]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return [(int(r), i) for i, r in enumerate(root) if r != i]
