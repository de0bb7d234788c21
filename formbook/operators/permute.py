"""Row numbers without an order, and keyed permutations of them."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.session import new_path

ROUNDS = 32

# Tasks are sent what they need of this module: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def numbered(df: DataFrame, out: str = "_at") -> tuple[DataFrame, int]:
    """``df`` written with numbers 0, 1, ... in no defined order, and their count.

    Nothing is sorted: a row's number is its place in its task plus the rows of earlier
    tasks. The table is written, so a repeated task cannot number its rows anew.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "numbered")
    df.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_task", F.shiftright("_id", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task that wrote.
    tasks = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    starts = tasks.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out_rows = rows.join(F.broadcast(starts), "_task").withColumn(out, place).drop("_task", "_start", "_id")
    return out_rows, tasks.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def permuted(at: Column, n: int, key: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """The image of ``at`` under a permutation of 0 .. n - 1 that ``key``, a whole number, names.

    Each round pairs every number with its mirror image at a keyed place and swaps the
    pairs that a hash of their larger number chooses. A round undoes itself, so all of
    them together are a bijection for any ``n``, and need no table. Rounds run over Arrow
    batches: an expression has no loop but one that is interpreted row by row.
    """
    size = max(n, 1)

    def run(places: pa.Array, keys: pa.Array) -> pa.Array:
        x, names = places.to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False)
        out = np.empty(len(x), dtype=np.int64)
        for name in np.unique(names):
            mine = names == name
            here = x[mine].astype(np.int64)
            for k in range(1, rounds + 1):
                turn = _hashed(np.int32(k), _hashed(name, _hashed(np.int32(seed), START)))
                mirror = int(turn.astype(np.int64)) % size
                other = (mirror - here) % size
                state = _hashed(name, _hashed(np.int32(seed), _hashed(np.int32(k), START)))
                chosen = _hashed(np.maximum(here, other), state) & np.uint64(1)
                here = np.where(chosen == 1, other, here)
            out[mine] = here
        return pa.array(out)

    return F.arrow_udf(run, "long")(at.cast("long"), key.cast("long"))


# Spark's xxhash64 of whole numbers, one after another from this seed.
START = np.uint64(42)
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hashed(value: np.ndarray, state: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        if value.dtype == np.int32:
            low = value.astype(np.uint32).astype(np.uint64)
            h = _turned((state + _P5 + np.uint64(4)) ^ (low * _P1), 23) * _P2 + _P3
        else:
            h = _turned((state + _P5 + np.uint64(8)) ^ (_turned(value.astype(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
