"""Centroid clustering of whole-number vectors by scalar lookup tables.

Components become whole numbers, so a squared difference of a component and a centroid's
component takes few different values. Per batch of vectors and dimension the values that
occur are found, their squared difference to every centroid is tabulated, and distances
are gathered from these tables and added up: no difference is computed per vector, and
all sums are exact. The tables of a batch have at most as many rows as the batch.

Centroids start as the vectors with the smallest seeded hashes of their ids. A round
assigns every vector to the nearest centroid (ties: the smaller number) and replaces each
centroid that got any by the floor of its vectors' mean. A task hands on one sum per
centroid it met; these are added by Spark per centroid and dimension, and only that
table, whose size depends on neither rows nor tasks, reaches the driver. The vectors are
written once, packed, and read in each round; a lost executor costs a re-read.

Vectors that are null, of another length, or hold null or non-finite components have no
row in the result. Rows that repeat an id or a vector each take part; among equal ids the
smaller vector starts first. A null id is hashed as an empty one. With fewer vectors than
centroids there are as many centroids as vectors; an empty table gives an empty result.
Columns of the input that clash with results are replaced. Components beyond 2**28 after
scaling are refused with an error, since a distance would no longer fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.graph import stored
from formbook.llm.vectors import is_finite

SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
# The largest whole number whose distances over 64 dimensions fit a long.
LARGEST = 1 << 28


def _packed(vectors: DataFrame, dims: int, scale: int, embedding: str, keep: list[str], largest: int) -> DataFrame:
    """``keep``, the components as whole numbers in one binary column, the start hash."""
    numbers = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(is_finite(F.col(embedding)) & (F.size(embedding) == dims))
    # Compared as doubles: a component beyond a long must not pass.
    over = F.exists(F.col(embedding), lambda x: F.abs(x.cast("double") * scale) >= largest)
    checked = F.when(over, F.raise_error(F.lit(f"a component is beyond {largest} after scaling"))).otherwise(numbers)
    rows = rows.select(*keep, "_hash", checked.alias("_numbers"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_numbers")

    def run(batches):
        for batch in batches:
            flat = batch.column("_numbers").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            rows = flat.reshape(batch.num_rows, dims)
            codes = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "_hash")), codes], [*keep, "_hash", "_codes"])

    return rows.mapInArrow(run, f"{kinds}, _codes binary")


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dims)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row, by tables."""
    total = np.zeros((len(rows), len(centroids)), np.int64)
    for d in range(rows.shape[1]):
        values, at = np.unique(rows[:, d], return_inverse=True)
        squares = (values.astype(np.int64)[:, None] - centroids[None, :, d]) ** 2
        total += squares[at]
    number = total.argmin(axis=1)
    return number, total[np.arange(len(rows)), number]


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(centroid, dimension, sum, count) over all vectors of a centroid."""
    dims = centroids.shape[1]

    def run(batches):
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            rows = _numbers(batch.column(0), dims)
            number, _ = nearest(rows, centroids)
            np.add.at(sums, number, rows)
            counts += np.bincount(number, minlength=len(centroids))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array([s.tolist() for s in sums[met]], pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    made = vectors.select("_codes").mapInArrow(run, "cluster int, n long, sums array<long>")
    parts = made.select("cluster", "n", F.posexplode("sums").alias("dim", "sum"))
    # Sums of many tasks may pass 64 bits.
    return parts.groupBy("cluster", "dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).collect()


def first_centroids(vectors: DataFrame, dims: int, k: int) -> np.ndarray:
    first = vectors.select("_hash", "_codes").orderBy("_hash", "_codes").limit(k).collect()
    return np.array([np.frombuffer(r["_codes"], np.int32) for r in first], np.int64).reshape(len(first), dims)


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Centroids at the floor of their vectors' means; those without any stay."""
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["dim"]] = int(r["sum"]) // r["n"]
    return out


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dims: int = 64,
    scale: int = SCALE,
    seed: int = SEED,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The columns of ``vectors`` but the embedding, for every vector that takes part,
    and ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``."""
    added = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    keep = [c for c in vectors.columns if c != embedding and c not in added]
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)
    largest = min(LARGEST, int((2**62 / (4 * max(dims, 1))) ** 0.5))
    packed = stored(_packed(vectors.withColumn("_hash", hashed), dims, scale, embedding, keep, largest), "centroid-vectors")
    centroids = first_centroids(packed, dims, k)
    if not len(centroids):
        return packed.select(*keep, *_result_columns())
    for _ in range(rounds):
        centroids = moved(centroids, _sums(packed, centroids))

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name in keep)

    def run(batches):
        for batch in batches:
            number, distance = nearest(_numbers(batch.column("_codes"), dims), centroids)
            columns = [*(batch.column(c) for c in keep), pa.array(number.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([digests[i] for i in number])], [*keep, "cluster", "distance", "centroid_sha256"]
            )

    kinds = f"{kinds}, " if kinds else ""
    assigned = packed.select(*keep, "_codes").mapInArrow(run, f"{kinds}cluster int, distance long, centroid_sha256 string")
    assigned = stored(assigned, "centroid-rows")
    # One row per centroid.
    own = assigned.groupBy(F.col("cluster").alias("_cluster")).agg(F.sum("distance").alias("cluster_inertia"))
    total = own.agg(F.sum("cluster_inertia").alias("inertia")).first()["inertia"]
    joined = assigned.join(F.broadcast(own), F.col("cluster") == F.col("_cluster"))
    return joined.select(
        *keep, "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )


def _result_columns() -> list:
    kinds = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    return [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
