"""Embedding near-duplicates by an epsilon grid order join.

For vectors of length one, cosine >= t means a distance of at most
eps = sqrt(2 - 2t), also between projections on any leading principal dimensions.
Vectors of a label are sorted by their grid cells (eps wide) on those dimensions and
cut into blocks. Two blocks can only hold a link if their boxes come within eps, and
along the first dimension that is an equi-join on the cells a block covers. Inside a
task the two sorted sequences are halved again and again, boxes that are provably
apart are skipped, and what remains is multiplied out in double precision.

Equal vectors of a label are one vector with a count, so copies cost nothing. A task
returns link counts and a spanning forest of the links, never pairs. The principal
dimensions come from all vectors (sums per task, d x d numbers in the end); they
decide speed, never results.

Vectors that are null, zero, or hold null or non-finite components, and vectors
without a label, link with nothing. Shorter vectors count as filled with zeros.
Rows with the same id are vectors of their own; null ids take part, and a component
of null ids only has a null id. Other columns, whatever their names, are not read. An
empty table gives none. Components are taken in the precision they are given in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.graph import components, forest, stored
from formbook.llm.vectors import is_finite, pack, precise, unpack

COSINE = 0.93
# Leading principal dimensions that make up the grid.
DIMS = 3
BLOCK = 512
# Sequences of this length are multiplied out.
LEAF = 128


def _directions(unique: DataFrame, dims: int) -> np.ndarray:
    """Leading eigenvectors of the second moments of all vectors scaled to length one."""

    def run(batches):
        total = np.zeros((0, 0))
        for batch in batches:
            x = _units(unpack(*pack(batch.column("embedding").to_pylist())))
            d = max(len(total), x.shape[1])
            grown = np.zeros((d, d))
            grown[: len(total), : len(total)] = total
            grown[: x.shape[1], : x.shape[1]] += x.T @ x
            total = grown
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["i", "j", "v"])

    # d x d sums: as many as the vectors have components, squared.
    sums = unique.select("embedding").mapInArrow(run, "i long, j long, v double")
    sums = sums.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if sums.empty:
        return np.zeros((0, dims))
    d = int(sums["i"].max()) + 1
    moments = np.zeros((d, d))
    moments[sums["i"].to_numpy(int), sums["j"].to_numpy(int)] = sums["v"].to_numpy(float)
    _, vectors = np.linalg.eigh((moments + moments.T) / 2)
    out = vectors[:, ::-1][:, :dims]
    # A fixed sign, so that a repeated run sorts alike.
    out = out * np.where(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])] < 0, -1.0, 1.0)
    return np.pad(out, ((0, 0), (0, dims - out.shape[1])))


def _units(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of tiny or huge components stay in range.
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _placed(unique: DataFrame, directions: np.ndarray, eps: float) -> DataFrame:
    """Add the coordinates ``at`` on the leading dimensions."""
    shared = unique.sparkSession.sparkContext.broadcast(directions)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = unpack(*pack(batch.column("embedding").to_pylist()), dims=len(shared.value))
                at = _units(x) @ shared.value
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at))], [*batch.schema.names, "at"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in unique.schema.fields)
    out = unique.mapInArrow(run, f"{kinds}, at array<double>")
    return out.withColumns({f"cell{k}": F.floor(F.col("at")[k] / eps) for k in range(directions.shape[1])})


def _blocks(placed: DataFrame, dims: int) -> DataFrame:
    """Blocks of at most ``BLOCK`` vectors of one label along the grid order."""
    order = ["label", *(f"cell{k}" for k in range(dims)), "node"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        label, held = None, []

        def block():
            at = np.array([r["at"] for r in held])
            sizes, flat = pack([r["embedding"] for r in held])
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "label": label,
                        "first": int(held[0]["node"]),
                        "low": at.min(axis=0).tolist(),
                        "high": at.max(axis=0).tolist(),
                        "nodes": [r["node"] for r in held],
                        "copies": [r["copies"] for r in held],
                        "at": at.tobytes(),
                        "sizes": sizes,
                        "flat": flat,
                    }
                ],
                schema=_BLOCK_ARROW,
            )

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["label"] != label or len(held) == BLOCK):
                    yield block()
                    held = []
                label = row["label"]
                held.append(row)
        if held:
            yield block()

    keep = ranged.select("label", "node", "copies", "embedding", "at")
    return keep.mapInArrow(run, _BLOCK_SCHEMA)


_BLOCK_SCHEMA = (
    "label long, first long, low array<double>, high array<double>, nodes array<long>, copies array<long>,"
    " at binary, sizes binary, flat binary"
)
_BLOCK_ARROW = pa.schema(
    [
        ("label", pa.int64()),
        ("first", pa.int64()),
        ("low", pa.list_(pa.float64())),
        ("high", pa.list_(pa.float64())),
        ("nodes", pa.list_(pa.int64())),
        ("copies", pa.list_(pa.int64())),
        ("at", pa.binary()),
        ("sizes", pa.binary()),
        ("flat", pa.binary()),
    ]
)


def _block_pairs(blocks: DataFrame, eps: float, dims: int) -> DataFrame:
    """(a, b): first nodes of the blocks whose boxes come within eps, each pair once.

    ``b`` begins at or after ``a`` in the first dimension, and within a cell of its
    end; so it is enough to look up the cell in which ``b`` begins.
    """
    cell = lambda x: F.floor(x / eps)
    own = blocks.select("label", "first", "low", "high")
    left = own.select(
        "label",
        F.col("first").alias("a"),
        F.col("low").alias("low_a"),
        F.col("high").alias("high_a"),
        F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]) + 1)).alias("cell"),
    )
    right = own.select("label", F.col("first").alias("b"), "low", "high", cell(F.col("low")[0]).alias("cell"))
    gap = sum(
        F.pow(F.greatest(F.lit(0.0), F.col("low")[k] - F.col("high_a")[k], F.col("low_a")[k] - F.col("high")[k]), 2)
        for k in range(dims)
    )
    later = (F.col("low_a")[0] < F.col("low")[0]) | ((F.col("low_a")[0] == F.col("low")[0]) & (F.col("a") <= F.col("b")))
    return left.join(right, ["label", "cell"]).where(later & (gap <= eps * eps + 1e-9)).select("a", "b")


def sequence_links(x, at_x, y, at_y, same: bool, cosine: float, eps: float):
    """(left, right) of the rows of ``x`` and ``y`` that link.

    ``same``: both are one sequence; then each pair counts once.
    """
    found = []

    def join(a, b, c, d):
        gap = np.maximum(
            0, np.maximum(at_x[a:b].min(0) - at_y[c:d].max(0), at_y[c:d].min(0) - at_x[a:b].max(0))
        )
        if (gap * gap).sum() > eps * eps + 1e-9 or (same and d <= a):
            return
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
            return
        halves_x = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        halves_y = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        for p, q in halves_x:
            for r, s in halves_y:
                join(p, q, r, s)

    join(0, len(x), 0, len(y))
    none = np.zeros(0, int)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def _links(pairs: DataFrame, blocks: DataFrame, cosine: float, eps: float, dims: int) -> DataFrame:
    """(node, links, root) per vector with links in a pair of blocks."""
    payload = ["nodes", "copies", "at", "sizes", "flat"]

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("first").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in payload])

    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                same = row["a"] == row["b"]
                x, y = (unpack(row[f"sizes_{s}"], row[f"flat_{s}"]) for s in "ab")
                d = max(x.shape[1], y.shape[1])
                x, y = (_units(np.pad(v, ((0, 0), (0, d - v.shape[1])))) for v in (x, y))
                at_x, at_y = (np.frombuffer(row[f"at_{s}"]).reshape(-1, dims) for s in "ab")
                left, right = sequence_links(x, at_x, y, at_y, same, cosine, eps)
                nodes = np.array(row["nodes_a"] + ([] if same else row["nodes_b"]), np.int64)
                copies = np.array(row["copies_a"] + ([] if same else row["copies_b"]), np.int64)
                if not same:
                    right = right + len(x)
                links = np.zeros(len(nodes), np.int64)
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
                roots = nodes.copy()
                for a, b in forest(left, right, len(nodes)):
                    roots[b] = nodes[a]
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[some]), pa.array(links[some]), pa.array(roots[some])], ["node", "links", "root"]
                )

    return both.repartition("a", "b").mapInArrow(run, "node long, links long, root long")


def join(
    vectors: DataFrame, cosine: float = COSINE, dims: int = DIMS, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    eps = float(np.sqrt(2 - 2 * cosine))
    exact = precise(F.col(embedding), dict(vectors.dtypes)[embedding])
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("long").alias("label"), exact.alias("embedding"))
    joins = F.col("label").isNotNull() & is_finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    unique = stored(
        rows.where(joins)
        .groupBy("label", "embedding")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("smallest"))
        .withColumn("node", F.monotonically_increasing_id()),
        "ego-unique",
    )
    directions = _directions(unique, dims)
    placed = _placed(unique.drop("smallest"), directions, eps)
    blocks = stored(_blocks(placed, dims), "ego-blocks")
    links = stored(_links(_block_pairs(blocks, eps, dims), blocks, cosine, eps, dims), "ego-links")
    roots = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = (
        unique.join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    smallest = joined.groupBy("root").agg(F.min("smallest").alias("component_id"))
    found = joined.join(smallest, "root").select(
        F.col("label").alias("_label"),
        F.col("embedding").alias("_embedding"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id",
        F.lit(True).alias("_joined"),
    )
    match = joins & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    component = F.when(F.col("_joined"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.join(found, match, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
