"""Exact top-k by inner product, with vectors grouped by length.

Components become whole numbers, floor(scale * x), so scores are whole and ties are
real. Candidates are grouped into buckets of nearly equal length and cut into blocks
inside them; queries are grouped into blocks too. Scoring the queries against one
block of the longest candidates gives each a score it needs at least, and with the
length of its bucket that becomes a local cosine threshold: above one, the bucket is
skipped. Otherwise the bucket is pruned by coordinates where the threshold is high
(each candidate's share in the query's largest coordinate is bounded) and by length
where it is low; what is left is multiplied out.

The blocks of a bucket are dealt to tasks in runs; a task keeps one running top-k per
query of a block, so it returns k rows per query and run, and these meet in one
ranking. Queries are taken in blocks against all rows; nothing is cut off.

Vectors that are null or hold null or non-finite components, and rows without an id,
take no part. Shorter vectors count as filled with zeros; an empty vector scores 0.
Rows with the query's id are its own and never candidates; other repeated rows are
candidates each. A query row that is repeated asks once. Components are taken in the
precision they are given in; scaled ones beyond a double's range count as its largest
value, and scores beyond 64 bits as the largest or smallest long. Other columns, whatever
their names, are not read. An empty table gives none; with fewer candidates than k, all
are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.graph import stored
from formbook.llm.vectors import is_finite, pack, precise, unpack, width

SCALE = 64
K = 20
CANDIDATES, QUERIES = 1024, 256
# Blocks of a bucket that one task goes through with one running top-k.
RUN = 8
# Buckets per doubling of the length.
STEPS = 4
# Local cosine from which coordinates prune better than lengths.
BY_COORDINATE = 0.8
# Class of vectors of length 0, below all others.
NO_LENGTH = -10_000
LARGEST = 2**63 - 1
FARTHEST = np.finfo(np.float64).max


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -FARTHEST, FARTHEST)


def lengths_of(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors, scaled first so that squares stay in range."""
    most = np.abs(x).max(axis=1, initial=0)
    part = x / np.maximum(most, 1)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(np.maximum(most, 1) * np.sqrt((part * part).sum(axis=1)), FARTHEST)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of tables of whole doubles, as longs."""
    d = max(q.shape[1], p.shape[1])
    q, p = (np.pad(v, ((0, 0), (0, d - v.shape[1]))) for v in (q, p))
    with np.errstate(over="ignore"):
        largest = np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(1, d)
    if largest < 2**53:
        return (q @ p.T).astype(np.int64)
    a, b = (np.array([[int(x) for x in row] for row in v], object).reshape(len(v), d) for v in (q, p))
    exact = a.dot(b.T) if d else np.zeros((len(a), len(b)), object)
    return np.array([[max(-LARGEST - 1, min(LARGEST, int(x))) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(ids))
    # ~x turns the order of longs around; -x has no value for the smallest one.
    order = np.lexsort((ids[some], ~scores[some]))
    return some[order[:k]]


def _class_of(length: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(length > 0, np.floor(np.log2(length) * STEPS), NO_LENGTH).astype(np.int64)


def _packed(ids: list, rows: list, lengths: list, **more) -> dict:
    sizes, flat = pack(rows)
    return {"ids": ids, "sizes": sizes, "flat": flat, "lengths": np.array(lengths).tobytes(), **more}


def _with_lengths(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, embedding, length and class of the vectors that take part."""

    kind = dict(vectors.dtypes)["embedding"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                length = lengths_of(whole_numbers(unpack(*pack(batch.column("embedding").to_pylist())), scale))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(length), pa.array(_class_of(length))], ["vec_id", "embedding", "length", "class"]
                )

    return vectors.mapInArrow(run, f"vec_id long, embedding {kind}, length double, class long")


_BLOCK = "class long, block long, most double, least double, ids array<long>, sizes binary, flat binary, lengths binary"


def _blocks(rows: DataFrame, order: list, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of one class along ``order``."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        held, part = [], None

        def block():
            lengths = [r["length"] for r in held]
            made = _packed(
                [r["vec_id"] for r in held],
                [r["embedding"] for r in held],
                lengths,
                **{"class": held[0]["class"], "block": 0, "most": max(lengths), "least": min(lengths)},
            )
            return pa.RecordBatch.from_pylist([made], schema=_BLOCK_ARROW)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["class"] != held[0]["class"] or len(held) == size):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return ranged.mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id())


_BLOCK_ARROW = pa.schema(
    [
        ("class", pa.int64()),
        ("block", pa.int64()),
        ("most", pa.float64()),
        ("least", pa.float64()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.binary()),
        ("flat", pa.binary()),
        ("lengths", pa.binary()),
    ]
)


def survivors(q, length: float, need: float, p, lengths) -> np.ndarray:
    """Rows of a block that may reach ``need`` (above 0) with the query ``q``."""
    cosine = need / np.maximum(length * lengths, 1e-300)
    may = cosine <= 1 + 1e-9
    if need >= BY_COORDINATE * length * lengths.max(initial=0):
        # For unit vectors, cosine <= the product in one coordinate plus the rest's lengths.
        f = int(np.abs(q).argmax())
        share = q[f] / length
        own = p[:, f] / np.maximum(lengths, 1e-300)
        rest = np.sqrt(np.maximum(0, 1 - share * share) * np.maximum(0, 1 - own * own))
        may &= share * own + rest >= cosine - 1e-9
    return np.flatnonzero(may)


def _first_scores(queries: DataFrame, blocks: DataFrame, k: int, scale: int) -> DataFrame:
    """Query blocks with ``needs``, per query a score that its k best reach (or null)."""
    # One block: at most CANDIDATES rows.
    top = blocks.orderBy(F.desc("most"), "block").limit(1).collect()
    shared = queries.sparkSession.sparkContext.broadcast(top[0].asDict() if top else None)

    def needs(row) -> list:
        one = shared.value
        if one is None:
            return [None] * len(row["ids"])
        q, p = (whole_numbers(unpack(r["sizes"], r["flat"]), scale) for r in (row, one))
        scores, ids = products(q, p), np.array(one["ids"], np.int64)
        out = []
        for mine, line in zip(row["ids"], scores):
            line = line[ids != mine]
            out.append(int(np.partition(line, len(line) - k)[len(line) - k]) if len(line) >= k else None)
        return out

    def run(batches):
        for batch in batches:
            found = [needs(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "needs"]
            )

    return queries.mapInArrow(run, f"{_BLOCK}, needs array<long>")


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for every row where ``is_query``."""
    exact = precise(F.col(embedding), dict(vectors.dtypes)[embedding])
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), exact.alias("embedding"), is_query.alias("_asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & is_finite(F.col("embedding")))
    measured = stored(_with_lengths(rows.select("vec_id", "embedding"), scale), "topk-rows")
    candidates = stored(_blocks(measured, [F.desc("class"), F.desc("length"), F.col("vec_id")], CANDIDATES), "topk-blocks")
    asking = rows.where("_asks").select("vec_id", "embedding").dropDuplicates(["vec_id", "embedding"])
    asking = _with_lengths(asking, scale)
    asking = _blocks(asking.withColumn("class", F.lit(0).cast("long")), [F.col("length"), F.col("vec_id")], QUERIES)
    queries = stored(_first_scores(stored(asking, "topk-asking"), candidates, k, scale), "topk-queries")

    # Length classes that a query block has to visit; there are at most STEPS per
    # power of two that a double has.
    present = [r["class"] for r in candidates.select("class").distinct().collect()]
    need = F.array_min("needs")
    any_length = F.exists("needs", lambda n: n.isNull() | (n <= 0)) | (F.col("most") <= 0)
    lowest = F.when(~any_length, F.floor(F.log2(need / F.col("most")) * STEPS) - 1)
    known = F.array(*[F.lit(c).cast("long") for c in present]).cast("array<long>")
    visits = queries.select(
        F.col("block").alias("asked"),
        F.explode(F.filter(known, lambda c: lowest.isNull() | (c >= lowest))).alias("class"),
    )
    return _ranked(_found(visits, queries, candidates, k, scale), k)


def _found(visits: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, scale: int) -> DataFrame:
    """(asked, place, query_id, vec_id, score): the k best per query and run of blocks."""
    to = candidates.select("class", "block", F.floor(F.col("block") / RUN).alias("run"))
    pairs = visits.join(to, "class").select("asked", "run", "block")
    packed = ["ids", "sizes", "flat", "lengths"]
    theirs = candidates.select("block", F.col("most").alias("longest"), *packed)
    ours = queries.select(F.col("block").alias("asked"), "needs", *[F.col(c).alias(f"q_{c}") for c in packed])
    rows = pairs.join(theirs, "block").join(ours, "asked")
    rows = rows.repartition("asked", "run").sortWithinPartitions("asked", "run", F.desc("longest"), "block")

    def run(batches):
        head, state = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if (row["asked"], row["run"]) != head:
                    if state is not None:
                        yield state.result(head[0])
                    head, state = (row["asked"], row["run"]), _Running(row, k, scale)
                state.visit(row)
        if state is not None:
            yield state.result(head[0])

    return rows.mapInArrow(run, "asked long, place int, query_id long, vec_id long, score long")


class _Running:
    """The k best so far of each query of a block."""

    def __init__(self, row: dict, k: int, scale: int):
        self.k, self.scale = k, scale
        self.q = whole_numbers(unpack(row["q_sizes"], row["q_flat"]), scale)
        self.lengths = np.frombuffer(row["q_lengths"])
        self.own = row["q_ids"]
        self.needs = list(row["needs"])
        self.ids = [np.zeros(0, np.int64)] * len(self.own)
        self.scores = [np.zeros(0, np.int64)] * len(self.own)

    def visit(self, row: dict) -> None:
        ids, lengths = np.array(row["ids"], np.int64), np.frombuffer(row["lengths"])
        d = max(self.q.shape[1], width(row["sizes"]))
        q = np.pad(self.q, ((0, 0), (0, d - self.q.shape[1])))
        p = whole_numbers(unpack(row["sizes"], row["flat"], d), self.scale)
        whole = []
        for i, need in enumerate(self.needs):
            reach = self.lengths[i] * row["longest"]
            if need is None or need <= 0 or need < BY_COORDINATE * reach:
                whole.append(i)
            elif need <= reach * (1 + 1e-9):
                some = survivors(q[i], self.lengths[i], need, p, lengths)
                if len(some):
                    self.add(i, ids[some], products(q[i : i + 1], p[some])[0])
        if whole:
            needs = [self.needs[i] for i in whole]
            shortest = [n / max(self.lengths[i], 1e-300) if n is not None and n > 0 else 0 for i, n in zip(whole, needs)]
            some = np.flatnonzero(lengths >= min(shortest) * (1 - 1e-9))
            for i, line in zip(whole, products(q[whole], p[some])):
                self.add(i, ids[some], line)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        may = ids != self.own[i]
        if self.needs[i] is not None:
            may &= scores >= self.needs[i]
        if may.any():
            ids, scores = np.append(self.ids[i], ids[may]), np.append(self.scores[i], scores[may])
            top = best(ids, scores, self.k)
            self.ids[i], self.scores[i] = ids[top], scores[top]
            if len(top) == self.k:
                self.needs[i] = max(int(scores[top[-1]]), -LARGEST - 1 if self.needs[i] is None else self.needs[i])

    def result(self, asked: int) -> pa.RecordBatch:
        sizes = [len(x) for x in self.ids]
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(sum(sizes), asked)),
                pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
                pa.array(np.repeat(np.array(self.own, np.int64), sizes)),
                pa.array(np.concatenate([none, *self.ids])),
                pa.array(np.concatenate([none, *self.scores])),
            ],
            ["asked", "place", "query_id", "vec_id", "score"],
        )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
