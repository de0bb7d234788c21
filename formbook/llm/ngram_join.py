"""Join of texts whose sets of word n-grams have a Jaccard similarity of 0.8 or more.

Texts with the same set are one class; classes are compared, not copies. MinHash
bands put classes into buckets; a pair meets in the first bucket it shares. There
the MinHash values of all pairs of two blocks are compared step by step: with m of n
values equal, the posterior of the similarity (flat prior) is a beta distribution,
and a pair whose probability of reaching the threshold falls below the tolerance is
dropped. What is left is verified on the n-gram sets, exactly.

Two classes above the threshold share no bucket with probability
(1 - 0.8^BAND_ROWS)^BANDS at most, 3 in 100,000 at exactly 0.8 and far less above.

A bucket of any size is cut into blocks by a hash; block pairs go to tasks, and a
task returns link counts and a spanning forest of the links, never pairs. Each class
of a bucket of n is sent to n / BLOCK block pairs with its n-grams, so rows shuffled
grow with n * n / BLOCK. Buckets with the same members count once. No bucket, block or
candidate is capped.

Words are runs of non-blanks in lower case; a text of fewer than five words has one
n-gram, all its words. Null and empty texts have none, link with nothing and are
classes of their own. Rows equal in id and text each count as a document of their
class. A null id takes part; a class or component of null ids only has a null id.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.arrow import append_columns
from formbook.llm.graph import components, forest, stored

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 20, 4
# MinHash values that a pair is compared on, and how many per step.
HASHES, STEP = 128, 32
TOLERANCE = 1e-6
# Classes per block of a bucket.
BLOCK = 512
KNOWN_WORDS = 150_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        raw = word.encode()
        self[word] = code = zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], len(raw))
        return code


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The sorted distinct n-gram codes of a text."""

    def __init__(self, words: int = WORDS):
        self.codes, self.n = _WordHashes(), words

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        if n == 0:
            return codes
        total = mixed(codes[: len(codes) - n + 1] + np.uint64(n))
        for k in range(1, n):
            total = mixed(total + codes[k : len(codes) - n + 1 + k])
        return np.unique(total)


@lru_cache(maxsize=2)
def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def minhash(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` values of each set; no set is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), count), np.uint32)
    factor, shift = _factors(HASHES)
    if len(flat) * count <= 1 << 18:
        values = (flat[:, None] * factor[:count] + shift[:count]) >> np.uint64(32)
        return np.minimum.reduceat(values, starts, axis=0).astype(np.uint32)
    for k in range(count):
        values = ((flat * factor[k] + shift[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(values, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A bucket key per band; its lowest five bits are the band."""
    keys = np.empty((len(values), BANDS), np.int64)
    for b in range(BANDS):
        key = np.full(len(values), b + 1, np.uint64)
        for k in range(BAND_ROWS):
            key = mixed(key + values[:, b * BAND_ROWS + k].astype(np.uint64))
        keys[:, b] = ((key & ~np.uint64(31)) | np.uint64(b)).view(np.int64)
    return keys


@lru_cache(maxsize=8)
def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Per number of compared values, the matches below which a pair is dropped.

    With a flat prior, P(similarity >= t | m of n) is the chance of at most m
    successes in n + 1 draws of probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (numbers in ``left`` and ``right``) reach the threshold, exactly."""
    sizes = np.array([len(s) for s in sets])
    both = sizes[left] + sizes[right]
    if len(left) * 20 < len(sets) ** 2:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)])
    else:
        # Dense: columns are n-grams that at least two of the sets hold.
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
        owner, number = owner[number >= 0], number[number >= 0]
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        table = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int((count > 1).sum()), 2048):
            a, b = np.searchsorted(number, [start, start + 2048])
            part = np.zeros((len(sets), 2048), np.float32)
            part[owner[a:b], number[a:b] - start] = 1
            table += part @ part.T
        shared = table[left, right].astype(np.int64)
    return shared >= threshold * (both - shared) - 1e-9


def likely(values: np.ndarray, left: np.ndarray, right: np.ndarray, fewest: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs left after comparing MinHash values step by step."""
    matches = np.zeros(len(left), np.int32)
    for n, least in fewest.items():
        for k in range(n - STEP, n):
            matches += values[left, k] == values[right, k]
        stay = matches >= least
        left, right, matches = left[stay], right[stay], matches[stay]
    return left, right


def block_links(sets, sizes, keys, blocks, pair: tuple[int, int], band: int, threshold: float):
    """(left, right) of the links between the two blocks of a bucket.

    ``keys``: per class and band the bucket it is in (0: none). A pair that shares an
    earlier bucket is left to that one.
    """
    first, second = np.flatnonzero(blocks == pair[0]), np.flatnonzero(blocks == pair[1])
    values = minhash(sets, HASHES)
    fewest = fewest_matches(threshold)
    found = []
    for a in first:
        # One row of the block against all of the other: memory stays that of a row.
        other = second[second > a] if pair[0] == pair[1] else second
        small, large = np.minimum(sizes[a], sizes[other]), np.maximum(sizes[a], sizes[other])
        other = other[small >= threshold * large - 1e-9]
        if len(other):
            found.append(likely(values, np.full(len(other), a), other, fewest))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    left, right = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    if len(left):
        shared = (keys[left] == keys[right]) & (keys[left] != 0)
        mine = np.argmax(shared, axis=1) == band
        left, right = left[mine], right[mine]
    if len(left):
        linked = similar(sets, left, right, threshold)
        left, right = left[linked], right[linked]
    return left, right


def _signatures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``digest`` of the n-gram set and ``bands`` (null without words)."""
    import hashlib

    def make():
        shingles = Shingles()

        def run(texts):
            sets = [shingles(t) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            digests, bands = [None] * len(sets), [None] * len(sets)
            if some:
                keys = band_keys(minhash([sets[i] for i in some], BANDS * BAND_ROWS))
                for i, row in zip(some, keys):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i] = row
            return [pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

        return run

    return append_columns(docs, text, keep, {"digest": "binary", "bands": "array<bigint>"}, make)


def _code(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _buckets(classes: DataFrame) -> DataFrame:
    """(digest, keys): for every class that shares a bucket, its buckets by band with
    their sizes; of buckets with the same members one stays."""
    spread = classes.select("digest", F.explode("bands").alias("key"))
    several = (
        spread.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("digest")).alias("x"),
            F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"),
        )
        .where("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min("key").alias("key"))
        .select("key", "n")
    )
    return spread.join(several, "key").groupBy("digest").agg(F.collect_list(F.struct("key", "n")).alias("keys"))


def _block_rows(docs: DataFrame, candidates: DataFrame, text: str) -> DataFrame:
    """(key, i, j, block, digest, n, keys, grams): the classes of each pair of blocks."""

    def make():
        shingles = Shingles()

        def run(texts):
            return [pa.array([shingles(t).tobytes() for t in texts], pa.binary())]

        return run

    chosen = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text"), _code(text).alias("_code"))
    met = chosen.join(
        candidates, F.col("_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("_code") == F.col("rep.code"))
    ).select("_text", "digest", "size", "keys")
    grams = append_columns(met, "_text", ["digest", "size", "keys"], {"grams": "binary"}, make)
    blocks = F.ceil(F.col("at.n") / BLOCK)
    own = F.pmod(F.xxhash64("digest", F.lit(2)), blocks)
    return (
        grams.select("digest", "size", "keys.key", "grams", F.explode("keys").alias("at"))
        .select("digest", "size", F.col("key").alias("keys"), "grams", F.col("at.key").alias("key"), own.alias("block"), blocks.alias("_blocks"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other"))
        .select(
            "key",
            F.least("block", "_other").alias("i"),
            F.greatest("block", "_other").alias("j"),
            "block",
            "digest",
            "size",
            "keys",
            "grams",
        )
    )


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """(digest, links, root) per class with links in a pair of blocks."""

    def compare(head, members):
        key, i, j = head
        members = list({m["digest"]: m for m in members}.values())
        sets = [np.frombuffer(m["grams"], np.uint64) for m in members]
        keys = np.zeros((len(members), BANDS), np.int64)
        for row, m in enumerate(members):
            for k in m["keys"]:
                keys[row, k & 31] = k
        sizes = np.array([len(s) for s in sets])
        blocks = np.array([m["block"] for m in members])
        left, right = block_links(sets, sizes, keys, blocks, (i, j), key & 31, threshold)
        copies = np.array([m["size"] for m in members], np.int64)
        links = np.zeros(len(members), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        roots = dict((b, a) for a, b in forest(left, right, len(members)))
        return [
            (members[x]["digest"], int(links[x]), members[roots[x]]["digest"] if x in roots else None)
            for x in np.flatnonzero(links)
        ]

    def run(batches):
        head, members, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                mine = (row["key"], row["i"], row["j"])
                if mine != head:
                    if len(members) > 1:
                        out += compare(head, members)
                    head, members = mine, []
                    if len(out) >= 5000:
                        yield _rows(out)
                        out = []
                members.append(row)
        if len(members) > 1:
            out += compare(head, members)
        yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in out], pa.binary()),
                pa.array([r[1] for r in out], pa.int64()),
                pa.array([r[2] for r in out], pa.binary()),
            ],
            ["digest", "links", "root"],
        )

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "digest binary, links long, root binary")


def join(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, code, class_id, n_links, component_id) of every row of ``docs``.

    ``class_id``: smallest id among texts with the same n-grams. ``n_links``: other
    documents at the threshold or above. ``component_id``: smallest id that links
    reach. ``code``: a hash of the text, to find the row again.
    """
    marks = stored(_signatures(docs.select("doc_id", text, _code(text).alias("code")), text, ["doc_id", "code"]), "join-marks")
    classes = stored(
        marks.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min_by(F.struct("doc_id", "code"), F.struct(F.col("doc_id").isNull(), "doc_id", "code")).alias("rep"),
            F.first("bands").alias("bands"),
        ),
        "join-classes",
    )
    candidates = stored(_buckets(classes).join(classes.drop("bands"), "digest"), "join-candidates")
    links = stored(_links(_block_rows(docs, candidates, text), threshold), "join-links")
    roots = components(links.where("root IS NOT NULL").select(F.col("digest").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("digest").agg(F.sum("links").alias("links"))
    joined = (
        classes.drop("bands")
        .join(counted, "digest", "left")
        .join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        .withColumn("root", F.coalesce("root", "digest"))
    )
    smallest = joined.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    found = stored(
        joined.join(smallest, "root").select(
            "digest",
            F.col("rep.doc_id").alias("class_id"),
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            "component_id",
        ),
        "join-found",
    )
    alone = F.col("digest").isNull()
    return marks.drop("bands").join(found, "digest", "left").select(
        "doc_id",
        "code",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, joined: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is that of their component, one per component.

    Rows equal in id and text are told apart by nothing, so of those one stays; null
    ids only stay where no other id is in the component.
    """
    kept = joined.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(kept.groupBy("doc_id", "code", "component_id").agg(F.count(F.lit(1)).alias("_n")), "join-kept")
    match = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_code") == _code(text))

    def rows(of: DataFrame) -> DataFrame:
        of = of.select(F.col("doc_id").alias("_id"), F.col("code").alias("_code"))
        return docs.join(of, match, "left_semi")

    once = rows(kept.where("_n = 1"))
    repeated = kept.where("_n > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(rows(repeated).dropDuplicates(["doc_id", text]))
