"""Substring dedup by content-defined chunks.

A rolling gear hash over the last 32 bytes decides where a text is cut: behind the
character whose hash is smaller than that of any other within ``NEAR`` bytes. Blanks
come before all other places, so words stay whole where there are blanks; text
without any is cut by the hash alone. What stands more than ``NEAR`` + 32 bytes away
has no say, nor has any other cut, so an insertion only moves the cuts around it.
Only where ``MOST`` bytes have no such place, as in a short pattern said over and
over, a cut depends on the last one.

Chunks are told apart by digest. A first pass counts 64-bit digests (pre-aggregated)
and keeps those seen twice; a second one finds the places of these by full digest.
All places but the first (by document id, then position) are repeats. They are anchors:
where they and their first places stand in a row, the characters left and right of the
row are compared with those beside its first place, and it grows as far as these are
equal (a word that only ends or begins alike stays). A grown row of ``RUN_CHARS``
characters is a repeated passage and goes, so a shared short line stays where it is,
also beside other short lines. Very long texts are cut and compared like short ones.

Null text counts as empty; it has no chunks. Rows with the same id and text are one
document: repeats are looked for between documents and within a text. Null ids come last in order.
An empty table gives none. Columns that clash with results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.arrow import text_slices
from formbook.llm.graph import stored

# A cut has the smallest hash of so many bytes on either side; bytes of a chunk at most.
NEAR, MOST = 24, 256
RUN_CHARS = 100
# Characters on either side of a run of chunks that are compared one by one: more than
# a chunk and what decides its cuts. Characters up to which a begun word is given back.
REACH, WORD = MOST + 2 * (NEAR + 32), 32
SPANS = "array<struct<start:int,stop:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
SEED = 0x9E3779B97F4A7C15


def gear_table(seed: int = SEED) -> np.ndarray:
    """256 random words from one seed."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = gear_table()
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
_NEVER = np.uint32((1 << 32) - 1)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[raw[i]] in 32 bits, so a sum over the last 32 bytes;
    five doublings of the window give it for all places at once."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(raw)
    if not n:
        return []
    # Blanks rank before other places; inside a character is no place.
    rank = np.where(_BLANK[raw], 0, 1 << 31).astype(np.uint32) | (gear_hash(raw) >> np.uint32(1))
    rank[:-1][raw[1:] & 0xC0 == 0x80] = _NEVER
    edge = np.full(NEAR, _NEVER)
    low = np.concatenate([edge, rank, edge])
    for k in (1, 2, 4, 8, NEAR - 16):
        low = np.minimum(low[:-k], low[k:])
    # Now the smallest of NEAR places from each on.
    places = (np.flatnonzero((rank < low[:n]) & (rank <= low[NEAR + 1 :])) + 1).tolist()
    out, last = [], 0
    for place in [*places, n]:
        while place - last > MOST:
            # Nothing stands out, as in a short pattern said over and over: the first
            # of its smallest places keeps step with the pattern.
            last += MOST - 64 + int(rank[last + MOST - 65 : last + MOST - 1].argmin())
            out.append(last)
        if place > last:
            out.append(place)
            last = place
    return out


def chunks(text: str) -> tuple[list[bytes], list[int]]:
    """Digests of the chunks, and their borders in code points (one more)."""
    coded = text.encode()
    raw = np.frombuffer(coded, np.uint8)
    ends = cuts(raw)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts = [0, *ends[:-1]]
    digests = [xxhash.xxh3_128_digest(coded[a:b]) for a, b in zip(starts, ends)]
    return digests, lead[[0, *ends]].tolist()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests as two longs each; the first is the code that is counted."""
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table. What was shuffled for it goes with the write, not when the driver
    next collects its garbage: each table is read from its files, never made twice."""
    return stored(df, name, drop_shuffles=True)


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """64-bit digests that more than one place has."""

    def run(batches):
        for _, texts in text_slices(batches, text):
            codes, _ = _halves([d for t in texts for d in chunks(t)[0]])
            yield pa.RecordBatch.from_arrays([pa.array(codes)], ["code"])

    found = docs.select(text).mapInArrow(run, "code long")
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("code")


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, key, seq, start, stop, code, rest) of every chunk."""

    def run(batches):
        for part, texts in text_slices(batches, "text"):
            owner, seq, start, stop, digests = [], [], [], [], []
            for i, t in enumerate(texts):
                own, borders = chunks(t)
                owner += [i] * len(own)
                seq += range(len(own))
                start += borders[:-1]
                stop += borders[1:]
                digests += own
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(owner),
                    part.column("key").take(owner),
                    pa.array(seq, pa.int32()),
                    pa.array(start, pa.int32()),
                    pa.array(stop, pa.int32()),
                    *map(pa.array, _halves(digests)),
                ],
                ["doc_id", "key", "seq", "start", "stop", "code", "rest"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, key long, seq int, start int, stop int, code long, rest long")


def _runs(docs: DataFrame) -> DataFrame:
    """(doc_id, key, start, stop, f_id, f_key, f_start, f_stop): repeats in a row whose
    first places are in a row too."""
    # Written, so that the join can divide a code that very many chunks have.
    codes = _written(_counted(docs, "text"), "chunk-codes")
    seen = _written(_places(docs).join(codes, "code", "left_semi"), "chunk-places")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("seq").alias("s"))
    first = seen.groupBy("code", "rest").agg(
        F.min(F.struct(place.alias("at"), "start", "stop")).alias("first"), F.count(F.lit(1)).alias("_n")
    )
    first = _written(first.where("_n > 1"), "chunk-first")
    again = seen.join(first, ["code", "rest"]).where(place != F.col("first.at"))
    again = again.select(
        "doc_id", "key", "seq", "start", "stop",
        F.col("first.at.d").alias("f_id"), F.col("first.at.k").alias("f_key"),
        F.col("first.start").alias("f_start"), F.col("first.stop").alias("f_stop"),
        (F.col("start") - F.col("first.start")).alias("_off"),
    )
    side = ["doc_id", "key", "f_id", "f_key", "_off"]
    # Dense, as a row that is there twice has the same id, text and places.
    again = again.withColumn("_run", F.col("seq") - F.dense_rank().over(Window.partitionBy(*side).orderBy("seq")))
    ends = [f(c).alias(c) for f, c in ((F.min, "start"), (F.max, "stop"), (F.min, "f_start"), (F.max, "f_stop"))]
    return _written(again.groupBy(*side, "_run").agg(*ends).drop("_off", "_run"), "chunk-runs")


def _beside(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(f_id, f_key, left, at, beside): what stands left or right of the ends of the
    first places."""
    asked = ends.select("f_id", "f_key", "left", "at").distinct()
    asked = asked.groupBy("f_id", "f_key").agg(F.collect_list(F.struct("left", "at")).alias("asked"))
    found = docs.join(asked, docs["doc_id"].eqNullSafe(F.col("f_id")) & (docs["key"] == F.col("f_key")))

    def batch(part, owner, left, at, beside):
        owner = pa.array(owner, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                part.column("f_id").take(owner),
                part.column("f_key").take(owner),
                pa.array(left, pa.bool_()),
                pa.array(at, pa.int32()),
                pa.array(beside, pa.string()),
            ],
            ["f_id", "f_key", "left", "at", "beside"],
        )

    def run(batches):
        for part, texts in text_slices(batches, "text"):
            rows = [], [], [], []
            for i, t in enumerate(texts):
                for x in part.column("asked")[i].as_py():
                    left, at = x["left"], x["at"]
                    for column, value in zip(rows, (i, left, at, t[max(0, at - REACH) : at] if left else t[at : at + REACH])):
                        column.append(value)
                    if len(rows[0]) == 5000:
                        yield batch(part, *rows)
                        rows = [], [], [], []
            yield batch(part, *rows)

    kind = dict(docs.dtypes)["doc_id"]
    beside = found.select("text", "f_id", "f_key", "asked").mapInArrow(
        run, f"f_id {kind}, f_key long, left boolean, at int, beside string"
    )
    return _written(beside.dropDuplicates(["f_id", "f_key", "left", "at"]), "chunk-beside")


def _common(one: str, two: str) -> int:
    """Characters that both begin with."""
    low, high = 0, min(len(one), len(two))
    while low < high:
        middle = (low + high + 1) // 2
        if one[low:middle] == two[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _in_word(text: str, at: int) -> bool:
    """Whether a place is inside a word of a script that sets blanks."""
    return 0 < at < len(text) and all(c.isalnum() and c < "\u0e00" for c in text[at - 1 : at + 1])


def extended(text: str, runs: list[tuple[int, int, str, str]], run_chars: int) -> list[tuple[int, int]]:
    """Repeated passages from runs (start, stop, what stands left and right of the
    first place): each as far as both texts are equal, but for a begun word. What then
    has ``run_chars`` characters in a row with one first place is a passage; short runs
    from several places that only stand side by side are none."""
    grown = []
    for start, stop, left, right in runs:
        far = start - _common(text[max(0, start - REACH) : start][::-1], left[::-1])
        begin = next((k for k in range(far, min(start, far + WORD) + 1) if not _in_word(text, k)), far)
        far = stop + _common(text[stop : stop + REACH], right)
        end = next((k for k in range(far, max(stop, far - WORD) - 1, -1) if not _in_word(text, k)), far)
        if end - begin >= run_chars:
            grown.append((begin, end))
    out: list[tuple[int, int]] = []
    for start, stop in sorted(grown):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _own_runs(docs: DataFrame) -> DataFrame:
    """(_id, _key, spans): a document's runs, each as its two ends with what stands
    beside the same end of the first place."""
    runs = _runs(docs)
    two = F.array(
        F.struct(F.lit(True).alias("left"), F.col("f_start").alias("at")),
        F.struct(F.lit(False).alias("left"), F.col("f_stop").alias("at")),
    )
    ends = runs.select("doc_id", "key", "f_id", "f_key", "start", "stop", F.explode(two).alias("end"))
    ends = ends.select("*", "end.left", "end.at").drop("end")
    beside = _beside(docs, ends).withColumnsRenamed({"f_id": "_f_id", "f_key": "_f_key", "left": "_left", "at": "_at"})
    on = F.col("f_id").eqNullSafe(F.col("_f_id")) & (F.col("f_key") == F.col("_f_key"))
    known = ends.join(beside, on & (F.col("left") == F.col("_left")) & (F.col("at") == F.col("_at")))
    own = known.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("start", "stop", "left", "beside")).alias("spans")
    )
    return _written(own, "chunk-own-runs")


def _with_spans(docs: DataFrame, run_chars: int, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``spans``, joined once with what is known of their runs."""
    whole = F.coalesce(text, F.lit(""))
    own = _own_runs(docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("key")))

    def found(texts: pa.Array, runs: pa.Array) -> pa.Array:
        spans = []
        for t, ends in zip(texts, runs):
            # A chunk has one first place, so a run of chunks is known by its start.
            mine = {}
            for x in ends.as_py() or ():
                mine.setdefault((x["start"], x["stop"]), {})[x["left"]] = x["beside"]
            passages = extended(t.as_py(), [(*k, v[True], v[False]) for k, v in mine.items()], run_chars) if mine else []
            spans.append([{"start": a, "stop": b} for a, b in passages])
        return pa.array(spans, _SPAN_TYPE)

    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(whole) == F.col("_key"))
    joined = docs.drop("spans").join(own, same, "left").drop("_id", "_key")
    # Only texts with runs are sent to Python.
    return joined.withColumn("spans", F.arrow_udf(found, SPANS)(F.when(F.col("spans").isNotNull(), whole), "spans"))


def repeats(docs: DataFrame, run_chars: int = RUN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, spans) of documents with repeated passages; ``spans`` in code
    points, ``key`` a hash of the text."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    found = _with_spans(docs, run_chars, "doc_id", "text").where(F.size("spans") > 0)
    return found.select("doc_id", F.xxhash64("text").alias("key"), "spans").dropDuplicates(["doc_id", "key"])


def without_repeats(docs: DataFrame, run_chars: int = RUN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (repeated passages, empty if none) and ``kept_text``."""
    joined = _with_spans(docs.drop("spans", "kept_text"), run_chars, doc_id, text)
    # What stands between the end of one span and the start of the next.
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["stop"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    return joined.withColumn("kept_text", F.when(F.size("spans") == 0, F.col(text)).otherwise(F.array_join(kept, "")))
