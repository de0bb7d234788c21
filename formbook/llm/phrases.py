"""Phrase collocation mining by Misra-Gries summaries and an exact second pass.

Words are runs between blanks, inside pieces between marks or line ends; a phrase is a
run of words of one piece, and everything is counted per language. Phrases of 1 to
``max_words`` words seen at least ``least`` times are wanted exactly, without a table of
all phrases that occur.

Pass one. A task hashes every occurrence of a phrase to a number whose leading bits name
a hash partition, counts equal numbers, and hands each partition a packed block. A
partition merges its blocks in a Misra-Gries summary: at most ``capacity`` counters, and
when there are more, the smallest count that is one too many is taken from all. What was
taken is the most by which a counter can be low. The capacity always exceeds the mass
seen divided by the threshold (twice), and it grows instead of taking when the total
taken would reach the threshold. So a phrase seen ``least`` times always survives, and
memory follows the partition's mass divided by the threshold. The number of partitions
follows the size of the text, so neither grows with the table.

Pass two. The survivors' numbers become a bit table of eight bits or more per survivor,
at most ``2 ** MOST_BITS`` bits, which every task gets. Phrases whose bit is set are
counted exactly, as text, in the task and then by Spark; those below the threshold go. A
fuller table only lets more phrases through to that exact count.

``collocations`` scores frequent phrases of two or more words by their least favourable
cut, drops those that a longer phrase covers, and keeps the best of each language. All
of it is joins and aggregates on (language, phrase). Products are decimals.

Null texts are empty and add nothing; a null language is ``und``. Repeated rows count
each time. Texts of any length are cut at piece ends only, so a piece is what a task
holds at once. An empty table, or one without a frequent phrase, gives an empty result.
Equal scores are ordered by count, then phrase in byte order, so no tie is left.
Columns of the input other than text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.graph import stored

LEAST = 30
MAX_WORDS = 4
TOP = 2000
COVERED = 80
SCALE = 2_000_000
# Bytes of text that a task works on at once, and phrases that it counts at once.
SLICE_BYTES = 1 << 20
FLUSH = 1 << 21
# Phrase occurrences per hash partition that its summary is planned for.
PARTITION_MASS = 1 << 24
FEWEST_CAPACITY = 1 << 16
# Bits of the number of a phrase: those of its partition and this many more.
REST_BITS = 32
MOST_PARTITION_BITS = 24
FEWEST_BITS, MOST_BITS = 20, 30
# Parts in which the best phrases of a language are chosen first.
SALT = 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts, in order, and where phrases may start."""

    def __init__(self, data: np.ndarray, text_ends: np.ndarray, langs: np.ndarray):
        """``data`` holds the texts' bytes one after the other; ``langs`` numbers per text."""
        kind = _KIND[data]
        inside = kind == 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        firsts = text_ends[:-1][text_ends[:-1] < len(data)]
        start[firsts] = inside[firsts]
        packed = _LOWER[data[inside]]
        at = np.flatnonzero(start[inside])
        self.n = len(at)
        offsets = np.append(at, len(packed)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        self.id = coded.indices.to_numpy(zero_copy_only=False)
        self.dictionary = coded.dictionary
        places = np.flatnonzero(start)
        text = np.searchsorted(text_ends, places, "right") - 1
        self.lang = langs[text]
        piece = np.cumsum(kind == 2, dtype=np.int64)[places]
        # Words that the next word of the same piece follows.
        self.joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1]) if self.n else np.zeros(0, bool)

    def starts(self, max_words: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each phrase length, the words at which such a phrase starts."""
        open_ = np.ones(self.n, bool)
        for k in range(1, max_words + 1):
            if k > 1:
                open_ = open_[: self.n - k + 1] & self.joined[k - 2 :] if self.n >= k else np.zeros(0, bool)
            yield k, np.flatnonzero(open_)

    def numbers(self, lang_seeds: np.ndarray, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, where phrases start and a 64-bit number of each."""
        digest = xxhash.xxh3_64_intdigest
        own = np.array([digest(w) for w in self.dictionary.to_pylist()], np.uint64)[self.id] if self.n else np.zeros(0, np.uint64)
        run = _mixed(own ^ lang_seeds[self.lang]) if self.n else own
        for k, at in self.starts(max_words):
            if k > 1:
                run = _mixed(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :]) if len(run) else run
            yield k, at, run[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a number over all of it."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slices(batches, lang_codes: dict, most: int) -> Iterator[Words]:
    """The words of the batches' (text, lang) rows, about ``most`` bytes at a time.
    ``lang_codes`` gets a number for each language met."""
    for batch in batches:
        texts = pc.cast(pc.fill_null(batch.column("text"), ""), pa.large_string())
        langs = np.array([lang_codes.setdefault(x, len(lang_codes)) for x in batch.column("lang").to_pylist()], np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            if offsets[to] - offsets[at] <= 2 * most:
                yield Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], langs[at:to])
            else:
                # One long text, cut behind the ends of pieces.
                own = data[offsets[at] : offsets[to]]
                ends = np.flatnonzero(_KIND[own] == 2) + 1
                start = 0
                while start < len(own):
                    near = np.searchsorted(ends, start + most)
                    stop = int(ends[near]) if near < len(ends) else len(own)
                    yield Words(own[start:stop], np.array([0, stop - start]), langs[at : at + 1])
                    start = stop
            at = to


def _seeds(lang_codes: dict) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in lang_codes], np.uint64)


def _counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    return numbers[first], np.diff(np.append(first, len(numbers)))


_BLOCK = "part int, once binary, often binary, counts binary"


def _blocks(docs: DataFrame, part_bits: int, max_words: int) -> DataFrame:
    """Per task and hash partition, the numbers met once and those met more often."""
    drop = np.uint64(64 - REST_BITS - part_bits)

    def emit(gathered: list) -> pa.RecordBatch:
        numbers, counts = _counted(np.concatenate(gathered))
        part = (numbers >> np.uint64(REST_BITS)).astype(np.int64)
        rest = (numbers & np.uint64((1 << REST_BITS) - 1)).astype(np.uint32)
        parts, first = np.unique(part, return_index=True)
        rows = []
        for p, a, b in zip(parts.tolist(), first, np.append(first[1:], len(part))):
            single = counts[a:b] == 1
            rows.append((p, rest[a:b][single].tobytes(), rest[a:b][~single].tobytes(), counts[a:b][~single].astype(np.uint32).tobytes()))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["part", "once", "often", "counts"])

    def run(batches):
        codes: dict = {}
        gathered, held = [], 0
        for words in _slices(batches, codes, SLICE_BYTES):
            for _, _, numbers in words.numbers(_seeds(codes), max_words):
                gathered.append(numbers >> drop)
                held += len(numbers)
            if held >= FLUSH:
                yield emit(gathered)
                gathered, held = [], 0
        if held:
            yield emit(gathered)

    return docs.mapInArrow(run, _BLOCK)


class Summary:
    """A Misra-Gries summary of numbers with counts, in order of the numbers."""

    def __init__(self, least: int, capacity: int = FEWEST_CAPACITY):
        self.least, self.capacity = least, capacity
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.mass = self.taken = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add the counters of another summary, or counts of another block."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.mass += int(counts.sum()) - int(self.counts.sum())
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(keys) else counts
        self.capacity = max(self.capacity, 2 * self.mass // self.least + 1)
        self._shrink()

    def _shrink(self) -> None:
        over = len(self.keys) - self.capacity
        if over <= 0:
            return
        # The count of the first counter beyond the capacity, from the largest.
        take = int(np.partition(self.counts, over - 1)[over - 1])
        if self.taken + take >= self.least:
            self.capacity = 2 * len(self.keys)
            return
        stays = self.counts > take
        self.keys, self.counts = self.keys[stays], self.counts[stays] - take
        self.taken += take

    def survivors(self) -> np.ndarray:
        """Numbers that may have been met ``least`` times; nobody else was."""
        return self.keys[self.counts + self.taken >= self.least]


def _survivors(blocks: DataFrame, least: int) -> DataFrame:
    """(part, n, numbers): what the summary of each hash partition keeps."""
    rows = blocks.repartition("part").sortWithinPartitions("part")

    def run(batches):
        part, summary, waiting, held = None, None, [], 0

        def add() -> None:
            nonlocal waiting, held
            if waiting:
                keys, counts = (np.concatenate(x) for x in zip(*waiting))
                summary.merge(keys, counts)
            waiting, held = [], 0

        def result() -> pa.RecordBatch:
            add()
            kept = summary.survivors()
            columns = [pa.array([part], pa.int32()), pa.array([len(kept)], pa.int64()), pa.array([kept.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "n", "numbers"])

        for batch in batches:
            for p, once, often, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if part is not None:
                        yield result()
                    part, summary = p, Summary(least)
                single = np.frombuffer(once, np.uint32)
                waiting.append((single, np.ones(len(single), np.int64)))
                waiting.append((np.frombuffer(often, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64)))
                held += len(single) + len(often) // 4
                # Merged when there is about as much as the summary holds.
                if held >= max(FEWEST_CAPACITY, len(summary.keys)):
                    add()
        if part is not None:
            yield result()

    return rows.mapInArrow(run, "part int, n long, numbers binary")


def _bit_table(survivors: DataFrame, part_bits: int) -> tuple[np.ndarray, int]:
    """The survivors' bits, and how many bits of a number find one: at least eight per
    survivor, at most ``2 ** MOST_BITS``."""
    total = survivors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = min(max(int(8 * total).bit_length(), FEWEST_BITS, part_bits + 3), MOST_BITS)
    rest = bits - part_bits

    def run(batches):
        for batch in batches:
            for p, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.zeros(1 << rest, bool)
                own[np.frombuffer(numbers, np.uint32) >> np.uint32(REST_BITS - rest)] = True
                packed = np.packbits(own, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed], pa.binary())], ["part", "bits"])

    table = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (rest - 3)
    made = survivors.where("n > 0").select("part", "numbers").mapInArrow(run, "part int, bits binary")
    for row in made.toLocalIterator():
        table[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def _exact(docs: DataFrame, table: np.ndarray, bits: int, max_words: int) -> DataFrame:
    """(lang, words, phrase, f) of phrases whose bit is set; those of no words carry the
    number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    drop = np.uint64(64 - bits)

    def emit(langs: list[str], words: Words, k: int, at: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        # One occurrence of each; a language's words are told apart by its number.
        ids = [words.lang[at], *(words.id[at + i].astype(np.int64) for i in range(k))]
        order = np.lexsort([*reversed(ids), numbers])
        same = np.ones(max(len(order) - 1, 0), bool)
        for column in ids:
            same &= column[order][1:] == column[order][:-1]
        first = np.flatnonzero(np.append(True, ~same))
        counts = np.diff(np.append(first, len(order)))
        one = at[order[first]]
        parts = [pc.take(words.dictionary, pa.array(words.id[one + i])) for i in range(k)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if k > 1 else parts[0]
        names = pa.array(langs).take(pa.array(words.lang[one]))
        columns = [names, pa.array(np.full(len(one), k, np.int32)), pc.cast(phrase, pa.string()), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "f"])

    def run(batches):
        flags = shared.value
        codes: dict = {}
        totals: dict[int, int] = {}
        for words in _slices(batches, codes, SLICE_BYTES):
            if not words.n:
                continue
            langs = list(codes)
            for lang, n in zip(*np.unique(words.lang, return_counts=True)):
                totals[int(lang)] = totals.get(int(lang), 0) + int(n)
            for k, at, numbers in words.numbers(_seeds(codes), max_words):
                place = numbers >> drop
                may = (flags[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if may.any():
                    yield emit(langs, words, k, at[may], numbers[may])
        langs = list(codes)
        columns = [pa.array([langs[i] for i in totals], pa.string()), pa.array([0] * len(totals), pa.int32())]
        columns += [pa.array([""] * len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "f"])

    found = docs.mapInArrow(run, "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def frequent(
    docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, words, phrase, f) of all phrases seen ``least`` times, exactly counted; rows
    of no words hold the number of all words of a language."""
    docs = docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 1), F.lit(0)).alias("n")).first()["n"]
    # A word takes two bytes at least, with what parts it from the next.
    partitions = max_words * size // 2 // PARTITION_MASS + 1
    part_bits = min(max(int(partitions - 1).bit_length(), 6), MOST_PARTITION_BITS)
    survivors = stored(_survivors(_blocks(docs, part_bits, max_words), least), "phrase-survivors")
    table, bits = _bit_table(survivors, part_bits)
    counted = _exact(docs, table, bits, max_words)
    return stored(counted.where((F.col("f") >= least) | (F.col("words") == 0)), "phrase-counts")


def _whole(number: Column) -> Column:
    return number.cast("decimal(20,0)")


def _part(phrase: Column, first: Column, n: Column) -> Column:
    """``n`` words of a space-joined phrase from the word number ``first`` (from 1)."""
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    covered: int = COVERED,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language."""
    counts = frequent(docs, least, max_words, text, lang)
    phrases = counts.where("words > 0")
    candidates = phrases.where("words > 1").withColumnRenamed("f", "a")

    left = phrases.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns(
        {"_left": _part(F.col("phrase"), F.lit(1), F.col("cut")), "_right": _part(F.col("phrase"), F.col("cut") + 1, F.col("words") - F.col("cut"))}
    )
    cuts = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    # Whole division of decimals: no rounding at any size.
    scored = cuts.withColumns(
        {"_top": _whole(F.col("a")) * F.lit(SCALE).cast("decimal(10,0)"), "_sum": _whole(F.col("l")) + _whole(F.col("r"))}
    ).withColumn("score", F.expr("_top div _sum").cast("long"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "words", "a", "l", "r")).alias("_low"))
    lowest = lowest.select("lang", "phrase", "_low.*")

    # The largest count of a longer phrase around each.
    spans = candidates.where("words > 2").select(
        "lang", "phrase", "words", F.col("a").alias("_longer"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_n")
    )
    spans = spans.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_n") + 1)))
    inner = spans.select("lang", _part(F.col("phrase"), F.col("_from"), F.col("_n")).alias("phrase"), "_longer")
    inner = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    much = _whole(F.col("_longer")) * 100 >= _whole(F.col("a")) * covered
    open_ = lowest.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(much, F.lit(False)))

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language may hold most phrases: the best of each part first, then of these.
    salted = open_.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    some = salted.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
