"""Line dedup: range-partitioned line hashes, streamed in order of document and place.

A text is split at line feeds. A line's key is the line without blanks at both ends and
with A-Z in lower case. Keys of at least ``least_chars`` code points that at least
``least_docs`` documents hold lose all their lines but those of the largest document
that holds them. Shorter and rarer ones stay.

Lines are hashed (128 bits), and only hash, document and place move. They are cut into
ranges along (hash, document from the largest, place), so one line that fills a third
of the table is spread over many ranges like any other. Along that order the first
occurrence of a hash names the largest document, and each change of document counts
one. Within a range this is a window of one sorted run; a hash that crosses the edge of
a range is counted from all its ranges by an aggregate that is combined before the
shuffle. Of these there are at most as many as ranges, which bounds the broadcast.

The result is a bitmap per document, 64 lines to a number, bit set: the line goes. Words
of 64 lines without a dropped one behind the last dropped one are left out, and documents
that lose nothing have no row. ``kept_text`` applies a bitmap to the text.

Null and empty texts are one empty line. Rows of the same document number are one
document: their lines are counted once, and in the largest document all of them stay;
each row has its own bitmap, equal rows the same. Rows without a number are together
one document, smaller than every other. Texts of any length are split whole; a document
is the unit that one task holds. An empty table gives an empty result. Columns of the
input that clash with results are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.graph import stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 20
LEAST_DOCS = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; of pure ASCII text ``lower`` does just that, and faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _version(text: Column) -> Column:
    """Tells rows of the same document number with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _line_hashes(docs: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """(hash, doc, version, place) of every line whose key is long enough."""
    lines = docs.select(
        F.col(doc_id).alias("doc"), _version(F.col(text)).alias("version"), F.posexplode(lines_of(F.col(text))).alias("place", "line")
    )
    # A key is never longer than its line.
    keyed = lines.where(F.length("line") >= least_chars).select("doc", "version", "place", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= least_chars).select(F.unhex(F.md5("key")).alias("hash"), "doc", "version", "place")


def dropped_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """(doc, version, place) of the lines that go."""
    order = [F.col("hash"), F.col("doc").desc_nulls_last(), F.col("version"), F.col("place")]
    ranged = _line_hashes(docs, doc_id, text, least_chars).repartitionByRange(*order)
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "line-ranges")

    # Hashes at the edges of ranges: at most two per range.
    edges = ranged.groupBy("range").agg(F.array(F.min("hash"), F.max("hash")).alias("edge"))
    edges = edges.select("range", F.explode(F.array_distinct("edge")).alias("hash"))
    crossing = edges.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hash")
    # Counted in two steps, each combined before its shuffle.
    spread = ranged.join(F.broadcast(crossing), "hash").groupBy("hash", "doc").agg(F.count(F.lit(1)).alias("_n"))
    spread = spread.groupBy("hash").agg(F.count(F.lit(1)).alias("all_docs"), F.max("doc").alias("all_first"))

    run = Window.partitionBy("range", "hash").orderBy(*order[1:])
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag("doc").over(run)
    new = (F.row_number().over(run) == 1) | ~F.col("doc").eqNullSafe(before)
    streamed = ranged.withColumn("_new", new.cast("long")).select(
        "range", "hash", "doc", "version", "place", F.sum("_new").over(whole).alias("docs"), F.first("doc").over(run).alias("first")
    )
    counted = streamed.join(F.broadcast(spread), "hash", "left")
    first = F.when(F.col("all_docs").isNull(), F.col("first")).otherwise(F.col("all_first"))
    often = F.coalesce("all_docs", "docs") >= least_docs
    return counted.where(often & ~F.col("doc").eqNullSafe(first)).select("doc", "version", "place")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, version, bitmap, n_dropped): one row per document that loses lines."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    bits = dropped.withColumns({"word": F.floor(F.col("place") / 64).cast("int"), "bit": bit})
    words = bits.groupBy("doc", "version", "word").agg(F.bit_or("bit").alias("bits"))
    packed = words.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    gap = lambda w, i: w["word"] - F.when(i == 0, F.lit(0)).otherwise(F.get("words", i - 1)["word"] + 1)
    dense = F.flatten(F.transform("words", lambda w, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(w, i)), F.array(w["bits"]))))
    count = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    return packed.select("doc", "version", dense.alias("bitmap"), count.alias("n_dropped"))


def is_dropped(bitmap: Column, place: Column) -> Column:
    word = F.coalesce(F.get(bitmap, F.floor(place / 64).cast("int")), F.lit(0).cast("long"))
    return F.getbit(word, place % 64) == 1


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines whose bit is not set, joined by line feeds; a null text is empty."""
    kept = F.filter(lines_of(text), lambda line, at: ~is_dropped(bitmap, at))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def without_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """The columns of ``docs`` and ``bitmap`` (null: all stay), ``n_lines``, ``n_dropped``."""
    found = bitmaps(dropped_lines(docs, doc_id, text, least_chars, least_docs)).alias("_found")
    added = ("bitmap", "n_lines", "n_dropped")
    rows = docs.drop(*added).alias("_docs")
    same = F.col(f"_docs.`{doc_id}`").eqNullSafe(F.col("_found.doc")) & (_version(F.col(f"_docs.`{text}`")) == F.col("_found.version"))
    return rows.join(found, same, "left").select(
        *[F.col(f"_docs.`{c}`") for c in rows.columns],
        F.col("_found.bitmap").alias("bitmap"),
        F.size(lines_of(F.col(f"_docs.`{text}`"))).cast("long").alias("n_lines"),
        F.coalesce("_found.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
