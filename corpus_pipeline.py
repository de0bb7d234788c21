"""From raw documents to token sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read back as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm import bpe, mixing, ngram_join, pii, quality
from formbook.llm.graph import stored
from formbook.sources.tables import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored
    like any other, repeated rows alike; extra columns keep their values unless they are
    named like a result of the classifier, then they are put aside."""
    weights = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    rows, back = _aside(docs, "score", "predicted")
    kept = quality.score(rows, weights).where("predicted = 1").select(*rows.columns)
    return kept.withColumnsRenamed(back).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates. Documents
    without a text are alike only to each other; all columns are kept."""
    return ngram_join.keep_one(docs, ngram_join.join(docs)).select(*docs.columns)


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names put aside, and how to name them back."""
    back = {f"_own_{c}": c for c in names if c in docs.columns}
    return docs.withColumnsRenamed({c: aside for aside, c in back.items()}), back


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; null texts stay null. Columns named
    like the detector's results keep their values."""
    rows, back = _aside(docs, "pii", "redacted")
    clean = pii.detect(rows, pii.fit(rows))
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    clean = clean.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*rows.columns)
    return clean.withColumnsRenamed(back).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; a null source is one of
    its own. Columns named like results of the mix keep their values."""
    rows, back = _aside(docs, "size", "source_size", "target", "repeats", "taken")
    return mixing.repeat_rows(mixing.mix(rows)).select(*rows.columns).withColumnsRenamed(back).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text. A null
    text is encoded as an empty one. Columns named ids, n_tokens or decodes are replaced,
    others keep their values."""
    results = ("ids", "n_tokens", "decodes")
    kept = docs.drop(*results)
    rows, back = _aside(kept, "starts", "ends", "decoded")
    coded = bpe.round_trip(rows, VOCABULARY, PATTERN, keep=tuple(rows.columns))
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    made = coded.select(*rows.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))
    return made.withColumnsRenamed(back).select(*kept.columns, *results)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram join", drop_near_copies),
    ("personal data", redact),
    ("source mix", mix_sources),
    ("byte-level bpe", encode),
]

# A trained classifier and similarity of sets are beyond SQL; tests/llm compares
# every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{at}")
    return docs
