"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Characters of text that one step of a function holds at once.
SLICE_CHARS = 1 << 20


def text_slices(batches, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with their texts (null: empty): about ``chars`` characters
    each, or one longer row."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
        at, size = 0, 0
        for i, more in enumerate(sizes):
            size += more
            if size >= chars or i + 1 == len(sizes):
                # Only this part's texts become Python strings.
                part = batch.slice(at, i + 1 - at)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                at, size = i + 1, 0


def append_columns(
    df: DataFrame, text: str, keep: list[str], added: dict[str, str], make: Callable[[], Callable[[list[str]], list]]
) -> DataFrame:
    """``keep`` and the columns ``added`` (name to type) that a function makes from texts.

    ``make()`` runs once per task and returns the function: from the texts of a
    slice to one Arrow array or list per added column. A kept column that is also
    added is replaced.
    """
    keep = [c for c in keep if c not in added]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` {k}" for c, k in added.items())])

    def run(batches):
        work = make()
        for part, texts in text_slices(batches, text):
            made = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(texts)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, *added])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
