"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file (one ``base64(bytes) rank`` per line) gives the vocabulary. The
tokenizers library wants merges instead of ranks: the pair behind a token is what
merging its own bytes by rank leaves just before the last merge, and no other pair
of neighbours can ever form that token, because merges inside a stretch of bytes
do not depend on what stands around it as long as nothing crosses its borders.

Every byte has a printable stand-in character, so any byte string, also half a
character, is a string of the vocabulary. Offsets come from that mapping: the
tokens of a text concatenate to exactly its bytes, so a running sum of token
lengths gives byte borders, and counting lead bytes turns them into code points.
A token that holds part of a character gets the whole character as its span.

Long texts are cut into pieces where no match of the pattern can span the cut (a
letter or digit followed by a blank), so memory depends on the piece, not the text.

Null text counts as empty; empty text has no tokens. Decoding ids outside the
vocabulary, or null ids, raises; a null id list decodes to no bytes. Repeated rows are
encoded each, alike; an empty table gives an empty result. Kept columns that are named
like a result are replaced by it.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from formbook.llm.arrow import text_slices

# Characters handed to the tokenizer at once.
PIECE_CHARS = 1 << 16
BATCH_CHARS = 1 << 19
# Distinct matches in each of a worker's two tables.
KNOWN_MATCHES = 120_000
# Matches given to the library in one call; its results are large.
LEARN_AT_ONCE = 2_000


def byte_characters() -> list[str]:
    """The stand-in of each byte: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the token's bytes reach by merging along the ranks."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(
            ((ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks),
            default=None,
        )
        if best is None:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def tokenizer_json(path: str) -> str:
    """The vocabulary as a definition the tokenizers library reads; it takes one match
    of the pattern at a time."""
    stand_in = byte_characters()
    ranks = read_ranks(path)
    text = {t: "".join(stand_in[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        pair = last_pair(token, ranks) if len(token) > 1 else None
        if pair:
            merges.append([text[pair[0]], text[pair[1]]])
    by_byte = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [],
            "normalizer": None,
            "pre_tokenizer": by_byte,
            "post_processor": None,
            "decoder": None,
            "model": {
                "type": "BPE",
                "dropout": None,
                "unk_token": None,
                "continuing_subword_prefix": None,
                "end_of_word_suffix": None,
                "fuse_unk": False,
                "byte_fallback": False,
                # A match that is a token as a whole is that token.
                "ignore_merges": True,
                "vocab": {text[t]: i for t, i in ranks.items()},
                "merges": merges,
            },
        }
    )


class Codec:
    """One worker's tokenizer, its table from ids to bytes and the matches seen so far.

    Words repeat, so a match goes through the library once and is then looked up, as
    long as it comes up again before two tables of matches have filled.
    """

    def __init__(self, definition: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.matches = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(definition)["model"]["vocab"]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # One object per id for all entries of ``known``.
        self.ids = list(range(len(self.bytes)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [[self.matches(piece) for piece in split_safely(text)] for text in texts]
        self.learn({word for pieces in split for words in pieces for word in words})
        return [self.look_up(chain.from_iterable(pieces)) for pieces in split]

    def look_up(self, words) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32)

    def learn(self, found: set[str]) -> None:
        """Put all of ``found`` into ``known``. A full table becomes the older one, from
        which words that come up again move over; the rest of it goes at the next change."""
        if len(self.known) + len(found) > KNOWN_MATCHES:
            self.known, self.older = {}, self.known
        new = []
        for word in found.difference(self.known):
            ids = self.older.get(word)
            if ids is None:
                new.append(word)
            else:
                self.known[word] = ids
        for at in range(0, len(new), LEARN_AT_ONCE):
            words = new[at : at + LEARN_AT_ONCE]
            for word, one in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
                self.known[word] = tuple(map(self.ids.__getitem__, one.ids))

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code-point start and end of each token."""
        raw = np.frombuffer(text.encode(), np.uint8)
        lead = np.cumsum((raw & 0xC0) != 0x80)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if len(ids) == 0:
            return starts.astype(np.int32), ends.astype(np.int32)
        return (lead[starts] - 1).astype(np.int32), lead[ends - 1].astype(np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        at = np.asarray(ids, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self.bytes)):
            raise ValueError("an id outside the vocabulary")
        return b"".join(map(self.bytes.__getitem__, at.tolist()))


_CUT = re.compile(r"(?<=[^\W_])[ \n]")


def split_safely(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of at least ``size`` characters, cut before a blank after a letter or digit.

    No match of the pattern holds a blank after a non-blank, and its one look-ahead
    only sees what follows blanks, so pieces split like the whole.
    """
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


_CODEC: dict[tuple[str, str], Codec] = {}


@contextmanager
def _codec(shared):
    """The worker's codec: built once, used by all its tasks. What a task has learnt
    goes with it, so that idle workers are small."""
    if shared.value not in _CODEC:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CODEC.clear()
        _CODEC[shared.value] = Codec(*shared.value)
    codec = _CODEC[shared.value]
    try:
        yield codec
    finally:
        codec.forget()
        pa.default_memory_pool().release_unused()


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def _encode_columns(codec: Codec, texts: list[str]) -> list[pa.Array]:
    ids = codec.encode(texts)
    spans = [codec.spans(t, x) for t, x in zip(texts, ids)]
    return [_lists(ids), _lists([s for s, _ in spans]), _lists([e for _, e in spans])]


def _with(df: DataFrame, extra: dict[str, str], run: Callable, keep: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + ", ".join(f"{c} {k}" for c, k in extra.items())
    return df.mapInArrow(run, schema)


ENCODED = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>"}


def _shared(df: DataFrame, path: str, pattern: str):
    """The definition as a broadcast: its size is that of one vocabulary."""
    return df.sparkSession.sparkContext.broadcast((tokenizer_json(path), pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids, starts, ends`` of each row's whole text. Kept columns of these
    names are replaced."""
    shared, keep = _shared(df, path, pattern), [c for c in keep if c not in ENCODED]

    def run(batches):
        with _codec(shared) as codec:
            for part, texts in text_slices(batches, text, BATCH_CHARS):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *_encode_columns(codec, texts)], [*keep, *ENCODED]
                )

    return _with(df.select(*dict.fromkeys([*keep, text])), ENCODED, run, keep)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded``, the bytes of each row's ids. Bytes, since ids cut out
    of a sequence can begin or end inside a character. A kept ``decoded`` is replaced."""
    shared, keep = _shared(df, path, pattern), [c for c in keep if c != "decoded"]

    def run(batches):
        with _codec(shared) as codec:
            for batch in batches:
                for row in range(batch.num_rows):
                    part = batch.slice(row, 1)
                    value = part.column(ids).to_pylist()[0]
                    out = pa.array([codec.decode(value or [])], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), out], [*keep, "decoded"])

    return _with(df.select(*dict.fromkeys([*keep, ids])), {"decoded": "binary"}, run, keep)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass over the rows. Kept columns
    named like a result are replaced."""
    shared, keep = _shared(df, path, pattern), [c for c in keep if c not in (*ENCODED, "decoded")]

    def run(batches):
        with _codec(shared) as codec:
            for part, texts in text_slices(batches, text, BATCH_CHARS):
                columns = _encode_columns(codec, texts)
                values = columns[0].values.to_numpy(), columns[0].offsets.to_numpy()
                decoded = [codec.decode(values[0][a:b]) for a, b in zip(values[1], values[1][1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *columns, pa.array(decoded, pa.binary())],
                    [*keep, *ENCODED, "decoded"],
                )

    return _with(df.select(*dict.fromkeys([*keep, text])), {**ENCODED, "decoded": "binary"}, run, keep)
