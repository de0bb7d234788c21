"""Personal data by gradient-boosted candidates.

High-recall generators propose overlapping spans in every whole text: runs around
``@``, dotted and spaced digit groups, and long unbroken strings. Each candidate
gets format features (lengths, character classes, checksums) and context features
(neighbouring characters, what stands before). Boosted trees, fitted on a stated
number of documents, score them, and per kind the lowest threshold that holds the
wanted precision on all documents kept out of the fit selects what is added.

The trees learn from rules that know their kind (a checksum, a key in front of a
quoted string). The same rules' base kinds are always reported, whatever a tree
says: the method only adds spans, and none that overlaps a base span.

Null text counts as empty and holds nothing. Empty tables, or samples without both
outcomes, fit no trees; then only base spans are found. Repeated rows are treated
alike; columns that clash with results are replaced. Matching is linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.arrow import append_columns, text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
# Documents (about) that the trees and thresholds are fitted on.
FIT_DOCS = 6_000
TREES, DEPTH = 12, 4
# Precision that a kind's threshold must hold on documents kept out of the fit.
PRECISION = 0.98
CONTEXT = 24

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE_AT = re.compile(r"@[^\s@<>]{1,80}")
_LOOSE_DIGITS = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){5,24}")
_LONG = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_KEY = re.compile(r"(?i)(?:token|secret|key|password|passwd|pwd)\w*\s*[:=]\s*[\"']?$")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the base rules, leftmost and non-overlapping per kind."""
    found = []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append(("email", start, m.end()))
                last = m.end()
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [
            ("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15
        ]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that might be personal data; generous and overlapping."""
    found = []
    if "@" in text:
        for m in _LOOSE_AT.finditer(text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and not text[start - 1].isspace() and text[start - 1] not in "<>@":
                start -= 1
            found.append(("email", start, m.end()))
    for m in _LOOSE_DIGITS.finditer(text):
        words = m.group()
        n = sum(c.isdigit() for c in words)
        if words.count(".") >= 3:
            found.append(("ip", *m.span()))
        if n >= 13:
            found.append(("card", *m.span()))
        if 7 <= n <= 15:
            found.append(("phone", *m.span()))
    for m in _LONG.finditer(text):
        words = m.group()
        if any(c.isdigit() for c in words) and any(c.isalpha() for c in words):
            found.append(("secret", *m.span()))
    return found


N_FEATURES = 19


def features(text: str, kind: str, start: int, stop: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start : min(stop, start + 256)]
    n = len(span)
    digits = [c for c in span if "0" <= c <= "9"]
    letters = sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    before, after = text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT]
    return [
        float(KINDS.index(kind)),
        float(stop - start),
        float(len(digits)),
        float(letters),
        float(n - len(digits) - letters),
        len(set(span)) / n,
        float(13 <= len(digits) <= 19 and luhn("".join(digits))),
        float(span[0] == "+"),
        float(span.count("@")),
        float(span.count(".")),
        float(max(groups, default=0)),
        float(len(groups)),
        float(all(c in "0123456789abcdefABCDEF" for c in span if c.isalnum())),
        sum(c in "aeiouAEIOU" for c in span) / n,
        _side(before[-1:]),
        _side(after[:1]),
        float(any(c in "=:" for c in before)),
        float(any(c in "\"'" for c in before[-2:])),
        float(sum(c.isdigit() for c in before + after)),
    ]


def _side(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalnum() else 3.0 if c in "\"'" else 4.0 if c in "=:" else 5.0


def is_certain(text: str, kind: str, start: int, stop: int, base: set) -> bool:
    """What the trees learn from: base rules, and a key in front of a string."""
    if kind == "secret":
        return bool(_KEY.search(text[max(0, start - CONTEXT) : start]))
    return (kind, start, stop) in base


@dataclass
class Trees:
    """Boosted trees as flat arrays, and the threshold of each kind."""

    roots: list[int]
    rates: list[float]
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    thresholds: dict[str, float]

    def score(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        at = np.arange(len(rows))
        for root, rate in zip(self.roots, self.rates):
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                f = self.feature[node]
                inner = f >= 0
                goes_left = rows[at, np.where(inner, f, 0)] <= self.cut[node]
                node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
            margin += rate * self.value[node]
        return 1.0 / (1.0 + np.exp(-2.0 * np.clip(margin, -20, 20)))


def _flat(model) -> Trees:
    feature, cut, left, right, value = [], [], [], [], []

    def add(node) -> int:
        at = len(feature)
        for column in (feature, cut, left, right, value):
            column.append(0)
        value[at], feature[at] = node.prediction(), -1
        if node.subtreeDepth() > 0:
            split = node.split()
            feature[at], cut[at] = split.featureIndex(), split.threshold()
            left[at], right[at] = add(node.leftChild()), add(node.rightChild())
        return at

    roots = [add(tree._call_java("rootNode")) for tree in model.trees]
    return Trees(roots, list(model.treeWeights), np.array(feature), np.array(cut, float), np.array(left), np.array(right), np.array(value, float), {})


def _examples(docs: DataFrame, text: str) -> DataFrame:
    """(features, label) of the candidates of ``docs``."""

    def run(batches):
        for _, texts in text_slices(batches, text):
            out = {"features": [], "label": []}
            for words in texts:
                base = set(base_spans(words))
                for found in candidates(words):
                    out["features"].append(features(words, *found))
                    out["label"].append(float(is_certain(words, *found, base)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["features"], pa.list_(pa.float64())), pa.array(out["label"], pa.float64())], list(out)
            )

    return docs.select(text).mapInArrow(run, "features array<double>, label double")


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_docs: int = FIT_DOCS, seed: int = 11) -> Trees | None:
    """Trees from four fifths of about ``fit_docs`` documents chosen by a hash, and
    thresholds from all other documents."""
    rows = docs.count()
    place = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1_000_000))
    fold = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed + 1)), F.lit(5))
    fitted = (place < min(1.0, fit_docs / max(1, rows)) * 1_000_000) & (fold != 0)
    known = _examples(docs.where(fitted), text).withColumn("vector", array_to_vector("features")).cache()
    try:
        seen = {r["label"] for r in known.groupBy("label").count().collect()}
        if len(seen) < 2:
            return None
        trainer = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=seed)
        trees = _flat(trainer.fit(known))
    finally:
        known.unpersist()
    trees.thresholds = lowest_cuts(_counts(docs.where(~fitted), text, trees))
    return trees


def _counts(docs: DataFrame, text: str, trees: Trees) -> list[tuple[int, int, int, int]]:
    """(kind, hundredth of the score, candidates, right ones) over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        # Kind and hundredth as one number, for candidates and for right ones.
        seen = np.zeros((2, len(KINDS) * 101), np.int64)
        for _, texts in text_slices(batches, text):
            rows, right = [], []
            for words in texts:
                found = candidates(words)
                base = set(base_spans(words)) if found else set()
                rows += [features(words, *c) for c in found]
                right += [is_certain(words, *c, base) for c in found]
            if rows:
                x = np.array(rows, float)
                at = x[:, 0].astype(np.int64) * 101 + np.floor(shared.value.score(x) * 100).astype(np.int64)
                seen[0] += np.bincount(at, minlength=seen.shape[1])
                seen[1] += np.bincount(at[np.array(right)], minlength=seen.shape[1])
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // 101), pa.array(at % 101), pa.array(seen[0][at]), pa.array(seen[1][at])], ["kind", "score", "n", "right"]
        )

    counts = docs.select(text).mapInArrow(run, "kind long, score long, n long, right long")
    # At most one row per kind and hundredth.
    counts = counts.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).collect()
    return [(r["kind"], r["score"], r["n"], r["right"]) for r in counts]


def lowest_cuts(counts: list[tuple[int, int, int, int]]) -> dict[str, float]:
    """Per kind, the lowest hundredth (a half at least) from which all scores together
    hold the wanted precision, whatever a few at the top do."""
    out = {}
    for k, kind in enumerate(KINDS):
        n = right = 0
        for _, score, more, good in sorted((c for c in counts if c[0] == k), reverse=True):
            n, right = n + more, right + good
            if score >= 50 and right >= PRECISION * n:
                out[kind] = score / 100
    return out


def find(text: str, trees: Trees | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, stop, score), by kind and start; base spans have score 1."""
    base = base_spans(text)
    found = [(*b, 1.0) for b in base]
    proposed = candidates(text) if trees is not None else []
    if proposed:
        scores = trees.score(np.array([features(text, *c) for c in proposed], float))
        better = [
            (*c, float(s)) for c, s in zip(proposed, scores) if s >= trees.thresholds.get(c[0], 2.0)
        ]
        # Best first; a span that meets one already chosen is left out.
        taken = sorted((a, b) for _, a, b in base)
        for kind, start, stop, s in sorted(better, key=lambda x: (-x[3], x[1] - x[2], x[1])):
            if not any(a < stop and start < b for a, b in taken):
                found.append((kind, start, stop, s))
                taken.append((start, stop))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or what overlapping spans cover together, as its kind."""
    out, last, open_until = [], 0, -1
    for kind, start, stop, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= open_until:
            out += [text[last:start], f"<{kind}>"]
        open_until = last = max(open_until, stop)
    return "".join([*out, text[last:]])


SPANS = "array<struct<kind:string,start:int,stop:int,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))


def detect(docs: DataFrame, trees: Trees | None, text: str = "text", keep: list[str] | None = None, redact: bool = True) -> DataFrame:
    """``keep`` (all columns) with ``pii``, the spans, and ``redacted``, the text without them."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        def run(texts):
            spans = [find(t, shared.value) for t in texts]
            columns = [pa.array([[dict(zip(("kind", "start", "stop", "score"), s)) for s in x] for x in spans], _SPAN_TYPE)]
            if redact:
                columns.append(pa.array([redacted(t, s) for t, s in zip(texts, spans)], pa.string()))
            return columns

        return run

    added = {"pii": SPANS, **({"redacted": "string"} if redact else {})}
    return append_columns(docs, text, list(docs.columns) if keep is None else keep, added, make)
