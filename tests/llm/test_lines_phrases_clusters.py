"""Line dedup, phrase mining and centroid clustering against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook.llm import catalog, centroids, line_dedup, phrases
from tests.llm.conftest import SCHEMA


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- lines


def plain_lines(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = lower_ascii(line.strip(line_dedup.BLANKS))
            if len(key) >= 20:
                holders[key].add(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keys = [lower_ascii(x.strip(line_dedup.BLANKS)) for x in lines]
        kept = [x for x, k in zip(lines, keys) if k not in last or last[k] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def said_lines(df):
    found = line_dedup.without_repeats(df)
    kept = F.sha2(line_dedup.kept_text(F.col("text"), F.col("bitmap")), 256)
    return sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", kept).collect()), key=str)


def line_rows():
    rng = random.Random(3)
    stock = [f"A stock line number {i} with some  WORDS" for i in range(30)]
    stock += ["short", "", "   ", "é" * 20, "É" * 20, "x" * 19, " y" * 10, "\t" + "z" * 20 + "\x0b"]
    rows = []
    for doc in range(60):
        lines = [rng.choice(stock) if rng.random() < 0.6 else f"own line {doc} {i} and more of it" for i in range(rng.randint(0, 9))]
        lines = [x.upper() if rng.random() < 0.2 else x for x in lines] + ["one line that all documents hold"] * rng.randint(1, 3)
        rng.shuffle(lines)
        rows.append((doc, "\n".join(lines)))
    rows += [(7, rows[7][1]), (8, "another text of document eight\n" + stock[0]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(f"line number {i % 500} of a very long text" for i in range(20_000)))]
    rows += [(104, "\n".join(f"line number {i} of a very long text" for i in range(0, 500, 7)) + "\r\n"), (105, "Line Number 499 of a very long text ")]
    rows += [(106, "line number 499 of a very long text")]
    return rows


@pytest.mark.parametrize("partitions", [1, 13])
def test_lines_equal_the_plain_version(spark, partitions):
    rows = line_rows()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = said_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_lines(rows)


def test_one_line_of_all_documents_is_cut_into_ranges(spark):
    rows = [(i, f"the one line that every document holds\nown words of document number {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert said_lines(df) == plain_lines(rows)


def test_bitmaps_of_far_lines(spark):
    places = [0, 63, 64, 700, 701, 1_000_000]
    df = spark.createDataFrame([(1, 5, p) for p in places], "doc long, version long, place int")
    row = line_dedup.bitmaps(df).first()
    assert row["n_dropped"] == len(places) and len(row["bitmap"]) == 1_000_000 // 64 + 1
    got = [64 * i + b for i, w in enumerate(row["bitmap"]) for b in range(64) if w >> b & 1]
    assert got == places


def test_lines_of_odd_rows(odd, none, clashing):
    from pyspark.sql import functions as F

    plain = plain_lines([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert said_lines(odd) == plain
    assert line_dedup.without_repeats(none).count() == 0
    mixed = clashing.withColumns({n: F.lit("x") for n in "bitmap n_lines n_dropped hash doc version place range line key _doc _bitmap".split()})
    assert said_lines(mixed) == plain
    assert set(mixed.columns) == set(line_dedup.without_repeats(mixed).columns)


# --- phrases


def plain_phrases(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {p: c for p, c in f.items() if c >= least}
    covered = Counter()
    for (lang, words), c in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                covered[lang, words[i : i + k]] = max(covered[lang, words[i : i + k]], c)
    by_lang = defaultdict(list)
    for (lang, words), a in often.items():
        if len(words) < 2 or 100 * covered[lang, words] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def text_rows(seed=4, docs=1200):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(6)] + ["The", "é", "ÉA", "a.b", "x y", "don't"]
    rows = []
    for _ in range(docs):
        text = "".join(
            rng.choice(words) + rng.choice([" "] * 8 + ["\t", "  ", ", ", "\n", ".", "!? ", "\r\n", " ; "])
            for _ in range(rng.randint(0, 60))
        )
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), (None, None), ("fr", "only one text here"), ("en", "a  very long way " * 20_000), ("de", "  \t ")]


@pytest.mark.parametrize("least, top", [(30, 2000), (5, 40)])
def test_phrases_equal_the_plain_version(spark, least, top, monkeypatch):
    # Small slices and blocks, so that summaries are merged and long texts are cut.
    monkeypatch.setattr(phrases, "SLICE_BYTES", 300)
    monkeypatch.setattr(phrases, "FLUSH", 2000)
    rows = text_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=top).collect())
    want = plain_phrases(rows, least, top)
    assert got == want and len(got) > 20


def test_summaries_lose_no_frequent_number():
    rng = np.random.default_rng(5)
    least = 30
    numbers = np.concatenate([rng.integers(0, 1 << 32, 60_000), np.repeat(rng.integers(0, 1 << 32, 300), rng.integers(20, 60, 300))])
    rng.shuffle(numbers)
    # So small a capacity that counters are taken down, and grow rather than lose.
    summary = phrases.Summary(least, capacity=64)
    sizes = []
    for block in np.array_split(numbers.astype(np.uint32), 50):
        keys, counts = np.unique(block, return_counts=True)
        summary.merge(keys, counts)
        sizes.append(len(summary.keys))
    keys, counts = np.unique(numbers.astype(np.uint32), return_counts=True)
    assert summary.mass == len(numbers) and 0 < summary.taken < least
    assert set(keys[counts >= least]) <= set(summary.survivors())
    assert max(sizes) <= 2 * len(numbers) // least + 1
    true = dict(zip(keys.tolist(), counts.tolist()))
    assert all(c <= true[k] <= c + summary.taken for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_a_full_bit_table_loses_nothing(spark, monkeypatch):
    rows = text_rows(6, 100)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "FEWEST_BITS", 9)
    monkeypatch.setattr(phrases, "MOST_BITS", 9)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=5).collect())
    assert got == plain_phrases(rows, 5)


def test_phrases_of_odd_rows(spark, odd, none, clashing):
    names = "words phrase f l r n rank part a".split()
    crowded = clashing.withColumns({x: F.lit("x") for x in names})
    want = plain_phrases([(r["lang"], r["text"]) for r in odd.collect()], 2)
    for df in (odd, crowded):
        assert sorted(tuple(r) for r in phrases.collocations(df, least=2).collect()) == want
    assert want and phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))).count() == 0


# --- clusters


def plain_clusters(rows, k, rounds, dims):
    whole = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            whole.append((vec_id, [math.floor(256 * x) for x in v]))
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), np.array(v, np.int32).tobytes()) for i, v in whole)
    means = [np.frombuffer(b, np.int32).tolist() for _, b in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in whole:
            own[near(v)[1]].append(v)
        for c, vs in own.items():
            means[c] = [sum(x) // len(vs) for x in zip(*vs)]
    last = [(i, *near(v)) for i, v in whole]
    inertia = Counter()
    for _, d, c in last:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in last), key=str)


def vector_rows(dims=6):
    rng = random.Random(8)
    heads = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(heads)]) for i in range(400)]
    rows += [(i, list(heads[0])) for i in range(500, 600)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (601, None), (602, []), (603, heads[0][:-1])]
    return rows + [(604, [None, *heads[1][1:]]), (605, [math.nan, *heads[1][1:]]), (606, [-math.inf, *heads[1][1:]])]


RESULT = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("k", [1, 12, 2000])
def test_clusters_equal_the_plain_version(spark, k):
    rows = vector_rows() if k < 100 else vector_rows()[:60]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = centroids.cluster(df, k=k, rounds=4, dims=6).select(*RESULT).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, k, 4, 6)


def test_tables_give_the_distances():
    rng = np.random.default_rng(9)
    rows, middle = rng.integers(-200, 200, (500, 5)).astype(np.int32), rng.integers(-200, 200, (9, 5))
    number, distance = centroids.nearest(rows, middle)
    full = ((rows[:, None, :].astype(np.int64) - middle[None]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_sums_beyond_a_long_are_exact():
    big = centroids.moved(np.zeros((2, 1), np.int64), [{"cluster": 0, "dim": 0, "sum": -(2**70) - 1, "n": 2**62}])
    assert big.tolist() == [[-257], [0]]


def test_clusters_of_odd_vectors(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    crowded = df.withColumns({n: F.lit("x") for n in "cluster distance inertia n sums label".split()})
    made = centroids.cluster(crowded, k=5, rounds=2, dims=6)
    assert set(made.columns) == {*RESULT, "n", "sums", "label"}
    assert sorted((tuple(r) for r in made.select(*RESULT).collect()), key=str) == plain_clusters(rows, 5, 2, 6)
    none = centroids.cluster(df.limit(0), dims=6)
    assert none.select(*RESULT).count() == 0 and none.schema["inertia"].dataType.simpleString() == "bigint"
    far = spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(far, dims=6).collect()


def test_embeddings_of_no_rows_and_schema(spark):
    assert SCHEMA.startswith("doc_id")
    wanted = {"op11_line_dedup", "op12_phrase_mining", "op13_centroids"}
    queries, checks = catalog.load()
    assert wanted <= set(queries) and wanted <= set(checks)
