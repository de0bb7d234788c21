"""Each stage of the corpus pipeline against a plain version, on the smallest tables."""

from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from formbook.llm import bpe, mixing, pii
from formbook.llm.graph import stored
from tests.llm.test_joins_and_trees import plain_join
from tests.llm.test_text_operators import plain_base

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        found.append(docs)
    return found


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_of_documents_stay(steps):
    for df in steps[:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality_keeps_clean_documents(spark, steps):
    before, after = rows_of(steps[0]), rows_of(steps[1])
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(after[i] == before[i] for i in after)
    assert {i for i, q in marks.items() if q == 1} <= set(after)
    assert not {i for i, q in marks.items() if q == 0} & set(after)


def test_one_document_of_each_group_stays(steps):
    before, after = rows_of(steps[1]), rows_of(steps[2])
    components = {int(i): int(c) for i, _, c in plain_join([(i, r["text"]) for i, r in before.items()])}
    assert set(after) == {i for i, c in components.items() if i == c}
    assert all(after[i] == before[i] for i in after)


def test_personal_data_goes_and_the_rest_stays(steps):
    before, after = rows_of(steps[2]), rows_of(steps[3])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not plain_base(r["text"]) and r["n_chars"] == len(r["text"])
        if not plain_base(before[i]["text"]) and "token" not in before[i]["text"]:
            assert r == before[i]


def test_documents_are_repeated_as_the_mix_says(steps):
    plan = {r["doc_id"]: r["repeats"] for r in mixing.mix(steps[3]).collect()}
    before, got = rows_of(steps[3]), Counter(tuple(r) for r in steps[4].collect())
    assert got == Counter({tuple(before[i]): n for i, n in plan.items() if n})


def test_ids_are_those_of_the_ranks(steps):
    plain = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY),
        special_tokens={},
    )
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r["ids"] == plain.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["decodes"]


def test_run_gives_what_the_stages_give(spark, steps):
    got = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == sorted((r["doc_id"], r["n_tokens"]) for r in steps[5].collect())


def test_stages_survive_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, FOLDER), "test-odd")
        assert "ids" in docs.columns
    assert pii.fit(none) is None


def test_stages_keep_columns_named_like_results(spark, clashing):
    docs = clashing
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-clashing")
    kinds = dict(docs.dtypes)
    assert kinds["ids"] == "array<int>" and kinds["n_tokens"] == "bigint" and kinds["decodes"] == "boolean"
    assert [c for c in docs.columns if c not in ("ids", "n_tokens", "decodes")] == [c for c in clashing.columns if c != "ids"]
    kept = [c for c in clashing.columns if c not in ("doc_id", "text", "lang", "source", "n_chars", "ids")]
    assert {tuple(r) for r in docs.select(*kept).distinct().collect()} <= {("x",) * len(kept)}


def test_encoding_replaces_kept_columns_of_its_names(spark, clashing):
    keep = ("doc_id", "ids", "ends", "decoded", "label")
    made = bpe.round_trip(clashing, corpus_pipeline.VOCABULARY, corpus_pipeline.PATTERN, keep=keep)
    assert sorted(made.columns) == sorted(["doc_id", "label", "ids", "starts", "ends", "decoded"])
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in made.join(clashing.select("doc_id", "text").distinct(), "doc_id").collect())
    again = bpe.decode(made, corpus_pipeline.VOCABULARY, corpus_pipeline.PATTERN, keep=("doc_id", "decoded"))
    assert again.columns == ["doc_id", "decoded"] and again.count() == clashing.count()
