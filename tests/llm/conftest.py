import pytest

# The rows that every operator must survive: nulls anywhere, empty and long texts,
# repeated rows and ties.
ODD_DOCS = [
    (1, "plain words stand here and there in this short text", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "plain words stand here and there in this short text", "en", None, 10),
    (5, "long " * 60_000, "en", "b", 300_000),
    (6, "the same row twice, with some words to share among rows", "en", "b", 5),
    (6, "the same row twice, with some words to share among rows", "en", "b", 5),
    (7, "é\u0000ß \U0001f600 <|im_end|> mail a.b@c.de\n\n\t", "de", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD_DOCS, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(odd):
    """The odd rows with extra columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = "score predicted size target taken repeats source_size pii redacted ids starts ends decoded digest bands code label spans kept_text".split()
    return odd.withColumns({n: F.lit("x") for n in names})
